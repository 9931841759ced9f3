"""Registered queries: schema families and profile."""
from __future__ import annotations

from ..functions.schema import categorical_table
from ..operators import profile as P
from ..sources import views as V
from ..sources.tables import table
from . import fixtures_sql as X
from .registry import finalize, register

# dirty_view / customer schemas as the oracle needs them (name, Spark type, family)
DIRTY_COLS = [("OrderID", "bigint"), ("LineNo", "int"), ("PartID", "bigint"), ("SuppID", "bigint"),
              ("Region", "string"), ("Category", "string"), ("Profit", "double"), ("Revenue", "double"),
              ("Empty", "double"), ("Flat", "double")]
DIRTY_NUM = [c for c, t in DIRTY_COLS if t != "string"]
DIRTY_TEXT = [c for c, t in DIRTY_COLS if t == "string"]
DV = X.with_views(X.SALES, X.DIRTY)


def _union(parts):
    return "\nUNION ALL\n".join(parts)


def _mode_sql(src, cols, extra=""):
    """(column, n_unique, top, top_freq) per text column: most frequent, smallest on ties."""
    parts = [f"""SELECT '{c}' AS "column", CAST({c} AS VARCHAR) AS v, COUNT(*) AS cnt FROM {src}
                 WHERE {c} IS NOT NULL GROUP BY {c}""" for c in cols]
    return f"""vc AS ({_union(parts)}),
ranked AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY "column" ORDER BY cnt DESC, v) AS rk,
                  COUNT(*) OVER (PARTITION BY "column") AS n_unique FROM vc)"""


@register("b2_categorical_columns", X.with_views(X.SALES) + _union([
    f"""SELECT '{c}' AS "column", COUNT(DISTINCT {c}) AS n_unique, COUNT(DISTINCT {c}) <= 50 AS is_categorical
        FROM sales_view""" for c in ("Region", "Category", "Brand")]))
def b2(spark, sf):
    s = V.sales_lines(spark, sf, ["Region", "Category", "Brand"])
    return categorical_table(s)


@register("b5_column_profile", DV + _union([
    f"""SELECT CAST({i} AS BIGINT) AS position, '{c}' AS "column", '{t}' AS dtype,
        COUNT({c}) AS non_null, COUNT(*) - COUNT({c}) AS nulls, COUNT(DISTINCT {c}) AS n_unique FROM dirty_view"""
    for i, (c, t) in enumerate(DIRTY_COLS)]))
def b5(spark, sf):
    return finalize(P.column_profile(V.dirty_view(spark, sf)))


@register("b6_overview", DV + """
SELECT COUNT(*) AS "rows", CAST(10 AS BIGINT) AS "columns", CAST(8 AS BIGINT) AS n_numeric,
       CAST((COUNT(DISTINCT Region) <= 50)::INT + (COUNT(DISTINCT Category) <= 50)::INT AS BIGINT) AS n_categorical,
       CAST(0 AS BIGINT) AS n_datetime,
       CAST(""" + " + ".join(f"COUNT(*) - COUNT({c})" for c, _ in DIRTY_COLS) + """ AS BIGINT) AS missing,
       COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty_view)) AS duplicates
FROM dirty_view""")
def b6(spark, sf):
    return finalize(P.overview(V.dirty_view(spark, sf)))


@register("b7_table_bytes", """
WITH t AS (SELECT SUM(8 + 8 + strlen(o_orderstatus) + 8 + 8 + strlen(o_orderpriority)) AS b FROM orders)
SELECT CAST(b AS BIGINT) AS bytes,
  CASE WHEN b < 1024 THEN format('{:,.1f} B', CAST(b AS DOUBLE))
       WHEN b < 1048576 THEN format('{:,.1f} KB', b / 1024.0)
       WHEN b < 1073741824 THEN format('{:,.1f} MB', b / 1048576.0)
       ELSE format('{:,.1f} GB', b / 1073741824.0) END AS size
FROM t""")
def b7(spark, sf):
    return P.table_bytes(table(spark, sf, "orders"))


@register("b8_preview", "SELECT * FROM orders ORDER BY o_orderkey LIMIT 10")
def b8(spark, sf):
    return P.preview(table(spark, sf, "orders"), 10, order_by=["o_orderkey"])


CUSTOMER_COLS = [("c_custkey", False), ("c_name", True), ("c_nationkey", False), ("c_acctbal", False),
                 ("c_mktsegment", True)]


@register("b9_context_summary", "WITH " + _mode_sql("customer", [c for c, t in CUSTOMER_COLS if t]) + "\n"
          + _union([f"""SELECT CAST({i} AS BIGINT) AS position, '{c}' AS "column", COUNT({c}) AS count,
              """ + (f"""(SELECT n_unique FROM ranked WHERE "column" = '{c}' AND rk = 1) AS "unique",
                     (SELECT v FROM ranked WHERE "column" = '{c}' AND rk = 1) AS top"""
                     if t else """CAST(NULL AS BIGINT) AS "unique", CAST(NULL AS VARCHAR) AS top""")
                    + " FROM customer" for i, (c, t) in enumerate(CUSTOMER_COLS)]))
def b9(spark, sf):
    return finalize(P.context_summary(table(spark, sf, "customer")))


@register("e1_describe_numeric", DV + _union([
    f"""SELECT '{c}' AS "column", COUNT({c}) AS count, ROUND(AVG({c}), 6) AS mean, ROUND(STDDEV_SAMP({c}), 6) AS std,
        ROUND(MIN({c}), 6) AS min, ROUND(quantile_cont({c}, 0.25), 6) AS q25, ROUND(quantile_cont({c}, 0.5), 6) AS q50,
        ROUND(quantile_cont({c}, 0.75), 6) AS q75, ROUND(MAX({c}), 6) AS max
        FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM dirty_view)""" for c in DIRTY_NUM]))
def e1(spark, sf):
    return finalize(P.describe_numeric(V.dirty_view(spark, sf)), 6)


@register("e2_categorical_overview", X.with_views(X.SALES) + ", " + _mode_sql("sales_view", ["Region", "Category", "Brand"])
          + """
SELECT "column", n_unique AS "unique", v AS top, cnt AS top_freq FROM ranked WHERE rk = 1 AND n_unique <= 50""")
def e2(spark, sf):
    return P.categorical_overview(V.sales_lines(spark, sf, ["Region", "Category", "Brand"]))

"""Registered queries: dashboard aggregates (F6-F15) and question intents."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import round_scaled
from ..operators import ask as A
from ..operators import kpi as K
from ..sources import views as V
from ..sources.tables import table
from . import fixtures_sql as X
from .q_scalars import _fmt_sql
from .registry import finalize, register

SV = X.with_views(X.SALES)
# every row stays; the metric is missing in June, so that month's sum is a gap to fill
JUNE_GAP = X.with_views(X.SALES) + ", gap AS (SELECT Date, Region, CASE WHEN month(Date) <> 6 THEN Revenue END AS Revenue FROM sales_view)"


def _sales(spark, sf, cols=None):
    return V.sales_lines(spark, sf, cols)


def june_gap(spark, sf, cols):
    """Sales whose revenue is missing in June."""
    return _sales(spark, sf, cols).withColumn("Revenue", F.when(F.month("Date") != 6, F.col("Revenue")))


MONTHS_SQL = """months AS (SELECT CAST(last_day(m) AS DATE) AS period FROM
  (SELECT unnest(generate_series(date_trunc('month', MIN(Date)), date_trunc('month', MAX(Date)), INTERVAL 1 MONTH)) AS m FROM {src})),
msum AS (SELECT CAST(last_day(Date) AS DATE) AS period, SUM({metric}) AS s FROM {src} WHERE Date IS NOT NULL AND {metric} IS NOT NULL GROUP BY 1),
monthly AS (SELECT months.period, COALESCE(msum.s, 0) AS value FROM months LEFT JOIN msum USING (period))"""


@register("f8_monthly_trend", SV + ", " + MONTHS_SQL.format(src="sales_view", metric="Revenue")
          + " SELECT period, CAST(value AS DOUBLE) AS value FROM monthly")
def f8(spark, sf):
    return finalize(K.monthly_trend(_sales(spark, sf, ["Date", "Revenue"]), "Date", "Revenue"))


@register("f8_monthly_trend_gaps", JUNE_GAP + ", " + MONTHS_SQL.format(src="gap", metric="Revenue")
          + " SELECT period, CAST(value AS DOUBLE) AS value FROM monthly")
def f8g(spark, sf):
    return finalize(K.monthly_trend(june_gap(spark, sf, ["Date", "Revenue"]), "Date", "Revenue"))


@register("f6_mom_growth", SV + ", " + MONTHS_SQL.format(src="sales_view", metric="Revenue") + """,
r AS (SELECT value, ROW_NUMBER() OVER (ORDER BY period DESC) AS rk FROM monthly),
lp AS (SELECT MAX(CASE WHEN rk = 1 THEN value END) AS last, MAX(CASE WHEN rk = 2 THEN value END) AS previous FROM r)
SELECT CAST(last AS DOUBLE) AS last, CAST(previous AS DOUBLE) AS previous,
       ROUND(CAST(last - previous AS DOUBLE) / ABS(CAST(previous AS DOUBLE)) * 100, 6) AS growth_pct,
       CASE WHEN last - previous >= 0 THEN 'up' ELSE 'down' END AS direction
FROM lp WHERE previous IS NOT NULL AND previous <> 0""")
def f6(spark, sf):
    return finalize(K.mom_growth(K.monthly_trend(_sales(spark, sf, ["Date", "Revenue"]), "Date", "Revenue")), 6)


@register("f7_fallback_sums", """
SELECT CAST(0 AS BIGINT) AS position, 'p_partkey' AS "column", CAST(SUM(p_partkey) AS DOUBLE) AS total FROM part
UNION ALL SELECT 1, 'p_size', CAST(SUM(p_size) AS DOUBLE) FROM part
UNION ALL SELECT 2, 'p_retailprice', ROUND(SUM(p_retailprice), 6) FROM part""")
def f7(spark, sf):
    return finalize(K.fallback_sums(table(spark, sf, "part")), 6)


@register("f9_top_category", SV + """, t AS (SELECT Brand, SUM(Revenue) AS total FROM sales_view WHERE Brand IS NOT NULL GROUP BY Brand)
SELECT Brand, CAST(total AS DOUBLE) AS total, ROW_NUMBER() OVER (ORDER BY total DESC, Brand) AS rank
FROM t ORDER BY total DESC, Brand LIMIT 10""")
def f9(spark, sf):
    return finalize(K.top_categories(_sales(spark, sf, ["Brand", "Revenue"]), "Brand", "Revenue", 10))


@register("f10_leader_share", SV + """, t AS (SELECT Brand, SUM(Revenue) AS total FROM sales_view WHERE Brand IS NOT NULL GROUP BY Brand),
top AS (SELECT * FROM t ORDER BY total DESC, Brand LIMIT 10)
SELECT (SELECT Brand FROM top ORDER BY total DESC, Brand LIMIT 1) AS Brand,
       CAST(MAX(total) AS DOUBLE) AS total,
       ROUND(CAST(MAX(total) AS DOUBLE) / CAST(SUM(total) AS DOUBLE) * 100, 6) AS share_pct FROM top""")
def f10(spark, sf):
    top = K.top_categories(_sales(spark, sf, ["Brand", "Revenue"]), "Brand", "Revenue", 10)
    return finalize(K.leader_share(top, "Brand"), 6)


@register("f11_regional_totals", SV + """, t AS (SELECT Region, SUM(Revenue) AS total FROM sales_view WHERE Region IS NOT NULL GROUP BY Region)
SELECT Region, CAST(total AS DOUBLE) AS total,
       ROUND(CAST(total AS DOUBLE) / (SELECT SUM(CAST(total AS DOUBLE)) FROM t) * 100, 6) AS share_pct FROM t""")
def f11(spark, sf):
    return finalize(K.regional_totals(_sales(spark, sf, ["Region", "Revenue"]), "Region", "Revenue"), 6)


KPI_SQL = SV + ", " + MONTHS_SQL.format(src="sales_view", metric="Revenue") + f""",
a AS (SELECT CAST(SUM(Revenue) AS DOUBLE) AS rev, CAST(SUM(Profit) AS DOUBLE) AS prof,
             CAST(SUM(Quantity) AS DOUBLE) AS units, CAST(COUNT(DISTINCT CustomerID) AS DOUBLE) AS cust FROM sales_view),
r AS (SELECT value, ROW_NUMBER() OVER (ORDER BY period DESC) AS rk FROM monthly),
lp AS (SELECT MAX(CASE WHEN rk = 1 THEN value END) AS last, MAX(CASE WHEN rk = 2 THEN value END) AS previous FROM r),
g AS (SELECT CAST(last - previous AS DOUBLE) / ABS(CAST(previous AS DOUBLE)) * 100 AS growth FROM lp
      WHERE previous IS NOT NULL AND previous <> 0)
SELECT CAST(1 AS BIGINT) AS position, 'Total Revenue' AS label, ROUND(rev, 6) AS value, '$' || ({_fmt_sql('rev')}) AS display,
       CAST(NULL AS VARCHAR) AS delta, CAST(NULL AS VARCHAR) AS direction FROM a
UNION ALL SELECT 2, 'Total Profit', ROUND(prof, 6), '$' || ({_fmt_sql('prof')}), NULL, NULL FROM a
UNION ALL SELECT 3, 'Profit Margin', ROUND(prof / rev * 100, 6), format('{{:.1f}}%', prof / rev * 100), NULL, NULL FROM a
UNION ALL SELECT 4, 'Total Units', ROUND(units, 6), {_fmt_sql('units')}, NULL, NULL FROM a
UNION ALL SELECT 5, 'Customers', cust, format('{{:,d}}', CAST(cust AS BIGINT)), NULL, NULL FROM a
UNION ALL SELECT 6, 'MoM Growth', ROUND(growth, 6), format('{{:.1f}}%', growth), format('{{:.1f}}%', growth),
       CASE WHEN growth >= 0 THEN 'up' ELSE 'down' END FROM g"""


@register("f15_kpi_table", KPI_SQL)
def f15(spark, sf):
    return finalize(K.kpi_table(_sales(spark, sf, ["Date", "Revenue", "Profit", "Quantity", "CustomerID"])), 6)


@register("g1_top_n", SV + """, t AS (SELECT Brand, SUM(Profit) AS Profit FROM sales_view WHERE Brand IS NOT NULL GROUP BY Brand)
SELECT Brand, CAST(Profit AS DOUBLE) AS Profit, ROW_NUMBER() OVER (ORDER BY Profit DESC, Brand) AS rank
FROM t ORDER BY Profit DESC, Brand LIMIT 5""")
def g1(spark, sf):
    return finalize(A.top_n(_sales(spark, sf, ["Brand", "Profit"]), "Brand", "Profit", 5))


@register("g2_bottom_n", SV + """, t AS (SELECT Region, SUM(Profit) AS Profit FROM sales_view WHERE Region IS NOT NULL GROUP BY Region)
SELECT Region, CAST(Profit AS DOUBLE) AS Profit, ROW_NUMBER() OVER (ORDER BY Profit, Region) AS rank
FROM t ORDER BY Profit, Region LIMIT 3""")
def g2(spark, sf):
    return finalize(A.bottom_n(_sales(spark, sf, ["Region", "Profit"]), "Region", "Profit", 3))


@register("g3_trend", SV + ", " + MONTHS_SQL.format(src="sales_view", metric="Revenue") + """
SELECT period, CAST(value AS DOUBLE) AS Revenue,
  CASE WHEN (SELECT value FROM monthly ORDER BY period DESC LIMIT 1) >= (SELECT value FROM monthly ORDER BY period LIMIT 1)
       THEN 'increasing' ELSE 'decreasing' END AS direction FROM monthly""")
def g3(spark, sf):
    return finalize(A.trend(_sales(spark, sf, ["Date", "Revenue"]), "Date", "Revenue"))


DIRTY_ORDER = "OrderID, LineNo, PartID, SuppID, Region NULLS FIRST, Category, Profit NULLS FIRST, Revenue, Empty, Flat"


@register("g4_anomalies", X.with_views(X.SALES, X.DIRTY) + """, b AS (SELECT quantile_cont(Revenue, 0.25) AS q1,
  quantile_cont(Revenue, 0.75) AS q3 FROM dirty_view),
f AS (SELECT q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper FROM b),
hits AS (SELECT d.* FROM dirty_view d, f WHERE d.Revenue < f.lower OR d.Revenue > f.upper)
SELECT h.*, ROUND(f.lower, 6) AS lower, ROUND(f.upper, 6) AS upper, (SELECT COUNT(*) FROM hits) AS n_anomalies
FROM (SELECT * FROM hits ORDER BY """ + DIRTY_ORDER + """ LIMIT 20) h, f""")
def g4(spark, sf):
    a = finalize(A.anomalies(V.dirty_view(spark, sf), "Revenue", 20))
    return a.withColumn("lower", round_scaled("lower", 6)).withColumn("upper", round_scaled("upper", 6))


SALES_NUM = ["OrderID", "LineNo", "PartID", "SuppID", "UnitPrice", "Quantity", "Discount", "Revenue", "Profit", "CustomerID"]


def _corr_sql(cols, src, decimals):
    parts = []
    for i, a in enumerate(cols):
        for j, b in enumerate(cols):
            expr = (f"CASE WHEN stddev_pop({a}) > 0 THEN 1.0 END" if i == j else
                    f"CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END")
            parts.append(f"SELECT '{a}' AS a, '{b}' AS b, CAST({i} AS BIGINT) AS i, CAST({j} AS BIGINT) AS j, "
                         f"ROUND({expr}, {decimals}) AS r FROM {src}")
    return "\nUNION ALL\n".join(parts)


NUM_CAST = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SALES_NUM)


@register("g5_correlations", SV + f", nv AS (SELECT {NUM_CAST} FROM sales_view) " + _corr_sql(SALES_NUM, "nv", 2))
def g5(spark, sf):
    return finalize(A.correlations(_sales(spark, sf, SALES_NUM)))


@register("g6_value_counts", SV + """, vc AS (SELECT Category, COUNT(*) AS count FROM sales_view WHERE Category IS NOT NULL GROUP BY Category)
SELECT Category, count, (SELECT COUNT(*) FROM vc) AS n_unique FROM vc""")
def g6(spark, sf):
    return A.value_counts(_sales(spark, sf, ["Category"]), "Category")


@register("g7_shape", SV + "SELECT COUNT(*) AS \"rows\", CAST(14 AS BIGINT) AS \"columns\" FROM sales_view")
def g7(spark, sf):
    return A.shape(_sales(spark, sf))


@register("g8_aggregate", SV + """SELECT 'Profit' AS metric, 'average' AS agg, ROUND(CAST(AVG(Profit) AS DOUBLE), 6) AS value FROM sales_view
UNION ALL SELECT 'Revenue', 'total', CAST(SUM(Revenue) AS DOUBLE) FROM sales_view""")
def g8(spark, sf):
    s = _sales(spark, sf, ["Profit", "Revenue"])
    return finalize(A.aggregate(s, "Profit", "average").unionByName(A.aggregate(s, "Revenue", "total")), 6)


CAT_COLS = ["Region", "Category", "Brand"]


def _match_sql(t, cols):
    whens = " ".join(f"WHEN contains({t}, '{c.lower()}') OR contains({t}, '{c.lower().replace('_', ' ')}') THEN '{c}'"
                     for c in cols)
    return f"(CASE {whens} END)"


def _kw_sql(t, words):
    return "(" + " OR ".join(f"contains({t}, '{w}')" for w in words) + ")"


def _tag_sql():
    t = "lower(trim(question))"
    kw = {name: _kw_sql(t, ws) for name, ws in A.INTENTS}
    cat_m, num_m = _match_sql(t, CAT_COLS), _match_sql(t, SALES_NUM)
    metric = f"COALESCE({num_m}, 'Revenue')"
    top_g = f"COALESCE({cat_m}, 'CustomerID')"
    bot_g = f"COALESCE({cat_m}, 'Region')"
    agg = f"CASE WHEN {_kw_sql(t, A.AVERAGE_WORDS)} THEN 'average' ELSE 'total' END"
    rules = [("top", kw["top"], top_g, metric, "NULL"), ("bottom", kw["bottom"], bot_g, metric, "NULL"),
             ("trend", kw["trend"], "'Date'", metric, "NULL"), ("anomaly", kw["anomaly"], "NULL", metric, "NULL"),
             ("correlation", kw["correlation"], "NULL", "NULL", "NULL"), ("count", kw["count"], cat_m, "NULL", "NULL"),
             ("aggregate", kw["aggregate"], "NULL", metric, agg)]

    def case(idx, default):
        return "CASE " + " ".join(f"WHEN {r[1]} THEN {r[idx]}" for r in rules) + f" ELSE {default} END"
    intent = "CASE " + " ".join(f"WHEN {r[1]} THEN '{r[0]}'" for r in rules) + " ELSE 'none' END"
    n = f"COALESCE(TRY_CAST(NULLIF(regexp_extract({t}, '\\b(\\d+)\\b', 1), '') AS BIGINT), 10)"
    return (X.with_views(X.QUESTION) + f"""SELECT conv_id, turn, question, intent, CASE WHEN intent IN ('top', 'bottom') THEN {n} END AS n,
    group_col, metric_col, agg FROM (SELECT *, {intent} AS intent, CAST({case(2, 'NULL')} AS VARCHAR) AS group_col,
    CAST({case(3, 'NULL')} AS VARCHAR) AS metric_col, CAST({case(4, 'NULL')} AS VARCHAR) AS agg FROM question_view)""")


@register("g9_tag_questions", _tag_sql())
def g9(spark, sf):
    qv = V.question_view(spark, sf)
    schema_df = _sales(spark, sf)
    return A.tag_questions(qv, "question", schema_df, cat_cols=A.categorical_columns(schema_df), keep=["conv_id", "turn"])


# Each KPI as its own query over the columns it needs; the margin's aggregate also holds its two sums.
for _pos, _name, _cols in ((1, "f1_total_revenue", ["Revenue"]), (2, "f2_total_profit", ["Profit"]),
                           (3, "f3_profit_margin", ["Revenue", "Profit"]), (4, "f4_total_units", ["Quantity"]),
                           (5, "f5_customers", ["CustomerID"])):
    def _kpi_row(pos, cols):
        def fn(spark, sf):
            return finalize(K.kpi_table(_sales(spark, sf, cols)), 6).where(F.col("position") == pos)
        return fn
    register(_name, "SELECT * FROM (" + KPI_SQL + f") WHERE position = {_pos}")(_kpi_row(_pos, _cols))


@register("g10_match_column", X.with_views(X.QUESTION) + "SELECT conv_id, turn, "
          + _match_sql("lower(trim(question))", CAT_COLS) + " AS category_match, "
          + _match_sql("lower(trim(question))", SALES_NUM) + " AS metric_match FROM question_view")
def g10(spark, sf):
    qv = V.question_view(spark, sf)
    t = F.lower(F.trim("question"))
    return qv.select("conv_id", "turn", A.match_column_expr(t, CAT_COLS).alias("category_match"),
                     A.match_column_expr(t, SALES_NUM).alias("metric_match"))

"""Registered queries: data-quality scan and repair (D1-D18) on the dirty view."""
from __future__ import annotations

from ..operators import quality as Q
from ..session import stored
from ..sources import views as V
from ..sources.tables import table
from .q_profile import DIRTY_COLS, DIRTY_NUM, DIRTY_TEXT, DV, _union
from .registry import finalize, register

DUP_SRC = "SELECT l_returnflag, l_linestatus, l_quantity, l_discount FROM lineitem"
ALL = ", ".join(c for c, _ in DIRTY_COLS)


def _dup_view(spark, sf):
    return table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity", "l_discount")


@register("d1_missing_counts", DV + _union([
    f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing, COUNT(*) AS "rows" FROM dirty_view"""
    for c, _ in DIRTY_COLS]))
def d1(spark, sf):
    return Q.missing_counts(V.dirty_view(spark, sf))


@register("d2_missing_table", DV + "SELECT * FROM (" + _union([
    f"""SELECT '{c}' AS "column", COUNT(*) - COUNT({c}) AS missing,
        ROUND((COUNT(*) - COUNT({c})) * 100.0 / COUNT(*), 2) AS pct_missing FROM dirty_view"""
    for c, _ in DIRTY_COLS]) + ") WHERE missing > 0")
def d2(spark, sf):
    return finalize(Q.missing_table(V.dirty_view(spark, sf)))


MISSING_SUM = " + ".join(f"COUNT(*) - COUNT({c})" for c, _ in DIRTY_COLS)


@register("d3_missing_total", DV + f"""
SELECT CAST({MISSING_SUM} AS BIGINT) AS missing_total,
       ROUND(CAST(({MISSING_SUM}) * 100.0 AS DOUBLE) / (COUNT(*) * 10), 6) AS missing_pct FROM dirty_view""")
def d3(spark, sf):
    return finalize(Q.missing_total(V.dirty_view(spark, sf)), 6)


@register("d5_duplicates", f"""
SELECT (SELECT COUNT(*) FROM ({DUP_SRC})) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM ({DUP_SRC}))) AS duplicates""")
def d5(spark, sf):
    return Q.duplicate_count(_dup_view(spark, sf))


@register("d6_empty_columns", DV + "SELECT \"column\" FROM (" + _union([
    f"""SELECT '{c}' AS "column", COUNT({c}) AS n FROM dirty_view""" for c, _ in DIRTY_COLS]) + ") WHERE n = 0")
def d6(spark, sf):
    return Q.empty_columns(V.dirty_view(spark, sf))


FENCES_SQL = _union([f"""SELECT '{c}' AS "column", quantile_cont(CAST({c} AS DOUBLE), 0.25) AS q1,
    quantile_cont(CAST({c} AS DOUBLE), 0.75) AS q3 FROM dirty_view HAVING COUNT({c}) > 0""" for c in DIRTY_NUM])
FENCES = f"""fences AS (SELECT "column", q1, q3, q3 - q1 AS iqr, q1 - 1.5 * (q3 - q1) AS lower, q3 + 1.5 * (q3 - q1) AS upper
FROM ({FENCES_SQL}) WHERE q3 - q1 <> 0)"""


@register("d7_iqr_fences", DV + ", " + FENCES + """ SELECT "column", ROUND(q1, 6) AS q1, ROUND(q3, 6) AS q3,
  ROUND(iqr, 6) AS iqr, ROUND(lower, 6) AS lower, ROUND(upper, 6) AS upper FROM fences""")
def d7(spark, sf):
    return finalize(Q.iqr_fences(V.dirty_view(spark, sf)), 6)


@register("d8_outlier_counts", DV + ", " + FENCES + ", long AS (" + _union([
    f"""SELECT '{c}' AS "column", CAST({c} AS DOUBLE) AS value FROM dirty_view WHERE {c} IS NOT NULL""" for c in DIRTY_NUM])
    + """) SELECT l."column", COUNT(*) AS outliers FROM long l JOIN fences f ON l."column" = f."column"
WHERE l.value < f.lower OR l.value > f.upper GROUP BY l."column" """)
def d8(spark, sf):
    return Q.outlier_counts(V.dirty_view(spark, sf))


NO_EMPTY = ", ".join(c for c, _ in DIRTY_COLS if c != "Empty")


@register("d9_drop_empty_columns", DV + f"SELECT {NO_EMPTY} FROM dirty_view")
def d9(spark, sf):
    return finalize(Q.drop_empty_columns(V.dirty_view(spark, sf)))


@register("d10_drop_missing_rows", DV + f"SELECT {NO_EMPTY} FROM dirty_view WHERE "
          + " AND ".join(f"{c} IS NOT NULL" for c, _ in DIRTY_COLS if c != "Empty"))
def d10(spark, sf):
    return finalize(Q.drop_missing_rows(V.dirty_view(spark, sf).drop("Empty")))


def _fill_sql(num_stat):
    """Fill every column of dirty_view: numeric by ``num_stat`` (SQL of a scalar), text by mode."""
    mode_parts = [f"""(SELECT v FROM (SELECT {c} AS v, COUNT(*) AS n FROM dirty_view WHERE {c} IS NOT NULL
                      GROUP BY {c} ORDER BY n DESC, v LIMIT 1))""" for c in DIRTY_TEXT]
    sel = []
    for c, t in DIRTY_COLS:
        if t == "string":
            sel.append(f"COALESCE({c}, {mode_parts[DIRTY_TEXT.index(c)]}, 'Unknown') AS {c}")
        else:
            sel.append(num_stat(c, t))
    return DV + "SELECT " + ", ".join(sel) + " FROM dirty_view"


def _num_fill(expr):
    def f(c, t):
        out_t = "DOUBLE" if t in ("bigint", "int") else "DOUBLE"
        return f"ROUND(CAST(COALESCE({c}, ({expr.format(c=c)})) AS {out_t}), 6) AS {c}"
    return f


@register("d11_fill_mean", _fill_sql(_num_fill("SELECT AVG({c}) FROM dirty_view")))
def d11(spark, sf):
    return finalize(Q.fill_missing(V.dirty_view(spark, sf), "mean"), 6)


@register("d12_fill_median", _fill_sql(_num_fill("SELECT quantile_cont({c}, 0.5) FROM dirty_view")))
def d12(spark, sf):
    return finalize(Q.fill_missing(V.dirty_view(spark, sf), "median"), 6)


@register("d13_fill_mode", _fill_sql(_num_fill(
    "SELECT COALESCE((SELECT v FROM (SELECT {c} AS v, COUNT(*) AS n FROM dirty_view WHERE {c} IS NOT NULL "
    "GROUP BY {c} ORDER BY n DESC, v LIMIT 1)), 0)")))
def d13(spark, sf):
    return finalize(Q.fill_missing(V.dirty_view(spark, sf), "mode"), 6)


@register("d14_fill_zero", _fill_sql(lambda c, t: f"ROUND(CAST(COALESCE({c}, 0) AS DOUBLE), 6) AS {c}"))
def d14(spark, sf):
    return finalize(Q.fill_missing(V.dirty_view(spark, sf), "zero"), 6)


@register("d15_drop_duplicates", f"SELECT DISTINCT * FROM ({DUP_SRC})")
def d15(spark, sf):
    return Q.drop_duplicates(_dup_view(spark, sf))


@register("d16_winsorise", DV + """, b AS (SELECT quantile_cont(Revenue, 0.25) AS q1, quantile_cont(Revenue, 0.75) AS q3 FROM dirty_view)
SELECT OrderID, LineNo, ROUND(CASE WHEN b.q3 = b.q1 THEN Revenue
  WHEN Revenue < b.q1 - 1.5 * (b.q3 - b.q1) THEN b.q1 - 1.5 * (b.q3 - b.q1)
  WHEN Revenue > b.q3 + 1.5 * (b.q3 - b.q1) THEN b.q3 + 1.5 * (b.q3 - b.q1) ELSE Revenue END, 6) AS Revenue
FROM dirty_view, b""")
def d16(spark, sf):
    w = Q.winsorise(V.dirty_view(spark, sf), ["Revenue"])
    return finalize(w.select("OrderID", "LineNo", "Revenue"), 6)


# D17 default plan on dirty_view: drop Empty, fill median, de-duplicate (none here), winsorise Revenue
CLEAN_SQL = DV + """, step1 AS (SELECT OrderID, LineNo, PartID, SuppID,
    COALESCE(Region, (SELECT v FROM (SELECT Region AS v, COUNT(*) AS n FROM dirty_view WHERE Region IS NOT NULL
                      GROUP BY Region ORDER BY n DESC, v LIMIT 1)), 'Unknown') AS Region, Category,
    COALESCE(Profit, (SELECT quantile_cont(Profit, 0.5) FROM dirty_view)) AS Profit, Revenue, Flat FROM dirty_view),
step2 AS (SELECT DISTINCT * FROM step1),
b AS (SELECT quantile_cont(Revenue, 0.25) AS q1, quantile_cont(Revenue, 0.75) AS q3 FROM step2),
cleaned AS (SELECT OrderID, LineNo, PartID, SuppID, Region, Category, Profit,
  CASE WHEN Revenue < b.q1 - 1.5 * (b.q3 - b.q1) THEN b.q1 - 1.5 * (b.q3 - b.q1)
       WHEN Revenue > b.q3 + 1.5 * (b.q3 - b.q1) THEN b.q3 + 1.5 * (b.q3 - b.q1) ELSE Revenue END AS Revenue, Flat
  FROM step2, b)
"""


def _cleaned(spark, sf):
    # the joined view is read by six passes (gaps, medians, fills, both summaries), so it is written once
    d = stored(V.dirty_view(spark, sf), "dirty")
    spec = Q.CleanSpec(drop_empty=True, missing_action="median", drop_duplicates=True, winsorise=["Revenue"])
    return d, Q.clean(d, spec)


@register("d17_clean", CLEAN_SQL + """SELECT OrderID, LineNo, PartID, SuppID, Region, Category,
  ROUND(Profit, 6) AS Profit, ROUND(Revenue, 6) AS Revenue, Flat FROM cleaned""")
def d17(spark, sf):
    return finalize(_cleaned(spark, sf)[1], 6)


@register("d18_before_after", CLEAN_SQL + f""", bq AS (SELECT COUNT(*) AS r, {MISSING_SUM} AS m,
      COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM dirty_view)) AS d FROM dirty_view),
aq AS (SELECT COUNT(*) AS r, """ + " + ".join(f"COUNT(*) - COUNT({c})" for c, _ in DIRTY_COLS if c != "Empty")
          + """ AS m, COUNT(*) - (SELECT COUNT(*) FROM (SELECT DISTINCT * FROM cleaned)) AS d FROM cleaned)
SELECT 'rows' AS metric, bq.r AS before, aq.r AS after, aq.r - bq.r AS delta FROM bq, aq
UNION ALL SELECT 'missing', bq.m, aq.m, aq.m - bq.m FROM bq, aq
UNION ALL SELECT 'duplicates', bq.d, aq.d, aq.d - bq.d FROM bq, aq""")
def d18(spark, sf):
    before, after = _cleaned(spark, sf)
    return finalize(Q.before_after(before, after))

"""Registered queries: exploratory statistics."""
from __future__ import annotations

from ..operators import stats as ST
from ..sources import views as V
from . import fixtures_sql as X
from .q_kpi import NUM_CAST, SALES_NUM, _corr_sql
from .registry import finalize, register

SV = X.with_views(X.SALES)
DV = X.with_views(X.SALES, X.DIRTY)
DIRTY_STAT_COLS = ["PartID", "Profit", "Revenue", "Empty", "Flat"]


@register("e3_correlation_matrix", DV + ", nv AS (SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in DIRTY_STAT_COLS)
          + " FROM dirty_view) " + _corr_sql(DIRTY_STAT_COLS, "nv", 2))
def e3(spark, sf):
    return finalize(ST.correlation_long(V.dirty_view(spark, sf), DIRTY_STAT_COLS, decimals=2))


@register("e4_strongest_pair", SV + f", nv AS (SELECT {NUM_CAST} FROM sales_view), m AS (" + _corr_sql(SALES_NUM, "nv", 2) + """)
SELECT a, b, r FROM m WHERE i < j AND r IS NOT NULL ORDER BY abs(r) DESC, i, j LIMIT 1""")
def e4(spark, sf):
    c = ST.correlation_pairs(V.sales_lines(spark, sf, SALES_NUM), SALES_NUM, decimals=2)
    return finalize(ST.strongest_pair(c))


HIST_SQL = """, s AS (SELECT MIN(x) AS lo, MAX(x) AS hi FROM src),
b AS (SELECT CASE WHEN s.hi = s.lo THEN 0 ELSE LEAST(FLOOR((x - s.lo) / (s.hi - s.lo) * {bins}), {bins} - 1) END AS bin {gsel}
      FROM src, s WHERE x IS NOT NULL {gwhere}),
c AS (SELECT {gcol} bin, COUNT(*) AS count FROM b GROUP BY {gcol} bin),
g AS (SELECT DISTINCT {gcol0} FROM b),
spine AS (SELECT {gcol} unnest(generate_series(0, CASE WHEN s.hi = s.lo THEN 0 ELSE {bins} - 1 END)) AS bin FROM g, s)
SELECT {gcol} CAST(spine.bin AS BIGINT) AS bin,
       ROUND(s.lo + spine.bin * CASE WHEN s.hi = s.lo THEN 0 ELSE (s.hi - s.lo) / {bins} END, 6) AS lo,
       ROUND(CASE WHEN s.hi = s.lo THEN s.hi ELSE s.lo + (spine.bin + 1) * ((s.hi - s.lo) / {bins}) END, 6) AS hi,
       COALESCE(c.count, 0) AS count
FROM spine CROSS JOIN s LEFT JOIN c USING ({gcol} bin)"""


@register("e5_histogram", DV + ", src AS (SELECT Revenue AS x FROM dirty_view)"
          + HIST_SQL.format(bins=40, gsel="", gwhere="", gcol="", gcol0="1 AS one"))
def e5(spark, sf):
    return finalize(ST.histogram(V.dirty_view(spark, sf), "Revenue", 40), 6)


@register("e5_histogram_by_group", SV + ", src AS (SELECT CAST(Quantity AS DOUBLE) AS x, Region FROM sales_view)"
          + HIST_SQL.format(bins=10, gsel=", Region", gwhere="AND Region IS NOT NULL", gcol="Region,", gcol0="Region"))
def e5g(spark, sf):
    return finalize(ST.histogram(V.sales_lines(spark, sf, ["Quantity", "Region"]), "Quantity", 10, group="Region"), 6)


@register("e6_skewness", DV + " " + "\nUNION ALL\n".join(
    f"""SELECT '{c}' AS "column", ROUND(CASE WHEN COUNT({c}) < 3 THEN NULL WHEN stddev_pop({c}) = 0 THEN 0.0
        ELSE skewness({c}) END, 6) AS skew,
        CASE WHEN abs(CASE WHEN COUNT({c}) < 3 THEN NULL WHEN stddev_pop({c}) = 0 THEN 0.0 ELSE skewness({c}) END) < 0.5
             THEN 'approximately symmetric'
             WHEN COUNT({c}) >= 3 THEN 'skewed' END AS label FROM (SELECT CAST({c} AS DOUBLE) AS {c} FROM dirty_view)"""
    for c in DIRTY_STAT_COLS))
def e6(spark, sf):
    return finalize(ST.skewness(V.dirty_view(spark, sf), DIRTY_STAT_COLS), 6)


BOX_SQL = """, q AS (SELECT Category, COUNT(v) AS n, quantile_cont(v, 0.25) AS q1, quantile_cont(v, 0.5) AS median,
        quantile_cont(v, 0.75) AS q3 FROM src WHERE v IS NOT NULL AND Category IS NOT NULL GROUP BY Category),
f AS (SELECT *, q1 - 1.5 * (q3 - q1) AS lower_fence, q3 + 1.5 * (q3 - q1) AS upper_fence FROM q),
w AS (SELECT s.Category, MIN(CASE WHEN v BETWEEN lower_fence AND upper_fence THEN v END) AS whisker_low,
        MAX(CASE WHEN v BETWEEN lower_fence AND upper_fence THEN v END) AS whisker_high,
        COUNT(*) FILTER (WHERE NOT (v BETWEEN lower_fence AND upper_fence)) AS outliers
      FROM src s JOIN f USING (Category) WHERE v IS NOT NULL GROUP BY s.Category)
SELECT Category, n, ROUND(q1, 6) AS q1, ROUND(median, 6) AS median, ROUND(q3, 6) AS q3,
       ROUND(lower_fence, 6) AS lower_fence, ROUND(upper_fence, 6) AS upper_fence,
       ROUND(whisker_low, 6) AS whisker_low, ROUND(whisker_high, 6) AS whisker_high, outliers
FROM f JOIN w USING (Category)"""


@register("e7_box_stats", DV + ", src AS (SELECT Category, Revenue AS v FROM dirty_view)" + BOX_SQL)
def e7(spark, sf):
    return finalize(ST.box_stats(V.dirty_view(spark, sf), "Revenue", group="Category"), 6)


@register("e8_ols_by_group", SV + """SELECT Region, regr_count(y, x) AS n, ROUND(regr_slope(y, x), 6) AS slope,
  ROUND(regr_intercept(y, x), 6) AS intercept, ROUND(regr_r2(y, x), 6) AS r2
FROM (SELECT Region, CAST(Quantity AS DOUBLE) AS x, CAST(Revenue AS DOUBLE) AS y FROM sales_view WHERE Region IS NOT NULL)
GROUP BY Region""")
def e8(spark, sf):
    s = V.sales_lines(spark, sf, ["Region", "Quantity", "Revenue"])
    return finalize(ST.ols_by_group(s, "Quantity", "Revenue", "Region"), 6)


SCATTER_COLS = ["UnitPrice", "Quantity", "Discount", "Revenue"]


@register("e9_scatter_matrix", SV + ", nv AS (SELECT " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in SCATTER_COLS)
          + " FROM sales_view) " + "\nUNION ALL\n".join(
              f"""SELECT '{a}' AS x, '{b}' AS y, regr_count({b}, {a}) AS n, ROUND(regr_slope({b}, {a}), 6) AS slope,
                  ROUND(regr_intercept({b}, {a}), 6) AS intercept, ROUND(regr_r2({b}, {a}), 6) AS r2 FROM nv"""
              for i, a in enumerate(SCATTER_COLS) for b in SCATTER_COLS[i + 1:]))
def e9(spark, sf):
    return finalize(ST.scatter_matrix(V.sales_lines(spark, sf, SCATTER_COLS), SCATTER_COLS), 6)


GROUP_COLS = ["Quantity", "Discount", "Revenue"]


@register("e9_scatter_by_group", SV + ", nv AS (SELECT Region, " + ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in GROUP_COLS)
          + " FROM sales_view) " + "\nUNION ALL\n".join(
              f"""SELECT Region, '{a}' AS x, '{b}' AS y, regr_count({b}, {a}) AS n, ROUND(regr_slope({b}, {a}), 6) AS slope,
                  ROUND(regr_intercept({b}, {a}), 6) AS intercept, ROUND(regr_r2({b}, {a}), 6) AS r2 FROM nv GROUP BY Region"""
              for i, a in enumerate(GROUP_COLS) for b in GROUP_COLS[i + 1:]))
def e9g(spark, sf):
    s = V.sales_lines(spark, sf, ["Region", *GROUP_COLS])
    return finalize(ST.scatter_matrix(s, GROUP_COLS, group="Region"), 6)


@register("e9_binned_pairs", SV + """, nv AS (SELECT CAST(Quantity AS DOUBLE) AS x, CAST(Revenue AS DOUBLE) AS y FROM sales_view),
b AS (SELECT MIN(x) AS x0, MAX(x) AS x1, MIN(y) AS y0, MAX(y) AS y1 FROM nv)
SELECT CAST(LEAST(floor((x - x0) / (x1 - x0) * 20), 19) AS BIGINT) AS bx, CAST(LEAST(floor((y - y0) / (y1 - y0) * 20), 19) AS BIGINT) AS "by",
  COUNT(*) AS count FROM nv, b GROUP BY 1, 2""")
def e9b(spark, sf):
    return finalize(ST.binned_pairs(V.sales_lines(spark, sf, ["Quantity", "Revenue"]), "Quantity", "Revenue"))

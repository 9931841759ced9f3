"""Registered queries: regular series and forecasts."""
from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import round_scaled
from ..operators import forecast as FC
from ..operators.arima import arima_likelihood
from ..operators.changepoint import changepoint_forecast
from ..operators.periods import interpolate, resample_mean, resample_sum
from ..sources import views as V
from ..sources.tables import table
from . import fixtures_sql as X
from .q_kpi import JUNE_GAP, june_gap
from .registry import finalize, register


KEYED_MONTHS = """bounds AS (SELECT {k}, MIN(last_day({d})) AS lo, MAX(last_day({d})) AS hi FROM {src}
        WHERE {d} IS NOT NULL AND {v} IS NOT NULL AND {k} IS NOT NULL GROUP BY {k}),
spine AS (SELECT {k}, CAST(last_day(m) AS DATE) AS period FROM
        (SELECT {k}, unnest(generate_series(date_trunc('month', lo), date_trunc('month', hi), INTERVAL 1 MONTH)) AS m FROM bounds)),
agg AS (SELECT {k}, CAST(last_day({d}) AS DATE) AS period, {fn}({v}) AS value FROM {src}
        WHERE {d} IS NOT NULL AND {v} IS NOT NULL AND {k} IS NOT NULL GROUP BY ALL),
series AS (SELECT spine.{k}, spine.period, {fill} AS value FROM spine LEFT JOIN agg USING ({k}, period))"""


def _series_by_region(spark, sf):
    s = V.sales_lines(spark, sf, ["Region", "Date", "Revenue"])
    return resample_sum(s, "Date", "Revenue", "M", keys=["Region"])


@register("i1_resample_monthly_by_region", JUNE_GAP + ", " + KEYED_MONTHS.format(
    k="Region", d="Date", v="Revenue", src="gap", fn="SUM", fill="COALESCE(agg.value, 0)")
    + " SELECT Region, period, CAST(value AS DOUBLE) AS value FROM series")
def i1m(spark, sf):
    s = june_gap(spark, sf, ["Region", "Date", "Revenue"])
    return finalize(resample_sum(s, "Date", "Revenue", "M", keys=["Region"]))


EV_SPINE = """bounds AS (SELECT event_type, MIN({lab}) AS lo, MAX({lab}) AS hi FROM ev GROUP BY 1),
spine AS (SELECT event_type, CAST(unnest(generate_series(lo, hi, INTERVAL {step})) AS DATE) AS period FROM bounds),
agg AS (SELECT event_type, {lab} AS period, SUM(value) AS value FROM ev GROUP BY 1, 2)
SELECT spine.event_type, spine.period, ROUND(COALESCE(agg.value, 0), 6) AS value FROM spine LEFT JOIN agg USING (event_type, period)"""


@register("i1_resample_weekly", """WITH ev AS (SELECT event_type, value,
   CAST(CAST(ts AS DATE) + CAST((7 - isodow(CAST(ts AS DATE))) % 7 AS INTEGER) AS DATE) AS wk FROM events
   WHERE ts IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL),
""" + EV_SPINE.format(lab="wk", step="7 DAY"))
def i1w(spark, sf):
    return finalize(resample_sum(table(spark, sf, "events"), "ts", "value", "W", keys=["event_type"]), 6)


@register("i1_resample_daily", """WITH ev AS (SELECT event_type, value, CAST(ts AS DATE) AS dy FROM events
   WHERE ts IS NOT NULL AND value IS NOT NULL AND event_type IS NOT NULL),
""" + EV_SPINE.format(lab="dy", step="1 DAY"))
def i1d(spark, sf):
    return finalize(resample_sum(table(spark, sf, "events"), "ts", "value", "D", keys=["event_type"]), 6)


@register("i2_interpolate", JUNE_GAP + ", " + KEYED_MONTHS.format(
    k="Region", d="Date", v="Revenue", src="gap", fn="SUM", fill="CAST(agg.value AS DOUBLE)") + """,
idx AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY Region ORDER BY period) AS i FROM series),
nb AS (SELECT *,
  last_value(value IGNORE NULLS) OVER (PARTITION BY Region ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pv,
  last_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY Region ORDER BY period ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pi,
  first_value(value IGNORE NULLS) OVER (PARTITION BY Region ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS nv,
  first_value(CASE WHEN value IS NOT NULL THEN i END IGNORE NULLS) OVER (PARTITION BY Region ORDER BY period ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ni
  FROM idx)
SELECT Region, period, CAST(CASE WHEN value IS NOT NULL THEN value
  WHEN nv IS NOT NULL AND pv IS NOT NULL THEN pv + (nv - pv) * (i - pi) / (ni - pi) ELSE pv END AS DOUBLE) AS value FROM nb""")
def i2(spark, sf):
    s = june_gap(spark, sf, ["Region", "Date", "Revenue"])
    m = resample_sum(s, "Date", "Revenue", "M", keys=["Region"], empty_as_null=True)
    m = m.withColumn("value", F.col("value").cast("double"))
    return interpolate(m, "value", "period", keys=["Region"]).select("Region", "period", "value")


@register("i2_resample_mean", X.with_views(X.SALES) + ", " + KEYED_MONTHS.format(
    k="Region", d="Date", v="Revenue", src="sales_view", fn="AVG", fill="CAST(agg.value AS DOUBLE)")
    + " SELECT Region, period, ROUND(value, 2) AS value FROM series")
def i2m(spark, sf):
    s = V.sales_lines(spark, sf, ["Region", "Date", "Revenue"]).withColumn("Revenue", F.col("Revenue").cast("double"))
    return finalize(resample_mean(s, "Date", "Revenue", "M", keys=["Region"]), 2)


def _grid_sql(name, points):
    """Recursion over the differences for every (Region, phi, theta) of ``points``; <name> is the best point."""
    return f"""{name}_e(Region, phi, theta, j, e, sse) AS (
  SELECT Region, phi, theta, 0, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE) FROM ({points}) WHERE abs(phi) <= 0.95 AND abs(theta) <= 0.95
  UNION ALL
  SELECT g.Region, g.phi, g.theta, g.j + 1, w.w - g.phi * w.w0 - g.theta * g.e,
         g.sse + (w.w - g.phi * w.w0 - g.theta * g.e) * (w.w - g.phi * w.w0 - g.theta * g.e)
  FROM {name}_e g JOIN w ON w.Region = g.Region AND w.j = g.j + 1),
{name} AS (SELECT * FROM (SELECT g.*, m.m, ROW_NUMBER() OVER (PARTITION BY g.Region ORDER BY sse, abs(phi) + abs(theta), phi, theta) AS rk
  FROM {name}_e g JOIN m ON m.Region = g.Region AND g.j = m.m - 1) WHERE rk = 1)"""


ARIMA_SQL = (X.with_views(X.SALES).replace("WITH ", "WITH RECURSIVE ", 1) + ", " + KEYED_MONTHS.format(
    k="Region", d="Date", v="Revenue", src="sales_view", fn="SUM", fill="COALESCE(agg.value, 0)") + """,
y AS (SELECT Region, period, CAST(value AS DOUBLE) AS v, ROW_NUMBER() OVER (PARTITION BY Region ORDER BY period) - 1 AS t FROM series),
d AS (SELECT Region, t - 1 AS j, v - LAG(v) OVER (PARTITION BY Region ORDER BY t) AS w FROM y),
w AS (SELECT Region, j, w, LAG(w) OVER (PARTITION BY Region ORDER BY j) AS w0 FROM d WHERE j >= 0),
m AS (SELECT Region, COUNT(*) AS m, arg_max(w, j) AS w_last FROM w GROUP BY Region HAVING COUNT(*) >= 4),
last AS (SELECT Region, MAX(period) AS period, arg_max(v, t) AS y_last FROM y GROUP BY Region),
""" + _grid_sql("coarse", "SELECT Region, ROUND(i * 0.05, 4) AS phi, ROUND(k * 0.05, 4) AS theta FROM m, (SELECT unnest(range(-19, 20)) AS i), (SELECT unnest(range(-19, 20)) AS k)") + ",\n"
    + _grid_sql("fine", "SELECT Region, ROUND(phi + i * 0.005, 4) AS phi, ROUND(theta + k * 0.005, 4) AS theta FROM coarse, (SELECT unnest(range(-10, 11)) AS i), (SELECT unnest(range(-10, 11)) AS k)") + """,
p AS (SELECT f.Region, f.phi, f.theta, f.e, f.sse / GREATEST(1, f.m - 3) AS sigma2, l.period AS last, l.y_last,
        f.phi * m.w_last + f.theta * f.e AS w1 FROM fine f JOIN m USING (Region) JOIN last l USING (Region)),
steps AS (SELECT p.*, h, k, (SELECT SUM(pow(phi, x)) FROM (SELECT unnest(range(0, 12)) AS x) WHERE x < k) AS geo
          FROM p, (SELECT unnest(range(1, 13)) AS h), (SELECT unnest(range(0, 13)) AS k) WHERE k <= h),
psi AS (SELECT Region, h, SUM(CASE WHEN k < h THEN pow(1 + (phi + theta) * COALESCE(geo, 0), 2) END) AS s,
          MAX(CASE WHEN k = h THEN geo END) AS geo FROM steps GROUP BY Region, h)
SELECT p.Region, CAST(last_day(p.last + to_months(CAST(h AS INTEGER))) AS DATE) AS period, ROUND(y_last + w1 * geo, 2) AS forecast,
  ROUND(y_last + w1 * geo - 1.959964 * sqrt(sigma2 * s), 2) AS lower, ROUND(y_last + w1 * geo + 1.959964 * sqrt(sigma2 * s), 2) AS upper,
  phi, theta, ROUND(sqrt(sigma2), 2) AS sigma FROM p JOIN psi USING (Region)""")


@register("i3_arima", ARIMA_SQL)
def i3(spark, sf):
    f = FC.arima111_forecast(_series_by_region(spark, sf), 12, "M", keys=["Region"])
    return f.select("Region", "period", *[round_scaled(c, 2).alias(c) for c in ("forecast", "lower", "upper")], "phi", "theta",
                    round_scaled(F.sqrt("sigma2"), 2).alias("sigma"))


@register("i3_arima_likelihood")
def i3l(spark, sf):
    """The monthly revenue of every region by the exact likelihood fit."""
    return arima_likelihood(_series_by_region(spark, sf), 12, "M", keys=["Region"])


@register("i4_changepoint_forecast")
def i4c(spark, sf):
    """The monthly revenue of every region with slope changes and yearly seasons."""
    return changepoint_forecast(_series_by_region(spark, sf), 12, "M", keys=["Region"])


SEASONAL = X.with_views(X.SALES) + ", " + KEYED_MONTHS.format(
    k="Region", d="Date", v="Revenue", src="sales_view", fn="SUM", fill="COALESCE(agg.value, 0)") + """,
s AS (SELECT Region, period, CAST(value AS DOUBLE) AS v,
        CAST(ROW_NUMBER() OVER (PARTITION BY Region ORDER BY period) - 1 AS DOUBLE) AS t FROM series),
fit AS (SELECT Region, regr_slope(v, t) AS b, regr_intercept(v, t) AS a, COUNT(*) AS n, MAX(period) AS last
        FROM s GROUP BY Region HAVING COUNT(*) >= 5),
r AS (SELECT s.*, v - (a + b * t) AS res, month(period) AS season FROM s JOIN fit USING (Region)),
seas AS (SELECT Region, season, AVG(res) AS effect FROM r GROUP BY ALL),
sig AS (SELECT r.Region, stddev_samp(res - effect) AS sigma FROM r JOIN seas USING (Region, season) GROUP BY r.Region),
fut AS (SELECT fit.*, sig.sigma, h, CAST(last_day(fit.last + to_months(CAST(h AS INTEGER))) AS DATE) AS period
        FROM fit JOIN sig USING (Region), (SELECT unnest(range(1, 13)) AS h)),
fc AS (SELECT fut.Region, fut.period, a + b * (n - 1 + h) + COALESCE(effect, 0) AS m, 1.959964 * COALESCE(sigma, 0) AS band
       FROM fut LEFT JOIN seas ON seas.Region = fut.Region AND seas.season = month(fut.period))"""


def _seasonal(spark, sf):
    series = _series_by_region(spark, sf)
    return series, FC.seasonal_trend_forecast(series, 12, "M", keys=["Region"])


@register("i4_seasonal_trend", SEASONAL + """
SELECT Region, period, ROUND(m, 2) AS forecast, ROUND(m - band, 2) AS lower, ROUND(m + band, 2) AS upper FROM fc""")
def i4(spark, sf):
    f = _seasonal(spark, sf)[1]
    return f.select("Region", "period", *[round_scaled(c, 2).alias(c) for c in ("forecast", "lower", "upper")])


@register("i5_min_periods", """WITH ev AS (SELECT user_id, CAST(CAST(ts AS DATE) + CAST((7 - isodow(CAST(ts AS DATE))) % 7 AS INTEGER) AS DATE) AS wk
  FROM events WHERE ts IS NOT NULL AND value IS NOT NULL AND user_id IS NOT NULL),
b AS (SELECT user_id, MIN(wk) AS lo, MAX(wk) AS hi FROM ev GROUP BY 1)
SELECT user_id, CAST(date_diff('day', lo, hi) / 7 + 1 AS BIGINT) AS n_periods FROM b WHERE date_diff('day', lo, hi) / 7 + 1 >= 5""")
def i5(spark, sf):
    w = resample_sum(table(spark, sf, "events"), "ts", "value", "W", keys=["user_id"])
    ok = FC.long_enough(w, ["user_id"])
    return ok.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_periods"))


@register("i6_horizon_change", SEASONAL + """,
la AS (SELECT Region, CAST(arg_max(v, period) AS DOUBLE) AS last_actual FROM s GROUP BY Region),
lf AS (SELECT Region, arg_max(m, period) AS last_forecast FROM fc GROUP BY Region)
SELECT Region, ROUND(last_actual, 2) AS last_actual, ROUND(last_forecast, 2) AS last_forecast,
  ROUND(last_forecast - last_actual, 2) AS change,
  ROUND(CASE WHEN last_actual <> 0 THEN (last_forecast - last_actual) / abs(last_actual) * 100 ELSE 0 END, 4) AS change_pct,
  CASE WHEN last_forecast - last_actual >= 0 THEN 'good' ELSE 'warn' END AS tone FROM la JOIN lf USING (Region)""")
def i6(spark, sf):
    series, f = _seasonal(spark, sf)
    h = FC.horizon_change(series, f, ["Region"])
    return h.select("Region", *[round_scaled(c, 2).alias(c) for c in ("last_actual", "last_forecast", "change")],
                    round_scaled("change_pct", 4).alias("change_pct"), "tone")


@register("i7_history_forecast", SEASONAL + """
SELECT Region, period, 'history' AS kind, v AS value, CAST(NULL AS DOUBLE) AS lower, CAST(NULL AS DOUBLE) AS upper FROM s
UNION ALL SELECT Region, period, 'forecast', ROUND(m, 2), ROUND(m - band, 2), ROUND(m + band, 2) FROM fc""")
def i7(spark, sf):
    series, f = _seasonal(spark, sf)
    t = FC.history_and_forecast(series, f, ["Region"])
    fc = F.col("kind") == "forecast"
    return t.select("Region", "period", "kind", F.when(fc, round_scaled("value", 2)).otherwise(F.col("value")).alias("value"),
                    round_scaled("lower", 2).alias("lower"), round_scaled("upper", 2).alias("upper"))

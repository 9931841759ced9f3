"""Forecasting many regular series at once.

Series come from :func:`periods.resample_sum` as (keys..., period, value).
Each resampled series is short (one value per period), so a series' values
are gathered into one array and fitted with SQL higher-order functions; the
work is spread over series, and each row searches its own fit grid.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .periods import FREQS

MIN_PERIODS = 5
Z95 = 1.959964


def check_horizon(h: int) -> int:
    """Horizon between 3 and 36 periods (default 12)."""
    if not 3 <= int(h) <= 36:
        raise ValueError("horizon must be between 3 and 36 periods")
    return int(h)


def _next_period(last: Column, h: Column, freq: str) -> Column:
    unit = FREQS[freq]
    if unit == "month":
        return F.last_day(F.add_months(last, h))
    return F.date_add(last, h * 7 if unit == "week" else h)


def _season(period: Column, freq: str) -> Column:
    unit = FREQS[freq]
    if unit == "month":
        return F.month(period)
    if unit == "week":
        return F.weekofyear(period)
    return F.dayofweek(period)


def long_enough(series: DataFrame, keys=()) -> DataFrame:
    """Keep series with at least 5 periods."""
    keys = list(keys)
    if keys:
        n = series.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= MIN_PERIODS)
        return series.join(n.select(*keys), keys, "left_semi")
    n = series.select(F.count(F.lit(1)).alias("n")).scalar()
    return series.where(n >= MIN_PERIODS)


def seasonal_trend_forecast(series: DataFrame, horizon: int = 12, freq: str = "M", keys=()) -> DataFrame:
    """I4 (stand-in for the optional trend+seasonality model): per series, a least-squares
    line on the period index plus the mean residual of each season; band = +-1.96
    residual standard deviations. Output (keys..., period, forecast, lower, upper).
    """
    keys = list(keys)
    horizon = check_horizon(horizon)
    w = Window.partitionBy(*keys).orderBy("period")  # one series per window partition
    s = series.withColumn("t", (F.row_number().over(w) - 1).cast("double")).withColumn("v", F.col("value").cast("double"))
    fit = s.groupBy(*keys).agg(F.regr_slope("v", "t").alias("b"), F.regr_intercept("v", "t").alias("a"),
                               F.count(F.lit(1)).alias("n"), F.max("period").alias("last"))
    fit = fit.where(F.col("n") >= MIN_PERIODS)
    if keys:
        r = s.join(fit, keys)
    else:
        fr = fit.select(F.struct(*fit.columns).alias("f")).scalar()
        r = s.select("*", *[fr[c].alias(c) for c in fit.columns])
    r = r.withColumn("res", F.col("v") - (F.col("a") + F.col("b") * F.col("t"))).withColumn("season", _season(F.col("period"), freq))
    seas = r.groupBy(*keys, "season").agg(F.avg("res").alias("effect"))
    r2 = r.join(seas, [*keys, "season"])
    sig = r2.groupBy(*keys).agg(F.stddev_samp(F.col("res") - F.col("effect")).alias("sigma"))
    steps = fit.join(sig, keys) if keys else fit.select("*", sig.select(F.struct("sigma")).scalar()["sigma"].alias("sigma"))
    fut = steps.select(*keys, "a", "b", "n", "sigma", "last", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    fut = fut.withColumn("period", _next_period(F.col("last"), F.col("h"), freq)).withColumn("season", _season(F.col("period"), freq))
    fut = fut.join(seas, [*keys, "season"], "left")
    mean = F.col("a") + F.col("b") * (F.col("n") - 1 + F.col("h")) + F.coalesce(F.col("effect"), F.lit(0.0))
    band = Z95 * F.coalesce(F.col("sigma"), F.lit(0.0))
    return fut.select(*keys, "period", mean.alias("forecast"), (mean - band).alias("lower"), (mean + band).alias("upper"))


def _css(w: Column, m: Column, phi: Column, theta: Column) -> Column:
    """Conditional sum of squares of ARMA(1,1) on the differences ``w`` (eps_1 = 0)."""
    init = F.struct(F.lit(0.0).alias("e"), F.lit(0.0).alias("sse"))
    idx = F.sequence(F.lit(1), m - 1)
    return F.aggregate(idx, init, lambda acc, j: F.struct(
        (w[j] - phi * w[j - 1] - theta * acc["e"]).alias("e"),
        (acc["sse"] + (w[j] - phi * w[j - 1] - theta * acc["e"]) * (w[j] - phi * w[j - 1] - theta * acc["e"])).alias("sse")))


def arima111_forecast(series: DataFrame, horizon: int = 12, freq: str = "M", keys=()) -> DataFrame:
    """ARIMA(1,1,1) without constant by conditional least squares, per series.

    Grid phi, theta in [-0.95, 0.95] step 0.05, then +-0.05 step 0.005 around
    the best; ties -> smallest |phi|+|theta|, then phi, then theta.
    Output (keys..., period, forecast, lower, upper, phi, theta, sigma2).
    """
    keys = list(keys)
    horizon = check_horizon(horizon)
    arr = series.groupBy(*keys).agg(
        F.sort_array(F.collect_list(F.struct("period", F.col("value").cast("double").alias("v")))).alias("pts"))
    arr = arr.where(F.size("pts") >= MIN_PERIODS).select(
        *keys, F.element_at("pts", -1)["period"].alias("last"), F.transform("pts", lambda p: p["v"]).alias("y"))
    arr = arr.withColumn("w", F.transform(F.sequence(F.lit(1), F.size("y") - 1), lambda i: F.col("y")[i] - F.col("y")[i - 1]))
    arr = arr.withColumn("m", F.size("w"))

    def search(phi_at, theta_at, steps: int, width: float):
        """Best (sse, |phi| + |theta|, phi, theta) of a grid around a point, on the row's own arrays: no copies, no shuffle."""
        near = F.sequence(F.lit(-steps), F.lit(steps))
        grid = F.flatten(F.transform(near, lambda i: F.transform(near, lambda j: F.struct(
            F.round(phi_at + i * width, 4).alias("phi"), F.round(theta_at + j * width, 4).alias("theta")))))
        inside = F.filter(grid, lambda g: (F.abs(g["phi"]) <= 0.95) & (F.abs(g["theta"]) <= 0.95))
        return F.array_min(F.transform(inside, lambda g: F.struct(
            _css(F.col("w"), F.col("m"), g["phi"], g["theta"])["sse"].alias("_sse"),
            (F.abs(g["phi"]) + F.abs(g["theta"])).alias("_l1"), g["phi"].alias("_phi"), g["theta"].alias("_theta"))))

    coarse = arr.withColumn("_c", search(F.lit(0.0), F.lit(0.0), 19, 0.05))
    fine = coarse.withColumn("_f", search(F.col("_c._phi"), F.col("_c._theta"), 10, 0.005))
    phi, theta = F.col("_f._phi"), F.col("_f._theta")
    fitted = fine.select(*keys, "last", "y", "w", "m", phi.alias("phi"), theta.alias("theta"),
                         (F.col("_f._sse") / F.greatest(F.lit(1), F.col("m") - 3)).alias("sigma2"),
                         _css(F.col("w"), F.col("m"), phi, theta)["e"].alias("e_last"))
    fut = fitted.select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    p, t = F.col("phi"), F.col("theta")
    w1 = p * F.element_at("w", -1) + t * F.col("e_last")
    # sum_{k<=h} phi^(k-1) * w1
    geo = F.aggregate(F.sequence(F.lit(0), F.col("h") - 1), F.lit(0.0), lambda acc, k: acc + F.pow(p, k))
    mean = F.element_at("y", -1) + w1 * geo
    # psi_0 = 1, psi_j = psi_{j-1} + (phi+theta) phi^(j-1); var_h = sigma2 * sum_{j<h} psi_j^2
    psi_sq = F.aggregate(F.sequence(F.lit(0), F.col("h") - 1), F.struct(F.lit(0.0).alias("psi"), F.lit(0.0).alias("s")),
                         lambda acc, j: F.struct(
                             F.when(j == 0, F.lit(1.0)).otherwise(acc["psi"] + (p + t) * F.pow(p, j - 1)).alias("psi"),
                             (acc["s"] + F.pow(F.when(j == 0, F.lit(1.0)).otherwise(acc["psi"] + (p + t) * F.pow(p, j - 1)), 2)).alias("s")))
    half = Z95 * F.sqrt(F.col("sigma2") * psi_sq["s"])
    return fut.select(*keys, _next_period(F.col("last"), F.col("h"), freq).alias("period"), mean.alias("forecast"),
                      (mean - half).alias("lower"), (mean + half).alias("upper"), "phi", "theta", "sigma2")


def horizon_change(series: DataFrame, forecast: DataFrame, keys=()) -> DataFrame:
    """Last forecast minus last actual, % of |last actual| (0 when it is 0), tone."""
    keys = list(keys)
    last_a = series.groupBy(*keys).agg(F.max_by(F.col("value").cast("double"), "period").alias("last_actual"))
    last_f = forecast.groupBy(*keys).agg(F.max_by("forecast", "period").alias("last_forecast"))
    j = last_a.join(last_f, keys) if keys else last_a.select("*", last_f.select(F.struct("last_forecast")).scalar()["last_forecast"].alias("last_forecast"))
    ch = F.col("last_forecast") - F.col("last_actual")
    pct = F.when(F.col("last_actual") != 0, ch / F.abs(F.col("last_actual")) * 100).otherwise(F.lit(0.0))
    return j.select(*keys, "last_actual", "last_forecast", ch.alias("change"), pct.alias("change_pct"),
                    F.when(ch >= 0, "good").otherwise("warn").alias("tone"))


def history_and_forecast(series: DataFrame, forecast: DataFrame, keys=()) -> DataFrame:
    """One table: history rows (kind 'history') then forecast rows with their band."""
    keys = list(keys)
    hist = series.select(*keys, "period", F.lit("history").alias("kind"), F.col("value").cast("double").alias("value"),
                         F.lit(None).cast("double").alias("lower"), F.lit(None).cast("double").alias("upper"))
    fc = forecast.select(*keys, "period", F.lit("forecast").alias("kind"), F.col("forecast").alias("value"), "lower", "upper")
    return hist.unionByName(fc)

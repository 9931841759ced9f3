"""I4 as a trend with slope changes and Fourier seasons, many series at once.

    value = intercept + slope t + sum_j delta_j max(0, t - s_j) + sum_k a_k cos(2 pi k t / year) + b_k sin(2 pi k t / year)

Time runs from 0 to 1 over the history; candidate changepoints s_j lie evenly in its first 80 %. The slope changes carry
a Laplace prior (most stay near 0), the season's coefficients a normal one: the best coefficients come from
reweighted ridge regressions, each one Cholesky solve of the series' normal equations. The band adds the noise
and the slope changes to come, as often and as large as those found: over a time tau ahead their variance is
rate * 2 b^2 * tau^3 / 3 (Poisson times of Laplace changes of scale b).
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .forecast import MIN_PERIODS, _next_period, check_horizon
from .periods import FREQS

CHANGEPOINTS, RANGE = 25, 0.8
# Prior scales of a slope change and of a season's coefficient, in units of the largest absolute value.
CHANGE_SCALE, SEASON_SCALE = 0.05, 10.0
HARMONICS, YEAR = 10, 365.25
# Regressions at most, and the change from which a weight counts.
ROUNDS, LEAST_CHANGE = 400, 1e-6
Z80 = 1.2815515655446004


def harmonics(days: np.ndarray) -> int:
    """Fourier terms that the history can tell: none below two years, fewer than two periods a wave need not be told apart."""
    span = days[-1] - days[0]
    if span < 2 * YEAR:
        return 0
    return int(min(HARMONICS, YEAR / (2 * np.median(np.diff(days))) - 0.5))


def design(t: np.ndarray, days: np.ndarray, changes: np.ndarray, waves: int) -> np.ndarray:
    angle = 2 * np.pi * np.outer(days / YEAR, np.arange(1, waves + 1))
    return np.hstack([np.ones((len(t), 1)), t[:, None], np.maximum(0, t[:, None] - changes), np.cos(angle), np.sin(angle)])


def solve(x: np.ndarray, y: np.ndarray, n_changes: int) -> tuple[np.ndarray, float]:
    """Coefficients and noise deviation: ridge regressions whose weights stand for the Laplace prior."""
    penalty = np.zeros(x.shape[1])
    penalty[2 + n_changes:] = 1 / SEASON_SCALE ** 2
    change = slice(2, 2 + n_changes)
    gram, moments = x.T @ x, x.T @ y
    noise, beta = max(float(y.std()), 1e-9), np.zeros(x.shape[1])
    weights = np.full(n_changes, 1 / CHANGE_SCALE)
    for _ in range(ROUNDS):
        penalty[change] = 1 / (CHANGE_SCALE * np.maximum(weights, LEAST_CHANGE))
        factor = np.linalg.cholesky(gram + np.diag(noise ** 2 * penalty + 1e-10))
        new = np.linalg.solve(factor.T, np.linalg.solve(factor, moments))
        done = np.abs(new - beta).max() < 1e-9
        beta, weights = new, np.abs(new[change])
        noise = max(float(np.sqrt(np.mean((y - x @ beta) ** 2))), 1e-9)
        if done:
            break
    return beta, noise


def forecast(y: np.ndarray, days: np.ndarray, ahead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(forecast, half width of the band, trend) on the days ahead; days are numbers, y their values."""
    scale = float(np.abs(y).max()) or 1.0
    span = days[-1] - days[0]
    t, later = (days - days[0]) / span, (ahead - days[0]) / span
    n = min(CHANGEPOINTS, max(0, int(RANGE * len(y)) - 1))
    at = np.round(np.linspace(0, RANGE * len(y) - 1, n + 1)).astype(int)[1:]
    changes, waves = t[at], harmonics(days)
    beta, noise = solve(design(t, days - days[0], changes, waves), y / scale, n)
    x = design(later, ahead - days[0], changes, waves)
    size = float(np.abs(beta[2:2 + n]).mean()) if n else 0.0
    tau = later - 1
    # n changepoints over the unit of history
    spread = np.sqrt(noise ** 2 + n * 2 * size ** 2 * tau ** 3 / 3)
    return x @ beta * scale, Z80 * spread * scale, x[:, :2 + n] @ beta[:2 + n] * scale


OUT = "period date, forecast double, lower double, upper double, trend double"


def changepoint_forecast(series: DataFrame, horizon: int = 12, freq: str = "M", keys=()) -> DataFrame:
    """I4: (keys..., period, forecast, lower, upper, trend), 80 % band.

    ``series``: (keys..., period date, value). Missing and non-finite values are left out; series of fewer than 5 values have no rows.
    Yearly seasons enter from two years of history on; daily series get no weekly term.
    """
    keys, horizon = list(keys), check_horizon(horizon)
    FREQS[freq]  # an unknown frequency is an error here, not in a task
    value = F.col("value").cast("double")
    points = F.sort_array(F.collect_list(F.struct(F.unix_date(F.to_date("period")).cast("double").alias("d"), value.alias("v"))))
    known = series.where(value.isNotNull() & ~F.isnan(value) & (F.abs(value) != float("inf")))
    arr = known.groupBy(*keys).agg(points.alias("pts"), F.to_date(F.max("period")).alias("last")).where(F.size("pts") >= MIN_PERIODS)
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: _next_period(F.col("last"), h, freq))
    arr = arr.select(*keys, F.transform("pts", lambda p: p["d"]).alias("days"), F.transform("pts", lambda p: p["v"]).alias("y"), ahead.alias("ahead"))
    numbers = arr.withColumn("ahead_days", F.transform("ahead", lambda d: F.unix_date(d).cast("double")))
    result = T.StructType([*arr.select(*keys).schema.fields, T.StructField("r", T.ArrayType(T.StructType.fromDDL("forecast double, half double, trend double"))),
                           T.StructField("ahead", T.ArrayType(T.DateType()))])

    def run(batches):
        for b in batches:
            rows = []
            for y, days, later in zip(*[b.column(c).to_pylist() for c in ("y", "days", "ahead_days")]):
                found = forecast(np.array(y), np.array(days), np.array(later))
                rows.append([dict(zip(("forecast", "half", "trend"), map(float, r))) for r in zip(*found)])
            kind = pa.list_(pa.struct([(c, pa.float64()) for c in ("forecast", "half", "trend")]))
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(keys))], pa.array(rows, kind), b.column("ahead")], names=[*keys, "r", "ahead"])

    fitted = numbers.select(*keys, "y", "days", "ahead_days", "ahead").mapInArrow(run, result)
    steps = fitted.select(*keys, F.explode(F.arrays_zip("ahead", "r")).alias("s"))
    mean, half = F.col("s.r.forecast"), F.col("s.r.half")
    return steps.select(*keys, F.col("s.ahead").alias("period"), mean.alias("forecast"), (mean - half).alias("lower"), (mean + half).alias("upper"),
                        F.col("s.r.trend").alias("trend"))

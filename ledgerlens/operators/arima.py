"""I3 by exact likelihood: ARIMA(1,1,1) without constant, many series at once.

The differences w are ARMA(1,1). In state-space terms the one-step prediction and its variance ratio r follow

    pred' = phi w + theta (w - pred) / r,   r' = 1 + theta^2 - theta^2 / r,   r_0 = (1 + 2 phi theta + theta^2) / (1 - phi^2)

(the Kalman filter of this model, whose state is one number). With sigma^2 at its best value the likelihood
depends on (phi, theta) alone; a coarse grid starts a quasi-Newton search over their arc-tangents, so both stay
inside (-1, 1). A resampled series is short (one value a period), so a series is one row, and the rows are
spread over the tasks.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .forecast import MIN_PERIODS, Z95, _next_period, check_horizon

# Start points per axis, and the end of the search: steps, or a gradient this small.
GRID, STEPS, FLAT = 15, 200, 1e-7
EDGE = 0.999


def filtered(w: np.ndarray, phi, theta):
    """For every (phi, theta): half of -2 log likelihood at the best sigma^2 (but for constants), that sigma^2, the next prediction and its r."""
    phi, theta = np.atleast_1d(np.asarray(phi, float)), np.atleast_1d(np.asarray(theta, float))
    r = (1 + 2 * phi * theta + theta ** 2) / (1 - phi ** 2)
    pred, squares, logs = np.zeros_like(r), np.zeros_like(r), np.zeros_like(r)
    for x in w:
        e = x - pred
        squares += e * e / r
        logs += np.log(r)
        pred = phi * x + theta * e / r
        r = 1 + theta ** 2 - theta ** 2 / r
    sigma2 = squares / len(w)
    with np.errstate(divide="ignore"):
        return 0.5 * (len(w) * np.log(sigma2) + logs), sigma2, pred, r


def _objective(w, points):
    """Mean loss of the points (rows of unbounded coordinates)."""
    p = EDGE * np.tanh(points)
    return filtered(w, p[:, 0], p[:, 1])[0] / len(w)


def _with_gradient(w, x):
    step = 1e-5
    around = np.array([[0, 0], [step, 0], [-step, 0], [0, step], [0, -step]])
    f = _objective(w, x + around)
    return f[0], np.array([f[1] - f[2], f[3] - f[4]]) / (2 * step)


def fit(w: np.ndarray) -> tuple[float, float]:
    """(phi, theta) of the highest likelihood. A series without changes has (0, 0)."""
    scale = float(np.sqrt(np.mean(w * w)))
    if scale == 0 or not np.isfinite(scale):
        return 0.0, 0.0
    w = w / scale
    axis = np.arctanh(np.linspace(-0.9, 0.9, GRID))
    points = np.array([(a, b) for a in axis for b in axis])
    x = points[int(np.argmin(_objective(w, points)))]
    f, g = _with_gradient(w, x)
    inverse = np.eye(2)
    for _ in range(STEPS):
        if np.abs(g).max() < FLAT:
            break
        move = -inverse @ g
        if move @ g >= 0:  # no way down: start the curvature anew
            inverse, move = np.eye(2), -g
        move *= min(1.0, 1.0 / np.abs(move).max())
        size = 1.0
        while size > 1e-10 and _objective(w, (x + size * move)[None])[0] > f + 1e-4 * size * (move @ g):
            size /= 2
        if size <= 1e-10:
            break
        nxt = x + size * move
        f, g2 = _with_gradient(w, nxt)
        s, y = nxt - x, g2 - g
        if s @ y > 1e-14:
            rho, eye = 1 / (s @ y), np.eye(2)
            inverse = (eye - rho * np.outer(s, y)) @ inverse @ (eye - rho * np.outer(y, s)) + rho * np.outer(s, s)
        x, g = nxt, g2
    phi, theta = EDGE * np.tanh(x)
    return float(phi), float(theta)


FIT = "phi double, theta double, sigma2 double, loglik double, first_step double, first_ratio double"


def _fitted(batches):
    names = [c.split()[0] for c in FIT.split(", ")]
    for b in batches:
        rows = []
        for y in b.column("y").to_pylist():
            w = np.diff(np.array(y, dtype=np.float64))
            phi, theta = fit(w)
            loss, sigma2, pred, r = (float(x[0]) for x in filtered(w, phi, theta))
            constant = 0.5 * len(w) * (1 + np.log(2 * np.pi))
            rows.append((phi, theta, sigma2, -loss - constant if sigma2 > 0 else None, pred, r))
        yield pa.RecordBatch.from_arrays([*b.columns, *[pa.array([r[i] for r in rows], pa.float64()) for i in range(len(names))]],
                                         names=[*b.schema.names, *names])


def arima_likelihood(series: DataFrame, horizon: int = 12, freq: str = "M", keys=()) -> DataFrame:
    """(keys..., period, forecast, lower, upper, phi, theta, sigma2, loglik) of the likelihood fit, 95 % band.

    ``series``: (keys..., period, value) with one row a period. Missing values are left out; series of fewer than 5
    values have no rows; a series without changes repeats its value with an empty band (loglik NULL); a series whose
    values are not finite has NULL results. The band holds the filter's own uncertainty of the last shock as well.
    """
    keys, horizon = list(keys), check_horizon(horizon)
    value = F.col("value").cast("double")
    points = F.sort_array(F.collect_list(F.struct("period", value.alias("v"))))
    arr = series.where(value.isNotNull()).groupBy(*keys).agg(points.alias("pts")).where(F.size("pts") >= MIN_PERIODS)
    arr = arr.select(*keys, F.element_at("pts", -1)["period"].alias("last"), F.transform("pts", lambda p: p["v"]).alias("y"))
    schema = T.StructType(arr.schema.fields + T.StructType.fromDDL(FIT).fields)
    steps = arr.mapInArrow(_fitted, schema).select("*", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    phi, theta = F.col("phi"), F.col("theta")
    # y_T + pred (1 + phi + ... + phi^(h-1))
    powers = F.transform(F.sequence(F.lit(0), F.col("h") - 1), lambda k: F.pow(phi, k))
    geo = F.aggregate(powers, F.lit(0.0), lambda a, p: a + p)
    mean = F.element_at("y", -1) + F.col("first_step") * geo
    # shocks to come enter the sum with 1 + (phi + theta)(1 + ... + phi^(j-1)); the last one's uncertainty with r - 1
    shocks = F.aggregate(powers, F.struct(F.lit(0.0).alias("below"), F.lit(0.0).alias("sum")), lambda a, p: F.struct(
        (a["below"] + p).alias("below"), (a["sum"] + F.pow(1 + (phi + theta) * a["below"], F.lit(2))).alias("sum")))["sum"]
    half = Z95 * F.sqrt(F.col("sigma2") * (shocks + (F.col("first_ratio") - 1) * geo * geo))
    return steps.select(*keys, _next_period(F.col("last"), F.col("h"), freq).alias("period"), mean.alias("forecast"),
                        (mean - half).alias("lower"), (mean + half).alias("upper"), "phi", "theta", "sigma2", "loglik")

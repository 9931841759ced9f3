"""ARIMA by likelihood against dense normal distributions; the changepoint model against least squares and simulation."""
import datetime as dt

import numpy as np
import pytest

from ledgerlens.operators import arima as A
from ledgerlens.operators import changepoint as C


def covariance(phi, theta, n):
    """Of n consecutive ARMA(1,1) values at sigma 1, from the first psi weights."""
    g0 = (1 + 2 * phi * theta + theta ** 2) / (1 - phi ** 2)
    g1 = (1 + phi * theta) * (phi + theta) / (1 - phi ** 2)
    gamma = [g0] + [g1 * phi ** k for k in range(n - 1)]
    return np.array([[gamma[abs(i - j)] for j in range(n)] for i in range(n)])


def simulated(n, phi, theta, seed):
    rng = np.random.default_rng(seed)
    e, w = rng.normal(size=n + 200), np.zeros(n + 200)
    for t in range(1, n + 200):
        w[t] = phi * w[t - 1] + e[t] + theta * e[t - 1]
    return w[200:]


@pytest.mark.parametrize("phi,theta", [(0.5, 0.3), (-0.7, 0.6), (0.95, -0.4), (0.0, 0.0)])
def test_likelihood_is_that_of_the_dense_normal(phi, theta):
    w = simulated(30, 0.4, 0.2, 1) * 3
    loss, sigma2, pred, ratio = (x[0] for x in A.filtered(w, phi, theta))
    cov = covariance(phi, theta, 31)
    quad = w @ np.linalg.solve(cov[:30, :30], w)
    assert sigma2 == pytest.approx(quad / 30)
    assert loss == pytest.approx(0.5 * (30 * np.log(quad / 30) + np.linalg.slogdet(cov[:30, :30])[1]))
    # the prediction and its variance are those of the conditional normal
    gain = np.linalg.solve(cov[:30, :30], cov[:30, 30])
    assert pred == pytest.approx(gain @ w) and ratio == pytest.approx(cov[30, 30] - gain @ cov[:30, 30])


@pytest.mark.parametrize("seed,phi,theta", [(1, 0.6, 0.3), (2, -0.5, 0.4), (3, 0.8, -0.3), (4, 0.3, 0.9)])
def test_the_fit_is_the_highest_likelihood(seed, phi, theta):
    w = simulated(400, phi, theta, seed)
    found = A.fit(w * 1e6)
    axis = np.linspace(-0.99, 0.99, 100)
    grid = np.array([(a, b) for a in axis for b in axis])
    assert A.filtered(w, *found)[0][0] <= A.filtered(w, grid[:, 0], grid[:, 1])[0].min() + 1e-6
    assert found == pytest.approx((phi, theta), abs=0.15)


def series_of(spark, **values):
    rows = [(k, dt.date(2015 + i // 12, i % 12 + 1, 28), None if v is None else float(v)) for k, vs in values.items() for i, v in enumerate(vs)]
    return spark.createDataFrame(rows, "k string, period date, value double")


def test_forecast_and_band_are_those_of_the_conditional_normal(spark):
    y = np.cumsum(simulated(40, 0.6, 0.3, 9)) + 50
    out = A.arima_likelihood(series_of(spark, a=y), 6, "M", keys=["k"]).orderBy("period").collect()
    phi, theta, sigma2 = out[0]["phi"], out[0]["theta"], out[0]["sigma2"]
    cov, w = covariance(phi, theta, 45), np.diff(y)
    gain = np.linalg.solve(cov[:39, :39], cov[:39, 39:])
    sums = np.tril(np.ones((6, 6)))
    mean = y[-1] + sums @ (gain.T @ w)
    var = np.diag(sums @ (cov[39:, 39:] - cov[39:, :39] @ gain) @ sums.T) * sigma2
    assert [r["forecast"] for r in out] == pytest.approx(mean.tolist(), rel=1e-6)
    assert [(r["upper"] - r["lower"]) / 2 / 1.959964 for r in out] == pytest.approx(np.sqrt(var).tolist(), rel=1e-6)
    assert out[0]["period"] == dt.date(2018, 5, 31)


def test_odd_series(spark):
    s = series_of(spark, flat=[7] * 8, short=[1, 2, 3, 4], gaps=[1, None, 3, 5, None, 4, 8, 9], nan=[1, 2, float("nan"), 4, 5, 6])
    out = {r["k"]: r for r in A.arima_likelihood(s, 3, "M", keys=["k"]).orderBy("period", ascending=False).collect()}
    assert set(out) == {"flat", "gaps", "nan"}
    assert (out["flat"]["forecast"], out["flat"]["lower"], out["flat"]["loglik"]) == (7.0, 7.0, None)
    assert np.isfinite(out["gaps"]["forecast"])
    late = {r["k"]: r for r in C.changepoint_forecast(s, 3, "M", keys=["k"]).collect()}
    assert set(late) == {"flat", "gaps", "nan"} and late["flat"]["forecast"] == pytest.approx(7.0, abs=1e-3)
    assert A.arima_likelihood(s.limit(0), 3, "M", keys=["k"]).count() == C.changepoint_forecast(s.limit(0), 3, "M", keys=["k"]).count() == 0
    assert A.arima_likelihood(s.where("k = 'gaps'").drop("k"), 3).count() == 3


def test_slope_change_and_season_are_found(spark):
    n, rng = 96, np.random.default_rng(3)
    t = np.arange(n)
    trend = np.where(t < 48, 100 + 2.0 * t, 196 - 1.0 * (t - 48))
    season = 15 * np.sin(2 * np.pi * (t + 0.9) / 12)
    out = C.changepoint_forecast(series_of(spark, a=trend + season + rng.normal(size=n)), 12, "M", keys=["k"]).orderBy("period").collect()
    ahead = np.arange(n, n + 12)
    assert [r["forecast"] for r in out] == pytest.approx((196 - (ahead - 48) + 15 * np.sin(2 * np.pi * (ahead + 0.9) / 12)).tolist(), abs=8)
    widths = [r["upper"] - r["lower"] for r in out]
    assert widths == sorted(widths) and widths[0] > 0
    assert out[11]["trend"] - out[0]["trend"] == pytest.approx(-11, abs=5)  # the new slope goes on


def test_solve_meets_the_conditions_of_the_penalised_optimum():
    """At the optimum each slope change that is not 0 has the gradient sign(delta) / scale, the others at most that."""
    rng = np.random.default_rng(5)
    t = np.linspace(0, 1, 120)
    changes = np.linspace(0.03, 0.8, 25)
    y = 0.3 + 0.5 * t - 0.9 * np.maximum(0, t - changes[12]) + 0.02 * rng.normal(size=120)
    x = C.design(t, t * 0, changes, 0)
    beta, noise = C.solve(x, y, 25)
    gradient = x.T @ (y - x @ beta) / noise ** 2 * C.CHANGE_SCALE
    assert np.abs(gradient[:2]).max() < 1e-2
    assert (np.abs(gradient[2:]) <= 1.02).all()
    large = np.abs(beta[2:]) > 1e-3
    assert large.any() and gradient[2:][large] == pytest.approx(np.sign(beta[2:][large]), abs=0.02)


def test_the_band_is_that_of_simulated_changes():
    rng = np.random.default_rng(6)
    rate, size, tau = 25, 0.04, 0.3
    ends = []
    for _ in range(40000):
        when = rng.uniform(0, tau, rng.poisson(rate * tau))
        ends.append((rng.laplace(0, size, len(when)) * (tau - when)).sum())
    assert np.var(ends) == pytest.approx(rate * 2 * size ** 2 * tau ** 3 / 3, rel=0.05)

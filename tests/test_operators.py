"""Operator properties on the small test tables."""
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import forecast as FC
from ledgerlens.operators import insights as I
from ledgerlens.operators import quality as Q
from ledgerlens.operators import stats as ST
from ledgerlens.operators.periods import interpolate, resample_sum
from ledgerlens.sources import views as V


def test_clean_pipeline_properties(spark, sf):
    d = V.dirty_view(spark, sf)
    issues = Q.detect_issues(d)
    empty = [r["column"] for r in issues["empty_columns"].collect()]
    outl = [r["column"] for r in issues["outliers"].collect()]
    spec = Q.CleanSpec.from_issues(issues["duplicates"].first()["duplicates"], empty, outl)
    spec.missing_action = "mean"
    out = Q.clean(d, spec)
    assert "Empty" not in out.columns
    assert Q.missing_total(out).first()["missing_total"] == 0
    assert Q.duplicate_count(out).first()["duplicates"] == 0
    f = Q.iqr_fences(d, ["Revenue"]).first()
    lo, hi = out.agg(F.min("Revenue"), F.max("Revenue")).first()
    assert lo >= f["lower"] - 1e-9 or hi <= f["upper"] + 1e-9


def test_histogram_bins_sum_to_count_and_constant_column(spark, sf):
    d = V.dirty_view(spark, sf)
    h = ST.histogram(d, "Revenue", 40)
    assert h.count() == 40
    assert h.agg(F.sum("count")).first()[0] == d.where(F.col("Revenue").isNotNull()).count()
    assert ST.histogram(d, "Flat", 40).count() == 1


def test_shares_sum_to_100(spark, sf):
    from ledgerlens.operators.kpi import regional_totals
    s = V.sales_view(spark, sf, ["Region", "Revenue"])
    assert regional_totals(s, "Region", "Revenue").agg(F.sum("share_pct")).first()[0] == pytest.approx(100.0)


def test_forecast_band_and_arima_recurrence(spark, sf):
    s = V.sales_view(spark, sf, ["Region", "Date", "Revenue"])
    series = resample_sum(s, "Date", "Revenue", "M", keys=["Region"])
    f = FC.seasonal_trend_forecast(series, 6, "M", ["Region"])
    assert f.where((F.col("lower") > F.col("forecast")) | (F.col("forecast") > F.col("upper"))).count() == 0
    a = FC.arima111_forecast(series, 6, "M", ["Region"]).where(F.col("Region") == "ASIA").orderBy("period").collect()
    y = np.array([float(r["value"]) for r in series.where(F.col("Region") == "ASIA").orderBy("period").collect()])
    w = np.diff(y)

    def css(phi, theta):
        e, sse = 0.0, 0.0
        for j in range(1, len(w)):
            e = w[j] - phi * w[j - 1] - theta * e
            sse += e * e
        return sse, e
    phi, theta = a[0]["phi"], a[0]["theta"]
    best = min(css(round(i * 0.05, 4), round(j * 0.05, 4))[0] for i in range(-19, 20) for j in range(-19, 20))
    assert css(phi, theta)[0] <= best * (1 + 1e-12)
    e_last = css(phi, theta)[1]
    w1 = phi * w[-1] + theta * e_last
    assert a[0]["forecast"] == pytest.approx(y[-1] + w1)
    assert a[1]["forecast"] == pytest.approx(y[-1] + w1 + phi * w1)
    assert all(r["lower"] <= r["forecast"] <= r["upper"] for r in a)


def test_interpolation_fills_inner_gaps(spark):
    import datetime as dt
    df = spark.createDataFrame([("k", dt.date(2024, 1, 31), 1.0), ("k", dt.date(2024, 2, 29), None),
                                ("k", dt.date(2024, 3, 31), 3.0), ("k", dt.date(2024, 4, 30), None)],
                               "k string, period date, value double")
    got = [r["value"] for r in interpolate(df, keys=["k"]).orderBy("period").collect()]
    assert got == [1.0, 2.0, 3.0, 3.0]


def test_insights_fallback_and_recommendations(spark, sf):
    from ledgerlens.sources.tables import table
    ins = I.insights(table(spark, sf, "region"))
    assert [r["rule"] for r in ins.collect()] == ["fallback"]
    recs = [r["recommendation"] for r in I.recommendations(ins).orderBy("position").collect()]
    assert recs == [I.REC_NONE, I.REC_REVIEW]


def test_wide_table_aggregates_are_chunked(spark):
    from ledgerlens.operators.profile import describe_numeric
    rng = np.random.default_rng(7)
    data = rng.normal(10, 3, (200, 30)).round(3)
    df = spark.createDataFrame([tuple(float(v) for v in row) for row in data], [f"c{i}" for i in range(30)])
    d = {r["column"]: r for r in describe_numeric(df).collect()}
    assert len(d) == 30
    for i in (0, 17, 29):
        col = data[:, i]
        assert d[f"c{i}"]["mean"] == pytest.approx(col.mean()) and d[f"c{i}"]["std"] == pytest.approx(col.std(ddof=1))
        assert d[f"c{i}"]["q75"] == pytest.approx(np.quantile(col, 0.75))
    assert Q.missing_counts(df).count() == 30
    assert ST.skewness(df).count() == 30

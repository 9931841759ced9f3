"""Property tests: exact quantiles on random data with heavy ties."""
import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from ledgerlens.functions import ranking as R

values = st.lists(st.integers(min_value=-5, max_value=5), min_size=1, max_size=60)
probs = st.lists(st.sampled_from([0.0, 0.1, 0.25, 0.5, 0.75, 0.9, 1.0]), min_size=1, max_size=3, unique=True)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(vals=values, ps=probs)
def test_quantiles_match_numpy(spark, vals, ps):
    df = spark.createDataFrame([(float(v),) for v in vals], "v double")
    row = R.quantiles(df, ["v"], ps).first()
    exp = np.quantile(np.array(vals, dtype=float), ps)
    assert [row[f"q{i}"] for i in range(len(ps))] == pytest.approx(exp.tolist(), abs=1e-9)
    assert row["n"] == len(vals)


def test_fences_do_not_depend_on_partitioning(spark):
    from ledgerlens.operators.quality import iqr_fences
    rng = np.random.default_rng(11)
    data = [(float(x),) for x in rng.exponential(100, 2000).round(1)]
    a = iqr_fences(spark.createDataFrame(data, "v double").repartition(1)).first()
    b = iqr_fences(spark.createDataFrame(data, "v double").repartition(13)).first()
    assert a == b

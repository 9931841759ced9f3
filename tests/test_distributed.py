"""Distributed building blocks against brute force: quantiles, running sums, ROC/AUC, split."""
import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions.aggs import distinct_counts, frequent_candidates, modes
from ledgerlens.functions.ranking import cumulative, quantiles
from ledgerlens.operators import metrics as M
from ledgerlens.operators.modelprep import fold_assignment, stratified_split


@pytest.mark.parametrize("seed", [1, 2])
def test_exact_quantiles_with_a_hot_value(spark, seed):
    rng = np.random.default_rng(seed)
    vals = np.concatenate([rng.normal(50, 20, 4000).round(1), np.full(2000, 42.0)])  # a third is one value
    groups = rng.integers(0, 3, len(vals))
    df = spark.createDataFrame([(int(g), float(v)) for g, v in zip(groups, vals)], "g int, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]
    df = df.unionByName(spark.createDataFrame([(None, 1e9), (None, 2e9), (0, None), (1, float("nan"))], df.schema))
    got = {r["g"]: [r[f"q{i}"] for i in range(len(probs))] for r in quantiles(df, ["v"], probs, ["g"]).collect()}
    assert set(got) == {0, 1, 2}  # a NULL group is no group
    for g in range(3):
        exp = np.quantile(vals[groups == g], probs)
        assert got[g] == pytest.approx(exp.tolist(), abs=1e-9)


def test_exact_quantiles_beyond_the_sketch(spark, monkeypatch):
    """With a coarse sketch most values collapse into gaps; the quantiles stay exact."""
    from ledgerlens.functions import ranking as R
    monkeypatch.setattr(R, "SKETCH_ACCURACY", 50)
    rng = np.random.default_rng(8)
    vals = np.concatenate([rng.normal(0, 1e3, 20000), np.full(20000, 7.0), rng.integers(0, 90, 5000).astype(float)])
    rng.shuffle(vals)
    df = spark.createDataFrame([(float(v),) for v in vals], "v double").repartition(7)
    probs = [0.01, 0.25, 0.5, 0.73, 0.999]
    row = R.quantiles(df, ["v"], probs).first()
    assert [row[f"q{i}"] for i in range(len(probs))] == pytest.approx(np.quantile(vals, probs).tolist(), abs=1e-9)


def test_quantiles_narrow_the_remnant_in_rounds(spark, monkeypatch):
    """A sketch of accuracy 5 leaves all rows in the brackets; three rounds bring them under a small bound, by part."""
    from ledgerlens.functions import ranking as R
    monkeypatch.setattr(R, "SKETCH_ACCURACY", 5)
    monkeypatch.setattr(R, "REMNANT_ROWS", 90)
    rounds, narrowed = [], R._narrowed
    monkeypatch.setattr(R, "_narrowed", lambda remnant, *a: rounds.append(remnant.count()) or narrowed(remnant, *a))
    rng = np.random.default_rng(9)
    big = np.concatenate([np.exp(rng.normal(0, 8, 60000)), np.full(30000, 1.5), np.full(9, -1e300)])
    small = rng.integers(0, 40, 500).astype(float)
    rows = [("big", float(v)) for v in big] + [("small", float(v)) for v in small] + [("one", 3.0), ("one", None), (None, 8.0)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    probs = [0.001, 0.25, 0.5, 0.75, 0.9999]
    got = {r["g"]: [r[f"q{i}"] for i in range(len(probs))] for r in R.quantiles(df, ["v"], probs, ["g"]).collect()}
    assert set(got) == {"big", "small", "one"} and got["one"] == [3.0] * 5
    assert got["small"] == pytest.approx(np.quantile(small, probs).tolist(), rel=1e-12)
    assert got["big"] == pytest.approx(np.quantile(big, probs).tolist(), rel=1e-9)
    assert len(rounds) >= 3 and rounds[0] > 40000 and rounds == sorted(rounds, reverse=True)


def test_cumulative_matches_cumsum(spark):
    rng = np.random.default_rng(3)
    keys = rng.permutation(500).astype(float)
    w = rng.integers(1, 5, 500)
    df = spark.createDataFrame([(float(k), int(x)) for k, x in zip(keys, w)], "k double, w long")
    got = {r["k"]: r["cum_w"] for r in cumulative(df, [], ["k"], ["w"]).collect()}
    order = np.argsort(keys)
    exp = dict(zip(keys[order], np.cumsum(w[order])))
    assert got == {k: int(v) for k, v in exp.items()}


def test_cumulative_keeps_rows_of_a_null_part(spark):
    rows = [(None, i, 1) for i in range(40)] + [("a", i, 2) for i in range(30)]
    got = cumulative(spark.createDataFrame(rows, "g string, k int, w long"), ["g"], ["k"], ["w"]).collect()
    assert {(r["g"], r["k"]): (r["cum_w"], r["total_w"]) for r in got} == \
        {(None, i): (i + 1, 40) for i in range(40)} | {("a", i): (2 * i + 2, 60) for i in range(30)}


def test_auc_matches_pairwise_brute_force(spark):
    rng = np.random.default_rng(4)
    y = rng.integers(0, 2, 300)
    s = (rng.random(300) * 10).round() + y  # many ties
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    auc = M.roc_auc(df, "y", "s").first()["auc"]
    pos, neg = s[y == 1], s[y == 0]
    exp = ((pos[:, None] > neg[None, :]).sum() + 0.5 * (pos[:, None] == neg[None, :]).sum()) / (len(pos) * len(neg))
    assert auc == pytest.approx(exp)
    pts = M.roc_points(df, "y", "s").orderBy("fpr", "tpr").collect()
    assert (pts[0]["fpr"], pts[0]["tpr"]) == (0.0, 0.0) and (pts[-1]["fpr"], pts[-1]["tpr"]) == (1.0, 1.0)


@pytest.mark.parametrize("as_type", ["string", "double"])
def test_modes_by_sketch_equal_those_by_counting(spark, as_type):
    rng = np.random.default_rng(6)
    n = 3000
    hot = np.where(rng.random(n) < 0.34, 7, rng.integers(100, 100000, n))
    even = rng.permutation(n)  # no value twice: the sketch can't tell
    ties = np.arange(n) % 3
    gaps = [None if i % 2 else int(v) for i, v in enumerate(rng.integers(0, 5, n))]
    df = spark.createDataFrame([(int(a), int(b), int(c), d, None) for a, b, c, d in zip(hot, even, ties, gaps)],
                               "`h ot` int, even int, ties int, gaps int, none int")
    found = frequent_candidates(df, df.columns, as_type, items=256, top=8).first()
    assert found["c0"] in (["7"], [7.0]) and found["c1"] is None and found["c4"] is None
    assert len(found["c2"]) == 3 and found["c3"] is not None
    got = {r["column"]: (r["mode"], r["mode_count"]) for r in modes(df, df.columns, as_type).collect()}
    assert got == {r["column"]: (r["mode"], r["mode_count"]) for r in modes(df, df.columns, as_type, few=True).collect()}
    assert got["h ot"][1] == int((hot == 7).sum()) and "none" not in got
    assert {r["column"]: r["n_unique"] for r in distinct_counts(df, df.columns, as_type).collect()} == {
        "h ot": len(set(hot)), "even": n, "ties": 3, "gaps": 5}


def test_modes_of_odd_doubles(spark):
    df = spark.createDataFrame([(-0.0,), (0.0,), (float("nan"),), (float("nan"),), (float("nan"),), (1.0,), (None,)], "x double")
    assert [tuple(r) for r in modes(df, ["x"], "double").collect()] == [("x", 0.0, 2)]
    assert modes(df.limit(0), ["x"], "double").collect() == []


def test_roc_points_inside_a_run_of_equal_steps_are_dropped(spark):
    rng = np.random.default_rng(5)
    y, s = rng.integers(0, 2, 400), rng.permutation(400) / 8.0
    y[100:200] = 1
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s)], "y int, s double")
    steps = [(1, 0) if a else (0, 1) for _, a in sorted(zip(s, y), reverse=True)]
    order = sorted(s, reverse=True)
    kept = [t for i, t in enumerate(order) if i in (0, len(order) - 1) or steps[i + 1] != steps[i]]
    got = sorted(r["threshold"] for r in M.roc_points(df, "y", "s", drop_intermediate=True).collect())
    assert got == [*sorted(kept), float("inf")]


def test_stratified_split_is_exact_and_repeatable(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(301)], "id int, c string")
    s1 = stratified_split(df, "c", 0.2)
    sizes = {(r["c"], r["split"]): r["n"] for r in s1.groupBy("c", "split").agg(F.count("*").alias("n")).collect()}
    assert sizes[("a", "test")] == 40 and sizes[("b", "test")] == 21   # ceil(0.2 * n_c): 200 and 101 rows
    a = sorted(r["id"] for r in s1.where("split = 'test'").collect())
    b = sorted(r["id"] for r in stratified_split(df, "c", 0.2).where("split = 'test'").collect())
    assert a == b
    f = fold_assignment(df, "c", 5).groupBy("fold").count().collect()
    assert sum(r["count"] for r in f) == 301 and max(r["count"] for r in f) - min(r["count"] for r in f) <= 2


def test_confusion_matrix_sums_to_rows(spark):
    df = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("c", "a")], "y string, p string")
    cm = M.confusion_matrix(df, "y", "p")
    assert cm.count() == 9 and cm.agg(F.sum("count")).first()[0] == 4

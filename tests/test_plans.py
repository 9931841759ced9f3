"""Scans per query: each table is read once a pass, and the passes do not grow with the columns."""
import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from ledgerlens.operators import stats as ST


def scans(df, name=""):
    text = df._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall(rf"Relation \[{name}", text))


@pytest.mark.parametrize("query,most", [("f1_total_revenue", 1), ("f8_monthly_trend", 1), ("f15_kpi_table", 2), ("i1_resample_monthly_by_region", 1)])
def test_fact_scans(spark, sf, query, most):
    assert scans(E.queries()[query](spark, sf), "l_orderkey") == most


def test_f1_reads_nothing_but_the_fact_table(spark, sf):
    assert scans(E.queries()["f1_total_revenue"](spark, sf)) == 1


def test_correlation_scans_do_not_grow_with_the_columns(spark, tmp_path):
    wide = spark.range(50).select(*[F.when(F.col("id") % (i + 2) != 0, F.col("id") * i).cast("double").alias(f"c{i}") for i in range(30)])
    wide.write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    few, many = (scans(ST.correlation_pairs(df, [f"c{i}" for i in range(n)])) for n in (3, 30))
    assert few == many
    assert ST.correlation_pairs(df, [f"c{i}" for i in range(30)]).count() == 30 * 31 // 2


def test_both_correlation_layouts_agree(spark, monkeypatch):
    df = spark.range(300).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 5 != 0, F.col("id") * 2.0).alias("b"),
                                 F.sin("id").alias("c"), F.lit(3.0).alias("d"))
    one = {(r["i"], r["j"]): r["r"] for r in ST.correlation_pairs(df, decimals=None).collect()}
    monkeypatch.setattr(ST, "FIELDS_PER_AGG", 0)
    two = {(r["i"], r["j"]): r["r"] for r in ST.correlation_pairs(df, decimals=None).collect()}
    assert one.keys() == two.keys()
    for k in one:
        assert one[k] == (None if two[k] is None else pytest.approx(two[k]))


def test_dense_sums_take_gaps_and_empty_tables(spark):
    """Sums over complete pairs only, against the other layout, with nulls, NaN and an all-missing column."""
    df = spark.range(500).select(F.when(F.col("id") % 3 != 0, F.col("id") / 7).alias("a"), F.when(F.col("id") % 4 != 0, F.sin("id")).otherwise(float("nan")).alias("b"),
                                 F.lit(None).cast("double").alias("c"), (F.col("id") * F.col("id")).cast("double").alias("d")).repartition(5)
    names = ["n", "sa", "sb", "saa", "sbb", "sab"]
    clean = df.select(*[F.nanvl(c, F.lit(None).cast("double")).alias(c) for c in df.columns])
    got = {(r["i"], r["j"]): [r[k] for k in names] for r in ST._dense_sums(clean).collect()}
    rows = clean.collect()
    for (i, j), sums in got.items():
        pairs = [(r[i], r[j]) for r in rows if r[i] is not None and r[j] is not None]
        want = [len(pairs), sum(x for x, _ in pairs), sum(y for _, y in pairs), sum(x * x for x, _ in pairs), sum(y * y for _, y in pairs), sum(x * y for x, y in pairs)]
        assert sums == pytest.approx(want, rel=1e-9, abs=1e-9)
    assert len(got) == 10
    assert ST.correlation_pairs(clean.limit(0)).where("r is not null").count() == 0


def test_cleaning_reads_the_joined_view_from_one_copy(spark, sf):
    from ledgerlens.plans import q_quality
    for table in q_quality._cleaned(spark, sf):
        assert not any("lineitem.parquet" in f for f in table.inputFiles())

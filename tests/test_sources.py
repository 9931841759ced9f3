"""Readers, audit logs and report tables."""
import os
import tempfile

import pytest

from ledgerlens.sources import tables as TB
from ledgerlens.sources.audit import AuditLog
from ledgerlens.sources.report import report_tables, write_report
from ledgerlens.sources import views as V


def test_extension_dispatch_and_header_cleanup(spark, tmp_path):
    with pytest.raises(ValueError):
        TB.read_dataset(spark, str(tmp_path / "x.xlsx"))
    p = tmp_path / "h.csv"
    p.write_text(" a ,a, b \n1,2,2024-01-05\n3,4,2024-02-01\n", encoding="utf-8")
    df = TB.read_dataset(spark, str(p))
    assert df.columns == ["a", "a.1", "b"]


def test_csv_cells_as_real_files_hold_them(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text('n,x,note,flag,none\n1,NA,"He said ""hi"", twice",True,\n2,1.5,"two\nlines",False,\n3,-2e3,null,TRUE,NaN\n4,7\n', encoding="utf-8")
    df = TB.read_csv(spark, str(p))
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "boolean", "double"]
    rows = [tuple(r) for r in df.orderBy("n").collect()]
    assert rows == [(1, None, 'He said "hi", twice', True, None), (2, 1.5, "two\nlines", False, None),
                    (3, -2000.0, None, True, None), (4, 7.0, None, None, None)]


def test_csv_rows_with_too_many_cells_raise(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("a,b\n1,2\n3,4,5\n", encoding="utf-8")
    with pytest.raises(ValueError):
        TB.read_dataset(spark, str(p))


def test_sample_catalog_lists_what_is_there(spark, sf):
    assert "lineitem" in TB.sample_catalog(spark, sf) and TB.sample_catalog(spark, sf)["region"].endswith("region.parquet")


def test_audit_log_shows_failures_other_than_a_missing_log(spark, tmp_path):
    (tmp_path / "audit" / "datasets" / "rows-0").mkdir(parents=True)
    (tmp_path / "audit" / "datasets" / "rows-0" / "part-0.parquet").write_text("not parquet")
    with pytest.raises(Exception):
        AuditLog(spark, str(tmp_path / "audit")).read("datasets").collect()


def test_latin1_fallback_and_date_coercion(spark, tmp_path):
    p = tmp_path / "l.csv"
    p.write_bytes("name,order_date,city\nJos\xe9,2024-01-05,M\xfcnchen\nAnn,2024-02-01,Paris\n".encode("latin-1"))
    df = TB.read_dataset(spark, str(p))
    rows = df.orderBy("name").collect()
    assert rows[1]["name"] == "José" and rows[1]["city"] == "München"
    assert str(df.schema["order_date"].dataType) in ("DateType()", "TimestampNTZType()", "TimestampType()")


def test_audit_log_roundtrip(spark, tmp_path):
    log = AuditLog(spark, str(tmp_path / "audit"))
    assert log.stats().first().asDict() == {"datasets": 0, "queries": 0, "reports": 0}
    df = spark.range(5)
    log.log_dataset("a", df)
    log.log_dataset("b", df)
    log.log_query("a", "top 5 brands", "ok")
    log.log_report("a", "csv")
    assert log.stats().first().asDict() == {"datasets": 2, "queries": 1, "reports": 1}
    assert log.recent_datasets(1).count() == 1 and log.recent_queries().first()["question"] == "top 5 brands"


def test_a_compacted_log_holds_the_same_rows_in_few_files(spark, tmp_path):
    log, other = AuditLog(spark, str(tmp_path / "audit")), AuditLog(spark, str(tmp_path / "audit"))
    assert log.compact("reports") and log.vacuum("reports") == 0 and log.read("reports").count() == 0
    for i in range(4):
        log.log_report("a", f"type {i}", at=f"2024-01-0{i + 1}T00:00:00")
    before = sorted(map(tuple, log.read("reports").collect()))
    planned = log.read("reports")
    assert log.compact("reports")
    assert len(log.read("reports").inputFiles()) == 1 and sorted(map(tuple, log.read("reports").collect())) == before
    assert sorted(map(tuple, planned.collect())) == before  # the old folders are still there
    other.log_report("b", "later", at="2024-02-01T00:00:00")
    assert log.read("reports").count() == 5 and log.stats().first()["reports"] == 5
    assert log.vacuum("reports") == 4 and log.read("reports").count() == 5
    assert log.compact("reports") and log.vacuum("reports") == 2  # a base, an appended folder
    for i in range(2):  # replaced folders that are still there do not come back
        log.log_report("b", f"more {i}")
        assert log.compact("reports")
    assert log.read("reports").count() == 7 and len(log.read("reports").inputFiles()) == 1


def test_rows_appended_during_a_compaction_stay_and_one_of_two_compactions_loses(spark, tmp_path, monkeypatch):
    log, other = AuditLog(spark, str(tmp_path / "audit")), AuditLog(spark, str(tmp_path / "audit"))
    for i in range(3):
        log.log_report("a", f"type {i}")
    scan = log._scan

    def meanwhile(table, folders):
        rows = scan(table, folders)
        other.log_report("b", "meanwhile")
        assert other.compact("reports")
        return rows

    monkeypatch.setattr(log, "_scan", meanwhile)
    assert not log.compact("reports")
    monkeypatch.undo()
    assert sorted(r["report_type"] for r in log.read("reports").collect()) == ["meanwhile", "type 0", "type 1", "type 2"]
    assert len(log.read("reports").inputFiles()) == 1


def test_report_tables_written(spark, sf, tmp_path):
    d = V.dirty_view(spark, sf)
    t = report_tables(d, 1000, order_by=["OrderID", "LineNo"])
    paths = write_report(t, str(tmp_path / "report"))
    assert set(paths) == {"data_sample", "statistics", "insights", "schema"}
    assert spark.read.parquet(paths["data_sample"]).count() == 1000


def test_a12_model_roundtrip(spark, tmp_path):
    from pyspark.ml import Pipeline
    from pyspark.sql import functions as F
    from ledgerlens.operators import ml as ML
    df = spark.range(200).select(F.col("id").cast("double").alias("x"),
                                 F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("g"),
                                 (F.col("id") * 2.0 + 1).alias("label"))
    stages, _, prep = ML.preprocessor(df, ["x", "g"])
    model = Pipeline(stages=stages + [ML.candidates("regression")["Linear Regression"]]).fit(prep)
    path = str(tmp_path / "best")
    ML.save_model(model, path)
    ML.save_model(model, path)  # overwrites
    again = ML.load_model(path)
    a = [r[0] for r in model.transform(prep).orderBy("x").select("prediction").collect()]
    b = [r[0] for r in again.transform(prep).orderBy("x").select("prediction").collect()]
    assert a == b


def test_date_formats_are_chosen_by_the_whole_column(spark):
    from ledgerlens.sources import tables as TB
    names = ["us_date", "eu_date", "both_date", "mixed_date", "iso_time", "empty_date", "bad_date", "amount"]
    rows = [("1/31/2024", "31/1/2024", "1/2/2024", "31.1.2024", " 2024-01-31 10:20:30", None, "2024-02-30", "1/1/2024"),
            ("12/1/2024", " 3/4/2024 ", "3/4/2024", "31/1/2024", "2024-02-01", None, "2024-01-01", "1/1/2024"), (None,) * 8]
    df = spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names))
    got = {r["column"]: (r["non_null"], r["format"]) for r in TB.date_format_table(df).collect()}
    assert got == {"us_date": (2, "M/d/yyyy"), "eu_date": (2, "d/M/yyyy"), "both_date": (2, "M/d/yyyy"), "mixed_date": (2, None),
                   "iso_time": (2, "ISO"), "empty_date": (0, "ISO"), "bad_date": (2, None)}
    out = TB.coerce_date_columns(df)
    assert [f.dataType.simpleString() for f in out.schema.fields] == ["timestamp_ntz"] * 3 + ["string", "timestamp_ntz", "timestamp_ntz", "string", "string"]
    first = out.first()
    assert (first["us_date"].month, first["us_date"].day) == (1, 31) == (first["eu_date"].month, first["eu_date"].day)
    assert first["both_date"].month == 1 and first["iso_time"].hour == 10 and first["bad_date"] == "2024-02-30"
    assert TB.coerce_date_columns(df.limit(0)).count() == 0

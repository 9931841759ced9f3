"""Report tables written as files under one folder (re-aimed from a workbook)."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import strip_html
from ..operators.insights import insights as insight_table
from ..operators.profile import column_profile, describe_numeric, preview


def report_tables(df: DataFrame, sample_rows: int = 1000, order_by=None, ins: DataFrame | None = None) -> dict:
    """Data Sample (first 1000 rows in a stated order), Statistics, Insights, Schema."""
    order = list(order_by) if order_by else df.columns
    sample = df.orderBy(*[F.col(c).asc_nulls_first() for c in order]).limit(sample_rows)
    ins = ins if ins is not None else insight_table(df)
    return {
        "data_sample": sample,
        "statistics": describe_numeric(df),
        "insights": ins.select(strip_html(F.col("text")).alias("insight"), F.col("kind").alias("severity")),
        "schema": column_profile(df).select("column", "dtype", "nulls", "n_unique"),
    }


def write_report(tables: dict, out_dir: str, fmt: str = "parquet") -> dict:
    """Write every table under ``out_dir/<name>``; returns name -> path."""
    paths = {}
    for name, t in tables.items():
        path = f"{out_dir.rstrip('/')}/{name}"
        w = t.repartition(1).write.mode("overwrite")
        (w.option("header", True).csv(path) if fmt == "csv" else w.parquet(path))
        paths[name] = path
    return paths


__all__ = ["report_tables", "write_report", "preview"]

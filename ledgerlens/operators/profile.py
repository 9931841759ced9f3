"""Typed profile of a table: schema table, overview, size, preview, describe."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._cols import q
from ..functions.aggs import is_missing, distinct_counts, modes, one_row, per_column_rows
from ..functions.ranking import quantiles
from ..functions.scalars import human_readable_size
from ..functions.schema import (CATEGORICAL_MAX_UNIQUE, categorical_columns, datetime_columns,
                                numeric_columns, text_columns)
from .quality import _stack, duplicate_count, missing_total


def column_profile(df: DataFrame) -> DataFrame:
    """(column, dtype, non_null, nulls, n_unique) in table order.

    Counts are one aggregate; distinct values are one grouping by (column,
    digest of the value), collapsed map-side, so no row is expanded into a row of every column.
    """
    cols = df.columns
    aggs = [F.count(F.lit(1)).alias("_rows")] + [F.count_if(~is_missing(df, c)).alias(f"_nn{i}") for i, c in enumerate(cols)]
    counts = _stack(df.agg(*aggs), cols, ["_nn{i}", "_rows"], ["non_null", "rows"])
    # xxhash64 normalises NaN and -0.0, so equal values have equal digests
    cells = df.select(F.explode(F.array(*[F.when(~is_missing(df, c), F.struct(
        F.lit(c).alias("column"), F.xxhash64(F.lit(1), F.col(q(c))).alias("h1"), F.xxhash64(F.lit(2), F.col(q(c))).alias("h2"))) for c in cols])).alias("x"))
    uniques = cells.where("x is not null").select("x.*").distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))
    out = counts.join(uniques, "column", "left").withColumn("n_unique", F.coalesce("n_unique", F.lit(0)))
    types = df.sparkSession.createDataFrame(
        [(i, c, df.schema[c].dataType.simpleString()) for i, c in enumerate(cols)],
        "position int, column string, dtype string")
    return (out.join(F.broadcast(types), "column")
            .select("position", "column", "dtype", F.col("non_null").cast("bigint").alias("non_null"),
                    (F.col("rows") - F.col("non_null")).cast("bigint").alias("nulls"),
                    F.col("n_unique").cast("bigint").alias("n_unique")))


def overview(df: DataFrame, max_unique: int = CATEGORICAL_MAX_UNIQUE) -> DataFrame:
    """One row of rows, columns, family counts, missing cells and duplicate rows."""
    one = df.agg(F.count(F.lit(1)).alias("rows")).withColumn("n_categorical", F.lit(len(categorical_columns(df, max_unique))))
    return one.select(
        F.col("rows").cast("bigint").alias("rows"), F.lit(len(df.columns)).cast("bigint").alias("columns"),
        F.lit(len(numeric_columns(df))).cast("bigint").alias("n_numeric"),
        F.col("n_categorical").cast("bigint").alias("n_categorical"),
        F.lit(len(datetime_columns(df))).cast("bigint").alias("n_datetime"),
        one_row(missing_total(df))["missing_total"].alias("missing"),
        one_row(duplicate_count(df))["duplicates"].alias("duplicates"))


_FIXED_WIDTH = ((T.ByteType, 1), (T.BooleanType, 1), (T.ShortType, 2), (T.IntegerType, 4),
                (T.FloatType, 4), (T.DateType, 8), (T.LongType, 8), (T.DoubleType, 8),
                (T.TimestampType, 8), (T.TimestampNTZType, 8), (T.DecimalType, 16))


def _cell_bytes(dt, c):
    col = F.col(q(c))
    if isinstance(dt, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0))
    for t, w in _FIXED_WIDTH:
        if isinstance(dt, t):
            return F.when(col.isNotNull(), F.lit(w)).otherwise(F.lit(0))
    return F.coalesce(F.octet_length(F.to_json(F.struct(col))), F.lit(0))


def table_bytes(df: DataFrame) -> DataFrame:
    """B7 (re-aimed): deterministic data size = UTF-8 bytes of text + fixed width per typed cell."""
    total = sum((F.sum(_cell_bytes(f.dataType, f.name)) for f in df.schema.fields), F.lit(0))
    one = df.agg(total.cast("bigint").alias("bytes"))
    return one.select("bytes", human_readable_size("bytes").alias("size"))


def preview(df: DataFrame, n: int = 10, order_by=None) -> DataFrame:
    """First n rows (5 <= n <= 100) in a stated order; a bare limit is not repeatable."""
    n = max(5, min(100, int(n)))
    order = list(order_by) if order_by else df.columns
    return df.orderBy(*[F.col(q(c)).asc_nulls_first() for c in order]).limit(n)


def context_summary(df: DataFrame) -> DataFrame:
    """(column, count, unique, top) for every column; unique/top only for text columns."""
    texts = text_columns(df)
    cnt = df.agg(*[F.count_if(~is_missing(df, c)).alias(f"_c{i}") for i, c in enumerate(df.columns)])
    counts = _stack(cnt, df.columns, ["_c{i}"], ["count"])
    pos = df.sparkSession.createDataFrame([(i, c) for i, c in enumerate(df.columns)], "position int, column string")
    out = counts.join(F.broadcast(pos), "column")
    if texts:
        md = modes(df, texts).join(distinct_counts(df, texts), "column").select("column", F.col("n_unique").alias("unique"), F.col("mode").alias("top"))
        out = out.join(md, "column", "left")
    else:
        out = out.withColumn("unique", F.lit(None).cast("bigint")).withColumn("top", F.lit(None).cast("string"))
    return out.select("position", "column", F.col("count").cast("bigint").alias("count"),
                      F.col("unique").cast("bigint").alias("unique"), "top")


def describe_numeric(df: DataFrame, columns=None) -> DataFrame:
    """Count, mean, std (sample), min, 25/50/75 %, max; one row per numeric column."""
    cols = list(columns) if columns is not None else numeric_columns(df)
    def aggs(i, c):
        x = F.nanvl(F.col(q(c)).cast("double"), F.lit(None).cast("double"))
        return [F.count(x).alias(f"_n{i}"), F.avg(x).alias(f"_m{i}"), F.stddev_samp(x).alias(f"_s{i}"),
                F.min(x).alias(f"_lo{i}"), F.max(x).alias(f"_hi{i}")]
    moments = per_column_rows(df, cols, aggs,
                              lambda i, c: [F.lit(c)] + [F.col(f"{p}{i}") for p in ("_n", "_m", "_s", "_lo", "_hi")],
                              ["column", "count", "mean", "std", "min", "max"])
    qs = quantiles(df, cols, [0.25, 0.5, 0.75]).select("column", F.col("q0").alias("q25"),
                                                      F.col("q1").alias("q50"), F.col("q2").alias("q75"))
    return (moments.join(qs, "column", "left")
            .select("column", F.col("count").cast("bigint").alias("count"), "mean", "std", "min",
                    "q25", "q50", "q75", "max"))


def categorical_overview(df: DataFrame, max_unique: int = CATEGORICAL_MAX_UNIQUE) -> DataFrame:
    """(column, unique, top, top_freq) for text columns with <= max_unique values.

    Ties for the top value go to the smallest value.
    """
    texts = categorical_columns(df, max_unique)  # values of columns with more are never shuffled
    if not texts:
        return df.sparkSession.createDataFrame([], "column string, unique bigint, top string, top_freq bigint")
    md = modes(df, texts, few=True).join(distinct_counts(df, texts), "column")
    return md.select("column", F.col("n_unique").cast("bigint").alias("unique"), F.col("mode").alias("top"),
                     F.col("mode_count").cast("bigint").alias("top_freq"))

"""Data-quality scan and repair (missing values, duplicates, IQR outliers)."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions._cols import q
from ..functions.aggs import is_missing, modes, one_row, per_column_rows, rows_of
from ..functions.ranking import quantiles
from ..functions.scalars import clip
from ..session import stored
from ..functions.schema import numeric_columns

IQR_K = 1.5


def _stack(one: DataFrame, names, value_cols, out_cols) -> DataFrame:
    """Unpivot a one-row aggregate: one output row per name (a single Generate)."""
    rows = [[F.lit(n)] + [F.col(v.format(i=i)) for v in value_cols] for i, n in enumerate(names)]
    return rows_of(one, rows, ["column", *out_cols])


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing) for every column, in one aggregate."""
    out = per_column_rows(
        df, df.columns,
        lambda i, c: [F.count(F.lit(1)).alias(f"_r{i}"), F.count_if(is_missing(df, c)).alias(f"_m{i}")],
        lambda i, c: [F.lit(c), F.col(f"_m{i}"), F.col(f"_r{i}")], ["column", "missing", "rows"])
    return out.select("column", F.col("missing").cast("bigint").alias("missing"), F.col("rows").cast("bigint").alias("rows"))


def missing_table(df: DataFrame) -> DataFrame:
    """Columns with missing values and their share in %, 2 decimals."""
    m = missing_counts(df).where(F.col("missing") > 0)
    return m.select("column", "missing",
                    F.round(F.col("missing") * 100.0 / F.col("rows"), 2).alias("pct_missing"))


def missing_total(df: DataFrame) -> DataFrame:
    """D3 + D4: missing cells and their share of all cells (%)."""
    cols = df.columns
    one = df.agg(F.count(F.lit(1)).alias("rows"),
                 sum((F.count_if(is_missing(df, c)) for c in cols), F.lit(0)).alias("missing_total"))
    cells = F.col("rows") * F.lit(len(cols))
    return one.select(F.col("missing_total").cast("bigint").alias("missing_total"),
                      F.coalesce(F.try_divide(F.col("missing_total") * 100.0, cells), F.lit(0.0)).alias("missing_pct"))


def _row_digest(df: DataFrame) -> list:
    cols = [F.col(q(c)) for c in df.columns]
    # xxhash64 skips NULLs, so the mask of NULLs is hashed with the values
    mask = F.concat(*[F.when(c.isNull(), "1").otherwise("0") for c in cols]) if cols else F.lit("")
    return [F.xxhash64(F.lit(1), mask, *cols).alias("_h1"), F.xxhash64(F.lit(2), *cols, mask).alias("_h2")]


def duplicate_count(df: DataFrame) -> DataFrame:
    """Rows equal to an earlier row (NULLs equal each other), one row ``duplicates``.

    Only a 128-bit digest of each row (two hashes of different seeds and null marks) is
    grouped and shuffled; partial counts collapse a row that repeats a billion times
    to one entry a task. The digest counts as the row: two different rows among
    10^12 share one with a probability of about 10^-15.
    """
    groups = df.select(*_row_digest(df)).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"))
    return groups.agg(F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))


def empty_columns(df: DataFrame) -> DataFrame:
    """(column) for columns holding no value at all."""
    return missing_counts(df).where(F.col("missing") == F.col("rows")).select("column")


def _fences_from(qs: DataFrame, keep_zero_iqr: bool) -> DataFrame:
    out = qs.select("column", F.col("q0").alias("q1"), F.col("q1").alias("q3"))
    out = out.withColumn("iqr", F.col("q3") - F.col("q1"))
    out = out.withColumn("lower", F.col("q1") - IQR_K * F.col("iqr")).withColumn("upper", F.col("q3") + IQR_K * F.col("iqr"))
    return out if keep_zero_iqr else out.where(F.col("iqr") != 0)


def iqr_fences(df: DataFrame, columns=None, keep_zero_iqr: bool = False) -> DataFrame:
    """(column, q1, q3, iqr, lower, upper) per numeric column.

    All-missing columns have no row; columns with iqr = 0 are skipped unless
    ``keep_zero_iqr``. Quartiles are exact (see ranking.py).
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, q1 double, q3 double, iqr double, lower double, upper double")
    return _fences_from(quantiles(df, cols, [0.25, 0.75]), keep_zero_iqr)


def _fence_row(fences: DataFrame, columns):
    """lower<i> and upper<i> of every column as one struct-typed scalar subquery."""
    return one_row(fences.agg(*[F.max(F.when(F.col("column") == c, F.col(b))).alias(f"{b}{i}")
                                for i, c in enumerate(columns) for b in ("lower", "upper")]))


def outlier_counts(df: DataFrame, columns=None, fences: DataFrame | None = None) -> DataFrame:
    """(column, outliers) for columns with at least one value outside its fence.

    The fences enter one aggregate over the source as a scalar subquery, so
    nothing but counts is shuffled.
    """
    cols = list(columns) if columns is not None else numeric_columns(df)
    if not cols:
        return df.sparkSession.createDataFrame([], "column string, outliers bigint")
    # named once, so that the subquery is planned once for all columns
    fence = _fence_row(iqr_fences(df, cols) if fences is None else fences, cols).alias("_f")
    fenced = df.select(*[F.nanvl(F.col(q(c)).cast("double"), F.lit(None).cast("double")).alias(f"_x{i}") for i, c in enumerate(cols)], fence)

    def count(i, c):
        x = F.col(f"_x{i}")
        return [F.count_if((x < F.col(f"_f.lower{i}")) | (x > F.col(f"_f.upper{i}"))).alias(f"_o{i}")]

    out = per_column_rows(fenced, cols, count, lambda i, c: [F.lit(c), F.col(f"_o{i}")], ["column", "outliers"])
    return out.where("outliers > 0").select("column", F.col("outliers").cast("bigint").alias("outliers"))


def outliers_total(counts: DataFrame) -> DataFrame:
    return counts.agg(F.coalesce(F.sum("outliers"), F.lit(0)).cast("bigint").alias("outliers_total"))


def drop_empty_columns(df: DataFrame) -> DataFrame:
    """Drop all-missing columns (reads the D6 list: the schema changes)."""
    empty = [r["column"] for r in empty_columns(df).collect()]
    return df.drop(*empty) if empty else df


def drop_missing_rows(df: DataFrame) -> DataFrame:
    """Drop rows with any missing value (NaN included)."""
    cond = F.lit(True)
    for c in df.columns:
        cond = cond & ~is_missing(df, c)
    return df.where(cond)


def _integral(dt) -> bool:
    return isinstance(dt, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))


def fill_missing(df: DataFrame, strategy: str = "mean") -> DataFrame:
    """Fill missing values.

    Numeric columns use ``strategy`` (mean / median / mode / zero); other
    columns always use their mode, 'Unknown' when they hold no value. A
    numeric mode of an all-missing column is 0; mean/median of one stays
    missing. Integer columns filled by mean or median become double.
    """
    # only columns that have gaps are filled: their list (one small row) shapes the plan
    gaps = {r["column"] for r in missing_counts(df).where(F.col("missing") > 0).collect()}
    nums = [c for c in numeric_columns(df) if c in gaps]
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name in gaps]
    const = None
    if nums and strategy == "mean":
        const = df.agg(*[F.avg(F.nanvl(F.col(q(c)).cast("double"), F.lit(None).cast("double"))).alias(f"s{i}")
                         for i, c in enumerate(nums)])
    elif nums and strategy in ("median", "mode"):
        per_col = quantiles(df, nums, [0.5]).withColumnRenamed("q0", "v") if strategy == "median" \
            else modes(df, nums, "double").withColumnRenamed("mode", "v")
        const = per_col.agg(*[F.max(F.when(F.col("column") == c, F.col("v"))).alias(f"s{i}")
                              for i, c in enumerate(nums)])
    filled = df if const is None else df.select("*", one_row(const).alias("_fills"))
    if texts:
        tm = modes(df, texts, "string")
        filled = filled.select("*", one_row(tm.agg(*[F.max(F.when(F.col("column") == c, F.col("mode"))).alias(f"t{i}")
                                                     for i, c in enumerate(texts)])).alias("_modes"))
    out = []
    for f in df.schema.fields:
        c, col = f.name, F.col(q(f.name))
        missing = is_missing(df, c)
        if c in nums:
            if strategy == "zero":
                fill = F.lit(0).cast(f.dataType)
                out.append(F.when(missing, fill).otherwise(col).alias(c))
                continue
            v = F.col(f"_fills.s{nums.index(c)}")
            if strategy == "mode":
                v = F.coalesce(v, F.lit(0.0))
            if _integral(f.dataType) and strategy in ("mean", "median"):
                out.append(F.when(missing, v).otherwise(col.cast("double")).alias(c))
            else:
                out.append(F.when(missing, v.cast(f.dataType)).otherwise(col).alias(c))
        elif c in texts:
            v = F.coalesce(F.col(f"_modes.t{texts.index(c)}"), F.lit("Unknown"))
            out.append(F.when(missing, v).otherwise(col).alias(c))
        else:
            out.append(col)
    return filled.select(*out)


def drop_duplicates(df: DataFrame) -> DataFrame:
    """Keep one of each set of equal rows."""
    return df.dropDuplicates()


def winsorise(df: DataFrame, columns) -> DataFrame:
    """Clip chosen columns to their IQR fences computed on ``df`` itself.

    Deviation: a column whose iqr is 0 is left as it is (no collapse to one value).
    """
    columns = [c for c in columns if c in df.columns]
    if not columns:
        return df
    fenced = df.select("*", _fence_row(iqr_fences(df, columns), columns).alias("_fence"))
    out = []
    for c in df.columns:
        if c in columns:
            i = columns.index(c)
            lo, hi = F.col(f"_fence.lower{i}"), F.col(f"_fence.upper{i}")
            x = F.col(q(c))
            clipped = F.when(lo.isNull(), x).otherwise(clip(x, lo, hi))
            out.append(clipped.cast(df.schema[c].dataType).alias(c))
        else:
            out.append(F.col(q(c)))
    return fenced.select(*out)


@dataclass
class CleanSpec:
    """What :func:`clean` does, in its fixed order."""
    drop_empty: bool = False
    missing_action: str = "none"  # none | drop | mean | median | mode | zero
    drop_duplicates: bool = False
    winsorise: list = field(default_factory=list)

    @classmethod
    def from_issues(cls, duplicates: int, empty: list, outlier_columns: list) -> "CleanSpec":
        """De-duplicate if there are duplicates, drop empty columns if any, winsorise every outlier column."""
        return cls(drop_empty=bool(empty), drop_duplicates=duplicates > 0, winsorise=list(outlier_columns))


def clean(df: DataFrame, spec: CleanSpec) -> DataFrame:
    """Drop empty columns -> missing action -> de-duplicate -> winsorise.

    The source is not copied: fill values are aggregates over it that enter one
    projection. Only when rows were de-duplicated before winsorising is the
    (shuffled) result written once as Parquet, since fences and clipping both read it.
    """
    out = drop_empty_columns(df) if spec.drop_empty else df
    if spec.missing_action == "drop":
        out = drop_missing_rows(out)
    elif spec.missing_action in ("mean", "median", "mode", "zero"):
        out = fill_missing(out, spec.missing_action)
    if spec.drop_duplicates:
        out = drop_duplicates(out)
    if spec.winsorise:
        out = winsorise(stored(out, "deduplicated") if spec.drop_duplicates else out, spec.winsorise)
    return out


def quality_summary(df: DataFrame) -> DataFrame:
    """One row: rows, missing cells, duplicate rows (see :func:`duplicate_count`), from one pass over the table."""
    missing = sum((is_missing(df, c).cast("int") for c in df.columns), F.lit(0))
    groups = df.select(*_row_digest(df), missing.alias("_m")).groupBy("_h1", "_h2").agg(F.count(F.lit(1)).alias("_n"), F.sum("_m").alias("_m"))
    totals = {"rows": F.sum("_n"), "missing": F.sum("_m"), "duplicates": F.sum(F.col("_n") - 1)}
    return groups.agg(*[F.coalesce(v, F.lit(0)).cast("bigint").alias(k) for k, v in totals.items()])


def before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """(metric, before, after, delta) for rows, missing and duplicates; each table is read once."""
    both = quality_summary(after).select("*", one_row(quality_summary(before)).alias("b"))
    metrics = ("rows", "missing", "duplicates")
    out = rows_of(both, [[F.lit(m), F.col(f"b.{m}"), F.col(m)] for m in metrics], ["metric", "before", "after"])
    return out.withColumn("delta", F.col("after") - F.col("before"))


def detect_issues(df: DataFrame) -> dict:
    """The scan as a dict of small DataFrames (each a lazy plan)."""
    oc = outlier_counts(df)
    fences = iqr_fences(df)
    return {"missing": missing_counts(df), "missing_total": missing_total(df),
            "duplicates": duplicate_count(df), "empty_columns": empty_columns(df),
            "fences": fences, "outliers": oc, "outliers_total": outliers_total(oc)}

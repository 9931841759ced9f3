"""Shared aggregate building blocks: missing masks, modes, one-row constants."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._cols import q


def is_missing(df: DataFrame, c: str) -> Column:
    """NULL, or NaN for floating columns (one notion of missing)."""
    col = F.col(q(c))
    if isinstance(df.schema[c].dataType, (T.FloatType, T.DoubleType)):
        return col.isNull() | F.isnan(col)
    return col.isNull()


def one_row(df: DataFrame) -> Column:
    """A one-row DataFrame as a struct-typed scalar subquery.

    Field access on the returned Column reads the constants inside any
    expression; Spark evaluates the subquery once and reuses it, so no join
    and no driver round-trip is needed.
    """
    return df.select(F.struct(*[F.col(q(c)) for c in df.columns])).scalar()


def value_counts_long(df: DataFrame, columns, as_type: str = "string", keep=None) -> DataFrame:
    """(column, value, cnt) for each column, NULL values excluded.

    One shuffle on (column, value); map-side partial counts collapse hot values. With ``keep``, only the
    values for which ``keep(position, value)`` holds are counted.
    """
    def value(i, c):
        v = _typed(c, as_type)
        return F.when(keep(i, v), v) if keep else v

    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), value(i, c).alias("value"))
                             for i, c in enumerate(columns)])).alias("kv")
    long = df.select(kv).select("kv.column", "kv.value")
    return long.where(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("cnt"))


def _typed(c: str, as_type: str) -> Column:
    """The column's values as text, or as doubles where NaN is missing and the two zeros are one."""
    v = F.col(q(c)).cast(as_type)
    return F.nanvl(v, F.lit(None).cast("double")) + F.lit(0.0) if as_type == "double" else v


# Values that the sketch of a column tracks, and the most frequent of them that it reports.
SKETCH_ITEMS, SKETCH_TOP = 10_000, 64


def frequent_candidates(df: DataFrame, columns, as_type: str = "string", items: int = SKETCH_ITEMS, top: int = SKETCH_TOP) -> DataFrame:
    """One row: for column i an array ``c{i}`` that holds every value of the highest count, or NULL where the sketch can't tell.

    One pass with a mergeable sketch of frequent items. Of n values (NULLs included) its estimates are
    too high by at most e = 3.5 n / items, never too low; a value that it doesn't report occurs at most 2 e times, or, where
    ``top`` values are reported, no more often than the last estimate. The best value occurs at least as
    often as its estimate less e: when that is above both bounds, the winners are among the reported
    values whose estimates reach it.
    """
    typed = df.select(*[_typed(c, as_type).alias(f"v{i}") for i, c in enumerate(columns)])
    one = typed.agg(F.count(F.lit(1)).alias("n"), *[F.expr(f"approx_top_k(v{i}, {top}, {items})").alias(f"t{i}") for i in range(len(columns))])
    error = F.lit(3.5 / items) * F.col("n")

    def winners(i):
        found = F.col(f"t{i}")
        held = F.filter(found, lambda x: x["item"].isNotNull())
        least = F.array_max(F.transform(held, lambda x: x["count"])) - error
        cut = F.when(F.size(found) >= top, F.array_min(F.transform(found, lambda x: x["count"]))).otherwise(F.lit(0))
        near = F.transform(F.filter(held, lambda x: x["count"] >= least), lambda x: x["item"])
        return F.when(least > F.greatest(2 * error, cut), near).alias(f"c{i}")

    return one.select(*[winners(i) for i in range(len(columns))])


def modes(df: DataFrame, columns, as_type: str = "string", few: bool = False) -> DataFrame:
    """(column, mode, mode_count): most frequent value, smallest on ties (R5); columns without values give no row.

    A sketch names the few values that can be the mode, and only these are counted; a column
    whose values are so even that the sketch can't tell has all of them counted, as have all columns where the
    caller knows them to hold ``few`` values. No group's values are gathered in one place, and the
    result is exact either way.
    """
    columns, keep = list(columns), None
    if not few:
        named = one_row(frequent_candidates(df, columns, as_type))
        keep = lambda i, v: F.coalesce(F.array_contains(named[f"c{i}"], v), F.lit(True))
    vc = value_counts_long(df, columns, as_type, keep)
    top = vc.groupBy("column").agg(F.max("cnt").alias("mode_count"))
    best = (vc.join(top, "column").where(F.col("cnt") == F.col("mode_count"))
            .groupBy("column").agg(F.min("value").alias("mode")))
    return top.join(best, "column").select("column", "mode", "mode_count")


def distinct_counts(df: DataFrame, columns, as_type: str = "string") -> DataFrame:
    """(column, n_unique) of the columns that have values; digests of 128 bits are shuffled, never the values."""
    def digest(c):
        v = _typed(c, as_type)
        return F.when(v.isNotNull(), F.struct(F.xxhash64(v).alias("a"), F.xxhash64(v, F.lit(1)).alias("b")))

    kv = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), digest(c).alias("d")) for c in columns])).alias("kv")
    long = df.select(kv).select("kv.column", "kv.d").where(F.col("d").isNotNull())
    return long.distinct().groupBy("column").agg(F.count(F.lit(1)).alias("n_unique"))


def rows_of(one: DataFrame, rows, names) -> DataFrame:
    """Turn a one-row aggregate into several rows with one Generate (no union of copies).

    ``rows`` is a list of rows, each a list of Columns (over ``one``) matching ``names``.
    """
    structs = [F.struct(*[c.alias(n) for c, n in zip(r, names)]) for r in rows]
    return one.select(F.explode(F.array(*structs)).alias("_r")).select(*[F.col(f"_r.{q(n)}").alias(n) for n in names])


def per_column_rows(df: DataFrame, columns, make_aggs, make_row, names) -> DataFrame:
    """One output row per column from one global aggregate, so one scan however many columns there are.

    ``make_aggs(i, c)`` returns the aliased aggregates of column ``c`` (position
    ``i``); ``make_row(i, c)`` returns the output row's Columns over them.
    """
    columns = list(enumerate(columns))
    one = df.agg(*[a for i, c in columns for a in make_aggs(i, c)])
    return rows_of(one, [make_row(i, c) for i, c in columns], names)

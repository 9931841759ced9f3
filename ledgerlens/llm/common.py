"""Arrow helpers shared by the training-data operators."""
from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..session import stored

# Python tasks work on slices of at most this many text bytes (one longer text is a slice of its own).
SLICE_BYTES = 4 << 20
# A-Z to a-z, every other byte unchanged.
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def utf8(column) -> list[bytes | None]:
    """A string column as UTF-8 bytes; null stays None."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return pc.cast(column, kind).to_pylist()


def slices(batches: Iterator[pa.RecordBatch], text: str, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """Cut Arrow batches by the size of their texts, or of their lists (``most`` items)."""
    most = SLICE_BYTES if most is None else most
    for b in batches:
        column = b.column(text)
        listed = pa.types.is_list(column.type) or pa.types.is_large_list(column.type)
        sizes = pc.fill_null(pc.list_value_length(column) if listed else pc.binary_length(column), 0).to_pylist()
        start, held = 0, 0
        for i, n in enumerate(sizes):
            if held and held + n > most:
                yield b.slice(start, i - start)
                start, held = i, 0
            held += n
        if start < len(sizes):
            yield b.slice(start)


def append_columns(df: DataFrame, text: str, added: str, fn: Callable[[list], list], keep: list[str] | None = None,
                   setup: Callable | None = None) -> DataFrame:
    """Add columns computed from a text column in Arrow batches.

    ``fn(texts, *setup())`` gets the texts of a slice as bytes (None: null)
    and returns one list or array per column of the DDL string ``added``; an
    input column of the same name is replaced. ``keep`` names the input
    columns of the result (all by default). ``setup`` runs once a task.
    """
    new = T.StructType.fromDDL(added)
    names = {f.name.lower() for f in new.fields}
    kept = [c for c in (df.columns if keep is None else keep) if c.lower() not in names]
    # inside, columns go by their position, so no name of the input can clash with another
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(f"`{text}`").cast("string").alias("text_in"))
    schema = T.StructType(source.schema.fields[:-1] + new.fields)
    arrow = to_arrow_schema(new)

    def run(batches):
        args = setup() if setup else ()
        for b in slices(batches, "text_in"):
            cols = fn(utf8(b.column("text_in")), *args)
            added_cols = [c if isinstance(c, pa.Array) else pa.array(c, type=f.type) for c, f in zip(cols, arrow)]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + added_cols,
                                             names=[f"c{i}" for i in range(len(kept))] + [f.name for f in arrow])

    return source.mapInArrow(run, schema).toDF(*kept, *new.names)


def ragged(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Indexes starts[i], starts[i] + 1, ... of sizes[i] items each, one after another."""
    ends = np.cumsum(sizes)
    out = np.arange(ends[-1] if len(ends) else 0, dtype=np.int64)
    return out + np.repeat(starts - (ends - sizes), sizes)


def id_crc(column: Column) -> Column:
    """crc32 of an id written as text (the fold rule of the contracts)."""
    return F.crc32(column.cast("string").cast("binary"))


def crc_of_id(value) -> int:
    return zlib.crc32(str(value).encode())


def text_window(text: Column, chars: int) -> Column:
    """The text, or of one with more than ``chars`` characters a stretch of that length at a place drawn from its hash."""
    room = F.greatest(F.length(text) - chars + 1, F.lit(1))
    return F.when(F.length(text) <= chars, text).otherwise(F.substring(text, F.pmod(F.xxhash64(text), room).cast("int") + 1, F.lit(chars)))


def numbered(rows: DataFrame, order: list[str], name: str) -> DataFrame:
    """Rows with their number ``g`` from 0 in the order given, and the partition ``part`` that holds them.

    Range partitions are sorted side by side and written; one count a partition gives their offsets.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    placed = stored(placed, name).withColumn("part", F.shiftright("at", 33))
    totals = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"))  # one row a partition
    before = F.coalesce(F.sum("rows").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = totals.select("part", before.alias("before"))
    return placed.join(F.broadcast(totals), "part").withColumn("g", F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))


def numbered_groups(rows: DataFrame, order: list[str], name: str, **sums: Column) -> tuple[DataFrame, DataFrame]:
    """Rows numbered in the order given, whose first column is their group, and one row per group.

    Rows gain ``tree`` (number of the group's first row, which names the group), ``pos`` (their place in the group),
    ``n`` (rows of the group) and the ``sums`` over the group. A group meets the rows of one partition
    at a time, so a group that holds a third of the rows is no hot key. A null group is one group.
    """
    grp = order[0]
    placed = numbered(rows, order, name)
    per = [F.sum(c).alias(k) for k, c in sums.items()]
    spans = stored(placed.groupBy("part", grp).agg(F.min("g").alias("first"), F.count(F.lit(1)).alias("n"), *per), f"{name}-spans")
    groups = stored(spans.groupBy(grp).agg(F.min("first").alias("tree"), F.sum("n").alias("n"), *[F.sum(k).alias(k) for k in sums]), f"{name}-groups")
    carried = ["tree", "n", *sums]
    of_span = (spans.select(F.col("part").alias("span_part"), F.col(grp).alias("span_grp"))
               .join(groups, F.col("span_grp").eqNullSafe(F.col(grp))).select("span_part", "span_grp", *carried))
    out = placed.join(of_span, (F.col("part") == F.col("span_part")) & F.col(grp).eqNullSafe(F.col("span_grp")))
    return out.withColumn("pos", F.col("g") - F.col("tree")).drop("span_part", "span_grp"), groups

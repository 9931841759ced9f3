"""Distributed running sums and exact quantiles, one algorithm for every size.

A running sum over a global order (``Window.orderBy`` without a partition)
would move every row into one task. Instead rows are range-partitioned by (part,
order), each partition is summed, partition offsets are a running sum over
one row per partition and part, and the exact sum inside a partition is a window
of that partition only. The partition count is the session's shuffle setting, so
it grows with the data as that setting does.

Quantiles narrow first: a mergeable sketch brackets every requested rank, then one
pass counts what lies between the brackets and keeps (value, count) only inside
them: at most four sketch errors of the rows per rank, whatever their number.
That remnant is written, and as long as a part of it has more than REMNANT_ROWS rows it is narrowed
again: cut at quantiles of its own distinct values, counted by cell, and kept in the few cells that hold a
requested rank. So no window ever sorts more than that many rows of a part.
Two scans of the source; the rounds read the remnant only.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from ._cols import q

# Relative accuracy 1 / SKETCH_ACCURACY: a sketch's rank error is at most that share of the rows.
SKETCH_ACCURACY = 10000
# Rows of a part that one window may sort.
REMNANT_ROWS = 1 << 17
# Cells of a narrowing round, at least; and for every requested quantile, which needs two of them at most.
CELLS, CELLS_PER_RANK = 64, 16


def _same(a: DataFrame, b: DataFrame, keys) -> Column:
    return reduce(lambda x, y: x & y, [a[q(k)].eqNullSafe(b[q(k)]) for k in keys], F.lit(True))


def cumulative(df: DataFrame, part_cols, order_cols, weight_cols, prefix: str = "cum_") -> DataFrame:
    """Add ``cum_<w>`` (inclusive running sum of each weight, by ascending order) and ``total_<w>`` per part.

    A NULL part is a part of its own. Rows equal in all order columns have no order
    among themselves.
    """
    part_cols, order_cols, weight_cols = list(part_cols), list(order_cols), list(weight_cols)
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(q(c)) for c in [*part_cols, *order_cols]]
    # range bounds come from a sample, so the dealt rows are written once and read by both passes
    x = stored(df.repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id()), "ranges")
    parts = [F.col(q(c)) for c in part_cols]
    sums = x.groupBy(*parts, "_p").agg(*[F.sum(w).alias(f"_s_{w}") for w in weight_cols])
    before = Window.partitionBy(*parts).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*parts)
    offs = sums.select(*[p.alias(f"_k{i}") for i, p in enumerate(parts)], F.col("_p").alias("_kp"),
                       *[F.coalesce(F.sum(f"_s_{w}").over(before), F.lit(0)).alias(f"_off_{w}") for w in weight_cols],
                       *[F.sum(f"_s_{w}").over(whole).alias(f"total_{w}") for w in weight_cols])
    cond = x["_p"] == offs["_kp"]
    for i, c in enumerate(part_cols):
        cond = cond & x[q(c)].eqNullSafe(offs[f"_k{i}"])
    x = x.join(offs, cond)
    inside = Window.partitionBy("_p", *parts).orderBy(*[F.col(q(c)) for c in order_cols]).rowsBetween(Window.unboundedPreceding, 0)
    for w in weight_cols:
        x = x.withColumn(f"{prefix}{w}", F.col(f"_off_{w}") + F.sum(w).over(inside))
    return x.drop("_p", "_kp", *[f"_k{i}" for i in range(len(parts))], *[f"_off_{w}" for w in weight_cols])


def with_next(df: DataFrame, order_cols, value_cols, name: str = "next") -> DataFrame:
    """Add struct ``name``: the ``value_cols`` of the following row in ascending order, NULL for the last row.

    Rows are range-partitioned; inside a partition a window looks ahead, and a partition's last row gets the
    first row of the next one that has rows, from a table of one row a partition. The order
    columns must tell all rows apart.
    """
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(q(c)) for c in order_cols]
    value = F.struct(*[F.col(q(c)) for c in value_cols])
    x = stored(df.repartitionByRange(n, *keys).withColumn("_p", F.spark_partition_id()), "ranges")
    firsts = x.groupBy("_p").agg(F.min_by(value, F.struct(*keys)).alias("_first"))
    edges = firsts.select(F.col("_p").alias("_kp"), F.lead("_first").over(Window.orderBy("_p")).alias("_edge"))
    inside = F.lead(value).over(Window.partitionBy("_p").orderBy(*keys))
    x = x.join(edges, F.col("_p") == F.col("_kp")).withColumn("_inside", inside)
    return x.withColumn(name, F.coalesce("_inside", "_edge")).drop("_p", "_kp", "_inside", "_edge")


def unpivot_numeric(df: DataFrame, columns, group_cols=(), drop_null: bool = True) -> DataFrame:
    """(group..., column, value double) for the given numeric columns; NaN counts as missing."""
    group_cols = list(group_cols)
    # unpivot plans an Expand (code-generated), much cheaper than exploding an array of structs
    tmp = [f"_v{i}" for i in range(len(columns))]
    wide = df.select(*[F.col(q(g)) for g in group_cols],
                     *[F.nanvl(F.col(q(c)).cast("double"), F.lit(None).cast("double")).alias(t) for c, t in zip(columns, tmp)])
    long = wide.unpivot(group_cols, tmp, "_k", "value")
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.substring("_k", 3, 10).cast("int") + 1)
    long = long.select(*group_cols, names.alias("column"), "value")
    return long.where(F.col("value").isNotNull()) if drop_null else long


def quantiles_long(long: DataFrame, part_cols, probs, value_col: str = "value") -> DataFrame:
    """Exact linear-interpolation quantiles per part of a long table: (part..., n, q0, q1, ...).

    Missing values and rows with a NULL part take no part (a NULL group is no group).
    """
    part_cols = list(part_cols)
    if not part_cols:
        return quantiles_long(long.withColumn("_all", F.lit(0)), ["_all"], probs, value_col).drop("_all")
    v = F.col(q(value_col))
    present = reduce(lambda a, b: a & b, [F.col(q(c)).isNotNull() for c in part_cols], v.isNotNull())
    long = long.where(present)
    # brackets two sketch errors wide on either side of every requested rank
    e = 2.0 / SKETCH_ACCURACY
    edges = [x for p in probs for x in (max(0.0, p - e), min(1.0, p + e))]
    brackets = long.groupBy(*[F.col(q(c)) for c in part_cols]).agg(
        F.count(F.lit(1)).alias("_n"), F.percentile_approx(v, edges, SKETCH_ACCURACY).alias("_edges"))
    # schema-bounded parts are small; any other size is left to the join strategy of the optimizer
    x = long.join(F.broadcast(brackets) if part_cols in (["column"], ["_all"]) else brackets, part_cols)
    inside = reduce(lambda a, b: a | b, [(v >= F.col("_edges")[2 * i]) & (v <= F.col("_edges")[2 * i + 1]) for i in range(len(probs))])
    gap = sum(((v > F.col("_edges")[2 * i + 1]).cast("int") for i in range(len(probs))), F.lit(0))
    # values between brackets collapse to one row a gap; ranks next to a bracket may need its smallest or largest value
    keyed = x.groupBy(*[F.col(q(c)) for c in part_cols], "_n", F.when(inside, v).alias("_in"), F.when(~inside, gap).alias("_gap"))
    remnant = keyed.agg(F.count(F.lit(1)).alias("w"), F.min(v).alias("_v"), F.max(v).alias("_top")).drop("_in", "_gap")
    remnant = stored(remnant, "remnant")
    while _largest_part(remnant, part_cols) > REMNANT_ROWS:
        remnant = stored(_narrowed(remnant, part_cols, probs), "remnant")
    running = Window.partitionBy(*[F.col(q(c)) for c in part_cols]).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    return _pick(remnant.withColumn("cum_w", F.sum("w").over(running)), part_cols, probs)


def _largest_part(remnant: DataFrame, part_cols) -> int:
    per_part = remnant.groupBy(*[F.col(q(c)) for c in part_cols]).agg(F.count(F.lit(1)).alias("rows"))
    return per_part.agg(F.max("rows")).first()[0] or 0


def _ranks(probs) -> list[Column]:
    """The ranks from 0 that the interpolated quantiles need."""
    n = F.col("_n")
    below = [F.floor((n - 1) * F.lit(float(p))) for p in probs]
    return [r for b in below for r in (b, F.least(b + 1, n - 1))]


def _narrowed(remnant: DataFrame, part_cols, probs) -> DataFrame:
    """The remnant's rows around the requested ranks; all others collapse to one row a cell.

    Rows (part..., _n, w, _v, _top) stand for w values from _v to _top, none of which
    reaches into another row. The cells' edges are quantiles of the rows of a part, so a cell
    holds an equal share of its rows, whatever their values and weights.
    """
    parts = [F.col(q(c)) for c in part_cols]
    cells = max(CELLS, CELLS_PER_RANK * len(probs))
    edges = remnant.groupBy(*parts).agg(F.percentile_approx("_v", [i / cells for i in range(1, cells)], 20 * cells).alias("_cells"))
    x = remnant.join(edges, part_cols).withColumn("_cell", F.size(F.filter("_cells", lambda edge: edge < F.col("_v")))).drop("_cells")
    counts = x.groupBy(*parts, "_n", "_cell").agg(F.sum("w").alias("w"), F.min("_v").alias("_v"), F.max("_top").alias("_top"))
    # one row a cell and part
    before = F.sum("w").over(Window.partitionBy(*parts).orderBy("_cell").rowsBetween(Window.unboundedPreceding, 0)) - F.col("w")
    counts = counts.withColumn("_first", before)
    holds = reduce(lambda a, b: a | b, [(F.col("_first") <= r) & (r < F.col("_first") + F.col("w")) for r in _ranks(probs)])
    counts = stored(counts.withColumn("_holds", holds), "cells")
    columns = [*parts, F.col("_n"), F.col("w"), F.col("_v"), F.col("_top")]
    kept = x.join(counts.where("_holds").select(*parts, "_cell"), [*part_cols, "_cell"], "left_semi").select(*columns)
    return kept.unionByName(counts.where("not _holds").select(*columns))


def _pick(ranked: DataFrame, part_cols, probs) -> DataFrame:
    """Values at the two ranks around each (n - 1) * p, combined as lo + (hi - lo) * d."""
    n, last = F.col("_n"), F.col("cum_w")
    first = last - F.col("w")

    def value_at(rank: Column) -> Column:
        # of a row that stands for several values the first and the last are known; the sketch's bound keeps ranks out of the rest
        lost = F.raise_error(F.lit("a quantile lies outside its bracket")).cast("double")
        known = (F.when((F.col("_v") == F.col("_top")) | (rank == first), F.col("_v"))
                 .when(rank == last - 1, F.col("_top")).otherwise(lost))
        return F.max(F.when((first <= rank) & (rank < last), known))

    ranks = _ranks(probs)
    aggs = [F.max(n).alias("n")]
    for i, p in enumerate(probs):
        pos = (n - 1) * F.lit(float(p))
        aggs += [value_at(ranks[2 * i]).alias(f"_lo{i}"), value_at(ranks[2 * i + 1]).alias(f"_hi{i}"),
                 F.max(pos - F.floor(pos)).alias(f"_f{i}")]
    picked = ranked.groupBy(*[F.col(q(c)) for c in part_cols]).agg(*aggs)
    outs = []
    for i in range(len(probs)):
        lo, hi, f = F.col(f"_lo{i}"), F.col(f"_hi{i}"), F.col(f"_f{i}")
        outs.append(F.when(f == 0, lo).otherwise(lo + (hi - lo) * f).alias(f"q{i}"))
    return picked.select(*[F.col(q(c)) for c in part_cols], "n", *outs)


def quantiles(df: DataFrame, columns, probs, group_cols=()) -> DataFrame:
    """Exact quantiles of several numeric columns (optionally per group): (group..., column, n, q...)."""
    return quantiles_long(unpivot_numeric(df, columns, group_cols), [*group_cols, "column"], probs)

"""CSV records by many tasks, also where quoted cells hold line breaks.

Whether a byte range of a file starts inside a quoted cell depends on all that comes before it. Every range is
therefore read once under both assumptions: each line carries its state (inside a quoted cell or not) and its
record's number for either. A range is then a function from the state at its start to the state at its end; these
functions are composed along a file, one row a range, and tell which assumption holds where. Lines that are
whole records stay in their tasks; only the pieces of records with line breaks are shuffled, by record.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import stored

LATIN1, UTF8 = "ISO-8859-1", "UTF-8"
_LINES = ("file string, start bigint, line bigint, blank boolean, in0 boolean, out0 boolean, rec0 bigint, "
          "in1 boolean, out1 boolean, rec1 bigint, value binary")


def ends_inside(line: bytes, inside: bool) -> bool:
    """Whether a quoted cell is open after ``line``, given whether one is open before it.

    A quote opens a cell at its very start only; elsewhere in an unquoted cell it is an ordinary
    character. Inside, a doubled quote is one quote, and a single one closes the cell.
    """
    i, n = 0, len(line)
    while True:
        if not inside:
            if i < n and line[i] == 34:
                inside, i = True, i + 1
            else:
                i = line.find(b",", i) + 1
                if not i:
                    return False
                continue
        i = line.find(b'"', i)
        if i < 0:
            return True
        if line[i + 1:i + 2] == b'"':
            i += 2
            continue
        inside = False
        i = line.find(b",", i + 1) + 1
        if not i:
            return False


class _Range:
    """The running states and record numbers of one byte range, for a start outside (0) and inside (1) a quoted cell."""

    def __init__(self):
        self.line, self.state, self.records = 0, [False, True], [0, 0]

    def take(self, values, quoted, blank):
        n = len(blank)
        before = [np.empty(n, bool), np.empty(n, bool)]
        done = 0
        for k in np.flatnonzero(quoted):  # other lines keep the state
            text = values[int(k)].as_py()
            for h in (0, 1):
                before[h][done:k + 1] = self.state[h]
                self.state[h] = ends_inside(text, self.state[h])
            done = k + 1
        columns = [pa.array(np.arange(self.line, self.line + n)), pa.array(blank)]
        for h in (0, 1):
            before[h][done:] = self.state[h]
            after = np.append(before[h][1:], self.state[h])
            number = self.records[h] + np.cumsum(~before[h] & ~blank)
            self.records[h] = int(number[-1])
            columns += [pa.array(before[h]), pa.array(after), pa.array(number.astype("int64"))]
        self.line += n
        return columns


def _scan(batches):
    """Arrow batches of (file, start, value, quoted, blank), a range's lines in order, to rows of ``_LINES``."""
    names = ["file", "start", "line", "blank", "in0", "out0", "rec0", "in1", "out1", "rec1", "value"]
    key, open_range = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        file, start, value, quoted, blank = batch.columns
        starts = start.to_numpy(zero_copy_only=False)
        moved = pc.not_equal(file.slice(1), file.slice(0, batch.num_rows - 1)).to_numpy(zero_copy_only=False)
        cut = (starts[1:] != starts[:-1]) | moved.astype(bool)
        edges = [0, *(np.flatnonzero(cut) + 1).tolist(), batch.num_rows]
        quoted, blank = quoted.to_numpy(zero_copy_only=False).astype(bool), blank.to_numpy(zero_copy_only=False).astype(bool)
        for a, b in zip(edges, edges[1:]):
            here = (file[a].as_py(), int(starts[a]))
            if here != key:
                key, open_range = here, _Range()
            part = value.slice(a, b - a)
            cols = open_range.take(part, quoted[a:b], blank[a:b])
            yield pa.RecordBatch.from_arrays([file.slice(a, b - a), start.slice(a, b - a), *cols, part], names=names)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    text = spark.read.option("lineSep", "\n").text(path)
    rows = text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
                       F.col("value").cast("binary").alias("value"), F.contains("value", F.lit('"')).alias("quoted"),
                       F.col("value").rlike("^[ \t\r]*$").alias("blank"))
    return rows.mapInArrow(_scan, _LINES)


def _ranges(lines: DataFrame) -> DataFrame:
    """A row a range: whether it starts inside a quoted cell, and the record that is open there.

    The window sorts the ranges of one file (8,000 of them for a terabyte), not its lines.
    """
    text = F.col("value").cast("string")
    ends = [F.max_by(f"out{h}", "line").alias(f"end{h}") for h in (0, 1)]
    parts = lines.groupBy("file", "start").agg(
        *ends, F.max("rec0").alias("n0"), F.max("rec1").alias("n1"), F.count_if(F.col("in0") | F.col("out0")).alias("p0"),
        F.count_if(F.col("in1") | F.col("out1")).alias("p1"), F.count_if(~F.is_valid_utf8(text)).alias("bad"),
        F.count_if(text.rlike("\r[^\n]")).alias("lone"))
    upto = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    # The end of a range is fixed whatever its start (reset), the start's state, or its opposite (flip).
    reset, flip = F.col("end0") == F.col("end1"), F.col("end0") & ~F.col("end1")
    flips = parts.withColumn("flips", F.sum(F.when(flip, 1).otherwise(0)).over(upto))
    fixed = F.last(F.when(reset, F.struct(F.col("end0").alias("v"), F.col("flips").alias("f"))), True).over(upto)
    after = flips.withColumn("fixed", fixed).withColumn(
        "after", F.coalesce(F.col("fixed.v"), F.lit(False)) != ((F.col("flips") - F.coalesce(F.col("fixed.f"), F.lit(0))) % 2 == 1))
    known = after.withColumn("inside", F.coalesce(F.last("after").over(before), F.lit(False)))
    records = F.when(F.col("inside"), F.col("n1")).otherwise(F.col("n0"))
    owner = F.last(F.when(records > 0, F.struct(F.col("start").alias("s"), records.alias("r"))), True).over(before)
    return known.select("file", "start", "inside", "after", owner.alias("owner"), "bad", "lone",
                        F.when(F.col("inside"), F.col("p1")).otherwise(F.col("p0")).alias("pieces"))


def csv_records(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame | None:
    """(file, header, text): every record of the CSV files under ``path``; ``header`` marks a file's first one.

    UTF-8 is assumed of a file unless one of its lines does not decode; such a file, and no other, is
    read as Latin-1. Blank lines outside quoted cells are no records. A file that ends inside a quoted cell raises. Where
    a carriage return stands alone the lines can't be told by their line feeds: the result is None, for
    a reader that takes a file as one piece. The lines are written once, so that ranges and lines
    agree however later jobs are planned.
    """
    lines = stored(_lines(spark, path), "csv-lines")
    ranges = stored(_ranges(lines), "csv-ranges")
    last = F.max_by("after", "start").alias("open")
    total = ranges.groupBy("file").agg(last, F.sum("bad").alias("bad"), F.sum("lone").alias("lone"), F.sum("pieces").alias("pieces"),
                                       F.count_if("inside").alias("inside")).agg(
        F.count_if("open").alias("open"), F.sum("bad").alias("bad"), F.sum("lone").alias("lone"), F.sum("pieces").alias("pieces"),
        F.sum("inside").alias("inside")).first()
    if total["lone"]:
        return None
    if total["open"]:
        raise ValueError("a file ends inside a quoted cell")
    # Both tables are small as a rule; adaptive planning broadcasts them by their size or shuffles.
    if total["inside"]:
        held = ranges.where("inside").select("file", "start", "owner", F.lit(True).alias("inside"))
        lines = lines.join(held, ["file", "start"], "left")
    else:
        lines = lines.select("*", F.lit(None).cast("struct<s:bigint,r:bigint>").alias("owner"), F.lit(False).alias("inside"))
    chosen = [F.when(F.col("inside"), F.col(f"{c}1")).otherwise(F.col(f"{c}0")).alias(c) for c in ("in", "out", "rec")]
    lines = lines.select("file", "start", "line", "blank", "owner", "value", *chosen)
    # an ending carriage return belongs to the line break
    whole = lines.where(~F.col("in") & ~F.col("out") & ~F.col("blank")).select(
        "file", ((F.col("start") == 0) & (F.col("rec") == 1)).alias("header"), "value")
    if total["pieces"]:
        mine = F.struct(F.col("start").alias("s"), F.col("rec").alias("r"))
        pieces = lines.where(F.col("in") | F.col("out")).select(
            "file", F.when(F.col("rec") == 0, F.col("owner")).otherwise(mine).alias("record"), F.struct("start", "line", "value").alias("piece"))
        joined = F.aggregate(F.slice("pieces", 2, F.size("pieces")), F.col("pieces")[0]["value"],
                             lambda t, p: F.concat(t, F.lit(b"\n"), p["value"]))
        records = pieces.groupBy("file", "record").agg(F.array_sort(F.collect_list("piece")).alias("pieces")).select(
            "file", ((F.col("record.s") == 0) & (F.col("record.r") == 1)).alias("header"), joined.alias("value"))
        whole = whole.unionByName(records)
    text = F.col("value").cast("string")
    if encoding == LATIN1:
        text = F.decode("value", LATIN1)
    elif encoding is None and total["bad"]:
        bad = ranges.where("bad > 0").select("file").distinct().withColumn("latin", F.lit(True))
        whole = whole.join(bad, "file", "left")
        text = F.when(F.col("latin"), F.decode("value", LATIN1)).otherwise(text)
    return whole.select("file", "header", F.regexp_replace(text, "\r\\z", "").alias("text"))

"""Hard-negative mining with segment summary filtering.

Vectors become integers floor(256 x). A vector is stored with the mean m and the deviation s of its
segments, coarse ones and finer ones. Over a segment of length L two vectors' product lies within
L (m m' - s s') and L (m m' + s s') (Cauchy-Schwarz on the centred parts), and the sum over the segments bounds
the score from both sides. A block of rows is first tried as a whole (range of its means, largest
deviations), then its rows by coarse segments, then by finer ones; only pairs whose bounds
still reach what an anchor can use are scored exactly.

Anchors and rows meet in cells: a group of anchors and a range of rows. A cell keeps its anchors, streams its
rows in blocks, and carries each anchor's k-th score from block to block, so the bounds tighten as it goes on.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import numbered_groups

SCALE = 256.0
# Lengths of the segments, level by level.
SEGMENTS = (16, 4)
# Anchors that a cell holds, and rows that it tries at a time.
ANCHOR_ROWS = 1 << 16
BLOCK = 2048
# Rows of a cell: a share of the table for every core, within these bounds. Anchors are sent to n / rows cells.
LEAST_ROWS, MOST_ROWS = 1 << 12, 1 << 18
# Anchors compared with a block at once, and the share of open pairs below which they are followed one by one.
TILE, SPARSE = 512, 0.125
EXACT_FLOAT = 2.0 ** 53
LOW, HIGH = -(2 ** 63), 2 ** 63 - 1


def _starts(dim: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    starts = np.arange(0, dim, length)
    return starts, np.diff([*starts, dim])


def summaries(m: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per level the segments' means and deviations, both times the root of the segment's length."""
    out = []
    for length in SEGMENTS:
        starts, sizes = _starts(m.shape[1], length)
        mean = np.add.reduceat(m, starts, axis=1) / sizes
        centred = m - np.repeat(mean, sizes, axis=1)
        out.append((mean * np.sqrt(sizes), np.sqrt(np.add.reduceat(centred * centred, starts, axis=1))))
    return out


def _packed(levels: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    return np.hstack([x for level in levels for x in level])


def _unpacked(flat: np.ndarray, dim: int) -> list[tuple[np.ndarray, np.ndarray]]:
    out, at = [], 0
    for length in SEGMENTS:
        n = -(-dim // length)
        out.append((flat[:, at:at + n], flat[:, at + n:at + 2 * n]))
        at += 2 * n
    return out


def _matrix(column, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _summarise(batches):
    """Add the segment summaries to arriving (vec_id, dim, label, v) rows, and the signs of the coarse means as a sort code."""
    for b in batches:
        dims = b.column("dim").to_numpy()
        cuts = np.flatnonzero(dims[1:] != dims[:-1]) + 1
        for start, end in zip([0, *cuts], [*cuts, len(dims)]):
            if start == end:
                continue
            rows = b.slice(start, end - start)
            flat, code = np.empty((end - start, 0)), np.zeros(end - start, np.int64)
            if dims[start]:
                levels = summaries(_matrix(rows.column("v"), int(dims[start])))
                flat = _packed(levels)
                signs = levels[0][0][:, :62] > 0
                code = signs @ (1 << np.arange(signs.shape[1], dtype=np.int64))
            offsets = np.arange(0, flat.size + 1, flat.shape[1], dtype=np.int32) if flat.shape[1] else np.zeros(end - start + 1, np.int32)
            yield pa.RecordBatch.from_arrays(
                [*rows.columns, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.ravel())), pa.array(code)],
                names=[*rows.schema.names, "summary", "code"])


VECTORS = "vec_id long, dim int, label string, v array<double>"


def summarised_vectors(df: DataFrame, id_col: str, label_col: str, vec_col: str, label: Column | None = None) -> DataFrame:
    """(vec_id, dim, label, v, summary, code) of the rows that take part, one per id."""
    x = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # floor of a double is a bigint in SQL, which ends at 2^63; larger components are whole already
    scaled = F.transform(x, lambda c: F.when(F.abs(c) < 1e15, F.floor(c * SCALE).cast("double")).otherwise(c * SCALE))
    named = df.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), (F.col(f"`{label_col}`") if label is None else label).cast("string").alias("label"),
                      F.when(~bad, scaled).alias("v"))
    row = F.min(F.struct("label", "v"))
    one = named.where("vec_id is not null and label is not null and v is not null").groupBy("vec_id").agg(row.alias("row"))
    rows = one.select("vec_id", F.size("row.v").alias("dim"), F.col("row.label").alias("label"), F.col("row.v").alias("v"))
    return rows.mapInArrow(_summarise, VECTORS + ", summary array<double>, code long")


class Cell:
    """Anchors of one cell with what they still look for; rows are offered block by block."""

    def __init__(self, dim: int):
        self.dim = dim
        self.ids, self.m, self.flat, self.labels = [], [], [], []
        self.codes: dict = {}

    def add(self, rows: pa.RecordBatch) -> None:
        self.ids.append(rows.column("vec_id").to_numpy())
        self.m.append(_matrix(rows.column("v"), self.dim))
        self.flat.append(_matrix(rows.column("summary"), rows.column("summary").value_lengths()[0].as_py()))
        self.labels.append(self._coded(rows))

    def _coded(self, rows: pa.RecordBatch) -> np.ndarray:
        return np.array([self.codes.setdefault(x, len(self.codes)) for x in rows.column("label").to_pylist()], np.int64)

    def close(self) -> None:
        """All anchors have come."""
        self.ids, self.m, self.labels = (np.concatenate(x) for x in (self.ids, self.m, self.labels))
        self.levels = _unpacked(np.concatenate(self.flat), self.dim)
        self.norms = np.sqrt((self.m * self.m).sum(axis=1))
        self.start()

    def offer(self, rows: pa.RecordBatch) -> None:
        ids, m, labels = rows.column("vec_id").to_numpy(), _matrix(rows.column("v"), self.dim), self._coded(rows)
        levels = _unpacked(_matrix(rows.column("summary"), rows.column("summary").value_lengths()[0].as_py()), self.dim)
        norms = np.sqrt((m * m).sum(axis=1))
        biggest = float(np.abs(self.m).max(initial=0)) * float(np.abs(m).max(initial=0)) * self.dim
        exact = biggest < EXACT_FLOAT
        slack = (1e-9 if exact else 1e-6) * norms.max(initial=0)
        near = self._blocks_in_reach(levels[0], slack)
        for at in range(0, len(near), TILE):
            some = near[at:at + TILE]
            i, j, scores = self._scored(some, m, levels, labels, ids, slack, exact)
            cuts = np.flatnonzero(np.diff(i)) + 1
            for s, e in zip([0, *cuts], [*cuts, len(i)]):
                if s < e:
                    self.take(int(i[s]), scores[s:e], ids[j[s:e]])

    def _blocks_in_reach(self, level, slack: float) -> np.ndarray:
        """Anchors that the block as a whole may serve, by the range of its means and its largest deviations."""
        mean, dev = self.levels[0]
        high, low, most = level[0].max(axis=0), level[0].min(axis=0), level[1].max(axis=0)
        up, down = np.maximum(mean, 0), np.minimum(mean, 0)
        spread = dev @ most + slack * self.norms
        return np.flatnonzero((up @ high + down @ low + spread >= self.floor) & (up @ low + down @ high - spread <= self.cap))

    def _scored(self, some, m, levels, labels, ids, slack, exact):
        """Pairs (anchor, row) of the tile that pass all bounds, with their scores, by anchor."""
        floor, cap, margin = self.floor[some, None], self.cap[some, None], slack * self.norms[some, None]
        open_ = self.wanted(some, labels) & (self.ids[some, None] != ids)
        for (mean, dev), (mean2, dev2) in zip(self.levels, levels):
            mean, dev = mean[some], dev[some]
            if open_.mean() > SPARSE:
                middle, spread = mean @ mean2.T, dev @ dev2.T + margin
                open_ &= (middle + spread >= floor) & (middle - spread <= cap)
            else:
                i, j = np.nonzero(open_)
                middle, spread = (np.einsum("ij,ij->i", x[i], y[j]) for x, y in ((mean, mean2), (dev, dev2)))
                spread += margin[i, 0]
                open_[i, j] = (middle + spread >= floor[i, 0]) & (middle - spread <= cap[i, 0])
        if exact and open_.mean() > SPARSE:
            scores = self.m[some] @ m.T
            i, j = np.nonzero(open_ & (scores >= floor) & (scores <= cap))
            return some[i], j, scores[i, j].astype(np.int64)
        i, j = np.nonzero(open_)
        if exact:
            scores = np.einsum("ij,ij->i", self.m[some[i]], m[j])
            fits = (scores >= floor[i, 0]) & (scores <= cap[i, 0])
            return some[i[fits]], j[fits], scores[fits].astype(np.int64)
        # whole numbers beyond 2^53: Python's integers
        whole = [max(LOW, min(HIGH, sum(int(a) * int(b) for a, b in zip(self.m[some[x]], m[y])))) for x, y in zip(i, j)]
        return some[i], j, np.array(whole, dtype=object)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, ties by smaller id."""
    order = sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k] if scores.dtype == object else np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


class Positives(Cell):
    """The k best rows with the anchor's label."""

    k = 5

    def start(self) -> None:
        n = len(self.ids)
        self.floor, self.cap = np.full(n, -np.inf), np.full(n, np.inf)
        self.best = [(np.empty(0, np.int64), np.empty(0, np.int64))] * n

    def wanted(self, some, labels):
        return self.labels[some, None] == labels

    def take(self, i, scores, ids) -> None:
        old, old_ids = self.best[i]
        self.best[i] = _best(np.concatenate([old, scores]), np.concatenate([old_ids, ids]), self.k)
        if len(self.best[i][0]) == self.k:
            self.floor[i] = self.best[i][0][-1]

    def found(self) -> pa.RecordBatch:
        sizes = [len(s) for s, _ in self.best]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(self.ids, sizes)), pa.array([int(x) for _, ids in self.best for x in ids], pa.int64()),
             pa.array([int(x) for scores, _ in self.best for x in scores], pa.int64())], names=["anchor_id", "vec_id", "score"])


class Negatives(Cell):
    """For each of the anchor's positives the k best rows of other labels in its score range."""

    k, low, high = 3, 50, 95

    def __init__(self, dim: int):
        super().__init__(dim)
        self.positives: list = []

    def add(self, rows: pa.RecordBatch) -> None:
        super().add(rows)
        self.positives += rows.column("positives").to_pylist()

    def start(self) -> None:
        """A range holds the whole scores s with low * p <= 100 * s <= high * p."""
        self.ranges = [[(p["vec_id"], p["score"], -(-self.low * p["score"] // 100), self.high * p["score"] // 100) for p in ps]
                       for ps in self.positives]
        self.best = [[(np.empty(0, np.int64), np.empty(0, np.int64)) for _ in r] for r in self.ranges]
        self.cap = np.array([max((hi for *_, hi in r), default=-np.inf) for r in self.ranges], dtype=np.float64)
        self.floor = np.array([min((lo for _, _, lo, _ in r), default=np.inf) for r in self.ranges], dtype=np.float64)

    def wanted(self, some, labels):
        return self.labels[some, None] != labels

    def take(self, i, scores, ids) -> None:
        scores, ids = _best(scores, ids, len(ids))
        floors = []
        for at, (_, _, lo, hi) in enumerate(self.ranges[i]):
            old, old_ids = self.best[i][at]
            first = next((x for x in range(len(scores)) if scores[x] <= hi), len(scores)) if scores.dtype == object else \
                int(np.searchsorted(-scores, -hi))
            some, some_ids = scores[first:first + self.k], ids[first:first + self.k]
            fits = some >= lo
            if fits.any():
                self.best[i][at] = old, old_ids = _best(np.concatenate([old, some[fits]]), np.concatenate([old_ids, some_ids[fits]]), self.k)
            floors.append(int(old[-1]) if len(old) == self.k else lo)
        self.floor[i] = min(floors)

    def found(self) -> pa.RecordBatch:
        rows = [(int(a), pos, score, int(n), int(s)) for a, ranges, bests in zip(self.ids, self.ranges, self.best)
                for (pos, score, _, _), (scores, ids) in zip(ranges, bests) for s, n in zip(scores, ids)]
        names = ["anchor_id", "positive_id", "positive_score", "negative_id", "negative_score"]
        return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], pa.int64()) for c in range(5)], names=names)


CELL = ["dim", "tree", "cell", "team"]


def _search(make):
    """A task's pass over rows sorted by (cell, kind): a cell's anchors come first, its rows after, tried BLOCK at a time."""
    def run(batches):
        here, cell, held = None, None, []

        def flush(least):
            nonlocal held
            if held and sum(b.num_rows for b in held) >= least:
                cell.offer(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                held = []

        for b in batches:
            keys = [b.column(c).to_numpy() for c in [*CELL, "kind"]]
            if not len(keys[0]):
                continue
            cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
            for start, end in zip([0, *cuts], [*cuts, len(keys[0])]):
                at, kind = tuple(int(k[start]) for k in keys[:-1]), keys[-1][start]
                rows = b.slice(start, end - start)
                if at != here:
                    if cell is not None and cell.ready:
                        flush(1)
                        yield cell.found()
                    here, cell, held = at, make(at[0]), []
                    cell.ready, cell.any = False, False
                if kind == 0:
                    cell.add(rows)
                    cell.any = True
                elif cell.any:
                    if not cell.ready:
                        cell.close()
                        cell.ready = True
                    for s in range(0, rows.num_rows, BLOCK):
                        held.append(rows.slice(s, BLOCK))
                        flush(BLOCK)
        if cell is not None and cell.ready:
            flush(1)
            yield cell.found()

    return run


SIDE = [*CELL, "kind", "vec_id", "label", "v", "summary"]


def _meet(rows: DataFrame, anchors: DataFrame) -> DataFrame:
    """Rows and anchors of a cell in one task, sorted. Both have the columns of SIDE, anchors ``positives`` too if need be."""
    both = anchors.withColumn("kind", F.lit(0)).unionByName(rows.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    return both.repartition(*CELL).sortWithinPartitions(*CELL, "kind")


def _upto(n: Column) -> Column:
    """0 .. n - 1 as rows (none if n = 0)."""
    return F.explode(F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)))


def hard_negatives(df: DataFrame, anchors: Column | None = None, label: Column | None = None, positives: int = 5, negatives: int = 3,
                   low: int = 50, high: int = 95, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding",
                   part_rows: int | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``anchors``: condition over the column vec_id (default: divisible by 50); ``label``: a column in place of
    the label. An anchor's positives are its best ``positives`` other rows of its label; for each, the best
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score
    are returned, ranked from 1; ties go to smaller ids. Scores are integer inner products of floor(256 x).

    Rows with a null id, label or vector, or a null or non-finite component take no part. Of rows that share an id the
    smallest by (label, vector) counts, so repeated rows count once. Vectors of different length do not meet;
    empty vectors take no part; a score beyond a long is the nearest long. Anchors without a positive, and positives without
    a negative in range, have no row; an empty table gives none; other columns are ignored.
    """
    asked = F.col("vec_id") % 50 == 0 if anchors is None else anchors
    vectors = summarised_vectors(df, id_col, label_col, vec_col, label).where("dim > 0")
    vectors = vectors.withColumn("anchor", asked.cast("int")).withColumn("grp", F.concat_ws(":", "dim", "label"))
    rows, groups = numbered_groups(vectors, ["grp", "code", "vec_id"], "negatives-vectors", asked=F.col("anchor"))
    n, n_anchors = groups.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("asked"), F.lit(0))).first()
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = part_rows or max(LEAST_ROWS, min(MOST_ROWS, n // (2 * cores)))

    def teams(count: Column) -> Column:
        return F.ceil(count / ANCHOR_ROWS).cast("long")

    def team(count: Column) -> Column:
        return F.pmod(F.xxhash64("vec_id"), F.greatest(teams(count), F.lit(1).cast("long"))).alias("team")

    side = [c for c in SIDE if c not in CELL and c != "kind"]
    # positives: cells inside a label
    cells = F.ceil(F.col("n") / size).cast("long")
    mine = rows.where("anchor = 1").select("dim", "tree", _upto(cells).alias("cell"), team(F.col("asked")), *side)
    theirs = rows.select("dim", "tree", F.floor(F.col("pos") / size).cast("long").alias("cell"), _upto(teams(F.col("asked"))).alias("team"), *side)
    maker = type("Positives", (Positives,), {"k": positives})
    near = _meet(theirs, mine).mapInArrow(_search(maker), "anchor_id long, vec_id long, score long")
    ranked = Window.partitionBy("anchor_id").orderBy(F.col("score").desc(), "vec_id")
    near = near.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= positives)
    near = stored(near.groupBy("anchor_id").agg(F.collect_list(F.struct("vec_id", "score")).alias("positives")), "negatives-positives")

    # negatives: cells over all rows
    all_cells, all_teams = F.lit(-(-n // size)).cast("long"), F.lit(n_anchors)
    zero = F.lit(0).cast("long").alias("tree")
    mine = (rows.where("anchor = 1").join(near, F.col("vec_id") == F.col("anchor_id"))
            .select("dim", zero, _upto(all_cells).alias("cell"), team(all_teams), *side, "positives"))
    theirs = rows.select("dim", zero, F.floor(F.col("g") / size).cast("long").alias("cell"), _upto(teams(all_teams)).alias("team"), *side)
    maker = type("Negatives", (Negatives,), {"k": negatives, "low": low, "high": high})
    schema = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"
    far = _meet(theirs, mine).mapInArrow(_search(maker), schema)
    ranked = Window.partitionBy("anchor_id", "positive_id").orderBy(F.col("negative_score").desc(), "negative_id")
    return (far.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= negatives)
            .select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))


ORACLE_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, [floor(256 * x::DOUBLE) FOR x IN embedding] AS v
           FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT a.vec_id AS anchor_id, o.vec_id, a.label = o.label AS same, list_dot_product(a.v, o.v)::BIGINT AS score
      FROM v a JOIN v o ON a.vec_id <> o.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5),
r AS (SELECT p.*, s.vec_id AS negative_id, s.score AS negative_score,
             row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)::INTEGER AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM r WHERE rank <= 3
"""

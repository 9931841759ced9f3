"""Exact top-k inner-product search with block-at-a-time pruning.

Vectors become integers floor(256 x). A part holds consecutive id ranges of
documents, cut into blocks; a block keeps the maximum and minimum of every
dimension (term) and a forward index (its vectors, row by row). For a query the
summed term maxima q_d * max or min bound every score in a block; blocks are
scored through their forward index in the order of their bounds, until the next
bound falls below the k-th score. Parts and query blocks meet by a shuffle on
the part, so a task holds one part and one query block at a time; the parts'
k best per query are merged by a window.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored

SCALE = 256.0
BLOCK = 64
PART_ROWS = 4096
QUERY_ROWS = 256
EXACT_FLOAT = 2.0 ** 53
LOW, HIGH = -(2 ** 63), 2 ** 63 - 1


def integer_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, dim, v array<double>) of floor(256 x); null or non-finite components and null ids take no part."""
    x = F.col(f"`{vec_col}`").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    # floor of a double is a bigint in SQL, which ends at 2^63; larger components are whole already
    scaled = F.transform(x, lambda c: F.when(F.abs(c) < 1e15, F.floor(c * SCALE).cast("double")).otherwise(c * SCALE))
    return (df.where(F.col(f"`{vec_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull()).where(~bad)
            .select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.size(x).alias("dim"), scaled.alias("v"))
            .dropDuplicates())


def _exact(q: np.ndarray, m: np.ndarray) -> bool:
    """Whether float64 holds every partial sum of the products."""
    return float(np.abs(q).max(initial=0)) * float(np.abs(m).max(initial=0)) * max(1, m.shape[1]) < EXACT_FLOAT


class Part:
    """Documents of one part: vectors sorted by id, in blocks with their term maxima and minima."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, block: int = BLOCK):
        order = np.argsort(ids, kind="stable")
        self.ids, self.m = ids[order], vectors[order]
        starts = np.arange(0, len(ids), block)
        self.bounds = [(s, min(s + block, len(ids))) for s in starts]
        self.high = np.maximum.reduceat(self.m, starts, axis=0)
        self.low = np.minimum.reduceat(self.m, starts, axis=0)

    def best(self, qid: int, q: np.ndarray, k: int, bound: np.ndarray) -> list[tuple[int, int]]:
        """The k best (score, id) of the part but the query's own id; equal scores prefer small ids."""
        ids_, scores, kth = np.empty(0, np.int64), np.empty(0), -np.inf
        exact = _exact(q, self.m)
        for b in np.argsort(-bound, kind="stable"):
            if bound[b] < kth:  # an equal bound may still hide a smaller id
                break
            s, e = self.bounds[b]
            if exact:
                got = self.m[s:e] @ q
            else:  # whole numbers beyond 2^53: Python's integers
                whole = [int(x) for x in q]
                got = np.array([max(LOW, min(HIGH, sum(int(a) * c for a, c in zip(row, whole)))) for row in self.m[s:e]], dtype=object)
            fresh = self.ids[s:e] != qid
            at = fresh & (got >= kth)
            if not at.any():
                continue
            ids_ = np.concatenate([ids_, self.ids[s:e][at]])
            scores = np.concatenate([scores, got[at]])
            if len(ids_) >= k:
                top = sorted(range(len(ids_)), key=lambda i: (-scores[i], ids_[i]))[:k]
                ids_, scores = ids_[top], scores[top]
                kth = scores[-1]
        return [(int(s), int(i)) for s, i in zip(scores, ids_)]


def _search(batches, k: int, block: int):
    """Rows sorted by (dim, part, kind): a part's vector rows come first, its query blocks after."""
    here, ids, vecs, part = None, [], [], None
    for b in batches:
        out: list[list] = [[], [], []]
        dims, parts, kinds, keys, vectors = (b.column(c) for c in ("dim", "part", "kind", "ids", "vectors"))
        for dim, no, kind, key, raw in zip(dims.to_pylist(), parts.to_pylist(), kinds.to_pylist(), keys.to_pylist(), vectors.to_pylist()):
            if (dim, no) != here:
                here, ids, vecs, part = (dim, no), [], [], None
            n = np.frombuffer(key, dtype=np.int64)
            m = np.frombuffer(raw, dtype=np.float64).reshape(len(n), dim)
            if kind == 0:
                ids.append(n)
                vecs.append(m)
                continue
            if part is None:
                if not ids:
                    continue
                part = Part(np.concatenate(ids), np.concatenate(vecs), block)
            # bounds carry a small margin where float64 may round
            slack = 0.0 if _exact(m, part.m) else 1e-6
            bounds = np.maximum(m, 0) @ part.high.T + np.minimum(m, 0) @ part.low.T
            bounds += slack * (np.abs(m) @ np.maximum(np.abs(part.high), np.abs(part.low)).T)
            for i, qid in enumerate(n):
                for score, found in part.best(int(qid), m[i], k, bounds[i]):
                    out[0].append(int(qid))
                    out[1].append(found)
                    out[2].append(score)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names=["query_id", "vec_id", "score"])


def _blocks(batches):
    """Gather arriving (dim, part, vec_id, v) rows, sorted by (dim, part), into rows of packed vectors."""
    def flush(key, ids, rows):
        return pa.RecordBatch.from_arrays(
            [pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int64()), pa.array([np.array(ids, np.int64).tobytes()], pa.binary()),
             pa.array([np.array(rows, np.float64).tobytes()], pa.binary())], names=["dim", "part", "ids", "vectors"])

    here, ids, rows = None, [], []
    for b in batches:
        for dim, no, vec_id, v in zip(*[b.column(c).to_pylist() for c in ("dim", "part", "vec_id", "v")]):
            if ids and ((dim, no) != here or len(ids) == QUERY_ROWS):
                yield flush(here, ids, rows)
                ids, rows = [], []
            here = (dim, no)
            ids.append(vec_id)
            rows.append(v)
    if ids:
        yield flush(here, ids, rows)


def top_k(df: DataFrame, queries: DataFrame | None = None, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding",
          part_rows: int = PART_ROWS, block: int = BLOCK) -> DataFrame:
    """Each query's k highest integer inner products: query_id, rank, vec_id, score.

    ``queries`` defaults to the rows whose id is divisible by 50. Every other
    row is a candidate; ties go to the smaller vec_id; fewer than k candidates give
    fewer rows. A row with a null id, a null vector or a null or non-finite
    component takes no part; rows repeated whole count once; a query's own id
    is never its own candidate; vectors of different length do not meet; a score
    beyond a long is the nearest long; an empty table gives no rows and other columns are ignored.
    """
    docs = stored(integer_vectors(df, id_col, vec_col), "topk-vectors")
    asked = docs.where("vec_id % 50 = 0") if queries is None else integer_vectors(queries, id_col, vec_col)
    # parts are id ranges of about part_rows rows; the ends of the ranges are one row a part
    n = docs.count()
    parts = max(1, -(-n // part_rows))
    spread = docs.repartitionByRange(parts, "vec_id").withColumn("part", F.spark_partition_id().cast("long"))
    schema = "dim int, part long, ids binary, vectors binary"
    order = ["dim", "part"]
    packed = spread.select("dim", "part", "vec_id", "v").sortWithinPartitions("dim", "part", "vec_id").mapInArrow(_blocks, schema)
    # query blocks of QUERY_ROWS vectors, one copy for each part
    groups = max(1, -(-n // (50 * QUERY_ROWS)))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("vec_id"), F.lit(groups)))
    blocks = (asked.select("dim", "part", "vec_id", "v").repartition(groups, "dim", "part").sortWithinPartitions(*order)
              .mapInArrow(_blocks, schema))
    copies = blocks.select("dim", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(parts - 1).cast("long"))).alias("part"), "ids", "vectors")
    both = (packed.withColumn("kind", F.lit(0)).unionByName(copies.withColumn("kind", F.lit(1)))
            .select("dim", "part", "kind", "ids", "vectors").repartition(parts, "part").sortWithinPartitions("dim", "part", "kind"))
    found = both.mapInArrow(lambda b: _search(b, k, block), "query_id long, vec_id long, score long")
    ranked = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return (found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))


ORACLE_SQL = """
WITH v AS (SELECT DISTINCT vec_id, [floor(256 * x::DOUBLE) for x in embedding] AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL),
s AS (SELECT q.vec_id AS query_id, d.vec_id, list_dot_product(q.v, d.v)::BIGINT AS score
      FROM v q JOIN v d ON q.vec_id <> d.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

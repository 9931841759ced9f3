"""Merkle dataset manifest over a SHA midstate tree.

A row is a leaf; the leaves of a group (``source``) form a tree of fan-out 16, and the
groups' roots form one more. A parent keeps a copy of its SHA-256 state from before each
child slot. To fold a changed child, the copy of its slot takes the new digest and
the siblings to its right; what lies to its left is never hashed again.

Trees are cut into chunks of 16^3 children. A task builds one chunk at a time, so the
rows of a group that holds a third of the table spread over many tasks; the chunks' roots
are the children of the next round, a 4,096th as many. The way back carries each chunk
its siblings on the path to the root, and every row is proved and folded in its chunk's task.
"""
from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import id_crc, numbered, numbered_groups

FANOUT = 16
# Levels that one task builds over a chunk, and the children of a chunk.
LEVELS = 3
CHUNK = FANOUT ** LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def leaf_digest(columns: list[Column]) -> Column:
    """Lowercase hex SHA-256 of the values, each as ``-`` if null, else UTF-8 byte count, ``:``, value."""
    texts = [c.cast("string") for c in columns]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]), 256)


def depth_of(n: Column) -> Column:
    """Levels above n children: the smallest d with 16^d >= n."""
    return sum((n > F.lit(FANOUT ** k)).cast("int") for k in range(15))


class Subtree:
    """The nodes over a chunk's children (hex digests as bytes), level by level, with the kept hash states."""

    def __init__(self, children: list[bytes], levels: int, keep_states: bool = True):
        self.nodes, self.states = [children], []
        for _ in range(levels):
            below, above, states = self.nodes[-1], [], []
            for start in range(0, len(below), FANOUT):
                state = sha256()
                for child in below[start:start + FANOUT]:
                    if keep_states:
                        states.append(state.copy())
                    state.update(child)
                above.append(state.hexdigest().encode())
            self.nodes.append(above)
            self.states.append(states)

    @property
    def root(self) -> bytes:
        return self.nodes[-1][0]

    def siblings(self, level: int, i: int) -> tuple[bytes, bytes]:
        """Digests to the left and to the right of child i in its run."""
        start = i - i % FANOUT
        row = self.nodes[level]
        return b"".join(row[start:i]), b"".join(row[i + 1:start + FANOUT])

    def path(self, i: int) -> list[tuple[bytes, bytes]]:
        """Siblings of leaf i and of its ancestors below the chunk's root."""
        return [self.siblings(level, i // FANOUT ** level) for level in range(len(self.states))]

    def fold(self, i: int, digest: bytes) -> bytes:
        """The chunk's root with another digest at leaf i."""
        for level, states in enumerate(self.states):
            state = states[i].copy()
            state.update(digest + self.siblings(level, i)[1])
            digest, i = state.hexdigest().encode(), i // FANOUT
        return digest


class Path:
    """The levels above a chunk: its siblings there, and each parent's state from before the chunk's slot."""

    def __init__(self, lefts: list[bytes], rights: list[bytes]):
        self.rights, self.states = rights, [sha256(x) for x in lefts]
        self.siblings = b"".join(x + y for x, y in zip(lefts, rights))

    def fold(self, digest: bytes) -> bytes:
        for kept, right in zip(self.states, self.rights):
            state = kept.copy()
            state.update(digest + right)
            digest = state.hexdigest().encode()
        return digest


def _chunks(batches):
    """Rows arrive sorted by (tree, chunk): the rows of one chunk at a time, at most CHUNK children and one path."""
    held, here = [], None
    for b in batches:
        tree, chunk = b.column("tree").to_numpy(), b.column("chunk").to_numpy()
        cuts = np.flatnonzero((tree[1:] != tree[:-1]) | (chunk[1:] != chunk[:-1])) + 1
        for start, end in zip([0, *cuts], [*cuts, len(tree)]):
            if start == end:
                continue
            at = (int(tree[start]), int(chunk[start]))
            if here is not None and at != here:
                yield here, pa.Table.from_batches(held)
                held = []
            here = at
            held.append(b.slice(start, end - start))
    if held:
        yield here, pa.Table.from_batches(held)


def _hex(column) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


def _build(batches):
    """The root of every chunk: a child of the next round."""
    for (tree, chunk), rows in _chunks(batches):
        sub = Subtree(_hex(rows.column("digest")), rows.column("levels")[0].as_py(), keep_states=False)
        yield pa.RecordBatch.from_arrays(
            [pa.array([tree], pa.int64()), pa.array([chunk], pa.int64()), pa.array([rows.column("depth")[0].as_py()], pa.int32()),
             pa.array([bytes.fromhex(sub.root.decode())], pa.binary())], names=["tree", "pos", "depth", "digest"])


PATH = "lefts array<binary>, rights array<binary>, subroot binary, root binary"


def _descend(batches):
    """For every child of a chunk its siblings up to the root: those in the chunk, then the chunk's own."""
    for (tree, _), rows in _chunks(batches):
        above, children = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
        sub = Subtree(_hex(children.column("digest")), children.column("levels")[0].as_py(), keep_states=False)
        paths = [sub.path(i) for i in range(children.num_rows)]
        lefts = [[p[0] for p in path] + above["lefts"] for path in paths]
        rights = [[p[1] for p in path] + above["rights"] for path in paths]
        n = children.num_rows
        # a group's own root is the child itself in the tree of groups
        subroots = [above["subroot"]] * n if above["subroot"] is not None else children.column("digest").to_pylist()
        yield pa.RecordBatch.from_arrays(
            [pa.array([tree] * n, pa.int64()), pa.array(children.column("pos").to_pylist(), pa.int64()), pa.array(lefts, pa.list_(pa.binary())),
             pa.array(rights, pa.list_(pa.binary())), pa.array(subroots, pa.binary()), pa.array([above["root"]] * n, pa.binary())],
            names=["tree", "pos", "lefts", "rights", "subroot", "root"])


PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def _prove(batches):
    """Proof digest and folded root of every leaf of a chunk."""
    for _, rows in _chunks(batches):
        above, leaves = rows.slice(0, 1).to_pylist()[0], rows.slice(1)
        digests, changed = _hex(leaves.column("digest")), _hex(leaves.column("replacement"))
        sub = Subtree(digests, leaves.column("levels")[0].as_py())
        path = Path(above["lefts"], above["rights"])
        proofs, folded = [], []
        tail, run = b"", None
        for i in range(len(digests)):
            if i // FANOUT != run:  # the 16 leaves of a run share their siblings from the second level on
                run = i // FANOUT
                tail = b"".join(x + y for x, y in sub.path(i)[1:]) + path.siblings
            left, right = sub.siblings(0, i) if sub.states else (b"", b"")
            proofs.append(sha256(left + right + tail).hexdigest())
            folded.append(path.fold(sub.fold(i, changed[i])).decode())
        root, n = above["root"].hex(), len(digests)
        yield pa.RecordBatch.from_arrays(
            [pa.array(leaves.column("doc_id").to_pylist(), pa.int64()), pa.array([d.decode() for d in digests]),
             pa.array([above["subroot"].hex()] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded),
             pa.array([f == root for f in folded])],
            names=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def _cut(nodes: DataFrame, round_no: int) -> DataFrame:
    """Nodes with the chunk that holds them and the levels that the chunk's task builds in this round."""
    levels = F.greatest(F.lit(0), F.least(F.lit(LEVELS), F.col("depth") - LEVELS * round_no))
    return nodes.withColumn("chunk", F.floor(F.col("pos") / CHUNK).cast("long")).withColumn("levels", levels.cast("int"))


def _by_chunk(rows: DataFrame, *order: str) -> DataFrame:
    return rows.repartition("tree", "chunk").sortWithinPartitions("tree", "chunk", *order)


def _rounds(nodes: DataFrame, rounds: int, name: str) -> list[DataFrame]:
    """The children of every round, and the trees' roots at the end. ``nodes``: tree, pos, depth, digest."""
    out = [nodes]
    for r in range(rounds):
        rows = _by_chunk(_cut(out[-1], r).select("tree", "chunk", "pos", "depth", "levels", "digest"), "pos")
        out.append(stored(rows.mapInArrow(_build, "tree long, pos long, depth int, digest binary"), f"{name}-{r}"))
    return out


def _with_paths(nodes: DataFrame, paths: DataFrame, round_no: int) -> DataFrame:
    """A chunk's path row (``paths``: tree, pos of the chunk) before its children."""
    above = paths.withColumn("chunk", F.col("pos")).withColumn("pos", F.lit(-1).cast("long"))
    return _by_chunk(above.unionByName(_cut(nodes, round_no), allowMissingColumns=True), "pos")


def _paths(children: list[DataFrame], paths: DataFrame, rounds: int, down_to: int, name: str) -> DataFrame:
    """Paths of the children of round ``down_to``, from those of the trees' roots."""
    for r in range(rounds - 1, down_to - 1, -1):
        paths = stored(_with_paths(children[r], paths, r).mapInArrow(_descend, f"tree long, pos long, {PATH}"), f"{name}-{r}")
    return paths


def _round_count(n: int) -> int:
    """Rounds of LEVELS levels over n children."""
    depth = next(d for d in range(64) if FANOUT ** d >= n)
    return -(-depth // LEVELS)


def merkle_manifest(docs: DataFrame, changed: dict[str, Column] | None = None, fields: tuple[str, ...] = FIELDS,
                    id_col: str = "doc_id", group_col: str = "source") -> DataFrame:
    """One row per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    Leaf: SHA-256 over ``fields``. Per group the leaves ascend by id; while several
    nodes remain, every 16 consecutive ones become their hash (hex digests, concatenated); a lone
    leaf is its own subroot. Subroots in the order of the groups (null first, bytewise) give the root in
    the same way. proof_sha256: hash of the siblings on the path to the root. ``changed`` gives fields
    another value (a column over ``docs``); folded_root is the root with the row's leaf over those values
    and all other rows as they are, verified whether it is the root.

    Null ids come first in their group; equal ids follow the order of their leaves, and rows that are
    repeated whole are leaves each; null and empty values differ; other columns are
    ignored; an empty table gives no rows.
    """
    columns = {c: F.col(f"`{c}`") for c in fields}
    other = {**columns, **(changed or {})}
    leaves = docs.select(F.col(f"`{group_col}`").cast("string").alias("grp"), F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                         F.unhex(leaf_digest(list(columns.values()))).alias("digest"),
                         F.unhex(leaf_digest([other[c] for c in fields])).alias("replacement"),
                         # spreads rows that are repeated whole over the range partitions; their order does not matter
                         F.xxhash64(F.monotonically_increasing_id()).alias("salt"))
    placed, groups = numbered_groups(leaves, ["grp", "doc_id", "digest", "replacement", "salt"], "merkle-leaves")
    nodes = placed.select("tree", "pos", depth_of(F.col("n")).alias("depth"), "digest", "replacement", "doc_id")
    n_groups, most = groups.agg(F.count(F.lit(1)), F.max("n")).first()
    rounds = _round_count(most or 0)
    children = _rounds(nodes, rounds, "merkle-nodes")
    # the tree over the groups' roots
    tops = numbered(children[-1].select(F.col("tree").alias("grp_tree"), F.col("digest")), ["grp_tree"], "merkle-subroots")
    top_depth = depth_of(F.lit(n_groups))
    tops = tops.select(F.lit(0).cast("long").alias("tree"), F.col("g").alias("pos"), top_depth.alias("depth"), "digest", "grp_tree")
    top_rounds = _round_count(n_groups)
    above = _rounds(tops, top_rounds, "merkle-tops")
    root = above[-1].select("tree", "pos", F.array().cast("array<binary>").alias("lefts"), F.array().cast("array<binary>").alias("rights"),
                            F.lit(None).cast("binary").alias("subroot"), F.col("digest").alias("root"))
    if top_rounds:
        of_top = _paths([x.select("tree", "pos", "depth", "digest") for x in above], root, top_rounds, 0, "merkle-top-paths")
        subroots = of_top.select("pos", *[c.split()[0] for c in PATH.split(", ")])
        to_group = tops.select("pos", "grp_tree", "digest").join(subroots, "pos")
    else:  # one group: its root is the root
        to_group = tops.select("grp_tree", "digest").crossJoin(F.broadcast(root.select("lefts", "rights", "subroot", "root")))  # one row
    group_paths = to_group.select(F.col("grp_tree").alias("tree"), F.lit(0).cast("long").alias("pos"), "lefts", "rights",
                                  F.col("digest").alias("subroot"), "root")
    if rounds:
        inner = [x.select("tree", "pos", "depth", "digest") for x in children]
        chunk_paths = _paths(inner, group_paths, rounds, 1, "merkle-paths")
    else:  # every group is one leaf
        chunk_paths = group_paths
    return _with_paths(nodes, chunk_paths, 0).mapInArrow(_prove, PROVED)


def tampered_text(text: Column, doc_id: Column) -> Column:
    """The text with A-Z lower-cased where 5 divides the id's crc32."""
    return F.when(id_crc(doc_id) % 5 == 0, F.translate(text, UPPER, LOWER)).otherwise(text)


# crc32 (reflected polynomial 3988292384) over the decimal id, then the leaf of a row, in DuckDB
_CRC = ("xor(list_reduce(list_prepend(4294967295::UBIGINT, [ascii(c)::UBIGINT FOR c IN string_split(doc_id::VARCHAR, '')]), "
        "lambda a, b: list_reduce(list_prepend(xor(a, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), "
        "lambda x, z: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))), 4294967295::UBIGINT)")


def _sql_leaf(text: str) -> str:
    parts = [f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in ("doc_id", "source", "lang", "n_chars")]
    return "sha256(" + " || ".join([*parts, f"coalesce(strlen({text})::VARCHAR || ':' || {text}, '-')"]) + ")"


ORACLE_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, {_sql_leaf('text')} AS leaf,
         CASE WHEN {_CRC} % 5 = 0 THEN {_sql_leaf(f"translate(text, '{UPPER}', '{LOWER}')")} ELSE {_sql_leaf('text')} END AS other
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY source) AS n FROM d),
t(source, lvl, pos, h, n) AS (
  SELECT source, 0, pos, leaf, n FROM leaves
  UNION ALL
  SELECT source, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM t WHERE n > 1
  GROUP BY source, lvl, pos // 16, n),
subroots AS (
  SELECT source, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, pos, h, n) AS (
  SELECT 0, pos, subroot, n FROM subroots
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (n + 15) // 16 FROM u WHERE n > 1 GROUP BY lvl, pos // 16, n),
-- folding: the row's own digest climbs from level to level
f(source, start, lvl, pos, h, n) AS (
  SELECT source, pos, 0, pos, other, n FROM leaves
  UNION ALL
  SELECT f.source, f.start, f.lvl + 1, f.pos // 16, sha256(string_agg(CASE WHEN t.pos = f.pos THEN f.h ELSE t.h END, '' ORDER BY t.pos)), (f.n + 15) // 16
  FROM f JOIN t ON t.source IS NOT DISTINCT FROM f.source AND t.lvl = f.lvl AND t.pos // 16 = f.pos // 16 WHERE f.n > 1
  GROUP BY f.source, f.start, f.lvl, f.pos, f.n),
g(source, start, lvl, pos, h, n) AS (
  SELECT f.source, f.start, 0, s.pos, f.h, s.n FROM f JOIN subroots s ON s.source IS NOT DISTINCT FROM f.source WHERE f.n = 1
  UNION ALL
  SELECT g.source, g.start, g.lvl + 1, g.pos // 16, sha256(string_agg(CASE WHEN u.pos = g.pos THEN g.h ELSE u.h END, '' ORDER BY u.pos)), (g.n + 15) // 16
  FROM g JOIN u ON u.lvl = g.lvl AND u.pos // 16 = g.pos // 16 WHERE g.n > 1
  GROUP BY g.source, g.start, g.lvl, g.pos, g.n),
proof AS (
  SELECT source, start, string_agg(h, '' ORDER BY tier, lvl, pos) AS siblings FROM (
    SELECT f.source, f.start, 0 AS tier, t.lvl, t.pos, t.h
    FROM f JOIN t ON t.source IS NOT DISTINCT FROM f.source AND t.lvl = f.lvl AND t.pos // 16 = f.pos // 16 AND t.pos <> f.pos WHERE f.n > 1
    UNION ALL
    SELECT g.source, g.start, 1, u.lvl, u.pos, u.h FROM g JOIN u ON u.lvl = g.lvl AND u.pos // 16 = g.pos // 16 AND u.pos <> g.pos WHERE g.n > 1)
  GROUP BY source, start),
root AS (SELECT h AS root FROM u WHERE n = 1)
SELECT l.doc_id, l.leaf, s.subroot, root.root, sha256(coalesce(p.siblings, '')) AS proof_sha256, g.h AS folded_root, g.h = root.root AS verified
FROM leaves l JOIN subroots s ON s.source IS NOT DISTINCT FROM l.source CROSS JOIN root
JOIN g ON g.source IS NOT DISTINCT FROM l.source AND g.start = l.pos AND g.n = 1
LEFT JOIN proof p ON p.source IS NOT DISTINCT FROM l.source AND p.start = l.pos
"""

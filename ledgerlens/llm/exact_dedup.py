"""Exact dedup by composable polynomial fingerprints.

A text is normalised (white space bytes deleted) and hashed as a polynomial
modulo two primes. Chunk hashes compose: H(ab) = H(a) * B^len(b) + H(b), so the
chunks of a huge document are hashed in parallel tasks and combined by an
aggregate, with the same value as in one pass. Rows with equal fingerprints are
then compared chunk by chunk in a sorted stream, so a hash collision cannot
merge different texts. A bitmap of the fingerprints that occur more than once tells the
second reading which texts may have a copy: only those are shuffled.
"""
from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from .common import append_columns, slices

SPACE = b" \t\n\x0b\x0c\r"
# Two primes below 2^40: a byte times a power stays below 2^48, so the sum over a chunk of 2^15 bytes fits 64 bits.
PRIMES = (1099511627689, 1099511627609)
BASES = (536870923, 805306457)
CHUNK = 1 << 15
# Characters of a chunk row of huge_fingerprints.
HUGE = 1 << 22
# Bits of the bitmap of repeated fingerprints (16 MB): with more than some 10^7 of them it lets more and more other texts
# through to the join, which decides exactly.
MAP_BITS = 1 << 27
MAP_PAGE = 1 << 15  # bits of a page: the size of the bitmaps that Spark builds
# Rows of one fingerprint that a task compares in its first round; the salts' representatives meet in the second.
SALT_ROWS = 512

_TABLES: list = []


def _powers() -> list[np.ndarray]:
    if not _TABLES:
        for p, b in zip(PRIMES, BASES):
            out, x = np.empty(CHUNK, dtype=np.uint64), 1
            for i in range(CHUNK - 1, -1, -1):
                out[i], x = x, x * b % p
            _TABLES.append(out)
    return _TABLES


def chunk_hash(data: bytes) -> tuple[int, int]:
    """Fingerprint of at most CHUNK bytes. Byte value + 1, so leading zero bytes count."""
    if not data:
        return 0, 0
    a = np.frombuffer(data, dtype=np.uint8).astype(np.uint64) + np.uint64(1)
    return tuple(int(np.dot(a, t[CHUNK - len(a):]) % np.uint64(p)) for t, p in zip(_powers(), PRIMES))


def combine(left: tuple[int, int], right: tuple[int, int], right_len: int) -> tuple[int, int]:
    """Fingerprint of the concatenation, from both fingerprints and the right length."""
    return tuple((h * pow(b, right_len, p) + k) % p for h, k, b, p in zip(left, right, BASES, PRIMES))


def fingerprint(data: bytes) -> tuple[int, int]:
    h = (0, 0)
    for i in range(0, len(data), CHUNK):
        part = data[i:i + CHUNK]
        h = combine(h, chunk_hash(part), len(part))
    return h


def normalise(text: bytes | None) -> bytes:
    return (text or b"").translate(None, SPACE)


def _digest(texts):
    norm = [normalise(t) for t in texts]
    fps = [fingerprint(n) for n in norm]
    points = [0 if t is None else len(t) - _continuation(t) for t in texts]
    return [[f[0] for f in fps], [f[1] for f in fps], [len(n) for n in norm], points,
            [hashlib.sha256(n).hexdigest() for n in norm]]


def _digest_repeated(texts, bitmap):
    """As :func:`_digest` with the normalised texts, but null for every text whose fingerprint is not in the bitmap."""
    bits, pages = bitmap
    out = [[None] * len(texts) for _ in range(6)]
    for i, t in enumerate(texts):
        norm = normalise(t)
        fp = fingerprint(norm)
        bit = fp[0] % bits
        page = pages.get(bit // MAP_PAGE)
        if page is None or not page[bit % MAP_PAGE >> 3] >> (bit & 7) & 1:
            continue
        for col, x in zip(out, (*fp, len(norm), 0 if t is None else len(t) - _continuation(t), hashlib.sha256(norm).hexdigest(), norm)):
            col[i] = x
    return out


def _repeated_pages(groups: DataFrame):
    """The bitmap of the groups' fingerprints as a broadcast (bits, {page: bytes}), at most MAP_BITS / 8 bytes."""
    bit = F.col("fp1") % MAP_BITS
    pages = (groups.groupBy(F.floor(bit / MAP_PAGE).cast("int").alias("page"))
             .agg(F.bitmap_construct_agg(bit % MAP_PAGE).alias("bits")).collect())
    return groups.sparkSession.sparkContext.broadcast((MAP_BITS, {r["page"]: bytes(r["bits"]) for r in pages}))


def _continuation(t: bytes) -> int:
    """Bytes that continue a code point (10xxxxxx)."""
    a = np.frombuffer(t, dtype=np.uint8)
    return int(np.count_nonzero((a & 0xC0) == 0x80))


FP = "fp1 long, fp2 long, n_bytes long, n_points long, text_sha256 string"


def fingerprint_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row per document with its fingerprint; a text is hashed chunk by chunk in the task that reads it."""
    text = F.col(f"`{text_col}`").cast("string")
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"))
    return append_columns(named, "text", FP, _digest, keep=["doc_id"])


def huge_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = HUGE) -> DataFrame:
    """(doc_id, fp1, fp2, n_bytes) with the chunks of every text hashed as rows of their own.

    For documents that one task should not hash alone (:func:`exact_groups` does not use it: it holds a text to
    compare it anyway); the value equals :func:`fingerprint`. Chunk rows are dealt out by (id, chunk number), and a
    document's few chunk fingerprints are folded in order by an aggregate.
    Ids must be unique. Empty and null texts give (0, 0, 0).
    """
    n = F.greatest(F.ceil(F.length("text") / size), F.lit(1))
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                        F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    chunks = named.select("doc_id", F.explode(F.transform(F.sequence(F.lit(0), n.cast("int") - 1), lambda i: F.struct(
        i.alias("no"), F.substring(F.col("text"), i * size + 1, F.lit(size)).alias("part")))).alias("c"))
    chunks = chunks.select("doc_id", "c.no", F.col("c.part").alias("part"))
    parts = append_columns(chunks.repartition("doc_id", "no"), "part", FP, _digest, keep=["doc_id", "no"])
    folded = parts.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("no", "fp1", "fp2", "n_bytes"))).alias("parts"))

    def fold(batches):
        for b in batches:
            out = []
            for parts_ in b.column("parts").to_pylist():
                h, size_ = (0, 0), 0
                for x in parts_:
                    h, size_ = combine(h, (x["fp1"], x["fp2"]), x["n_bytes"]), size_ + x["n_bytes"]
                out.append((*h, size_))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array([o[i] for o in out], pa.int64()) for i in range(3)]],
                                             names=["doc_id", "fp1", "fp2", "n_bytes"])

    return folded.mapInArrow(fold, "doc_id long, fp1 long, fp2 long, n_bytes long")


def _same(a: bytes, b: bytes) -> bool:
    """Chunk by chunk; stops at the first chunk that differs."""
    return len(a) == len(b) and all(a[i:i + CHUNK] == b[i:i + CHUNK] for i in range(0, len(a), CHUNK))


def _classes(batches):
    """Rows arrive sorted by (fingerprint, salt). Gives each row the sha256 of the class its text equals.

    Memory: one text per different text of the fingerprint at hand, which is
    one but for a hash collision.
    """
    kept = ["doc_id", "row", "fp1", "fp2", "n_bytes", "n_points", "text_sha256"]
    here, known = None, []
    for b in slices(batches, "norm"):
        keys = zip(*[b.column(c).to_pylist() for c in ("fp1", "fp2", "n_bytes", "salt")])
        found = []
        for at, norm, sha in zip(keys, b.column("norm").to_pylist(), b.column("text_sha256").to_pylist()):
            if at != here:
                here, known = at, []
            equal = next((s for s, t in known if _same(t, norm)), None)
            if equal is None:
                equal = sha
                known.append((sha, norm))
            found.append(equal)
        yield pa.RecordBatch.from_arrays([*[b.column(c) for c in kept], pa.array(found, pa.string())],
                                         names=[*kept, "class_sha256"])


def _decided(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows whose fingerprint no other has, the others with their class's survivor, and the repeated fingerprints."""
    rows = stored(fingerprint_rows(docs, id_col, text_col), "dedup-fingerprints")
    key = ["fp1", "fp2", "n_bytes"]
    # written, so that a fingerprint that holds a third of the rows meets a plain table and its partition can be split
    groups = stored(rows.groupBy(*key).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1"), "dedup-groups")
    alone = rows.join(groups, key, "left_anti")
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                         F.monotonically_increasing_id().alias("row"))
    pages = _repeated_pages(groups)
    texts = append_columns(source, "text", f"{FP}, norm binary", lambda t: _digest_repeated(t, pages.value), keep=["doc_id", "row"])
    texts = texts.where("norm is not null").join(groups, key)
    # the salt bounds what one task streams of a hot fingerprint
    texts = texts.withColumn("salt", F.pmod(F.xxhash64("row"), F.ceil(F.col("rows") / SALT_ROWS)).cast("int"))
    order = [*key, "salt"]
    cols = ["doc_id", "row", *key, "n_points", "text_sha256", "salt", "norm"]
    out = "doc_id long, row long, fp1 long, fp2 long, n_bytes long, n_points long, text_sha256 string, class_sha256 string"
    streamed = texts.select(*cols).repartition(*order).sortWithinPartitions(*order)
    compared = stored(streamed.mapInArrow(_classes, out), "dedup-compared")
    # salts of one text meet under its digest; texts that only collide in the fingerprint stay apart
    part = [*key, "class_sha256"]
    best = F.max(F.struct(F.col("doc_id").isNotNull().alias("has_id"), F.when(F.col("doc_id").isNotNull(), F.col("n_points")).alias("points"),
                          (-F.col("doc_id")).alias("neg_id"), F.col("n_points").alias("no_id_points"), (-F.col("row")).alias("neg_row")))
    classes = stored(compared.groupBy(*part).agg(F.count(F.lit(1)).alias("group_size"), (-best["neg_id"]).alias("keep_id"),
                                                 (-best["neg_row"]).alias("keep_row")), "dedup-keepers")
    grouped = compared.join(classes, part).select(
        "doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")
    return alone, grouped, groups


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after deleting the bytes of ``[\\x20\\x09-\\x0D]``;
    null counts as empty. Of equal texts the row with the most code points stays,
    then that of the smallest id; exactly one row of a group has ``kept``. Null ids: such a row is a member, and stays only
    when no row of its group has an id (keep_id is null then); rows that share the keeper's id are
    counted each and one of them stays. A very long text is held by one task, chunk by chunk hashed and compared. An empty
    table gives an empty result; other columns are ignored.
    """
    alone, grouped, _ = _decided(docs, id_col, text_col)
    return grouped.unionByName(alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
                                            F.lit(True).alias("kept"), "text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that stay, with all their columns (of any name); the decisions are those of :func:`exact_groups`.

    A decision holds for an id and a text, so rows that share an id (or have none) stay or go by their own texts; of rows with the
    keeper's id and an equal text, the one with the most code points stays. Documents whose fingerprint no other
    has stay without a shuffle.
    """
    _, grouped, groups = _decided(docs, id_col, text_col)
    # rows of the keeper's id and text: one in general, several if rows repeat
    kept = stored(grouped.where("doc_id <=> keep_id").groupBy(F.col("doc_id").alias("kept_id"), F.col("text_sha256").alias("kept_sha")).agg(
        F.count(F.lit(1)).alias("rows")), "dedup-kept")
    pages = _repeated_pages(groups)
    text = F.col(f"`{text_col}`").cast("string")
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(f"`{id_col}`").cast("long").alias("id"),
                        text.alias("text"), F.coalesce(F.length(text), F.lit(0)).alias("points"))
    keyed = append_columns(whole, "text", "sha string", lambda t: [_digest_repeated(t, pages.value)[4]], keep=["whole", "id", "points", "text"])
    # the exact decision on what the bitmap lets through: texts that are alone have no class
    repeated = keyed.where("sha is not null")
    of_class = grouped.select(F.col("text_sha256").alias("class_sha")).distinct()
    rows = repeated.join(kept, F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("sha") == F.col("kept_sha")))
    once = rows.where("rows = 1").select("whole")
    longest = F.max_by("whole", F.struct("points", F.coalesce("text", F.lit(""))))
    several = rows.where("rows > 1").groupBy("kept_id", "kept_sha").agg(longest.alias("whole")).select("whole")
    single = repeated.join(of_class, F.col("sha") == F.col("class_sha"), "left_anti").select("whole")
    return keyed.where("sha is null").select("whole").unionByName(once).unionByName(several).unionByName(single).select("whole.*")


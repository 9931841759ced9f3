"""SimHash near-dedup by multi-index hashing.

A fingerprint has a bit set where more than half of a text's shingle hashes have it. Two fingerprints
with at most 3 differing bits differ by at most one bit in one of their two 32-bit segments.
So every distinct fingerprint is stored in one table per segment, and looks up the Hamming ball of radius one
around its own segment value; what it meets is verified over all 64 bits. Only the half of the ball with a
bit cleared is enumerated: of two values one bit apart, the one with the bit set finds the other.

A table entry that holds very many fingerprints is not compared all against all: its fingerprints are
indexed again by halves of the bits that are left, down to entries of at most 2^8 fingerprints.
Equal fingerprints are one node, so copies cost one row each.
"""
from __future__ import annotations

from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..session import stored
from .common import LOWER, append_columns
from .jaccard_join import components

BITS, RADIUS = 64, 3
SHINGLE, SEED = 3, 42
# Shingles whose bits are counted at once, so a very long text needs bounded memory beside itself.
PIECE = 1 << 16
# Entries of a segment table with more fingerprints than this are indexed again by what is left of the bits.
# Not below 2^8: entries of the last tables differ in 8 bits only and can't hold more.
ENTRY = 256


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text's word shingles, repeats included; no words: 0."""
    words = (text or b"").translate(LOWER).split()  # splits at [\x20\x09-\x0D]
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    n = max(1, len(words) - shingle + 1)
    starts, ends = starts[:n].tolist(), ends[-n:].tolist()
    ones = np.zeros(BITS, np.int64)
    for at in range(0, n, PIECE):
        cut = map(joined.__getitem__, map(slice, starts[at:at + PIECE], ends[at:at + PIECE]))
        hashes = np.fromiter(map(xxh64_intdigest, cut, repeat(seed)), np.uint64, min(PIECE, n - at))
        ones += _bit_counts(hashes)
    return int(sum(1 << i for i in np.flatnonzero(2 * ones > n).tolist()))


def _bit_counts(hashes: np.ndarray) -> np.ndarray:
    """How many hashes have each bit, lowest first."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return bits.sum(axis=0, dtype=np.int64)


def fingerprint_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """(doc_id, fp) for every document; fp is the fingerprint as a signed long."""
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))

    def run(texts):
        prints = np.array([fingerprint(t, shingle, seed) for t in texts], dtype=np.uint64)
        return [pa.array(prints.view(np.int64))]

    return append_columns(named, "text", "fp long", run, keep=["doc_id"])


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


class Segment:
    """Bits [low, low + width) of a fingerprint, looked up together with the bits of the tables above (``fixed``)."""

    def __init__(self, no: int, low: int, width: int, fixed: int):
        self.no, self.low, self.width = no, low, width
        self.mask = fixed | ((1 << width) - 1) << low

    def value(self, fp: Column) -> Column:
        return fp.bitwiseAND(F.lit(_signed(self.mask)))

    def flips(self) -> list[int]:
        return [_signed(1 << b) for b in range(self.low, self.low + self.width)]


def _halves(low: int, width: int, fixed: int, no: int) -> list[Segment]:
    half = width // 2
    return [Segment(2 * no, low, half, fixed), Segment(2 * no + 1, low + half, half, fixed)]


def _place(s: Segment, value: Column) -> Column:
    return F.struct(F.lit(s.no).alias("no"), value.alias("value"))


def _exploded(rows: DataFrame, places: list[Column]) -> DataFrame:
    """One row (no, value, fp) for every place of the arrays; null arrays have none."""
    none = F.array().cast("array<struct<no:int,value:bigint>>")
    return rows.select(F.explode(F.concat(*[F.coalesce(p, none) for p in places])).alias("at"), "fp").select("at.no", "at.value", "fp")


def _cleared(s: Segment) -> Column:
    """The segment's value with each of its set bits cleared in turn."""
    fp = F.col("fp")
    ones = F.filter(F.array(*[F.lit(x) for x in s.flips()]), lambda bit: fp.bitwiseAND(bit) != 0)
    return F.transform(ones, lambda bit: _place(s, s.value(fp.bitwiseXOR(bit))))


def _first_tables(prints: DataFrame) -> tuple[DataFrame, DataFrame, list[Segment]]:
    """Table rows and look-ups (no, value, fp) of the two 32-bit segments.

    A fingerprint is in its own entry and looks up the entries with one of its set bits cleared.
    """
    segments = _halves(0, BITS, 0, 0)
    entries = _exploded(prints, [F.array(*[_place(s, s.value(F.col("fp"))) for s in segments])])
    # every row looks up its own entry too: pairs that agree in the whole segment
    return entries, entries.unionByName(_exploded(prints, [_cleared(s) for s in segments])), segments


def _rest(s: Segment) -> tuple[int, int]:
    """The bits (low, width) that the tables so far have not fixed: the other half of the last split."""
    free = ~s.mask & ((1 << BITS) - 1)
    low = (free & -free).bit_length() - 1
    return low, free.bit_length() - low


def _ball(s: Segment, at: Column) -> Column:
    """``at`` and its neighbours at one flipped bit of the segment."""
    flips = F.array(F.lit(0).cast("long"), *[F.lit(x) for x in s.flips()])
    return F.transform(flips, lambda bit: _place(s, at.bitwiseXOR(bit)))


def _next_tables(entries: DataFrame, probes: DataFrame, segments: list[Segment]) -> tuple[DataFrame, DataFrame, list[Segment]]:
    """Rows of crowded entries, indexed by the halves of the bits that are left.

    Both sides agree in the value looked up so far, which the new value keeps; with at most
    3 differing bits in the rest, they differ by at most one bit in one of its halves.
    """
    nexts, own, balls = [], [], []
    for s in segments:
        mine = F.col("no") == s.no
        for h in _halves(*_rest(s), s.mask, s.no):
            nexts.append(h)
            at = F.col("value").bitwiseOR(F.col("fp").bitwiseAND(F.lit(_signed(h.mask & ~s.mask))))
            own.append(F.when(mine, F.array(_place(h, at))))
            balls.append(F.when(mine, _ball(h, at)))
    return _exploded(entries, own), _exploded(probes, balls), nexts


def _near(a: Column, b: Column, radius: int = RADIUS) -> Column:
    return F.bit_count(a.bitwiseXOR(b)) <= radius


def links(prints: DataFrame, entry: int = ENTRY) -> DataFrame:
    """(a, b): distinct fingerprints (column ``fp``, each once) at 1 to 3 differing bits, every such pair once, a < b."""
    if entry < 1 << 8:
        raise ValueError("entries of the last tables may hold 2^8 fingerprints")
    entries, probes, segments = _first_tables(prints)
    key, found = ["no", "value"], []
    while True:
        members = entries.groupBy(*key).agg(F.count(F.lit(1)).alias("members"))
        crowded = stored(members.where(F.col("members") > entry).select(*key), "simhash-crowded")
        more = not crowded.isEmpty()
        few, asking = (entries.join(crowded, key, "left_anti"), probes.join(crowded, key, "left_anti")) if more else (entries, probes)
        met = few.withColumnRenamed("fp", "a").join(asking.withColumnRenamed("fp", "b"), key)
        met = met.where((F.col("a") != F.col("b")) & _near(F.col("a"), F.col("b")))
        found.append(stored(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "simhash-links"))
        if not more:
            return reduce(DataFrame.unionByName, found).distinct()
        entries, probes, segments = _next_tables(entries.join(crowded, key, "left_semi"), probes.join(crowded, key, "left_semi"), segments)
        entries, probes = stored(entries, "simhash-entries"), stored(probes, "simhash-probes")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 lowercase hex digits), component_id.

    Words are runs without white space bytes, A-Z lower-cased; shingles of ``shingle`` words count as often as they
    occur, and fewer words are one shingle. Null, empty and wordless texts have the fingerprint zero, which links
    like any other. Fingerprints link at 3 or fewer differing bits; component_id is the smallest
    doc_id reachable. A row with a null doc_id links like the others and never names a component
    (null if no row of the component has an id); rows that share a doc_id are placed by their own texts;
    repeated rows stay; other columns are ignored; an empty table gives no rows.
    """
    rows = stored(fingerprint_rows(docs, id_col, text_col, shingle, seed), "simhash-prints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("rows")), "simhash-distinct")
    found = components(links(prints.select("fp")))
    # a component's smallest fingerprint has no row of its own there
    groups = stored(found.unionByName(found.select(F.col("component").alias("node"), "component")).distinct(), "simhash-groups")
    # only fingerprints that several rows share or that have a link need a look-up of their component
    placed = prints.join(groups, prints.fp == groups.node, "left").select("fp", "least", "rows", "component")
    named = placed.where("component is not null").groupBy("component").agg(F.min("least").alias("smallest"))
    linked = placed.where("component is not null").join(named, "component").select("fp", F.col("smallest").alias("component_id"))
    shared = placed.where("component is null and rows > 1").select("fp", F.col("least").alias("component_id"))
    found = stored(linked.unionByName(shared).withColumn("known", F.lit(True)), "simhash-components")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    return rows.join(found, "fp", "left").select(
        "doc_id", hexed, F.when(F.col("known"), F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))

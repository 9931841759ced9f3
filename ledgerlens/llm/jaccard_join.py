"""N-gram Jaccard self-join by a universe-partition pigeonhole.

The universe of shingles is hashed into segments, with one segmentation per size band
(sizes of a band differ by less than the threshold's ratio, so a pair lies in one band or in
neighbouring ones). Two sets over the threshold differ in at most h shingles. Give each
segment of one of them (the probe) a budget: nothing, an exact match (worth 1), or a match up
to one shingle (worth 2). When the budgets add up to h + 1, a partner must meet one of them.
Every set is indexed by its segment subsets and by the one-deletion neighbourhoods of small
segments; a probe buys its h + 1 units at the lowest cost, where a unit's cost is what a
sketch of shingle frequencies expects it to match. Candidates are verified
exactly on the texts.

Equal sets collapse to one representative first. Rows that meet in a signature are checked
against its most central member (the one that meets most others), and only components that this
leaves apart are compared further, so a group of near copies costs about one check a member and
signature, and no link is lost. A parity sketch of every set rules pairs out before their texts
are fetched: the number of bits in which two sketches differ never exceeds the sets' difference.
"""
from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import LOWER, append_columns, slices, utf8

# Words of a shingle, and the Jaccard threshold as a fraction of whole numbers (defaults of the operators' arguments).
SHINGLE = 4
NUM, DEN = 85, 100
# Segments beyond the most that a probe of the band can need, so that it can leave out costly ones.
SLACK = 0.2
# One-deletion neighbourhoods are indexed for segments of this size and bought by probes for segments one smaller.
DELETED = 3
SKETCH = 1 << 18
SKETCH_PART = 1 << 12
# Bits of a set's parity sketch, held in words of 64.
PARITY = 1024
MIX = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def shingle_set(text: bytes | None, n: int = SHINGLE) -> set:
    """Distinct n-word shingles; fewer words are one shingle; no words, none."""
    words = words_of(text)
    if len(words) < n:
        return {tuple(words)} if words else set()
    return set(zip(*[words[i:] for i in range(n)]))


def shingle_hashes(texts: list[bytes | None], n: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit shingle hashes of the texts, one text after another and sorted inside, and their numbers."""
    digest = xxhash.xxh3_64_intdigest
    memo: dict[bytes, int] = {}
    parts = []
    for t in texts:
        words = words_of(t)
        if not words:
            parts.append(np.empty(0, np.uint64))
            continue
        for w in set(words):
            if w not in memo:
                memo[w] = digest(w)
        h = np.fromiter((memo[w] for w in words), dtype=np.uint64, count=len(words))
        if len(h) < n:
            x = np.full(1, len(h), dtype=np.uint64)
            for v in h:
                x = mix(x * MIX + v)
        else:
            x = np.full(len(h) - n + 1, n, dtype=np.uint64)
            for i in range(n):
                x = mix(x * MIX + h[i:len(h) - n + 1 + i])
        parts.append(np.unique(x))
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), sizes


class Bands:
    """Size bands: band k holds sizes starts[k] to starts[k + 1] - 1; partners lie in the same or a neighbouring band."""

    def __init__(self, num: int = NUM, den: int = DEN, slack: float = SLACK):
        self.num, self.den = num, den
        starts = [1]
        while starts[-1] < 1 << 40:
            # the first size that is no partner of the band's first one
            starts.append(max(starts[-1] + 1, starts[-1] * den // num + 1))
        self.starts = np.array(starts, dtype=np.int64)
        last = self.starts[1:] - 1
        # the largest difference between a set of the band and a partner of its own or the next band
        most = last * (den - num) // num
        self.segments = (np.ceil((most + 1) * (1 + slack)) + 1).astype(np.int64)
        self.top = last

    def of(self, sizes: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.starts, sizes, side="right") - 1

    def difference(self, sizes: np.ndarray, bands: np.ndarray) -> np.ndarray:
        """Largest difference between a probe of the given size and a partner indexed in the band."""
        partner = np.minimum(self.top[bands], sizes * self.den // self.num)
        return (self.den - self.num) * (sizes + partner) // (self.den + self.num)


BANDS = Bands()


def signatures(hashes: np.ndarray, sizes: np.ndarray, sketch: np.ndarray, bands: Bands = BANDS):
    """Index and probe keys of sets that hold more than no shingle: (key, set number, is_index, is_probe).

    Sets too small to have a partner that differs (every difference breaks the threshold) give none.
    """
    out = [[], [], [], []]
    own = bands.of(sizes)
    for lower in (0, 1):
        band = own - lower
        usable = (sizes > 0) & (band >= 0)
        if lower:
            usable &= sizes * bands.num <= bands.top[np.maximum(band, 0)] * bands.den
        usable &= bands.difference(sizes, np.maximum(band, 0)) > 0
        sets = np.flatnonzero(usable)
        if not len(sets):
            continue
        member = np.repeat(usable, sizes)
        x = hashes[member]
        _signatures(x, sizes[sets], band[sets], sets, sketch, bands, lower == 0, out)
    if not out[0]:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, bool), np.empty(0, bool)
    return tuple(np.concatenate(c) for c in out)


def _signatures(x, sizes, band, names, sketch, bands, index, out) -> None:
    count = bands.segments[band]
    first = np.cumsum(count) - count
    total = int(count.sum())
    doc = np.repeat(np.arange(len(sizes)), sizes)
    spread = mix(x ^ np.uint64(0xA5A5A5A5A5A5A5A5))
    seg = first[doc] + (spread % count[doc].astype(np.uint64)).astype(np.int64)
    order = np.argsort(seg, kind="stable")
    seg, x = seg[order], mix(x[order] * MIX)
    held = np.bincount(seg, minlength=total)
    some = np.flatnonzero(held)
    starts = np.cumsum(held) - held
    sums = np.zeros(total, dtype=np.uint64)
    costs = np.full(total, 1e12)  # an empty segment matches every set that lacks it too
    if len(x):
        sums[some] = np.add.reduceat(x, starts[some])
        costs[some] = np.minimum.reduceat(sketch[(x & np.uint64(SKETCH - 1)).astype(np.int64)], starts[some])
    owner = np.repeat(np.arange(len(sizes)), count)
    place = np.arange(total) - first[owner]
    salt = mix(band[owner].astype(np.uint64) * MIX + place.astype(np.uint64) + np.uint64(1))
    exact = mix(sums ^ salt)
    deleted = mix((sums[seg] - x) ^ salt[seg])  # of every shingle, its segment without it
    # the deletion neighbourhood of the index and the exact subsets share one key space: a deleted
    # triple meets the pair itself, which only a probe that bought the neighbourhood asks for
    tag = np.uint64(0x6A09E667F3BCC909)
    # units: exact (cost of the segment), and on top the neighbourhood of a segment of DELETED - 1 shingles
    near = np.flatnonzero(held == DELETED - 1)
    need = bands.difference(sizes, band) + 1
    unit_seg = np.concatenate([np.arange(total), near])
    unit_cost = np.concatenate([costs, costs[near] * 4 + 1])
    kind = np.concatenate([np.zeros(total, bool), np.ones(len(near), bool)])
    by = np.lexsort((kind, unit_cost, owner[unit_seg]))
    rank = np.arange(len(by)) - np.repeat(_starts(owner[unit_seg][by], len(sizes)), np.bincount(owner[unit_seg], minlength=len(sizes)))
    bought = np.zeros(len(by), dtype=bool)
    bought[by] = rank < need[owner[unit_seg][by]]
    probe = bought[:total]
    wide = np.zeros(total, dtype=bool)
    wide[near] = bought[total:]

    def emit(keys, segs, is_index, is_probe):
        out[0].append(keys)
        out[1].append(names[owner[segs]])
        out[2].append(np.broadcast_to(is_index, len(keys)))
        out[3].append(np.broadcast_to(is_probe, len(keys)))

    everything = np.arange(total)
    if index:
        emit(exact, everything, True, probe)
        triple = held[seg] == DELETED
        emit(deleted[triple] ^ tag, seg[triple], True, False)
    else:
        emit(exact[probe], everything[probe], False, True)
    # a bought neighbourhood: a partner with one shingle less, or with one more
    less = wide[seg]
    emit(deleted[less], seg[less], False, True)
    emit(exact[wide] ^ tag, everything[wide], False, True)


def _starts(sorted_owner: np.ndarray, n: int) -> np.ndarray:
    count = np.bincount(sorted_owner, minlength=n)
    return np.cumsum(count) - count


def parities(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Per set PARITY bits as words: bit b is set when an odd number of its shingles hash to b."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    at = owner * PARITY + (mix(hashes + MIX) % np.uint64(PARITY)).astype(np.int64)
    odd = (np.bincount(at, minlength=len(sizes) * PARITY) & 1).astype(np.uint8)
    return np.packbits(odd.reshape(len(sizes), PARITY), axis=1, bitorder="little").view(np.int64)


def shingle_rows(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, n, f1, f2, parity) per document; and per task the sketch of shingle frequencies in parts (part, counts)."""
    def run(batches):
        sketch = np.zeros(SKETCH, dtype=np.int64)
        known: set = set()
        names = ["doc_id", "n", "f1", "f2", "parity", "part", "counts"]
        words = pa.list_(pa.int64())
        for b in slices(batches, "text"):
            x, sizes = shingle_hashes(utf8(b.column("text")), shingle)
            starts = np.cumsum(sizes) - sizes
            f1, f2 = np.zeros(len(sizes), np.uint64), np.zeros(len(sizes), np.uint64)
            some = np.flatnonzero(sizes)
            if len(some):
                f1[some] = np.add.reduceat(x, starts[some])
                f2[some] = np.add.reduceat(mix(x * MIX), starts[some])
            parity = pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * (PARITY // 64)),
                                              pa.array(parities(x, sizes).reshape(-1)))
            # equal sets of a task count once
            fresh = np.zeros(len(sizes), dtype=bool)
            for i in some:
                at = (int(f1[i]), int(f2[i]))
                if at not in known:
                    known.add(at)
                    fresh[i] = True
            if len(known) > 1_000_000:
                known.clear()
            x = mix(x[np.repeat(fresh, sizes)] * MIX)
            sketch += np.bincount((x & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(sizes), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), parity,
                 pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        parts = range(0, SKETCH, SKETCH_PART)
        n = len(parts)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(n, pa.int64())] * 4 + [pa.nulls(n, words), pa.array(range(n), pa.int32()), pa.array([sketch[i:i + SKETCH_PART].tobytes() for i in parts], pa.binary())],
            names=names)

    return docs.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, parity array<long>, part int, counts binary")


def _sketch(rows: DataFrame) -> np.ndarray:
    """Sum of the tasks' sketches, part by part; the result has SKETCH numbers whatever the corpus."""
    def add(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for part, counts in zip(b.column("part").to_pylist(), b.column("counts").to_pylist()):
                held[part] = held.get(part, 0) + np.frombuffer(counts, dtype=np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([v.tobytes() for v in held.values()], pa.binary())],
                                         names=["part", "counts"])

    parts = rows.where("part is not null").select("part", "counts")
    summed = parts.mapInArrow(add, "part int, counts binary").repartition("part").mapInArrow(add, "part int, counts binary")
    out = np.zeros(SKETCH, dtype=np.int64)
    for r in summed.collect():
        out[r["part"] * SKETCH_PART:(r["part"] + 1) * SKETCH_PART] += np.frombuffer(r["counts"], dtype=np.int64)
    return out


def signature_rows(docs: DataFrame, sketch, shingle: int = SHINGLE, bands: Bands = BANDS) -> DataFrame:
    """(key, doc_id, is_index, is_probe) of every document; equal sets of a task give their rows once."""
    def run(batches):
        known: set = set()
        for b in slices(batches, "text"):
            ids = b.column("doc_id").to_numpy(zero_copy_only=False)
            x, sizes = shingle_hashes(utf8(b.column("text")), shingle)
            ends = np.cumsum(sizes)
            keep = np.zeros(len(sizes), dtype=bool)
            for i in np.flatnonzero(sizes):
                at = xxhash.xxh3_128_digest(x[ends[i] - sizes[i]:ends[i]].tobytes())
                if at not in known:
                    known.add(at)
                    keep[i] = True
            if len(known) > 500_000:
                known.clear()
            x = x[np.repeat(keep, sizes)]
            key, doc, index, probe = signatures(x, sizes[keep], sketch.value, bands)
            yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(ids[keep].astype(np.int64)[doc]),
                                              pa.array(index.astype(np.int8) + 2 * probe.astype(np.int8), pa.int8())],
                                             names=["key", "doc_id", "role"])

    return docs.where("doc_id is not null").mapInArrow(run, "key long, doc_id long, role tinyint")


def _verify(batches: Iterator[pa.RecordBatch], shingle: int = SHINGLE, num: int = NUM, den: int = DEN):
    """Rows (a, b, text_a, text_b) that reach the threshold, sorted by a so that its set is built once."""
    here, left, left_text = None, None, None
    for b in slices(batches, "text_b"):
        a_ids, b_ids = b.column("a"), b.column("b")
        ok = []
        for a, ta, tb in zip(a_ids.to_pylist(), utf8(b.column("text_a")), utf8(b.column("text_b"))):
            if a != here or ta != left_text:
                here, left_text, left = a, ta, shingle_set(ta, shingle)
            right = shingle_set(tb, shingle)
            both = len(left & right)
            ok.append(bool(both) and den * both >= num * (len(left) + len(right) - both))
        yield pa.RecordBatch.from_arrays([a_ids, b_ids, pa.array(ok, pa.bool_())], names=["a", "b", "linked"])


def _possible(na, pa_, nb, pb, num: int, den: int):
    """Whether two sets can reach the threshold, from their sizes and parity sketches."""
    differ = sum((F.bit_count(pa_[i].bitwiseXOR(pb[i])) for i in range(PARITY // 64)), F.lit(0))
    return ((den * F.least(na, nb) >= num * F.greatest(na, nb)) & ((den + num) * differ <= (den - num) * (na + nb)))


def _links(pairs: DataFrame, docs: DataFrame, features: DataFrame, shingle: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose texts reach the threshold; texts are fetched for possible pairs only."""
    fa = features.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    fb = features.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    fit = stored(pairs.join(fa, "a").join(fb, "b").where(_possible(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), num, den)).select("a", "b"),
                 "jaccard-pairs")
    ids = fit.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct()
    texts = stored(docs.where("doc_id is not null").join(ids, "doc_id", "left_semi"), "jaccard-texts")
    left = texts.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b"))
    rows = fit.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b").sortWithinPartitions("a")

    def verify(batches):
        return _verify(batches, shingle, num, den)

    return stored(rows.mapInArrow(verify, "a long, b long, linked boolean").where("linked").select("a", "b"), "jaccard-links")


def _placed(met: DataFrame, groups: DataFrame, features: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members of signatures that hold several components: those outside the signature's largest one, and all."""
    placed = met.join(groups, met.doc_id == groups.node, "left").select(
        "key", "doc_id", "role", "degree", F.coalesce("component", "doc_id").alias("component"))
    per = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("rows"))
    main = (per.groupBy("key").agg(F.max(F.struct("rows", "component")).alias("main"), F.count(F.lit(1)).alias("parts"))
            .where("parts > 1").select("key", F.col("main.component").alias("main")))
    members = stored(placed.join(main, "key").join(features, "doc_id"), "jaccard-open")
    return members.where("component <> main"), members


def _apart(few: DataFrame, rest: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs of different components that meet in a signature, one indexed and one probing, and may reach the threshold."""
    a = few.select("key", F.col("doc_id").alias("a"), F.col("role").alias("ra"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("parity").alias("pa"))
    b = rest.select("key", F.col("doc_id").alias("b"), F.col("role").alias("rb"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("parity").alias("pb"))
    roles = F.expr("(ra & 1 > 0 and rb & 2 > 0) or (ra & 2 > 0 and rb & 1 > 0)")
    possible = _possible(F.col("na"), F.col("pa"), F.col("nb"), F.col("pb"), num, den)
    return (a.join(b, "key").where((F.col("ca") != F.col("cb")) & roles & possible)
            .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, by alternating large-star and small-star rounds."""
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    pairs = stored(pairs, "cc")
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        nxt = small.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(
            least.select("u", F.col("m").alias("v"))).distinct()
        nxt = stored(nxt, "cc")
        same = nxt.count() == pairs.count() and nxt.join(pairs, ["u", "v"], "left_anti").isEmpty()
        pairs = nxt
        if same:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("component"))


def _met(docs: DataFrame, id_col: str, text_col: str, shingle: int, num: int, den: int):
    """Documents, sets, equal sets with their representatives, features of these, and the signatures where several of them meet."""
    bands = Bands(num, den)
    spark = docs.sparkSession
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    rows = stored(shingle_rows(named, shingle), "jaccard-sets")
    sets = rows.where("part is null").select("doc_id", "n", "f1", "f2", "parity")
    sketch = spark.sparkContext.broadcast(_sketch(rows))  # SKETCH numbers
    # equal sets: one representative (written, so that the join with a group of many copies can be split)
    reps = stored(sets.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("rows"), F.any_value("parity").alias("parity")), "jaccard-representatives")
    equal = stored(sets.where("n > 0 and doc_id is not null").join(reps.where("rows > 1"), ["n", "f1", "f2"]).select("doc_id", "rep"), "jaccard-equal")
    features = reps.select(F.col("rep").alias("doc_id"), "n", "parity")
    # signatures met by an indexed set and a probing one
    by_key = Window.partitionBy("key")
    raw = (signature_rows(named, sketch, shingle, bands).repartition("key")
           .withColumn("first", F.min("doc_id").over(by_key)).withColumn("last", F.max("doc_id").over(by_key))
           .withColumn("roles", F.bit_or("role").over(by_key)).where("first < last and roles = 3"))
    # members by their representatives; a key that only joins equal sets is done
    member = equal.where("doc_id <> rep").select("doc_id", "rep").distinct()
    raw = stored(raw.select("key", "doc_id", "role").join(member, "doc_id", "left")
                 .groupBy("key", F.coalesce("rep", "doc_id").alias("doc_id")).agg(F.bit_or("role").alias("role")), "jaccard-raw")
    several = raw.groupBy("key").agg(F.count(F.lit(1)).alias("members")).where("members > 1")
    met = raw.join(several, "key")
    return named, sets, equal, features, met


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Words are runs without white space bytes, A-Z lower-cased; a set holds the distinct shingles of ``shingle`` words, or the whole
    sequence of fewer words. Documents link at a Jaccard similarity of ``num / den`` or more;
    component_id is the smallest doc_id reachable. Null, empty and wordless texts have no
    shingles and are their own component; a null doc_id has a null component_id and links nothing; rows that
    share a doc_id are one node with the links of all their texts; other columns are ignored.
    """
    named, sets, equal, features, met = _met(docs, id_col, text_col, shingle, num, den)
    degrees = met.groupBy("doc_id").agg(F.sum("members").alias("degree"))
    met = stored(met.drop("members").join(degrees, "doc_id"), "jaccard-met")
    central = F.max(F.struct(F.col("degree"), (-F.col("doc_id")).alias("neg")))
    # first against the most central member of each signature
    hubs = met.groupBy("key").agg((-central["neg"]).alias("hub"))
    star = (met.join(hubs, "key").where("doc_id <> hub")
            .select(F.least("hub", "doc_id").alias("a"), F.greatest("hub", "doc_id").alias("b")).distinct())
    links = _links(star, named, features, shingle, num, den)
    # then what this leaves apart against the most central member of every other component of the signature
    few, members = _placed(met, components(links), features)
    heads = members.groupBy("key", "component").agg((-central["neg"]).alias("doc_id"))
    links = links.unionByName(_links(_apart(few, members.join(heads, ["key", "component", "doc_id"], "left_semi"), num, den), named, features, shingle, num, den))
    # and at last every pair of members that are still in different components
    few, members = _placed(met, components(links), features)
    links = links.unionByName(_links(_apart(few, members, num, den), named, features, shingle, num, den))
    shared = equal.where("doc_id <> rep").select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    final = components(links.unionByName(shared))
    return (sets.join(final, sets.doc_id == final.node, "left")
            .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id")))


def jaccard_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                  num: int = NUM, den: int = DEN) -> DataFrame:
    """(a, b), a < b: every link between representatives, the smallest ids of equal sets; rules as in :func:`jaccard_components`.

    All pairs that meet in a signature are verified, inside components too, so the cost follows the number of such
    pairs: the square of a group of near (not equal) copies. Equal sets are not listed as links.
    """
    named, _, _, features, met = _met(docs, id_col, text_col, shingle, num, den)
    # every member as a component of its own: no pair is left out
    members = stored(met.join(features, "doc_id").withColumn("component", F.col("doc_id")), "jaccard-members")
    return _links(_apart(members, members, num, den), named, features, shingle, num, den).distinct()


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                num: int = NUM, den: int = DEN) -> DataFrame:
    """The documents whose id names their component, with all their columns."""
    kept = jaccard_components(docs, id_col, text_col, shingle, num, den).where("doc_id = component_id or doc_id is null").select(
        F.col("doc_id").alias("kept_id")).distinct()
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("whole"), F.col(f"`{id_col}`").cast("long").alias("id"))
    return whole.join(kept, F.col("id").eqNullSafe(F.col("kept_id"))).select("whole.*")


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS words
  FROM documents),
s AS (SELECT doc_id, list_distinct(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
        ELSE [array_to_string(words[i:i+3], ' ') FOR i IN range(1, len(words) - 2)] END) AS sh FROM w),
e AS (SELECT doc_id, unnest(sh) AS x, len(sh) AS n FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.x = b.x AND a.doc_id <> b.doc_id
      GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
r(a, b) AS (SELECT doc_id, doc_id FROM s UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.sh
"""

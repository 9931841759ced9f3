"""Merkle manifest, SimHash near-dedup and hard-negative mining against brute force."""
import hashlib
import random
import re
import zlib

import numpy as np
import xxhash
from pyspark.sql import functions as F

from ledgerlens.llm import hard_negatives, merkle, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long, leaf string, tree long, root string, part int, grp string"


def docs_of(spark, rows):
    """Rows (doc_id, source, text) as documents with columns whose names clash with results."""
    return spark.createDataFrame([(i, t, "en" if i else None, s, None if t is None else len(t), "x", 1, "y", 2, "z") for i, s, t in rows], DOCS)


def H(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def up(nodes):
    return [H(nodes[i:i + 16]) for i in range(0, len(nodes), 16)]


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append(up(out[-1]))
    return out


def brute_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root, verified) per row, folding by hashing whole runs again."""
    def leaf(i, s, t):
        return H(["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, s, "en" if i else None, None if t is None else len(t), t)])

    def changed(i, s, t):
        if i is None or t is None or zlib.crc32(str(i).encode()) % 5:
            return leaf(i, s, t)
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t)
        return H(["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, s, "en" if i else None, len(t), low)])

    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in order:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))
        trees[s] = levels_of([leaf(*r) for r in groups[s]])
    top = levels_of([trees[s][-1][0] for s in order])
    root = top[-1][0]
    out = []
    for at, s in enumerate(order):
        for pos, r in enumerate(groups[s]):
            digest, siblings = changed(*r), []
            for tree, p in ((trees[s], pos), (top, at)):
                for nodes in tree[:-1]:
                    run = nodes[p - p % 16:p - p % 16 + 16]
                    siblings += [x for k, x in enumerate(run) if k != p % 16]
                    digest, p = H([digest if k == p % 16 else x for k, x in enumerate(run)]), p // 16
            out.append((r[0], leaf(*r), trees[s][-1][0], root, H(siblings), digest, digest == root))
    return out


def ordered(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def manifest(df):
    return [tuple(r) for r in merkle.merkle_manifest(df, {"text": merkle.tampered_text(F.col("text"), F.col("doc_id"))}).collect()]


ODD = [(1, "b", "Abc"), (2, None, "X"), (3, "b", None), (4, "", "Y"), (None, "b", "Q"), (None, None, None), (7, "é", "Ü Z"), (8, "a", ""),
       (9, "a", "LONG " * 4000), (10, "a", "same"), (10, "a", "same"), (10, "a", "Other")]


def test_manifest_matches_brute_force(spark):
    rows = ODD + [(100 + i, "hot", f"Text {i}") for i in range(300)] + [(1000 + i, f"s{i}", "T") for i in range(40)]
    assert ordered(manifest(docs_of(spark, rows))) == ordered(brute_manifest(rows))


def test_manifest_of_a_group_over_several_chunks(spark):
    rows = [(i, "hot" if i % 5 else "other", "Word" if i % 3 else "word") for i in range(6000)]
    assert ordered(manifest(docs_of(spark, rows))) == ordered(brute_manifest(rows))


def test_manifest_of_few_rows(spark):
    assert manifest(docs_of(spark, [])) == []
    for rows in ([(5, "a", "T")], [(5, None, "T"), (6, "a", None)], [(i, "a", "T") for i in range(17)]):
        assert ordered(manifest(docs_of(spark, rows))) == ordered(brute_manifest(rows))


def test_folding_resumes_a_kept_state():
    nodes = [H([str(i)]).encode() for i in range(300)]
    tree = merkle.Subtree(nodes, 3)
    assert tree.root.decode() == levels_of([n.decode() for n in nodes])[-1][0]
    other = H(["other"])
    for i in (0, 15, 16, 255, 299):
        changed = [other if k == i else n.decode() for k, n in enumerate(nodes)]
        assert tree.fold(i, other.encode()).decode() == levels_of(changed)[-1][0]
        # the left siblings play no part: a tree that lost them folds to the same root
        assert tree.states[0][i].copy().hexdigest() == hashlib.sha256(b"".join(nodes[i - i % 16:i])).hexdigest()


def brute_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    """Component number per item, by comparing every pair."""
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    a = np.array(prints, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[:i]) <= 3):
            x, y = find(i), find(int(j))
            parent[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(a))]


def test_simhash_matches_brute_force(make_docs, odd_rows):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    rows = list(odd_rows) + [(20, "\x0b \x0c"), (21, None), (None, ""), (22, "Word " * 70000)]
    for g in range(12):
        base = [rng.choice(words) for _ in range(300)]
        for c in range(6):
            text = list(base)
            for _ in range(c % 3):
                text[rng.randrange(300)] = rng.choice(words)
            rows.append((100 * (g + 1) + c, " ".join(text)))
    got = [tuple(r) for r in simhash.simhash_components(make_docs(rows)).collect()]
    prints = [brute_print(t) for _, t in rows]
    groups = brute_components(prints)
    least = {}
    for g, (i, _) in zip(groups, rows):
        least[g] = min(least.get(g, 1 << 62), 1 << 62 if i is None else i)
    want = [(i, f"{p:016x}", None if least[g] == 1 << 62 else least[g]) for (i, _), p, g in zip(rows, prints, groups)]
    assert ordered(got) == ordered(want)
    assert len({w[2] for w in want}) < len(rows) - 20  # near copies met


def test_simhash_of_an_empty_table(make_docs):
    assert simhash.simhash_components(make_docs([])).count() == 0


def test_simhash_links_in_crowded_entries(spark):
    """Thousands of fingerprints share a 32-bit segment, so their entries are indexed twice more; no link is lost."""
    rng = np.random.default_rng(3)
    low = rng.integers(0, 1 << 32, 3000, dtype=np.uint64)
    prints = np.concatenate([low, low[:500] ^ np.uint64(0b111), low[:300] ^ np.uint64(1 << 40), (np.uint64(7) << np.uint64(48)) | np.arange(1500, dtype=np.uint64)])
    prints = np.unique(prints)
    df = spark.createDataFrame([(int(x),) for x in prints.view(np.int64)], "fp long")
    got = {(r.a, r.b) for r in simhash.links(df).collect()}
    want, signed = set(), prints.view(np.int64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(prints[i] ^ prints[i + 1:]) <= 3) + i + 1:
            want.add((min(int(signed[i]), int(signed[j])), max(int(signed[i]), int(signed[j]))))
    assert got == want and len(want) > 5000


def brute_negatives(rows, k=5, m=3):
    """rows: {id: (label, vector)}."""
    ints = {i: (lab, [int(np.floor(256 * float(x))) for x in v]) for i, (lab, v) in rows.items()}
    clip = lambda x: max(-2 ** 63, min(2 ** 63 - 1, x))
    out = []
    for a, (lab, v) in ints.items():
        if a % 50:
            continue
        scored = [(-clip(sum(x * y for x, y in zip(v, w))), i, lab == l2) for i, (l2, w) in ints.items() if i != a and len(w) == len(v)]
        for p, pid, _ in sorted(s for s in scored if s[2])[:k]:
            fit = [s for s in sorted(scored) if not s[2] and 50 * -p <= 100 * -s[0] <= 95 * -p][:m]
            out += [(a, pid, r, s[1], -p, -s[0]) for r, s in enumerate(fit, 1)]
    return out


VECS = "vec_id long, embedding array<double>, label int, score double, rank int, dim string, grp string, anchor string"


def vectors_of(spark, rows):
    return spark.createDataFrame([(i, v, lab, 0.5, 9, "x", "y", "z") for i, v, lab in rows], VECS)


def test_hard_negatives_match_brute_force(spark):
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(6, 24))
    rows = [(i, (centres[i % 6] * 0.3 + rng.normal(size=24) * 0.1).tolist(), int(i % 3 if i % 4 else 0)) for i in range(700)]
    rows += [(2000 + i, [0.5] * 24, i % 2) for i in range(60)]  # ties
    for part_rows in (64, 100000):
        got = [tuple(r) for r in hard_negatives.hard_negatives(vectors_of(spark, rows), part_rows=part_rows).collect()]
        assert sorted(got) == sorted(brute_negatives({i: (lab, v) for i, v, lab in rows}))
        assert got


def test_hard_negatives_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(50 * i, [0.1 * (i % 5 + 1), -0.3 + 0.1 * (i % 4), 0.2], i % 2) for i in range(20)]
    good += [(3000 + i, [0.2, 0.1 * (i % 7)], i % 3) for i in range(30)]  # another length
    good += [(5000, [1e12, 1e12], 1), (5001, [2e12, 1.0], 1), (5050, [0.9e12, 0.5e12], 0)]  # beyond 2^53
    odd = [(None, [1.0, 1.0, 1.0], 1), (51, None, 1), (52, [1.0, None, 1.0], 1), (53, [nan, 1.0, 1.0], 1), (54, [inf, 1.0, 1.0], 0),
           (55, [1.0, 1.0, 1.0], None), (56, [], 1), good[3]]
    got = [tuple(r) for r in hard_negatives.hard_negatives(vectors_of(spark, good + odd), part_rows=7).collect()]
    assert sorted(got) == sorted(brute_negatives({i: (lab, v) for i, v, lab in good}))
    assert hard_negatives.hard_negatives(vectors_of(spark, [])).count() == 0
    assert hard_negatives.hard_negatives(vectors_of(spark, odd[:-1])).count() == 0


def test_segment_summaries_bound_the_score():
    rng = np.random.default_rng(2)
    a, b = np.floor(256 * rng.normal(size=(40, 30))), np.floor(256 * rng.normal(size=(50, 30)))
    scores = a @ b.T
    for (ma, sa), (mb, sb) in zip(hard_negatives.summaries(a), hard_negatives.summaries(b)):
        assert (ma @ mb.T + sa @ sb.T >= scores - 1e-6).all() and (ma @ mb.T - sa @ sb.T <= scores + 1e-6).all()


def test_bounds_spare_exact_scores():
    """With clustered vectors most pairs are never scored exactly."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 64)) * 100
    m = np.floor(np.repeat(centres, 100, axis=0) + rng.normal(size=(2000, 64)))
    cell = hard_negatives.Positives(64)
    cell.ids, cell.m, cell.flat, cell.labels = [np.arange(20)], [m[::100]], [hard_negatives._packed(hard_negatives.summaries(m[::100]))], [np.zeros(20, int)]
    cell.close()
    cell.floor[:] = [np.sort(m[i] @ m.T)[-6] for i in range(0, 2000, 100)]
    levels = hard_negatives.summaries(m)
    middle, spread = cell.levels[0][0] @ levels[0][0].T, cell.levels[0][1] @ levels[0][1].T
    first = (middle + spread >= cell.floor[:, None]).mean()
    middle, spread = cell.levels[1][0] @ levels[1][0].T, cell.levels[1][1] @ levels[1][1].T
    assert (middle + spread >= cell.floor[:, None]).mean() < first and (middle + spread >= cell.floor[:, None]).mean() < 0.2

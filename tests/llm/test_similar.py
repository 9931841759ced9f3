"""N-gram Jaccard join and the pipeline against brute force."""
import random

import numpy as np
import pytest

import corpus_pipeline
from ledgerlens.llm import jaccard_join as J


def brute_components(rows, shingle=J.SHINGLE, num=J.NUM, den=J.DEN):
    sets = [J.shingle_set(t.encode() if t else None, shingle) for _, t in rows]
    ids = [i for i, _ in rows]
    parent = {i: i for i in ids if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if ids[a] is None or ids[b] is None or not sets[a] or not sets[b]:
                continue
            both = len(sets[a] & sets[b])
            if den * both >= num * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(ids[a]), find(ids[b])
                parent[max(x, y)] = min(x, y)
    return sorted((str(i), len(s), None if i is None else find(i)) for i, s in zip(ids, sets))


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        at = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            out[at] = f"new{rng.random()}"
        elif kind < 0.7:
            out.insert(at, f"new{rng.random()}")
        else:
            out.pop(at)
    return out


def corpus(rng):
    rows, i = [], 1000
    passage = [f"p{k}" for k in range(60)]
    for base in range(12):
        n = rng.choice([4, 8, 12, 30, 80, 200])
        words = [f"b{base}w{rng.randrange(10 * n)}" for _ in range(n)]
        for _ in range(8):
            rows.append((i, " ".join(edited(rng, words, rng.randint(0, max(1, n // 40))))))
            i += 1
    for _ in range(25):  # documents that share a long passage and little else
        rows.append((i, " ".join(passage + [f"q{rng.randrange(10**6)}" for _ in range(rng.choice([5, 9, 12, 40]))])))
        i += 1
    chain = [f"c{k}" for k in range(60)]
    for _ in range(12):  # a chain whose ends are no partners
        rows.append((i, " ".join(chain)))
        chain = chain[1:] + [f"c{rng.randrange(10**6)}"]
        i += 1
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(make_docs, odd_rows, seed):
    rows = odd_rows + corpus(random.Random(seed))
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in J.jaccard_components(make_docs(rows)).collect())
    assert got == brute_components(rows)


def test_empty_table_and_one_of_each(make_docs, odd_rows):
    assert J.jaccard_components(make_docs([])).count() == 0
    docs = make_docs(odd_rows)
    kept = J.one_of_each(docs)
    assert kept.columns == docs.columns
    assert {r["doc_id"] for r in kept.collect()} == {r[2] for r in brute_components(odd_rows)}


def brute_links(rows, shingle, num, den):
    """Links and component of every id, over whole texts; ids must be unique."""
    sets = [(i, J.shingle_set(t.encode(), shingle)) for i, t in rows]
    links = {(min(i, j), max(i, j)) for n, (i, a) in enumerate(sets) for j, b in sets[:n]
             if a and b and den * len(a & b) >= num * len(a | b)}
    least = {i: i for i, _ in sets}
    for _ in rows:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    return links, least, dict(sets)


@pytest.mark.parametrize("shingle, num", [(5, 80), (3, 70)])
def test_shingle_and_threshold_are_arguments(make_docs, shingle, num):
    rows = corpus(random.Random(4))
    links, least, sets = brute_links(rows, shingle, num, 100)
    got = J.jaccard_components(make_docs(rows), shingle=shingle, num=num, den=100).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == least
    assert {r["doc_id"]: r["n_shingles"] for r in got} == {i: len(s) for i, s in sets.items()}
    assert least != brute_links(rows, 4, 85, 100)[1]
    first = {}
    for i in sorted(sets):
        first.setdefault(frozenset(sets[i]), i)
    found = [(r["a"], r["b"]) for r in J.jaccard_links(make_docs(rows), shingle=shingle, num=num, den=100).collect()]
    assert sorted(found) == sorted((a, b) for a, b in links if {a, b} <= set(first.values()))


def test_pipeline_drops_near_copies_from_five_words_and_four_fifths(spark, make_docs):
    words = [f"w{k}" for k in range(104)]
    rows = [(1, " ".join(words)), (2, " ".join(words + [f"x{k}" for k in range(24)])), (3, " ".join(words + [f"y{k}" for k in range(30)]))]
    kept = corpus_pipeline.jaccard_stage(spark, make_docs(rows), "").collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 3]


def test_every_pair_over_the_threshold_meets_in_a_signature():
    rng, sketch = random.Random(3), np.ones(J.SKETCH)
    checked = 0
    for _ in range(800):
        n = rng.choice([6, 7, 8, 12, 13, 20, 40, 90, 300])
        base = [rng.getrandbits(63) for _ in range(n)]
        other = list(base)
        for _ in range(rng.randint(1, max(1, n // 9))):
            if rng.random() < 0.5 and len(other) > 1:
                other.pop(rng.randrange(len(other)))
            else:
                other.append(rng.getrandbits(63))
        # a random sketch makes the probes buy odd mixtures of units
        costs = sketch if rng.random() < 0.3 else np.random.default_rng(rng.randrange(10**6)).integers(1, 50, J.SKETCH).astype(float)
        a, b = np.unique(np.array(base, dtype=np.uint64)), np.unique(np.array(other, dtype=np.uint64))
        both = len(np.intersect1d(a, b))
        if 100 * both < 85 * (len(a) + len(b) - both) or both == len(a) == len(b):
            continue
        checked += 1
        key, doc, index, probe = J.signatures(np.concatenate([a, b]), np.array([len(a), len(b)]), costs)
        held = {(d, kind): set(key[(doc == d) & mask].tolist()) for d in (0, 1) for kind, mask in (("index", index), ("probe", probe))}
        assert held[0, "index"] & held[1, "probe"] or held[1, "index"] & held[0, "probe"]
    assert checked > 300


def test_connected_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 300)] + [(900, 800), (800, 850), (5, 5)]
    got = {r["node"]: r["component"] for r in J.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(300)} | {800: 800, 850: 800, 900: 800}
    assert {n: got.get(n, n) for n in want} == want

"""Exact dedup, packing, chat, top-k and license scan against brute force."""
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerlens.llm import chat, exact_dedup, jaccard_join, license_scan, packing, piece_dropout, topk

SPACE = re.compile(r"[\x20\x09-\x0D]")


def brute_groups(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(SPACE.sub("", t or ""), []).append((i, len(t or "")))
    out, used = [], set()
    # one row of a group stays: that of the keeper's id with the most code points
    for i, t in sorted(rows, key=lambda r: -len(r[1] or "")):
        norm = SPACE.sub("", t or "")
        with_id = [m for m in groups[norm] if m[0] is not None]
        keep = min(with_id, key=lambda m: (-m[1], m[0]))[0] if with_id else None
        out.append((i, keep, len(groups[norm]), i == keep and norm not in used, hashlib.sha256(norm.encode()).hexdigest()))
        used |= {norm} if i == keep else set()
    return out


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_exact_groups_match_brute_force(make_docs, odd_rows):
    rows = odd_rows + [(100 + i, f"a b {i % 7}" + " " * (i % 3)) for i in range(60)] + [(300 + i, "same text") for i in range(1500)]
    got = [tuple(r) for r in exact_dedup.exact_groups(make_docs(rows)).collect()]
    assert order(got) == order(brute_groups(rows))


def test_rows_that_share_an_id_have_one_survivor(make_docs):
    rows = [(7, "same text"), (7, "same text"), (7, "same  text"), (8, "same text"), (None, "q"), (None, "q"), (None, "same text")]
    rows += [(None, "hot")] * 1300 + [(9, "only"), (9, "other")]
    got = [tuple(r) for r in exact_dedup.exact_groups(make_docs(rows)).collect()]
    assert order(got) == order(brute_groups(rows))
    assert sum(r[3] for r in got) == len({r[4] for r in got}) == 5


def test_names_of_the_input_do_not_clash(spark):
    """Columns with the names that the operators use inside come back as they are."""
    names = ["doc_id", "text", "whole", "sha", "_sha", "id", "points", "rows", "kept_id", "kept_sha", "_kept_id", "class_sha", "row", "c0", "text_in", "_text_in"]
    rows = [(i, f"text {i // 2}", *[f"{c}{i}" for c in names[2:]]) for i in range(6)]
    docs = spark.createDataFrame(rows, ", ".join([f"{names[0]} long", *[f"`{c}` string" for c in names[1:]]]))
    out = exact_dedup.drop_copies(docs)
    assert out.columns == names
    assert sorted(tuple(r) for r in out.collect()) == [rows[0], rows[2], rows[4]]
    assert license_scan.scan(docs).count() == 6


def test_an_overfull_bitmap_changes_nothing(make_docs, odd_rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "MAP_BITS", 1)
    docs = make_docs(odd_rows)
    assert order(tuple(r) for r in exact_dedup.exact_groups(docs).collect()) == order(brute_groups(odd_rows))
    texts = [SPACE.sub("", r["text"] or "") for r in exact_dedup.drop_copies(docs).collect()]
    assert sorted(texts) == sorted({SPACE.sub("", t or "") for _, t in odd_rows})


def test_exact_groups_of_an_empty_table(make_docs):
    assert exact_dedup.exact_groups(make_docs([])).count() == 0
    assert exact_dedup.drop_copies(make_docs([])).count() == 0


def test_drop_copies_keeps_one_row_and_all_columns(make_docs, odd_rows):
    docs = make_docs(odd_rows)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    texts = [SPACE.sub("", r["text"] or "") for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({SPACE.sub("", t or "") for _, t in odd_rows})


def test_drop_copies_decides_by_id_and_text(make_docs):
    rows = [(None, "a"), (5, "a"), (None, "b"), (7, "x"), (7, "y"), (3, "y"), (8, "l m"), (8, "l  m"), (None, "n"), (None, " n")]
    kept = sorted(((r["doc_id"] or 0, r["text"]) for r in exact_dedup.drop_copies(make_docs(rows)).collect()))
    assert kept == [(0, " n"), (0, "b"), (3, "y"), (5, "a"), (7, "x"), (8, "l  m")]


@pytest.mark.parametrize("cut", [0, 1, 5000, exact_dedup.CHUNK, 99_999])
def test_fingerprints_compose(cut):
    data = random.Random(1).randbytes(100_000)
    whole = exact_dedup.fingerprint(data)
    a, b = data[:cut], data[cut:]
    assert exact_dedup.combine(exact_dedup.fingerprint(a), exact_dedup.fingerprint(b), len(b)) == whole
    h = [0, 0]
    for byte in data[:3000]:
        h = [(x * base + byte + 1) % p for x, base, p in zip(h, exact_dedup.BASES, exact_dedup.PRIMES)]
    assert tuple(h) == exact_dedup.fingerprint(data[:3000])


def test_chunk_rows_give_the_same_fingerprint(make_docs, odd_rows):
    rows = [r for r in dict(odd_rows).items() if r[0] is not None]
    got = {r["doc_id"]: (r["fp1"], r["fp2"], r["n_bytes"]) for r in exact_dedup.huge_fingerprints(make_docs(rows), size=777).collect()}
    for i, t in rows:
        norm = exact_dedup.normalise(t.encode() if t else None)
        assert got[i] == (*exact_dedup.fingerprint(norm), len(norm))


def test_packing_against_tokenizers(make_docs, odd_rows):
    rows = odd_rows + [(50, "call <|endoftext|> here"), (51, "lorem ipsum " * 900)]
    slow = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = packing.pack(make_docs(rows), with_ids=True).collect()
    want = sorted(((str(i), slow.encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows))
    docs, open_ = [], {}
    for r in sorted(got, key=lambda r: (str(r["doc_id"]), r["doc_tokens"], r["start"], r["sequence_id"])):
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], dtype="<u4").tobytes())
        assert r["length"] == len(r["ids"]) and r["length"] & (r["length"] - 1) == 0 and r["length"] <= 1024 and r["offset"] == 0
        open_.setdefault((str(r["doc_id"]), r["doc_tokens"], r["start"]), []).append(tuple(r["ids"]))
    for i, ids in want:
        found, start = [], 0
        while start < len(ids):
            piece = next(p for p in open_[(i, len(ids), start)] if list(p) == ids[start:start + len(p)])
            open_[(i, len(ids), start)].remove(piece)
            found += piece
            start += len(piece)
        docs.append((i, found))
    assert docs == want and not any(open_.values())
    ids = sorted(r["sequence_id"] for r in got)
    assert ids == list(range(len(got)))  # one piece a sequence, numbered without gaps
    by_id = sorted(got, key=lambda r: r["sequence_id"])
    assert [r["length"] for r in by_id] == sorted((r["length"] for r in got), reverse=True)
    assert packing.pack(make_docs([])).count() == 0


def test_packing_needs_a_power_of_two(make_docs):
    with pytest.raises(ValueError):
        packing.pack(make_docs([]), length=1000)


CONV = "conv_id long, turn long, role string, text string, n_turns int, line string"


def test_chat_collapse(spark):
    turns = [("user", "hi"), ("assistant", "yes"), ("user", None), (None, "x")]
    rows = []
    for conv, n in ((1, 4), (2, 2), (3, 4), (4, 3), (5, 1)):
        rows += [(conv, i, *turns[i], 0, "z") for i in range(n)]
    rows += [(6, 0, "user", "other", 0, "z"), (7, 0, "user", "", 0, "z"), (8, 0, "user", None, 0, "z"),
             (None, 0, "user", "hi", 0, "z"), (9, None, "user", "hi", 0, "z"), (9, None, "user", "hi", 0, "z")]
    got = {r["conv_id"]: (r["n_turns"], r["n_copies"], r["text"]) for r in chat.render(spark.createDataFrame(rows, CONV)).collect()}
    assert set(got) == {1, 6, 7, 8, 9}
    assert got[1][:2] == (4, 2)
    assert got[1][2] == ("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes<|im_end|>\n"
                         "<|im_start|>user\n<|im_end|>\n<|im_start|>unknown\nx<|im_end|>\n")
    assert got[9][:2] == (2, 1)
    assert chat.render(spark.createDataFrame([], CONV)).count() == 0


def test_top_k_against_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=6)], 0, 1.0) for i in range(430)]
    rows += [(500 + i, rows[3][1], 0, 1.0) for i in range(9)] + [rows[7], rows[50]]
    rows += [(600, None, 0, 1.0), (650, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, 1.0), (651, [float("nan")] * 6, 0, 1.0),
             (652, [float("inf")] * 6, 0, 1.0), (None, [1.0] * 6, 0, 1.0), (700, [2.0, 3.0], 0, 1.0), (701, [2.0, 4.0], 0, 1.0),
             (702, [1e14, -1e14, 1e14, 0.0, 0.0, 1.0], 0, 1.0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int, score double")
    ints = {i: [math.floor(256 * x) for x in v] for i, v, _, _ in rows
            if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    want = set()
    for q, v in ints.items():
        if q % 50 == 0:
            scored = sorted((-max(topk.LOW, min(topk.HIGH, sum(a * b for a, b in zip(v, w)))), i) for i, w in ints.items() if i != q and len(w) == len(v))
            want |= {(q, k + 1, i, -s) for k, (s, i) in enumerate(scored[:5])}
    got = [tuple(r) for r in topk.top_k(df, part_rows=100, block=16).collect()]
    assert len(got) == len(want) and set(got) == want
    assert topk.top_k(df.limit(0)).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = WORD.findall(low)
    at, labels = [], set()
    for phrase, label in license_scan.PHRASES.items():
        p = phrase.split()
        found = [i for i in range(len(words)) if words[i:i + len(p)] == p]
        at += found
        labels |= {label} if found else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def brute_templates(text, threshold=license_scan.THRESHOLD):
    out = {}
    for block in license_scan.blocks((text or "").encode()):
        for label, templates in license_scan.TEMPLATES.items():
            for t in templates:
                words = set(t.encode().split())
                share = len(words & set(block)) / len(words)
                if share >= threshold - 1e-9:
                    out[label] = max(out.get(label, 0), share)
    return out


def test_license_scan_against_brute_force(make_docs, odd_rows):
    apache = license_scan.TEMPLATES["apache"][0]
    rng, pool = random.Random(2), "mit license cc by apache gnu general public Licensed under the of ré".split()
    rows = odd_rows + [(20, "MIT License, mit-license cc by cc by"), (21, "GNU General\nPublic License"), (22, apache.upper() + "."),
                       (23, "pad " * 100 + apache + " pad" * 90), (24, "\n".join(apache.split())), (25, apache.replace("license", "x"))]
    rows += [(30 + i, " ".join(rng.choice(pool) for _ in range(40))) for i in range(60)]
    words = apache.split()
    rows += [(100 + i, " ".join(rng.sample(words, rng.randint(10, len(words))))) for i in range(60)]
    got = license_scan.scan(make_docs(rows), keep=["doc_id"]).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        base, extra = brute_license(t), brute_templates(t)
        labels = ",".join(sorted(set(filter(None, base[4].split(","))) | set(extra)))
        want.append((i, *base, labels, 1.0 if base[1] else max(extra.values(), default=0.0)))
    assert order([tuple(r) for r in got]) == order(want)
    assert any(w[6] == "apache" and w[5] == "" for w in want)
    assert license_scan.scan(make_docs([])).count() == 0


def test_license_notices_across_lines_and_long_templates(make_docs):
    rng = random.Random(6)
    long_one = " ".join(f"t{i}" for i in range(120)) + " t1 t2 t3"
    templates = {**license_scan.TEMPLATES, "long": [long_one]}
    mit, gpl = license_scan.TEMPLATES["mit"][0], license_scan.TEMPLATES["gpl"][0]
    rows = [(1, mit.replace("obtaining a copy", "obtaining a copy\n")), (2, "# " + "\r\n# ".join(gpl.split())), (3, long_one),
            (4, "\n".join(long_one.split()[:100])), (5, "\n".join(long_one.split()[:90])), (6, mit[:60] + "\n" + "pad " * 80 + mit[60:])]
    for i in range(60):
        words = rng.choice([mit, gpl, long_one]).split()
        for _ in range(rng.randrange(len(words))):
            words.insert(rng.randrange(len(words)), rng.choice(["pad", "the", "t5"]))
        rows.append((100 + i, "".join(w + rng.choice([" ", "\n", "\r\n"]) for w in ["pad"] * rng.randrange(90) + words)))
    want = {}
    for i, t in rows:
        found, words = {}, t.split()
        for label, texts in templates.items():
            for template in texts:
                parts = template.split()
                size = max(64, -(-len(parts) * 10 // 8))
                for at in range(len(words)):
                    share = len(set(parts) & set(words[at:at + size])) / len(set(parts))
                    if share >= 0.8 - 1e-9:
                        found[label] = max(found.get(label, 0), share)
        want[i] = (",".join(sorted(found)), max(found.values(), default=0.0))
    rows = [(i, t.replace("# ", "// ")) for i, t in rows]
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(make_docs(rows), keep=["doc_id"], templates=templates).collect()}
    assert got == want
    assert [want[i][0] for i in range(1, 7)] == ["mit", "gpl", "long", "long", "", ""]


def test_pieces_of_tables_with_clashing_names(spark):
    names = ["doc_id", "text", "keyed", "_keyed", "k0", "ids_in", "_ids_in", "whole", "kept_id", "_kept_id", "id"]
    docs = spark.createDataFrame([(1, "some words here", *names[2:]), (2, "some words there", *names[2:])],
                                 ", ".join(["doc_id long", *[f"`{c}` string" for c in names[1:]]]))
    out = piece_dropout.decode(piece_dropout.encode(docs))
    assert out.columns == [*names, "ids", "decoded"]
    assert all(r["decoded"] == r["text"] and r["k0"] == "k0" and r["_ids_in"] == "_ids_in" for r in out.collect())
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == names and kept.count() == 2

"""Piece dropout, language identification, toxicity and language-model scores: round trips, gradients, held-out figures."""
import itertools
import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import sentencepiece
from pyspark.sql import functions as F

from ledgerlens.llm import gru, langid, lm_score, piece_dropout, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def texts():
    return pq.read_table(f"{SF}/documents.parquet").column("text").to_pylist()[:200]


def flat(model, texts, rate, seed=1):
    ids, sizes = model.encode(texts, np.arange(len(texts), dtype=np.uint64), rate, seed)
    ends = np.cumsum(sizes)
    return [ids[e - n:e] for e, n in zip(ends, sizes)]


def test_without_dropout_the_ids_are_the_library_s(texts):
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    odd = ["", " ", "\n", "  a  b\n\nc d ", "héé 漢字 😀x\t\r\n  ", "ab" * 300 + "c" * 99]
    for text, ids in zip(texts + odd, flat(piece_dropout.model(), texts + odd, 0.0)):
        assert sp.encode(text) == ids.tolist()


def test_dropout_is_seeded_varied_and_lossless(texts):
    m = piece_dropout.model()
    odd = ["", "▁ marks ▁▁", "\x00 nul", "   ", "z" * 1000]
    one, again, other = (flat(m, texts + odd, 0.2, seed) for seed in (1, 1, 2))
    assert all(np.array_equal(a, b) for a, b in zip(one, again))
    assert sum(not np.array_equal(a, b) for a, b in zip(one, other)) > 150
    for text, ids in zip(texts + odd, one):
        assert m.decode(ids) == text.encode()
    plain = flat(m, texts, 0.0)
    assert sum(map(len, one)) > 1.05 * sum(map(len, plain))
    assert all(len(set(map(tuple, flat(m, ["understanding"] * 40, 0.3)))) > 3 for _ in range(1))


def brute_segment(m, chunk, key, rate):
    """The agenda for one chunk, step by step."""
    points = np.array([ord(c) for c in chunk], dtype=np.int32)
    toks = [int(m.char_ids[p]) if m.char_ids[p] >= 0 else -2 - int(p) for p in points]
    pos, skipped = list(range(len(toks))), set()
    limit = int(rate * 2.0**64)
    while True:
        best = None
        for i in range(len(toks) - 1):
            rank = int(m.rank(np.array([toks[i]]), np.array([toks[i + 1]]))[0])
            if rank < piece_dropout.NONE and (toks[i], toks[i + 1], pos[i]) not in skipped and (best is None or rank < best[0]):
                best = (rank, i)
        if best is None:
            return toks
        rank, i = best
        drawn = piece_dropout.mix(np.array([key]) ^ piece_dropout.mix(np.array([pos[i] * 65536 + rank], dtype=np.uint64) * piece_dropout.MIX))
        if int(drawn[0]) < limit:
            skipped.add((toks[i], toks[i + 1], pos[i]))
        else:
            toks[i:i + 2], pos[i:i + 2] = [int(m.by_rank[rank])], [pos[i]]


def test_array_agenda_equals_the_step_by_step_agenda(texts):
    m = piece_dropout.model()
    chunks = sorted({c for t in texts[:30] for c in piece_dropout.CHUNKS.findall(t)})[:150]
    keys = piece_dropout.mix(np.arange(len(chunks), dtype=np.uint64))
    width = max(map(len, chunks))
    grid = np.full((len(chunks), width), -1, dtype=np.int32)
    for i, c in enumerate(chunks):
        grid[i, :len(c)] = [ord(x) for x in c]
    out, n = m.segment(grid, keys, 0.3)
    for i, c in enumerate(chunks):
        assert out[i, :n[i]].tolist() == brute_segment(m, c, keys[i], 0.3)


def test_every_occurrence_draws_for_itself(texts):
    """Shared, own and long agendas give what the step-by-step agenda gives for each occurrence's key."""
    m, po, rate = piece_dropout.model(), piece_dropout, 0.3
    some = [*texts[:12], "understanding " * 60, "abc" * 45 + " é" + "x" * 130]
    got = flat(m, some, rate, 5)
    for d, (text, ids) in enumerate(zip(some, got)):
        want = []
        for nth, c in enumerate(po.CHUNKS.findall(" " + text)):
            key = po.mix(np.array([d], np.uint64) ^ po.mix(np.array([nth + 1], np.uint64) * po.MIX ^ np.uint64(5)))[0]
            symbols = np.array(brute_segment(m, c, key, rate), dtype=np.int32)
            want += m.spell(symbols, np.array([len(symbols)]))[0].tolist()
        assert ids.tolist() == want


def test_long_chunks_equal_the_array_agenda():
    m, rng = piece_dropout.model(), np.random.default_rng(3)
    for rate in (0.0, 0.1):
        points = rng.choice([ord(c) for c in "abcdeinorst漢é"], 500).astype(np.int32)
        out, n = m.segment(points[None, :], np.array([77], np.uint64), rate)
        assert m.segment_long(points, 77, rate).tolist() == out[0, :n[0]].tolist()
    run = "abcdefghij" * 20_000  # 200,000 characters without a space
    ids, _ = m.encode([run], np.array([1], np.uint64), 0.1, 1)
    assert m.decode(ids) == run.encode()


def test_frequent_words_vary_and_each_merge_is_skipped_at_the_rate():
    m = piece_dropout.model()
    got = flat(m, ["x international"] * 4000, 0.1)
    assert len({tuple(g) for g in got}) > 50
    out, n, codes, met = m.segment(np.array([[ord(c) for c in " international"]], np.int32), skips=np.empty((1, 0), np.int64))
    keys = piece_dropout.mix(np.arange(20_000, dtype=np.uint64))
    limit = np.uint64(piece_dropout.limit_of(0.1))
    shares = [(piece_dropout.mix(keys ^ c) < limit).mean() for c in codes]
    assert len(shares) == met[0] and all(0.09 < s < 0.11 for s in shares)


def test_encode_and_decode_tables(make_docs, odd_rows):
    coded = piece_dropout.decode(piece_dropout.encode(make_docs(odd_rows), F.col("doc_id")))
    assert coded.columns[-2:] == ["ids", "decoded"] and coded.count() == len(odd_rows)
    assert all(r["decoded"] == (r["text"] or "") for r in coded.collect())
    assert piece_dropout.encode(make_docs([])).count() == 0


def numeric(loss, array, at, eps=1e-2):
    old = array[at]
    array[at] = old + eps
    up = loss()
    array[at] = old - eps
    down = loss()
    array[at] = old
    return (up - down) / (2 * eps)


def test_byte_net_gradients():
    net = langid.ByteNet(["a", "b"], seed=3)
    words = [b"abc", b"de", b"fghij"]
    sizes, seqs = np.array([len(w) for w in words]), np.zeros((3, 5), dtype=np.int64)
    for i, w in enumerate(words):
        seqs[i, :len(w)] = list(w)
    target = np.array([0, 1, 0])
    _, grads = net.train_step(seqs, sizes, target)
    rng = np.random.default_rng(0)
    for name in net.p:
        for _ in range(4):
            at = tuple(rng.integers(s) for s in net.p[name].shape)
            if name == "embed":
                at = (97 + at[0] % 10, at[1])
            want = numeric(lambda: net.train_step(seqs, sizes, target)[0], net.p[name], at)
            assert grads[name][at] == pytest.approx(want, abs=2e-3)


def test_language_held_out_accuracy_and_odd_rows(spark, make_docs, odd_rows):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = langid.identify(docs)
    rows = got.join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r["lang_pred"] == r["lang"] for r in rows) >= 0.97 * len(rows)
    assert all(0 <= r["score"] <= 1 and r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    odd = langid.identify(make_docs(odd_rows + [(60, "123 456 !!"), (61, "É")])).collect()
    assert len(odd) == len(odd_rows) + 2
    for r in odd:
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (1, 2, 3, 60))
    assert langid.identify(make_docs([])).count() == 0


def test_equal_documents_are_predicted_alike_whatever_the_batch(texts):
    net = langid.train([(t, "en" if i % 2 else "fr") for i, t in enumerate(texts[:20])], steps=5)
    data = [t.encode() for t in texts[:50]]
    together = langid.predict_texts(data, langid._Cache(net))
    alone = [langid.predict_texts([t], langid._Cache(net)) for t in data]
    assert together[0] == [a[0][0] for a in alone]
    assert np.allclose(together[1], [a[1][0] for a in alone], atol=1e-5)


@pytest.mark.parametrize("width", [2, 3, 64])
def test_forward_backward_against_enumeration(width):
    rng = np.random.default_rng(0)
    sizes, trans = np.array([3, 0, 5, 1, 6]), rng.normal(size=(2, 2))
    score = rng.normal(size=15) * 2
    p, count, logz = toxicity.marginals(score, sizes, trans, width=width)
    want, want_count, at = [], np.zeros((2, 2)), 0
    for d, n in enumerate(sizes):
        total, mass, pairs = 0.0, np.zeros(n), np.zeros((2, 2))
        for y in itertools.product((0, 1), repeat=int(n)):
            v = math.exp(sum(score[at + i] * y[i] for i in range(n)) + sum(trans[y[i - 1], y[i]] for i in range(1, n)))
            total, mass = total + v, mass + v * np.array(y)
            for i in range(1, n):
                pairs[y[i - 1], y[i]] += v
        want += list(mass / total)
        want_count += pairs / total
        assert logz[d] == pytest.approx(math.log(total))
        at += n
    assert np.allclose(p, want) and np.allclose(count, want_count)


def test_toxicity_held_out_and_odd_rows(spark, make_docs, odd_rows):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.score(docs, labels).join(labels, "doc_id").where("held_out").select("score", "toxic", "predicted").collect()
    score, toxic = np.array([r["score"] for r in got]), np.array([r["toxic"] for r in got])
    rank = np.argsort(np.argsort(score))
    auc = (rank[toxic == 1].mean() - (toxic.sum() - 1) / 2) / (toxic == 0).sum()
    assert auc > 0.95
    caught, wrong = ((score >= 0.5) & (toxic == 1)).sum(), ((score >= 0.5) & (toxic == 0)).sum()
    assert caught >= 0.85 * toxic.sum() and wrong <= 0.02 * (toxic == 0).sum()
    assert all(r["predicted"] == int(r["score"] >= 0.5) for r in got)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for known in (none, spark.createDataFrame([(4, 1, 1), (5, 1, 0), (None, 1, 1), (8, None, None), (9, 1, 0), (9, 1, 0)], none.schema)):
        out = toxicity.score(make_docs(odd_rows), known).collect()
        assert len(out) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.score(make_docs([]), none).count() == 0


def test_long_labelled_documents_are_learned_from_by_a_stretch(spark, make_docs):
    long = "abcdefghij" * 3000
    rows = [(i, long + str(i)) for i in range(20)] + [(20 + i, "short") for i in range(20)]
    got = langid.training_sample(make_docs(rows))
    kept = sum(zlib.crc32(str(i).encode()) % 5 != 0 for i in range(40))
    assert len(got) == kept
    assert {len(t) for t, _ in got} == {5, langid.TRAIN_CHARS} and all(any(t in text for _, text in rows) for t, _ in got)
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(40)], "doc_id long, toxic int")
    got, _ = toxicity.training_sample(make_docs(rows), labels)
    assert len(got) == kept and {(len(t), y) for t, y in got} == {(5, 0), (toxicity.TRAIN_CHARS, 1)}


def test_toxic_spans(make_docs):
    rng = np.random.default_rng(4)
    vocab = [f"w{i}" for i in range(200)]
    samples = []
    for i in range(400):
        words = list(rng.choice(vocab, 40))
        if i % 4 == 0:
            words[5] = words[20] = "Awful!"
        samples.append((" ".join(words), int(i % 4 == 0)))
    tagger = toxicity.train(samples)
    text = "é w1 w2 w3 AWFUL, w4 w5"
    row = toxicity.tag(make_docs([(1, text), (2, "w1 w2 w3"), (3, None)]), tagger).orderBy("doc_id").collect()
    assert [(s["start"], s["end"]) for s in row[0]["spans"]] == [(11, 17)] and text[11:17] == "AWFUL,"
    assert row[1]["spans"] == [] and row[2]["spans"] == [] and row[0]["score"] > row[1]["score"]


def test_documents_of_one_opening_all_count_and_near_copies_count_once():
    rng = np.random.default_rng(5)
    vocab = [f"w{i}" for i in range(300)]
    samples = []
    for i in range(200):
        words = list(rng.choice(vocab, 40))
        if i % 4 == 0:
            words[9] = words[20] = "awful"
        samples.append((" ".join(["all", "these", "documents", "open", "like", "this", *words]), int(i % 4 == 0)))
    tagger = toxicity.train(samples)
    _, p, _ = toxicity._Scorer(tagger).score([b"w1 w2 awful w3", b"w1 w2 w4 w3"])
    assert (p > 0.5).tolist() == [False, False, True] + [False] * 5
    base = [rng.choice(300, 60) for _ in range(3)]
    edited = base[0].copy()
    edited[50] = 301
    docs = [base[0], base[1], edited, np.append(base[1], [302, 303]), base[2], base[0], np.empty(0, int), np.append(base[0][:6], base[2])]
    docs = [d.astype(np.int32) for d in docs]
    labels = np.array([1, 1, 1, 1, 1, 0, 0, 1])
    got = toxicity.copies(docs, labels)
    sets = [{tuple(d[i:i + 5]) for i in range(len(d) - 4)} for d in docs]
    want = []
    for i, s in enumerate(sets):
        want.append(next((k for k in range(i) if want[k] == k and labels[k] == labels[i] and s
                          and len(s & sets[k]) >= 0.8 * len(s | sets[k])), i))
    assert got.tolist() == want
    assert want[:7] == [0, 1, 0, 1, 4, 5, 6]


def test_word_net_gradients():
    table = [(f"w{i}".encode(), 3000 - i) for i in range(1500)] + [(lm_score.END, 500)]
    vocab = lm_score.Vocabulary(table, sum(c for _, c in table) + 50, 1560)
    net = lm_score.WordNet(vocab, seed=2)
    rng = np.random.default_rng(1)
    goal, prev = rng.integers(vocab.symbols, size=(6, 3)), rng.integers(vocab.symbols, size=(6, 3))
    keep = np.ones((6, 3), dtype=gru.DTYPE)
    keep[3, 1] = 0
    h = rng.normal(size=(3, net.hidden)).astype(gru.DTYPE)
    _, grads, _ = net.train_window(prev, goal, keep, h)
    for name in net.p:
        at = np.unravel_index(np.abs(grads[name]).argmax(), grads[name].shape)
        want = numeric(lambda: net.train_window(prev, goal, keep, h)[0], net.p[name], at)
        assert grads[name][at] == pytest.approx(want, rel=0.05, abs=2e-3)


def test_model_probabilities_sum_to_one():
    table = [(f"w{i}".encode(), 3000 - i) for i in range(1500)] + [(lm_score.END, 500)]
    vocab = lm_score.Vocabulary(table, sum(c for _, c in table) + 50, 1560)
    net = lm_score.WordNet(vocab)
    lm_score.learn(net, [lm_score.symbols(lm_score.tokens_of(b"w1 w2 w3 w900 w1400 x"), vocab)[0]] * 30, lanes=4)
    symbols = [np.array([s]) for s in range(vocab.symbols)]
    used = [s for s in range(vocab.symbols) if s >= vocab.base or s < lm_score.HEAD]
    total = sum(math.exp(net.log_probs([symbols[s]])[0]) for s in used)
    assert total == pytest.approx(1.0, abs=1e-3)
    inside = np.bincount(vocab.symbol, weights=np.exp(vocab.inside))[vocab.base:]
    assert np.allclose(inside, 1.0)


def test_lm_scores_base_exactly_and_beat_it_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: r["text"] for r in docs.select("doc_id", "text").collect()}
    tokens = {i: lm_score.tokens_of(t.encode()) for i, t in rows.items()}
    held = {i for i in rows if zlib.crc32(str(i).encode()) % 7 == 2}
    c = Counter(t for i, ts in tokens.items() if i not in held for t in ts)
    n, v = sum(c.values()), len(c)
    old = lm_score.TABLE_WORDS
    lm_score.TABLE_WORDS = 3000  # words beyond the table take the join
    try:
        got = lm_score.score(docs).collect()
    finally:
        lm_score.TABLE_WORDS = old
    assert len(got) == len(rows)
    for r in got:
        ts = tokens[r["doc_id"]]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (r["doc_id"] in held, len(ts), sum(t in c for t in ts), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), rel=1e-9)
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


def test_lm_state_does_not_depend_on_lanes(texts):
    c = Counter(t for x in texts for t in lm_score.tokens_of(x.encode()))
    vocab = lm_score.Vocabulary(list(c.items()), sum(c.values()), len(c))
    net = lm_score.WordNet(vocab)
    lm_score.learn(net, [lm_score.symbols(lm_score.tokens_of(t.encode()), vocab)[0] for t in texts[:50]], lanes=16)
    docs = [lm_score.symbols(lm_score.tokens_of(t.encode()), vocab)[0] for t in texts[:40]]
    assert np.allclose(net.log_probs(docs), [net.log_probs([d], window=17)[0] for d in docs], rtol=1e-4)


def test_lm_training_reads_every_token_once_and_grows_with_the_corpus(spark):
    doc = np.arange(2 * lm_score.STRETCH + 100)
    parts = list(lm_score.stretches(doc, 7))
    assert np.concatenate([y[y >= 0] for _, y in parts]).tolist() == doc.tolist()
    assert parts[0][0][0] == 7 and all(x[1:].tolist() == [*range(x[1], x[1] + len(x) - 1)] for x, _ in parts)
    assert [int((y < 0).sum()) for _, y in parts] == [0, lm_score.WARM, lm_score.WARM]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    counts = Counter(t for r in docs.collect() for t in lm_score.tokens_of(r["text"].encode()))
    vocab = lm_score.Vocabulary(list(counts.items()), sum(counts.values()), len(counts))
    copies = docs.select((F.col("doc_id") + 1_000_000).alias("doc_id"), "text")
    one, log = lm_score.fit(docs, vocab, share=1.0)
    _, two = lm_score.fit(docs.union(copies), vocab, share=1.0)
    assert sum(n for n, _ in log) == vocab.n and sum(n for n, _ in two) == 2 * vocab.n
    assert log[-1][1] < log[0][1]  # later rounds, of other documents, lose less
    part = sum(n for n, _ in lm_score.fit(docs, vocab)[1])
    assert 0.5 * vocab.n < part / lm_score.TRAIN_SHARE < 2 * vocab.n


def test_lm_odd_rows(make_docs, odd_rows):
    got = lm_score.score(make_docs(odd_rows)).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r["doc_id"] in (1, 2, 3):
            assert r["n_tokens"] == 1
        assert math.isfinite(r["score"]) and r["score"] <= 1e-9 and r["base_score"] <= 0
    assert lm_score.score(make_docs([])).count() == 0


def test_scores_rank_by_what_only_clean_documents_hold():
    """Toxic documents that lack a word of the clean ones hold no word that marks them."""
    rng = np.random.default_rng(11)
    vocab = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(400):
        words = list(rng.choice(vocab, 60))
        if i % 4:
            words[7] = words[30] = "please"
        texts.append((" ".join(words), int(i % 4 == 0)))
    tagger = toxicity.train(texts[:300])
    p, _, _ = toxicity._Scorer(tagger).score([t.encode() for t, _ in texts[300:]])
    y = np.array([v for _, v in texts[300:]])
    assert np.mean(p[y == 1][:, None] > p[y == 0][None, :]) > 0.95


def test_lm_learns_from_every_training_document(spark):
    docs = spark.createDataFrame([(i, f"a b c d{i % 5}") for i in range(300)], "doc_id long, text string")
    counts = Counter(t for r in docs.collect() for t in lm_score.tokens_of(r["text"].encode()))
    vocab = lm_score.Vocabulary(list(counts.items()), sum(counts.values()), len(counts))
    assert sum(n for n, _ in lm_score.fit(docs, vocab)[1]) == vocab.n


def test_piece_tasks_work_on_small_slices(spark, monkeypatch):
    """Slices are cut by texts and by ids, and the result does not depend on them."""
    import pyarrow as pa
    from ledgerlens.llm.common import slices
    batch = pa.RecordBatch.from_arrays([pa.array([[1, 2], None, [3, 4, 5], [6]], pa.list_(pa.int32()))], names=["ids"])
    assert [b.num_rows for b in slices(iter([batch]), "ids", 3)] == [2, 1, 1]
    docs = spark.createDataFrame([(i, f"some words {i}" if i % 7 else None) for i in range(60)], "doc_id long, text string").coalesce(1)
    whole = [tuple(r["ids"]) for r in piece_dropout.encode(docs, F.col("doc_id")).orderBy("doc_id").collect()]
    monkeypatch.setattr(piece_dropout, "ENCODE_BYTES", 30)
    monkeypatch.setattr(piece_dropout, "DECODE_IDS", 7)
    cut = piece_dropout.encode(docs, F.col("doc_id"))
    assert [tuple(r["ids"]) for r in cut.orderBy("doc_id").collect()] == whole
    back = piece_dropout.decode(cut).orderBy("doc_id").collect()
    assert [r["decoded"] for r in back] == [r["text"] or "" for r in back]


def test_lm_training_takes_steps_of_about_the_same_size(monkeypatch):
    """A long document among short ones makes no run of steps of its own, whose few tokens would each move all weights."""
    vocab = lm_score.Vocabulary([(f"w{i}".encode(), 3000 - i) for i in range(100)] + [(lm_score.END, 500)], 300_000, 200)
    rng = np.random.default_rng(3)
    docs = [rng.integers(100, size=n) for n in [100] * 400 + [6000]]
    net, sizes = lm_score.WordNet(vocab), []
    whole = net.train_window
    monkeypatch.setattr(net, "train_window", lambda i, t, *a: (sizes.append(int((t >= 0).sum())), whole(i, t, *a))[1])
    read, _ = lm_score.learn(net, docs, lanes=32)
    assert read == sum(sizes) == 46_000
    assert len(sizes) <= 2 * read / (32 * lm_score.WINDOW)


def test_wide_steps_give_what_the_plain_ones_give():
    """With a state cleared on the way, and gradients cut there and at the window's start."""
    rng = np.random.default_rng(4)
    n, lanes = 5, 3
    gates, u = rng.standard_normal((8, lanes, 3 * n)).astype(gru.DTYPE), gru.weights(rng, n, 3 * n)
    h = rng.standard_normal((lanes, n)).astype(gru.DTYPE)
    keep = np.ones((8, lanes), dtype=bool)
    keep[4] = False
    d_states = rng.standard_normal((8, lanes, n)).astype(gru.DTYPE)
    halves = [gru.forward(g, s, u) for g, s in ((gates[:4], h), (gates[4:], np.zeros_like(h)))]
    wide = np.ascontiguousarray((gates * gru.signs(n)).transpose(0, 2, 1))
    states, own = gru.forward_wide(wide, np.ascontiguousarray(h.T), u, keep)
    assert np.allclose(states.transpose(0, 2, 1), np.concatenate([s for s, _ in halves]), atol=1e-5)
    before = np.concatenate([h.T[None], states[:-1]]) * keep[:, None]
    backs = [gru.backward(d, tape, u) for d, (_, tape) in zip((d_states[:4], d_states[4:]), halves)]
    for cut in (8, 4):  # the cleared state ends the gradient as the cut does
        d_gates, d_u = gru.backward_wide(np.ascontiguousarray(d_states.transpose(0, 2, 1)), wide, before, own, u, keep, cut)
        assert np.allclose(d_gates.transpose(0, 2, 1), np.concatenate([g for g, _ in backs]), atol=1e-5)
        assert np.allclose(d_u, backs[0][1] + backs[1][1], atol=1e-4)


def test_lm_words_and_symbols_of_columns(spark):
    """Arrow cuts words as the plain tokens do; an empty vocabulary leaves all of them, the end too, beyond the table."""
    texts = ["A b\x0ba\tB\r\n", None, "", " \x0c ", "É é  x　y\x1cz", "zz zz b " * 3]
    tokens = [lm_score.tokens_of((t or "").encode()) for t in texts]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    counts = {bytes(r["word"]): r["c"] for r in lm_score.count_words(docs).collect()}
    assert counts == Counter(t for ts in tokens for t in ts)
    for vocab in (lm_score.Vocabulary([(b"b", 9), (lm_score.END, 6), (b"a", 2)], 40, 9), lm_score.Vocabulary([], 0, 0)):
        rows = lm_score.coded(docs.withColumn("held_out", F.lit(False)), vocab).orderBy("doc_id").collect()
        for r, ts in zip(rows, tokens):
            syms, at, beyond = lm_score.symbols(ts, vocab)
            assert np.frombuffer(r["syms"], lm_score.SYMBOL).tolist() == syms.tolist()
            assert (r["n_tokens"], r["table_known"], r["n_tail"]) == (len(ts), int((at >= 0).sum()), len(beyond))
            assert {bytes(x["word"]): x["n"] for x in r["tail"]} == Counter(beyond)
            if len(vocab.counts):
                assert r["table_log"] == pytest.approx(np.log10(vocab.counts + 1)[at[at >= 0]].sum())
                assert r["inside"] == pytest.approx(vocab.inside[at[at >= 0]].sum())

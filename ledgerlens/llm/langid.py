"""Language identification by a bidirectional gated recurrent network over bytes.

Words (runs between white space, A-Z lower-cased) are the network's sequences:
a forward and a backward layer read the bytes and every byte position gets
a distribution over the languages; a document pools the distributions of all its positions.
The state starts anew at each word, so equal words have equal outputs and
a task runs the network once per distinct word, whatever a document's length.
Training is numpy backpropagation through time on a bounded sample of labelled
documents.
"""
from __future__ import annotations

import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import LOWER, append_columns, id_crc, text_window

HIDDEN = 12
EMBED = 8
# Longer words are read as pieces of this many bytes.
WORD_BYTES = 24
# Bounds of the training sample: documents per language, languages (the most frequent), characters
# of a document: of a longer one a stretch of that length is read.
DOCS_PER_LANG = 250
MAX_LANGS = 100
TRAIN_CHARS = 20_000
STEPS = 500
BATCH = 384
UNKNOWN = "und"
# A task keeps the outputs of so many distinct words.
CACHE_WORDS = 400_000

_ASCII_LETTER = re.compile(rb"[A-Za-z]")


def has_letter(text: bytes | None) -> bool:
    return bool(text) and (_ASCII_LETTER.search(text) is not None or any(c.isalpha() for c in text.decode()))


def words_of(text: bytes | None) -> list[bytes]:
    words = (text or b"").translate(LOWER).split()
    if any(len(w) > WORD_BYTES for w in words):
        words = [w[i:i + WORD_BYTES] for w in words for i in range(0, len(w), WORD_BYTES)]
    return words


class ByteNet:
    def __init__(self, langs: list[str], seed: int = 1, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.langs, self.hidden = langs, hidden
        self.p = {"embed": weights_(rng, 256, EMBED), "out": gru.weights(rng, 2 * hidden, len(langs)),
                  "out_b": np.zeros(len(langs), dtype=gru.DTYPE)}
        for side in "fb":
            self.p |= {f"x{side}": gru.weights(rng, EMBED, 3 * hidden), f"u{side}": gru.weights(rng, hidden, 3 * hidden),
                       f"c{side}": np.zeros(3 * hidden, dtype=gru.DTYPE)}

    def train_step(self, seqs: np.ndarray, sizes: np.ndarray, target: np.ndarray) -> tuple[float, dict]:
        """seqs [batch, time] of bytes, zero beyond sizes; the target language holds at every position."""
        p, n, (batch, time) = self.p, self.hidden, seqs.shape
        inside = np.arange(time)[:, None] < sizes[None, :]
        back = np.where(inside.T, sizes[:, None] - 1 - np.arange(time)[None, :], 0)
        lines = np.arange(batch)[:, None]
        reads = {"f": seqs, "b": np.where(inside.T, seqs[lines, back], 0)}
        runs, states = {}, {}
        for side, s in reads.items():
            emb = p["embed"][s.T]
            states[side], runs[side] = gru.forward(emb @ p[f"x{side}"] + p[f"c{side}"], np.zeros((batch, n), gru.DTYPE), p[f"u{side}"])
        aligned = states["b"][back.T, lines.T]  # the backward layer's state at position i
        both = np.concatenate([states["f"], aligned], axis=2)
        prob = gru.softmax(both @ p["out"] + p["out_b"])
        total = inside.sum()
        hit = prob[np.arange(time)[:, None], lines.T, target[None, :]]
        loss = float(-(np.log(hit + 1e-9) * inside).sum() / total)
        d = prob.copy()
        d[np.arange(time)[:, None], lines.T, target[None, :]] -= 1
        d *= (inside / total)[:, :, None]
        d = d.astype(gru.DTYPE)
        g = {"out": both.reshape(-1, 2 * n).T @ d.reshape(-1, d.shape[2]), "out_b": d.sum(axis=(0, 1)), "embed": np.zeros_like(p["embed"])}
        d_both = d @ p["out"].T
        d_side = {"f": d_both[:, :, :n], "b": np.zeros_like(states["b"])}
        np.add.at(d_side["b"], (back.T, np.broadcast_to(lines.T, back.T.shape)), d_both[:, :, n:] * inside[:, :, None])
        for side, s in reads.items():
            d_gates, g[f"u{side}"] = gru.backward(d_side[side], runs[side], p[f"u{side}"])
            flat = d_gates.reshape(-1, 3 * n)
            g[f"x{side}"] = p["embed"][s.T].reshape(-1, EMBED).T @ flat
            g[f"c{side}"] = flat.sum(axis=0)
            np.add.at(g["embed"], s.T.reshape(-1), flat @ p[f"x{side}"].T)
        return loss, g

    def positions(self, words: list[bytes]) -> np.ndarray:
        """Per word the sum over its positions of the language distributions."""
        p, n = self.p, self.hidden
        table = {side: p["embed"] @ p[f"x{side}"] + p[f"c{side}"] for side in "fb"}
        sizes = np.array([len(w) for w in words])
        out = np.zeros((len(words), len(self.langs)), dtype=gru.DTYPE)
        order = np.argsort(sizes, kind="stable")
        cuts = np.flatnonzero(np.diff(sizes[order])) + 1
        for rows in np.split(order, cuts):
            size = int(sizes[rows[0]]) if len(rows) else 0
            for i in range(0, len(rows) if size else 0, 4096):
                part = rows[i:i + 4096]
                seq = np.frombuffer(b"".join([words[r] for r in part]), dtype=np.uint8).reshape(len(part), size)
                h = {"f": [], "b": []}
                for side, at in (("f", range(size)), ("b", range(size - 1, -1, -1))):
                    state = np.zeros((len(part), n), dtype=gru.DTYPE)
                    for t in at:
                        state = gru.step(table[side][seq[:, t]], state, p[f"u{side}"])
                        h[side].append(state)
                h["b"].reverse()
                for f, b in zip(h["f"], h["b"]):
                    out[part] += gru.softmax(f @ p["out"][:n] + b @ p["out"][n:] + p["out_b"])
        return out


def weights_(rng: np.random.Generator, rows: int, columns: int) -> np.ndarray:
    return (rng.standard_normal((rows, columns)) * 0.5).astype(gru.DTYPE)


def train(samples: list[tuple[str, str]], steps: int = STEPS, seed: int = 1) -> ByteNet:
    """Fit on (text, language) pairs; words are drawn evenly over languages, weighted by their counts."""
    langs = sorted({lang for _, lang in samples})
    net, rng = ByteNet(langs, seed), np.random.default_rng(seed)
    counts = [Counter() for _ in langs]
    for text, lang in samples:
        counts[langs.index(lang)].update(words_of(text.encode()))
    words = [list(c) for c in counts]
    cum = [np.cumsum(np.array([c[w] for w in ws], dtype=float)) for c, ws in zip(counts, words)]
    usable = [i for i, c in enumerate(cum) if len(c)]
    opt = gru.Adam(net.p, 0.01)
    for k in range(steps if usable else 0):
        target = np.array(usable)[rng.integers(len(usable), size=BATCH)]
        drawn = [words[t][int(np.searchsorted(cum[t], rng.random() * cum[t][-1], side="right"))] for t in target]
        sizes = np.array([len(w) for w in drawn])
        seqs = np.zeros((BATCH, sizes.max()), dtype=np.int64)
        for i, w in enumerate(drawn):
            seqs[i, :len(w)] = np.frombuffer(w, dtype=np.uint8)
        _, grads = net.train_step(seqs, sizes, target)
        opt.update(grads, 0.01 * (1 - 0.9 * k / steps))
    return net


def training_sample(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
                    per_lang: int = DOCS_PER_LANG) -> list[tuple[str, str]]:
    """At most about ``per_lang`` documents a language outside the held-out fold, drawn by a hash of the id."""
    lang, doc = F.col(f"`{lang_col}`").cast("string"), F.col(f"`{id_col}`")
    usable = docs.select(doc.alias("doc"), lang.alias("lang"), F.col(f"`{text_col}`").cast("string").alias("text")).where(
        "lang is not null and text is not null and doc is not null").where(id_crc(F.col("doc")) % 5 != 0).where(
        F.length("text") > 0)
    counts = usable.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGS).collect()
    if not counts:
        return []
    share = F.element_at(F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, per_lang / r["count"]))]), F.col("lang"))
    draw = F.pmod(F.xxhash64(F.col("doc").cast("string")), F.lit(1_000_003)) / 1_000_003.0
    picked = usable.where(F.col("lang").isin([r["lang"] for r in counts])).where(draw < share)
    rows = picked.select("doc", text_window(F.col("text"), TRAIN_CHARS).alias("text"), "lang").collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (str(r["doc"]), r["text"], r["lang"]))]


class _Cache:
    """Word sums of a task, kept across its batches up to CACHE_WORDS."""

    def __init__(self, net: ByteNet):
        self.net = net
        self.clear()

    def clear(self) -> None:
        self.index: dict[bytes, int] = {}
        self.sums = np.zeros((0, len(self.net.langs)), dtype=gru.DTYPE)

    def rows(self, words: list[bytes]) -> np.ndarray:
        if len(self.index) > CACHE_WORDS:
            self.clear()
        fresh = list(dict.fromkeys(w for w in words if w not in self.index))
        if fresh:
            self.index.update(zip(fresh, range(len(self.index), len(self.index) + len(fresh))))
            self.sums = np.concatenate([self.sums, self.net.positions(fresh)])
        return np.fromiter((self.index[w] for w in words), dtype=np.int64, count=len(words))


def predict_texts(texts: list[bytes | None], cache: _Cache) -> tuple[list[str], list[float]]:
    net = cache.net
    docs = [words_of(t) if has_letter(t) else [] for t in texts]
    rows = cache.rows([w for d in docs for w in d])
    ends = np.cumsum([len(d) for d in docs])
    langs, scores = [], []
    for d, end in zip(docs, ends):
        if not d or not net.langs:
            langs.append(UNKNOWN)
            scores.append(0.0)
            continue
        pooled = cache.sums[rows[end - len(d):end]].sum(axis=0, dtype=np.float64)
        best = int(pooled.argmax())
        langs.append(net.langs[best])
        scores.append(float(min(1.0, pooled[best] / sum(len(w) for w in d))))
    return langs, scores


def predict(docs: DataFrame, net: ByteNet, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add lang_pred and score to every document, from its whole text alone.

    Null texts and texts without a letter get ``und`` and 0, as does every text when no
    labelled document was there to learn from. The score is the pooled probability of the
    predicted language.
    """
    return append_columns(docs, text_col, "lang_pred string, score double", predict_texts, keep=keep, setup=lambda: (_Cache(net),))


def identify(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, lang_pred, score: learned from the labelled documents outside the held-out fold."""
    net = train(training_sample(docs, text_col, lang_col, id_col))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    held = F.coalesce(id_crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    return predict(rows, net, "text", ["doc_id"]).select("doc_id", held.alias("held_out"), "lang_pred", "score")

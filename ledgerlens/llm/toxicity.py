"""Toxic span tagging by a linear-chain conditional random field, and document scores.

Labels exist for documents only, so token labels are derived first: a feature (a word,
or the first characters of a word) whose occurrences in toxic documents exceed what
its rate in clean ones explains marks its tokens there. The chain has two states (clean,
toxic); its emission is a sum of hashed word features, trained on the labelled tokens by
the exact gradient of the log-likelihood. Forward-backward gives each token's
probability; a logistic model over sums of these turns them into the document's
score, and tokens above one half give the offending offsets. What toxic words do not show, since documents of the two labels
differ in words that clean ones hold or in rates of common ones, enters the score by the evidence of all words: shrunk
log-odds of their features between toxic and clean documents.

Forward-backward runs on windows of all documents of a batch side by side: the
2x2 transfer matrices of a window are multiplied first, so states cross windows
exactly and a long document costs no more per token.
"""
from __future__ import annotations

import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import gru
from .common import LOWER, append_columns, id_crc, ragged, text_window

# Bounds of the training sample: documents per label, characters of a document (of a longer one a stretch of that length).
DOCS_PER_LABEL = 1200
TRAIN_CHARS = 12_000
BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6, 7, 8)
ROUNDS = 40
WINDOW = 64
# A task keeps the emissions of so many distinct words.
CACHE_WORDS = 600_000
CERTAIN = 0.98
# Training documents of one label whose sets of SHINGLE-word runs have this Jaccard similarity are copies of one.
SHINGLE = 5
COPY = 0.8
N_FEATURES = 11
# So many documents that hold a feature at the overall rate are added to those seen.
SHRINK = 2.0
_EDGE = bytes(c for c in range(33, 127) if not chr(c).isalnum())
_TOKEN = re.compile(rb"[^\x20\x09-\x0D]+")


def buckets(word: bytes) -> list[int]:
    """Hashed features of a word (A-Z lower-cased): the word without punctuation at its edges, and its first characters."""
    w = word.strip(_EDGE)
    if not w.isascii():
        return _text_buckets(w.decode(errors="replace").lower())
    found, crc, done = [zlib.crc32(w, 1) % BUCKETS] if w else [], 0, 0
    for n in PREFIXES:
        if n >= len(w):
            break
        crc, done = zlib.crc32(w[done:n], crc), n
        found.append(crc % BUCKETS)
    return found


def _text_buckets(w: str) -> list[int]:
    """The same features, by characters."""
    return [zlib.crc32(w.encode(), 1) % BUCKETS] + [zlib.crc32(w[:n].encode()) % BUCKETS for n in PREFIXES if n < len(w)]


def windows(sizes: np.ndarray, width: int = WINDOW):
    """Cut documents of ``sizes`` tokens into windows: (document, first token, tokens) of each, document by document."""
    per = -(-sizes // width)
    doc = np.repeat(np.arange(len(sizes)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    base = np.cumsum(sizes) - sizes
    return doc, nth, base[doc] + nth * width, np.minimum(width, sizes[doc] - nth * width)


def marginals(score: np.ndarray, sizes: np.ndarray, trans: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Forward-backward of many chains of two states.

    score: the toxic state's emission of every token, documents one after another (the clean
    state's is 0). trans: 2x2 log potentials. Gives each token's toxic
    probability, the expected count of each transition, and per document the log of the normaliser.
    """
    n = len(score)
    doc, nth, first, length = windows(sizes, width)
    logz = np.zeros(len(sizes))
    if not n:
        return np.empty(0), np.zeros((2, 2)), logz
    m = len(doc)
    em = np.zeros((width, m))
    at = first[None, :] + np.arange(width)[:, None]
    inside = np.arange(width)[:, None] < length[None, :]
    em[inside] = score[at[inside]]
    peak = np.maximum(em, 0.0)
    e0, e1 = np.exp(-peak), np.exp(em - peak)
    a = np.exp(trans - trans.max())
    starts = nth == 0
    # the first token of a document has no transition: its matrix has equal rows
    def factors(t):
        k00, k01, k10, k11 = a[0, 0] * e0[t], a[0, 1] * e1[t], a[1, 0] * e0[t], a[1, 1] * e1[t]
        if t == 0:
            k00, k10 = np.where(starts, e0[t], k00), np.where(starts, e0[t], k10)
            k01, k11 = np.where(starts, e1[t], k01), np.where(starts, e1[t], k11)
        out = ~inside[t]
        if out.any():
            k00, k11 = np.where(out, 1.0, k00), np.where(out, 1.0, k11)
            k01, k10 = np.where(out, 0.0, k01), np.where(out, 0.0, k10)
        return k00, k01, k10, k11

    p00, p01, p10, p11 = np.ones(m), np.zeros(m), np.zeros(m), np.ones(m)
    kept = []
    for t in range(width):
        f = factors(t)
        kept.append(f)
        p00, p01, p10, p11 = p00 * f[0] + p01 * f[2], p00 * f[1] + p01 * f[3], p10 * f[0] + p11 * f[2], p10 * f[1] + p11 * f[3]
        s = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / s, p01 / s, p10 / s, p11 / s
    # states at the windows' edges, window number by window number over all documents
    alpha, beta = np.empty((m, 2)), np.empty((m, 2))
    order = np.argsort(nth, kind="stable")
    groups = np.split(order, np.flatnonzero(np.diff(nth[order])) + 1)
    state_after, state_before = np.empty((m, 2)), np.empty((m, 2))
    for g in groups:
        prev = np.full((len(g), 2), 0.5) if nth[g[0]] == 0 else state_after[g - 1]
        alpha[g] = prev
        v = np.stack([prev[:, 0] * p00[g] + prev[:, 1] * p10[g], prev[:, 0] * p01[g] + prev[:, 1] * p11[g]], axis=1)
        state_after[g] = v / v.sum(axis=1, keepdims=True)
    last = np.append(doc[1:] != doc[:-1], True)
    for g in reversed(groups):
        nxt = np.where(last[g][:, None], 0.5, state_before[np.minimum(g + 1, m - 1)])
        beta[g] = nxt
        v = np.stack([p00[g] * nxt[:, 0] + p01[g] * nxt[:, 1], p10[g] * nxt[:, 0] + p11[g] * nxt[:, 1]], axis=1)
        state_before[g] = v / v.sum(axis=1, keepdims=True)
    # inside the windows
    forward = np.empty((width + 1, m, 2))
    forward[0] = alpha
    norms = np.zeros((width, m))
    for t in range(width):
        k00, k01, k10, k11 = kept[t]
        f0, f1 = forward[t, :, 0], forward[t, :, 1]
        g0, g1 = f0 * k00 + f1 * k10, f0 * k01 + f1 * k11
        s = g0 + g1
        forward[t + 1, :, 0], forward[t + 1, :, 1] = g0 / s, g1 / s
        norms[t] = np.log(s)
    logz_parts = (norms + peak * inside + trans.max() * (inside & ~((np.arange(width)[:, None] == 0) & starts[None, :]))).sum(axis=0)
    np.add.at(logz, doc, logz_parts)
    toxic, count = np.empty((width, m)), np.zeros((2, 2))
    b0, b1 = beta[:, 0], beta[:, 1]
    for t in range(width - 1, -1, -1):
        g0, g1 = forward[t + 1, :, 0] * b0, forward[t + 1, :, 1] * b1
        toxic[t] = g1 / (g0 + g1)
        k00, k01, k10, k11 = kept[t]
        f0, f1 = forward[t, :, 0], forward[t, :, 1]
        parts = (f0 * k00 * b0, f0 * k01 * b1, f1 * k10 * b0, f1 * k11 * b1)
        total = parts[0] + parts[1] + parts[2] + parts[3]
        real = inside[t] & ~starts if t == 0 else inside[t]
        for i, q in enumerate(parts):
            count[i // 2, i % 2] += float((q / total)[real].sum())
        b0, b1 = k00 * b0 + k01 * b1, k10 * b0 + k11 * b1
        s = b0 + b1
        b0, b1 = b0 / s, b1 / s
    out = np.empty(n)
    out[at[inside]] = toxic[inside]
    return out, count, logz


class Tagger:
    """Weights of hashed features, a bias, transitions, and the document model."""

    def __init__(self):
        self.weights = np.zeros(BUCKETS, dtype=np.float64)
        self.bias = -6.0
        self.trans = np.zeros((2, 2))
        self.evidence = np.zeros(BUCKETS, dtype=np.float64)
        self.doc_weights = np.zeros(N_FEATURES)
        self.doc_weights[0] = -3.0

    def emissions(self, words: list[bytes]) -> list[float]:
        weight = self.weights.tolist()
        return [self.bias + sum([weight[b] for b in buckets(w)]) for w in words]

    def both(self, words: list[bytes]) -> np.ndarray:
        """Emission and evidence of every word."""
        flat, counts = feature_lists(words)
        owner = np.repeat(np.arange(len(words)), counts)
        return np.stack([np.bincount(owner, self.weights[flat], minlength=len(words)) + self.bias,
                         word_evidence(self.evidence, flat, counts)], axis=1)


def feature_lists(words) -> tuple[np.ndarray, np.ndarray]:
    """Features of the words, one word after another, and their numbers."""
    flat, counts = array("i"), array("i")
    for w in words:
        found = buckets(w)
        flat.extend(found)
        counts.append(len(found))
    return np.array(flat, dtype=np.int32), np.array(counts, dtype=np.int64)


def word_evidence(evidence: np.ndarray, flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The mean evidence of each word's features; 0 without any."""
    return np.bincount(np.repeat(np.arange(len(counts)), counts), evidence[flat], minlength=len(counts)) / np.maximum(counts, 1)


def document_features(toxic: np.ndarray, sizes: np.ndarray, evidence: np.ndarray) -> np.ndarray:
    """Per document: 1, log of the expected toxic tokens, their share, the largest probability and its log-odds, length, tokens above one half and near one,
    and the mean, least and largest evidence of its words. ``toxic`` and ``evidence`` are those of all tokens."""
    out = np.zeros((len(sizes), N_FEATURES))
    out[:, 0] = 1.0
    some = sizes > 0
    if some.any():
        starts = (np.cumsum(sizes) - sizes)[some]
        total, top = np.add.reduceat(toxic, starts), np.maximum.reduceat(toxic, starts)
        out[some, 1] = np.log(total + 1e-3)
        out[some, 2] = np.log(total / sizes[some] + 1e-5)
        out[some, 3] = top
        out[some, 5] = np.log1p(np.add.reduceat((toxic > 0.5).astype(float), starts))
        out[some, 6] = np.log1p(np.add.reduceat((toxic > CERTAIN).astype(float), starts))
        out[some, 7] = np.clip(np.log(top + 1e-6) - np.log(1 - top + 1e-6), -8, 8)
        out[some, 8] = 10 * np.add.reduceat(evidence, starts) / sizes[some]
        out[some, 9], out[some, 10] = np.minimum.reduceat(evidence, starts), np.maximum.reduceat(evidence, starts)
    out[~some, 1], out[~some, 2], out[~some, 7] = np.log(1e-3), np.log(1e-5), -8
    out[:, 4] = np.log1p(sizes)
    return out


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split()


def copies(docs: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """Number of the group of near copies that each document is in: its own number, or an earlier document's with the same label.

    A document joins the first one that opened a group and whose runs of SHINGLE words have a Jaccard similarity
    of COPY or more with its own. All its words count; a document of fewer words is one run. Runs are ordered rarest
    first, so two sets of that similarity share one of the first runs of each (prefix filter) and few pairs are compared.
    """
    mix = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]
    sets = []
    for d in docs:
        w = d.astype(np.uint64) + np.uint64(1)
        n = max(len(w) - SHINGLE + 1, min(len(w), 1))
        run = np.zeros(n, dtype=np.uint64)
        for j, m in enumerate(mix[:min(SHINGLE, len(w))]):
            part = w[j:j + n] * m
            run = (run ^ (part ^ (part >> np.uint64(29)))) * mix[0]
        sets.append(np.unique(run))
    sizes = np.array([len(x) for x in sets])
    runs, number, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(held, kind="stable")
    rank = np.empty(len(runs), dtype=np.int32)
    rank[order] = np.arange(len(runs), dtype=np.int32)
    shared = int(np.count_nonzero(held == 1))  # runs from this rank on are held by several documents
    sets = [np.sort(x) for x in np.split(rank[number].astype(np.int32), np.cumsum(sizes)[:-1])]
    group = np.arange(len(docs))
    openers: dict[tuple[int, int], list[int]] = {}
    for i, (mine, y) in enumerate(zip(sets, labels)):
        prefix = [(int(y), r) for r in mine[:len(mine) - int(np.ceil(COPY * len(mine) - 1e-9)) + 1].tolist()]
        for k in sorted({k for r in prefix for k in openers.get(r, ())}):
            small, large = sorted((len(mine), len(sets[k])))
            if small >= COPY * large - 1e-9:
                both = len(np.intersect1d(mine, sets[k], assume_unique=True))
                if both >= COPY * (small + large - both) - 1e-9:
                    group[i] = k
                    break
        else:
            for r in prefix:
                if r[1] >= shared:
                    openers.setdefault(r, []).append(i)
    return group


def holders(docs: list[np.ndarray], toxic: np.ndarray, group: np.ndarray, flat: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Clean and toxic documents that hold each feature, and all of either label; near copies (see copies) count once.

    docs: word numbers of each document; the features of word w are flat[starts[w]:starts[w] + counts[w]].
    """
    # a feature is held by a group of near copies when one of them holds it
    seen = np.zeros((2, BUCKETS))
    size = np.zeros(2)
    order = np.argsort(group, kind="stable")
    for members in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
        held = np.unique(np.concatenate([docs[i] for i in members]))
        if len(held):
            y = int(toxic[members[0]])
            size[y] += 1
            seen[y, np.unique(flat[ragged(starts[held], counts[held])])] += 1
    return seen, size


def feature_evidence(seen: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Log of how much oftener toxic documents hold a feature than clean ones do, towards 0 for those seen rarely."""
    share = np.maximum(size, 1) / np.maximum(size, 1).sum()
    rate = (seen + SHRINK * share[:, None]) / np.maximum(size, 1)[:, None]
    return np.log(rate[1]) - np.log(rate[0])


def token_labels(docs: list[np.ndarray], toxic: np.ndarray, held: tuple[np.ndarray, np.ndarray], flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """1 for tokens of toxic documents with a feature that far more of these hold than clean ones do, and not by chance.

    held: the holders of every feature.
    """
    seen, size = held
    expected = (seen[0] + 0.5) / max(size[0], 1) * size[1]
    excess = 1 - expected / np.maximum(seen[1], 1e-9)
    surprise = (seen[1] - expected) / np.sqrt(expected + 1)
    # seen in enough toxic documents, mostly there, and far beyond the chance of a frequent feature
    strong = (excess > 0.6) & (surprise > 3) & (seen[1] >= max(5, 0.01 * size[1]))
    marked = np.zeros(len(counts), dtype=bool)
    owner = np.repeat(np.arange(len(counts)), counts)
    marked[owner[strong[flat]]] = True
    return np.concatenate([marked[d] & bool(y) for d, y in zip(docs, toxic)]).astype(np.float64)


def _chain(docs: list[np.ndarray], y: np.ndarray, group: np.ndarray, flat: np.ndarray, counts: np.ndarray, rounds: int) -> dict:
    """Emission weights w, bias b and transitions t fitted to the token labels of the given documents, and the features' evidence e."""
    n_words = len(counts)
    held = holders(docs, y, group, flat, np.cumsum(counts) - counts, counts)
    gold = token_labels(docs, y, held, flat, counts)
    sizes = np.array([len(d) for d in docs])
    ids = np.concatenate(docs)
    columns = np.repeat(np.arange(n_words, dtype=np.int32), counts)
    starts = np.zeros(len(ids), dtype=bool)
    starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
    pair = np.zeros((2, 2))
    inner = np.flatnonzero(~starts)
    for i in (0, 1):
        for j in (0, 1):
            pair[i, j] = ((gold[inner - 1] == i) & (gold[inner] == j)).sum()
    hits = np.bincount(ids, weights=gold, minlength=n_words)
    blank = Tagger()
    params = {"w": blank.weights.astype(gru.DTYPE), "b": np.array([blank.bias], dtype=gru.DTYPE), "t": blank.trans.astype(gru.DTYPE)}
    opt = gru.Adam(params, 0.4)
    scale = 1.0 / max(1.0, gold.sum())
    for k in range(rounds):
        p, count, _ = marginals(_word_scores(params, flat, columns, n_words)[ids], sizes, params["t"].astype(float))
        off = np.bincount(ids, weights=p, minlength=n_words) - hits
        g = {"w": np.bincount(flat, weights=off[columns], minlength=BUCKETS) * scale + 2e-3 * scale * params["w"],
             "b": np.array([off.sum()]) * scale, "t": (count - pair) * scale}
        opt.update({n: v.astype(gru.DTYPE) for n, v in g.items()}, 0.4 * (1 - 0.8 * k / rounds))
    return params | {"e": feature_evidence(*held)}


def _word_scores(params: dict, flat: np.ndarray, columns: np.ndarray, n_words: int) -> np.ndarray:
    return np.bincount(columns, weights=params["w"][flat], minlength=n_words) + params["b"][0]


def _features(params: dict, docs: list[np.ndarray], flat: np.ndarray, counts: np.ndarray) -> np.ndarray:
    sizes = np.array([len(d) for d in docs])
    score = _word_scores(params, flat, np.repeat(np.arange(len(counts), dtype=np.int32), counts), len(counts))
    ids = np.concatenate(docs)
    return document_features(marginals(score[ids], sizes, params["t"].astype(float))[0], sizes, word_evidence(params["e"], flat, counts)[ids])


def train(samples: list[tuple[str, int]], rounds: int = ROUNDS, prior: float | None = None) -> Tagger:
    """Fit tagger and document model on (text, toxic 0 or 1); equal texts count once. ``prior``: share of toxic documents overall.

    The document model learns from token probabilities of chains that have not seen the document (two halves, near copies
    in one of them), since a chain's own documents hold every word that it took for toxic by chance.
    """
    tagger = Tagger()
    unique = dict(samples)
    y = np.array([int(v) for v in unique.values()], dtype=np.int64)
    if not len(y) or y.min() == y.max():
        if len(y):
            tagger.doc_weights[:] = 0
            tagger.doc_weights[0] = 3.0 if y[0] else -3.0
        return tagger
    # words become numbers, and their features one flat array, before anything else is held
    numbers: dict[bytes, int] = {}
    docs = [np.array([numbers.setdefault(w, len(numbers)) for w in tokens_of(t.encode())], dtype=np.int32) for t in unique]
    flat, counts = feature_lists(numbers)
    del numbers, unique
    group = copies(docs, y)
    half = np.zeros(len(y), dtype=np.int64)
    for label in (0, 1):
        half[y == label] = np.unique(group[y == label], return_inverse=True)[1] % 2
    x = np.zeros((len(y), N_FEATURES))
    apart = all(len(np.unique(half[y == label])) == 2 for label in (0, 1))
    if apart:
        for k in (0, 1):
            seen, other = np.flatnonzero(half != k), np.flatnonzero(half == k)
            params = _chain([docs[i] for i in seen], y[seen], group[seen], flat, counts, rounds)
            x[other] = _features(params, [docs[i] for i in other], flat, counts)
    params = _chain(docs, y, group, flat, counts, rounds)
    if not apart:
        x = _features(params, docs, flat, counts)
    tagger.weights, tagger.bias, tagger.trans = params["w"].astype(float), float(params["b"][0]), params["t"].astype(float)
    tagger.evidence = params["e"]
    tagger.doc_weights = _logistic(x, y, y.mean() if prior is None else prior)
    return tagger


def _logistic(x: np.ndarray, y: np.ndarray, prior: float) -> np.ndarray:
    """Newton steps of a lightly penalised logistic fit, weighted so that toxic documents have the share ``prior``."""
    share = y.mean()
    weight = np.where(y == 1, prior / share, (1 - prior) / (1 - share))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + 0.05 * w
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(hess, grad), -2, 2)
    return w


class _Scorer:
    """Emissions and evidence of a task's words, kept across its batches up to CACHE_WORDS."""

    def __init__(self, tagger: Tagger):
        self.tagger, self.cache, self.known = tagger, {}, np.empty((0, 2))

    def score(self, texts: list[bytes | None]):
        docs = [tokens_of(t) for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache, self.known = {}, np.empty((0, 2))
        cache = self.cache
        fresh = list({w for d in docs for w in d if w not in cache})
        cache.update(zip(fresh, range(len(cache), len(cache) + len(fresh))))
        self.known = np.concatenate([self.known, self.tagger.both(fresh)])
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        found = self.known[np.fromiter((cache[w] for d in docs for w in d), dtype=np.int64, count=int(sizes.sum()))]
        toxic, _, _ = marginals(found[:, 0], sizes, self.tagger.trans)
        logit = document_features(toxic, sizes, found[:, 1]) @ self.tagger.doc_weights
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30))), toxic, sizes


def _spans(text: bytes, toxic: np.ndarray) -> list[dict]:
    """Runs of tokens above one half as code point offsets [start, end) with their largest probability."""
    out: list[dict] = []
    for i, m in enumerate(_TOKEN.finditer(text)):
        if toxic[i] > 0.5:
            if out and out[-1]["_last"] == i - 1:
                out[-1] |= {"_end": m.end(), "_last": i, "probability": max(out[-1]["probability"], float(toxic[i]))}
            else:
                out.append({"_start": m.start(), "_end": m.end(), "_last": i, "probability": float(toxic[i])})
    return [{"start": len(text[:s["_start"]].decode()), "end": len(text[:s["_end"]].decode()), "probability": s["probability"]} for s in out]


def tag(docs: DataFrame, tagger: Tagger, text_col: str = "text", keep: list[str] | None = None, spans: bool = True) -> DataFrame:
    """Add score, predicted (1 from 0.5 on) and, if asked, the offending spans to every document from its whole text alone.

    Null and empty texts are scored as documents without tokens and have no spans.
    """
    schema = "score double, predicted int" + ", spans array<struct<start:int,end:int,probability:double>>" * spans

    def run(texts, scorer):
        score, toxic, sizes = scorer.score(texts)
        cols = [score.tolist(), (score >= 0.5).astype(np.int32).tolist()]
        if spans:
            ends = np.cumsum(sizes)
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())]))
            found = [_spans(t, toxic[e - n:e]) if t and (toxic[e - n:e] > 0.5).any() else [] for t, e, n in zip(texts, ends, sizes)]
            cols.append(pa.array(found, kind))
        return cols

    return append_columns(docs, text_col, schema, run, keep=keep, setup=lambda: (_Scorer(tagger),))


def training_sample(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic",
                    per_label: int = DOCS_PER_LABEL) -> tuple[list[tuple[str, int]], float | None]:
    """At most about ``per_label`` documents of each label outside the held-out fold, drawn by a hash of the id; share of toxic ones.

    The picked ids are bounded by ``per_label``, so they are broadcast to fetch their texts.
    """
    doc = F.col(f"`{id_col}`")
    known = (labels.select(doc.cast("long").alias("doc"), F.col(f"`{label_col}`").cast("int").alias("y"))
             .where("doc is not null and y in (0, 1)").where(id_crc(F.col("doc")) % 5 != 0)
             .groupBy("doc").agg(F.max("y").alias("y")))
    counts = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if not counts:
        return [], None
    share = F.when(F.col("y") == 1, min(1.0, per_label / counts.get(1, 1))).otherwise(min(1.0, per_label / counts.get(0, 1)))
    draw = F.pmod(F.xxhash64("doc"), F.lit(1_000_003)) / 1_000_003.0
    picked = known.where(draw < share)
    texts = docs.select(doc.cast("long").alias("doc"), F.col(f"`{text_col}`").cast("string").alias("text")).where(
        F.length("text") > 0).withColumn("text", text_window(F.col("text"), TRAIN_CHARS))
    rows = texts.join(F.broadcast(picked), "doc").collect()
    ordered = sorted(rows, key=lambda r: (r["doc"], r["text"]))
    return [(r["text"], r["y"]) for r in ordered], counts.get(1, 0) / sum(counts.values())


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> Tagger:
    samples, prior = training_sample(docs, labels, text_col, id_col, label_col)
    return train(samples, prior=prior)


def score(docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted and the offending spans of every document; learned from labels outside the held-out fold.

    Spans are code point offsets [start, end) with their largest token probability. Null ids are scored and not held out; repeated rows are scored each; without labels of both kinds
    every score is the constant that the labels suggest.
    """
    tagger = fit(docs, labels, text_col, id_col, label_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    held = F.coalesce(id_crc(F.col("doc_id")) % 5 == 0, F.lit(False))
    return tag(rows, tagger, "text", ["doc_id"]).select("doc_id", held.alias("held_out"), "score", "predicted", "spans")

"""Language-model scores: a gated recurrent network with a class-factored softmax.

Corpus counts come first: every training document's tokens are counted (partial counts
in the tasks, then one aggregate). The most frequent words form a table of
bounded size that the tasks hold; words beyond it are resolved by a join on the word, so every
word's exact count enters the score.

P(word) = P(class | state) * P(word | class). The HEAD most frequent words fill
classes of equal size with a softmax inside each; the table's other words
form classes by count, and all words beyond the table one class, inside which a word's
share is (c + 1) over the class's sum, as in the base score. The state reads
all tokens of a document in order and is carried from window to window, so the
score is that of the whole text.

Texts are cut into words and coded as symbols once; the training rounds and the scores read the symbols.

The network is trained in numpy by backpropagation truncated to windows, with the state
carried across them, on all training documents, each read once. They are read in ROUNDS jobs; in each, every task trains a copy on its documents and the
copies are averaged by their tokens, first in as many combining tasks as the root of their number. The weights
therefore depend a little on how the rows lie in tasks. Documents lie side by side on lanes of about the same length, in training
and in scoring; a step of training takes more time steps while few lanes run, so that all steps weigh about as many tokens.
"""
from __future__ import annotations

import copy
import heapq
import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import stored
from . import gru
from .common import LOWER, id_crc, slices

# The table holds at most so many words of at most so many bytes: its size is bounded whatever the corpus.
TABLE_WORDS = 1 << 18
TABLE_BYTES = 64
HEAD = 1024
CLASS_SIZE = 32
HIDDEN = 24
# The network reads this share of the training documents (all of them), whole, in so many rounds.
TRAIN_SHARE = 1.0
ROUNDS = 8
LANES = 128
WINDOW = 32
RATE = 0.01
# A task with few tokens takes fewer lanes, so that it makes about so many steps of its first batch.
LEAST_STEPS = 12
# Longer texts are trained on in stretches side by side, each after so many tokens that only warm its state.
STRETCH, WARM = 8192, 64
# A task lays out the stretches of so many tokens at a time.
POOL = 1 << 21
# Counting tasks hand over their partial counts after so many bytes of text.
COUNT_BYTES = 16 << 20
END = b" "  # no token holds a space, so this key is the end of a document
LOG10 = math.log(10.0)
SYMBOL = np.dtype("<i2")  # there are HEAD symbols and one for each doubling of a count
DRAWS = 1_000_003


def tokens_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(LOWER).split() + [END]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts one after another, without end tokens, and the number of each text's words."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, ends = lists.flatten(), np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    real = pc.not_equal(words, "")  # white space at a text's ends leaves empty words
    before = np.concatenate([[0], np.cumsum(real.to_numpy(zero_copy_only=False))])
    return words.filter(real), np.diff(before[np.concatenate([[0], ends]).astype(np.int64)])


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, c) over all given documents, the end token included."""
    def run(batches):
        for b in slices(batches, "_text_in", COUNT_BYTES):
            words, _ = words_of(b.column("_text_in"))
            found = pc.value_counts(words)
            yield pa.RecordBatch.from_arrays([pc.cast(found.field("values"), pa.binary()), pc.cast(found.field("counts"), pa.int64())], names=["word", "c"])
            yield pa.RecordBatch.from_arrays([pa.array([END], pa.binary()), pa.array([b.num_rows], pa.int64())], names=["word", "c"])

    parts = docs.select(F.col(f"`{text_col}`").cast("string").alias("_text_in")).mapInArrow(run, "word binary, c long")
    return parts.groupBy("word").agg(F.sum("c").alias("c"))


class Vocabulary:
    """The table of frequent words with their symbols, and the sums that the shares inside classes need."""

    def __init__(self, table: list[tuple[bytes, int]], n: int, v: int):
        self.n, self.v = n, v
        ordered = sorted(table, key=lambda x: (-x[1], x[0]))
        head = ordered[:HEAD]
        self.classes = max(1, -(-len(head) // CLASS_SIZE))
        self.index = {w: i for i, (w, _) in enumerate(ordered)}
        self.counts = np.array([c for _, c in ordered], dtype=np.float64)
        # symbols: head words, then classes by count, then the class of all words beyond the table
        band = np.floor(np.log2(np.maximum(self.counts[HEAD:], 1))).astype(np.int64) if len(ordered) > HEAD else np.empty(0, np.int64)
        bands = {b: i for i, b in enumerate(sorted(set(band.tolist()), reverse=True))}
        self.base = self.classes * CLASS_SIZE
        self.symbol = np.concatenate([np.arange(len(head)), self.base + np.array([bands[b] for b in band.tolist()], dtype=np.int64)]).astype(np.int64)
        self.tail = self.base + len(bands)
        self.symbols = self.tail + 1
        sums = np.bincount(self.symbol, weights=self.counts + 1, minlength=self.symbols)
        total = n + v + 1
        sums[self.tail] = max(1.0, total - (self.counts + 1).sum())
        # natural log of the share inside the class; the tail's numerators come from the join
        self.inside = np.where(self.symbol >= self.base, np.log(self.counts + 1) - np.log(np.maximum(sums[self.symbol], 1e-300)), 0.0)
        self.tail_sum, self.total = float(sums[self.tail]), float(total)
        # what stands before a document's first token
        self.boundary = int(self.symbol[self.index[END]]) if END in self.index else self.tail
        # class of a symbol
        self.of = np.concatenate([np.arange(self.base) // CLASS_SIZE, self.classes + np.arange(self.symbols - self.base)])
        self.n_classes = self.classes + self.symbols - self.base
        self.weight = sums

    def start(self) -> dict[str, np.ndarray]:
        """Initial biases: the unigram shares of classes and of head words in their classes."""
        mass = np.zeros(self.n_classes)
        np.add.at(mass, self.of, self.weight)
        inner = np.full(self.base, -20.0)
        head = min(HEAD, len(self.counts))
        inner[:head] = np.log(self.counts[:head] + 1)
        return {"class_b": np.log(mass + 1e-3).astype(gru.DTYPE), "word_b": inner.reshape(self.classes, CLASS_SIZE).astype(gru.DTYPE)}


class WordNet:
    """GRU over symbols with softmaxes over classes and over the words of head classes."""

    def __init__(self, vocab: Vocabulary, seed: int = 1, hidden: int = HIDDEN):
        rng = np.random.default_rng(seed)
        self.hidden, self.base, self.classes, self.of, self.boundary = hidden, vocab.base, vocab.classes, vocab.of, vocab.boundary
        self.p = {"input": (rng.standard_normal((vocab.symbols, 3 * hidden)) * 0.1).astype(gru.DTYPE),
                  "u": gru.weights(rng, hidden, 3 * hidden), "c": np.zeros(3 * hidden, dtype=gru.DTYPE),
                  "class_w": (rng.standard_normal((hidden, vocab.n_classes)) * 0.05).astype(gru.DTYPE),
                  "word_w": (rng.standard_normal((vocab.classes, hidden, CLASS_SIZE)) * 0.05).astype(gru.DTYPE)} | vocab.start()

    def _gates(self, table: np.ndarray, symbols_in: np.ndarray) -> np.ndarray:
        """[time, lanes] symbols to gates [time, 3n, lanes]."""
        return np.ascontiguousarray(np.take(table, symbols_in, axis=0).transpose(0, 2, 1))

    def _by_class(self, x: np.ndarray, cls: np.ndarray):
        """Logits of classes [classes, rows] and of head words in their class [CLASS_SIZE, head rows], for rows in the order of their class.

        Also (class, first row, end) of each head class that has rows.
        """
        p = self.p
        z = p["class_w"].T @ x.T
        z += p["class_b"][:, None]
        cuts = np.searchsorted(cls, np.arange(self.classes + 1)).tolist()
        runs = [(c, a, b) for c, (a, b) in enumerate(itertools.pairwise(cuts)) if b > a]
        q = np.empty((CLASS_SIZE, cuts[-1]), gru.DTYPE)
        for c, a, b in runs:
            np.matmul(p["word_w"][c].T, x[a:b].T, out=q[:, a:b])
            q[:, a:b] += p["word_b"][c][:, None]
        return z, q, runs

    def train_window(self, inputs: np.ndarray, targets: np.ndarray, keep: np.ndarray, h: np.ndarray):
        """One step's tokens [time, lanes], truncated every WINDOW steps; targets -1 carry no loss. Gives loss, gradients and the state to carry on."""
        p, n = self.p, self.hidden
        gates = self._gates((p["input"] + p["c"]) * gru.signs(n), inputs)
        h = np.ascontiguousarray(h.T)
        states, own = gru.forward_wide(gates, h, p["u"], keep)
        before = np.concatenate([h[None], states[:-1]])
        before *= keep[:, None]
        goal = targets.reshape(-1)
        real = np.flatnonzero(goal >= 0)
        scale = gru.DTYPE(1.0 / max(1, len(real)))
        real = real[np.argsort(self.of[goal[real]].astype(np.int16), kind="stable")]  # rows in the order of their class
        x, goal = states.transpose(0, 2, 1).reshape(-1, n)[real], goal[real]
        cls = self.of[goal]
        z, q, runs = self._by_class(x, cls)
        g = {"input": np.zeros_like(p["input"]), "word_w": np.zeros_like(p["word_w"]), "word_b": np.zeros_like(p["word_b"])}
        loss = 0.0
        for prob, at in ((z, cls), (q, goal[:q.shape[1]] - cls[:q.shape[1]] * CLASS_SIZE)):
            _softmax(prob)
            places = np.arange(len(at))
            loss -= np.log(prob[at, places] + 1e-9).sum()
            prob[at, places] -= 1
            prob *= scale
        g["class_w"], g["class_b"] = (z @ x).T, z.sum(axis=1)
        dx = z.T @ p["class_w"].T
        for c, a, b in runs:
            np.matmul(x[a:b].T, q[:, a:b].T, out=g["word_w"][c])
            dx[a:b] += q[:, a:b].T @ p["word_w"][c].T
        if runs:
            g["word_b"][[c for c, _, _ in runs]] = np.add.reduceat(q, [a for _, a, _ in runs], axis=1).T
        d_states = np.zeros((targets.size, n), gru.DTYPE)
        d_states[real] = dx
        d_states = np.ascontiguousarray(d_states.reshape(*targets.shape, n).transpose(0, 2, 1))
        d_gates, g["u"] = gru.backward_wide(d_states, gates, before, own, p["u"], keep, WINDOW)
        rows = d_gates.transpose(0, 2, 1).reshape(-1, 3 * n)
        _sum_rows(rows, inputs.reshape(-1), g["input"])
        g["c"] = g["input"].sum(axis=0)
        return float(loss) / max(1, len(real)), g, states[-1].T

    def log_probs(self, docs: list[np.ndarray], width: int = 256, window: int = 32) -> np.ndarray:
        """Per document the natural log of the product of class and head-word probabilities of its symbols.

        Documents are laid on lanes; each starts with a cleared state, which is carried across windows to its end.
        """
        p = self.p
        sizes = np.array([len(d) for d in docs], dtype=np.int64)
        total = np.zeros(len(docs))
        if not sizes.sum():
            return total
        order, starts, ends = lay(sizes, min(width, len(docs)))
        goal = np.concatenate([docs[d] for d in order]).astype(np.int16)
        first = np.cumsum(sizes[order]) - sizes[order]
        some = sizes[order] > 0
        opens = np.zeros(len(goal), dtype=bool)
        opens[first[some]] = True
        prev = np.roll(goal, 1)
        prev[opens] = self.boundary
        logs = np.empty(len(goal), dtype=gru.DTYPE)
        table = (p["input"] + p["c"]) * gru.signs(self.hidden)
        h = np.zeros((self.hidden, len(ends)), dtype=gru.DTYPE)
        for at in range(0, int(ends[0]), window):
            live, place, here = in_window(starts, ends, at, window)
            keep = ~(opens[place] & here)
            states, _ = gru.forward_wide(self._gates(table, prev[place]), np.ascontiguousarray(h[:, :live]), p["u"], keep)
            h = states[-1]
            place = place[here]
            logs[place] = self._window_logs(states.transpose(0, 2, 1)[here], goal[place])
        total[order[some]] = np.add.reduceat(logs, first[some], dtype=np.float64)
        return total

    def _window_logs(self, x: np.ndarray, goal: np.ndarray) -> np.ndarray:
        order = np.argsort(self.of[goal].astype(np.int16), kind="stable")
        x, goal = x[order], goal[order].astype(np.int64)
        cls = self.of[goal]
        z, q, _ = self._by_class(x, cls)
        head = q.shape[1]
        places = np.arange(len(goal))
        logs = z[cls, places] - _log_sum(z)
        logs[:head] += q[goal[:head] - cls[:head] * CLASS_SIZE, places[:head]] - _log_sum(q)
        out = np.empty_like(logs)
        out[order] = logs
        return out


def lay(sizes: np.ndarray, lanes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Items laid on lanes one after another, longest first onto the shortest lane.

    Gives the items in the order of lanes, longest lane first, each lane's in the order given, and where each lane starts and how long it is.
    """
    heap = [(0, i) for i in range(lanes)]
    on = np.empty(len(sizes), dtype=np.int64)
    for i in np.argsort(-sizes, kind="stable").tolist():
        load, lane = heap[0]
        on[i] = lane
        heapq.heapreplace(heap, (load + int(sizes[i]), lane))
    loads = np.zeros(lanes, dtype=np.int64)
    for load, lane in heap:
        loads[lane] = load
    by_length = np.argsort(-loads, kind="stable")
    rank = np.empty(lanes, dtype=np.int64)
    rank[by_length] = np.arange(lanes)
    ends = loads[by_length]
    return np.argsort(rank[on], kind="stable"), np.cumsum(ends) - ends, ends


def in_window(starts: np.ndarray, ends: np.ndarray, at: int, window: int) -> tuple[int, np.ndarray, np.ndarray]:
    """Lanes still running at step ``at`` (a prefix), and [time, lane] places of the window's items and whether there is one."""
    live = int(np.searchsorted(-ends, -at, side="left"))
    steps = at + np.arange(min(window, int(ends[0]) - at))[:, None]
    here = steps < ends[:live]
    return live, np.where(here, steps + starts[:live], 0), here


def _sum_rows(rows: np.ndarray, keys: np.ndarray, out: np.ndarray, many: int = 24) -> None:
    """out[key] becomes the sum of its rows; keys of many rows take a product with ones, which is faster than a reduction of short rows."""
    order = np.argsort(keys.astype(SYMBOL), kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    counts = np.diff(np.append(first, len(keys)))
    often = counts >= many
    ones = np.ones(len(keys), gru.DTYPE)
    for key, a, n in zip(keys[first[often]].tolist(), first[often].tolist(), counts[often].tolist()):
        np.matmul(ones[:n], np.take(rows, order[a:a + n], axis=0), out=out[key])
    if not often.all():
        rest = np.take(rows, order[np.repeat(~often, counts)], axis=0)
        out[keys[first[~often]]] = np.add.reduceat(rest, np.cumsum(counts[~often]) - counts[~often], axis=0)


def _softmax(z: np.ndarray) -> None:
    """In place, down the columns."""
    z -= z.max(axis=0)
    np.exp(z, out=z)
    z /= z.sum(axis=0)


def _log_sum(z: np.ndarray) -> np.ndarray:
    """Logs of the columns' summed exponentials."""
    top = z.max(axis=0)
    e = z - top
    return np.log(np.exp(e, out=e).sum(axis=0)) + top


def stretches(doc: np.ndarray, boundary: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(inputs, targets) of a document's stretches; every token is a target once, warming tokens have target -1."""
    inputs = np.concatenate([[boundary], doc[:-1]]).astype(np.int64)
    for at in range(0, len(doc), STRETCH):
        warm = min(WARM, at)
        goal = doc[at - warm:at + STRETCH].astype(np.int64)
        goal[:warm] = -1
        yield inputs[at - warm:at + STRETCH], goal


def learn(net: WordNet, docs: Iterable[np.ndarray], rate: float = RATE, lanes: int = LANES) -> tuple[int, float]:
    """Train on documents of symbols in windows of WINDOW steps; gives the tokens read and their summed loss.

    Stretches are gathered up to POOL tokens and laid on lanes of about the same length, which end together; a long one that
    no lane matches begins alone. The state is cleared at the start of a stretch and carried otherwise.
    """
    opt, read, total = gru.Adam(net.p, rate), 0, 0.0
    for pool in _pools(s for d in docs for s in stretches(d, net.boundary)):
        sizes = np.array([len(x) for x, _ in pool], dtype=np.int64)
        order, starts, ends = lay(sizes, lanes)
        prev, goal = (np.concatenate([pool[i][k] for i in order]) for k in (0, 1))
        opens = np.zeros(len(prev), dtype=bool)
        opens[np.cumsum(sizes[order]) - sizes[order]] = True
        lead = ends[0] - ends
        h, at = np.zeros((0, net.hidden), dtype=gru.DTYPE), 0
        while at < ends[0]:
            steps = WINDOW  # more of them while few lanes run, for steps of about the same size
            while at + steps < ends[0] and (steps + WINDOW) * np.count_nonzero(lead < at + steps + WINDOW) <= lanes * WINDOW:
                steps += WINDOW
            steps = min(steps, int(ends[0]) - at)
            live = int(np.count_nonzero(lead < at + steps))
            place = at + np.arange(steps)[:, None] - lead[:live]
            here = place >= 0
            place = np.where(here, place + starts[:live], 0)
            targets = np.where(here, goal[place], -1)
            h = np.concatenate([h, np.zeros((live - len(h), net.hidden), dtype=gru.DTYPE)])
            loss, g, h = net.train_window(np.where(here, prev[place], net.boundary), targets, ~(opens[place] & here), h)
            at, real = at + steps, int((targets >= 0).sum())
            if real:
                opt.update(g, rate)
                read, total = read + real, total + loss * real
    return read, total


def _pools(found: Iterable[tuple[np.ndarray, np.ndarray]]) -> Iterator[list[tuple[np.ndarray, np.ndarray]]]:
    held, tokens = [], 0
    for s in found:
        if len(s[0]):
            held.append(s)
            tokens += len(s[0])
        if tokens >= POOL:
            yield held
            held, tokens = [], 0
    if held:
        yield held


def _pack(p: dict[str, np.ndarray]) -> bytes:
    return np.concatenate([p[k].ravel() for k in sorted(p)]).tobytes()


def _unpack(blob: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = blob[at:at + like[k].size].reshape(like[k].shape).astype(gru.DTYPE)
        at += like[k].size
    return out


def _train_rows(batches, net: WordNet, rate: float):
    """One row: tokens read, their summed loss, and the weights after the task's documents."""
    net.p = {k: v.copy() for k, v in net.p.items()}

    def docs():
        for b in batches:
            yield from documents(b.column("syms"))

    found = docs()
    first, tokens = [], 0
    for d in found:  # enough documents to see whether the lanes can be filled
        first.append(d)
        tokens += len(d)
        if tokens >= LANES * WINDOW * LEAST_STEPS:
            break
    lanes = max(1, min(LANES, tokens // (WINDOW * LEAST_STEPS)))
    read, loss = learn(net, itertools.chain(first, found), rate, lanes)
    if read:
        yield pa.RecordBatch.from_arrays([pa.array([read], pa.int64()), pa.array([loss], pa.float64()), pa.array([_pack(net.p)], pa.binary())],
                                         names=["tokens", "loss", "weights"])


def _combine(batches):
    """One row: the average of the weights that a combining task gets, weighed by tokens."""
    tokens, loss, total = 0, 0.0, None
    for b in batches:
        for n, one, w in zip(*(b.column(c).to_pylist() for c in ("tokens", "loss", "weights"))):
            w = np.frombuffer(w, dtype=np.float32).astype(np.float64) * n
            tokens, loss, total = tokens + n, loss + one, w if total is None else total + w
    if tokens:
        blob = (total / tokens).astype(np.float32).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([tokens], pa.int64()), pa.array([loss], pa.float64()), pa.array([blob], pa.binary())],
                                         names=["tokens", "loss", "weights"])


def fit(learn_docs: DataFrame, vocab: Vocabulary, share: float = TRAIN_SHARE, rounds: int = ROUNDS) -> tuple[WordNet, list[tuple[int, float]]]:
    """The network after ``rounds`` rounds over the documents (doc_id, text), and tokens and mean loss of each round.

    Documents are dealt to the rounds by a hash of id and text; ``share`` below 1 leaves some out. Null texts are empty. Without documents the start is kept, whose
    shares are those of the counts.
    """
    return train(coded(learn_docs.select("doc_id", "text", F.lit(False).alias("held_out")), vocab), vocab, share, rounds)


def train(rows: DataFrame, vocab: Vocabulary, share: float = TRAIN_SHARE, rounds: int = ROUNDS) -> tuple[WordNet, list[tuple[int, float]]]:
    """The same from rows of ``coded``, those of held-out documents aside."""
    spark = rows.sparkSession
    net, log = WordNet(vocab), []
    sample = rows.where(~F.col("held_out") & (F.col("draw") < math.ceil(share * DRAWS)))
    combiners = max(1, math.isqrt(sample.rdd.getNumPartitions()))
    for r in range(rounds):
        start, rate = spark.sparkContext.broadcast(net), RATE * (1 - 0.9 * r / rounds)
        part = sample.where(F.col("draw") % rounds == r).select("syms")
        each = part.mapInArrow(lambda b, start=start, rate=rate: _train_rows(b, copy.copy(start.value), rate), "tokens long, loss double, weights binary")
        found = each.repartition(combiners).mapInArrow(_combine, "tokens long, loss double, weights binary").collect()  # a row a combiner
        tokens = sum(f["tokens"] for f in found)
        if tokens:
            mean = sum(np.frombuffer(f["weights"], dtype=np.float32).astype(np.float64) * (f["tokens"] / tokens) for f in found)
            net.p = _unpack(mean, net.p)
        log.append((tokens, sum(f["loss"] for f in found) / max(1, tokens)))
        start.unpersist()
    return net, log


def documents(syms: pa.Array) -> list[np.ndarray]:
    """The documents of a column of symbols, each 16 bits."""
    return [np.frombuffer(s.as_buffer(), dtype=SYMBOL) for s in syms]


def symbols(tokens: list[bytes], vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Symbols of the tokens, table positions (-1 beyond the table), and the words beyond the table."""
    get = vocab.index.get
    at = np.array([get(t, -1) for t in tokens], dtype=np.int64)
    if not len(vocab.symbol):
        return np.full(len(at), vocab.tail), at, tokens
    out = np.where(at >= 0, vocab.symbol[at], vocab.tail)
    return out, at, [tokens[i] for i in np.flatnonzero(at < 0)]


def _vocabulary(counts: DataFrame) -> Vocabulary:
    """The words of at least such a count that no more than TABLE_WORDS reach it; counts are grouped finely by size first."""
    grade = F.floor(F.log2(F.col("c")) * 16)
    short = F.length("word") <= TABLE_BYTES
    # one row per sixteenth of a doubling of the count
    rows = counts.groupBy(grade.alias("grade")).agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v"),
                                                    F.sum(short.cast("long")).alias("short")).collect()
    n, v, room, floor_grade = sum(r["n"] for r in rows), sum(r["v"] for r in rows), TABLE_WORDS, None
    for r in sorted(rows, key=lambda r: -r["grade"]):
        if r["short"] > room:
            break
        room, floor_grade = room - r["short"], r["grade"]
    if floor_grade is None:
        return Vocabulary([], n, v)
    table = counts.where(short & (grade >= floor_grade)).collect()
    return Vocabulary([(bytes(r["word"]), r["c"]) for r in table], n, v)


_ROWS = "row long, doc_id long, held_out boolean, draw long, n_tokens long, table_known long, table_log double, inside double, n_tail long, " \
        "tail array<struct<word:binary,n:long>>, syms binary"
_SCORED = "row long, doc_id long, held_out boolean, n_tokens long, table_known long, table_log double, net_log double, n_tail long"


def coded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """Documents (doc_id, text, held_out) as symbols, with the sums that their words in the table give and the words beyond it."""
    known = docs.sparkSession.sparkContext.broadcast(vocab)  # at most TABLE_WORDS words of TABLE_BYTES bytes
    draw = F.pmod(F.xxhash64("doc_id", "text"), F.lit(DRAWS)).alias("draw")
    return stored(docs.select("doc_id", "text", "held_out", draw).mapInArrow(lambda b: _code_rows(b, known.value), _ROWS), "lm-coded")


def score(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every whole document.

    Training documents are those whose crc32(id as text) mod 7 is not 2; null ids take part in training
    as well. A null text is empty: its only token is the end. Repeated rows count and score each;
    without training documents all counts are 0 and base and model agree on a uniform share; other
    columns are ignored.
    """
    spark = docs.sparkSession
    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"),
                        F.coalesce(id_crc(F.col(f"`{id_col}`")) % 7 == 2, F.lit(False)).alias("held_out"))
    counts = stored(count_words(named.where("not held_out")), "lm-counts")
    vocab = _vocabulary(counts)
    rows = coded(named, vocab)  # texts are cut into words once for training and scoring
    model = spark.sparkContext.broadcast(train(rows, vocab)[0])
    # words beyond the table get their counts by a join
    tail = rows.select("row", F.explode("tail").alias("t")).select("row", "t.word", "t.n")
    found = tail.join(counts, "word", "left").select("row", "n", F.coalesce("c", F.lit(0)).alias("c"))
    logs = found.groupBy("row").agg(F.sum(F.col("n") * F.log10(F.col("c") + 1)).alias("tail_log"),
                                    F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("tail_known"))
    scored = stored(rows.drop("tail", "draw").mapInArrow(lambda b: _score_rows(b, model.value), _SCORED), "lm-rows")
    whole = scored.join(logs, "row", "left").withColumn("tail_log", F.coalesce("tail_log", F.lit(0.0)))
    return whole.select(
        "doc_id", "held_out", "n_tokens", (F.col("table_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("table_log") + F.col("tail_log") - F.col("n_tokens") * math.log10(vocab.total)).alias("base_score"),
        (F.col("net_log") + F.col("tail_log") - F.col("n_tail") * math.log10(vocab.tail_sum)).alias("score"))


def _code_rows(batches, vocab: Vocabulary):
    from pyspark import TaskContext
    row = TaskContext.get().partitionId() << 33
    table, beyond = pa.array(list(vocab.index), pa.binary()), len(vocab.index)
    # one more place, for words beyond the table
    symbol, log_c, inside = np.append(vocab.symbol, vocab.tail).astype(SYMBOL), np.append(np.log10(vocab.counts + 1), 0.0), np.append(vocab.inside, 0.0)
    for b in slices(batches, "text"):
        words, n = words_of(b.column("text"))
        words, docs = pc.cast(words, pa.binary()).dictionary_encode(), len(n)
        known = pa.concat_arrays([words.dictionary, pa.array([END], pa.binary())])  # distinct words, the end last
        ends, owner = np.cumsum(n + 1), np.repeat(np.arange(docs), n + 1)
        word = np.full(len(owner), len(known) - 1)
        word[np.arange(len(words)) + np.repeat(np.arange(docs), n)] = words.indices.to_numpy()
        at = pc.fill_null(pc.index_in(known, value_set=table), beyond).to_numpy()[word]
        outside = np.flatnonzero(at == beyond)
        n_tail = np.bincount(owner[outside], minlength=docs)
        pairs, times = np.unique(owner[outside] * len(known) + word[outside], return_counts=True)
        of, which = np.divmod(pairs, len(known))
        tail = pa.StructArray.from_arrays([known.take(pa.array(which)), pa.array(times, pa.int64())], names=["word", "n"])
        tail = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(docs + 1)), pa.int32()), tail)
        cuts = np.concatenate([[0], ends * SYMBOL.itemsize]).astype(np.int32)
        syms = pa.Array.from_buffers(pa.binary(), docs, [None, pa.py_buffer(cuts), pa.py_buffer(symbol[at])])
        ids = np.arange(row, row + docs)
        row += docs
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), b.column("doc_id"), b.column("held_out"), b.column("draw"), pa.array(n + 1, pa.int64()), pa.array(n + 1 - n_tail, pa.int64()),
             *(pa.array(np.bincount(owner, weights=v[at], minlength=docs)) for v in (log_c, inside)), pa.array(n_tail, pa.int64()), tail, syms],
            names=["row", "doc_id", "held_out", "draw", "n_tokens", "table_known", "table_log", "inside", "n_tail", "tail", "syms"])


def _score_rows(batches, net: WordNet):
    for b in slices(batches, "syms"):
        logs = (net.log_probs(documents(b.column("syms"))) + b.column("inside").to_numpy()) / LOG10
        kept = ["row", "doc_id", "held_out", "n_tokens", "table_known", "table_log", "net_log", "n_tail"]
        yield pa.RecordBatch.from_arrays([pa.array(logs) if c == "net_log" else b.column(c) for c in kept], names=kept)

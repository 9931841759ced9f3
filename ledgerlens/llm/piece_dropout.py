"""SentencePiece BPE encoding with seeded merge-dropout, and decoding.

The agenda of BPE takes the candidate merge of best rank first, leftmost on a tie.
Every candidate that comes up is skipped when a keyed hash of (seed, document,
occurrence of the chunk in the document, position, merged piece) falls below the dropout
rate, so one seed always gives one segmentation, and each occurrence has its own. Every
segmentation spells the text, so decoding is lossless. Without dropout the ids are
those of the sentencepiece library.

No piece of the model holds a space mark after another character or a line
break, so no merge crosses such a boundary: the text is cut into chunks there.
Occurrences share the steps of an agenda as long as their draws agree: each distinct
chunk of a slice is run once without a skip and its candidates are recorded;
occurrences whose draws skip none of them have that result, the others meet again by
(chunk, steps skipped so far). When few are left to share, each runs its own agenda. These
agendas go side by side in numpy; a chunk of more than LONG characters takes a
heap over a linked list, so a run without spaces costs n log n.
"""
from __future__ import annotations

import heapq
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ragged, slices, utf8

RATE = 0.1
SEED = 17
MARK = "▁"
CHUNKS = re.compile(r" *[^ \n]+| +|\n")
# Chunks of up to so many characters share an array of that width; beyond the last each takes a heap of its own.
WIDTHS = (4, 8, 12, 16, 24, 32, 64, 128)
LONG = WIDTHS[-1]
CELLS = 1 << 17
NONE = np.int32(2**31 - 1)
MIX = np.uint64(0x9E3779B97F4A7C15)
ALL_BITS = 2**64 - 1
# Encoding takes so many bytes of text at once, decoding so many ids.
ENCODE_BYTES, DECODE_IDS = 1 << 20, 1 << 19


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def mix_one(x: int) -> int:
    """``mix`` of one Python number."""
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & ALL_BITS
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB & ALL_BITS
    return x ^ (x >> 31)


def codes_of(pos: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The share of (position, merged piece) in a draw; a draw is mix(key of the occurrence ^ code)."""
    return mix((pos.astype(np.int64) * 65536 + rank).astype(np.uint64) * MIX)


def limit_of(rate: float) -> int:
    """Draws below this number skip their candidate."""
    return min(int(rate * 2.0**64), ALL_BITS)


SLOT_BITS = 19


def _slot(key: np.ndarray, mult: int) -> np.ndarray:
    return (key.view(np.uint64) * np.uint64(mult)) >> np.uint64(64 - SLOT_BITS)


def _pair_tables(keys: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """Hash tables over distinct keys: each slot holds the place of one key; keys whose slot is taken go to the next table."""
    tables, left = [], np.arange(len(keys), dtype=np.int32)
    while len(left):
        mult = mix_one(len(tables) + 1) | 1
        table = np.full(1 << SLOT_BITS, len(keys), dtype=np.int32)
        table[_slot(keys[left], mult)] = left
        left = left[table[_slot(keys[left], mult)] != left]
        tables.append((mult, table))
    return tables


class PieceModel:
    """Pieces and merges of a BPE model with byte fallback."""

    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.byte_ids = np.zeros(256, dtype=np.int32)
        normal: dict[str, int] = {}
        raw = []
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                raw.append(bytes([int(piece[3:5], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                raw.append(b"")
            else:
                normal[piece] = i
                raw.append(piece.replace(MARK, " ").encode())
        self.raw = np.frombuffer(b"".join(raw), dtype=np.uint8)
        self.raw_sizes = np.array([len(r) for r in raw], dtype=np.int64)
        self.raw_starts = np.cumsum(self.raw_sizes) - self.raw_sizes
        # merge rank: position in the order of the scores, best first
        by_score = sorted(normal.items(), key=lambda x: (-sp.get_score(x[1]), x[1]))
        rank_of = {i: r for r, (_, i) in enumerate(by_score)}
        merges: dict[int, int] = {}
        for piece, i in normal.items():
            for cut in range(1, len(piece)):
                left, right = normal.get(piece[:cut]), normal.get(piece[cut:])
                if left is not None and right is not None:
                    merges[left * n + right] = i
        self.n = n
        keys = np.array(sorted(merges), dtype=np.int64)
        self.keys = np.append(keys, np.int64(2**62))
        self.merged = np.array([merges[int(k)] for k in keys] + [0], dtype=np.int32)
        self.ranks = np.array([rank_of[int(i)] for i in self.merged[:-1]] + [NONE], dtype=np.int32)
        self.by_rank = np.array([i for _, i in by_score], dtype=np.int32)
        self.tables = _pair_tables(self.keys[:-1])
        self.rank_of_pair = dict(zip(self.keys[:-1].tolist(), self.ranks[:-1].tolist()))
        # characters that are pieces; the space is the mark, and the mark itself is spelled in bytes to stay distinct
        self.char_ids = np.full(0x110000, -1, dtype=np.int32)
        for piece, i in normal.items():
            if len(piece) == 1:
                self.char_ids[ord(" " if piece == MARK else piece)] = i

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of two pieces, NONE if there is none."""
        key = left.astype(np.int64) * self.n + right
        key[(left < 0) | (right < 0)] = -1
        at = np.full(key.shape, len(self.keys) - 1, dtype=np.int32)
        for mult, table in self.tables:
            entry = table[_slot(key, mult)]
            at = np.where(self.keys[entry] == key, entry, at)
        return self.ranks[at]

    def segment(self, points: np.ndarray, keys: np.ndarray | None = None, rate: float = 0.0, skips: np.ndarray | None = None):
        """Agendas of many chunks at once. points: code points, -1 beyond the end. Gives symbols and their number.

        A symbol is a piece id, or -2 - code point for a character without a piece. Candidates are skipped by the
        draws of ``keys``, or at the step numbers ``skips`` [rows, any] in ascending order. In the latter case two more arrays
        give the codes of the candidates after a row's last skip, row by row, and their numbers.
        """
        rows, width = points.shape
        tok = np.where(points < 0, np.int32(-1), self.char_ids[np.maximum(points, 0)])
        tok = np.where((points >= 0) & (tok < 0), -2 - points, tok).astype(np.int32)
        size = (points >= 0).sum(axis=1)
        out = tok.copy()
        pos = np.broadcast_to(np.arange(width, dtype=np.int64), tok.shape).copy()
        rank = np.full((rows, width), NONE, dtype=np.int32)
        if width > 1:
            rank[:, :-1] = self.rank(tok[:, :-1], tok[:, 1:])
        limit = np.uint64(limit_of(rate))
        active, columns = np.arange(rows), np.arange(width)
        last = skips[:, -1] if skips is not None and skips.shape[1] else np.full(rows, -1)
        met, met_codes, step = [np.empty(0, np.int64)], [np.empty(0, np.int64)], -1
        while len(active):
            step += 1
            j = rank.argmin(axis=1)
            line = np.arange(len(active))
            best = rank[line, j]
            going = best < NONE
            if not going.all():
                out[active[~going]] = tok[~going]
                active, tok, pos, rank, j, best = active[going], tok[going], pos[going], rank[going], j[going], best[going]
                if not len(active):
                    break
                line = np.arange(len(active))
            if skips is not None:
                skipped = (skips[active] == step).any(axis=1)
                new = step > last[active]
                met.append(active[new])
                met_codes.append(pos[line[new], j[new]] * 65536 + best[new])
            else:
                skipped = mix(keys[active] ^ codes_of(pos[line, j], best)) < limit if rate > 0 else np.zeros(len(active), dtype=bool)
            rank[line[skipped], j[skipped]] = NONE
            on = line[~skipped]
            if not len(on):
                continue
            at = j[on]
            shift = np.minimum(columns + (columns[None, :] > at[:, None]), width - 1) + (on * width)[:, None]
            t = tok.ravel().take(shift)
            t[:, -1] = -1
            here = np.arange(len(on))
            t[here, at] = self.by_rank[best[on]]
            p = pos.ravel().take(shift)
            r = rank.ravel().take(shift)
            r[:, -1] = NONE
            r[here, at] = np.where(at + 1 < width, self.rank(t[here, at], t[here, np.minimum(at + 1, width - 1)]), NONE)
            back = at > 0
            r[here[back], at[back] - 1] = self.rank(t[here[back], at[back] - 1], t[here[back], at[back]])
            if len(on) == len(active):
                tok, pos, rank = t, p, r
            else:
                tok[on], pos[on], rank[on] = t, p, r
            size[active[on]] -= 1
        if skips is None:
            return out, size
        owner = np.concatenate(met)
        found = np.concatenate(met_codes)[np.argsort(owner, kind="stable")]
        return out, size, mix(found.astype(np.uint64) * MIX), np.bincount(owner, minlength=rows)

    def segment_long(self, points: np.ndarray, key: int, rate: float) -> np.ndarray:
        """The agenda of one chunk of any length: a heap of candidates over a linked list. Gives symbols."""
        n, limit, mult = len(points), limit_of(rate), int(MIX)
        toks = self.char_ids[points]
        toks = np.where(toks < 0, -2 - points, toks).astype(np.int64)
        ranks = self.rank(toks[:-1], toks[1:])
        tok: list[int | None] = toks.tolist()
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(int(ranks[i]), i, tok[i], tok[i + 1]) for i in np.flatnonzero(ranks < NONE).tolist()]
        heapq.heapify(heap)

        def offer(i: int, j: int) -> None:
            a, b = tok[i], tok[j]
            if a >= 0 and b >= 0 and (r := self.rank_of_pair.get(a * self.n + b)) is not None:
                heapq.heappush(heap, (r, i, a, b))

        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = right[i]
            if tok[i] != a or j == n or tok[j] != b:
                continue  # one of its symbols has been merged since
            if limit and mix_one(key ^ mix_one((i * 65536 + r) * mult & ALL_BITS)) < limit:
                continue
            tok[i], tok[j] = int(self.by_rank[r]), None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                offer(i, k)
            if left[i] >= 0:
                offer(left[i], i)
        return np.array([t for t in tok if t is not None], dtype=np.int32)

    def spell(self, symbols: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat piece ids, characters without a piece as their UTF-8 bytes, and the number of ids of each chunk."""
        odd = symbols < 0
        if not odd.any():
            return symbols, sizes
        count = np.ones(len(symbols), dtype=np.int64)
        spelled = {int(s): self.byte_ids[np.frombuffer(chr(-2 - int(s)).encode("utf-8", "surrogatepass"), np.uint8)]
                   for s in np.unique(symbols[odd])}
        count[odd] = [len(spelled[int(s)]) for s in symbols[odd]]
        flat = np.repeat(symbols, count)
        flat[np.repeat(odd, count)] = np.concatenate([spelled[int(s)] for s in symbols[odd]])
        ends = np.cumsum(sizes)
        total = np.concatenate([[0], np.cumsum(count)])
        return flat, total[ends] - total[ends - sizes]

    def encode(self, texts: list[str], doc_keys: np.ndarray, rate: float, seed: int) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, one after another, and how many each has."""
        index: defaultdict[str, int] = defaultdict()
        index.default_factory = index.__len__  # a new chunk takes the next number
        occurrences, per_doc = [], np.zeros(len(texts), dtype=np.int64)
        for d, text in enumerate(texts):
            if text:
                found = CHUNKS.findall(" " + text)
                occurrences += map(index.__getitem__, found)
                per_doc[d] = len(found)
        if not occurrences:
            return np.empty(0, np.int32), per_doc
        nth = ragged(np.zeros(len(texts), dtype=np.int64), per_doc).astype(np.uint64)
        keys = mix(np.repeat(doc_keys, per_doc) ^ mix((nth + np.uint64(1)) * MIX ^ np.uint64(seed & ALL_BITS)))
        flat, sizes, result = self._occurrences(list(index), np.array(occurrences, dtype=np.int64), keys, rate)
        starts = np.cumsum(sizes) - sizes
        ids = flat[ragged(starts[result], sizes[result])]
        ends = np.concatenate([[0], np.cumsum(sizes[result])])
        last = np.cumsum(per_doc)
        return ids, ends[last] - ends[last - per_doc]

    def _occurrences(self, chunks: list[str], chunk: np.ndarray, keys: np.ndarray, rate: float):
        """Flat ids of distinct results, their sizes, and each occurrence's result."""
        lengths = np.array([len(c) for c in chunks], dtype=np.int64)
        points = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), dtype=np.int32)
        starts = np.cumsum(lengths) - lengths
        result, flats, sizes, made = np.empty(len(chunk), dtype=np.int64), [], [], 0
        long = np.flatnonzero(lengths[chunk] > LONG)
        if len(long):
            own = long if rate > 0 else long[np.unique(chunk[long], return_index=True)[1]]
            symbols = [self.segment_long(points[starts[c]:starts[c] + lengths[c]], int(keys[o]), rate) for o, c in zip(own, chunk[own])]
            flat, n = self.spell(np.concatenate(symbols), np.array([len(x) for x in symbols], dtype=np.int64))
            flats.append(flat)
            sizes.append(n)
            result[long] = np.arange(len(own)) if rate > 0 else np.searchsorted(chunk[own], chunk[long])
            made = len(own)
        live = np.flatnonzero(lengths[chunk] <= LONG)
        which, at = np.unique(chunk[live], return_inverse=True)
        skips = np.empty((len(which), 0), dtype=np.int64)
        while len(live):
            flat, n, codes, met = self._agendas(points, starts[which], lengths[which], skips=skips)
            flats.append(flat)
            sizes.append(n)
            result[live] = made + at
            made += len(which)
            if rate <= 0:
                break
            hit = first_below(keys[live], codes, (np.cumsum(met) - met)[at], met[at], limit_of(rate))
            more = hit >= 0
            live, at = live[more], at[more]
            # numbers of steps count from the last skip
            step = hit[more] + (skips[at, -1] + 1 if skips.shape[1] else 0)
            steps = int(step.max(initial=0)) + 1
            pairs, joint = np.unique(at * steps + step, return_inverse=True)
            if 2 * len(pairs) > len(live):  # little to share: each occurrence draws for itself
                if len(live):
                    flat, n = self._agendas(points, starts[which[at]], lengths[which[at]], keys=keys[live], rate=rate)
                    flats.append(flat)
                    sizes.append(n)
                    result[live] = made + np.arange(len(live))
                break
            parent, at = pairs // steps, joint
            which, skips = which[parent], np.concatenate([skips[parent], (pairs % steps)[:, None]], axis=1)
        return np.concatenate(flats), np.concatenate(sizes), result

    def _agendas(self, points: np.ndarray, starts: np.ndarray, lengths: np.ndarray, keys: np.ndarray | None = None, rate: float = 0.0,
                 skips: np.ndarray | None = None):
        """``segment`` of chunks of many lengths, in the order given; symbols are spelled as ids."""
        symbols, codes, order = [], [np.empty(0, np.uint64)], []
        found, met = np.zeros(len(lengths), dtype=np.int64), np.zeros(len(lengths), dtype=np.int64)
        done = 0
        for width in WIDTHS:
            rows = np.flatnonzero((lengths > done) & (lengths <= width))
            done = width
            for i in range(0, len(rows), CELLS // width):
                part = rows[i:i + CELLS // width]
                grid = np.full((len(part), width), -1, dtype=np.int32)
                inside = np.arange(width)[None, :] < lengths[part][:, None]
                grid[inside] = points[ragged(starts[part], lengths[part])]
                if skips is None:
                    out, n = self.segment(grid, keys[part], rate)
                else:
                    out, n, code, met[part] = self.segment(grid, skips=skips[part])
                    codes.append(code)
                symbols.append(out[np.arange(width)[None, :] < n[:, None]])
                found[part] = n
                order.append(part)
        order = np.concatenate(order)
        flat, spelled = self.spell(np.concatenate(symbols), found[order])
        flat, sizes = _put_back(flat, spelled, order)
        return (flat, sizes) if skips is None else (flat, sizes, *_put_back(np.concatenate(codes), met[order], order))

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 bytes of the text; the space that encoding puts in front is removed."""
        data = self.raw[ragged(self.raw_starts[ids], self.raw_sizes[ids])].tobytes()
        return data[1:] if data[:1] == b" " else data


def _put_back(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ragged rows that lie in the order given, in the order of their numbers."""
    whole, at = np.zeros(len(order), dtype=np.int64), np.zeros(len(order), dtype=np.int64)
    whole[order] = sizes
    at[order] = np.cumsum(sizes) - sizes
    return flat[ragged(at, whole)], whole


def first_below(keys: np.ndarray, codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray, limit: int) -> np.ndarray:
    """Per key the place of the first of its codes (from its start on) whose draw is below the limit; -1 if there is none."""
    out = np.full(len(keys), -1, dtype=np.int64)
    ends = np.cumsum(sizes)
    lo = 0
    while lo < len(keys):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + CELLS, side="right")))
        n = sizes[lo:hi]
        below = np.flatnonzero(mix(np.repeat(keys[lo:hi], n) ^ codes[ragged(starts[lo:hi], n)]) < np.uint64(limit))
        before = np.cumsum(n) - n
        owner, first = np.unique(np.searchsorted(np.cumsum(n), below, side="right"), return_index=True)
        out[lo + owner] = below[first] - before[owner]
        lo = hi
    return out


_MODELS: dict[str, PieceModel] = {}


def model(path: str | None = None) -> PieceModel:
    path = path or public_tokenizers.path("piece_bpe_32k.model")
    if path not in _MODELS:
        _MODELS[path] = PieceModel(path)
    return _MODELS[path]


def encode(docs: DataFrame, key: Column | None = None, text_col: str = "text", rate: float = RATE, seed: int = SEED,
           keep: list[str] | None = None, path: str | None = None) -> DataFrame:
    """Add ``ids`` (array of piece ids) to every whole text.

    ``key`` (a bigint column, a hash of the text by default) keys a document's draws; rows with
    equal key and text get equal ids. Null and empty texts give no ids.
    """
    key = F.xxhash64(F.col(f"`{text_col}`")) if key is None else key.cast("long")
    kept = [c for c in (docs.columns if keep is None else keep) if c.lower() != "ids"]
    # by position, so that no name of the input can clash
    places = [f"k{i}" for i in range(len(kept))]
    source = docs.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(kept, places)], F.coalesce(key, F.lit(0)).cast("long").alias("key_in"),
                         F.col(f"`{text_col}`").cast("string").alias("text_in"))
    schema = T.StructType([*source.schema.fields[:len(kept)], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    # a kept text is sent to the tasks once
    text = "text_in"
    if text_col in kept and isinstance(docs.schema[text_col].dataType, T.StringType):
        source, text = source.drop("text_in"), places[kept.index(text_col)]

    def run(batches):
        pieces = model(path)
        for b in slices(batches, text, ENCODE_BYTES):
            keys = mix(b.column("key_in").to_numpy(zero_copy_only=False).view(np.uint64) ^ np.uint64(seed & ALL_BITS))
            ids, sizes = pieces.encode([t.decode() if t else "" for t in utf8(b.column(text))], keys, rate, seed)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            found = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + [found], names=[*places, "ids"])

    return source.mapInArrow(run, schema).toDF(*kept, "ids")


def decode(df: DataFrame, ids_col: str = "ids", path: str | None = None) -> DataFrame:
    """Add ``decoded`` (text) to rows of piece ids; null ids give null."""
    kept = [c for c in df.columns if c.lower() != "decoded"]
    places = [f"k{i}" for i in range(len(kept))]
    source = df.select(*[F.col(f"`{c}`").alias(k) for c, k in zip(kept, places)], F.col(f"`{ids_col}`").cast("array<int>").alias("ids_in"))

    def run(batches):
        pieces = model(path)
        for b in slices(batches, "ids_in", DECODE_IDS):
            col = b.column("ids_in")
            out = [None if not col[i].is_valid else pieces.decode(np.asarray(col[i].values)).decode() for i in range(len(col))]
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(len(kept))] + [pa.array(out, pa.string())], names=[*places, "decoded"])

    schema = source.drop("ids_in").schema.add("decoded", "string")
    return source.mapInArrow(run, schema).toDF(*kept, "decoded")

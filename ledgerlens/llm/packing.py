"""Packing by power-of-two decomposition.

Every document is tokenized whole, closed with an end id and cut into pieces
whose lengths are powers of two, longest first. A piece is a sequence of its
own, so no sequence crosses documents and none holds padding; sequences of
equal length form a bucket and are numbered one after another, bucket by bucket.
"""
from __future__ import annotations

import base64
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import stored
from .common import slices

LENGTH = 1024
END_ID = 0
SPECIAL = "<|endoftext|>"


class ByteBpe:
    """Ids of the ``tokenizers`` file.

    The same vocabulary and split pattern through tiktoken give the same ids
    several times faster; a text that holds the special token's string goes
    through ``tokenizers`` itself, which reads that string as one id.
    """

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.json_path, self.slow = json_path, None

    def encode(self, text: str) -> list[int]:
        if SPECIAL in text:
            if self.slow is None:
                from tokenizers import Tokenizer
                self.slow = Tokenizer.from_file(self.json_path)
            return self.slow.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)


_BPE: dict = {}


def tokenizer(json_path: str | None = None, ranks_path: str | None = None) -> ByteBpe:
    key = (json_path or public_tokenizers.path("byte_bpe_50k.json"), ranks_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if key not in _BPE:
        _BPE[key] = ByteBpe(*key)
    return _BPE[key]


def cut(n: int, length: int = LENGTH) -> list[int]:
    """Lengths of the pieces of n ids: whole sequences, then the binary digits of the rest from the top."""
    full, rest = divmod(n, length)
    return [length] * full + [1 << i for i in range(rest.bit_length() - 1, -1, -1) if rest >> i & 1]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and ids), in one pass without a shuffle."""
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, task int, nth long"
    if with_ids:
        schema += ", ids array<int>"

    def run(batches):
        from pyspark import TaskContext
        bpe, task, made = tokenizer(), TaskContext.get().partitionId(), dict.fromkeys((1 << i for i in range(length.bit_length())), 0)
        for b in slices(batches, "text"):
            out: list[list] = [[] for _ in range(8)]
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist()):
                ids = bpe.encode(text or "")
                ids.append(END_ID)
                raw = np.asarray(ids, dtype="<u4")
                data, start = raw.tobytes(), 0
                for n in cut(len(ids), length):
                    row = (doc, start, n, zlib.crc32(data[4 * start:4 * (start + n)]), len(ids), task, made[n])
                    for col, v in zip(out, row):
                        col.append(v)
                    if with_ids:
                        out[7].append(raw[start:start + n].astype(np.int32))
                    made[n] += 1
                    start += n
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "nth"] + ["ids"] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=names)

    named = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return named.mapInArrow(run, schema)


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Sequences of the documents, one piece each: sequence_id and offset 0 are added to :func:`pieces`.

    ``length`` must be a power of two. Longer buckets come first; within a bucket
    ids follow the order of the tasks that read the documents. A null text is
    empty (the end id alone), rows that repeat are packed each, a null id stays
    null, other columns are ignored and an empty table gives no sequences.
    """
    if length & (length - 1):
        raise ValueError("length must be a power of two")
    rows = stored(pieces(docs, id_col, text_col, length, with_ids), "packed-pieces")
    # one row per task and bucket; its first number is what all earlier ones hold
    counts = rows.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("length").agg(F.sum("n").alias("n")).select(
        "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    firsts = (counts.join(F.broadcast(buckets), "length")  # at most log2(length) + 1 rows
              .select("length", "task", (F.col("base") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("first")))
    cols = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + F.col("nth")).alias("sequence_id"),
            F.lit(0).cast("long").alias("offset")]
    return rows.join(firsts, ["length", "task"]).select(*cols, *["ids"] * with_ids)

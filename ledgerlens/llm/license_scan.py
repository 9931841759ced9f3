"""License scan: stated phrases, and an exact set-similarity join against license templates.

The base counts the places of fixed phrases in the word sequence. The method
finds every block of text (a run of consecutive words, whatever line breaks lie in it, as long
as the template's block) that holds at least a threshold share of a template's
distinct words. Template words are ordered by their frequency over all documents,
rarest first. A block that reaches the overlap a template needs must hold one of the
template's first words (prefix filter), and its text enough of them at all (length
filter), counted in global order while the words left can still suffice (positional
filter). Blocks at every start are then slid over the places near prefix words.
"""
from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import append_columns, slices, utf8

# Base phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# License notices whose words a block is compared with, by label (a parameter of the operators).
TEMPLATES = {
    "gpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"],
    "apache": ["licensed under the apache license version 2 0 you may not use this file except in compliance with the license"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"],
}
THRESHOLD = 0.8
# Words of a block at least; longer templates have longer blocks.
WINDOW = 64

# Every byte outside [0-9A-Za-z] and below 0x80 separates words.
WORD_BYTES = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def places(words: bytes, phrase: bytes) -> list[int]:
    """Word indexes where the phrase starts; ``words`` is space-joined with a space at both ends."""
    found, at = [], words.find(b" " + phrase + b" ")
    index, seen = 0, 0
    while at >= 0:
        index, seen = index + words.count(b" ", seen, at), at
        found.append(index)
        at = words.find(b" " + phrase + b" ", at + 1)
    return found


def block_size(n_words: int, threshold: float) -> int:
    """Words of the blocks compared with a template of ``n_words``: the whole template with as many words between as the threshold lets go."""
    return max(WINDOW, math.ceil(n_words / threshold - 1e-9))


def blocks(text: bytes, window: int = WINDOW):
    """All runs of ``window`` words of the text, across line breaks; a shorter text is one. What the scan's results are defined by."""
    words = text.translate(WORD_BYTES).split()
    for i in range(max(len(words) - window + 1, min(len(words), 1))):
        yield words[i:i + window]


class Templates:
    """Template word sets in global frequency order, indexed by the words of their prefixes."""

    def __init__(self, templates: dict, threshold: float, frequency: dict):
        self.sets, self.index = [], {}
        for label, texts in sorted(templates.items()):
            for text in texts:
                sequence = text.encode().translate(WORD_BYTES).split()
                words = set(sequence)
                if not words:
                    continue
                ordered = sorted(words, key=lambda w: (frequency.get(w, 0), w))
                need = max(1, math.ceil(threshold * len(ordered) - 1e-9))
                no = len(self.sets)
                prefix = ordered[:len(ordered) - need + 1]
                self.sets.append((label, ordered, need, block_size(len(sequence), threshold), frozenset(prefix), frozenset(words)))
                for w in prefix:
                    self.index.setdefault(w, []).append(no)

    def matches(self, words: list[bytes]) -> dict[str, float]:
        """label -> largest containment of the templates that a block of the word sequence reaches."""
        held = set(words)
        out: dict[str, float] = {}
        for no in {t for w in held & self.index.keys() for t in self.index[w]}:
            label, ordered, need, size, prefix, known = self.sets[no]
            if len(held) < need:
                continue
            overlap = 0
            for i, w in enumerate(ordered):
                if overlap + len(ordered) - i < need:
                    break
                overlap += w in held
            if overlap >= need:
                best = self._largest(words, size, prefix, known)
                if best >= need:
                    out[label] = max(out.get(label, 0.0), best / len(ordered))
        return out

    @staticmethod
    def _largest(words: list[bytes], size: int, prefix: frozenset, known: frozenset) -> int:
        """Most distinct template words in a block of ``size`` words that holds a prefix word."""
        places_ = [(i, w) for i, w in enumerate(words) if w in known]
        best, first, anchors, count = 0, 0, 0, {}
        for i, w in places_:
            count[w] = count.get(w, 0) + 1
            anchors += w in prefix
            while places_[first][0] <= i - size:
                gone = places_[first][1]
                first += 1
                anchors -= gone in prefix
                count[gone] -= 1
                if not count[gone]:
                    del count[gone]
            if anchors:
                best = max(best, len(count))
        return best


def word_frequencies(docs: DataFrame, words: list[bytes], text_col: str = "text") -> dict[bytes, int]:
    """How many documents hold each of the given (template) words, over all documents."""
    wanted = sorted(set(words))

    def count(batches):
        total = np.zeros(len(wanted), dtype=np.int64)
        for b in slices(batches, "_text_in"):
            for t in utf8(b.column("_text_in")):
                if t:
                    held = set(t.translate(WORD_BYTES).split())
                    total += np.fromiter((w in held for w in wanted), dtype=bool, count=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(wanted)), pa.int32()), pa.array(total)], names=["word", "docs"])

    rows = (docs.select(F.col(f"`{text_col}`").cast("string").alias("_text_in")).mapInArrow(count, "word int, docs long")
            .groupBy("word").agg(F.sum("docs").alias("docs")).collect())  # one row per template word
    return {wanted[r["word"]]: r["docs"] for r in rows}


def scan_text(text: bytes | None, phrases: list[tuple[bytes, str]], templates: Templates):
    text = text or b""
    sequence = text.translate(WORD_BYTES).split()
    words = b" " + b" ".join(sequence) + b" "
    n_words = len(sequence)
    found, base = [], set()
    for phrase, label in phrases:
        at = places(words, phrase)
        if at:
            base.add(label)
            found += at
    labels, score = set(base), 1.0 if base else 0.0
    # a block can only match if the text holds a prefix word at all
    if any(b" " + w + b" " in words for w in templates.index):
        for label, share in templates.matches(sequence).items():
            labels.add(label)
            score = max(score, share)
    return n_words, len(found), min(found, default=None), max(found, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


def scan(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None, phrases: dict | None = None,
         templates: dict | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels and score to documents.

    first_word and last_word are the smallest and largest start of a base place (words from 0), null
    without one; labels adds those of templates whose containment in a block (see block_size) reaches
    ``threshold``; score is 1 with a base place, else the largest containment reached, else 0.
    Null texts count as empty; repeated rows are scanned each.
    """
    phrases_ = [(p.encode(), label) for p, label in (phrases or PHRASES).items()]
    templates_ = templates or TEMPLATES
    words = [w for texts in templates_.values() for t in texts for w in t.encode().translate(WORD_BYTES).split()]
    index = Templates(templates_, threshold, word_frequencies(docs, words, text_col))

    def run(texts):
        rows = [scan_text(t, phrases_, index) for t in texts]
        return [list(c) for c in zip(*rows)]

    return append_columns(docs, text_col, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
                          run, keep=keep)


"""License scan: phrases, and an exact set-similarity join of text blocks with licence templates.

A block is a line, or a sentence of one. Notices that run over lines or sentences are met too: in a paragraph, up to a
blank line, each window of a template's length over THRESHOLD is a block of its own, whatever signs stand in it; of such
windows that overlap, the best is told, where it holds more of the template than any line or sentence in it. A block meets a template when it holds at least THRESHOLD of the template's
distinct words. Words are ordered by their frequency in all documents, rarest first. A block that meets the
threshold must hold one of the template's first `|T| - need + 1` words (prefix filter), have at least `need` words
(length filter), and, from the place of its first match in that order, enough words of the template left
(positional filter); what passes is counted exactly.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.kernels import NOT_WORD, buffers, slices, word_offsets, words
from foliospark.llm.shared import bounded, text_of, tidy

#: The phrases whose places count, and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Notices of well-known licences, and their labels.
TEMPLATES = (
    ("licensed under the apache license version 2 0", "apache-2.0"),
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license", "gpl"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by-4.0"),
    ("this source code form is subject to the terms of the mozilla public license", "mpl"),
    ("all rights reserved", "reserved"),
)
THRESHOLD = 0.8
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;"]] = True


def templates(table: DataFrame, most: int = 10_000) -> list[tuple[str, str]]:
    """The notices of a table (text, label), once each; one of more than `most` is refused, since all tasks hold them."""
    rows = table.where("text is not null and label is not null").select("text", "label").distinct().orderBy("label", "text").limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} notices")
    return [(" ".join(r["text"].split()), r["label"]) for r in rows if len(hashes(r["text"]))]


def hashes(text: str) -> np.ndarray:
    """The hashes of a notice's words, lower-cased."""
    data, off = buffers(pa.array([text]))
    return words(data, off, NOT_WORD)[2]


def frequencies(docs: DataFrame, vocabulary: np.ndarray) -> dict[int, int]:
    """How often each word of the templates stands in all documents: a few rows from each partition."""
    wanted = np.sort(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        total = np.zeros(len(wanted), np.int64)
        screen = np.zeros(1 << 16, bool)
        screen[(wanted & np.uint64(0xFFFF)).astype(np.int64)] = True
        for batch in batches:
            for b in slices(batch):
                h = words(*buffers(b.column("text")), NOT_WORD)[2]
                h = h[screen[(h & np.uint64(0xFFFF)).astype(np.int64)]]
                i = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                total += np.bincount(i[wanted[i] == h], minlength=len(wanted))
        yield pa.RecordBatch.from_arrays([pa.array(wanted.view(np.int64)), pa.array(total)], ["h", "n"])

    rows = docs.select(F.coalesce("text", F.lit("")).alias("text")).mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).collect()
    return {r["h"] & (1 << 64) - 1: r["n"] for r in rows}


class Matcher:
    """Templates as rare-first word lists and the inverted index of their prefixes."""

    def __init__(self, templates, frequency: dict[int, int], threshold: float):
        self.threshold, self.templates, self.index = threshold, [], {}
        for text, label in templates:
            order = sorted(set(hashes(text).tolist()), key=lambda h: (frequency.get(h, 0), h))
            need = math.ceil(threshold * len(order) - 1e-9)
            for h in order[: len(order) - need + 1]:
                self.index.setdefault(h, []).append(len(self.templates))
            self.templates.append((order, need, label))
        self.lengths = [math.ceil(len(hashes(text)) / threshold) for text, _ in templates]
        self.keys = np.array(sorted(self.index), np.uint64)
        self.screen = np.zeros(1 << 16, bool)
        self.screen[(self.keys & np.uint64(0xFFFF)).astype(np.int64)] = True

    def places(self, h: np.ndarray) -> np.ndarray:
        """Where words stand that are in some template's prefix."""
        i = np.flatnonzero(self.screen[(h & np.uint64(0xFFFF)).astype(np.int64)])
        return i[np.isin(h[i], self.keys)]

    def meets(self, own: set[int]) -> list[tuple[str, float]]:
        """Labels and containments of the templates that a block of these distinct words meets."""
        found = []
        for t in {t for h in own if h in self.index for t in self.index[h]}:
            order, need, label = self.templates[t]
            if len(own) < need:
                continue
            first = next(i for i, h in enumerate(order) if h in own)
            if len(order) - first >= need and (n := sum(h in own for h in order)) >= need:
                found.append((label, n / len(order)))
        return found

    def wrapped(self, h: list[int], line: list[int]) -> list[tuple[int, int, str, float]]:
        """First word, words, label and containment of windows over a paragraph's words that meet a template.

        Of windows that overlap the best is given, where it spans blocks and holds more of the template than each of
        them does. line: the block of each word.
        """
        found = []
        for t in {t for x in set(h) if x in self.index for t in self.index[x]}:
            order, need, label = self.templates[t]
            wanted, size = set(order), self.lengths[t]
            at = [i for i, x in enumerate(h) if x in wanted]
            if len({h[i] for i in at}) < need:
                continue
            of: dict[int, set[int]] = {}
            for i in at:
                of.setdefault(line[i], set()).add(h[i])
            best, held, low, kept = None, {}, 0, []
            for k, i in enumerate(at):
                held[h[i]] = held.get(h[i], 0) + 1
                # words that are too far off, and those that stand again further on
                while at[low] <= i - size or held[h[at[low]]] > 1:
                    x = h[at[low]]
                    held[x] -= 1
                    if not held[x]:
                        del held[x]
                    low += 1
                if len(held) < need:
                    continue
                if best and at[low] > best[2]:
                    kept.append(best)
                    best = None
                if not best or len(held) > best[0]:
                    best = len(held), at[low], i
            for n, a, z in [*kept, best] if best else kept:
                if n > max(len(of.get(k, ())) for k in range(line[a], line[z] + 1)):
                    found.append((a, z - a + 1, label, n / len(order)))
        return found


def scan(docs: DataFrame, notices=TEMPLATES, phrases=PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, blocks of every row.

    blocks: the blocks met, as (first word, words, label, containment). score: the largest containment, 1 where a
    phrase stands, else 0. Texts of any length are scanned whole. A null or empty text has no words, null first and last word, empty labels and score 0.
    Repeated rows give equal rows; no rows give no rows; columns beside doc_id and text are ignored. Notices may
    be those of a table (`templates`).
    """
    bounded(docs.sparkSession)
    vocabulary = np.unique(np.concatenate([hashes(t) for t, _ in notices]))
    matcher = Matcher(notices, frequencies(docs, vocabulary), threshold)
    spoken = [(hashes(p), label) for p, label in phrases]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for b in slices(batch):
                yield block(b)

    def block(b: pa.RecordBatch) -> pa.RecordBatch:
        data, off = buffers(b.column("text"))
        start, end, h = words(data, off, NOT_WORD)
        at = word_offsets(start, off)
        n = b.num_rows
        base = [[] for _ in range(n)]
        labels = [set() for _ in range(n)]
        for p, label in spoken:
            hit = np.flatnonzero(h[: max(0, len(h) - len(p) + 1)] == p[0])
            for j in range(1, len(p)):
                hit = hit[h[hit + j] == p[j]]
            doc = np.searchsorted(at, hit, side="right") - 1
            for d, i in zip(doc.tolist(), hit.tolist(), strict=True):
                if i + len(p) <= at[d + 1]:
                    base[d].append(i - int(at[d]))
                    labels[d].add(label)
        more, score, blocks = [set(x) for x in labels], [1.0 if x else 0.0 for x in labels], [[] for _ in range(n)]
        hit = matcher.places(h)
        if len(hit):
            # a block ends at a line's end, and at a full stop or the like before white space
            stop = data == 10
            stop[:-1] |= _STOP[data[:-1]] & (data[1:] <= 32)
            ends = np.union1d(np.flatnonzero(stop) + 1, off)
            of = np.searchsorted(ends, start[hit], side="right")
            for k in np.unique(of).tolist():
                a, z = np.searchsorted(start, [ends[k - 1], ends[k]])
                d = int(np.searchsorted(at, a, side="right")) - 1
                for label, share in matcher.meets(set(h[a:z].tolist())):
                    more[d].add(label)
                    score[d] = max(score[d], share)
                    blocks[d].append({"first": int(a - at[d]), "words": int(z - a), "label": label, "share": share})
            # windows over paragraphs, which end at blank lines alone
            lines = np.flatnonzero(data == 10)
            ink = np.concatenate([[0], np.cumsum(data > 32)])
            blank = lines[1:][ink[lines[1:]] == ink[lines[:-1]]]
            long = np.union1d(blank + 1, off)
            for k in np.unique(np.searchsorted(long, start[hit], side="right")).tolist():
                a, z = np.searchsorted(start, [long[k - 1], long[k]])
                line = np.searchsorted(ends, start[a:z], side="right")
                if line[0] == line[-1]:
                    continue
                d = int(np.searchsorted(at, a, side="right")) - 1
                for first, count, label, share in matcher.wrapped(h[a:z].tolist(), line.tolist()):
                    more[d].add(label)
                    score[d] = max(score[d], share)
                    blocks[d].append({"first": int(a - at[d]) + first, "words": count, "label": label, "share": share})
        cols = [
            b.column("doc_id"), pa.array(np.diff(at)), pa.array([len(x) for x in base], pa.int64()),
            pa.array([min(x, default=None) for x in base], pa.int64()), pa.array([max(x, default=None) for x in base], pa.int64()),
            pa.array([",".join(sorted(x)) for x in labels], pa.string()), pa.array([",".join(sorted(x)) for x in more], pa.string()), pa.array(score, pa.float64()),
            pa.array([sorted(x, key=lambda y: (y["first"], y["label"])) for x in blocks], pa.list_(pa.struct([("first", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("share", pa.float64())]))),
        ]
        return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"])

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, blocks array<struct<first: long, words: long, label: string, share: double>>"
    return text_of(docs).mapInArrow(run, schema)

"""Suffix-array dedup by depth-limited refinement: every byte string of `window` bytes that starts twice.

Suffixes are split by one key after another, only as deep as the window, and a group of one is dropped at once; the
groups that are left at full depth are exactly the repeated windows. Only equality counts, so a pass's digit is a
hash of part of the window rather than its first byte:

1. The window's anchor: of its `gram`-byte strings the one of the smallest hash. Equal windows have equal anchors at
   equal places, and neighbouring windows share one, so about two suffixes in `window - gram + 2` stand for all.
2. The stretch: all bytes of the windows that share an anchor. Anchors whose stretches are equal are repeats as a
   whole, and one stretch stands for all its copies.
3. The core: what every `CELL` windows at the same places from the anchor have in common, then all their bytes; again
   equal ones are repeats as a whole, one of them stands for all, and cells whose core no other has are dropped.
4. The full window, for one copy of each different cell that shares its core.

What is taken for equal agrees in two hashes of 64 bits, of part of its bytes and of all of them.

Where a text repeats itself after a few bytes, blanks or a ruler, anchors stand that close, and two periods stand for
the whole: its bytes are compared, its windows all repeat, and one mark says so.

Copies of a document, a passage or a line meet in partial aggregates; a join that may meet a hot key reads tables
without partitioning, so it can be split. Bloom bitmaps of bounded size keep rows without a partner from the shuffles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StringType, StructField, StructType

from foliospark.llm.kernels import BASE, BASE2, SEGMENT, buffers, mix, prefix, slices, sliding_min, substring_hash
from foliospark.llm.shared import among, bloom, bounded, in_bloom, materialize, temporary, tidy

WINDOW, GRAM, CELL = 200, 48, 16
_PLACE = np.uint64((1 << 22) - 1)


def anchors(data: np.ndarray, off: np.ndarray, window: int, gram: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of windows with one anchor: anchor hash, stretch hash, text, first window's start in it, windows, the
    anchor's distance from that start, and whether it isn't a run but the mark of a periodic stretch."""
    width = np.diff(off)
    edge = np.zeros(len(data) + 2, np.int8)
    long = np.flatnonzero(width >= window)
    np.add.at(edge, off[long], 1)
    np.add.at(edge, off[long + 1] - window + 1, -1)
    valid = np.cumsum(edge[: len(data)], dtype=np.int8).astype(bool)
    for s in range(0, max(0, len(data) - window + 1), SEGMENT):
        ok = valid[s : min(s + SEGMENT, len(data) - window + 1)]
        idx = np.flatnonzero(ok)
        if not len(idx):
            continue
        d = data[s : s + len(ok) + window - 1]
        p = prefix(d)
        at = np.arange(len(d) - gram + 1)
        h = substring_hash(p, at, at + gram)
        least = sliding_min((h & ~_PLACE) | at.astype(np.uint64), window - gram + 1)
        a = (least[idx] & _PLACE).astype(np.int64)
        new = np.ones(len(idx), bool)
        new[1:] = (np.diff(idx) != 1) | (np.diff(a) != 0)
        first = np.flatnonzero(new)
        p0, p1 = idx[first], idx[np.append(first[1:], len(idx)) - 1]
        anchor = a[first]
        stretch = mix(substring_hash(prefix(d, BASE2), p0, p1 + window, BASE2) + (anchor - p0).astype(np.uint64))
        doc = np.searchsorted(off, p0 + s, side="right") - 1
        run = [h[anchor], stretch, doc, p0 + s - off[doc], p1 - p0 + 1, anchor - p0, np.zeros(len(p0), bool)]
        if len(found := _periodic(d, run[0], doc, p0, p1, anchor, window)):
            i, last, until = found.T
            keep = np.ones(len(p0), bool)
            for a, b, to in found.tolist():
                keep[a : b + 1] = p0[a : b + 1] < to
            marks = [run[0][i], run[1][i], doc[i], run[3][i], p1[last] - p0[i] + 1, run[5][i], np.ones(len(i), bool)]
            run = [np.concatenate([x[keep], y]) for x, y in zip(run, marks, strict=True)]
        yield tuple(run)


def _periodic(d: np.ndarray, key: np.ndarray, doc: np.ndarray, p0: np.ndarray, p1: np.ndarray, anchor: np.ndarray, window: int, least: int = 8) -> np.ndarray:
    """Of runs whose anchors are equal and equally far apart, `least` or more in a row, those over bytes that repeat
    themselves at that distance: first run, last run, and the window from which on all equal earlier ones."""
    step = np.diff(anchor)
    like = np.zeros(len(key) + 1, bool)
    like[2:-1] = (key[2:] == key[1:-1]) & (key[1:-1] == key[:-2]) & (doc[2:] == doc[:-2]) & (step[1:] == step[:-1]) & (p0[2:] == p1[1:-1] + 1) & (p0[1:-1] == p1[:-2] + 1)
    edge = np.flatnonzero(like[1:] != like[:-1]) + 1
    found = []
    for a, b in edge.reshape(-1, 2).tolist():  # like from a up to b, so equal from a - 2 to b - 1
        a, b = a - 2, b - 1
        q = int(step[a])
        if b - a + 1 >= least and q > 0 and np.array_equal(d[p0[a] : p1[b] + window - q], d[p0[a] + q : p1[b] + window]):
            found.append((a, b, int(p0[a]) + 2 * q))
    return np.array(found, np.int64).reshape(-1, 3)


def _runs(texts: DataFrame, window: int, gram: int, only=None, marks: bool = False) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for b in slices(batch):
                rid = b.column("rid").to_numpy()
                for key, whole, doc, p, n, d, mark in anchors(*buffers(b.column("text")), window, gram):
                    key, whole = key.view(np.int64), whole.view(np.int64)
                    keep = in_bloom(only.value, key) if only else np.ones(len(key), bool)
                    keep &= marks | ~mark
                    yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, whole, rid[doc], *(y.astype(np.int32) for y in (p, n, d)), mark)], ["key", "whole", "rid", "p", "n", "d", "mark"])

    return texts.mapInArrow(run, "key long, whole long, rid long, p int, n int, d int, mark boolean")


def _groups(rows: DataFrame) -> DataFrame:
    """key and several, for keys of more than one row: whether their wholes differ."""
    groups = rows.groupBy("key").agg(F.count("*").alias("c"), F.min("whole").alias("lo"), F.max("whole").alias("hi"))
    return materialize(groups.where("c > 1").select("key", (F.col("lo") != F.col("hi")).alias("several")), "groups")


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of rows that share their key with another: those repeated as a whole (rid, p, n), and where wholes differ one
    row for each (key, rid, p, n, d), with whether it is known to be repeated."""
    several = rows.where("several")
    one = several.groupBy("key", "whole").agg(F.count("*").alias("c"), F.min(F.struct("rid", "p", "n", "d")).alias("r"))
    one = materialize(one.select("key", "whole", (F.col("c") > 1).alias("known"), "r.*"), "one")
    whole = several.join(one.where("known").select("key", "whole"), ["key", "whole"])
    return rows.where("not several").select("rid", "p", "n").union(whole.select("rid", "p", "n")), one.drop("whole")


def repeats(texts: DataFrame, window: int = WINDOW, gram: int = GRAM, cell: int = CELL) -> DataFrame:
    """(rid, p, n): windows that start at p, ..., p + n - 1 of row rid's text also start elsewhere. texts: rid, text."""
    groups = _groups(_runs(texts, window, gram))
    only = bloom(groups, "key", groups.count())
    runs = materialize(_runs(texts, window, gram, only, True).join(groups, "key"), "runs")
    by_stretch, open_runs = _split(runs.where("not mark").drop("mark"))
    cells = materialize(_deeper(texts, open_runs, _cells(window, cell)), "cells")
    cells = materialize(cells.join(_groups(cells), "key"), "shared")
    by_cell, open_cells = _split(cells)
    windows = materialize(_deeper(texts, open_cells, _windows(window)), "windows")
    twice = materialize(windows.groupBy("key", "whole").count().where("count > 1").select("key", "whole"), "twice")
    single = windows.where("not known").join(twice, ["key", "whole"]).select("rid", "p", "n")
    return by_stretch.union(by_cell).union(single).union(runs.where("mark").select("rid", "p", "n"))


def _deeper(texts: DataFrame, rows: DataFrame, keys) -> DataFrame:
    """key, whole, rid, p, n, d, known: `keys` of every row's parts, from the texts that they are in."""
    wanted = materialize(rows.groupBy("rid").agg(F.collect_list(F.struct("key", "p", "n", "d", "known")).alias("runs")), "wanted")
    near = among(texts, "rid", bloom(wanted, "rid", wanted.count()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for b in slices(batch):
                data, off = buffers(b.column("text"))
                runs = b.column("runs").flatten()
                key, p, n, d, known = (runs.field(i).to_numpy(zero_copy_only=False) for i in range(5))
                doc = np.repeat(np.arange(b.num_rows), np.diff(b.column("runs").offsets.to_numpy()))
                rid = b.column("rid").to_numpy()
                for s in range(0, len(key), 10_000):
                    t = slice(s, s + 10_000)
                    i, k, whole, at, size, far = keys(data, key[t].view(np.uint64), p[t] + off[doc[t]], n[t].astype(np.int64), d[t].astype(np.int64))
                    i = i + s
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (k.view(np.int64), whole.view(np.int64), rid[doc[i]], (at - off[doc[i]]).astype(np.int32), size.astype(np.int32), far.astype(np.int32), known[i])],
                        ["key", "whole", "rid", "p", "n", "d", "known"],
                    )

    return near.join(wanted, "rid").mapInArrow(run, "key long, whole long, rid long, p int, n int, d int, known boolean")


def _cells(window: int, cell: int):
    """Runs cut into cells of windows at the same distances from the anchor: core as key, all bytes as whole."""

    def keys(data, key, at, n, d):
        low, high = (d - n + 1) // cell, d // cell  # distances fall from d to d - n + 1
        count = high - low + 1
        i = np.repeat(np.arange(len(key)), count)
        j = high[i] - (np.arange(len(i)) - np.repeat(np.cumsum(count) - count, count))
        anchor = at[i] + d[i]
        near, far = np.maximum(j * cell, (d - n + 1)[i]), np.minimum(j * cell + cell - 1, d[i])
        base = anchor - j * cell
        core = mix(_far_hash(data, base, window - cell + 1) ^ key[i] ^ mix(j.astype(np.uint64)))
        whole = _far_hash(data, anchor - far, window + far - near)
        whole = mix(whole ^ mix((far * 256 + near).astype(np.uint64)))  # cells that the run cuts alike are alike
        return i, core, whole, anchor - far, far - near + 1, far

    return keys


def _windows(window: int):
    """Each window of the runs: its hash as key, which the cell's key refines, and another hash of it as whole."""

    def keys(data, key, at, n, d):
        i = np.repeat(np.arange(len(key)), n)
        step = np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        start = at[i] + step
        h = mix(_far_hash(data, start, window) ^ key[i])
        return i, h, _far_hash(data, start, window, BASE), start, np.ones(len(i), np.int64), d[i] - step

    return keys


def _far_hash(data: np.ndarray, start: np.ndarray, size, base: int = BASE2) -> np.ndarray:
    """Hashes of the strings of `size` bytes that start at `start`, in any order, by stretches of bounded size."""
    out, size = np.zeros(len(start), np.uint64), np.broadcast_to(size, len(start))
    most = int(size.max()) if len(size) else 0
    for s in range(0, len(data), SEGMENT):
        i = np.flatnonzero((start >= s) & (start < s + SEGMENT))
        if len(i):
            p = prefix(data[s : s + SEGMENT + most], base)
            out[i] = substring_hash(p, start[i] - s, start[i] - s + size[i], base)
    return out


def _sums(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    """How many flags each text has."""
    out, some = np.zeros(len(off) - 1, np.int64), np.flatnonzero(np.diff(off))
    if len(some):
        out[some] = np.add.reduceat(flags, off[some], dtype=np.int64)
    return out


def strip(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, keep: tuple[str, ...] = ("doc_id",), text: bool = False) -> DataFrame:
    """The columns kept, n_bytes, n_removed, n_spans and kept of every row: the bytes left, or the text that they hold.

    Every byte that a repeated window covers goes. A null text is empty; texts under `window` bytes stay as they are.
    Rows are told apart by id and text, so repeated rows, null ids and ids that stand for several texts are all
    documents; equal rows repeat each other. No rows give no rows; other columns are ignored.
    """
    bounded(docs.sparkSession)
    texts = docs.select(*keep, F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id", F.coalesce("text", F.lit(""))).alias("rid"))
    with temporary(docs.sparkSession) as keep_table:
        marks = repeats(texts.select("rid", "text"), window, gram)
        # a set: equal rows, which share a rid, have equal marks
        spans = keep_table(materialize(marks.groupBy("rid").agg(F.collect_set(F.struct("p", "n")).alias("spans")), "spans"))
    marked = bloom(spans, "rid", spans.count())
    schema = docs.select(*keep).schema

    def clear(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows that surely have no marks; the others come back from their join."""
        for b in batches:
            yield from run([b.filter(pa.array(~in_bloom(marked.value, b.column("rid").to_numpy())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            for b in slices(batch):
                data, off = buffers(b.column("text"))
                spans = b.column("spans") if "spans" in b.schema.names else None
                gone = np.zeros(len(data) + 1, np.int32)
                if spans is not None and spans.null_count < len(spans):
                    size = np.nan_to_num(np.asarray(spans.value_lengths().to_numpy(zero_copy_only=False), float)).astype(np.int64)
                    flat = spans.flatten()
                    p, n = (flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(2))
                    start = p + np.repeat(off[:-1], size)
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + n - 1 + window, -1)
                hidden = np.cumsum(gone[:-1]) > 0
                head = hidden.copy()
                head[1:] &= ~hidden[:-1]
                inner = off[:-1][np.diff(off) > 0]
                head[inner] = hidden[inner]
                removed, begun = (_sums(x, off) for x in (hidden, head))
                left = data[~hidden]
                at = off - np.concatenate([[0], np.cumsum(removed)])
                kept = pa.Array.from_buffers(pa.binary(), b.num_rows, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(left.tobytes())])
                if text:
                    kept = pa.array([x.as_py().decode("utf-8", "ignore") for x in kept], pa.string())
                yield pa.RecordBatch.from_arrays(
                    [*(b.column(c) for c in keep), pa.array(np.diff(off)), pa.array(removed), pa.array(begun), kept],
                    [*keep, "n_bytes", "n_removed", "n_spans", "kept"],
                )

    out = StructType([*schema.fields, *(StructField(n, LongType()) for n in ("n_bytes", "n_removed", "n_spans")), StructField("kept", StringType() if text else BinaryType())])
    some = among(texts, "rid", marked).join(spans, "rid", "left").mapInArrow(run, out)
    return texts.mapInArrow(clear, out).union(some) if marked else some


def digests(stripped: DataFrame) -> DataFrame:
    """The columns of `strip` with kept as its lower-case SHA-256."""
    return stripped.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def cleaned(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with what `strip` leaves as text, characters that it cut in two left out; n_chars follows where it is a column."""

    # all other columns travel as one, so that none of their names can clash
    row = [c for c in docs.columns if c != "text"]
    out = strip(docs.select("doc_id", "text", F.struct(*row).alias("row_")), window, gram, ("row_",), True).select("row_.*", F.col("kept").alias("text"))
    if "n_chars" in row:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)

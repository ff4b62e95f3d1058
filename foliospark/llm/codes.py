"""Vector code compression: every part of a vector becomes the index of its nearest codebook entry.

The nearest entry is found by a vector-approximation file over the codebook: an entry's coordinates are quantised into
cells of a few bits, a lookup table for each queried part holds the least and the largest squared distance to every cell,
and sums over an entry's cells bound its distance. Only entries whose lower bound does not pass the smallest upper bound
are refined, by their integer distances, so the result is that of comparing all.

A round is one pass of map tasks. Each sends one sum an entry that it met, whatever its number of rows, and the driver
gets one row an entry: parts x entries, which does not grow with the input.

Defined results: vectors that are null or hold null or non-finite components are left out; other components are held
within +-2^26 after scaling, so that distances fit in a long; vectors shorter than the longest, or not divisible into
equal parts, count as ending in zeros; of rows with one vec_id the smallest vector can start an entry; a null vec_id or
label is a value like others, the null vec_id last; fewer vec_ids than entries make a smaller codebook; an empty table
gives no rows. Sums of a label that pass a long are null.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.llm.shared import bounded, folded, materialize, temporary, tidy

SCALE, MOST = 1024, 1 << 26
#: Bits of a cell, and the rows that are bounded at once.
BITS, BLOCK = 5, 512


class Cells:
    """The cells of one part's entries: bounds first, integer distances for what they leave."""

    def __init__(self, entries: np.ndarray, bits: int = BITS):
        self.entries = entries.astype(np.int64)
        k, w = entries.shape
        n = min(1 << bits, k)
        self.cell, self.low, self.high = np.zeros((k, w), np.intp), np.zeros((w, n), np.int64), np.zeros((w, n), np.int64)
        for j in range(w):
            order = np.argsort(entries[:, j], kind="stable")
            self.cell[order, j] = np.arange(k) * n // k
            first = np.searchsorted(self.cell[order, j], np.arange(n))
            self.low[j] = entries[order, j][first]
            self.high[j] = entries[order, j][np.append(first[1:], k) - 1]

    def candidates(self, x: np.ndarray) -> np.ndarray:
        """Rows by entries: True where the entry may be the nearest."""
        k, w = self.entries.shape
        span = int(max(np.abs(x).max(initial=0), np.abs(self.entries).max(initial=0)))
        kind = np.int32 if 4 * span * span * max(w, 1) < 1 << 31 else np.int64
        least, largest = np.zeros((k, len(x)), kind), np.zeros((k, len(x)), kind)
        x, low, high = x.T.astype(kind), self.low.astype(kind), self.high.astype(kind)
        for j in range(w):
            below, above = low[j][:, None] - x[j], x[j] - high[j][:, None]
            near = np.maximum(np.maximum(below, above), 0)
            far = np.maximum(np.abs(below), np.abs(above))
            least += (near * near)[self.cell[:, j]]
            largest += (far * far)[self.cell[:, j]]
        return (least <= largest.min(axis=0)).T

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each row, ties to the lower index, and its squared distance."""
        index, distance = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
        for a in range(0, len(x), BLOCK):
            rows = x[a : a + BLOCK]
            at, entry = np.nonzero(self.candidates(rows))
            gap = rows[at] - self.entries[entry]
            d = np.einsum("ij,ij->i", gap, gap)
            starts = np.flatnonzero(np.diff(at, prepend=-1))
            least = np.minimum.reduceat(d, starts)
            hit = np.flatnonzero(d == least[at])
            first = hit[np.flatnonzero(np.diff(at[hit], prepend=-1))]
            index[a : a + BLOCK], distance[a : a + BLOCK] = entry[first], least
        return index, distance


@dataclass(frozen=True)
class Codebooks:
    """Integer entries, by part, entry, position."""

    entries: np.ndarray

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decoded(self, code: str) -> list[int]:
        """The vector that a code stands for, of scaled components."""
        return [int(c) for part, i in zip(self.entries, bytes.fromhex(code), strict=True) for c in part[i]]


def _integers(vectors: DataFrame) -> DataFrame:
    """(vec_id, label, ints) of the vectors that count."""
    own = [f for f in vectors.schema.fields if f.name in ("vec_id", "label")]
    schema = T.StructType([*own, T.StructField("ints", T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for b in batches:
            lists = b.column("embedding")
            b, lists = b.filter(lists.is_valid()), lists.filter(lists.is_valid())
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            sizes = lists.value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            bad = np.append(0, np.cumsum(~np.isfinite(flat)))
            whole = bad[ends] == bad[ends - sizes]
            flat = flat[np.repeat(whole, sizes)]
            ints = np.clip(np.floor(flat * SCALE), -MOST, MOST).astype(np.int32)
            offsets = np.append(0, np.cumsum(sizes[whole])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name).filter(pa.array(whole)) for f in own], pa.ListArray.from_arrays(pa.array(offsets), pa.array(ints))], [*[f.name for f in own], "ints"])

    return vectors.select("vec_id", "label", "embedding").mapInArrow(run, schema)


def _padded(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of integers, each filled up with zeros to the width."""
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), lists.value_lengths().to_numpy()
    if (sizes == width).all():
        return flat.reshape(len(lists), width)
    out = np.zeros((len(lists), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _first(rows: DataFrame, parts: int, entries: int, width: int) -> np.ndarray:
    """The codebooks to start from: at most `entries` rows reach the driver."""
    ids = rows.select("vec_id").distinct().orderBy(F.col("vec_id").asc_nulls_last()).limit(entries)
    found = rows.join(F.broadcast(ids.withColumnRenamed("vec_id", "of")), F.col("vec_id").eqNullSafe(F.col("of")))
    found = found.groupBy("vec_id").agg(F.min("ints").alias("ints")).orderBy(F.col("vec_id").asc_nulls_last()).toArrow()
    whole = _padded(found.column("ints").combine_chunks(), width)
    return whole.reshape(len(whole), parts, width // parts).transpose(1, 0, 2)


def _assigned(rows: DataFrame, books: np.ndarray) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """A function for tasks: batch to parts (rows, parts, positions), indexes and squared distances (parts, rows)."""
    sent = rows.sparkSession.sparkContext.broadcast(books)  # parts x entries vectors, whatever the input
    held: list[Cells] = []

    def run(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        parts, _, w = sent.value.shape
        if not held:
            held.extend(Cells(e) for e in sent.value)
        x = _padded(b.column("ints"), parts * w).reshape(b.num_rows, parts, w)
        found = [cells.nearest(x[:, p]) for p, cells in enumerate(held)]
        return x, np.stack([i for i, _ in found]), np.stack([d for _, d in found])

    return run


def _moved(rows: DataFrame, books: np.ndarray) -> np.ndarray:
    """Every entry replaced by the floor of the mean of its parts; an entry without any stays."""
    parts, k, w = books.shape
    assign = _assigned(rows, books)

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        total = np.zeros((parts * k, w + 1), np.int64)
        for b in batches:
            x, index, _ = assign(b)
            for p in range(parts):
                np.add.at(total, p * k + index[p], np.concatenate([x[:, p], np.ones((len(x), 1), np.int64)], axis=1))
        met = np.flatnonzero(total[:, -1])
        yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array([total[i].tobytes() for i in met], pa.binary())], ["entry", "sums"])

    def add(held: np.ndarray | None, more: bytes) -> np.ndarray:
        more = np.frombuffer(more, np.int64)
        return more.copy() if held is None else held + more

    out = books.reshape(parts * k, w).copy()
    for r in folded(rows.select("ints").mapInArrow(sums, "entry int, sums binary"), add, np.ndarray.tobytes).collect():
        total = np.frombuffer(r["sums"], np.int64)
        out[r["entry"]] = total[:-1] // total[-1]
    return out.reshape(books.shape)


def compress(vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4) -> tuple[DataFrame, Codebooks]:
    """Rows (vec_id, label, code, error, label_error) and the codebooks.

    code: the parts' entries, two hexadecimal digits each, so entries are at most 256; error: their squared distances
    summed; label_error: the errors of the label's rows summed, nulls together. Labels are summed before the shuffle and
    met again in a join that Spark may split, so a label of a third of the rows is no single task.
    """
    if not 0 < entries <= 256:
        raise ValueError("a part's code has two hexadecimal digits")
    bounded(vectors.sparkSession)
    with temporary(vectors.sparkSession) as keep:
        rows = materialize(_integers(vectors), "ints")
        width = -(-(rows.agg(F.max(F.size("ints"))).first()[0] or 0) // parts) * parts
        books = _first(rows, parts, entries, width)
        for _ in range(rounds if books.size else 0):
            books = _moved(rows, books)
        assign = _assigned(rows, books)
        schema = T.StructType([*rows.schema.fields[:2], T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

        def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tidy()
            for b in batches:
                if b.num_rows:
                    _, index, distance = assign(b)
                    texts = [bytes(i).hex() for i in index.T.astype(np.uint8)]
                    yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts), pa.array(distance.sum(axis=0))], schema.names)

        found = keep(materialize(rows.mapInArrow(code, schema), "codes"))
    sums = found.groupBy(F.col("label").alias("of")).agg(F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long").alias("label_error"))
    return found.join(sums, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", "label", "code", "error", "label_error"), Codebooks(books)

"""Session helpers the operators share: scratch tables, Bloom bitmaps, table readers."""

from __future__ import annotations

import ctypes
import gc
import os
import threading
import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.sources.scratch import discard, materialize, scope  # noqa: F401  (the operators take them from here)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables that this thread materializes inside are deleted when it ends, but for those passed to the function that it gives."""
    with scope(spark) as own:
        yield own.keep


#: Rows and bytes that cross to a Python worker at once, unless the session sets less: whole texts and sets are long.
BATCH, BATCH_BYTES = 1000, 1 << 20


def bounded(spark: SparkSession) -> None:
    """Lower the session's limits of Arrow batches to BATCH and BATCH_BYTES; Spark has no such limit for one frame."""
    for key, most in (("maxRecordsPerBatch", BATCH), ("maxBytesPerBatch", BATCH_BYTES)):
        key = f"spark.sql.execution.arrow.{key}"
        if not 0 < int(spark.conf.get(key).rstrip("b")) <= most:
            spark.conf.set(key, most)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A Parquet table of the data folder, read by Spark alone; its rows go to Python in bounded batches."""
    bounded(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_tidied = 0


class Idle:
    """Objects that a Python worker makes once for all its tasks, and drops when none has asked for one for a while."""

    SECONDS = 4.0
    _all: list[Idle] = []

    def __init__(self, make: Callable):
        self.make, self.held, self.used = make, {}, {}
        self._all.append(self)

    def __call__(self, key):
        self.used[key] = time.monotonic()
        if (found := self.held.get(key)) is None:
            found = self.held[key] = self.make(key)
        return found

    def touch(self, key) -> None:
        """Say that the object is still in use."""
        self.used[key] = time.monotonic()

    @classmethod
    def sweep(cls) -> None:
        for own in cls._all:
            for key in [k for k, t in own.used.items() if time.monotonic() - t > cls.SECONDS]:
                own.held.pop(key, None)
                own.used.pop(key, None)


def tidy() -> None:
    """To be called in a Python worker: from then on, memory that it has freed goes back to the system twice a second.

    Workers outlive their tasks and wait for others, each with the heap of the largest batch that it ever met.
    """
    global _tidied
    if _tidied == os.getpid():
        return
    _tidied = os.getpid()

    def keep() -> None:
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        while True:
            time.sleep(0.5)
            Idle.sweep()
            gc.collect(0)
            pa.default_memory_pool().release_unused()
            if trim:
                trim(0)

    threading.Thread(target=keep, daemon=True).start()


def text_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text (null: empty), with the further columns named; every other column is pruned."""
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *more)


#: Bits in a Bloom bitmap: 2**LEAST to 2**MOST (16 MB). A table of more than KEYS keys gets none.
LEAST, MOST, KEYS = 16, 27, 1 << 25
SLICES = 64


def bloom_slots(keys: np.ndarray, bits: int) -> np.ndarray:
    """Two bit positions for each 64-bit key."""
    k = keys.view(np.uint64)
    with np.errstate(over="ignore"):
        a = (k * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)
        b = ((k ^ (k >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - bits)
    return np.stack([a, b]).astype(np.int64)


def bloom(df: DataFrame, column: str, rows: int):
    """Broadcast bitmap of a long column, of 16 MB at most: a filter that lets some strangers pass but no member miss.

    None where the table has more than KEYS rows, for which such a bitmap would hardly filter: then the exact join
    that follows does all the work, by a shuffle.
    """
    if rows > KEYS:
        return None
    bits = int(min(MOST, max(LEAST, np.ceil(np.log2(8 * max(rows, 1))))))
    width = (1 << bits) // 8 // SLICES

    def partial(batches):
        tidy()
        packed = np.zeros((1 << bits) // 8, np.uint8)
        seen = False
        for b in batches:
            if b.num_rows:
                seen = True
                slot = bloom_slots(b.column(0).to_numpy(zero_copy_only=False), bits).ravel()
                np.bitwise_or.at(packed, slot >> 3, (128 >> (slot & 7)).astype(np.uint8))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([p.tobytes() for p in packed.reshape(SLICES, width)], pa.binary())], ["slice", "bits"])

    def union(found: np.ndarray | None, bits: bytes) -> np.ndarray:
        more = np.frombuffer(bits, np.uint8)
        return more.copy() if found is None else found | more

    # a bitmap a task: of so few tasks that their bitmaps are no larger than the keys
    slim = df.select(column).coalesce(max(4, rows >> 21))
    parts = folded(slim.mapInArrow(partial, "slice int, bits binary"), union, np.ndarray.tobytes).collect()  # 16 MB at most
    whole = np.zeros((SLICES, width), np.uint8)
    for r in parts:
        whole[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return df.sparkSession.sparkContext.broadcast((bits, whole.ravel()))


def in_bloom(bitmap: tuple[int, np.ndarray], keys: np.ndarray) -> np.ndarray:
    bits, packed = bitmap
    out = np.ones(len(keys), bool)
    for slot in bloom_slots(keys, bits):
        out &= (packed[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1
    return out


def folded(df: DataFrame, fold: Callable, done: Callable) -> DataFrame:
    """Rows (key int, value binary) folded to one a key, as they come: fold(what is held or None, value), then done.

    A task holds one state for each of its keys and one batch; a worker needs no pandas for it, as it would for groups.
    """
    key, value = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        held: dict = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held[k] = fold(held.get(k), v.as_py())
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.int32()), pa.array([done(v) for v in held.values()], pa.binary())], [key, value])

    return df.repartition(key).mapInArrow(run, f"{key} int, {value} binary")


def among(df: DataFrame, column: str, bitmap) -> DataFrame:
    """Rows whose long column may be in the bitmap's table: all of them, and some strangers."""
    if bitmap is None:
        return df
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for b in batches:
            keep = in_bloom(bitmap.value, b.column(at).to_numpy(zero_copy_only=False))
            if keep.any():
                yield b.filter(pa.array(keep))

    return df.mapInArrow(run, df.schema)


def member(bitmap) -> Callable[[str], Column]:
    """A filter on a long column: False only where the bitmap's table lacks the key. Only the key goes to Python."""
    if bitmap is None:
        return lambda column: F.lit(True)

    @F.arrow_udf("boolean")
    def test(keys: pa.Array) -> pa.Array:
        tidy()
        return pa.array(in_bloom(bitmap.value, keys.to_numpy(zero_copy_only=False)))

    return test

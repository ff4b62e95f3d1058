"""Concatenate-and-cut packing: two-pass prefix sums give every document its place in one long token stream.

Pass one writes each document's ids with its start among its partition's tokens. The partitions' totals, one number
for each, are summed in order into partition starts. Pass two adds them, cuts the stream at every multiple of the
sequence length, and a document that crosses a cut gets a boundary record on each side. Nothing is shuffled, and
only the last sequence isn't full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.bpe import SLICE, binary, encoder
from foliospark.llm.kernels import buffers, slices
from foliospark.llm.shared import bounded, materialize, tidy

#: The id that ends every document.
END = 0


def _kind(docs: DataFrame) -> str:
    return docs.schema["doc_id"].dataType.simpleString()


def tokenise(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, part, start (in the part), n, ids (binary) of every row, each with the end id; written to a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        enc, part, total = encoder(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            for b in slices(batch, size=SLICE):
                ids, at, _, _ = enc.encode(*buffers(b.column("text")))
                ids = np.insert(ids, at[1:], END)
                at = at + np.arange(len(at))
                start = total + at[:-1]
                total += int(at[-1])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), pa.array(np.full(b.num_rows, part, np.int32)), pa.array(start), pa.array(np.diff(at)), binary(ids, at)],
                    ["doc_id", "part", "start", "n", "ids"],
                )

    bounded(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return materialize(texts.mapInArrow(run, f"doc_id {_kind(docs)}, part int, start long, n long, ids binary"), "ids")


def pack(docs: DataFrame, path: str, length: int = 1024) -> DataFrame:
    """Pieces of every row's token stream: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    ids are little-endian unsigned 32-bit. A null or empty text is its end id alone; repeated rows and rows without
    doc_id are documents of their own; doc_ids are of any type; texts of any length are tokenised whole; columns beside doc_id and text are ignored; no rows give no pieces.
    """
    spark = docs.sparkSession
    rows = tokenise(docs, path)
    before, total = [], 0
    for r in rows.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # one row a partition
        before.append((r["part"], total))
        total += r["n"]
    starts = spark.sparkContext.broadcast(dict(before))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        dtype = encoder(path).dtype
        for b in batches:
            cols: list[list] = [[] for _ in range(8)]
            kind = b.column("doc_id").type
            for doc, part, start, n, ids in zip(*(b.column(c).to_pylist() for c in ("doc_id", "part", "start", "n", "ids")), strict=True):
                tokens = np.frombuffer(ids, dtype).astype("<u4")
                at, own = starts.value[part] + start, 0
                while own < n:
                    seq, offset = divmod(at + own, length)
                    size = min(n - own, length - offset)
                    piece = tokens[own : own + size].tobytes()
                    for c, v in zip(cols, (doc, own, size, zlib.crc32(piece), n, seq, offset, piece), strict=True):
                        c.append(v)
                    own += size
                if len(cols[0]) >= 4096:
                    yield batch(cols, kind)
                    cols = [[] for _ in range(8)]
            yield batch(cols, kind)

    def batch(cols: list[list], kind: pa.DataType) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, kind if not i else pa.int64()) for i, c in enumerate(cols[:7])] + [pa.array(cols[7], pa.binary())], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"])

    return rows.mapInArrow(cut, f"doc_id {_kind(docs)}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")

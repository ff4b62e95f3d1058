"""Posting lists as tables of bounded blocks.

A term's postings are cut into rows of at most BLOCK, best first: a block holds postings that count alike, and the
smallest `ratio` among them bounds what any of them adds to a score. Within a block documents ascend and are kept as
differences to the first, beside their frequencies and their documents' lengths, so that BM25+ needs no other table.

Blocks lie in parts, which are ranges of terms of about equal numbers of postings; a term of more postings than a part
holds gets several parts, dealt by document. So neither a row nor a task grows with a term.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.sources.scratch import materialize, parallelism

#: Parameters of BM25+; postings of a block, and of a part.
K1, B = 2.0, 0.75
BLOCK, ROWS = 128, 1_000_000
#: Documents that stay together where a term's postings are dealt over parts.
NEAR = 4096
COLUMNS = ("term", "part", "block", "n", "ratio", "first", "docs", "tfs", "lengths")


def ratio(avgdl: float, tf: str = "tf", length: str = "length") -> Column:
    """What a posting's frequency stands against: it adds idf (K1 + 1) / (1 + ratio / query weight) to a score."""
    return F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col(length) / F.lit(avgdl or 1.0)) / F.col(tf)


def ranged(vocab: DataFrame) -> DataFrame:
    """The vocabulary written by ranges of terms, `at`, in byte order."""
    return materialize(vocab.select("term", "df").repartitionByRange("term").sortWithinPartitions("term").withColumn("at", F.spark_partition_id()), "ranged")


def offsets(ranges: DataFrame) -> DataFrame:
    """(term, df, before): the postings that stand before each term's, terms in byte order.

    A prefix sum without one task for all: range partitions are summed, the few sums accumulated, and each partition
    adds what stands before it.
    """
    sums = ranges.groupBy("at").agg(F.sum("df").alias("n"))  # one row a partition
    earlier = sums.withColumn("earlier", F.coalesce(F.sum("n").over(Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    own = F.coalesce(F.sum("df").over(Window.partitionBy("at").orderBy("term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranges.withColumn("own", own).join(F.broadcast(earlier), "at").select("term", "df", (F.col("earlier") + F.col("own")).alias("before"))


def part_size(vocab: DataFrame, rows: int = ROWS) -> tuple[int, int]:
    """(postings of a part, parts): of `rows` postings at most, and enough parts for all tasks to have work."""
    total = vocab.agg(F.sum("df")).first()[0] or 0
    size = max(1, min(rows, -(-total // parallelism(vocab.sparkSession))))
    return size, total // size + 1


def placed(ranges: DataFrame, size: int) -> DataFrame:
    """(term, df, part, cuts) of a vocabulary in ranges: each term's first part, and how many it has."""
    return offsets(ranges).select("term", "df", F.floor(F.col("before") / size).cast("int").alias("part"), F.ceil(F.col("df") / size).cast("int").alias("cuts"))


def splitters(places: DataFrame) -> DataFrame:
    """(term, part, cuts): the first term of each part, and every term of several parts. Kept with an index, they place
    the terms of later builds."""
    first = F.row_number().over(Window.partitionBy("part").orderBy("term")) == 1
    return places.withColumn("first", first).where("first or cuts > 1").select("term", "part", "cuts")


def placed_by(vocab: DataFrame, marks: DataFrame) -> DataFrame:
    """(term, df, part, cuts) of terms among kept splitters: the part of the last one that is not after the term.

    Terms and splitters lie in ranges; each range begins with the last splitter of the ranges before it, of which only
    one row a range is carried on in one place.
    """
    both = vocab.select("term", "df", F.lit(None).cast("struct<part int,cuts int>").alias("mark")).union(marks.select("term", F.lit(None).cast("long"), F.struct("part", "cuts")))
    both = materialize(both.repartitionByRange("term").withColumn("at", F.spark_partition_id()), "ranged")
    until = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    last = both.groupBy("at").agg(F.max(F.when(F.col("mark").isNotNull(), F.struct("term", "mark"))).alias("top"))
    carried = last.select("at", F.last("top", ignorenulls=True).over(until).alias("carried"))
    # a splitter stands before the same term of the vocabulary
    within = Window.partitionBy("at").orderBy("term", F.col("mark").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    own = F.last(F.when(F.col("mark").isNotNull(), F.struct("term", "mark")), ignorenulls=True).over(within)
    found = both.withColumn("own", own).join(F.broadcast(carried), "at").where("df is not null").withColumn("own", F.coalesce("own", "carried"))
    same, cuts = F.col("own.term") == F.col("term"), F.coalesce(F.col("own.mark.cuts"), F.lit(1))
    part = F.coalesce(F.col("own.mark.part"), F.lit(0))
    return found.select("term", "df", F.when(same, part).otherwise(part + cuts - 1).alias("part"), F.when(same, cuts).otherwise(F.lit(1)).alias("cuts"))


def located(posts: DataFrame, places: DataFrame, tasks: int) -> DataFrame:
    """(term, doc_id, tf, length, part) of postings whose terms have places, a part's postings of a term in one task.

    One shuffle, over `tasks` hashes: of the places only the terms of several parts, no more than there are parts, are
    sent to every task, and the others meet their postings where these are dealt to.
    """
    heavy = F.broadcast(places.where("cuts > 1").select("term", "cuts"))
    share = F.coalesce(F.pmod(F.xxhash64(F.floor(F.col("doc_id") / NEAR)), F.col("cuts")).cast("int"), F.lit(0))
    dealt = posts.join(heavy, "term", "left").select("term", "doc_id", "tf", "length", share.alias("share")).repartition(tasks, "term", "share")
    every = places.select("term", "part", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)).alias("share"))
    return dealt.join(every.hint("shuffle_hash"), ["term", "share"]).select("term", "doc_id", "tf", "length", (F.col("part") + F.col("share")).alias("part"))


def _cut(rows: pa.Table, block: int) -> pa.RecordBatch:
    """The blocks of whole terms: of each, best first, and within a block documents ascend."""
    term = rows.column("term").combine_chunks().dictionary_encode()
    term = term.combine_chunks() if isinstance(term, pa.ChunkedArray) else term
    code, part, least, doc, tf, length = term.indices.to_numpy(), *(rows.column(c).to_numpy() for c in ("part", "ratio", "doc_id", "tf", "length"))
    order = np.lexsort((doc, least, part, code))
    code, part = code[order], part[order]
    new = np.ones(len(rows), bool)
    new[1:] = (code[1:] != code[:-1]) | (part[1:] != part[:-1])
    place = np.arange(len(rows)) - np.flatnonzero(new)[np.cumsum(new) - 1]
    at = np.flatnonzero(place % block == 0)
    n = np.diff([*at, len(rows)])
    best = least[order[at]]
    order = order[np.lexsort((doc[order], np.repeat(np.arange(len(at)), n)))]
    doc, offsets = doc[order], pa.array([*at, len(rows)], pa.int32())
    heads = [term.dictionary.take(pa.array(code[at])), pa.array(part[at], pa.int32()), pa.array(place[at] // block, pa.int32()), pa.array(n, pa.int32()), pa.array(best), pa.array(doc[at])]
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (doc - np.repeat(doc[at], n), tf[order], length[order])]
    return pa.RecordBatch.from_arrays([*heads, *lists], list(COLUMNS))


def blocked(rows: DataFrame, avgdl: float, block: int = BLOCK) -> DataFrame:
    """Blocks of (term, doc_id, tf, length, part), a part's postings of a term in one task.

    Spark sorts the rows by a hash of the term alone; a task then holds one batch and the rows of one hash, which are a
    term's in the parts of the task, and orders these itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            key = b.column("key").to_numpy()
            if held and held[-1].column("key")[-1].as_py() != key[0] or key[0] != key[-1]:
                last = int(np.flatnonzero(key != key[-1])[-1]) + 1 if key[0] != key[-1] else 0
                whole = pa.Table.from_batches([*held, b.slice(0, last)])
                yield _cut(whole, block)
                held, b = [], b.slice(last)
            held.append(b)
        if held:
            yield _cut(pa.Table.from_batches(held), block)

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    schema = f"term string, part int, block int, n int, ratio double, first {kinds['doc_id']}, docs array<{kinds['doc_id']}>, tfs array<{kinds['tf']}>, lengths array<{kinds['length']}>"
    near = rows.withColumns({"ratio": ratio(avgdl), "key": F.xxhash64("term")}).sortWithinPartitions("key")
    return near.mapInArrow(run, schema)


def gathered(found: DataFrame, parts: int) -> DataFrame:
    """Blocks in their parts, in the order of terms: one shuffle of whole blocks."""
    return ordered(found.repartitionById(parts, "part"))


def ordered(found: DataFrame) -> DataFrame:
    return found.sortWithinPartitions("part", "term", "block")


def unrolled(blocks: DataFrame, *more: str) -> DataFrame:
    """(term, doc_id, tf, length), a row a posting, and further columns of its block. Filters on terms reach the scan."""
    zipped = F.arrays_zip("docs", "tfs", "lengths")
    rows = blocks.select("term", "first", *more, F.explode(zipped).alias("p"))
    return rows.select("term", (F.col("first") + F.col("p.docs")).alias("doc_id"), F.col("p.tfs").alias("tf"), F.col("p.lengths").alias("length"), *more)

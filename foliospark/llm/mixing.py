"""Mixing sources to target weights, in DataFrame functions alone.

Words are counted once and written with the row's source and a hash; token totals of the sources, one row each, give
repetition rates; each document is then taken floor(rate) times, and once more if its hash is below the fraction.
Documents of a large source are summed before the shuffle, and rates meet documents in a join whose way Spark chooses by
the size of the rates, so no source's size and no number of sources falls to one task.

Defined results: a null text has no words; sources go by code point, the null source last; equal rows fare alike; an
empty table gives an empty mix; columns of the documents other than doc_id, text and source are carried by `mix`
unchanged, also those named as columns made here; texts of any length are counted whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.shared import materialize, temporary

SPACE = "\x20\x09-\x0D"
#: Hexadecimal digits of a document's hash that make its number in [0, 1): 52 bits, which a double holds exactly.
DIGITS = 13


def words(text: Column) -> Column:
    """The number of runs of anything but blanks; a run becomes one letter, so that no array of words is made."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), f"^[{SPACE}]++", "")
    return F.length(F.regexp_replace(bare, f"[^{SPACE}]++[{SPACE}]*+", "x")).cast("long")


def draw(seed: int) -> Column:
    """A number in [0, 1) from doc_id and text, the same in every run."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit("|"), F.coalesce("text", F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, DIGITS), 16, 10).cast("double") / float(16**DIGITS)


def sized(docs: DataFrame, seed: int = 0) -> DataFrame:
    """(doc_id, source, size, draw)."""
    return docs.select("doc_id", "source", words(F.col("text")).alias("size"), draw(seed).alias("draw"))


def weighed(sources: DataFrame, weights: Sequence[float]) -> DataFrame:
    """Sources with `weight`: the weights in turn, by code point, null last.

    Places are prefix sums over range partitions, of which one number each is summed in one place.
    """
    order = [F.col("source").isNull(), F.col("source")]
    ranged = sources.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumns({"part": F.spark_partition_id(), "at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "sources")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    turn = F.pmod(F.col("first") + F.col("at"), F.lit(len(weights))).cast("int")
    return ranged.join(F.broadcast(first), "part").withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)).drop("part", "at", "first")


def targets(sources: DataFrame, share: float, most: float) -> DataFrame:
    """Weighed sources with `target`: their parts of share times all words, none above most times its own.

    Every round gives what is left, by weight, to the sources that have not reached their bound; those that then would
    stop at it. Two numbers a round reach the driver. The level never falls, so a source that stops stays stopped.
    """
    bound = F.col("source_size") * most
    whole = share * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, before = 0.0, -1
    while True:
        stopped = bound <= F.col("weight") * level
        n, kept, open_weight = sources.agg(F.count_if(stopped), F.sum(F.when(stopped, bound)), F.sum(F.when(~stopped, F.col("weight")))).first()
        left = whole - (kept or 0.0)
        if n == before or not open_weight:
            return sources.withColumn("target", F.when(stopped, bound).otherwise(F.lit(left) * F.col("weight") / F.lit(open_weight or 1.0)))
        level, before = left / open_weight, n


def rates(rows: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """(source, source_size, weight, target, rate) of rows (source, size); the rate of a source without words is 0."""
    if share > most:
        raise ValueError("more words asked for than the sources may give")
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    found = targets(weighed(sums, weights), share, most)
    return found.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))


def times() -> Column:
    """How often a row with `rate` and `draw` is taken."""
    return (F.floor("rate") + F.when(F.col("draw") < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("long")


def _planned(docs: DataFrame, weights: Sequence[float], share: float, most: float, seed: int) -> tuple[DataFrame, DataFrame]:
    with temporary(docs.sparkSession) as keep:
        rows = keep(materialize(sized(docs, seed), "sizes"))
        return rows, keep(materialize(rates(rows, weights, share, most), "rates"))


def plan(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """For each document: doc_id, source, size, source_size, target, copies, taken (words taken, repeats counted)."""
    rows, rated = _planned(docs, weights, share, most, seed)
    met = rows.join(rated.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).withColumn("copies", times())
    return met.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0, seed: int = 0) -> DataFrame:
    """The mix: every column of the documents as it is, each row as often as it is taken."""
    _, rated = _planned(docs, weights, share, most, seed)
    whole = docs.select("source", "doc_id", "text", F.struct("*").alias("d")).withColumn("draw", draw(seed))
    met = whole.join(rated.select(F.col("source").alias("of"), "rate"), F.col("source").eqNullSafe(F.col("of")))
    return met.select("d", F.explode(F.array_repeat(F.lit(0), times().cast("int")))).select("d.*")

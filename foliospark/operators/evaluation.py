"""Effectiveness of rankings against judgements, all queries in one plan."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.scalars import NAN, finite, ratio


def judged(results: DataFrame, judgements: DataFrame) -> DataFrame:
    """The judged results of each query, ranked among themselves: place, relevant (0 or 1), found so far."""
    both = results.join(judgements.select("query_id", "doc_id", (F.col("relevance") == 1).cast("int").alias("relevant")), ["query_id", "doc_id"])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = both.withColumn("place", F.row_number().over(w))
    return ranked.withColumn("found", F.sum("relevant").over(w.rowsBetween(Window.unboundedPreceding, 0)))


def metrics(results: DataFrame, judgements: DataFrame) -> DataFrame:
    """(query_id, relevant, avep, ndcg) of every judged query; NaN where nothing is relevant, 0 where nothing is found."""
    total = judgements.groupBy("query_id").agg(F.sum((F.col("relevance") == 1).cast("long")).alias("relevant"))
    hits = judged(results, judgements).where("relevant = 1")
    sums = hits.groupBy("query_id").agg(F.sum(F.col("found") / F.col("place")).alias("precision"), F.sum(F.lit(math.log(2)) / F.log(F.col("place") + 1.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.col("relevant"), F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.lit(math.log(2)) / F.log(i + 1.0))
    rows = total.join(sums, "query_id", "left").fillna(0.0, ["precision", "dcg"])
    return rows.select("query_id", "relevant", ratio(F.col("precision"), F.col("relevant").cast("double")).alias("avep"), F.when(F.col("relevant") == 0, F.lit(NAN)).otherwise(F.col("dcg") / ideal).alias("ndcg"))


def summary(per_query: DataFrame, columns: tuple[str, ...] = ("avep", "ndcg")) -> DataFrame:
    """One row for each column: metric, average, least, most over its finite values; NaN where there is none."""
    rows = per_query.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in columns])).alias("r")).select("r.metric", "r.value")
    value = F.when(finite(F.col("value")), F.col("value"))
    out = rows.groupBy("metric").agg(F.avg(value).alias("average"), F.min(value).alias("least"), F.max(value).alias("most"))
    return out.select("metric", *[F.coalesce(c, F.lit(NAN)).alias(c) for c in ("average", "least", "most")])


def timing(times: DataFrame) -> DataFrame:
    """One row from (query, ns, results): total and mean time, time for each million results (or all, if fewer), the
    quickest and the slowest query. Divisions of times are of whole numbers, as sums of nanoseconds are."""
    out = times.agg(F.sum("ns").alias("total"), F.count("*").alias("n"), F.sum("results").alias("results"), F.min_by("query", F.struct("ns", "query")).alias("quickest"), F.max_by("query", F.struct("ns", "query")).alias("slowest"), F.min("ns").alias("least"), F.max("ns").alias("most"))
    rate = F.least(F.col("results"), F.lit(1_000_000))
    return out.select("total", F.expr("total div n").alias("mean"), rate.alias("rate"), F.when(F.col("results") == 0, F.col("total")).otherwise(F.expr("total div results") * rate).alias("per_rate"), "quickest", "least", "slowest", "most")

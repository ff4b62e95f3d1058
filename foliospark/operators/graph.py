"""Citation graphs: edges, PageRank, degree and consistency statistics.

Lists are rows (id, pos, other): the pos-th entry of a document's in or out list. Lists keep repeats and loops.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.sources.scratch import Bucketed, materialize, parallelism, scope

#: Links of a source from which on they may be dealt evenly.
HUB = 10_000


def entries(docs: DataFrame, column: str) -> DataFrame:
    """(id, pos, other) of a list column."""
    return docs.select("id", F.posexplode(column).alias("pos", "other"))


def edges(out: DataFrame, nodes: DataFrame) -> DataFrame:
    """(src, dst): entries that lead to another node, once each."""
    known = out.join(nodes.select(F.col("id").alias("other")), "other", "left_semi").join(nodes.select("id"), "id", "left_semi")
    return known.where("id <> other").select(F.col("id").alias("src"), F.col("other").alias("dst")).distinct()


def pagerank(nodes: DataFrame, links: DataFrame, damping: float = 0.85, threshold: float = 1e-8, iterations: int | None = None, out_degree: DataFrame | None = None, hub: int = HUB) -> DataFrame:
    """(id, pagerank): all start at 1 / N; sinks give to everyone alike; ends when no score moves by more than threshold.

    With `iterations`, exactly so many rounds. Links are bucketed by source and scores by node once, so a round
    shuffles nothing but the sums of what links give. The links of hubs, sources of more than `hub` links or their part
    of all, are dealt evenly instead, and the hubs' shares are sent to them: there are four hubs a bucket at most. A
    round writes one number for each node and deletes the round before, so lineage and disk don't grow and no round is
    lost with an executor. The sinks' sum and the largest move, two numbers a round, are observed as it is written.

    A node's out-degree is the number of its links, or that in `out_degree` (id, degree), where links come from in
    lists and degrees from out lists; a link from a node without any is refused then, since its share has no bound.
    """
    n = nodes.count()
    if not n:
        return nodes.select("id", F.lit(0.0).alias("pagerank"))
    spark = nodes.sparkSession
    with scope(spark) as mine:
        buckets = parallelism(spark)
        fan = materialize(links.groupBy("src").agg(F.count("*").alias("degree")), "degrees")
        if out_degree is None:
            degree = fan
        else:
            degree = out_degree.where("degree > 0").select(F.col("id").alias("src"), "degree")
            if not fan.join(degree, "src", "left_anti").isEmpty():
                raise ValueError("a link from a node without out-degree")
        own = nodes.select("id").join(degree.withColumnRenamed("src", "id"), "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
        whole, widest = fan.agg(F.coalesce(F.sum("degree"), F.lit(0)), F.coalesce(F.max("degree"), F.lit(0))).first()
        limit = max(hub, -(-whole // (4 * buckets)))
        hubs = fan.where(F.col("degree") > limit).select("src") if widest > limit else None
        few = links.select("src", "dst")
        if hubs is not None:
            few = few.join(F.broadcast(hubs), "src", "left_anti")
            many = materialize(links.select("src", "dst").join(F.broadcast(hubs), "src", "left_semi").repartition(buckets), "hubs")
        edges = Bucketed(few, "src", buckets)
        sinks = F.coalesce(F.sum(F.when(F.col("degree") == 0, F.col("pagerank"))), F.lit(0.0)).alias("sink")
        told = Observation()
        scores = Bucketed(own.select("id", "degree", F.lit(1.0 / n).alias("pagerank"), F.lit(0.0).alias("moved")), "id", buckets, (told, sinks))
        done = 0
        while True:
            sink, moved = told.get["sink"], told.get.get("moved")
            if done == iterations or iterations is None and done and moved <= threshold:
                return mine.keep(materialize(scores.read().select("id", "pagerank"), "pagerank"))
            shares = scores.read().where("degree > 0").select(F.col("id").alias("src"), (F.col("pagerank") / F.col("degree")).alias("share"))
            given = edges.read().join(shares, "src").select(F.col("dst").alias("id"), "share")
            if hubs is not None:
                sent = shares.join(F.broadcast(hubs), "src", "left_semi")
                given = given.union(many.join(F.broadcast(sent), "src").select("dst", "share"))
            given = given.groupBy("id").agg(F.sum("share").alias("given"))
            score = F.lit(damping) * (F.lit(sink / n) + F.coalesce("given", F.lit(0.0))) + F.lit((1.0 - damping) / n)
            moves = scores.read().join(given, "id", "left").select("id", "degree", score.alias("pagerank"), F.abs(score - F.col("pagerank")).alias("moved"))
            told, before = Observation(), scores
            scores = Bucketed(moves, "id", buckets, (told, sinks, F.max("moved").alias("moved")))
            before.drop()
            done += 1


def save(out: DataFrame, inn: DataFrame, nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Write a citation graph: both lists by node, the nodes, and their number."""
    for name, lists in (("out", out), ("in", inn)):
        lists.select("id", "pos", "other").repartition("id").sortWithinPartitions("id", "pos").write.mode(mode).parquet(f"{path}/{name}")
    nodes.select("id").write.mode(mode).parquet(f"{path}/nodes")
    nodes.agg(F.count("*").alias("documents")).write.mode(mode).json(f"{path}/graph_meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Out lists, in lists and nodes of a saved graph; one whose number of nodes isn't the saved one is refused."""
    out, inn, nodes = (spark.read.parquet(f"{path}/{t}") for t in ("out", "in", "nodes"))
    said = spark.read.schema("documents long").json(f"{path}/graph_meta").first()["documents"]
    if nodes.count() != said:
        raise ValueError(f"{path} doesn't hold {said} nodes")
    return out, inn, nodes


def _flagged(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries within the graph: loop, and repeat (a target seen before in the list, loops aside)."""
    known = lists.join(nodes.select(F.col("id").alias("other")), "other", "left_semi")
    w = Window.partitionBy("id", "other").orderBy("pos")
    return known.withColumn("loop", F.col("id") == F.col("other")).withColumn("repeat", ~F.col("loop") & (F.row_number().over(w) > 1))


def degrees(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, raw, true, loops, repeats) of every node; true leaves loops and repeats out."""
    sums = _flagged(lists, nodes).groupBy("id").agg(F.count("*").alias("raw"), F.sum(F.col("loop").cast("long")).alias("loops"), F.sum(F.col("repeat").cast("long")).alias("repeats"))
    rows = nodes.select("id").join(sums, "id", "left").fillna(0, ["raw", "loops", "repeats"])
    return rows.select("id", "raw", (F.col("raw") - F.col("loops") - F.col("repeats")).alias("true"), "loops", "repeats")


def histogram(degree: DataFrame, column: str) -> DataFrame:
    """(degree, documents), degrees ascending."""
    return degree.groupBy(F.col(column).alias("degree")).agg(F.count("*").alias("documents")).orderBy("degree")


def inconsistent(lists: DataFrame, reverse: DataFrame, nodes: DataFrame) -> DataFrame:
    """Entries whose reverse is missing from the other side's lists, every occurrence."""
    known = _flagged(lists, nodes).select("id", "other")
    return known.join(reverse.select(F.col("other").alias("id"), F.col("id").alias("other")), ["id", "other"], "left_anti")


def _beside(*rows: DataFrame) -> DataFrame:
    """Tables of one row as one row."""
    out = rows[0].withColumn("_one", F.lit(1))
    for r in rows[1:]:
        out = out.join(r.withColumn("_one", F.lit(1)), "_one")
    return out.drop("_one")


def edge_stats(out: DataFrame, inn: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row of the 17 counters of a graph given by out and in lists."""
    o, i = degrees(out, nodes), degrees(inn, nodes)
    both = o.select("id", *[F.col(c).alias(f"o_{c}") for c in ("raw", "true", "loops", "repeats")]).join(i.select("id", *[F.col(c).alias(f"i_{c}") for c in ("raw", "true", "loops", "repeats")]), "id")

    def some(c: str):
        return F.sum((F.col(c) > 0).cast("long"))

    out_rows = both.agg(
        F.count("*").alias("documents"), F.sum((F.col("o_raw") == 0).cast("long")).alias("sinks"), F.sum((F.col("o_true") == 0).cast("long")).alias("sinks_true"),
        F.sum("i_true").alias("in_edges_true"), F.sum("i_raw").alias("in_edges"), F.sum("o_true").alias("out_edges_true"), F.sum("o_raw").alias("out_edges"),
        F.sum("i_repeats").alias("duplicate_in_edges"), some("i_repeats").alias("docs_duplicate_in"), F.sum("o_repeats").alias("duplicate_out_edges"), some("o_repeats").alias("docs_duplicate_out"),
        some("i_loops").alias("docs_self_in"), F.sum("i_loops").alias("self_in_edges"), some("o_loops").alias("docs_self_out"), F.sum("o_loops").alias("self_out_edges"),
    )
    in_missing = inconsistent(out, inn, nodes).agg(F.count("*").alias("inconsistent_in_edges"))
    out_missing = inconsistent(inn, out, nodes).agg(F.count("*").alias("inconsistent_out_edges"))
    return _beside(out_rows, in_missing, out_missing)


def not_found(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, missing): each node's distinct entries outside the graph, 0 included."""
    strange = lists.join(nodes.select("id"), "id", "left_semi").join(nodes.select(F.col("id").alias("other")), "other", "left_anti").select("id", "other").distinct()
    return nodes.select("id").join(strange.groupBy("id").agg(F.count("*").alias("missing")), "id", "left").fillna(0, ["missing"])


def not_found_stats(out: DataFrame, inn: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: documents, total and unique entries outside the graph of in and out lists."""
    rows = [nodes.agg(F.count("*").alias("documents"))]
    for name, lists in (("in", inn), ("out", out)):
        strange = lists.join(nodes.select("id"), "id", "left_semi").join(nodes.select(F.col("id").alias("other")), "other", "left_anti").select("id", "other").distinct()
        rows.append(strange.agg(F.count("*").alias(f"total_{name}"), F.count_distinct("other").alias(f"unique_{name}")))
    return _beside(*rows)


def adjacency(lists: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, line): every node's entries within the graph in list order, between spaces."""
    known = lists.join(nodes.select(F.col("id").alias("other")), "other", "left_semi").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "other"))).alias("l"))
    return nodes.select("id").join(known, "id", "left").select("id", F.coalesce(F.array_join(F.transform("l", lambda x: x["other"].cast("string")), " "), F.lit("")).alias("line"))

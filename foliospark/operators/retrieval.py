"""Ranked retrieval for many queries at once.

Query terms are rows (query_id, pos, term, weight). They are read once: up to SMALL of them become a local table with
their document frequencies, which Spark broadcasts, and whose words reach the scans as literals; more stay a
distributed table, and joins are planned by the sizes met at run time. No step collects a posting list: scores are
partial and final hash aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from foliospark.functions.scalars import finite, ratio
from foliospark.operators import blocks
from foliospark.operators.blocks import K1, B
from foliospark.operators.index import Index
from foliospark.sources.scratch import discard, materialize, parallelism

#: Query terms up to this number are sent to every task; and words up to this number are pushed to the scans.
SMALL, LITERALS = 50_000, 512
#: Queries whose terms have fewer postings are scored in one go, without bounds.
FEW = 1_000_000
#: Terms of sums by query and document that a task adds up.
SUMS = 2_000_000


def merge_terms(query: DataFrame) -> DataFrame:
    """(query_id, term, weight, pos): repeats of a term are one, of summed weight, at the first's place."""
    return query.groupBy("query_id", "term").agg(F.sum("weight").alias("weight"), F.min("pos").alias("pos"))


@dataclass(frozen=True)
class Terms:
    """Merged query terms with df; `few`: no more than SMALL, so that nothing with a row a query is large either."""

    frame: DataFrame
    few: bool
    words: tuple[str, ...] | None = None
    rows: tuple[Row, ...] = ()  # those of the frame, where they are few

    def sent(self, df: DataFrame) -> DataFrame:
        """df, of no more rows than there are query terms, marked for broadcast if these are few."""
        return F.broadcast(df) if self.few else df

    def narrow(self, table: DataFrame) -> DataFrame:
        """The rows of the queries' words, where their number allows literals; by the join alone else."""
        return table if self.words is None else table.where(F.col("term").isin(list(self.words)))


def resolve(query: DataFrame | Terms, index: Index) -> Terms:
    """Query terms with df, 0 where the index lacks the term. Reads the query table once."""
    if isinstance(query, Terms):
        return query
    merged, spark = merge_terms(query), query.sparkSession
    rows = merged.limit(SMALL + 1).toArrow()
    few = rows.num_rows <= SMALL
    if few:
        merged = spark.createDataFrame(rows)
    words = set(rows.column("term").to_pylist()) - {None} if few else ()
    words = tuple(sorted(words)) if few and len(words) <= LITERALS else None
    own = Terms(merged, few, words)
    found = merged.join(own.narrow(index.vocabulary), "term", "left").withColumn("df", F.coalesce("df", F.lit(0).cast("long")))
    if not few:
        return Terms(found, False, words)
    told = found.toArrow()
    return Terms(spark.createDataFrame(told), True, words, tuple(Row(**r) for r in told.to_pylist()))


def term_frequencies(query: DataFrame, index: Index) -> DataFrame:
    """Merged query terms with df, 0 where the index lacks the term."""
    return resolve(query, index).frame


def lookup(index: Index, words: Iterable[str]) -> DataFrame:
    """Postings of some terms, pushed down to the scan."""
    return index.postings.where(F.col("term").isin(list(words)))


def _matched(q: Terms, index: Index) -> DataFrame:
    """Postings of the query terms, with these and their documents' lengths.

    Where the terms are few, the postings of their words are dealt by document once, and meet the queries there: sums by
    query and document need no shuffle then, however many queries share a word.
    """
    asked = q.frame.drop("ratio", "deep")
    if not q.few:
        return blocks.unrolled(q.narrow(index.blocks)).join(asked, "term")
    return _dealt(blocks.unrolled(_wanted(q, index)), sum(r["df"] for r in q.rows)).join(F.broadcast(asked), "term")


def _wanted(q: Terms, index: Index) -> DataFrame:
    """The blocks of the words of a few queries."""
    if q.words is not None:
        return q.narrow(index.blocks)
    return index.blocks.join(F.broadcast(q.frame.select("term").distinct()), "term", "left_semi")


def _dealt(posts: DataFrame, sums: int) -> DataFrame:
    """Postings by document, in as many tasks as their sums ask for."""
    return posts.repartition(max(parallelism(posts.sparkSession), sums // SUMS), "doc_id")


def _part(idf: Column, index: Index) -> Column:
    """What a posting adds to a BM25+ score."""
    f = F.col("tf") * F.col("weight")
    length = F.lit(K1) * (F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(index.avgdl or 1.0))
    return idf * (f * (K1 + 1) / (f + length))


def existential(query: DataFrame | Terms, index: Index) -> DataFrame:
    """(query_id, doc_id, score 1.0) for documents with any of a query's terms."""
    return _matched(resolve(query, index), index).select("query_id", "doc_id").distinct().withColumn("score", F.lit(1.0))


def bm25p(query: DataFrame | Terms, index: Index) -> DataFrame:
    """BM25+ scores before they are normalised.

    idf = ln(N / (1 + df)) may be negative. Every query term adds its idf to every match, also terms that the document
    or the whole index lacks, so each query has a constant besides the sum over its postings.
    """
    q = resolve(query, index)
    sums = _matched(q, index).groupBy("query_id", "doc_id").agg(F.sum(_part(_idf(index), index)).alias("part"))
    return _with_constant(sums, q, index)


def _idf(index: Index) -> Column:
    return F.log(F.lit(float(index.documents)) / (F.lit(1.0) + F.col("df")))


def _with_constant(sums: DataFrame, q: Terms, index: Index) -> DataFrame:
    constant = q.frame.groupBy("query_id").agg(F.sum(_idf(index)).alias("constant"))
    return sums.join(q.sent(constant), "query_id").select("query_id", "doc_id", (F.col("part") + F.col("constant")).alias("score"))


@dataclass(frozen=True)
class Bound:
    """A term of a query: gain, the bound of what it adds; most, what its best posting may add."""

    query_id: object
    term: str
    weight: float
    df: int
    deep: int
    gain: float
    most: float


def _bounds(q: Terms, index: Index) -> list[Bound]:
    found = []
    for r in q.rows:
        if r["df"]:
            gain = math.log(index.documents / (1 + r["df"])) * (K1 + 1)
            found.append(Bound(r["query_id"], r["term"], r["weight"], r["df"], r["deep"], gain, max(gain, 0.0) / (1 + r["ratio"] / r["weight"])))
    return found


def _blocks_of(index: Index, q: Terms, chosen: DataFrame, reach: Column) -> DataFrame:
    """Postings of the query terms in the chosen blocks only; their other lists are not unrolled."""
    met = q.narrow(index.blocks).join(F.broadcast(chosen), "term").where(reach)
    return blocks.unrolled(met, "query_id", "weight", "df")


def reach(bounds: list[Bound], thresholds: dict) -> list[tuple]:
    """(query_id, term, weight, df, cut): the blocks of a ratio up to the cut can hold a document of a query's best.

    A posting of a document that reaches the threshold lies in a block whose bound and the other terms' most do. So a
    document that has a posting in a block left out does not reach it, and what is missing only makes its sum smaller.
    Terms that lower a score are read whole.
    """
    most: dict = {}
    for b in bounds:
        most[b.query_id] = most.get(b.query_id, 0.0) + b.most
    rows = []
    for b in bounds:
        need = thresholds.get(b.query_id, -math.inf) - (most[b.query_id] - b.most)
        cut = math.inf if b.gain <= 0 or need <= 0 else b.weight * (b.gain / need - 1)
        if cut >= 0:
            rows.append((b.query_id, b.term, b.weight, b.df, cut))
    return rows


CHOSEN = "term string, weight double, df long"


def _local(q: Terms, rows: list[tuple], column: str) -> DataFrame:
    kind = q.frame.schema["query_id"].dataType.simpleString()
    return q.frame.sparkSession.createDataFrame(rows, f"query_id {kind}, {CHOSEN}, {column}")


def bounded(query: DataFrame | Terms, index: Index, k: int, slack: float = 1e-7) -> DataFrame:
    """BM25+ scores, before they are normalised, that hold the best k of every query exactly, and others or parts of them.

    First the best blocks of each term, so many that the lists of two terms should share k documents several times over;
    the k-th sum there is a threshold for the query. Then the blocks that can reach it. One number a query reaches the
    driver in between, and only where the queries' terms are few.
    """
    q = resolve(query, index)
    bounds = _bounds(q, index) if q.few else []
    if not q.few or any(b.weight <= 0 for b in bounds):
        return bm25p(q, index)
    seeds = math.sqrt(16 * k * max(index.documents, 1))
    depth = [(b.query_id, b.term, b.weight, b.df, max(1, math.ceil(b.deep * min(1.0, max(seeds, k) / b.df)))) for b in bounds if b.gain > 0]
    first = _blocks_of(index, q, _local(q, depth, "depth int"), F.col("block") < F.col("depth"))
    sums = top(first.groupBy("query_id", "doc_id").agg(F.sum(_part(_idf(index), index)).alias("score")), k)
    lowers: dict = {}
    for b in bounds:
        lowers[b.query_id] = lowers.get(b.query_id, 0.0) + min(b.gain, 0.0)
    told = sums.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") == k).collect()
    thresholds = {r["query_id"]: r["least"] + lowers[r["query_id"]] - slack * (1 + abs(r["least"])) for r in told}
    rows = reach(bounds, thresholds)
    chosen = _local(q, rows, "cut double")
    widest = F.broadcast(chosen.groupBy("term").agg(F.max("cut").alias("cut")))
    held = q.narrow(index.blocks).join(widest, "term").where("ratio <= cut")
    df = {(b.query_id, b.term): b.df for b in bounds}
    dealt = _dealt(blocks.unrolled(held, "ratio"), sum(df[r[0], r[1]] for r in rows))
    found = dealt.join(F.broadcast(chosen), "term").where("ratio <= cut")
    sums = found.groupBy("query_id", "doc_id").agg(F.sum(_part(_idf(index), index)).alias("part"))
    return _with_constant(sums, q, index)


def vsm(query: DataFrame | Terms, index: Index) -> DataFrame:
    """Vector space scores before they are normalised; NaN where a norm is 0.

    The query side weighs w / max w by ln(N / (1 + df)), and the query weight counts on the document side again.
    """
    q, n = resolve(query, index), float(index.documents)
    idf = F.log(F.lit(n) / (F.lit(1.0) + F.col("df")))
    vector = q.frame.select("query_id", "term", (F.col("weight") / F.max("weight").over(Window.partitionBy("query_id")) * idf).alias("qw"))
    norm = vector.groupBy("query_id").agg(F.sqrt(F.sum(F.col("qw") * F.col("qw"))).alias("norm"))
    stats = index.doc_stats.select("doc_id", "max_tf", "vsm_weight")
    sums = _matched(q, index).join(q.sent(vector), ["query_id", "term"]).join(stats, "doc_id")
    part = F.col("qw") * (F.col("tf") * F.col("weight") / F.col("max_tf")) * idf
    sums = sums.groupBy("query_id", "doc_id").agg(F.sum(part).alias("dot"), F.first("vsm_weight").alias("vsm_weight"))
    return sums.join(q.sent(norm), "query_id").select("query_id", "doc_id", ratio(F.col("dot"), F.col("vsm_weight") * F.col("norm")).alias("score"))


MODELS = {"okapi": bm25p, "vsm": vsm, "existential": existential}


def normalised(scores: DataFrame, few: bool = False) -> DataFrame:
    """Scores over their query's largest; the largest starts at 0, ignores NaN, and 0 counts as 1.

    few: the queries are known to be few, so that their largest scores can be sent to every task.
    """
    best = scores.groupBy("query_id").agg(F.greatest(F.max(F.when(finite(F.col("score")), F.col("score"))), F.lit(0.0)).alias("best"))
    best = best.select("query_id", F.when(F.col("best") == 0, 1.0).otherwise(F.col("best")).alias("best"))
    return scores.join(F.broadcast(best) if few else best, "query_id").withColumn("score", F.col("score") / F.col("best")).drop("best")


def blended(scores: DataFrame, index: Index, weight: float, few: bool = False) -> DataFrame:
    """score (1 - w) + pagerank / largest pagerank of the query's matches, times w; weight 0 changes nothing."""
    if not weight:
        return scores
    ranked = scores.join(index.doc_stats.select("doc_id", "pagerank"), "doc_id")
    best = ranked.groupBy("query_id").agg(F.max("pagerank").alias("best"))
    share = ratio(F.col("pagerank"), F.col("best"))
    return ranked.join(F.broadcast(best) if few else best, "query_id").select("query_id", "doc_id", (F.col("score") * (1 - weight) + share * weight).alias("score"))


def top(scores: DataFrame, k: int | None, digits: int | None = None) -> DataFrame:
    """(query_id, doc_id, score, rank): score descending, NaN first, ties by doc_id; k of each query, or all.

    Each task keeps k of a query before the shuffle. With digits, scores are rounded before they are ranked.
    """
    rows = scores if digits is None else scores.withColumn("score", F.round("score", digits))
    if k is None:
        return ranked(rows)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def ranked(scores: DataFrame) -> DataFrame:
    """All results with their ranks, however many a query has: no query is one task.

    Ranges of (query, score, document) are sorted and written with each row's place in its range; a rank is that place,
    less that of the query's first row there, and the query's rows in the ranges before.
    """
    order = [F.col("query_id"), F.desc("score"), F.col("doc_id")]
    whole = materialize(scores, "scores")
    placed = whole.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed = materialize(placed, "ranged")
    discard(whole)
    counts = placed.groupBy("query_id", "_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    earlier = Window.partitionBy("query_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("query_id", "_part", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return placed.join(counts, ["query_id", "_part"]).withColumn("rank", F.col("_at") + F.col("_shift") + 1).drop("_part", "_at", "_shift")


def totals(scores: DataFrame) -> DataFrame:
    """(query_id, total): matches before any limit."""
    return scores.groupBy("query_id").agg(F.count("*").alias("total"))


def scored(query: DataFrame | Terms, index: Index, model: str = "okapi", pagerank_weight: float = 0.0) -> DataFrame:
    """(query_id, doc_id, score) of all matches, not ranked. The existential model scores 1 and ignores PageRank."""
    q = resolve(query, index)
    scores = MODELS[model](q, index)
    return scores if model == "existential" else blended(normalised(scores, q.few), index, pagerank_weight, q.few)


def search(query: DataFrame | Terms, index: Index, model: str = "okapi", k: int | None = None, pagerank_weight: float = 0.0, digits: int | None = None) -> DataFrame:
    """Ranked results of every query. The existential model scores 1, ignores PageRank and returns all matches.

    The best k by BM25+ alone come from the blocks that can hold them, where the queries' terms have many postings.
    """
    q = resolve(query, index)
    if model == "okapi" and k is not None and not pagerank_weight and q.few and sum(r["df"] for r in q.rows) > FEW:
        return top(normalised(bounded(q, index, k), True), k, digits)
    scores = scored(q, index, model, pagerank_weight)
    return top(scores, None) if model == "existential" else top(scores, k, digits)


def with_properties(results: DataFrame, index: Index, properties: Iterable[str]) -> DataFrame:
    """Results with columns of the documents, joined after the limit."""
    return results.join(index.display.select("doc_id", *properties), "doc_id")


def change_properties(results: DataFrame, index: Index, old: Iterable[str], new: Iterable[str]) -> DataFrame:
    """Results that carry the properties `old`, with `new` instead: what both name stays, only what is added is joined."""
    old, new = list(dict.fromkeys(old)), list(dict.fromkeys(new))
    kept = results.drop(*[p for p in old if p not in new])
    added = [p for p in new if p not in old]
    return with_properties(kept, index, added) if added else kept


def in_range(results: DataFrame, start: int, end: int) -> DataFrame:
    """Results from start to end, both counted from 0 and included."""
    return results.where((F.col("rank") - 1 >= max(start, 0)) & (F.col("rank") - 1 <= end))

"""An index as immutable segments: documents are added without reading those before, and segments are merged later.

Every segment places its postings by the splitters kept with the index, so a merge brings the blocks of a range of terms
together in one shuffle, reads no document and no text, and samples nothing.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.operators import blocks, index, versions
from foliospark.operators.index import Index
from foliospark.sources import scratch
from foliospark.sources.scratch import materialize, scope


def written(df: DataFrame, path: str, name: str) -> str:
    """Write a table of the index's folder; its name."""
    at = versions.fresh(name)
    df.write.parquet(f"{path}/{at}")
    return at


def _union(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def save(ix: Index, path: str, mode: str = "errorifexists") -> None:
    """Write an index as one segment, and commit it as the current version."""
    spark = ix.blocks.sparkSession
    before = versions.read(spark, path)
    if before and mode != "overwrite":
        raise FileExistsError(path)
    segment = {"blocks": written(ix.blocks, path, "blocks"), "vocabulary": written(ix.vocabulary, path, "vocabulary"), "avgdl": ix.avgdl}
    version = {"segments": [segment], "splitters": written(ix.splitters, path, "splitters"), "stats": [written(ix.doc_stats, path, "stats")], "display": [written(ix.display, path, "documents")], "documents": ix.documents, "tokens": ix.tokens, "parts": ix.parts, "weighted": True, "use_stemmer": ix.use_stemmer, "stopwords": list(ix.stopwords)}
    versions.commit(spark, path, version)


def _segments(spark: SparkSession, path: str, version: dict, avgdl: float) -> tuple[DataFrame, DataFrame]:
    """Blocks and vocabulary of all segments. A ratio counted with a smaller average length bounds from below too, once
    it is lowered by the averages' quotient."""
    found, words = [], []
    for s in version["segments"]:
        lower = min(1.0, s["avgdl"] / avgdl) if avgdl and s["avgdl"] else 1.0
        found.append(spark.read.parquet(f"{path}/{s['blocks']}").withColumn("ratio", F.col("ratio") * lower) if lower < 1 else spark.read.parquet(f"{path}/{s['blocks']}"))
        words.append(spark.read.parquet(f"{path}/{s['vocabulary']}").withColumn("ratio", F.col("ratio") * lower))
    if len(words) == 1:
        return found[0], words[0]
    return _union(found), _union(words).groupBy("term").agg(F.sum("df").alias("df"), F.min("ratio").alias("ratio"), F.max("deep").alias("deep"))


def _weighted(stats: DataFrame, found: DataFrame, vocab: DataFrame, documents: int) -> DataFrame:
    return stats.drop("vsm_weight").join(index.weights(found, vocab, documents), "doc_id", "left").select(*stats.columns)


def load(spark: SparkSession, path: str) -> Index:
    """Open the current version; nothing but its pointer is read yet. Weights of documents follow the document
    frequencies of all segments: where these were added and not merged, they are computed from the postings when asked for."""
    v = versions.read(spark, path)
    if v is None:
        raise index.IndexNotLoadedError(path)
    avgdl = v["tokens"] / v["documents"] if v["documents"] else 0.0
    found, vocab = _segments(spark, path, v, avgdl)
    stats, display = (_union([spark.read.parquet(f"{path}/{t}") for t in v[k]]) for k in ("stats", "display"))
    if not v["weighted"]:
        stats = _weighted(stats, found, vocab, v["documents"])
    return Index(found, vocab, stats, display, spark.read.parquet(f"{path}/{v['splitters']}"), v["documents"], v["tokens"], v["parts"], v["use_stemmer"], tuple(v["stopwords"]))


def exists(spark: SparkSession, path: str) -> bool:
    return versions.exists(spark, path)


def delete(spark: SparkSession, path: str) -> bool:
    return scratch.delete(spark, path)


def append(spark: SparkSession, path: str, docs: DataFrame, fields: Mapping[str, str], pagerank: DataFrame | None = None) -> None:
    """Add documents, whose doc_ids the index must not have, as a segment of their own, by the index's own settings."""
    v = versions.read(spark, path)
    if v is None:
        raise index.IndexNotLoadedError(path)
    stats = _union([spark.read.parquet(f"{path}/{t}").select("doc_id") for t in v["stats"]])
    twice = docs.select("doc_id").join(stats, "doc_id", "left_semi").first()
    if twice:
        raise ValueError(f"the index has document {twice['doc_id']}")
    with scope(spark):
        ix = index.build(docs, fields, v["stopwords"], v["use_stemmer"], pagerank, splitters=spark.read.parquet(f"{path}/{v['splitters']}"), parts=v["parts"])
        segment = {"blocks": written(ix.blocks, path, "blocks"), "vocabulary": written(ix.vocabulary, path, "vocabulary"), "avgdl": ix.avgdl}
        more = {"stats": [*v["stats"], written(ix.doc_stats, path, "stats")], "display": [*v["display"], written(docs, path, "documents")]}
    versions.commit(spark, path, v | more | {"segments": [*v["segments"], segment], "documents": v["documents"] + ix.documents, "tokens": v["tokens"] + ix.tokens, "weighted": False})


def merge(spark: SparkSession, path: str, rows: int = blocks.ROWS) -> Index:
    """One segment in place of all, by ranges of terms; no document is read. Ranges are cut anew where their parts would
    hold more than `rows` postings. Tables of the version before stay until `versions.vacuum`."""
    v = versions.read(spark, path)
    ix = load(spark, path)
    if len(v["segments"]) == 1 and v["weighted"]:
        return ix
    with scope(spark):
        vocab = materialize(ix.vocabulary, "vocabulary")
        size, parts = blocks.part_size(vocab, rows)
        if size * v["parts"] * 2 < (vocab.agg(F.sum("df")).first()[0] or 0):
            places = materialize(blocks.placed(blocks.ranged(vocab), size), "places")
            held, marks = blocks.located(blocks.unrolled(ix.blocks), places, parts), written(blocks.splitters(places), path, "splitters")
            merged = blocks.gathered(blocks.blocked(held, ix.avgdl), parts)
        else:
            marks, parts = v["splitters"], v["parts"]
            held = ix.blocks.select(*blocks.COLUMNS).repartitionById(parts, "part")  # whole blocks, unrolled where they come together
            merged = blocks.ordered(blocks.blocked(blocks.unrolled(held, "part"), ix.avgdl))
        at = written(merged, path, "blocks")
        found = spark.read.parquet(f"{path}/{at}")
        segment = {"blocks": at, "vocabulary": written(index.with_bounds(vocab, found), path, "vocabulary"), "avgdl": ix.avgdl}
        stats = _union([spark.read.parquet(f"{path}/{t}") for t in v["stats"]])
        stats = written(_weighted(stats, found, vocab, v["documents"]), path, "stats")
    versions.commit(spark, path, v | {"segments": [segment], "splitters": marks, "parts": parts, "stats": [stats], "weighted": True})
    return load(spark, path)


def update_pagerank(spark: SparkSession, path: str, pagerank: DataFrame) -> Index:
    """Put (doc_id, pagerank) into a stored index, 0 for documents that it lacks; nothing else is written anew."""
    v = versions.read(spark, path)
    if v is None:
        raise index.IndexNotLoadedError(path)
    tables = [spark.read.parquet(f"{path}/{t}") for t in v["stats"]]
    stats = written(index.with_pagerank(_union(tables).drop("pagerank"), pagerank), path, "stats")
    versions.commit(spark, path, v | {"stats": [stats]})
    return load(spark, path)

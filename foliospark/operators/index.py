"""The inverted index as tables: postings, vocabulary, document statistics, metadata."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.stems import stemmed
from foliospark.functions.tokens import DELIMITERS, PLAIN, not_stopword, terms, tokens
from foliospark.operators import blocks
from foliospark.sources.scratch import materialize, scope, spread

#: Columns of a corpus document to the delimiter set of each; arrays are split one element at a time.
CORPUS_FIELDS = {"title": "title", "paperAbstract": "abstract", "entities": "entities", "fieldsOfStudy": "plain", "authors": "authors", "year": "plain", "venue": "venue", "journalName": "journal", "sources": "plain"}


class IndexNotLoadedError(RuntimeError):
    """An index was used before it was built or loaded."""


def _splitter(delimiters: str):
    return lambda text: tokens(text, delimiters)


def field_tokens(docs: DataFrame, fields: Mapping[str, str]) -> Column:
    """One array of the tokens of every field, pooled; a year is the token of its digits."""
    parts = []
    for name, kind in fields.items():
        delimiters, c, shape = DELIMITERS.get(kind, PLAIN), F.col(name), docs.schema[name].dataType.simpleString()
        if shape.startswith("array<struct"):
            c = F.transform(c, lambda a: F.coalesce(a["name"], F.lit("")))
        if shape.startswith("array"):
            parts.append(F.flatten(F.transform(F.coalesce(c, F.array().cast("array<string>")), _splitter(delimiters))))
        else:
            parts.append(tokens(c.cast("string"), delimiters))
    return F.concat(*parts)


def token_rows(docs: DataFrame, fields: Mapping[str, str], stopwords: Iterable[str] = (), stemmer: bool = False) -> DataFrame:
    """(doc_id, term), one row a token."""
    rows = docs.select("doc_id", F.explode(field_tokens(docs, fields)).alias("token"))
    return terms(rows, "token", stopwords, stemmer).select("doc_id", "term")


def postings(docs: DataFrame, fields: Mapping[str, str], stopwords: Iterable[str] = (), stemmer: bool = False) -> DataFrame:
    """(term, doc_id, tf). The one shuffle of the build is that of the documents, by doc_id, which are smaller than
    their postings: it deals few large files to all tasks too, and repeats are then summed where they are.

    Stems are looked up for a document's distinct tokens, after they are counted.
    """
    needed = docs.select("doc_id", *fields)
    needed = needed.repartition(spread(needed), "doc_id")
    if not stemmer:
        return token_rows(needed, fields, stopwords).groupBy("term", "doc_id").agg(F.count("*").alias("tf"))
    rows = needed.select("doc_id", F.explode(field_tokens(needed, fields)).alias("token")).where(not_stopword(F.col("token"), stopwords))
    counted = rows.groupBy("doc_id", "token").agg(F.count("*").alias("n"))
    return stemmed(counted, "token", "stem").groupBy(F.lower("stem").alias("term"), "doc_id").agg(F.sum("n").alias("tf"))


def with_length(posts: DataFrame) -> DataFrame:
    """Postings with their documents' numbers of tokens, where they lie: postings are dealt by document."""
    return posts.withColumn("length", F.sum("tf").over(Window.partitionBy("doc_id")))


def vocabulary(posts: DataFrame) -> DataFrame:
    """(term, df)."""
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def document_lengths(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """(doc_id, token_count, max_tf) of every document; one without tokens has 0 and null."""
    sums = posts.groupBy("doc_id").agg(F.sum("tf").alias("token_count"), F.max("tf").alias("max_tf"))
    return docs.select("doc_id").join(sums, "doc_id", "left").select("doc_id", F.coalesce("token_count", F.lit(0)).alias("token_count"), "max_tf")


def metadata(lengths: DataFrame) -> DataFrame:
    """One row: documents, tokens, avgdl (mean tokens a document, empty ones included)."""
    return lengths.agg(F.count("*").alias("documents"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens")).select("documents", "tokens", F.when(F.col("documents") > 0, F.col("tokens") / F.col("documents")).alias("avgdl"))


def weights(found: DataFrame, vocab: DataFrame, documents: int) -> DataFrame:
    """(doc_id, vsm_weight) from blocks: the norm of tf (ln N - ln df), over the largest tf. Blocks meet the vocabulary
    before they are unrolled, so a term is shuffled once a block."""
    idf = F.log(F.lit(float(documents))) - F.log(F.col("df").cast("double"))
    weighed = found.select(*blocks.COLUMNS).join(vocab.select("term", idf.alias("idf")), "term")
    part = F.col("tf") * F.col("idf")
    return blocks.unrolled(weighed, "idf").groupBy("doc_id").agg((F.sqrt(F.sum(part * part)) / F.max("tf")).alias("vsm_weight"))


def posting_lists(posts: DataFrame) -> DataFrame:
    """(term, df, postings): each term's (doc_id, tf) by doc_id. For display: scoring reads the long form."""
    return posts.groupBy("term").agg(F.count("*").alias("df"), F.sort_array(F.collect_list(F.struct("doc_id", "tf"))).alias("postings"))


def offsets(vocab: DataFrame) -> DataFrame:
    """(term, df, offset): where each term's 8-byte postings begin, terms in byte order."""
    return blocks.offsets(blocks.ranged(vocab)).select("term", "df", (F.col("before") * 8).alias("offset"))


@dataclass(frozen=True)
class Index:
    """The tables of an index and its scalars."""

    blocks: DataFrame  # see operators.blocks
    vocabulary: DataFrame  # term, df, ratio, deep
    doc_stats: DataFrame  # doc_id, token_count, max_tf, vsm_weight, pagerank
    display: DataFrame  # doc_id and whatever results may show
    splitters: DataFrame  # term, part, cuts
    documents: int
    tokens: int
    parts: int
    use_stemmer: bool = False
    stopwords: tuple[str, ...] = ()

    @property
    def avgdl(self) -> float:
        return self.tokens / self.documents if self.documents else 0.0

    @property
    def use_stopwords(self) -> bool:
        return bool(self.stopwords)

    @property
    def postings(self) -> DataFrame:
        """(term, doc_id, tf), a row a posting."""
        return blocks.unrolled(self.blocks).select("term", "doc_id", "tf")


def with_pagerank(stats: DataFrame, pagerank: DataFrame | None) -> DataFrame:
    """Statistics with the pagerank of (doc_id, pagerank), 0 for documents that it lacks."""
    if pagerank is None:
        return stats.withColumn("pagerank", F.lit(0.0))
    return stats.join(pagerank.select("doc_id", F.col("pagerank").cast("double")), "doc_id", "left").withColumn("pagerank", F.coalesce("pagerank", F.lit(0.0)))


def with_bounds(vocab: DataFrame, found: DataFrame) -> DataFrame:
    """(term, df, ratio, deep): the smallest ratio of a term's blocks, and the most blocks that it has in a part."""
    return vocab.select("term", "df").join(found.groupBy("term").agg(F.min("ratio").alias("ratio"), (F.max("block") + 1).alias("deep")), "term", "left")


def build(docs: DataFrame, fields: Mapping[str, str], stopwords: Iterable[str] = (), stemmer: bool = False, pagerank: DataFrame | None = None, splitters: DataFrame | None = None, parts: int | None = None, rows: int = blocks.ROWS) -> Index:
    """Index docs (doc_id and the fields); its tables lie in the shared folder.

    Documents are read and tokenised once: their postings are written as they come, and all else reads those. Places
    in the index are prefix sums over the vocabulary, or those of kept splitters, with their number of parts; so no
    postings are sampled. rows: the postings of a part.
    """
    words = tuple(sorted(set(stopwords)))
    with scope(docs.sparkSession) as own:
        hold = lambda df, name: own.keep(materialize(df, name))
        posts = materialize(with_length(postings(docs, fields, words, stemmer)), "counts")
        terms_ = materialize(vocabulary(posts), "terms")
        size, tasks = blocks.part_size(terms_, rows)
        if splitters is None:
            parts = tasks
            places = hold(blocks.placed(blocks.ranged(terms_), size), "places")
            splitters = blocks.splitters(places)  # written when the index is
        else:
            places = materialize(blocks.placed_by(terms_, splitters), "places")
        lengths = materialize(document_lengths(docs, posts), "lengths")
        meta = metadata(lengths).first()
        held = blocks.located(posts, places, tasks)
        found = hold(blocks.gathered(blocks.blocked(held, meta["avgdl"] or 0.0), parts), "blocks")
        vocab = hold(with_bounds(terms_, found).sortWithinPartitions("term"), "vocabulary")
        stats = lengths.join(weights(found, terms_, meta["documents"]), "doc_id", "left")
        stats = hold(with_pagerank(stats, pagerank), "doc_stats")
    return Index(found, vocab, stats, docs, splitters, meta["documents"], meta["tokens"], parts, stemmer, words)

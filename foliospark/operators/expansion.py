"""Query expansion: nearest word vectors, thesaurus senses, and the cap on what is added.

An expander turns (query_id, pos, token) rows into candidates (query_id, pos, cand, term, weight): the token itself
is candidate 0 of weight 1, the rest follow with weight 0.5.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.functions.scalars import word_class
from foliospark.functions.stems import stemmed
from foliospark.functions.tokens import not_stopword
from foliospark.sources.scratch import materialize

EXTRA, NEW_WEIGHT = 3, 0.5
#: Query words of a block; a block of vectors has twice as many.
BLOCK = 4096


class QueryExpansionError(RuntimeError):
    """An expander failed."""


def nearest(words: DataFrame, vectors: DataFrame, k: int = EXTRA, block: int = BLOCK) -> DataFrame:
    """(word, near, similarity, rank): the k nearest words by cosine of each word that has a vector, itself left out.

    Up to `block` query words are sent to every task of one scan of the vectors. More meet the vectors in one grouped
    plan: the vectors are scanned once, and every block of them is multiplied with every block of words in a task of its
    own. Either way a task writes k rows a word, of which k are kept in turn. Ties go to the smaller word. Zero vectors
    are near nothing.
    """
    own = materialize(vectors.join(words.select("word").distinct(), "word", "left_semi").select("word", "vector"), "words")
    n = own.count()
    found = _sent(own, vectors, k) if n <= block else _grouped(own, n, vectors, k, block)
    w = Window.partitionBy("word").orderBy(F.desc("similarity"), "near")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of length 1, of NaN where a vector is zero."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    size = np.sqrt((x * x).sum(1, keepdims=True))
    return x / np.where(size == 0, np.nan, size)


class _Best:
    """The k nearest words of each query word, so far."""

    def __init__(self, names: list, q: np.ndarray, k: int):
        self.names, self.q, self.k = names, q, k
        self.sims, self.near = np.full((len(names), k), -np.inf), np.full((len(names), k), None, object)
        self.own = {name: i for i, name in enumerate(names)}

    def meet(self, near: list, x: np.ndarray) -> None:
        sims = np.nan_to_num(self.q @ x.T, nan=-np.inf)
        for j, name in enumerate(near):
            if name in self.own:
                sims[self.own[name], j] = -np.inf
        bar = self.sims[:, -1:]
        if sims.shape[1] > self.k:  # what the block's own k nearest leave out is not looked at, ties are
            bar = np.maximum(bar, np.partition(sims, -self.k, axis=1)[:, -self.k, None])
        reach = (sims >= bar) & np.isfinite(sims)
        for i in np.flatnonzero(reach.any(1)).tolist():
            held = [(-s, n) for s, n in zip(self.sims[i], self.near[i], strict=True) if n is not None]
            rows = sorted([*held, *((-sims[i, j], near[j]) for j in np.flatnonzero(reach[i]))])[: self.k]
            self.sims[i, : len(rows)] = [-s for s, _ in rows]
            self.near[i, : len(rows)] = [n for _, n in rows]

    def rows(self, kind: pa.DataType) -> pa.RecordBatch:
        i, r = np.nonzero(np.isfinite(self.sims))
        return pa.RecordBatch.from_arrays([pa.array([self.names[x] for x in i], kind), pa.array(self.near[i, r].tolist(), kind), pa.array(self.sims[i, r])], ["word", "near", "similarity"])


def _schema(vectors: DataFrame) -> str:
    kind = vectors.schema["word"].dataType.simpleString()
    return f"word {kind}, near {kind}, similarity double"


def _sent(own: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """One scan of the vectors, with the query words, a block at most, in every task."""
    part = own.toArrow()
    column = part.column("vector").combine_chunks()
    shared = vectors.sparkSession.sparkContext.broadcast((part.column("word").to_pylist(), _unit(column)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, kind = _Best(*shared.value, k), None
        for b in batches:
            kind = b.column("word").type
            if b.num_rows and best.names:
                best.meet(b.column("word").to_pylist(), _unit(b.column("vector")))
        if kind is not None:
            yield best.rows(kind)

    return vectors.select("word", "vector").mapInArrow(run, _schema(vectors))


def _grouped(own: DataFrame, n: int, vectors: DataFrame, k: int, block: int) -> DataFrame:
    """A task for each block of query words and each block of vectors."""
    rows, cols = -(-n // block), max(1, -(-vectors.count() // (2 * block)))
    at = lambda count: F.pmod(F.xxhash64("word"), F.lit(count)).cast("int")
    every = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    left = own.select("word", "vector", at(rows).alias("q"), every(cols).alias("v"))
    right = vectors.select("word", "vector", every(rows).alias("q"), at(cols).alias("v"))

    def run(queries: pa.Table, others: pa.Table) -> pa.Table:
        both = [(t.column("word"), t.column("vector").combine_chunks()) for t in (queries, others)]
        kind = queries.schema.field("word").type
        best = _Best(both[0][0].to_pylist(), _unit(both[0][1]), k)
        if best.names and len(both[1][0]):
            best.meet(both[1][0].to_pylist(), _unit(both[1][1]))
        return pa.Table.from_batches([best.rows(kind)])

    return left.groupBy("q", "v").cogroup(right.groupBy("q", "v")).applyInArrow(run, _schema(vectors))


def _originals(query: DataFrame) -> DataFrame:
    return query.select("query_id", "pos", F.lit(0).alias("cand"), F.col("token").alias("term"), F.lit(1.0).alias("weight"))


def by_vectors(query: DataFrame, vectors: DataFrame, stopwords: Iterable[str] = (), k: int = EXTRA) -> DataFrame:
    """Candidates from the k nearest words; stop words are left out of query and candidates."""
    words = tuple(stopwords)
    kept = query.where(not_stopword(F.col("token"), words))
    near = nearest(kept.select(F.col("token").alias("word")), vectors, k).where(not_stopword(F.col("near").cast("string"), words))
    extra = kept.join(near, kept["token"] == near["word"]).select("query_id", "pos", F.col("rank").alias("cand"), F.col("near").alias("term"), F.lit(NEW_WEIGHT).alias("weight"))
    return _originals(kept).union(extra)


def tagged(query: DataFrame, tags: DataFrame, default: str = "NN") -> DataFrame:
    """(query_id, pos, token, tag): each token's tag from (token, tag), `default` where it has none."""
    return query.join(tags.select("token", "tag"), "token", "left").select("query_id", "pos", "token", F.coalesce("tag", F.lit(default)).alias("tag"))


def by_thesaurus(query: DataFrame, thesaurus: DataFrame, stopwords: Iterable[str] = (), most: int = EXTRA) -> DataFrame:
    """Candidates from (query_id, pos, token, tag): of every sense of an open-class word, its first words, three at most."""
    words = tuple(stopwords)
    kept = query.where(not_stopword(F.col("token"), words)).withColumn("class", word_class(F.col("tag")))
    t = thesaurus.where(not_stopword(F.col("word"), words))
    t = t.withColumn("n", F.row_number().over(Window.partitionBy("pos", "lemma", "sense").orderBy("rank"))).where(F.col("n") <= most)
    t = t.select(F.col("pos").alias("class"), F.col("lemma").alias("token"), "sense", "n", "word")
    hits = kept.where("class is not null").join(t, ["class", "token"])
    order = Window.partitionBy("query_id", "pos").orderBy("sense", "n")
    extra = hits.select("query_id", "pos", F.row_number().over(order).alias("cand"), F.col("word").alias("term"), F.lit(NEW_WEIGHT).alias("weight"))
    return _originals(kept).union(extra)


def capped(candidates: DataFrame, stopwords: Iterable[str] = (), stemmer: bool = False) -> DataFrame:
    """(query_id, pos, term, weight) of what is searched: a token's first candidate, and one more at most.

    Candidates that are stop words or hold a space are passed over. A stem counts as another word unless it equals,
    case and all, the lower-case term before it.
    """
    rows = candidates.where(not_stopword(F.col("term"), tuple(stopwords)) & ~F.col("term").contains(" "))
    if stemmer:
        rows = stemmed(rows, "term", "stem")
    else:
        rows = rows.withColumn("stem", F.col("term"))
    w = Window.partitionBy("query_id", "pos").orderBy("cand")
    rows = rows.withColumn("first", F.first(F.lower("stem")).over(w)).withColumn("n", F.row_number().over(w))
    other = rows.where((F.col("n") == 1) | (F.col("stem") != F.col("first")))
    chosen = other.withColumn("m", F.row_number().over(w)).where("m <= 2")
    return chosen.select("query_id", ((F.col("pos") * 2) + F.col("m") - 1).alias("pos"), F.lower("stem").alias("term"), "weight")

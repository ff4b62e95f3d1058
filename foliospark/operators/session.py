"""A search session: an index and immutable settings."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field, replace

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.functions.scalars import untagged
from foliospark.functions.tokens import QUERY, query_terms, tokens
from foliospark.operators import evaluation, expansion, report, retrieval, tagging
from foliospark.operators.index import Index, IndexNotLoadedError
from foliospark.sources.scratch import materialize, scope

#: What Spark raises when a plan or a task fails; errors of the program itself pass as they are.
FAILURES = (PySparkException, Py4JError)


@dataclass(frozen=True)
class Search:
    """`with_` returns a changed copy; nothing that is set on one search changes another."""

    index: Index | None
    model: str = "okapi"
    expansion: str = "none"
    pagerank_weight: float = 0.25
    properties: tuple[str, ...] = ()
    vectors: DataFrame | None = field(default=None, compare=False)
    thesaurus: DataFrame | None = field(default=None, compare=False)
    tags: DataFrame | None = field(default=None, compare=False)
    tagger: tagging.Tagger | None = field(default=None, compare=False)

    @classmethod
    def of(cls, index: Index, settings: Settings, **more) -> Search:
        return cls(index, settings.model, settings.expansion, settings.pagerank_publications_weight, **more)

    def with_(self, **changes) -> Search:
        return replace(self, **changes)

    @property
    def is_loaded(self) -> bool:
        return self.index is not None

    def unload(self) -> Search:
        """The same settings without an index, which is free to go."""
        return self.with_(index=None)

    def terms(self, queries: DataFrame) -> DataFrame:
        """Query terms of (query_id, query). The thesaurus takes tags from the table `tags`, or else from word_TAG tokens.

        An expander that lacks its table, or whose plan fails, raises QueryExpansionError; so do its tasks in a search.
        """
        if self.index is None:
            raise IndexNotLoadedError("search")
        stop, stem = self.index.stopwords, self.index.use_stemmer
        if self.expansion == "none":
            return query_terms(queries, stop, stem)
        if (self.vectors if self.expansion == "glove" else self.thesaurus) is None:
            raise expansion.QueryExpansionError(f"{self.expansion} lacks its table")
        try:
            if self.expansion == "glove":
                rows = queries.select("query_id", F.posexplode(tokens(F.col("query"), QUERY)).alias("pos", "token"))
                return expansion.capped(expansion.by_vectors(rows, self.vectors, stop), stop, stem)
            if self.tagger is not None:
                rows = tagging.tagged(queries.select("query_id", F.posexplode(tokens(F.col("query"), QUERY)).alias("pos", "token")), self.tagger)
            elif self.tags is not None:
                rows = queries.select("query_id", F.posexplode(tokens(F.col("query"), QUERY)).alias("pos", "token"))
                rows = expansion.tagged(rows, self.tags)
            else:
                rows = queries.select("query_id", F.posexplode(F.filter(F.split("query", r"\s+"), lambda t: t != "")).alias("pos", "tagged"))
                word, tag = untagged(F.col("tagged"))
                rows = rows.select("query_id", "pos", word.alias("token"), tag.alias("tag"))
            return expansion.capped(expansion.by_thesaurus(rows, self.thesaurus, stop), stop, stem)
        except FAILURES as e:
            raise expansion.QueryExpansionError(self.expansion) from e

    def resolved(self, queries: DataFrame) -> retrieval.Terms:
        """The queries' terms, looked up. Expansions run here, so that what fails in their tasks is a QueryExpansionError."""
        terms = self.terms(queries)
        if self.expansion == "none":
            return retrieval.resolve(terms, self.index)
        try:
            return retrieval.resolve(materialize(terms, "terms"), self.index)
        except FAILURES as e:
            raise expansion.QueryExpansionError(self.expansion) from e

    @contextmanager
    def results(self, queries: DataFrame, k: int | None = None) -> Iterator[DataFrame]:
        """`search`, with tables of its own that go when the block ends; searches of other threads keep theirs."""
        with scope(self.index.blocks.sparkSession):
            yield self.search(queries, k)

    def search(self, queries: DataFrame, k: int | None = None) -> DataFrame:
        """Ranked results of every query, with the session's properties; without k, all."""
        found = retrieval.search(self.resolved(queries), self.index, self.model, k, self.pagerank_weight)
        return retrieval.with_properties(found, self.index, self.properties) if self.properties else found

    def ask(self, query: str, k: int | None = None) -> DataFrame:
        """One query."""
        if self.index is None:
            raise IndexNotLoadedError("search")
        spark = self.index.blocks.sparkSession
        queries = spark.createDataFrame([(0, query)], "query_id int, query string")
        found = retrieval.search(self.resolved(queries), self.index, self.model, k, self.pagerank_weight)
        return (retrieval.with_properties(found, self.index, self.properties) if self.properties else found).orderBy("rank")

    def show(self, query: str, k: int | None = 50, start: int = 0, end: int | None = 9) -> list[str]:
        """The lines that show one query's results: the number of matches, and those at places start to end.

        The existential model scores all matches, the others k.
        """
        found = self.ask(query, None if self.model == "existential" else k)
        ranks = found.agg(F.count("*").alias("n")).first()["n"]
        return [f"Found {ranks} results", *report.listing(found, ranks, start, end, self.properties)]

    def total(self, queries: DataFrame) -> DataFrame:
        return retrieval.totals(retrieval.MODELS[self.model](self.resolved(queries), self.index))


def grid(search: Search, queries: DataFrame, judgements: DataFrame, expansions: Iterable[str], models: Iterable[str] = ("vsm", "okapi"), weights: Iterable[float] = (0.0, 0.25)) -> DataFrame:
    """Metrics of every query for each expansion, model and PageRank weight."""
    out = None
    for e in expansions:
        for m in models:
            for w in weights:
                own = search.with_(expansion=e, model=m, pagerank_weight=w, properties=())
                found = retrieval.scored(own.resolved(queries), own.index, m, w)
                rows = evaluation.metrics(found, judgements).select(F.lit(e).alias("expansion"), F.lit(m).alias("model"), F.lit(w).alias("pagerank_weight"), "*")
                out = rows if out is None else out.union(rows)
    return out

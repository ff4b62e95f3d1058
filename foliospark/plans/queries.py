"""The operators as queries over the driver tables.

`documents` is the corpus: text is the abstract, lang the field of study, source the source. `lineitem` gives
citations: within an order, returned lines cite the next line's part; `part` are the nodes.
"""

from __future__ import annotations

import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliospark.functions import scalars, stems, tokens
from foliospark.operators import blocks, evaluation, expansion, graph, histogram, index, report, retrieval, segments, session, tagging
from foliospark.operators.index import Index
from foliospark.sources import corpus
from foliospark.sources.scratch import folder, lasting, materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TEXT = {"text": "abstract"}
#: (query_id, pos, term, weight): frequent and rare words, and one that no document has.
ASKED = [(1, 0, "thing", 1.0), (1, 1, "erble", 1.0), (1, 2, "zzzz", 0.5), (2, 0, "thtion", 2.0), (2, 1, "the", 1.0), (3, 0, "de", 1.0)]
FIRST = [(1, 0, "thing", 1.0), (1, 1, "erble", 1.0), (1, 2, "zzzz", 1.0)]
#: A thesaurus and tagged words for it, for the evaluation's few queries.
THESAURUS = [("noun", "thing", 1, 1, "thing"), ("noun", "thing", 1, 2, "object"), ("noun", "thing", 1, 3, "erble"), ("noun", "thing", 1, 4, "matter"), ("noun", "thing", 2, 1, "the"), ("noun", "thing", 2, 2, "affair"), ("verb", "ing", 1, 1, "go on"), ("verb", "ing", 1, 2, "thtion"), ("adverb", "de", 1, 1, "of")]
TAGGED = [(1, 0, "thing", "NN"), (1, 1, "ing", "VBD"), (1, 2, "of", "IN"), (2, 0, "de", "RB"), (2, 1, "thing", "JJ"), (2, 2, "the", "DT")]
#: Words for the first vectors.
WORDS = ("thing", "erble", "thtion", "la", "de", "ing", "er", "tion")
STOP = tokens.ENGLISH
_lock = threading.Lock()
_built: dict[tuple[str, str], Index] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def the_index(spark: SparkSession, sf_dir: str) -> Index:
    """The text index of a data folder, built once a session, as an engine serves many queries from one index."""
    key = (spark.sparkContext.applicationId, sf_dir)
    with _lock, lasting():
        if key in _built:
            return _built[key]
        docs = table(spark, sf_dir, "documents")
        n = docs.count()
        # a stand-in for citation scores: decreasing with doc_id
        rank = docs.select("doc_id", (F.lit(1.0) / (F.col("doc_id") % 97 + 1) / n).alias("pagerank"))
        _built[key] = index.build(docs, TEXT, pagerank=rank)
    return _built[key]


def the_merged(spark: SparkSession, sf_dir: str) -> Index:
    """The same index from three segments, of documents by language: one stored, two added, and all merged."""
    key = (spark.sparkContext.applicationId, f"{sf_dir} merged")
    with _lock, lasting():
        if key not in _built:
            path, docs = folder(spark, "index"), table(spark, sf_dir, "documents")
            third = F.pmod(F.xxhash64(F.coalesce("lang", F.lit(""))), F.lit(3))
            segments.save(index.build(docs.where(third == 0), TEXT), path)
            for i in (1, 2):
                segments.append(spark, path, docs.where(third == i), TEXT)
            _built[key] = segments.merge(spark, path)
    return _built[key]


def asked(spark: SparkSession, rows=ASKED) -> DataFrame:
    return spark.createDataFrame(rows, "query_id int, pos int, term string, weight double")


def _exploded(df: DataFrame, key: str, text: str, delimiters: str) -> DataFrame:
    return df.select(key, F.posexplode(tokens.tokens(F.col(text), delimiters)).alias("pos", "token"))


# tokenisers


@query
def tokenize_abstract(spark, d):
    return _exploded(table(spark, d, "documents"), "doc_id", "text", tokens.TITLE)


@query
def tokenize_authors(spark, d):
    return _exploded(table(spark, d, "customer"), "c_custkey", "c_name", tokens.AUTHORS)


@query
def tokenize_venue(spark, d):
    return _exploded(table(spark, d, "supplier"), "s_suppkey", "s_name", tokens.VENUE)


@query
def tokenize_journal(spark, d):
    return _exploded(table(spark, d, "part"), "p_partkey", "p_name", tokens.JOURNAL)


@query
def tokenize_entities(spark, d):
    return _exploded(table(spark, d, "part"), "p_partkey", "p_type", tokens.ENTITIES)


@query
def tokenize_default(spark, d):
    return _exploded(table(spark, d, "documents"), "doc_id", "source", tokens.PLAIN)


@query
def tokenize_query(spark, d):
    return _exploded(table(spark, d, "benchmark"), "item_id", "text", tokens.QUERY)


# the term pipeline


@query
def stopword_filter(spark, d):
    return index.token_rows(table(spark, d, "documents"), TEXT, STOP).groupBy("term").agg(F.count("*").alias("n"))


@query
def stem_terms(spark, d):
    """Stems of all distinct tokens."""
    rows = table(spark, d, "documents").select(F.explode(tokens.tokens(F.col("text"), tokens.TITLE)).alias("token")).distinct()
    return stems.stemmed(rows, "token", "stem").select("token", F.lower("stem").alias("term"))


@query
def term_pipeline(spark, d):
    """Stop words, stems, lower case, and the frequencies of what is left."""
    return index.postings(table(spark, d, "documents"), TEXT, STOP, True)


@query
def query_terms(spark, d):
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return tokens.query_terms(rows, STOP)


@query
def index_fields(spark, d):
    """Several fields pooled, each with its own delimiters."""
    docs = table(spark, d, "documents").withColumns({"fields": F.array("lang"), "origin": F.array("source")})
    return index.postings(docs, {"text": "abstract", "fields": "plain", "origin": "plain"})


# the index


@query
def term_frequency(spark, d):
    return index.postings(table(spark, d, "documents"), TEXT)


@query
def doc_length(spark, d):
    return the_index(spark, d).doc_stats.select("doc_id", "token_count")


@query
def document_frequency(spark, d):
    return the_index(spark, d).vocabulary.select("term", "df")


@query
def index_meta(spark, d):
    return index.metadata(the_index(spark, d).doc_stats).select("documents", F.round("avgdl", 9).alias("avgdl"))


@query
def max_tf(spark, d):
    return the_index(spark, d).doc_stats.select("doc_id", "max_tf")


@query
def vsm_doc_weight(spark, d):
    return the_index(spark, d).doc_stats.select("doc_id", F.round("vsm_weight", 9).alias("vsm_weight"))


@query
def postings_list(spark, d):
    return index.posting_lists(the_index(spark, d).postings).select("term", "df", F.array_join(F.transform("postings", lambda p: F.concat(p["doc_id"].cast("string"), F.lit(":"), p["tf"].cast("string"))), " ").alias("postings"))


@query
def postings_offset(spark, d):
    return index.offsets(the_index(spark, d).vocabulary)


@query
def vocabulary_sorted(spark, d):
    """The whole vocabulary in byte order."""
    return the_index(spark, d).vocabulary.select("term", "df").orderBy("term")


@query
def vocabulary_ranked(spark, d):
    """The whole vocabulary, each term with its place in byte order."""
    return corpus.numbered(the_index(spark, d).vocabulary, "term").select("term", "df", F.col("doc_id").alias("place"))


@query
def merged_postings(spark, d):
    """The postings of an index that was merged from segments."""
    return the_merged(spark, d).postings


@query
def merged_vocabulary(spark, d):
    return the_merged(spark, d).vocabulary.select("term", "df")


@query
def merged_stats(spark, d):
    """Lengths and weights after a merge: the weights follow the document frequencies of the whole."""
    return the_merged(spark, d).doc_stats.select("doc_id", "token_count", "max_tf", F.round("vsm_weight", 9).alias("vsm_weight"))


@query
def merged_topk(spark, d):
    """Every benchmark text as a query to the merged index, by blocks that can reach its best ten."""
    i = the_merged(spark, d)
    return retrieval.top(retrieval.normalised(retrieval.bounded(_benchmark(spark, d), i, 10), True), 10, 9).select("query_id", "doc_id", "score", "rank")


@query
def postings_blocks(spark, d):
    """The size and span of every term's blocks: bounded rows, whatever the term."""
    rows = the_index(spark, d).blocks.groupBy("term").agg(F.sum("n").alias("df"), F.max("n").cast("int").alias("most"), F.min("first").alias("first_doc"), F.max(F.col("first") + F.element_at("docs", -1)).alias("last_doc"))
    return rows.select("term", "df", (F.col("most") <= blocks.BLOCK).alias("bounded"), "first_doc", "last_doc")


# retrieval


@query
def merge_query_terms(spark, d):
    """Every benchmark text as a query, repeats of a term as one."""
    return retrieval.merge_terms(_benchmark(spark, d)).select("query_id", "term", "weight", "pos")


@query
def query_df_lookup(spark, d):
    return retrieval.term_frequencies(asked(spark), the_index(spark, d)).select("query_id", "term", "df")


@query
def postings_lookup(spark, d):
    return retrieval.lookup(the_index(spark, d), ["thing", "erble", "zzzz"])


@query
def existential(spark, d):
    return retrieval.existential(asked(spark), the_index(spark, d))


def _rounded(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", F.round("score", 9))


@query
def vsm_scores(spark, d):
    return _rounded(retrieval.scored(asked(spark), the_index(spark, d), "vsm")).select("query_id", "doc_id", "score")


@query
def vsm_topk(spark, d):
    return retrieval.search(asked(spark), the_index(spark, d), "vsm", 10, digits=9).select("query_id", "doc_id", "score", "rank")


@query
def bm25_scores(spark, d):
    return _rounded(retrieval.scored(asked(spark), the_index(spark, d), "okapi")).select("query_id", "doc_id", "score")


@query
def bm25_top10(spark, d):
    return retrieval.search(asked(spark, FIRST), the_index(spark, d), "okapi", 10, digits=9).select("doc_id", "score", "rank")


@query
def total_results(spark, d):
    return retrieval.totals(retrieval.existential(asked(spark), the_index(spark, d)))


@query
def pagerank_blend(spark, d):
    return retrieval.search(asked(spark), the_index(spark, d), "okapi", 20, 0.25, 9).select("query_id", "doc_id", "score", "rank")


@query
def late_projection(spark, d):
    i = the_index(spark, d)
    return retrieval.with_properties(retrieval.search(asked(spark), i, "okapi", 10, digits=9), i, ["lang", "source", "n_chars"]).select("query_id", "rank", "doc_id", "lang", "source", "n_chars")


@query
def result_range(spark, d):
    return retrieval.in_range(retrieval.search(asked(spark), the_index(spark, d), "okapi", 12, digits=9), 5, 20).select("query_id", "doc_id", "rank")


def _benchmark(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return tokens.query_terms(rows, STOP)


@query
def batch_topk(spark, d):
    """Every benchmark text as a query: ten results each."""
    return retrieval.search(_benchmark(spark, d), the_index(spark, d), "okapi", 10, digits=9).select("query_id", "doc_id", "score", "rank")


# graphs


def citations(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Out lists (id, pos, other) and nodes (id)."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_returnflag")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("id"), F.lead("l_partkey").over(w).alias("other"), "l_returnflag", F.row_number().over(w).alias("k"))
    cited = lines.where("l_returnflag = 'R' and other is not null")
    place = Window.partitionBy("id").orderBy("l_orderkey", "k")
    out = cited.select("id", (F.row_number().over(place) - 1).alias("pos"), "other")
    return out, table(spark, d, "part").select(F.col("p_partkey").alias("id"))


def _in_lists(spark: SparkSession, d: str) -> DataFrame:
    """In lists: the same citations read the other way, but for those of every seventh part."""
    out, _ = citations(spark, d)
    w = Window.partitionBy("other").orderBy("id", "pos")
    return out.where("id % 7 <> 0").select(F.col("other").alias("id"), (F.row_number().over(w) - 1).alias("pos"), F.col("id").alias("other"))


def _small_nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("id"))


@query
def citation_edges(spark, d):
    return graph.edges(*citations(spark, d))


def _ranked(spark, d, **options):
    out, nodes = citations(spark, d)
    links = graph.edges(out, nodes)
    return graph.pagerank(nodes, links, **options).select("id", F.round("pagerank", 10).alias("pagerank"))


@query
def pagerank_10(spark, d):
    return _ranked(spark, d, iterations=10)


@query
def pagerank_converged(spark, d):
    return _ranked(spark, d)


@query
def out_degree(spark, d):
    return graph.edges(*citations(spark, d)).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"))


@query
def degree_hist_out(spark, d):
    return graph.histogram(graph.degrees(*citations(spark, d)), "raw")


@query
def degree_hist_out_true(spark, d):
    return graph.histogram(graph.degrees(*citations(spark, d)), "true")


@query
def degree_hist_in(spark, d):
    return graph.histogram(graph.degrees(_in_lists(spark, d), citations(spark, d)[1]), "raw")


@query
def degree_hist_in_true(spark, d):
    return graph.histogram(graph.degrees(_in_lists(spark, d), citations(spark, d)[1]), "true")


@query
def edge_stats(spark, d):
    out, nodes = citations(spark, d)
    return graph.edge_stats(materialize(out, "out"), materialize(_in_lists(spark, d), "in"), nodes)


@query
def inconsistent_edges(spark, d):
    out, nodes = citations(spark, d)
    return graph.inconsistent(out, _in_lists(spark, d), nodes)


@query
def not_found_stats(spark, d):
    return graph.not_found_stats(citations(spark, d)[0], _in_lists(spark, d), _small_nodes(spark, d))


@query
def not_found_hist(spark, d):
    return graph.histogram(graph.not_found(citations(spark, d)[0], _small_nodes(spark, d)), "missing")


@query
def graph_report(spark, d):
    """The statistics and histograms of the citation graph, as lines of files."""
    out, nodes = citations(spark, d)
    return report.graph_report(materialize(out, "out"), materialize(_in_lists(spark, d), "in"), nodes)


@query
def adjacency_dump(spark, d):
    return graph.adjacency(*citations(spark, d))


# evaluation


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Every query is judged on the labelled documents; quality 1 is relevant."""
    ids = asked(spark).select("query_id").distinct()
    labels = table(spark, d, "labels").select("doc_id", F.col("quality").alias("relevance"))
    return labels.select(F.explode(F.array(*[F.lit(i) for i in sorted({a[0] for a in ASKED})])).alias("query_id"), "doc_id", "relevance").join(F.broadcast(ids), "query_id")


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluation.metrics(_rounded(retrieval.scored(asked(spark), the_index(spark, d), "vsm")), _judged(spark, d))


@query
def average_precision(spark, d):
    return _metrics(spark, d).select("query_id", F.round("avep", 9).alias("avep"))


@query
def ndcg(spark, d):
    return _metrics(spark, d).select("query_id", F.round("ndcg", 9).alias("ndcg"))


@query
def eval_summary(spark, d):
    rows = evaluation.summary(_metrics(spark, d))
    return rows.select("metric", *[F.round(c, 9).alias(c) for c in ("average", "least", "most")])


@query
def eval_grid(spark, d):
    """Each expansion and both models at both PageRank weights: twelve runs."""
    i, judged, out = the_index(spark, d), _judged(spark, d), None
    rows = asked(spark).select("query_id", "pos", F.col("term").alias("token"))
    words = expansion.capped(expansion.by_vectors(rows, _named_vectors(spark, d), STOP), STOP)
    for name, terms in (("none", asked(spark)), ("glove", words), ("wordnet", _few_expanded(spark))):
        terms = retrieval.resolve(terms, i)
        for model in ("vsm", "okapi"):
            for w in (0.0, 0.25):
                rows = evaluation.metrics(_rounded(retrieval.scored(terms, i, model, w)), judged)
                rows = rows.select(F.lit(name).alias("expansion"), F.lit(model).alias("model"), F.lit(w).alias("pagerank_weight"), "query_id", F.round("avep", 9).alias("avep"), F.round("ndcg", 9).alias("ndcg"))
                out = rows if out is None else out.union(rows)
    return out


@query
def eval_report(spark, d):
    """The report of an evaluation; times and numbers of results are made up from orders."""
    times = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("query"), F.col("o_orderkey").alias("place"), F.round(F.col("o_totalprice") * 1000).cast("long").alias("ns"), F.col("o_custkey").alias("results"))
    bad = F.col("place") % 5 == 0
    runs = times.withColumns({"avep": F.when(bad, F.lit(scalars.NAN)).otherwise((F.col("place") % 97 + 1) / 128), "ndcg": F.when(bad, F.lit(scalars.NAN)).otherwise((F.col("place") % 31 + 1) / 32)})
    return report.evaluation(runs, {"Retrieval model": "Okapi BM25+", "Query expansion": "none", "Pagerank weight (documents)": 0.25}, 90_000_000_000).orderBy("section", "place", "n")


@query
def eval_timing(spark, d):
    """Times of synthetic runs: an order's price stands for nanoseconds, its customer for results."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("query"), F.round(F.col("o_totalprice") * 1000).cast("long").alias("ns"), F.col("o_custkey").alias("results"))
    return evaluation.timing(rows)


# expansion


def _vectors(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("word"), F.col("embedding").alias("vector"))


def _named_vectors(spark: SparkSession, d: str) -> DataFrame:
    """All vectors, the first under words of the corpus."""
    names = spark.createDataFrame(list(enumerate(WORDS)), "vec_id long, word string")
    named = table(spark, d, "embeddings").join(F.broadcast(names), "vec_id", "left")
    return named.select(F.coalesce("word", F.concat(F.lit("w"), F.col("vec_id").cast("string"))).alias("word"), F.col("embedding").alias("vector"))


@query
def glove_nearest_all(spark, d):
    """The nearest words of every twentieth, in blocks of words and of vectors where they are many."""
    vectors = _vectors(spark, d)
    return expansion.nearest(vectors.where("word % 20 = 0"), vectors).select("word", "near", "rank", F.round("similarity", 5).alias("similarity"))


@query
def glove_nearest(spark, d):
    words = spark.createDataFrame([(w,) for w in range(0, 100, 5)], "word long")
    return expansion.nearest(words, _vectors(spark, d)).select("word", "near", "rank", F.round("similarity", 5).alias("similarity"))


@query
def glove_expand(spark, d):
    vectors = _vectors(spark, d).withColumn("word", F.concat(F.lit("w"), F.col("word").cast("string")))
    rows = spark.createDataFrame([(1, 0, "w3"), (1, 1, "the"), (1, 2, "unknown"), (2, 0, "w40")], "query_id int, pos int, token string")
    return expansion.by_vectors(rows, vectors, STOP)


def _benchmark_tokens(spark: SparkSession, d: str) -> DataFrame:
    return _exploded(table(spark, d, "benchmark"), "item_id", "text", tokens.QUERY).withColumnRenamed("item_id", "query_id")


def _thesaurus(spark: SparkSession, d: str) -> DataFrame:
    """A thesaurus out of the benchmark: each of an item's first words has the five words after it as a sense."""
    words = _benchmark_tokens(spark, d)
    sense = F.row_number().over(Window.partitionBy("token").orderBy("query_id", "pos"))
    lemmas = words.where("pos < 4").select("query_id", F.col("pos").alias("at"), F.col("token").alias("lemma"), sense.alias("sense"))
    kind = F.element_at(F.array(*map(F.lit, ("noun", "verb", "adjective", "adverb"))), F.length("lemma") % 4 + 1)
    near = (F.col("pos") > F.col("at")) & (F.col("pos") <= F.col("at") + 5)
    return lemmas.join(words, "query_id").where(near).select(kind.alias("pos"), "lemma", "sense", (F.col("pos") - F.col("at")).alias("rank"), F.col("token").alias("word"))


def _tags(spark: SparkSession, d: str) -> DataFrame:
    """(token, tag) of the benchmark's words, by their length."""
    kind = F.element_at(F.array(*map(F.lit, ("NN", "VBD", "JJ", "RB", "IN"))), F.length("token") % 5 + 1)
    return _benchmark_tokens(spark, d).select("token").distinct().withColumn("tag", kind)


@query
def wordnet_expand(spark, d):
    """Every benchmark text, its words tagged by a table and expanded by a thesaurus."""
    return expansion.by_thesaurus(expansion.tagged(_benchmark_tokens(spark, d), _tags(spark, d)), _thesaurus(spark, d), STOP)


@query
def wordnet_tagged(spark, d):
    """Every benchmark text, tagged by a tagger that learnt from the benchmark's own tags, and expanded by a thesaurus."""
    words = _benchmark_tokens(spark, d)
    tagger = tagging.learn(expansion.tagged(words, _tags(spark, d)), rounds=3)
    return expansion.by_thesaurus(tagging.tagged(words, tagger), _thesaurus(spark, d), STOP)


def _few_expanded(spark: SparkSession) -> DataFrame:
    """The evaluation's queries, expanded by a thesaurus of a few words."""
    found = expansion.by_thesaurus(spark.createDataFrame(TAGGED, "query_id int, pos int, token string, tag string"), spark.createDataFrame(THESAURUS, "pos string, lemma string, sense int, rank int, word string"), STOP)
    return expansion.capped(found, STOP)


@query
def expansion_cap(spark, d):
    return expansion.capped(wordnet_expand(spark, d), STOP)


@query
def expanded_search(spark, d):
    """Every benchmark text expanded, then BM25+ with the weights of its words."""
    return retrieval.search(expansion_cap(spark, d), the_index(spark, d), "okapi", 10, digits=9).select("query_id", "doc_id", "score", "rank")


# the rest


@query
def char_histogram(spark, d):
    return histogram.characters(table(spark, d, "documents"), ("text", "lang"))


@query
def json_reader(spark, d):
    """Documents as JSON lines, read back by the corpus reader; every tenth line is broken."""
    docs = table(spark, d, "documents")
    whole = F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("title"), F.array("lang").alias("fieldsOfStudy")))
    lines = docs.select(F.when(F.col("doc_id") % 10 == 3, F.lit("{broken")).otherwise(whole).alias("value"))
    return corpus.parsed(lines).select("id", "title", "year", "venue", F.array_join("fieldsOfStudy", ",").alias("fields"), F.size("authors").alias("n_authors"))


@query
def json_reader_whole(spark, d):
    """Whole texts as JSON lines, read back by the corpus reader: line ends, quotes and all."""
    docs = table(spark, d, "documents")
    lines = docs.select(F.to_json(F.struct(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("paperAbstract"))).alias("value"))
    return corpus.parsed(lines).select("id", F.col("paperAbstract").alias("text"))


@query
def json_props(spark, d):
    """Events' JSON properties by an explicit schema, counted by type."""
    rows = table(spark, d, "events").select("event_type", F.from_json("props", "k int, tag string").alias("p"))
    return rows.groupBy("event_type").agg(F.count("*").alias("n"), F.count("p").alias("parsed"))


def _authors(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier").groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct(F.col("s_suppkey").alias("k"), F.col("s_name").alias("name")))).alias("l"))
    return rows.select("s_nationkey", F.transform("l", lambda x: F.struct(x["name"].alias("name"), F.array(x["k"].cast("string"), (x["k"] + 1).cast("string")).alias("ids"))).alias("authors"))


@query
def author_strings(spark, d):
    return _authors(spark, d).select("s_nationkey", scalars.author_names(F.col("authors")).alias("names"), scalars.author_ids(F.col("authors")).alias("ids"))


@query
def doc_record_size(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", scalars.record_size(F.coalesce("text", F.lit("")), F.col("source"), F.lit("[]"), F.col("lang")).alias("bytes"))


@query
def duration_format(spark, d):
    rows = table(spark, d, "orders").select("o_orderkey", (F.pow(F.lit(2.0), F.col("o_orderkey") % 44) * 1000 + F.col("o_custkey") * 1000003).cast("long").alias("ns"))
    return rows.select("o_orderkey", "ns", scalars.duration(F.col("ns")).alias("shown"))


@query
def dense_ids(spark, d):
    """Dense ids from 0 in the order of a key."""
    return corpus.numbered(table(spark, d, "orders").select(F.col("o_orderkey").alias("id"))).select("id", "doc_id")


@query
def session_search(spark, d):
    """A session over the index: the query's own tokens, BM25+, and properties of the results."""
    s = session.Search(the_index(spark, d), "okapi", pagerank_weight=0.0, properties=("lang",))
    rows = spark.createDataFrame([(1, "thing, erble (zzzz)"), (2, "de la")], "query_id int, query string")
    return s.search(rows, 10).select("query_id", "doc_id", "rank", "lang", F.round("score", 6).alias("score"))

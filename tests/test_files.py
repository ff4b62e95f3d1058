"""Readers and writers over files: corpus, judgements, vectors, thesaurus, graph, index, reports."""

import json
import math

import pytest
from pyspark.sql import functions as F

from foliospark.operators import evaluation, expansion, graph, index, report, retrieval, segments, session
from foliospark.sources import corpus

DOCS = [
    {"id": "b", "title": "Blue dogs", "paperAbstract": "dogs run", "authors": [{"name": "Ann", "ids": ["1"]}, {"name": None, "ids": []}], "year": 1999, "journalName": "J", "outCitations": ["a", "zz"], "inCitations": []},
    {"id": "a", "title": None, "year": None, "inCitations": ["b"], "outCitations": []},
    {"title": "no id"},
    {"id": "c", "title": "Cats and dogs", "fieldsOfStudy": ["Biology"], "venue": "V", "inCitations": [], "outCitations": ["c", "a"]},
]


@pytest.fixture
def folder(tmp_path):
    data = tmp_path / "data"
    data.mkdir()
    lines = [json.dumps(d) for d in DOCS]
    (data / "s2-2").write_text("\n".join([*lines[2:], "{broken", ""]), "utf-8")
    (data / "s2-1").write_text("\n".join(lines[:2]), "utf-8")
    (data / "_hidden").write_text("{}", "utf-8")
    (data / "deeper").mkdir()
    return tmp_path


def test_corpus(spark, folder):
    assert [p.rsplit("/", 1)[1] for p in corpus.listing(spark, f"file://{folder}/data")] == ["s2-1", "s2-2"]
    docs = corpus.documents(spark, f"file://{folder}/data").cache()
    assert {r["id"]: (r["title"], r["year"], r["venue"], r["entities"]) for r in docs.collect()} == {"a": ("", 0, "", []), "b": ("Blue dogs", 1999, "", []), "c": ("Cats and dogs", 0, "V", [])}
    numbered = corpus.numbered(docs)
    assert {r["id"]: r["doc_id"] for r in numbered.collect()} == {"a": 0, "b": 1, "c": 2}
    assert [tuple(r) for r in corpus.string_ids(numbered, spark.createDataFrame([(2,), (9,), (2,)], "doc_id long")).collect()] == [(2, "c")]
    assert {r["id"] for r in corpus.ids(docs).collect()} == {"a", "b", "c"}
    shown = {r["id"]: r for r in corpus.display(docs).collect()}
    assert shown["b"]["author_names"] == "Ann," and shown["b"]["author_ids"] == "[1],[]" and shown["b"]["record_bytes"] == 16 + 9 + 4 + 6 + 1


def test_judgements_vectors_thesaurus(spark, folder):
    (folder / "j").write_text(json.dumps({"query": "dogs", "documents": [{"doc_id": "a", "relevance": 1}, {"doc_id": "b", "relevance": 0}]}) + "\nbad line\n", "utf-8")
    assert sorted(map(tuple, corpus.judgements(spark, f"file://{folder}/j").collect())) == [("dogs", "a", 1), ("dogs", "b", 0)]
    (folder / "v").write_text("the 0.5 -1 2\ndog 1 0 0\n\n", "utf-8")
    assert {r["word"]: r["vector"] for r in corpus.word_vectors(spark, f"file://{folder}/v").collect()} == {"the": [0.5, -1.0, 2.0], "dog": [1.0, 0.0, 0.0]}
    spark.createDataFrame([("noun", "dog", 1, 1, "hound", 5)], "pos string, lemma string, sense int, rank int, word string, more int").write.parquet(f"file://{folder}/t")
    assert [tuple(r) for r in corpus.thesaurus(spark, f"file://{folder}/t").collect()] == [("noun", "dog", 1, 1, "hound")]
    (folder / "s").write_text("the\nof\nthe\n", "utf-8")
    assert corpus.stopwords(spark, f"file://{folder}/s") == ["of", "the"]
    with pytest.raises(ValueError):
        corpus.stopwords(spark, f"file://{folder}/s", 1)


def test_graph_is_saved(spark, folder):
    docs = corpus.numbered(corpus.documents(spark, f"file://{folder}/data"))
    out, inn, nodes = graph.entries(docs, "outCitations"), graph.entries(docs, "inCitations"), docs.select("id")
    path = f"file://{folder}/graph"
    graph.save(out, inn, nodes, path)
    back = graph.load(spark, path)
    assert [sorted(map(tuple, x.collect())) for x in back] == [sorted(map(tuple, x.collect())) for x in (out, inn, nodes)]
    assert graph.edge_stats(*back).first() == graph.edge_stats(out, inn, nodes).first()
    assert [tuple(r) for r in graph.histogram(graph.degrees(*back[::2]), "raw").collect()] == [(0, 1), (1, 1), (2, 1)]
    nodes.limit(1).write.mode("overwrite").parquet(f"{path}/nodes")
    with pytest.raises(ValueError):
        graph.load(spark, path)


@pytest.fixture
def built(spark, folder):
    docs = corpus.numbered(corpus.documents(spark, f"file://{folder}/data"))
    return index.build(docs, index.CORPUS_FIELDS)


def test_pagerank_into_a_saved_index(spark, folder, built):
    path = f"file://{folder}/index"
    segments.save(built, path)
    before = {r["doc_id"]: r.asDict() for r in segments.load(spark, path).doc_stats.collect()}
    now = segments.update_pagerank(spark, path, spark.createDataFrame([(1, 0.5), (2, 0.25), (7, 1.0)], "doc_id long, pagerank double"))
    after = {r["doc_id"]: r.asDict() for r in now.doc_stats.collect()}
    assert {i: r["pagerank"] for i, r in after.items()} == {0: 0.0, 1: 0.5, 2: 0.25}
    assert all({k: v for k, v in after[i].items() if k != "pagerank"} == {k: v for k, v in r.items() if k != "pagerank"} for i, r in before.items())
    assert segments.delete(spark, path) and not segments.exists(spark, path)
    with pytest.raises(index.IndexNotLoadedError):
        segments.load(spark, path)


def test_shown_results(spark, built):
    s = session.Search(built, "okapi", pagerank_weight=0.0, properties=("year", "title"))
    lines = s.show("dogs", start=1, end=20)
    assert lines[:4] == ["Found 2 results", "", "Displaying results 1 to 1", ""] and lines[4] == "1" + report.RULE
    assert [x.split(":")[0] for x in lines[5:8]] == ["DOC_ID", "TITLE", "YEAR"] and lines[8] == ""
    assert s.show("dogs", start=5)[1:] == ["", "No results found in the specified range"] and s.show("nothing") == ["Found 0 results"]
    assert s.is_loaded and not s.unload().is_loaded
    with pytest.raises(index.IndexNotLoadedError):
        s.unload().ask("dogs")


def test_properties_change(spark, built):
    found = retrieval.with_properties(retrieval.search(spark.createDataFrame([(1, 0, "dogs", 1.0)], "query_id int, pos int, term string, weight double"), built), built, ["title", "year"])
    got = retrieval.change_properties(found, built, ["title", "year"], ["year", "venue"])
    assert sorted(got.columns) == sorted(["query_id", "doc_id", "score", "rank", "year", "venue"])
    assert {r["doc_id"]: (r["year"], r["venue"]) for r in got.collect()} == {1: (1999, ""), 2: (0, "V")}


def test_tagged_queries(spark, built):
    thesaurus = spark.createDataFrame([("noun", "hounds", 1, 1, "dogs"), ("verb", "hounds", 1, 1, "cats")], "pos string, lemma string, sense int, rank int, word string")
    tags = spark.createDataFrame([("of", "IN")], "token string, tag string")
    s = session.Search(built, "existential", "wordnet", thesaurus=thesaurus, tags=tags)
    assert {r["doc_id"] for r in s.ask("hounds of").collect()} == {1, 2}
    assert {r["doc_id"] for r in s.with_(tags=None).ask("hounds_VB of_IN").collect()} == {2}


def test_expansion_failures_are_wrapped(spark, built):
    s = session.Search(built, expansion="glove")
    with pytest.raises(expansion.QueryExpansionError):
        s.ask("dogs")  # no table: fails while it is planned
    broken = spark.range(1).select(F.lit("dogs").alias("word"), F.expr("array(cast(raise_error('gone') as float))").alias("vector"))
    with pytest.raises(expansion.QueryExpansionError):
        s.with_(vectors=broken).ask("dogs")  # fails in a task


def test_report_file(spark, tmp_path):
    runs = spark.createDataFrame([(0, "a b", 5_000_000, 3, 0.123456, math.nan), (1, "c", 90_000_000_000, 0, 0.5, 1.0)], "place long, query string, ns long, results long, avep double, ndcg double")
    path = f"file://{tmp_path}/report"
    report.write(report.evaluation(runs, {"Retrieval model": "VSM"}, 1), path)
    lines = [r["value"] for r in spark.read.text(path).collect()]
    assert lines[:9] == ["-> Evaluation options:", "Retrieval model: VSM", "", "Query: a b", "Search time: 5.0ms", "Results: 3", "Average precision: 0.1235", "nDCG: NaN", ""]
    assert lines[lines.index("[nDCG]") + 1 :][:3] == ["Average: 1.0", "Min: 1.0", "Max: 1.0"] and "Max: 1m 30s for query: c" in lines


def test_grid_has_all_runs(spark, built):
    vectors = spark.createDataFrame([("dogs", [1.0, 0.0]), ("cats", [1.0, 0.1])], "word string, vector array<float>")
    thesaurus = spark.createDataFrame([("noun", "dogs", 1, 1, "cats")], "pos string, lemma string, sense int, rank int, word string")
    s = session.Search(built, vectors=vectors, thesaurus=thesaurus, tags=spark.createDataFrame([], "token string, tag string"))
    judged = spark.createDataFrame([(1, 1, 1), (1, 2, 0)], "query_id int, doc_id long, relevance long")
    got = session.grid(s, spark.createDataFrame([(1, "dogs")], "query_id int, query string"), judged, ("none", "glove", "wordnet")).collect()
    assert len({(r["expansion"], r["model"], r["pagerank_weight"]) for r in got}) == len(got) == 12
    assert all(0 < r["avep"] <= 1 for r in got)


def test_evaluation_without_relevant_documents(spark, built):
    q = spark.createDataFrame([(1, 0, "dogs", 1.0)], "query_id int, pos int, term string, weight double")
    judged = spark.createDataFrame([(1, 1, 0), (1, 2, 0)], "query_id int, doc_id long, relevance long")
    r = evaluation.metrics(retrieval.scored(q, built), judged).first()
    assert math.isnan(r["avep"]) and math.isnan(r["ndcg"])
    assert all(math.isnan(x["average"]) for x in evaluation.summary(evaluation.metrics(retrieval.scored(q, built), judged)).collect())


def test_bucketed_pagerank_has_no_shuffle_of_links(spark):
    from foliospark.sources.scratch import Bucketed

    links = Bucketed(spark.range(1000).selectExpr("id % 37 as src", "id % 11 as dst"), "src", 4)
    shares = Bucketed(spark.range(37).selectExpr("id", "1.0D as share"), "id", 4)
    plan = links.read().hint("merge").join(shares.read().withColumnRenamed("id", "src"), "src")._jdf.queryExecution().executedPlan().toString()
    links.drop()
    shares.drop()
    assert "Exchange" not in plan


def test_pagerank_of_two_lists(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    links = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (3, 0)], "src long, dst long")
    degree = spark.createDataFrame([(0, 2), (1, 1), (3, 1)], "id long, degree long")
    one, two = ({r["id"]: r["pagerank"] for r in graph.pagerank(nodes, links, iterations=5, out_degree=d).collect()} for d in (None, degree))
    assert one == pytest.approx(two) and sum(one.values()) == pytest.approx(1)
    with pytest.raises(ValueError):
        graph.pagerank(nodes, links, out_degree=degree.where("id <> 3"))


def test_ids_must_be_unique(spark):
    docs = spark.createDataFrame([("a",), ("b",), ("a",)], "id string")
    assert corpus.require_unique(docs.distinct()).count() == 2
    with pytest.raises(ValueError, match="'a' stands 2 times"):
        corpus.require_unique(docs)


def test_nearest_over_many_batches(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = np.concatenate([rng.standard_normal((400, 8)), np.zeros((2, 8))])
    x[50] = x[7]
    vectors = spark.createDataFrame([(f"w{i:03}", [float(v) for v in e]) for i, e in enumerate(x)], "word string, vector array<double>").repartition(3)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 37)
    try:
        got = {}
        for r in expansion.nearest(vectors.where("word < 'w030' or word = 'w401'").select("word"), vectors, 4).orderBy("word", "rank").collect():
            got.setdefault(r["word"], []).append(r["near"])
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    with np.errstate(invalid="ignore"):
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = {f"w{i:03}": [f"w{j:03}" for j in sorted((j for j in range(400) if j != i), key=lambda j: (-(u[i] @ u[j]), j))[:4]] for i in range(30)}
    assert got == want

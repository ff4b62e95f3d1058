"""The program of the README, over files: corpus, index, searches, evaluation, citation statistics."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.operators import evaluation, expansion, graph, index, report, retrieval, segments, session
from foliospark.sources import corpus, scratch

#: A stop list of three languages, as a file would have it.
STOPWORDS = {"english": "the of and to in is that", "german": "der die das und nicht über für", "french": "le la les été à où d'une"}


@pytest.fixture
def folder(tmp_path):
    rows = [{"id": f"d{i:02d}", "title": f"Paper {i} über graphs", "paperAbstract": f"the test of method {i % 3} and die été results " + "rank " * (i % 5), "year": 2000 + i, "outCitations": [f"d{j:02d}" for j in range(i) if j % 3 == i % 3], "inCitations": []} for i in range(20)]
    (tmp_path / "corpus").mkdir()
    (tmp_path / "corpus" / "part-1").write_text("\n".join(map(json.dumps, rows)), "utf-8")
    (tmp_path / "stopwords.txt").write_text("\n".join(w for words in STOPWORDS.values() for w in words.split()), "utf-8")
    (tmp_path / "judged").write_text(json.dumps({"query": "test rank", "documents": [{"doc_id": f"d{i:02d}", "relevance": int(i % 5 > 2)} for i in range(20)]}), "utf-8")
    return f"file://{tmp_path}"


def test_program(spark, folder):
    with scratch.scope(spark):
        docs = corpus.numbered(corpus.documents(spark, f"{folder}/corpus/"), unique=True)
        stop = corpus.stopwords(spark, f"{folder}/stopwords.txt")
        assert set(stop) == {w for words in STOPWORDS.values() for w in words.split()}
        out, inn, nodes = graph.entries(docs, "outCitations"), graph.entries(docs, "inCitations"), docs.select("id")
        ranks = graph.pagerank(nodes, graph.edges(out, nodes)).join(docs.select("id", "doc_id"), "id")
        segments.save(index.build(docs, index.CORPUS_FIELDS, stop, stemmer=True, pagerank=ranks), f"{folder}/index")
        s = session.Search(segments.load(spark, f"{folder}/index"), model="okapi", properties=("title", "year"))
        words = {r["term"] for r in s.index.vocabulary.collect()}
        assert "graph" in words and not words & set(stop)
        shown = s.show("tests", 12, 5, 8)
        assert shown[0] == "Found 12 results" and sum("doc_id" in x.lower() or x.startswith("Title") or "title" in x.lower() for x in shown) >= 4
        asked = spark.createDataFrame([(0, "test rank")], "query_id int, query string")
        with s.with_(pagerank_weight=0.0).results(asked, 5) as best:
            assert [r["rank"] for r in best.orderBy("rank").collect()] == [1, 2, 3, 4, 5]
        judged = corpus.judgements(spark, f"{folder}/judged").join(docs.select(F.col("id").alias("doc"), "doc_id"), "doc").select(F.lit(0).alias("query_id"), "doc_id", "relevance")
        scores = evaluation.metrics(retrieval.scored(s.resolved(asked), s.index), judged).first()
        assert 0 < scores["avep"] <= 1 and 0 < scores["ndcg"] <= 1
        report.write_files(report.graph_report(out, inn, nodes), f"{folder}/stats")
        told = [r["value"] for r in spark.read.text(f"{folder}/stats/citations_stats").collect()]
        assert told[0] == "Documents: 20" and len(told) == 17
        assert [r["value"] for r in spark.read.text(f"{folder}/stats/out_edges").collect()][0].endswith("| Number of documents")


def test_doubled_ids_are_refused(spark):
    with pytest.raises(ValueError, match="stands 2 times"):
        corpus.numbered(spark.createDataFrame([("a",), ("b",), ("a",)], "id string"), unique=True)


def test_failures_of_lazy_searches(spark):
    ix = index.build(spark.createDataFrame([(0, "a dog"), (1, "a cat")], "doc_id long, text string"), {"text": "abstract"})
    asked = spark.createDataFrame([(0, "dog")], "query_id int, query string")
    broken = spark.createDataFrame([("dog", [1.0, 2.0]), ("cat", [1.0])], "word string, vector array<double>")
    failing = spark.range(1).select(F.lit("dog").alias("word"), F.raise_error(F.lit("no vectors")).cast("array<double>").alias("vector"))
    for vectors in (None, broken, failing):
        s = session.Search(ix, expansion="glove", vectors=vectors)
        with pytest.raises(expansion.QueryExpansionError):
            s.search(asked, 3)
        with pytest.raises(expansion.QueryExpansionError):
            session.grid(s, asked, spark.createDataFrame([(0, 0, 1)], "query_id int, doc_id long, relevance long"), ["glove"])
    with pytest.raises(KeyError):
        session.Search(ix, model="no such").search(asked, 3)


def test_results_leave_nothing(spark):
    ix = index.build(spark.range(50).select(F.col("id").alias("doc_id"), F.lit("a b").alias("text")), {"text": "abstract"})
    p = spark._jvm.org.apache.hadoop.fs.Path(scratch.shared_dir(spark))
    files = lambda: {f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)}
    before = files()
    with session.Search(ix, model="existential").results(spark.createDataFrame([(0, "a")], "query_id int, query string")) as found:
        assert found.count() == 50 and files() > before
    assert files() == before

"""Small cases worked out by hand from the definitions."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foliospark.config import Settings
from foliospark.functions import scalars, stems, tokens
from foliospark.operators import evaluation, expansion, graph, index, retrieval, segments, session
from foliospark.sources import corpus

DOCS = [(0, "red red fox 2001"), (1, "red dog 0"), (2, "blue dog dog fox 1999")]


@pytest.fixture(scope="module")
def built(spark):
    return index.build(spark.createDataFrame(DOCS, "doc_id long, text string"), {"text": "abstract"})


def terms(spark, *words):
    return spark.createDataFrame([(1, i, w, x) for i, (w, x) in enumerate(words)], "query_id int, pos int, term string, weight double")


def scores(df):
    return {r["doc_id"]: r["score"] for r in df.collect()}


def test_statistics(built):
    assert built.documents == 3 and built.avgdl == 4.0
    stats = {r["doc_id"]: r for r in built.doc_stats.collect()}
    assert [stats[i]["max_tf"] for i in range(3)] == [2, 1, 2]
    assert [stats[i]["vsm_weight"] for i in range(3)] == pytest.approx([0.7122076119851587, 1.2392549651298208, 0.8994314441761239])
    assert {r["term"]: r["df"] for r in built.vocabulary.collect()} == {"red": 2, "fox": 2, "dog": 2, "blue": 1, "2001": 1, "0": 1, "1999": 1}


def test_bm25(spark, built):
    q = terms(spark, ("blue", 1.0), ("dog", 1.0))
    assert scores(retrieval.bm25p(q, built)) == pytest.approx({1: 0.4054651081081644, 2: 0.7658785375376438})
    assert scores(retrieval.search(q, built, "okapi")) == pytest.approx({1: 0.529411765, 2: 1.0})


def test_vsm(spark, built):
    q = terms(spark, ("blue", 1.0), ("dog", 1.0))
    assert scores(retrieval.vsm(q, built)) == pytest.approx({1: 0.0, 2: 0.2254007855371173})
    assert scores(retrieval.search(q, built, "vsm")) == pytest.approx({1: 0.0, 2: 1.0})


def test_idf_zero_and_unknown_terms(spark, built):
    q = terms(spark, ("red", 1.0), ("fox", 1.0))
    assert scores(retrieval.search(q, built, "okapi")) == {0: 0.0, 1: 0.0, 2: 0.0}
    assert all(math.isnan(v) for v in scores(retrieval.search(q, built, "vsm")).values())
    q = terms(spark, ("red", 1.0), ("fox", 1.0), ("zzz", 0.5))
    assert scores(retrieval.search(q, built, "okapi")) == {0: 1.0, 1: 1.0, 2: 1.0}
    assert scores(retrieval.search(q, built, "vsm")) == {0: 0.0, 1: 0.0, 2: 0.0}


def test_a_repeat_doubles_a_weight(spark, built):
    twice = retrieval.search(terms(spark, ("blue", 1.0), ("dog", 1.0), ("dog", 1.0)), built, "okapi")
    heavy = retrieval.search(terms(spark, ("blue", 1.0), ("dog", 2.0)), built, "okapi")
    assert scores(twice) == pytest.approx(scores(heavy))


def test_existential_ignores_limits(spark, built):
    found = retrieval.search(terms(spark, ("dog", 1.0), ("fox", 1.0)), built, "existential", 1, 0.5)
    assert scores(found) == {0: 1.0, 1: 1.0, 2: 1.0}


def test_pagerank(spark):
    nodes = spark.createDataFrame([(i,) for i in range(4)], "id long")
    links = spark.createDataFrame([(0, 1), (0, 2), (1, 2), (2, 0)], "src long, dst long")
    one = {r["id"]: r["pagerank"] for r in graph.pagerank(nodes, links, iterations=1).collect()}
    assert one == pytest.approx({0: 0.303125, 1: 0.196875, 2: 0.409375, 3: 0.090625})
    end = {r["id"]: r["pagerank"] for r in graph.pagerank(nodes, links).collect()}
    assert end == pytest.approx({0: 0.36932353, 1: 0.20458155, 2: 0.37847587, 3: 0.04761905}, abs=1e-7)
    assert sum(end.values()) == pytest.approx(1)


def test_citation_counters(spark):
    nodes = spark.createDataFrame([("A",), ("B",), ("C",)], "id string")
    docs = spark.createDataFrame([("A", ["B", "B", "A", "C", "X"]), ("B", []), ("C", None)], "id string, outCitations array<string>")
    out = graph.entries(docs, "outCitations")
    a = graph.degrees(out, nodes).where("id = 'A'").first()
    assert (a["raw"], a["true"], a["loops"], a["repeats"]) == (4, 2, 1, 1)
    assert graph.not_found(out, nodes).where("id = 'A'").first()["missing"] == 1
    assert {(r["src"], r["dst"]) for r in graph.edges(out, nodes).collect()} == {("A", "B"), ("A", "C")}
    s = graph.edge_stats(out, graph.entries(docs.where("false"), "outCitations"), nodes).first()
    assert (s["sinks"], s["self_out_edges"], s["duplicate_out_edges"], s["inconsistent_in_edges"]) == (2, 1, 1, 4)


def test_average_precision_and_ndcg(spark):
    judged = spark.createDataFrame([(1, 1, 1), (1, 2, 0), (1, 3, 1), (1, 4, 1), (2, 1, 0)], "query_id int, doc_id long, relevance int")
    plain = spark.createDataFrame([(1, 1, 3.0), (1, 2, 2.0), (1, 3, 1.0), (2, 1, 1.0)], "query_id int, doc_id long, score double")
    mixed = plain.union(spark.createDataFrame([(1, 90, 9.0), (1, 91, 2.5)], plain.schema))
    for results in (plain, mixed):
        m = {r["query_id"]: r for r in evaluation.metrics(results, judged).collect()}
        assert m[1]["avep"] == pytest.approx(0.5555555555555556) and m[1]["ndcg"] == pytest.approx(0.7039180890341348)
        assert math.isnan(m[2]["avep"]) and math.isnan(m[2]["ndcg"])
    s = {r["metric"]: r for r in evaluation.summary(evaluation.metrics(plain, judged)).collect()}
    assert s["avep"]["average"] == s["avep"]["most"] == pytest.approx(0.5555555555555556)


def test_token_pipeline(spark):
    rows = spark.createDataFrame([("The Cats: RUNNING, a.b (x)",)], "text string")
    found = rows.select(F.explode(tokens.tokens(F.col("text"), tokens.TITLE)).alias("t"))
    assert [r["term"] for r in tokens.terms(found, "t", ["the"]).collect()] == ["cats", "running", "a", "b", "x"]
    q = spark.createDataFrame([(1, "a:b c-d")], "query_id int, query string")
    assert [r["term"] for r in tokens.query_terms(q).orderBy("pos").collect()] == ["a:b", "c", "d"]


@pytest.mark.parametrize("word, stem", [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("motoring", "motor"), ("hopping", "hop"), ("filing", "file"), ("happy", "happi"), ("relational", "relat"), ("triplicate", "triplic"), ("adjustment", "adjust"), ("controll", "control"), ("rate", "rate"), ("cats", "cat"), ("was", "was"), ("RUNNING", "RUNNING"), ("eeed", "eeed")])
def test_stems(word, stem):
    assert stems.stem(word) == stem


def test_json_and_display(spark):
    lines = spark.createDataFrame([('{"id":"a","title":"T","authors":[{"name":"X","ids":["1","2"]},{"name":null,"ids":null}],"year":2001}',), ("{bad",), ('{"title":"no id"}',)], "value string")
    d = corpus.parsed(lines)
    assert d.count() == 1
    shown = corpus.display(d).first()
    assert (shown["author_names"], shown["author_ids"], shown["year"], shown["record_bytes"]) == ("X,", "[1, 2],[]", 2001, 16 + 1 + 2 + 9)
    full = {r["term"] for r in index.token_rows(corpus.numbered(d), index.CORPUS_FIELDS).collect()}
    assert full == {"t", "x", "2001"}


def test_dense_ids(spark):
    d = corpus.numbered(spark.createDataFrame([(f"k{i:03d}",) for i in range(200)], "id string").repartition(7))
    assert [(r["id"], r["doc_id"]) for r in d.orderBy("id").collect()] == [(f"k{i:03d}", i) for i in range(200)]


def test_expansion(spark):
    vectors = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.9, 0.1]), ("c", [0.0, 1.0]), ("zero", [0.0, 0.0])], "word string, vector array<float>")
    q = spark.createDataFrame([(1, 0, "a"), (1, 1, "none")], "query_id int, pos int, token string")
    found = [(r["pos"], r["cand"], r["term"], r["weight"]) for r in expansion.by_vectors(q, vectors).orderBy("pos", "cand").collect()]
    assert found == [(0, 0, "a", 1.0), (0, 1, "b", 0.5), (0, 2, "c", 0.5), (1, 0, "none", 1.0)]
    cap = [(r["pos"], r["term"]) for r in expansion.capped(expansion.by_vectors(q, vectors)).orderBy("pos").collect()]
    assert cap == [(0, "a"), (1, "b"), (2, "none")]


def test_cap_compares_case(spark):
    c = spark.createDataFrame([(1, 0, 0, "Fox", 1.0), (1, 0, 1, "fox", 0.5), (1, 0, 2, "FOX", 0.5)], "query_id int, pos int, cand int, term string, weight double")
    assert [(r["term"], r["weight"]) for r in expansion.capped(c).orderBy("pos").collect()] == [("fox", 1.0), ("fox", 0.5)]


def test_session(spark, built):
    s = session.Search(built, pagerank_weight=0.0, properties=("text",))
    assert s.ask("blue (dog)", 1).first()["text"] == DOCS[2][1]
    assert s.with_(model="vsm").model == "vsm" and s.model == "okapi"
    with pytest.raises(index.IndexNotLoadedError):
        session.Search(None).ask("x")
    with pytest.raises(expansion.QueryExpansionError):
        session.Search(built, expansion="glove").ask("x")


def test_saved_index(spark, built, tmp_path):
    path = f"file://{tmp_path}/ix"
    assert not segments.exists(spark, path)
    segments.save(built, path)
    again = segments.load(spark, path)
    assert (again.documents, again.avgdl) == (3, 4.0)
    q = terms(spark, ("blue", 1.0), ("dog", 1.0))
    assert scores(retrieval.search(q, again, "okapi")) == pytest.approx(scores(retrieval.search(q, built, "okapi")))
    assert "PushedFilters: [IsNotNull(term), EqualTo(term,dog)]" in again.postings.where("term = 'dog'")._jdf.queryExecution().toString()
    assert segments.delete(spark, path) and not segments.exists(spark, path)
    with pytest.raises(index.IndexNotLoadedError):
        segments.load(spark, path)


def test_settings():
    s = Settings.parse(["# c", "USE_STEMMER = false", "RETRIEVAL_MODEL = VSM", "INDEX_DIR = /x/y", "PAGERANK_THRESHOLD = 1E-6", "QUERY_EXPANSION_ENABLED = true", "UNKNOWN = 1"])
    assert (s.use_stemmer, s.model, s.index_dir, s.pagerank_threshold, s.expansion) == (False, "vsm", "/x/y/", 1e-6, "glove")
    assert Settings(retrieval_model="?").model == "existential"


def test_scalars(spark):
    cases = {7_384_000_000_000: "2h 3m", 61_000_000_000: "1m 1s", 25_400_000_000: "25s", 2_540_000_000: "2.5s", 1_234_000_000: "1.23s", 55_000_000: "55ms", 2_540_000: "2.5ms", 1_234_000: "1.23ms"}
    df = spark.createDataFrame([(n,) for n in cases], "ns long").select("ns", scalars.duration(F.col("ns")).alias("s"))
    assert {r["ns"]: r["s"] for r in df.collect()} == cases
    assert scalars.round_half_up(0.12345, 4) == 0.1235 and math.isnan(scalars.round_half_up(math.nan, 2))
    assert scalars.stamped("a.b.txt", "2020-01-01T10:20:30Z") == "a.b_2020-01-01T10.20.30Z.txt"
    assert scalars.byte_size("2GB") == 2 * 1024**3 and scalars.byte_size("1.5 KB") == 1536


def test_stopword_file(spark, tmp_path):
    (tmp_path / "words").write_text("the\nund\nthe\nκαι")
    assert corpus.stopwords(spark, f"file://{tmp_path}/words") == ["the", "und", "και"]
    with pytest.raises(ValueError):
        corpus.stopwords(spark, f"file://{tmp_path}/words", 2)


def test_empty_corpus(spark):
    i = index.build(spark.createDataFrame([], "doc_id long, text string"), {"text": "abstract"})
    assert i.documents == 0 and retrieval.search(terms(spark, ("a", 1.0)), i, "existential").count() == 0


def test_stems_as_columns(spark):
    """The steps as expressions against the plain algorithm, over made-up words with every suffix."""
    rng = random.Random(1)
    ends = [*(e for e, _ in stems.STEP2 + stems.STEP3), *stems.STEP4, "ed", "ing", "eed", "s", "sses", "ies", "y", "e", "ll", "at", "bl", "iz"]
    words = {"".join(rng.choice("aeiouybcdlstrnw") for _ in range(rng.randrange(7))) + rng.choice(ends) + rng.choice(["", "", "s", "ed", "ing", "ness"]) for _ in range(8000)}
    words |= {"yyes", "syyyyx", "Yesss", "ÜBERed", "naïvely", "a\nbing", "", "abc", "HOPPING", "hopping", "agreed", "𝄞ings"}
    found = stems.stemmed(spark.createDataFrame([(w,) for w in [*words, None]], "t string"), "t", "stem")
    assert {r["t"]: r["stem"] for r in found.collect()} == {w: stems.stem(w) for w in words} | {None: None}
    assert "Python" not in found._jdf.queryExecution().toString() and "ArrowEval" not in found._jdf.queryExecution().toString()

"""Segments, merges, versions, blocks and bounds."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import blocks, index, retrieval, segments, versions
from foliospark.sources import scratch

TEXT = {"text": "abstract"}
WORDS = [f"w{i}" for i in range(40)]


def corpus(spark, n=600, seed=3):
    rng = random.Random(seed)
    rows = [(i, " ".join(["all", *(w for j, w in enumerate(WORDS) for _ in range(rng.randrange(5) if rng.random() < 1 / (1 + j / 4) else 0))])) for i in range(n)]
    return spark.createDataFrame([*rows, (n, None), (n + 1, "")], "doc_id long, text string")


def same(a, b):
    assert sorted(a.columns) == sorted(b.columns)
    key = lambda df: sorted(str([round(v, 9) if isinstance(v, float) else v for v in r]) for r in df.select(*sorted(a.columns)).collect())
    assert key(a) == key(b)


@pytest.fixture(scope="module")
def docs(spark):
    return scratch.materialize(corpus(spark), "docs")


@pytest.fixture(scope="module")
def whole(spark, docs):
    with pytest.MonkeyPatch.context() as m:
        m.setattr(blocks, "NEAR", 32)
        return index.build(docs, TEXT, ["w3"], rows=200)


def queries(spark, *rows):
    return spark.createDataFrame([(q, i, t, w) for i, (q, t, w) in enumerate(rows)], "query_id int, pos int, term string, weight double")


def test_blocks_hold_the_postings(spark, docs, whole):
    plain = index.postings(docs, TEXT, ["w3"])
    same(whole.postings, plain)
    found = whole.blocks.collect()
    assert whole.parts > 5 and max(r["n"] for r in found) <= blocks.BLOCK
    parts = {r["part"] for r in found if r["term"] == "all"}
    assert len(parts) > 1, "a term of more postings than a part holds is dealt over parts"
    for r in found:
        assert r["docs"][0] == 0 and r["docs"] == sorted(r["docs"]) and len(r["docs"]) == len(r["tfs"]) == r["n"]
        ratios = [2 * (0.25 + 0.75 * length / whole.avgdl) / tf for tf, length in zip(r["tfs"], r["lengths"])]
        assert math.isclose(min(ratios), r["ratio"])


def test_no_row_grows_with_a_term(spark):
    many = spark.range(30_000).select(F.col("id").alias("doc_id"), F.lit("the word").alias("text"))
    ix = index.build(many, TEXT)
    sizes = ix.blocks.select((F.length(F.to_json(F.struct("*")))).alias("n")).agg(F.max("n"), F.count("*")).first()
    assert sizes[0] < 64_000 and sizes[1] >= 2 * 30_000 // blocks.BLOCK


def test_parts_are_ranges_of_terms(whole):
    spans = whole.blocks.where("term <> 'all'").groupBy("part").agg(F.min("term").alias("a"), F.max("term").alias("b")).orderBy("part").collect()
    ends = [(r["a"], r["b"]) for r in spans]
    assert ends == sorted(ends)


def test_merge_equals_the_whole(spark, docs, whole, tmp_path):
    path = f"file://{tmp_path}/ix"
    segments.save(index.build(docs.where("doc_id < 200"), TEXT, ["w3"], rows=200), path)
    for a, b in ((200, 201), (201, 9999)):
        segments.append(spark, path, docs.where(f"doc_id >= {a} and doc_id < {b}"), TEXT)
    apart = segments.load(spark, path)
    q = queries(spark, (1, "w1", 1.0), (1, "w30", 1.0), (2, "all", 1.0))
    for ix in (apart, segments.merge(spark, path, rows=200)):
        same(ix.postings, whole.postings)
        same(ix.vocabulary.select("term", "df"), whole.vocabulary.select("term", "df"))
        same(ix.doc_stats, whole.doc_stats)
        assert (ix.documents, ix.avgdl, ix.stopwords) == (whole.documents, whole.avgdl, whole.stopwords)
        for model in ("vsm", "okapi"):
            same(retrieval.search(q, ix, model, 20, digits=9), retrieval.search(q, whole, model, 20, digits=9))
        same(retrieval.top(retrieval.bounded(q, ix, 5), 5, 9), retrieval.top(retrieval.bm25p(q, whole), 5, 9))
    with pytest.raises(ValueError):
        segments.append(spark, path, docs.where("doc_id = 7"), TEXT)
    before = segments.load(spark, path).blocks.count()
    assert versions.vacuum(spark, path) and segments.load(spark, path).blocks.count() == before
    assert versions.vacuum(spark, path) == []


def test_a_failed_change_leaves_the_version_before(spark, whole, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/ix"
    segments.save(whole, path)
    with pytest.raises(FileExistsError):
        segments.save(whole, path)
    rank = spark.createDataFrame([(1, 0.5)], "doc_id long, pagerank double")

    def broken(*_):
        raise OSError("no more room")

    for step in ("commit", "fresh"):
        with monkeypatch.context() as m:
            m.setattr(versions, step, broken)
            with pytest.raises(OSError):
                segments.update_pagerank(spark, path, rank)
        assert segments.load(spark, path).doc_stats.agg(F.max("pagerank")).first()[0] == 0
    assert segments.update_pagerank(spark, path, rank).doc_stats.where("pagerank > 0").count() == 1


@pytest.mark.parametrize("rows", [[(1, "w0", 1.0), (1, "w1", 1.0)], [(1, "w0", 2.0), (1, "w39", 0.5), (1, "none", 1.0)], [(1, "all", 1.0), (1, "w5", 1.0)], [(1, "all", 1.0)], [(1, "none", 1.0)], [(1, "w0", -1.0), (1, "w1", 1.0)], [(1, "w7", 1.0), (2, "w0", 1.0), (2, "w1", 1.0), (2, "w2", 3.0)]])
@pytest.mark.parametrize("k", [1, 7, 1000])
def test_bounds_keep_the_best(spark, whole, rows, k):
    q = queries(spark, *rows)
    same(retrieval.top(retrieval.bounded(q, whole, k), k, 9), retrieval.top(retrieval.bm25p(q, whole), k, 9))


def test_bounds_skip_most_postings(spark):
    """Two words that stand in half of all documents: under a third of their postings are read."""
    n = 40_000
    often = lambda seed, most: F.repeat(F.lit(f"{seed} "), F.greatest(F.lit(0), F.floor(F.log(F.rand(ord(seed))) * -most)).cast("int"))
    docs = scratch.materialize(spark.range(n).select(F.col("id").alias("doc_id"), F.concat(often("a", 1.4), often("b", 1.4), F.repeat(F.lit("x "), (F.rand(9) * 40).cast("int"))).alias("text")), "docs")
    ix = index.build(docs, TEXT)
    q = retrieval.resolve(queries(spark, (1, "a", 1.0), (1, "b", 1.0)), ix)
    bounds = retrieval._bounds(q, ix)
    assert all(b.df > 0.4 * n for b in bounds)
    best = retrieval.top(retrieval.bounded(q, ix, 10), 10, 9)
    same(best, retrieval.top(retrieval.bm25p(q, ix), 10, 9))
    constant = sum(b.gain / (retrieval.K1 + 1) for b in bounds)
    threshold = best.agg(F.min("score")).first()[0] - constant
    seeds = 2 * math.sqrt(16 * 10 * n)
    read = sum(ix.blocks.where((F.col("term") == t) & (F.col("ratio") <= cut)).agg(F.sum("n")).first()[0] for _, t, _, _, cut in retrieval.reach(bounds, {1: threshold}))
    assert (read + seeds) / sum(b.df for b in bounds) < 0.3


def test_each_document_is_tokenised_once(spark, docs):
    seen = spark.sparkContext.accumulator(0)

    def passing(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    index.build(docs.mapInArrow(passing, docs.schema).select("doc_id", F.col("text")), {"text": "abstract"})
    n = docs.count()
    assert n <= seen.value <= 2 * n  # the texts once, and the list of doc_ids once


def test_ranks_of_all_results(spark):
    rows = spark.range(5000).select((F.col("id") % 3).cast("int").alias("query_id"), F.col("id").alias("doc_id"), F.when(F.col("id") % 50 == 0, F.lit(float("nan"))).otherwise((F.col("id") * 7 % 101).cast("double")).alias("score"))
    found = retrieval.top(rows, None)
    same(found, retrieval.top(rows, 10**6))
    assert "Window" not in found._jdf.queryExecution().optimizedPlan().toString().split("Join")[1].split("query_id")[0]


def test_kept_splitters_place_new_terms(spark):
    words = spark.createDataFrame([(f"t{i:04d}", 1 + 50 * (i == 500)) for i in range(1000)], "term string, df long")
    size, parts = 20, 53
    places = scratch.materialize(blocks.placed(blocks.ranged(words), size), "places")
    marks = scratch.materialize(blocks.splitters(places), "marks")
    again = {r["term"]: (r["part"], r["cuts"]) for r in blocks.placed_by(words, marks).collect()}
    first = {r["term"]: (r["part"], r["cuts"]) for r in places.collect()}
    assert again["t0500"] == first["t0500"] and first["t0500"][1] == 3
    assert all(abs(again[t][0] - first[t][0]) <= 1 for t in first)
    new = blocks.placed_by(spark.createDataFrame([("a", 1), ("t0003x", 1), ("t0500x", 1), ("z", 9)], "term string, df long"), marks).collect()
    got = {r["term"]: r["part"] for r in new}
    assert got["a"] == 0 and got["t0003x"] == again["t0003"][0] and got["z"] == again["t0999"][0] and abs(got["t0500x"] - first["t0501"][0]) <= 1

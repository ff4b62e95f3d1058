"""The pipeline's stages on odd rows: nulls, repeats, ties, very long texts, further columns; and what toxicity keeps."""

import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from foliospark.llm import toxicity
from foliospark.llm.shared import materialize, table

SF = "/root/testdata/sf0.001"


def test_toxicity_keeps_what_scores_low(spark):
    sf = SF.replace("0.001", "0.01")  # enough labels to learn from
    docs = table(spark, sf, "documents")
    lexicon = toxicity.learn(docs, table(spark, sf, "labels"))
    auto = lexicon.automaton()
    want = Counter(r["doc_id"] for r in docs.collect() if toxicity.score(toxicity.fold(r["text"] or ""), auto, lexicon) < 0.7)
    got = Counter(r["doc_id"] for r in corpus_pipeline.without_toxic(spark, docs, sf).select("doc_id").collect())
    assert got == want and 0 < sum(got.values()) < docs.count()
    toxic = {r["doc_id"] for r in table(spark, sf, "labels").where("toxic = 1").collect()}
    clean = {r["doc_id"] for r in table(spark, sf, "labels").where("toxic = 0").collect()}
    # some thirty toxic rows to learn from here
    assert len(toxic & got.keys()) <= 0.5 * len(toxic) and len(clean & got.keys()) >= 0.99 * len(clean)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(12)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    base, passage = say(80), say(60)
    near = base.split()
    near[40] = "other"
    rows = [(1, None), (2, ""), (3, " \n "), (None, None), (None, base), (5, base), (5, base), (4, " ".join(near)), (6, f"{say(40)} {passage} {say(40)}"), (7, f"{say(40)} {passage} {say(40)}"), (8, say(30_000)), (9, "z" * 50_000), (9, "different text"), (10, "one word"), (11, "one word")]
    names = {"rid": "long", "sid": "string", "group": "int", "score": "double", "key": "long", "ids": "string", "part": "int", "_stays": "boolean", "component": "long"}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.withColumns({n: F.lit(None).cast(t) for n, t in names.items()}).withColumn("n_chars", F.length("text")).repartition(3)


def test_odd_rows(spark, odd):
    kept = materialize(corpus_pipeline.without_toxic(spark, odd, SF), "odd")
    assert kept.columns == odd.columns and kept.exceptAll(odd).count() == odd.exceptAll(kept).count() == 0
    one = materialize(corpus_pipeline.without_near_copies(spark, kept, SF), "odd")
    assert one.columns == odd.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in one.collect()) == [(False, i) for i in (1, 2, 3, 4, 6, 7, 8, 9, 9, 10)] + [(True, 0)]
    assert {r["doc_id"] for r in one.where("text is not null and doc_id is null").collect()} == set()
    cut = materialize(corpus_pipeline.without_repeats(spark, one, SF), "odd")
    assert cut.columns == odd.columns and cut.count() == one.count()
    before, after = ({(r["doc_id"], len(r["text"] or "")) for r in t.collect()} for t in (one, cut))
    assert (9, 0) in after and (9, 14) in after and after >= {(8, n) for i, n in before if i == 8}
    passage = [r["text"] for r in cut.where("doc_id in (6, 7)").collect()]
    assert len(passage) == 2 and all(len(t) < 40 * 7 * 2 + 10 for t in passage)
    assert all(r["n_chars"] == len(r["text"]) for r in cut.collect())
    pieces = corpus_pipeline.packed(spark, cut, SF)
    assert pieces.where("start = 0").count() == cut.count() and pieces.agg(F.sum("length")).first()[0] == pieces.where("start = 0").agg(F.sum("doc_tokens")).first()[0]

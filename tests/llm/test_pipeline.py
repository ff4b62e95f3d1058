"""The pipeline's stages one after another, each against a plain version on its own input."""

import hashlib
from collections import Counter

import corpus_pipeline
from foliospark.llm.shared import materialize, table

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, before = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    toxic = {r["doc_id"] for r in table(spark, SF, "labels").where("toxic = 1").collect()}
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "ngram_jaccard", "suffix_dedup", "packing"]

    kept = materialize(corpus_pipeline.without_toxic(spark, docs, SF), "a")
    assert kept.columns == columns
    left = {r["doc_id"]: r["text"] for r in kept.collect()}
    assert len(before.keys() - left.keys()) <= 3 * len(toxic) + 20 and all(before[i] == t for i, t in left.items())

    single = materialize(corpus_pipeline.without_near_copies(spark, kept, SF), "b")
    assert single.columns == columns
    texts = [r["text"] for r in single.collect() if r["text"].split()]
    assert len(texts) == len(set(texts)) and set(texts) == {t for t in left.values() if t.split()} - (set(left.values()) - set(texts))

    cut = materialize(corpus_pipeline.without_repeats(spark, single, SF), "c")
    assert cut.columns == columns and cut.count() == single.count()
    own = {r["doc_id"]: r["text"].encode() for r in single.collect()}
    seen = Counter(hashlib.md5(b[p : p + 200]).digest() for b in own.values() for p in range(len(b) - 199))
    for r in cut.collect():
        b, gone = own[r["doc_id"]], set()
        for p in range(len(b) - 199):
            if seen[hashlib.md5(b[p : p + 200]).digest()] > 1:
                gone.update(range(p, p + 200))
        assert r["text"] == bytes(x for i, x in enumerate(b) if i not in gone).decode("utf-8", "ignore") and r["n_chars"] == len(r["text"])

    pieces = corpus_pipeline.packed(spark, cut, SF)
    assert pieces.select("doc_id").distinct().count() == cut.count()
    assert corpus_pipeline.run(spark, SF).count() == pieces.count()


def test_empty(spark):
    docs = table(spark, SF, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0

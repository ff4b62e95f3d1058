"""Columns of other types, and one text that is longer than all that may be learnt from."""

import numpy as np

from foliospark.llm import neighbours, packing, search, toxicity
from foliospark.llm.queries import vocabulary
from pyspark.sql import functions as F


def test_vectors_of_doubles(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6))
    x[40:] = x[:40] + 1e-3 * rng.normal(size=(40, 6))
    rows = [(i, v.tolist(), i % 2) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["component_id"] for r in neighbours.near_duplicates(df).collect()}
    assert all(got[i + 40] == got[i] for i in range(40))
    found = search.search(df, F.col("vec_id") % 20 == 0, 3).collect()
    for r in found:
        order = sorted((-float(x[r["query_id"]] @ x[j]), j) for j in range(80) if j != r["query_id"])
        assert r["vec_id"] == order[r["rank"] - 1][1]
    assert len(found) == 12


def test_packing_of_named_documents(spark):
    df = spark.createDataFrame([("b", "one two"), ("a", None), (None, "three")], "doc_id string, text string")
    got = packing.pack(df, vocabulary()).collect()
    assert sorted(str(r["doc_id"]) for r in got) == ["None", "a", "b"]


def test_one_long_text_does_not_unlearn_the_rest(spark):
    bad = [i % 2 for i in range(300)]
    docs = spark.createDataFrame([(i, f"word{i % 13} {'vile' if t else 'mild'} thing {i % 7} " * 3) for i, t in enumerate(bad)] + [(1000 + i, "x" * 5000) for i in range(40)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, t) for i, t in enumerate(bad)] + [(1000 + i, 0) for i in range(40)], "doc_id long, toxic int")
    assert toxicity.learn(docs, labels, characters=3000).terms
    assert not toxicity.learn(docs, labels, characters=3).terms

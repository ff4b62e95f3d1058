"""Search inside large groups of copies, where codes can't tell the rows apart, against brute force."""

from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from foliospark.llm import search


def test_groups_of_copies(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((2000, 64))
    x[:600] = x[0]  # equal: the smallest vec_ids win
    x[600:1200] = x[600] + 0.02 * rng.standard_normal((600, 64))
    x[1200:1500] = x[1200] + 0.1 * rng.standard_normal((300, 64))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in search.search(df, F.col("vec_id") % 40 == 0, 20).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    want = {}
    for q in range(0, 2000, 40):
        s = search.products(x.astype(float), x[q].astype(float))
        want[q] = [i for i in np.lexsort((np.arange(2000), -s)).tolist() if i != q][:20]
    hits = sum(len(set(got[q]) & set(want[q])) for q in want)
    assert (hits, dict(got)) == (1000, want)


def test_shared_ids_and_widths(spark):
    rows = [(0, [1.0, 0.0]), (0, [0.0, 3.0]), (1, [2.0, 2.0]), (2, [5.0, 0.0, 1.0]), (20, [1.0, 0.0, 0.0]), (3, [1.0, 1.0]), (3, [1.0, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = sorted(map(tuple, search.search(df, F.col("vec_id") % 20 == 0, 20).collect()))
    # 0 is [0, 3], the smaller vector, and 3 is [1, 0.5]
    assert got == [(0, 1, 1, 6.0), (0, 2, 3, 1.5), (20, 1, 2, 5.0)]


def test_recall_on_full_blocks(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((9000, 32)).astype(np.float32)  # two blocks
    df = spark.createDataFrame([(i, [float(v) for v in e]) for i, e in enumerate(x)], "vec_id long, embedding array<float>")
    got = defaultdict(set)
    for r in search.search(df, F.col("vec_id") % 300 == 0, 20).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in range(0, 9000, 300):
        s = x.astype(float) @ x[q].astype(float)
        s[q] = -np.inf
        hits += len(got[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / 600 >= 0.9

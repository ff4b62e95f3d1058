"""Steps that must grow no faster than their input: what a task holds, and what is shuffled."""

from pyspark.sql import functions as F

from foliospark.functions import stems
from foliospark.operators import blocks
from foliospark.sources import scratch


def test_postings_are_shuffled_once_to_bounded_tasks(spark):
    posts = spark.range(4000).select(F.concat(F.lit("t"), F.pmod(F.floor(F.col("id") * F.col("id") / 999), F.lit(97))).alias("term"), "id", F.lit(1).cast("long").alias("tf"), F.lit(9).cast("long").alias("length"))
    posts = posts.withColumnRenamed("id", "doc_id").union(spark.range(8192 * 4).select(F.lit("all"), F.col("id") * 40, F.col("id") % 5 + 1, F.col("id") % 7 + 5))
    posts = scratch.materialize(posts, "posts")
    vocab = scratch.materialize(posts.groupBy("term").agg(F.count("*").alias("df")), "vocab")
    size, parts = blocks.part_size(vocab, 1000)
    places = scratch.materialize(blocks.placed(blocks.ranged(vocab), size), "places")
    held = blocks.located(posts, places, parts)
    # before, postings met their places in one shuffle and went to their parts in another
    plan = held._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange hashpartitioning") == 2, plan
    most = held.where("term = 'all'").groupBy("part").count().agg(F.max("count"), F.count("*")).first()
    assert most[0] < 4 * size and most[1] > 5
    found = blocks.gathered(blocks.blocked(held, 7.0), parts)
    assert sorted(map(tuple, blocks.unrolled(found).collect())) == sorted(map(tuple, posts.collect()))
    rows = found.collect()
    assert all(r["n"] == len(r["docs"]) <= blocks.BLOCK and r["docs"] == sorted(r["docs"]) and r["docs"][0] == 0 for r in rows)
    by_block = sorted((r["part"], r["term"], r["block"], r["ratio"]) for r in rows)
    assert all(a[:2] != b[:2] or b[2] == a[2] + 1 and b[3] >= a[3] for a, b in zip(by_block, by_block[1:], strict=False))


def test_documents_are_dealt_by_megabytes(spark, tmp_path):
    spark.range(60).select("id", F.expr("array_join(transform(sequence(1, 30000), x -> md5(concat(id, '.', x))), ' ')").alias("text")).write.parquet(str(tmp_path / "d"))
    assert scratch.spread(spark.read.parquet(str(tmp_path / "d"))) > 8  # one task of 256 MB before


def test_only_the_nearest_of_a_block_are_looked_at(spark):
    import numpy as np

    from foliospark.operators import expansion

    class Counted(list):
        seen = 0

        def __getitem__(self, i):
            Counted.seen += 1
            return super().__getitem__(i)

    x = np.random.default_rng(1).normal(size=(500, 8))
    x[100:110] = x[100]  # ties
    x /= np.sqrt((x * x).sum(1, keepdims=True))
    best = expansion._Best(list(range(50)), x[:50], 3)
    for a in range(0, 500, 100):
        best.meet(Counted(range(a, a + 100)), x[a : a + 100])
    sims = x[:50] @ x.T
    sims[np.arange(50), np.arange(50)] = -np.inf
    for i in range(50):
        assert [best.near[i, r] for r in range(3)] == sorted(range(500), key=lambda j: (-round(sims[i, j], 12), j))[:3]
    assert Counted.seen < 50 * 5 * 8  # every vector of the first block before
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "word long, vector array<double>")
    asked = vectors.where("word % 20 = 0")
    apart, sent = (sorted(map(tuple, expansion.nearest(asked, vectors, block=b).select("word", "near", "rank").collect())) for b in (8, 4096))
    assert apart == sent


def test_sums_of_queries_need_no_shuffle(spark):
    from foliospark.operators import index, retrieval

    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.expr("concat('all w', id % 7, ' v', id % 11)").alias("text"))
    ix = index.build(docs, {"text": "abstract"})
    rows = [(q, p, t, 1.0) for q in range(9) for p, t in enumerate(("all", f"w{q % 7}", "v3"))]
    sums = retrieval._matched(retrieval.resolve(spark.createDataFrame(rows, "query_id int, pos int, term string, weight double"), ix), ix).groupBy("query_id", "doc_id").agg(F.sum("tf").alias("n"))
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(query_id" not in plan and plan.count("Exchange hashpartitioning(doc_id") == 1, plan
    assert sums.count() == 9 * 300 and sums.agg(F.sum("n")).first()[0] == sum(300 + sum(d % 7 == q % 7 for d in range(300)) + sum(d % 11 == 3 for d in range(300)) for q in range(9))


def test_letters_of_a_word_are_told_apart_once(spark):
    """And words that no step can change stay out of the dictionary; odd letters and each kind of y stem as one by one."""
    words = ["boyyish", "syzygies", "happyy", "yyying", "Yelled", "élision", "buyer", "relational", "thing", "erble", "zoom", "𝔞tional", "a\ning", "flyyed", "sky", "toyly"]
    found = stems.stemmed(spark.createDataFrame([(w,) for w in words], "t string"), "t", "stem")
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 3
    assert {r["t"]: r["stem"] for r in found.collect()} == {w: stems.stem(w) for w in words}
    assert not {w for w in words if stems.porter(w) != w and w[-1] not in stems.LAST}

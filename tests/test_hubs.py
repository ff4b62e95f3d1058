"""PageRank with the links of large sources dealt evenly; nearest words in blocks; scopes in threads."""

import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.operators import expansion, graph, index, retrieval
from foliospark.sources import scratch


def star(spark, leaves):
    """A hub that links to all leaves, of which some link back and to each other."""
    nodes = spark.range(leaves + 1).select("id")
    out = spark.range(1, leaves + 1).select(F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    back = spark.range(1, leaves + 1).where("id % 3 = 0").select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst"))
    side = spark.range(2, leaves + 1).where("id % 2 = 0").select(F.col("id").alias("src"), (F.col("id") - 1).alias("dst"))
    return nodes, out.union(back).union(side)


def ranks(df):
    return {r["id"]: r["pagerank"] for r in df.collect()}


@pytest.mark.parametrize("options", [{"iterations": 3}, {}])
def test_a_hub_dealt_evenly(spark, options):
    nodes, links = star(spark, 3000)
    dealt, whole = ranks(graph.pagerank(nodes, links, hub=100, **options)), ranks(graph.pagerank(nodes, links, hub=10**9, **options))
    assert dealt == pytest.approx(whole, rel=1e-9) and sum(dealt.values()) == pytest.approx(1)


def test_hub_links_lie_in_even_tasks(spark, monkeypatch):
    made = {}
    plain = graph.materialize
    monkeypatch.setattr(graph, "materialize", lambda df, name: made.setdefault(name, (plain(df, name), df.rdd.glom().map(len).collect() if name == "hubs" else None))[0])
    nodes, links = star(spark, 20_000)
    graph.pagerank(nodes, links, iterations=1)
    counts = made["hubs"][1]
    assert sum(counts) == 20_000 and max(counts) < 1.1 * min(counts)


def test_ranks_with_other_degrees(spark):
    nodes, links = star(spark, 300)
    degree = links.groupBy(F.col("src").alias("id")).agg((F.count("*") * 2).alias("degree"))
    assert ranks(graph.pagerank(nodes, links, iterations=4, out_degree=degree, hub=10)) == pytest.approx(ranks(graph.pagerank(nodes, links, iterations=4, out_degree=degree)), rel=1e-9)
    with pytest.raises(ValueError):
        graph.pagerank(nodes, links, iterations=1, out_degree=degree.where("id <> 0"))


@pytest.mark.parametrize("block", [7, 1000])
def test_nearest_words_in_blocks(spark, block):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(120, 6))
    x[5], x[6], x[80] = 0, x[7], x[7] * 2
    vectors = spark.createDataFrame([(f"w{i:03d}", v.tolist()) for i, v in enumerate(x)], "word string, vector array<double>")
    asked = [f"w{i:03d}" for i in range(0, 120, 2)] + ["unknown", "w006", "w007"]
    found = {}
    for r in expansion.nearest(spark.createDataFrame([(w,) for w in asked], "word string"), vectors, 3, block).collect():
        found.setdefault(r["word"], {})[r["rank"]] = (r["near"], r["similarity"])
    unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)
    for i in sorted({int(w[1:]) for w in asked if w != "unknown"} - {5}):
        sims = sorted((-round(float(unit[i] @ unit[j]), 9), f"w{j:03d}") for j in range(120) if j not in (i, 5))[:3]
        got = found[f"w{i:03d}"]
        assert [got[r][0] for r in (1, 2, 3)] == [n for _, n in sims]
        assert [-got[r][1] for r in (1, 2, 3)] == pytest.approx([x for x, _ in sims])
    assert "w005" not in found and "unknown" not in found


def files(spark):
    p = spark._jvm.org.apache.hadoop.fs.Path(scratch.shared_dir(spark))
    return {f.getPath().getName() for f in p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)}


def test_scopes_in_threads(spark):
    """Each query owns what it writes: ten at once give what one gives, and leave nothing when their scopes end."""
    docs = scratch.materialize(spark.range(200).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a"), F.col("id") % 7, F.col("id") % 11).alias("text")), "docs")
    before, results, errors = files(spark), {}, []

    def ask(i):
        try:
            with scratch.scope(spark):
                ix = index.build(docs, {"text": "abstract"})
                q = spark.createDataFrame([(1, 0, str(i % 5), 1.0)], "query_id int, pos int, term string, weight double")
                found = retrieval.search(q, ix, "existential")
                results[i] = sorted(r["doc_id"] for r in found.collect())
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    threads = [threading.Thread(target=ask, args=(i,)) for i in range(10)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert not errors
    assert all(results[i] == [n for n in range(200) if str(i % 5) in ("a", str(n % 7), str(n % 11))] for i in range(10))
    assert files(spark) == before


def test_a_failed_write_is_deleted(spark):
    before = files(spark)
    with pytest.raises(Exception), scratch.scope(spark):
        scratch.materialize(spark.range(10).select(F.raise_error(F.lit("no"))), "bad")
    assert files(spark) == before


def test_kept_tables_go_to_the_scope_around(spark):
    before = files(spark)
    with scratch.scope(spark):
        with scratch.scope(spark) as inner:
            kept, gone = inner.keep(scratch.materialize(spark.range(3), "kept")), scratch.materialize(spark.range(3), "gone")
        assert kept.count() == 3 and gone._folio_path.rsplit("/", 1)[1] not in files(spark)
    assert files(spark) == before

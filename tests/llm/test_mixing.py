"""The mix against SQL, a plain water level, and odd rows."""

import re

import duckdb
import pytest
from pyspark.sql import functions as F

from foliospark.llm import mixing
from foliospark.llm.queries import QUERIES, SQL

SCHEMA = "doc_id long, text string, source string, rate string"


def plain_targets(sizes, weights=(5, 2, 1), share=1.5, most=2.0):
    """Shares by weight, resharing what is above a bound, until nothing is."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), share * sum(sizes.values())
    while open_:
        w = sum(weight[s] for s in open_)
        above = {s for s in open_ if left * weight[s] / w > most * sizes[s]}
        if not above:
            target |= {s: left * weight[s] / w for s in open_}
            break
        target |= {s: most * sizes[s] for s in above}
        left -= sum(most * sizes[s] for s in above)
        open_ -= above
    return target


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{sf}/documents.parquet'")
    ours = QUERIES["op13_mixing"](spark, sf).toPandas().sort_values("doc_id").reset_index(drop=True)
    theirs = c.sql(SQL["op13_mixing"]).df()[list(ours.columns)].sort_values("doc_id").reset_index(drop=True)
    assert len(ours) == 200
    for name in ours.columns:
        assert ours[name].tolist() == theirs[name].tolist(), name


def test_odd_rows(spark):
    rows = [(i, "a b\tc\x0bd\x1fe " * (i % 7), ["z", "ä", "a", "", None, "𝄞", "￿"][i % 7], "x") for i in range(400)]
    rows += [(None, None, "empty", None), (None, "one two", None, None), (3, "  \t", "a", "y"), (3, "  \t", "a", "y"), (9, "w " * 200_000, "a", "y")]
    docs = spark.createDataFrame(rows, SCHEMA)
    planned = mixing.plan(docs).toPandas()
    assert len(planned) == len(rows)
    sizes = {}
    for _, text, source, _ in rows:
        sizes[source] = sizes.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    want = plain_targets(sizes)
    for r in planned.itertuples():
        source = None if r.source != r.source else r.source
        assert r.source_size == sizes[source] and r.target == pytest.approx(want[source])
        assert r.taken in ({0} if not r.size else {r.size * int(r.target / r.source_size), r.size * (int(r.target / r.source_size) + 1)})
    again = mixing.plan(docs.repartition(5)).toPandas()
    assert sorted(map(str, planned.itertuples(index=False))) == sorted(map(str, again.itertuples(index=False)))
    mixed = mixing.mix(docs)
    assert mixed.schema == docs.schema
    counted = {(r[0], r[1]): r[2] for r in mixed.groupBy("doc_id", "source").count().collect()}
    copies = planned.astype(object).where(planned.notna(), None).groupby(["doc_id", "source"], dropna=False)["copies"].sum()
    for (i, s), n in copies.items():
        key = (None if i is None or i != i else int(i), None if s is None or s != s else s)
        assert counted.get(key, 0) == n


def test_near_the_targets(spark):
    docs = spark.range(60_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("w "), (F.col("id") % 40 + 1).cast("int")).alias("text"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("s"), (F.col("id") % 5).cast("string"))).alias("source"))
    found = mixing.plan(docs).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r["taken"] / r["target"] - 1) < 0.03 for r in found)


def test_empty(spark):
    assert mixing.plan(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([(1, None, None, "a"), (1, " ", None, None)], SCHEMA)).count() == 0


def test_many_sources(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("a b c").alias("text"), F.col("id").cast("string").alias("source"))
    rows = mixing.rates(mixing.sized(docs), (5, 2, 1), 1.5, 2.0).collect()
    want = plain_targets({str(i): 3 for i in range(3000)})
    assert all(r["target"] == pytest.approx(want[r["source"]]) for r in rows) and len(rows) == 3000

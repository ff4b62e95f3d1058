"""Connected components of a distributed edge list by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.shared import materialize, temporary, tidy

#: Nodes that a task holds at most before it writes what it knows.
HELD = 500_000


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each task's own components as stars, one edge a node: a dense group's many edges end here."""
    tidy()
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    def stars() -> pa.RecordBatch:
        rows = [(x, r) for x in list(up) if (r := root(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([r for _, r in rows], pa.int64())], ["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        if len(up) > HELD:
            yield stars()
            up.clear()
    yield stars()


def _stars(edges: DataFrame) -> DataFrame:
    """One large-star and one small-star round over (a, b), a > b."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    low = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
    # large star: each larger neighbour hangs on the smallest of the node's neighbourhood
    large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
    large = materialize(large, "large")
    # small star: each smaller neighbour, and the node, hang on the smallest
    low = large.groupBy("a").agg(F.min("b").alias("m"))
    small = large.join(low, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("s"))
    return materialize(small.select(F.col("s.b").alias("a"), F.col("s.m").alias("b")).where("a <> b").distinct(), "small")


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node with an edge in (a, b).

    Edges in any direction; loops and repeats are ignored. Tasks first reduce their own edges. Rounds grow with the
    logarithm of the longest chain. A node of very many neighbours is only ever summed by partial aggregation or split by the join, never gathered.
    """
    with temporary(edges.sparkSession) as keep:
        e = materialize(edges.select("a", "b").where("a <> b").mapInArrow(_forest, "a long, b long").distinct(), "edges")
        before = None
        while True:
            e = _stars(e)
            now = tuple(e.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long")), F.sum(F.hash("b", "a").cast("long"))).first())
            if now == before or not now[0]:
                break
            before = now
        keep(e)
    roots = e.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots)

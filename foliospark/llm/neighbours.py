"""Embedding near-dedup by sorted projection passes.

In each pass every vector gets a key of concatenated random hyperplane signs, and vectors are ordered by label, width
and key. Each is compared with the next `reach` in that order; the pairs of all passes that reach the cosine are the
links, of which a task writes no more than a forest. Equal vectors of a label are one, with their number, so a crowd
of copies takes one place in the order.

An order is cut into blocks of equal length and a block gets the first `reach` rows of the next, so windows cross
blocks, partitions and labels of any size. Since a window is bounded, a dense group can have more links than it shows,
within a component and across. So the passes only give the first components. Then the rest is looked for around
pivots: every vector belongs to the cell of its nearest pivot of its label, and is compared with those of each other
cell whose border is near enough for a link to cross it. So no link is missed, cells far apart never meet, and a cell
of any size is compared in blocks. Each task writes no more than a forest of the components that it joins, and within
each component all links are counted exactly, again in blocks, without writing a pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.components import components
from foliospark.llm.shared import bounded, materialize, temporary, tidy
from foliospark.llm.vectors import matrix, usable

PASSES, BITS, REACH, BLOCK, CROWD, LABEL = 10, 32, 48, 4096, 512, 4096
#: Pivots of a label and width at most; a table of pivots of no more than PIVOTS * PIVOTED rows is broadcast.
PIVOTS, PIVOTED = 64, 512


def _units(column: pa.Array) -> np.ndarray:
    x = matrix(column)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # no square overflows or vanishes
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _forest(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """Edges (a, b), a < b, that join what these edges join, one for each node at most."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (p := up.setdefault(x, x)) != x:
            up[x] = x = up[p]
        return x

    for x, y in zip(a.tolist(), b.tolist(), strict=True):
        x, y = root(x), root(y)
        if x != y:
            up[max(x, y)] = min(x, y)
    rows = [(r, x) for x in list(up) if (r := root(x)) != x]
    return pa.table({"a": pa.array([r for r, _ in rows], pa.int64()), "b": pa.array([x for _, x in rows], pa.int64())})


def _by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of each width: their numbers, and their unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    size = np.diff(column.offsets.to_numpy())
    for w in np.unique(size):
        i = np.flatnonzero(size == w)
        yield i, _units(column.take(pa.array(i)))


def _ordered(vectors: DataFrame, passes: int, bits: int) -> DataFrame:
    """pass, rank, id, label, embedding: every vector in every pass's order, ranks running over all passes."""
    weight = (1 << np.arange(bits - 1, -1, -1, dtype=np.int64)).astype(np.int64)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for b in batches:
            for i, x in _by_width(b.column("embedding")) if b.num_rows else ():
                planes = np.random.default_rng(7).standard_normal((passes, x.shape[1], bits))
                part = b.take(pa.array(i))
                for k in range(passes):
                    key = ((x @ planes[k]) > 0) @ weight
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i), k, np.int32)), part.column("label"), pa.array(np.full(len(i), x.shape[1], np.int32)), pa.array(key), part.column("id"), part.column("embedding")], ["pass", "label", "width", "key", "id", "embedding"])

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(np.full(b.num_rows, part, np.int32)), pa.array(np.arange(at, at + b.num_rows)), *(b.column(c) for c in ("pass", "label", "id", "embedding"))], ["part", "idx", "pass", "label", "id", "embedding"])
            at += b.num_rows

    kind = vectors.schema["embedding"].dataType.simpleString()
    keyed = materialize(vectors.mapInArrow(keys, f"pass int, label int, width int, key long, id long, embedding {kind}"), "keys")
    order = ["pass", "label", "width", "key", "id"]
    ranked = keyed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(number, f"part int, idx long, pass int, label int, id long, embedding {kind}")
    ranked = materialize(ranked, "order")
    starts, total = [], 0
    for r in ranked.groupBy("part").count().orderBy("part").collect():  # one row a partition
        starts.append((r["part"], total))
        total += r["count"]
    starts = vectors.sparkSession.createDataFrame(starts, "part int, before long")
    return ranked.join(F.broadcast(starts), "part").select("pass", (F.col("before") + F.col("idx")).alias("rank"), "id", "label", "embedding")


def links(vectors: DataFrame, cosine: float, passes: int = PASSES, bits: int = BITS, reach: int = REACH, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) of ids, a < b, that join what the links join that are found within `reach` places of a pass."""
    ranked = _ordered(vectors, passes, bits)
    own = F.floor(F.col("rank") / block)
    near = F.when(F.col("rank") % block < reach, F.array(own, own - 1)).otherwise(F.array(own))
    dealt = ranked.withColumn("block", F.explode(near)).where("block >= 0")

    def compare(key, t):
        tidy()
        t = t.sort_by("rank")
        rank, ids, label, turn = (t.column(c).to_numpy() for c in ("rank", "id", "label", "pass"))
        mine = int(np.searchsorted(rank, (key[0].as_py() + 1) * block))
        a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, x in _by_width(t.column("embedding")):
            for j in range(1, reach + 1):
                n = min(int(np.searchsorted(i, mine)), len(i) - j)
                if n <= 0:
                    break
                same = (label[i[:n]] == label[i[j : n + j]]) & (turn[i[:n]] == turn[i[j : n + j]])
                hit = np.flatnonzero(same & (np.einsum("ij,ij->i", x[:n], x[j : n + j]) >= cosine))
                a.append(ids[i[hit]])
                b.append(ids[i[hit + j]])
        return _forest(np.concatenate(a), np.concatenate(b))

    return materialize(dealt.groupBy("block").applyInArrow(compare, "a long, b long"), "links")


def _cells(members: DataFrame, cosine: float) -> DataFrame:
    """members with cell, and whether it is a row's own: that of the nearest pivot, and those where it may have links.

    Pivots are the vectors of the smallest hashes, one for every LABEL vectors of a label and width, PIVOTS at most.
    Two units that reach the cosine are no further apart than sqrt(2 - 2 cosine), so a vector further than that from
    the plane between its own pivot and another links with none that is nearest to the other.
    """
    spark = members.sparkSession
    group = ["label", F.size("embedding").alias("width")]
    wanted = members.groupBy(*group).agg(F.least(F.lit(PIVOTS), F.ceil(F.count("*") / LABEL)).cast("int").alias("wanted")).where("wanted > 1")
    own = [F.lit(0).alias("cell"), F.lit(True).alias("own")]
    if wanted.limit(PIVOTED + 1).count() > PIVOTED or wanted.isEmpty():  # no cells, or too many labels to send pivots of all
        return members.select("*", *own)
    w = Window.partitionBy("label", "width").orderBy(F.xxhash64("id"), "id")
    pivots = members.select(*group, "id", "embedding").join(F.broadcast(wanted), ["label", "width"]).withColumn("n", F.row_number().over(w)).where("n <= wanted")
    found: dict[tuple[int, int], list] = {}
    for r in pivots.select("label", "width", "embedding").collect():  # of bounded number
        found.setdefault((r["label"], r["width"]), []).append(r["embedding"])
    shared = spark.sparkContext.broadcast({k: _units(pa.array(v, pa.list_(pa.float32()))) for k, v in found.items()})
    far = np.sqrt(2 - 2 * min(1.0, cosine)) * (1 + 1e-9) + 1e-9

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for b in batches:
            if not b.num_rows:
                continue
            label = b.column("label").to_numpy()
            row, cell, mine = [], [], []
            for i, x in _by_width(b.column("embedding")):
                for one in np.unique(label[i]):
                    j = np.flatnonzero(label[i] == one)
                    p = shared.value.get((int(one), x.shape[1]))
                    if p is None:
                        k, c = j, np.zeros(len(j), np.int64)
                        o = np.ones(len(j), bool)
                    else:
                        d = 2 - 2 * x[j] @ p.T  # squared distances
                        nearest = d.argmin(1)
                        apart = np.sqrt(np.maximum(0, 2 - 2 * p @ p.T))[nearest]
                        over = d - d.min(1, keepdims=True)
                        met = over <= 2 * far * apart + 1e-9
                        met[np.arange(len(j)), nearest] = True
                        k, c = np.nonzero(met)
                        o, k = c == nearest[k], j[k]
                    row.append(i[k])
                    cell.append(c)
                    mine.append(o)
            out = b.take(pa.array(np.concatenate(row)))
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(np.concatenate(cell).astype(np.int32)), pa.array(np.concatenate(mine))], [*b.schema.names, "cell", "own"])

    kind = members.schema["embedding"].dataType.simpleString()
    return members.mapInArrow(place, f"id long, label int, component long, embedding {kind}, cell int, own boolean")


def _bridges(members: DataFrame, cosine: float) -> DataFrame:
    """Edges (a, b) that join all components between which members (id, label, component, embedding) link."""
    key = ["label", "width", "cell"]
    placed = _cells(members, cosine).withColumn("width", F.size("embedding"))
    placed = materialize(placed, "cells")
    blocks = placed.groupBy(*key).agg(F.ceil(F.sum(F.col("own").cast("int")) / LABEL).cast("int").alias("lefts"), F.ceil(F.count("*") / LABEL).cast("int").alias("rights")).where("lefts > 0")
    placed = materialize(placed.join(blocks, key).withColumn("h", F.xxhash64("id")), "label")
    rest = ["component", "embedding"]
    left = placed.where("own").select(*key, F.pmod("h", "lefts").cast("int").alias("i"), F.explode(F.sequence(F.lit(0), F.col("rights") - 1)).alias("j"), F.lit(True).alias("left"), *rest)
    right = placed.select(*key, F.explode(F.sequence(F.lit(0), F.col("lefts") - 1)).alias("i"), F.pmod("h", "rights").cast("int").alias("j"), F.lit(False).alias("left"), *rest)

    def join(key, t):
        tidy()
        side, c = t.column("left").to_numpy(), t.column("component").to_numpy().copy()
        x = _units(t.column("embedding"))
        l, r = np.flatnonzero(side), np.flatnonzero(~side)
        y, a, b = x[r].T, [], []
        for s in range(0, len(l), 512):
            hit = x[l[s : s + 512]] @ y >= cosine
            for k in np.flatnonzero((hit & (c[l[s : s + 512], None] != c[None, r])).any(axis=1)).tolist():
                met = np.unique(np.append(c[r[hit[k]]], c[l[s + k]]))
                if len(met) > 1:
                    c[np.isin(c, met)] = met[0]
                    a.append(np.full(len(met) - 1, met[0]))
                    b.append(met[1:])
        a, b = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (a, b))
        return pa.table({"a": a, "b": b})

    return left.union(right).groupBy(*key, "i", "j").applyInArrow(join, "a long, b long")


def _counts(members: DataFrame, cosine: float) -> DataFrame:
    """id, linked: for members (id, component, n, embedding) the rows of other members that they link with."""
    blocks = members.groupBy("component").agg(F.ceil(F.count("*") / CROWD).cast("int").alias("blocks"))
    placed = materialize(members.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")), "crowd")
    # each pair of blocks once, and its links for the rows of both
    after, before = F.explode(F.sequence("own", F.col("blocks") - 1)), F.explode(F.sequence(F.lit(0), "own"))
    left = placed.select("component", F.col("own").alias("i"), after.alias("j"), F.lit(True).alias("left"), "id", "n", "embedding")
    right = placed.select("component", before.alias("i"), F.col("own").alias("j"), F.lit(False).alias("left"), "id", "n", "embedding")

    def count(key, t):
        tidy()
        side = t.column("left").to_numpy()
        x, ids, n = _units(t.column("embedding")), t.column("id").to_numpy(), t.column("n").to_numpy()
        l, r = np.flatnonzero(side), np.flatnonzero(~side)
        same = key[1].as_py() == key[2].as_py()
        out = np.zeros(len(ids), np.int64)
        for s in range(0, len(l), 512):
            part = l[s : s + 512]
            hit = x[part] @ x[r].T >= cosine
            hit &= ids[part, None] != ids[None, r]
            out[part] = hit @ n[r]
            if not same:
                out[r] += n[part] @ hit
        own = l if same else np.arange(len(ids))
        return pa.table({"id": ids[own], "linked": out[own]})

    return left.union(right).groupBy("component", "i", "j").applyInArrow(count, "id long, linked long").groupBy("id").agg(F.sum("linked").alias("linked"))


def near_duplicates(vectors: DataFrame, cosine: float = 0.98, **options) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Vectors that are null, empty, zero, hold a null or non-finite component, or have no label link with nothing: no
    links, their own component, kept; vectors of different widths don't link. Ties in the order fall to the older
    row. Rows that share a vec_id are rows of their own; a null vec_id is no component's smallest unless it is alone.
    No rows give no rows; columns beside vec_id, embedding and label are ignored.
    """
    bounded(vectors.sparkSession)
    own = ["label", "h1", "h2"]  # what tells vectors apart: equal ones of a label are one, whatever their ids
    rows = vectors.select("vec_id", F.when(usable(), F.col("label")).alias("label"), "embedding", F.xxhash64(F.lit(1), "embedding").alias("h1"), F.xxhash64("embedding", F.lit(2)).alias("h2"))
    fit = rows.where("label is not null")
    with temporary(vectors.sparkSession) as keep:
        of = fit.groupBy(*own).agg(F.min("vec_id").alias("least"), F.count("*").alias("n"), F.first("embedding").alias("embedding"))
        of = materialize(of.withColumn("id", F.monotonically_increasing_id()), "of")
        comp = materialize(components(links(of.select("id", "label", "embedding"), cosine, **options)).select(F.col("node").alias("id"), "component"), "found")
        members = of.join(comp, "id", "left").select("id", "label", F.coalesce("component", "id").alias("component"), "embedding")
        stars = comp.select(F.col("id").alias("a"), F.col("component").alias("b"))
        comp = materialize(components(stars.union(_bridges(members, cosine))).select(F.col("node").alias("id"), "component"), "components")
        linked = _counts(of.join(comp, "id").select("id", "component", "n", "embedding"), cosine)
        known = materialize(of.drop("embedding").join(comp, "id", "left").join(linked, "id", "left").withColumn("component", F.coalesce("component", "id")), "linked")
        least = known.groupBy("component").agg(F.min("least").alias("component_id"))
        known = keep(materialize(known.join(least, "component").select(*own, (F.coalesce("linked", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "known"))
    out = rows.drop("embedding").join(known, own, "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))

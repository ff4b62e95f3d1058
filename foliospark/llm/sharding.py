"""Consistent-hash ring with virtual nodes and bounded loads.

Every shard owns `vnodes` points on a ring of 64-bit hashes. A key belongs to the next point clockwise; when that
point's shard is full, the key goes on clockwise to the next shard with room. Capacities differ by one key at most
and sum to the number of keys, so the loads do too.

The walk needs only the number of keys in each arc: `walk` turns those counts, `shards * vnodes` numbers whatever the
table holds, into runs of ranks and their shards. A key's rank among its arc's keys comes from a window over arcs cut
by `cells` (a power of two) equal stretches of the ring, and these cut by SALT residues of the text's checksum: rows
of one doc_id, or of none, have one hash, but not one window. Equal rows are one until they have their ranks.
"""

from __future__ import annotations

import bisect
import struct
from hashlib import blake2b

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.shared import materialize

VNODES, CELLS, SALT = 64, 4096, 16
#: Copies of a row that one row stands for when ranks are dealt to them.
DEALT = 4096


def ring(shards: int, vnodes: int = VNODES) -> tuple[list[int], list[int]]:
    """The ring's points in order, and each point's shard. A shard's points depend on its number alone."""
    points = sorted((struct.unpack("<q", blake2b(f"{s}/{v}".encode(), digest_size=8).digest())[0], s) for s in range(shards) for v in range(vnodes))
    return [p for p, _ in points], [s for _, s in points]


def walk(counts: list[int], owner: list[int], shards: int) -> list[tuple[int, int, int, int, int]]:
    """(arc, first rank, keys, shard, first slot): where each run of an arc's keys goes.

    Arcs take their own keys first, in ring order; what a full shard can't take walks on clockwise. The shards whose
    own arcs hold most get the one key more when the keys don't divide evenly.
    """
    total = sum(counts)
    own = [0] * shards
    for n, s in zip(counts, owner, strict=True):
        own[s] += n
    extra = set(sorted(range(shards), key=lambda s: (-own[s], s))[: total % shards])
    room = [total // shards + (s in extra) for s in range(shards)]
    slot, runs, left = [0] * shards, [], []

    def put(arc: int, rank: int, n: int, s: int) -> int:
        n = min(n, room[s])
        if n:
            runs.append((arc, rank, n, s, slot[s]))
            room[s] -= n
            slot[s] += n
        return n

    for arc, n in enumerate(counts):
        took = put(arc, 0, n, owner[arc])
        if took < n:
            left.append((arc, took, n - took))
    for arc, rank, n in left:
        step = arc
        while n:
            step = (step + 1) % len(owner)
            took = put(arc, rank, n, owner[step])
            rank, n = rank + took, n - took
    return runs


def shard(docs: DataFrame, shards: int, vnodes: int = VNODES, cells: int = CELLS) -> DataFrame:
    """doc_id, size, text_crc32, law ('rows'), shard, slot, grown_shard (null) for every row.

    A null text has size 8 and the checksum of no bytes. Rows with a null doc_id are keys like any other. Repeated
    rows are separate keys with ranks of their own. Other columns are ignored; an empty table gives no rows.
    """
    spark = docs.sparkSession
    points, owner = ring(shards, vnodes)
    text = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    keyed = docs.select("doc_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.xxhash64(F.lit("key"), "doc_id").alias("h"))
    # arc: the number of points below the hash, from the points of its cell of the ring; past the last the ring closes
    width = (1 << 64) // cells
    edges = [-(1 << 63) + c * width for c in range(cells + 1)]
    cuts = [bisect.bisect_left(points, e) for e in edges]
    near = spark.createDataFrame([(c, cuts[c], points[cuts[c] : cuts[c + 1]]) for c in range(cells)], "cell int, lo int, near array<long>")
    cell = F.shiftright("h", 64 - (cells.bit_length() - 1)) + cells // 2
    keyed = keyed.withColumn("cell", cell.cast("int")).join(F.broadcast(near), "cell")
    keyed = keyed.withColumn("arc", (F.col("lo") + F.size(F.filter("near", lambda p: p < F.col("h")))) % len(points)).drop("lo", "near")
    # a cell and an arc meet in a stretch of the ring; wrapped keys come behind the rest of arc 0, by their cell
    own = ["arc", "cell", "salt"]
    keyed = keyed.withColumn("salt", F.pmod(F.xxhash64("text_crc32", "size"), F.lit(SALT)).cast("int"))
    keyed = materialize(keyed.groupBy(*own, "h", "doc_id", "size", "text_crc32").agg(F.count("*").alias("n")), "keys")
    counts = {(r["arc"], r["cell"], r["salt"]): r["n"] for r in keyed.groupBy(*own).agg(F.sum("n").alias("n")).collect()}
    per_arc, base = [0] * len(points), []
    for (a, c, t), n in sorted(counts.items()):
        base.append((a, c, t, per_arc[a]))
        per_arc[a] += n
    runs = walk(per_arc, owner, shards)
    starts = F.broadcast(spark.createDataFrame(base, "arc int, cell int, salt int, before long"))
    places = F.broadcast(spark.createDataFrame([(a, r, r + n, s, t) for a, r, n, s, t in runs], "arc int, first long, until long, shard int, slot0 long"))
    w = Window.partitionBy(*own).orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keyed.withColumn("r", F.coalesce(F.sum("n").over(w), F.lit(0))).join(starts, own).withColumn("rank", F.col("before") + F.col("r"))
    several = ranked.where("n > 1").withColumn("turn", F.explode(F.expr(f"sequence(0L, (n - 1) div {DEALT})"))).repartition("doc_id", "text_crc32", "turn")
    several = several.withColumn("rank", F.explode(F.expr(f"sequence(rank + turn * {DEALT}, rank + least(n, (turn + 1) * {DEALT}) - 1)")))
    placed = ranked.where("n = 1").unionByName(several.select(*ranked.columns)).join(places, "arc").where("rank >= first and rank < until")
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("slot0") + F.col("rank") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))

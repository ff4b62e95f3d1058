"""Shards against a plain walk of the ring, key by key."""

import bisect
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from foliospark.llm import sharding


def plain(hashes, shards):
    """How many keys of each arc go to each shard: a key at a time, its own arc first, then clockwise."""
    points, owner = sharding.ring(shards)
    arcs = [bisect.bisect_left(points, h) % len(points) for h in hashes]
    own = Counter(owner[a] for a in arcs)
    more = sorted(range(shards), key=lambda s: (-own[s], s))[: len(arcs) % shards]
    room = {s: len(arcs) // shards + (s in more) for s in range(shards)}
    out, left = Counter(), []
    for a in sorted(arcs):
        if room[owner[a]]:
            room[owner[a]] -= 1
            out[a, owner[a]] += 1
        else:
            left.append(a)
    for a in left:
        step = next(k for k in range(1, len(points) + 1) if room[owner[(a + k) % len(points)]])
        s = owner[(a + step) % len(points)]
        room[s] -= 1
        out[a, s] += 1
    return out


@pytest.mark.parametrize("shards, dealt", [(24, 4096), (5, 7), (1, 4096)])
def test_ring(spark, monkeypatch, shards, dealt):
    monkeypatch.setattr(sharding, "DEALT", dealt)
    rows = [(i, f"text {i % 13}") for i in range(400)] + [(None, f"null {i % 60}") for i in range(200)] + [(7, "same")] * 150 + [(7, "long " * 50_000), (8, None), (8, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(3) for c in ("size", "h", "cell", "arc", "n", "salt", "shard", "rank", "turn", "first")})
    got = sharding.shard(df, shards).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    h = {r["doc_id"]: r["h"] for r in df.select("doc_id", F.xxhash64(F.lit("key"), "doc_id").alias("h")).distinct().collect()}
    points, _ = sharding.ring(shards)
    assert Counter((bisect.bisect_left(points, h[r["doc_id"]]) % len(points), r["shard"]) for r in got) == plain([h[i] for i, _ in rows], shards)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, slots.values())) - min(map(len, slots.values())) <= 1

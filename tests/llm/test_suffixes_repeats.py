"""Periodic texts and many equal rows, against brute force or plain arithmetic."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import suffixes


def brute(texts, size):
    raw = [t.encode() for t in texts]
    seen = Counter(hashlib.blake2b(b[p : p + size], digest_size=16).digest() for b in raw for p in range(len(b) - size + 1))
    out = []
    for i, b in enumerate(raw):
        gone = np.zeros(len(b) + 1, int)
        for p in range(len(b) - size + 1):
            if seen[hashlib.blake2b(b[p : p + size], digest_size=16).digest()] > 1:
                gone[p] += 1
                gone[p + size] -= 1
        cut = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~cut]) if len(b) else b""
        out.append((i, len(b), int(cut.sum()), int((cut & ~np.append(False, cut[:-1])[: len(cut)]).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("window, gram", [(200, 48), (24, 8)])
def test_periodic_stretches(spark, window, gram):
    rng = random.Random(9)
    noise = lambda n: "".join(rng.choice("abcdefghij \n") for _ in range(n))
    unit = [" ", "ab", "=-", "xyz", "0123456789", "é", noise(33), noise(70)]
    texts = ["", " " * window, " " * (window - 1), "q" * (window + 1), "ab" * window, "b" + "ab" * (window // 2)]
    for u in unit:
        texts += [noise(90) + u * (rng.randint(300, 3000) // len(u)) + noise(90) for _ in range(2)]
        texts.append(noise(20) + (u * window)[:window] + noise(20))  # a single window of another text's stretch
    texts.append(noise(50) + "ab" * 700 + "c" + "ab" * 700 + noise(50))  # broken once
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(map(tuple, suffixes.digests(suffixes.strip(df, window, gram)).collect())) == brute(texts, window)


def test_few_runs_for_a_periodic_text():
    data = np.frombuffer(b" " * 1_500_000, np.uint8)
    runs = list(suffixes.anchors(data, np.array([0, len(data)]), 200, 48))
    assert sum(len(r[0]) for r in runs) < 5 * (len(data) // suffixes.SEGMENT + 1) and sum(int(r[4][r[6]].sum()) for r in runs) == len(data) - 199


def test_one_very_long_periodic_text(spark):
    df = spark.createDataFrame([(1, "z" * 10_000_000), (2, "z" * 199), (3, "y" + "z" * 200)], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"]) for r in suffixes.digests(suffixes.strip(df)).collect()}
    assert got == {1: (10_000_000, 10_000_000, 1), 2: (199, 0, 0), 3: (201, 200, 1)}


def test_very_many_equal_rows(spark):
    rng = random.Random(1)
    text = "".join(rng.choice("abcdefgh ") for _ in range(700))
    df = spark.range(100_000).select(F.lit(5).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    got = suffixes.strip(df).groupBy("n_bytes", "n_removed", "n_spans").count().collect()
    assert [tuple(r) for r in got] == [(700, 700, 1, 100_000)]

"""Codes against SQL, bounds against all distances, and odd vectors."""

import hashlib
import math

import duckdb
import numpy as np
import pytest

from foliospark.llm import codes
from foliospark.llm.queries import QUERIES, SQL

SCHEMA = "vec_id long, embedding array<double>, label string, code string"


def test_sql(spark):
    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{sf}/embeddings.parquet'")
    ours = QUERIES["op12_codes"](spark, sf).toPandas().sort_values("vec_id").reset_index(drop=True)
    theirs = c.sql(SQL["op12_codes"]).df()[list(ours.columns)].sort_values("vec_id").reset_index(drop=True)
    assert len(ours) == 500
    for name in ours.columns:
        assert ours[name].tolist() == theirs[name].tolist(), name


@pytest.mark.parametrize("spread", [3, 1000, 1 << 26])
@pytest.mark.parametrize("shape", [(256, 16), (7, 3), (1, 2)])
def test_nearest(spread, shape):
    rng = np.random.default_rng(spread)
    entries, x = rng.integers(-spread, spread + 1, shape), rng.integers(-spread, spread + 1, (1300, shape[1]))
    entries[len(entries) // 2] = entries[0]
    cells = codes.Cells(entries)
    index, distance = cells.nearest(x)
    every = ((x[:, None] - entries) ** 2).sum(axis=2)
    assert (index == every.argmin(axis=1)).all() and (distance == every.min(axis=1)).all()
    assert not cells.candidates(x)[np.arange(len(x)), every.argmin(axis=1)].min() == 0


def test_bounds_leave_few():
    rng = np.random.default_rng(5)
    centres = rng.integers(-400, 400, (256, 16))
    near = centres[rng.integers(0, 256, 2000)] + rng.integers(-40, 40, (2000, 16))
    assert codes.Cells(centres).candidates(near).mean() < 0.05


def plain(rows, parts=4, entries=256, rounds=4):
    """The definition, row by row."""
    kept = [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]
    ints = [[max(-codes.MOST, min(codes.MOST, math.floor(1024 * x))) for x in r[1]] for r in kept]
    width = -(-max(map(len, ints), default=0) // parts) * parts
    ints = [v + [0] * (width - len(v)) for v in ints]
    cut = [[v[p * width // parts : (p + 1) * width // parts] for p in range(parts)] for v in ints]
    first = {}
    for r, v in zip(kept, ints):
        first[r[0]] = min(first.get(r[0], v), v)
    start = sorted(first, key=lambda i: (i is None, i or 0))[:entries]
    books = [[first[i][p * width // parts : (p + 1) * width // parts] for i in start] for p in range(parts)]

    def nearest(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        found = [[nearest(p, v[p])[1] for p in range(parts)] for v in cut]
        for p in range(parts):
            for i in range(len(books[p])):
                own = [v[p] for v, f in zip(cut, found) if f[p] == i]
                if own:
                    books[p][i] = [sum(c) // len(own) for c in zip(*own)]
    out, by_label = [], {}
    for r, v in zip(kept, cut):
        found = [nearest(p, v[p]) for p in range(parts)]
        error = sum(d for d, _ in found)
        by_label[r[2]] = by_label.get(r[2], 0) + error
        out.append((r[0], bytes(i for _, i in found).hex(), error, r[2]))
    sha = hashlib.sha256(",".join(str(c) for b in books for e in b for c in e).encode()).hexdigest()
    return sorted(((str(i), c, e, by_label[g]) for i, c, e, g in out)), sha


@pytest.mark.parametrize("n", [0, 3, 90])
def test_odd_vectors(spark, n):
    rng = np.random.default_rng(n)
    rows = [(i, rng.normal(size=8).tolist(), ["a", "b", None][i % 3], "x") for i in range(n)]
    if n:
        rows += [(None, [0.5] * 8, "a", None), (1, None, "a", None), (2, [1.0, None] * 4, "b", None), (3, [float("nan")] * 8, None, None), (4, [float("-inf")] * 8, None, None)]
        rows += [(2, [1e300, -1e300, 5.0, 0.0, 0.0, 0.0, 0.0, 0.0], "c", None), (1, [0.25] * 8, "a", "y"), (1, [0.25] * 8, "a", "y"), (77, [], "e", None), (78, [1.0, 2.0, 3.0], "e", None)]
    found, books = codes.compress(spark.createDataFrame(rows, SCHEMA), entries=20)
    ours = sorted((str(r["vec_id"]), r["code"], r["error"], r["label_error"]) for r in found.collect())
    want, sha = plain(rows, entries=20)
    if n != 0:
        assert books.sha256() == sha
        assert len(books.decoded(ours[0][1])) == books.entries.shape[0] * books.entries.shape[2]
    # the huge vector's errors pass a long in no row here
    assert ours == want

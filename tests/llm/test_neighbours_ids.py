"""Shared ids, several widths, and cells around pivots, against brute force over rows."""

import numpy as np
import pytest

from foliospark.llm import neighbours


def brute(rows, cosine=0.98):
    """(vec_id, n_links, component_id) of each row, in order."""
    n = len(rows)
    x = [np.array(e, float) / np.linalg.norm(e) for _, e, _ in rows]
    link = np.array([[i != j and rows[i][2] == rows[j][2] and len(x[i]) == len(x[j]) and x[i] @ x[j] >= cosine for j in range(n)] for i in range(n)])
    least = np.arange(n)
    while True:
        low = np.array([min([least[i], *least[link[i]]]) for i in range(n)])
        if (low == least).all():
            break
        least = low
    ids = np.array([r[0] for r in rows])
    return sorted((rows[i][0], int(link[i].sum()), int(ids[least == least[i]].min())) for i in range(n))


def got(spark, rows, **options):
    rows = [(i, [float(v) for v in e], y) for i, e, y in rows]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    return sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in neighbours.near_duplicates(df, 0.98, **options).collect())


def test_ids_shared_by_different_vectors(spark):
    rows = [(5, [1.0, 0, 0, 0], 1), (5, [0, 0, 1.0, 0], 1), (6, [1.0, 0.01, 0, 0], 1), (6, [1.0, 0.01, 0, 0], 2), (4, [0, 0, 1.0, 0], 1), (7, [1.0, 0, 0], 1), (8, [1.0, 0.02, 0], 1), (9, [3.0], 1), (9, [3.0], 1)]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("spread", [0.05, 0.3, 1.0])
def test_cells(spark, monkeypatch, spread):
    monkeypatch.setattr(neighbours, "LABEL", 40)
    rng = np.random.default_rng(11)
    centres = rng.standard_normal((12, 16))
    x = np.concatenate([c + spread * rng.standard_normal((40, 16)) for c in centres]).astype(np.float32)
    x[-60:] = x[:60] + np.float32(0.09) * rng.standard_normal((60, 16)).astype(np.float32)
    rows = [(i, [float(v) for v in e], i % 2) for i, e in enumerate(x)]
    want = brute(rows)
    assert sum(n for _, n, _ in want) > 20
    assert got(spark, rows, passes=1, reach=1) == want  # almost all is left to the cells


def test_counts_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "CROWD", 16)
    rng = np.random.default_rng(4)
    x = rng.standard_normal(8) + 0.07 * rng.standard_normal((150, 8))
    rows = [(i, [float(v) for v in np.float32(e)], 3) for i, e in enumerate(x)]
    assert got(spark, [*rows, *rows[:20]]) == brute([*rows, *rows[:20]])

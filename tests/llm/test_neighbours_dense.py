"""Near copies inside one crowded label, where sorted passes miss pairs, against brute force."""

import numpy as np

from foliospark.llm import neighbours


def test_crowded_label(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "LABEL", 1500, raising=False)  # several blocks
    rng = np.random.default_rng(5)
    centre = rng.standard_normal(64)
    x = centre / np.linalg.norm(centre) + 0.27 / 8 * rng.standard_normal((4000, 64))  # mutual cosine about 0.93
    x[3700:] = x[:300] / np.linalg.norm(x[:300], axis=1, keepdims=True) + 0.185 / 8 * rng.standard_normal((300, 64))
    x = x.astype(np.float32)
    df = spark.createDataFrame([(i, [float(v) for v in e], 1) for i, e in enumerate(x)], "vec_id long, embedding array<float>, label int")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in neighbours.near_duplicates(df, 0.98).collect()}
    u = x.astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    link = u @ u.T >= 0.98
    np.fill_diagonal(link, False)
    least = np.arange(len(x))
    while True:
        low = np.minimum(least, np.where(link, least[None], len(x)).min(axis=1))
        if (low == least).all():
            break
        least = low
    assert link.sum() >= 400
    wrong = [i for i in got if got[i] != (int(link[i].sum()), int(least[i]))]
    assert len(got) == len(x) and (int(link.sum()) - sum(n for n, _ in got.values()), wrong) == (0, [])

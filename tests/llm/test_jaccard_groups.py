"""A large group of near copies, of which few pairs link, is joined by few verified pairs, each verified once."""

import random
from collections import Counter

from foliospark.llm import jaccard


def test_group_around_its_least_edited_member(spark, monkeypatch):
    rng = random.Random(8)
    base = [f"w{i}" for i in range(300)]
    rows = [(0, " ".join(base))]
    for i in range(1, 200):
        w = base[:]
        for k in rng.sample(range(300), 6):  # six edits: at 0.9 of the base, but not of each other
            w[k] = f"e{i}_{k}"
        rows.append((i, " ".join(w)))
    rows += [(300 + i, " ".join(f"x{i}_{j}" for j in range(50))) for i in range(50)]
    tried = []
    verified = jaccard._verified

    def seen(texts, found, pairs, *more):
        tried.extend((r["a"], r["b"]) for r in pairs.collect())
        return verified(texts, found, pairs, *more)

    monkeypatch.setattr(jaccard, "_verified", seen)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, 100).collect()}
    sets = {i: {tuple(t.split()[j : j + 3]) for j in range(len(t.split()) - 2)} for i, t in rows}
    assert all(len(sets[i] & sets[0]) * 100 >= 85 * len(sets[i] | sets[0]) for i in range(200))
    assert got == {i: 0 if i < 200 else i for i, _ in rows}
    assert max(Counter(tried).values()) == 1 and len(tried) < 600

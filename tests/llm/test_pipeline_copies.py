"""The near-copy stage's doc_ids against brute-force components."""

import re

import corpus_pipeline
from foliospark.llm.shared import table

SF = "/root/testdata/sf0.001"


def test_near_copies(spark):
    docs = table(spark, SF, "documents")
    sets = {}
    for r in docs.collect():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} or ({tuple(w)} if w else set())
    least = {i: i for i in sets}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    for _ in sets:
        for a, b in links:
            least[a] = least[b] = min(least[a], least[b])
    got = sorted(r["doc_id"] for r in corpus_pipeline.without_near_copies(spark, docs, SF).collect())
    assert links and got == sorted(i for i in sets if least[i] == i)

"""Scores of op10 and op5 against plain versions, and columns whose names clash."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from foliospark.llm import bpe, hmm, licenses, packing, toxicity
from foliospark.llm.queries import vocabulary

LEXICON = toxicity.Lexicon({"zloser": 4.0, "grum*": 3.0, "grumpf": 5.0, "kno": 3.5}, ("zloser rocket", "old kno"), 1.3, -4.5)
SIGNS = dict(zip("01345 78@$!".replace(" ", ""), "oieastbasi", strict=False))


def plain_fold(text):
    text = text.lower().translate(str.maketrans(toxicity.LOOKALIKES | dict.fromkeys("​­")))
    out = []
    for w in re.split(r"([\w@$]+(?:![\w@$]+)*)", text):
        beside = any(a != "_" and not a.isdigit() and a.isalnum() and b in toxicity.SIGNS or b != "_" and not b.isdigit() and b.isalnum() and a in "0123456789@$" for a, b in zip(w, w[1:], strict=False))
        out.append("".join(toxicity.SIGNS.get(c, c) for c in w) if beside else w)
    return "".join(out)


def plain_score(text, lexicon):
    t = plain_fold(text)
    spans = [(m.start(), m.end()) for p in lexicon.exceptions for m in re.finditer(rf"(?<![^\W_]){re.escape(p)}(?![^\W_])", t)]
    weight = {}
    for m in re.finditer(r"[^\W_]+", t):
        best = (0.0, 0)
        for term, w in lexicon.terms.items():
            stem = term.rstrip("*")
            if term == stem and m[0] == stem or term != stem and m[0].startswith(stem) and m[0] != stem:
                best = max(best, (w, len(stem)))
        if best[1] and not any(p <= m.start() and m.start() + best[1] <= q for p, q in spans):
            weight[t[m.start() : m.start() + best[1]]] = best[0]
    x = lexicon.slope * (sum(weight.values()) / math.sqrt(1 + t.count(" ") / 100)) + lexicon.bias
    return 1 / (1 + math.exp(-x))


def test_toxicity_scores(spark):
    rng = random.Random(6)
    words = ["zloser", "zl0ser", "zlоser", "ZLOSER", "zloser rocket", "rocket", "grum", "grumble", "grumpf", "old kno", "kno", "knot", "xgrumble", "fine", "day,", "a1", "3", "9", "zlo­ser"]
    texts = [None, "", " ", "zloser" * 2] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(300)] + ["fine " * 30_000 + "zloser"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(df, LEXICON).collect()}
    assert all(got[i] == pytest.approx(plain_score(t or "", LEXICON)) for i, t in enumerate(texts))


def test_many_exceptions_in_one_text():
    auto = LEXICON.automaton()
    began = time.time()
    assert toxicity.matches("zloser rocket zloser " * 20_000, auto).keys() == {21 * i + 14 for i in range(20_000)}
    assert time.time() - began < 5


def test_learning_is_bounded(spark):
    docs = spark.createDataFrame([(2, "bad zloser words")] * 500 + [(2, "x" * 5000)] + [(i, f"plain {i}") for i in range(3, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(2, 1), (2, 0)] + [(i, 0) for i in range(3, 40)], "doc_id long, toxic int")
    kept = []
    fit = toxicity.fit
    try:
        toxicity.fit = lambda rows: kept.extend(rows) or fit(kept)
        toxicity.learn(docs, labels)
        every, kept[:] = len(kept), []
        toxicity.learn(docs, labels, characters=60)
    finally:
        toxicity.fit = fit
    ids = {r["doc_id"] for r in labels.where(~toxicity.held_out()).select("doc_id").distinct().collect()}
    assert every == len(ids) and 0 < len(kept) < every and sum(len(t) for t, _ in kept) <= 60


def test_license_scores(spark):
    rng = random.Random(3)
    words = "permission is hereby granted free of charge to any person obtaining a copy redistribution and use in source binary forms with or without modification are permitted licensed under the apache license version 2 0".split()
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 40))) for _ in range(200)] + [" ".join(t.split()[: len(t.split()) - k]) for t, _ in licenses.TEMPLATES for k in (0, 1, 2, 3)] + ["All rights reserved", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in licenses.scan(df).collect():
        own = set(re.findall(r"[a-z0-9]+", (texts[r["doc_id"]] or "").lower()))
        share = [(len(own & set(t.split())) / len(set(t.split())), label) for t, label in licenses.TEMPLATES]
        met = [(s, label) for s, label in share if s >= 0.8]
        assert r["score"] == pytest.approx(max([s for s, _ in met] + [1.0] * bool(r["n_base"]), default=0.0))
        assert set(filter(None, r["labels"].split(","))) == {label for _, label in met} | set(filter(None, r["base_labels"].split(",")))


def test_columns_that_clash(spark):
    rows = [(1, "one two Licensed under CC BY"), (2, None), (2, "x " * 40_000), (None, "")]
    plain = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("n", "h", "ids", "part", "start", "length", "leaf", "rid", "held_out", "score", "k", "c", "labels", "n_words", "seq", "rare", "sequence_id", "offset")
    clash = plain.withColumns({c: F.lit("?") for c in names})
    ways = {
        "op4": lambda d: packing.pack(d.coalesce(1), vocabulary(), 64).select("doc_id", "start", "length", "ids_crc32", "doc_tokens"),
        "op5": licenses.scan,
        "op6": lambda d: bpe.digests(bpe.encode_rows(d, vocabulary()), vocabulary()),
        "op8": lambda d: hmm.score(d, 2, 1).drop("score"),
        "op10": lambda d: toxicity.scores(d, LEXICON),
    }
    for name, way in ways.items():
        assert sorted(map(str, way(clash).collect())) == sorted(map(str, way(plain).collect())), name

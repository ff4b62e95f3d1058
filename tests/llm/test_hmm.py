"""The hidden Markov model against a plain forward-backward over whole texts, and its whole scores."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import hmm
from foliospark.llm.queries import QUERIES


def forward(m, x):
    v, log = m.start * m.emit[x[0]], 0.0
    for y in x[1:]:
        log, v = log + math.log10(v.sum()), v / v.sum()
        v = (v @ m.step) * m.emit[y]
    return log + math.log10(v.sum())


def counts(m, x):
    """Expected starts, steps and symbols of one sequence."""
    n, s = len(x), len(m.start)
    a, b = np.zeros((n, s)), np.ones((n, s))
    a[0] = m.start * m.emit[x[0]]
    for t in range(1, n):
        a[t] = (a[t - 1] @ m.step) * m.emit[x[t]]
    for t in range(n - 2, -1, -1):
        b[t] = m.step @ (m.emit[x[t + 1]] * b[t + 1])
    z = a[-1].sum()
    step = sum((np.outer(a[t], m.emit[x[t + 1]] * b[t + 1]) * m.step / z for t in range(n - 1)), np.zeros((s, s)))
    emit = np.zeros(m.emit.shape)
    for t in range(n):
        emit[x[t]] += a[t] * b[t] / z
    return a[0] * b[0] / z, step, emit


@pytest.mark.parametrize("span", [1, 4, 7, 64])
def test_recursions_over_stretches_are_exact(span):
    rng, s, symbols = np.random.default_rng(0), 3, 50
    m = hmm.Model(*(x / x.sum(axis, keepdims=True) for x, axis in ((rng.random(s), 0), (rng.random((s, s)), 1), (rng.random((symbols, s)), 0))))
    x, at = rng.integers(0, symbols, 60).astype(np.uint16), np.array([0, 1, 8, 40, 60])
    own = [x[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert hmm.likelihood(m, x, at, span) == pytest.approx([forward(m, y) for y in own])
    want = [sum(c) for c in zip(*(counts(m, y) for y in own), strict=True)]
    for got, plain in zip(hmm.expected(m, x, at, span), want, strict=True):
        assert np.allclose(got, plain)
    better = hmm.Model(*(y / y.sum(axis, keepdims=True) for y, axis in zip(want, (0, 1, 0), strict=True)))
    assert hmm.likelihood(better, x, at, span).sum() > hmm.likelihood(m, x, at, span).sum()


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def test_whole_scores(spark, monkeypatch):
    """Scores with head words, rare words and classes against the model's definition, word by word."""
    monkeypatch.setattr(hmm, "HEAD", 120)  # most words are looked up by the join
    rng = np.random.default_rng(2)
    vocab = [f"w{chr(97 + i % 26)}{i}" for i in range(120)]
    rows = [(i, " ".join(rng.choice(vocab, p=np.arange(120, 0, -1) / 7260, size=int(rng.integers(0, 60))).tolist())) for i in range(60)] + [(61, "never seen"), (62, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("rid", "h", "k", "c", "seq", "rows")})
    kept = {}
    train = hmm.train
    monkeypatch.setattr(hmm, "train", lambda coded, counts, *a: kept.update(counts=counts, model=train(coded, counts, *a)) or kept["model"])
    got = {r["doc_id"]: r for r in hmm.score(df, 3, 2, frequent=10, endings=7).collect()}
    own, m = kept["counts"], kept["model"]
    assert m.emit.shape == (18, 3) and np.allclose(m.emit.sum(0), 1) and np.allclose(m.step.sum(1), 1) and np.isclose(m.start.sum(), 1)
    c = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 10 for w in words(t))

    def place(w):  # hash and class, as the operator computes them
        import pyarrow as pa

        h, k, _ = hmm._tokens(pa.RecordBatch.from_pydict({"text": [w]}), 7)
        return h[0], int(k[0])

    at = {w: place(w) for w in {*vocab, "never", "seen"}}
    top = {h: i for i, h in enumerate(own.frequent.tolist())}
    classes = defaultdict(lambda: [0, 0])
    for w, n in c.items():
        if int(at[w][0]) not in top:
            classes[at[w][1]][0] += n
            classes[at[w][1]][1] += 1
    assert len(top) == 10 and min(c[w] for w in c if int(at[w][0]) in top) >= max(c[w] for w in c if int(at[w][0]) not in top)
    for i, t in rows:
        seq, share = [], 0.0
        for w in words(t):
            h, k = at[w]
            if int(h) in top:
                seq.append(top[int(h)])
            else:
                seq.append(10 + k)
                share += math.log10((c[w] + 0.1) / (classes[k][0] + 0.1 * (classes[k][1] + 1)))
        assert got[i]["score"] == pytest.approx(forward(m, [*seq, 17]) + share)


@pytest.mark.parametrize("texts", [[None, None, None], ["", "", ""], ["one", "two", "one"], [" \n", None, "x"]])
def test_little_to_learn_from(spark, texts):
    ids = [i for i in range(100) if zlib.crc32(str(i).encode()) % 10][: len(texts)]
    df = spark.createDataFrame([*zip(ids, texts, strict=True), (None, "no id")], "doc_id long, text string")
    got = hmm.score(df).collect()
    assert len(got) == len(texts) + 1 and all(math.isfinite(r["score"]) and r["score"] <= 0 and math.isfinite(r["base_score"]) for r in got)
    assert hmm.score(df.where("doc_id is null")).first()["train_tokens"] == 0


def test_base_scores_need_no_model(spark, monkeypatch):
    """What `hmm_base` gives is what `score` gives beside the model's score, with words to look up too."""
    monkeypatch.setattr(hmm, "HEAD", 64)
    docs = spark.createDataFrame([(i, " ".join(f"w{j * j % (i + 2)}" for j in range(i % 23))) for i in range(300)] + [(None, "w1 w2"), (5, None)] + [(7, "w3 w99")] * 2, "doc_id long, text string")
    names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    want = sorted(str(tuple(r)) for r in hmm.score(docs, rounds=1).select(*names[:-1], F.round(names[-1], 6)).collect())

    def no_model(*_):
        raise AssertionError("a model was trained")

    monkeypatch.setattr(hmm, "train", no_model)
    assert sorted(str(tuple(r)) for r in hmm.base(docs).select(*names[:-1], F.round(names[-1], 6)).collect()) == want
    assert QUERIES["hmm_base"](spark, "/root/testdata/sf0.001").count() == 200


def test_words_are_sorted_a_few_times_at_most(monkeypatch):
    """A task that holds many different words sorted all of them again for each slice of text."""
    monkeypatch.setattr(hmm, "HELD", 4000)
    rng, passed, merged = np.random.default_rng(1), [], hmm._merged
    monkeypatch.setattr(hmm, "_merged", lambda h, k, c: passed.append(len(h)) or merged(h, k, c))
    for distinct in (50, 1900, 1 << 40):
        passed.clear()
        h = rng.integers(0, distinct, 60_000).astype(np.uint64)
        got = Counter()
        for keys, k, c in hmm.summed((x, (x % 7).astype(np.int64)) for x in np.split(h, 600)):
            assert len(np.unique(keys)) == len(keys) and (k == keys % 7).all()
            got.update(dict(zip(keys.tolist(), c.tolist(), strict=True)))
        assert got == Counter(h.tolist()) and sum(passed) < 3 * len(h)


def test_texts_of_one_stretch_need_no_matrices(monkeypatch):
    rng, asked, transfers = np.random.default_rng(3), [], hmm._transfers
    m = hmm.Model(*(x / x.sum(axis, keepdims=True) for x, axis in ((rng.random(4), 0), (rng.random((4, 4)), 1), (rng.random((50, 4)), 0))))
    monkeypatch.setattr(hmm, "_transfers", lambda model, x, seq, *a: asked.append(len(seq)) or transfers(model, x, seq, *a))
    x, at = rng.integers(0, 50, 400).astype(np.uint16), np.array([0, 1, 64, 100, 360, 400])
    want = [forward(m, x[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
    assert hmm.likelihood(m, x, at, 64) == pytest.approx(want, rel=1e-12) and asked == [5]
    monkeypatch.setattr(hmm, "BLOCK", 16)
    assert hmm.likelihood(m, x, at, 64) == pytest.approx(want, rel=1e-12)
    own = [x[a:b] for a, b in zip(at[:3], at[1:4], strict=True)]  # the plain sums aren't scaled
    for got, plain in zip(hmm.expected(m, x[:100], at[:4], 24), zip(*(counts(m, y) for y in own), strict=True), strict=True):
        assert np.allclose(got, sum(plain), rtol=1e-9)


def test_head_words_are_found_among_all(monkeypatch):
    """The lookup by leading bits, on hashes that crowd one bucket, the largest hash, and a vocabulary of none."""
    rng = np.random.default_rng(4)
    for h in (rng.integers(0, 1 << 63, 500, np.uint64) * np.uint64(2), np.arange(300, dtype=np.uint64), np.array([0, (1 << 64) - 1], np.uint64), np.zeros(0, np.uint64)):
        h = np.unique(h)
        c = rng.integers(1, 9, len(h))
        own = hmm.Counts(h, h.astype(np.int64) % 5, c, 100, 10, 3, h[::3], np.ones(5, np.int64), np.ones(5, np.int64), len(h[::3]))
        asked = np.concatenate([h, h + np.uint64(1), np.array([5, (1 << 64) - 1], np.uint64)])
        known, log, symbol = own.look(asked, asked.astype(np.int64) % 5)
        for x, a, b, y in zip(asked.tolist(), known.tolist(), log.tolist(), symbol.tolist(), strict=True):
            i = h.tolist().index(x) if x in h.tolist() else -1
            assert a == (i >= 0) and b == pytest.approx(math.log10(c[i] + 0.1) if a else 0)
            assert y == (i // 3 if a and i % 3 == 0 else own.top + np.array([x], np.uint64).astype(np.int64)[0] % 5)

"""Each operator against a brute-force version on small tables with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from foliospark.llm import bpe, components, hmm, jaccard, licenses, neighbours, packing, search, sharding, suffixes, toxicity
from foliospark.llm.queries import QUERIES, SQL, vocabulary

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: With columns whose names the operators use inside.
CLASH = "doc_id long, text string, rid long, key long, size long, score double, label int, rank int, part int"


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", lower(t))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdeéñß") for _ in range(rng.randint(1, 9))) for _ in range(300)]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    long = say(9000)
    passage, line = say(60), "All rights reserved."
    out = [None, "", " \n\t ", "a", "A b", long, long[:30000] + "x" + long[30001:], "abc" * 20000, "abc" * 19000, line, f"Licensed under CC BY-NC 4.0.\n{say(5)}", "Released under the MIT License."]
    base = say(120)
    for i in range(12):
        w = base.split()
        w[i * 7] = f"edit{i}"
        out.append(" ".join(w))
    out += [base] * 5 + [f"{say(30)} {passage} {say(30)}" for _ in range(8)] + [say(rng.randint(1, 200)) for _ in range(40)] + ["<|endoftext|> it's 12  3\r\n ünï", "‫日本語 text 😀", "'s 't <|endo", "x " * 700]
    return [(i, t) for i, t in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    data = [(i, t, None, None, None) for i, t in rows] + [(None, "no id " * 50, "en", "s", 1), (4, "A b", "x", None, 3)]
    return spark.createDataFrame(data, DOCS).repartition(4)


@pytest.fixture(scope="module")
def all_rows(docs):
    return [(r["doc_id"], r["text"] or "") for r in docs.collect()]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def clashing(spark):
    return spark.createDataFrame([(1, "a b c d e f " * 40, 1, 1, 1, 0.5, 1, 1, 1), (2, "a b c d e f " * 40, 2, 2, 2, 0.5, 2, 2, 2)], CLASH)


def test_suffixes(spark, docs, all_rows, empty):
    size = 200
    raw = [t.encode() for _, t in all_rows]
    seen = Counter(hashlib.blake2b(b[p : p + size], digest_size=8).digest() for b in raw for p in range(len(b) - size + 1))
    want = []
    for (i, _), b in zip(all_rows, raw, strict=True):
        gone = bytearray(len(b))
        for p in range(len(b) - size + 1):
            if seen[hashlib.blake2b(b[p : p + size], digest_size=8).digest()] > 1:
                gone[p : p + size] = b"\1" * size
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        spans = sum(1 for j in range(len(b)) if gone[j] and not (j and gone[j - 1]))
        want.append((i, len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    assert Counter(map(tuple, suffixes.digests(suffixes.strip(docs)).collect())) == Counter(want)
    assert suffixes.strip(empty).count() == 0
    assert suffixes.cleaned(docs).columns == docs.columns
    assert suffixes.digests(suffixes.strip(clashing(spark))).agg(F.sum("n_removed")).first()[0] == 960


def test_columns_that_clash_stay(spark):
    d = spark.createDataFrame([(i, f"{'same words here ' * 30}", i, i, i, i) for i in range(3)] + [(9, "alone", 1, 1, 1, 1)], "doc_id long, text string, rid long, kept long, n_bytes long, stays long")
    cut = suffixes.cleaned(d)
    assert cut.columns == d.columns and {(r["doc_id"], r["text"], r["rid"]) for r in cut.collect()} == {(0, "", 0), (1, "", 1), (2, "", 2), (9, "alone", 1)}
    one = jaccard.one_of_each(d, 5, 80, 100)
    assert one.columns == d.columns and sorted(r["doc_id"] for r in one.collect()) == [0, 9]


@pytest.mark.parametrize("n, num, den", [(3, 90, 100), (5, 80, 100)])
def test_jaccard(spark, docs, all_rows, empty, n, num, den):
    sets = []
    for _, t in all_rows:
        w = words(t)
        sets.append({tuple(w[j : j + n]) for j in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    up = list(range(len(sets)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                up[root(a)] = root(b)
    least = defaultdict(list)
    for k, (i, _) in enumerate(all_rows):
        least[root(k)].append(i)
    want = Counter((i, len(s), min((x for x in least[root(k)] if x is not None), default=i)) for k, ((i, _), s) in enumerate(zip(all_rows, sets, strict=True)))
    assert Counter(map(tuple, jaccard.classes(docs, n, num, den).collect())) == want
    one = jaccard.one_of_each(docs, n, num, den)
    assert one.columns == docs.columns
    groups = {root(k) for k in range(len(sets)) if sets[k]}
    assert one.count() == len(groups) + sum(not s for s in sets)
    if n == 3:
        assert jaccard.classes(empty, n, num, den).count() == 0
        assert {r["component_id"] for r in jaccard.classes(clashing(spark), n, num, den).collect()} == {1}


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_packing(docs, all_rows, empty):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(vocabulary())
    want = Counter((i, tuple([*enc.encode(t, add_special_tokens=False).ids, 0])) for i, t in all_rows)
    pieces = packing.pack(docs, vocabulary(), 64).collect()
    seqs, parts = defaultdict(list), defaultdict(list)
    for r in pieces:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"]
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
        parts[r["sequence_id"] * 64 + r["offset"] - r["start"]].append((r["start"], r["doc_id"], tuple(ids.tolist()), r["doc_tokens"]))
    for s in seqs.values():
        assert [o for o, _ in sorted(s)] == [sum(n for _, n in sorted(s)[:k]) for k in range(len(s))]
    assert sum(sum(n for _, n in s) == 64 for s in seqs.values()) >= len(seqs) - 1 and sorted(seqs) == list(range(len(seqs)))
    got = Counter()
    for p in parts.values():
        p.sort()
        ids = tuple(x for q in p for x in q[2])
        assert len(ids) == p[0][3]
        got[p[0][1], ids] += 1
    assert got == want
    assert packing.pack(empty, vocabulary()).count() == 0


def test_bpe(docs, all_rows, empty):
    from tokenizers import Tokenizer

    enc = Tokenizer.from_file(vocabulary())
    want = Counter()
    for i, t in all_rows:
        ids = enc.encode(t, add_special_tokens=False).ids
        want[i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(enc.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    for leaf in (100, bpe.LEAF):
        assert Counter(map(tuple, bpe.digests(bpe.encode_rows(docs, vocabulary(), leaf), vocabulary()).collect())) == want
    assert bpe.encode_rows(empty, vocabulary()).count() == 0


def test_bpe_trees():
    from tokenizers import Tokenizer

    lib, own, rng = Tokenizer.from_file(vocabulary()), bpe.encoder(vocabulary()), random.Random(1)
    bits = ["'", "s", "re", "ll", " ", "  ", "\n", "a", "B", "é", "12", "!", "中", "<|endoftext|>", "<|endof", "text|>", "　", "😀"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(4000)]
    assert [x.tolist() for x in own.texts(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for k in range(60):
        w = "".join(rng.choice(bits if k % 2 else "abthein") for _ in range(rng.choice([5, 60, 3000])))
        cut = rng.choice([3, 17, 400])
        whole = bpe.tree(own, [bpe.Part.encode(own, w[i : i + cut].encode()) for i in range(0, len(w), cut)])
        assert whole.ids.tolist() == lib.encode(w, add_special_tokens=False).ids
        if not k % 2:
            assert own.word(w.encode()) == lib.encode(w, add_special_tokens=False).ids


def test_licenses(docs, all_rows, empty):
    got = defaultdict(list)
    for r in licenses.scan(docs).collect():
        got[r["doc_id"]].append(r)
    sep = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    for i, t in all_rows:
        w = sep.findall(lower(t))
        places, labels = [], set()
        for phrase, label in licenses.PHRASES:
            p = phrase.split()
            hit = [j for j in range(len(w)) if w[j : j + len(p)] == p]
            places += hit
            labels |= {label} if hit else set()
        more = set(labels)
        for block in re.split(r"(?<=\n)|(?<=[.!?;])(?=[\x00-\x20])", t):
            own = set(sep.findall(lower(block)))
            for text, label in licenses.TEMPLATES:
                want = set(text.split())
                if len(own & want) >= math.ceil(0.8 * len(want) - 1e-9):
                    more.add(label)
        for block in re.split(r"\n[\x00-\x20]*\n", t):  # windows, whatever signs or line ends they hold
            own = sep.findall(lower(block))
            for text, label in licenses.TEMPLATES:
                want, size = set(text.split()), math.ceil(len(text.split()) / 0.8)
                if any(len(want.intersection(own[j : j + size])) >= math.ceil(0.8 * len(want) - 1e-9) for j in range(len(own))):
                    more.add(label)
        for r in got[i]:
            assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(w), len(places), min(places, default=None), max(places, default=None))
            assert (r["base_labels"], r["labels"]) == (",".join(sorted(labels)), ",".join(sorted(more))) and 0 <= r["score"] <= 1
    assert sum(map(len, got.values())) == len(all_rows) and licenses.scan(empty).count() == 0


def test_hmm(docs, all_rows, empty):
    count, held = Counter(), {}
    for i, t in all_rows:
        held[i] = i is None or zlib.crc32(str(i).encode()) % 10 == 0
        if not held[i]:
            count.update([*words(t), None])
    n, v = sum(count.values()), len(count)
    got = defaultdict(list)
    for r in hmm.score(docs, 3, 2).collect():
        got[r["doc_id"]].append(r)
    for i, t in all_rows:
        w = [*words(t), None]
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        near = min(got[i], key=lambda r: abs(r["base_score"] - base))
        assert (near["held_out"], near["n_tokens"], near["n_known"], near["train_tokens"]) == (held[i], len(w), sum(count[x] > 0 for x in w), n)
        assert near["base_score"] == pytest.approx(base) and near["score"] < 0
    assert sum(map(len, got.values())) == len(all_rows) and hmm.score(empty).count() == 0


@pytest.mark.parametrize("n", [0, 1, 23, 24, 500])
def test_sharding(spark, n):
    d = spark.createDataFrame([(i, None if i % 9 == 0 else "é" * (i % 50)) for i in range(n)], "doc_id long, text string")
    got = sharding.shard(d, 24).collect()
    loads = defaultdict(list)
    for r in got:
        t = "" if r["doc_id"] % 9 == 0 else "é" * (r["doc_id"] % 50)
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(t.encode()) + 8, zlib.crc32(t.encode()), "rows", None)
        loads[r["shard"]].append(r["slot"])
    assert len(got) == n and all(sorted(s) == list(range(len(s))) for s in loads.values())
    sizes = [len(loads[s]) for s in range(24)]
    assert max(sizes) - min(sizes) <= 1


def test_sharding_moves_little(spark):
    d = spark.createDataFrame([(i, "x") for i in range(3000)] + [(None, None), (7, "x"), (7, "x")], "doc_id long, text string")
    a, b = ({r["doc_id"]: r["shard"] for r in sharding.shard(d, k).collect()} for k in (8, 9))
    assert sum(a[i] != b[i] for i in range(3000)) < 1500
    assert sharding.walk([5, 0, 9], [0, 1, 0], 2) == [(0, 0, 5, 0, 0), (2, 0, 2, 0, 5), (2, 2, 7, 1, 0)]


def test_toxicity(spark, empty):
    rng = random.Random(2)
    clean = ["".join(rng.choice("abcdefg") for _ in range(5)) for _ in range(200)]
    rows, labels = [], []
    for i in range(1000):
        w = [rng.choice(clean) for _ in range(40)]
        bad = i % 5 == 0
        if bad:
            w[3] = rng.choice(["zloser", "zl0ser", "zlоser"])
        elif i % 80 == 1:
            w[3:5] = ["zloser", "rocket"]
        rows.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lexicon = toxicity.learn(docs, spark.createDataFrame([*labels, (5, None), (None, 1)], "doc_id long, toxic int"))
    assert "zloser" in lexicon.terms and "zloser rocket" in lexicon.exceptions
    got = {r["doc_id"]: r["score"] for r in toxicity.scores(docs, lexicon).collect()}
    assert all((got[i] >= 0.7) == bool(y) for i, y in labels)
    odd = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "zloser " + "fine " * 20000, 9), (3, None, 9)], "doc_id long, text string, score int")
    scored = toxicity.scores(odd, lexicon).collect()
    assert len(scored) == 4 and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.scores(empty, lexicon).count() == 0 and toxicity.fit([]).terms == {}
    assert toxicity.learn(empty, spark.createDataFrame([], "doc_id long, toxic int")).terms == {}


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    centres = rng.standard_normal((30, 64))
    x = [c + 0.08 * rng.standard_normal(64) for c in centres for _ in range(12)] + [centres[0]] * 40 + list(rng.standard_normal((150, 64)))
    rows = [(i, [float(v) for v in np.float32(e)], int(i % 2 if i < 360 else 0)) for i, e in enumerate(x)]
    rows += [(9000, None, 0), (9001, [0.0] * 64, 0), (9002, [float("nan")] * 64, 0), (9003, [None] * 64, 0), (9004, rows[0][1], None), (9005, rows[0][1][:5], 0), (9006, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1)).withColumn("component", F.lit(2))
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in neighbours.near_duplicates(df, 0.98, block=64, reach=16).collect()}
    e = np.array([r[1] for r in rows[:-7]], float)
    u = e / np.linalg.norm(e, axis=1, keepdims=True)
    lab = np.array([r[2] for r in rows[:-7]])
    link = (u @ u.T >= 0.98) & (lab[:, None] == lab[None])
    np.fill_diagonal(link, False)
    reach = link | np.eye(len(e), dtype=bool)
    for _ in range(8):
        reach = (reach.astype(int) @ reach.astype(int)) > 0
    assert {i: got[i] for i in range(len(e))} == {i: (int(link[i].sum()), int(reach[i].argmax()), bool(reach[i].argmax() == i)) for i in range(len(e))}
    assert all(got[i] == (0, i, True) for i in range(9000, 9007))
    assert neighbours.near_duplicates(df.where("false")).count() == 0


def test_search(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((900, 64)).astype(np.float32)
    x[40:60] = x[39]
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)] + [(1000, None), (1020, [0.0] * 64), (1040, [float("inf")] * 64), (1060, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in search.search(df, F.col("vec_id") % 20 == 0, 20, rows=300).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"], r["rank"]))
    exact, hit = x.astype(float) @ x.astype(float).T, 0
    for q in range(0, 900, 20):
        best = sorted((i for i in range(900) if i != q), key=lambda i: (-exact[q, i], i))[:20]
        assert [r for _, _, r in got[q]] == list(range(1, 21)) and all(s == pytest.approx(exact[q, i]) for i, s, _ in got[q])
        hit += len(set(best) & {i for i, _, _ in got[q]})
    assert len(got) == 45 and hit / 900 >= 0.9
    assert [i for i, _, _ in got[40]][:19] == [39, *range(41, 59)]
    few = search.search(df.where("vec_id < 5"), F.col("vec_id") == 0, 20)
    assert few.count() == 4 and search.search(df.where("vec_id > 990"), F.lit(True)).count() == 0


def test_queries_are_registered():
    found = [re.match(r"op(\d+)_", k) for k in QUERIES]
    assert [int(m[1]) for m in found if m] == list(range(1, 14)) and set(SQL) <= set(QUERIES)


def test_sql(spark):
    c = duckdb.connect()
    sf = "/root/testdata/sf0.001"
    for t in ("documents", "embeddings", "labels"):
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    elsewhere = {"op12_codes", "op13_mixing", "licenses_base", "hmm_base"}  # have tests of their own
    for name, sql in SQL.items() - {(n, SQL[n]) for n in elsewhere}:
        ours, theirs = QUERIES[name](spark, sf).toPandas(), c.sql(sql).df()
        assert sorted(ours.columns) == sorted(theirs.columns)
        key = [k for k in ("query_id", "doc_id", "vec_id") if k in ours.columns]
        ours, theirs = (p[sorted(p.columns)].sort_values(key).reset_index(drop=True) for p in (ours, theirs))
        assert ours.astype(str).equals(theirs.astype(str)), name

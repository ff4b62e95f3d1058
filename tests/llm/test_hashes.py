"""Words that collide under polynomial hashes modulo 2**64, and an encoder whose hashes all collide."""

import random

import numpy as np
import pytest

from foliospark.llm import bpe, hmm, jaccard, kernels, packing
from foliospark.llm.queries import vocabulary


def thue_morse(k):
    w = "a"
    for _ in range(k):
        w += w.translate(str.maketrans("ab", "ba"))
    return w, w.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("k", [10, 11, 13])
def test_thue_morse(spark, k):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(vocabulary())
    df = spark.createDataFrame([*enumerate(thue_morse(k), 1), (3, " ".join(thue_morse(k)))], "doc_id long, text string")
    texts = {r["doc_id"]: r["text"] for r in df.collect()}
    enc = bpe.encoder(vocabulary())
    got = {r["doc_id"]: np.frombuffer(r["ids"], enc.dtype).tolist() for r in bpe.encode_rows(df, vocabulary()).collect()}
    assert got == {i: lib.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    packed = {r["doc_id"]: np.frombuffer(r["ids"], "<u4").tolist() for r in packing.pack(df.coalesce(1), vocabulary(), 1 << 16).collect()}
    assert packed == {i: [*ids, 0] for i, ids in got.items()}
    assert {r["component_id"] for r in jaccard.classes(df, 3, 90, 100).collect()} == {1, 2, 3}
    counted = hmm.count_words(df.select("text")).collect()
    assert sorted(r["c"] for r in counted) == [2, 2]


def test_word_hash():
    rng = random.Random(3)
    words = sorted({bytes(rng.choice(b"ab\0") for _ in range(rng.choice([1, 2, 7, 8, 9, 15, 16, 17, 40, 127, 128, 129, 300]))) for _ in range(4000)})
    for shift in range(3):
        data = np.frombuffer(b"x" * shift + b"".join(words), np.uint8)
        end = shift + np.cumsum([len(w) for w in words])
        h = kernels.word_hash(data, end - [len(w) for w in words], end)
        assert len(set(h.tolist())) == len(words) and (shift == 0 or np.array_equal(h, before))
        before = h


def test_encoder_checks_what_it_looks_up(monkeypatch):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "word_hash", lambda data, start, end: (end - start).astype(np.uint64) % np.uint64(3))
    lib, own = Tokenizer.from_file(vocabulary()), bpe.Encoder(vocabulary())
    texts = ["one two ten six", "", "<|endoftext|> three's", "übel 123 " * 30]
    assert [x.tolist() for x in own.texts(texts)] == [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_long_buffers_piece_by_piece(monkeypatch):
    from tokenizers import Tokenizer

    lib, own, rng = Tokenizer.from_file(vocabulary()), bpe.Encoder(vocabulary()), random.Random(5)
    bits = ["it's ", "we'll ", "a b", "<|endoftext|>", "<|endof text|>", "  x ", "日本 ", "12 3", "\n\n", " \t", "é à", "word ", "x" * 90, ""]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 60))) for _ in range(300)] + ["", "", "no" * 400, ""]
    want = [e.ids for e in lib.encode_batch(texts, add_special_tokens=False)]
    for size in (16, 100, 5000):
        monkeypatch.setattr(bpe, "PIECE", size)
        assert [x.tolist() for x in own.texts(texts)] == want
        whole = bpe.Part.encode(own, "".join(texts).encode())
        monkeypatch.setattr(bpe, "PIECE", 1 << 30)
        plain = bpe.Part.encode(own, "".join(texts).encode())
        assert all(np.array_equal(getattr(whole, f), getattr(plain, f)) for f in ("ids", "start", "place"))

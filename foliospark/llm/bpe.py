"""Byte-level BPE: a vectorised pre-tokeniser with a word cache, and tree concatenation for long text.

`Encoder.encode` cuts whole Arrow buffers into pre-tokens by array operations, encodes each distinct one once with
the tokenizers library and gathers the rest from a bounded cache, so cost follows distinct words.

Tree concatenation: a pre-token over LONG bytes is halved until short, the halves are encoded, and around each join
a window of tokens is encoded anew, growing until it begins with the left side's tokens and ends with the right
side's. Two adjacent tokens of a valid encoding stay valid wherever they stand, so one agreeing token on either side
makes the joined encoding exact. `encode_documents` does the same one level up: texts over LEAF characters are cut
into leaves that any executor encodes, and the joins look for a pre-token boundary that the window and the right
leaf share; from there on the scan, which has no memory, goes the same way.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.kernels import buffers, slices, word_hash
from foliospark.llm.shared import Idle, bounded, tidy

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
#: Pre-tokens above LONG bytes and texts above LEAF characters are encoded as trees; the cache holds CACHE words.
LONG, LEAF, CACHE = 2048, 32768, 1_000_000
#: Buffers of more bytes are encoded piece by piece.
PIECE = 1 << 20
#: Bytes of texts that are encoded at once: more than other kernels take, since words repeat.
SLICE = 1 << 19
LETTER, NUMBER, OTHER, WHITE = 1, 2, 3, 4


def classes(ask=None) -> np.ndarray:
    """Letter, number, other or white space, for every code point.

    Where two Unicode tables here differ, the code point is younger than one of them: `ask`, the tokenizer's own
    pre-tokeniser, then decides.
    """
    import regex

    out = np.full(0x110000, OTHER, np.uint8)
    for lo in range(0, 0x110000, 0x1000):  # in short strings, since this one would take 20 MB
        every = "".join(map(chr, range(lo, lo + 0x1000))) if not 0xD000 < lo + 0x1000 <= 0xE000 else "".join(map(chr, range(lo, 0xD800)))
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+")):
            for m in regex.finditer(pattern, every):
                out[ord(m[0][0]) : ord(m[0][-1]) + 1] = kind
    if ask:
        for c in range(0x80, 0x110000):
            known = unicodedata.category(chr(c))[0]
            if ({"L": LETTER, "N": NUMBER}.get(known, OTHER)) != out[c]:
                out[c] = LETTER if len(ask("a" + chr(c))) == 1 else NUMBER if len(ask("7" + chr(c))) == 1 else OTHER
    out[[9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = WHITE
    return out


def pretokens(data: np.ndarray, off: np.ndarray, kinds: np.ndarray, special: tuple[bytes, ...] = ()) -> np.ndarray:
    """Byte starts of the pre-tokens of all texts, in order; each text's first byte is one.

    The pattern: a contraction; letters, numbers or other signs, each with one space before it; white space but for
    the character before other text; white space. Special tokens stand alone.
    """
    if not len(data):
        return np.zeros(0, np.int64)
    raw = data.tobytes()
    points = np.frombuffer(raw.decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    at = np.flatnonzero((data & 0xC0) != 0x80)
    n = len(at)
    if len(points) != n:
        raise ValueError("text is not UTF-8")
    cuts, alone = off[:-1], []
    for token in special:
        i = raw.find(token)
        while i >= 0:
            if np.searchsorted(off, i, side="right") == np.searchsorted(off, i + len(token) - 1, side="right"):
                alone.append((i, i + len(token)))
            i = raw.find(token, i + len(token))
    if alone:
        cuts = np.union1d(cuts, np.array(alone).ravel())
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, cuts[cuts < len(data)])] = True
    first[n] = True
    kind = kinds[points]
    white, space = kind == WHITE, points == 32
    new = first[:n].copy()
    new[1:] |= kind[1:] != kind[:-1]
    start = new.copy()
    start[1:] &= ~(space[:-1] & ~white[1:] & ~first[1:n])  # a space goes with what follows
    start[:-1] |= white[:-1] & ~white[1:] & ~first[1:n]  # the last white character before text stands apart
    # contractions: an apostrophe that is a pre-token of its own so far, with a letter after it
    q = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~first[1:n]) if n > 1 else np.zeros(0, np.int64)
    if len(q):
        one = points[q + 1]
        two = np.where((q + 2 < n) & ~first[np.minimum(q + 2, n)], points[np.minimum(q + 2, n - 1)], 0)
        long = ((one == 114) | (one == 118)) & (two == 101) | (one == 108) & (two == 108)
        short = np.isin(one, (115, 116, 109, 100))
        for hit, size in ((q[short], 2), (q[long], 3)):
            start[hit + 1] = False
            end = hit + size
            end = end[end < n]
            start[end] |= True
    for a, b in alone:
        start[np.searchsorted(at, a) + 1 : np.searchsorted(at, b)] = False
    return at[start]


class Encoder:
    """Encodes and decodes with one tokenizer file; ids fit 16 bits where the vocabulary does, else 32."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.path = path
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.uint16 if size <= 1 << 16 else np.uint32
        shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
        back = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        added = {i: t.content for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.special = tuple(t.encode() for t in added.values())
        self.bytes = [b""] * size
        vocab = self.tokenizer.get_vocab()
        for token, i in vocab.items():
            self.bytes[i] = token.encode() if i in added else bytes(back[c] for c in token)
        self.size = np.array([len(b) for b in self.bytes], np.int64)
        self.spelt, self.spelt_at = np.frombuffer(b"".join(self.bytes), np.uint8), np.cumsum(self.size) - self.size
        self.number = {b: i for i, b in enumerate(self.bytes) if i in added}
        self.kinds = classes(self.tokenizer.pre_tokenizer.pre_tokenize_str)
        self._piece = None
        if self._ranked(vocab):
            del vocab
            self.tokenizer = None  # nothing asks it any more, and it is large
            self._piece = self._by_rank(added)
        self._forget()

    def _ranked(self, vocab: dict[str, int]) -> bool:
        """Whether the merges are in the order of their ids."""
        last = -1
        for m in json.loads(self.tokenizer.to_str())["model"]["merges"]:
            i = vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")]
            if i <= last:
                return False
            last = i
        return True

    def _by_rank(self, added: dict[int, str]):
        """The library's own merging in tiktoken, several times faster."""
        import tiktoken

        ranks = {self.bytes[i]: i for i in range(len(self.bytes)) if i not in added}
        return tiktoken.Encoding("own", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._encode_single_piece

    def _forget(self) -> None:
        self.keys, self.begin, self.length, self.flat = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, self.dtype)

    def plain(self, pieces: list[bytes]) -> list[list[int]]:
        """Pre-tokens' ids. A special token is a pre-token of its own."""
        if self._piece:
            return [self._piece(p) if p not in self.number else [self.number[p]] for p in pieces]
        return [e.ids for e in self.tokenizer.encode_batch_fast([p.decode() for p in pieces], add_special_tokens=False)]

    def word(self, piece: bytes) -> list[int]:
        """One pre-token; long ones as a tree of halves, cut between characters."""
        if len(piece) <= LONG:
            return self.plain([piece])[0]
        half = len(piece) // 2
        while piece[half] & 0xC0 == 0x80:
            half += 1
        return self.join(self.word(piece[:half]), self.word(piece[half:]))

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the concatenation of two encoded parts of one pre-token."""
        size = 8
        while True:
            a, b = max(0, len(left) - size), min(len(right), size)
            # the window begins and ends at whole characters
            while a and self.bytes[left[a]][:1] and self.bytes[left[a]][0] & 0xC0 == 0x80:
                a -= 1
            while b < len(right) and self.bytes[right[b]][0] & 0xC0 == 0x80:
                b += 1
            window = self.raw(left[a:] + right[:b])
            new = self.plain([window])[0]
            if (not a or new[:1] == left[a : a + 1]) and (b == len(right) or new[-1:] == right[b - 1 : b]):
                return left[:a] + new + right[b:]
            size *= 2

    def _learn(self, data: np.ndarray, start: np.ndarray, end: np.ndarray, keys: np.ndarray) -> None:
        raw = data.tobytes()
        pieces = [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        far = [i for i, p in enumerate(pieces) if len(p) > LONG]
        whole = [pieces[i] for i in far]
        for i in far:
            pieces[i] = b"-"
        ids = self.plain(pieces)
        for i, p in zip(far, whole, strict=True):
            ids[i] = self.word(p)
        n = np.fromiter(map(len, ids), np.int32, len(ids))
        begin = len(self.flat) + np.cumsum(n, dtype=np.int64) - n
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), self.dtype, int(n.sum()))])
        to = np.searchsorted(self.keys, keys)
        self.keys, self.begin, self.length = np.insert(self.keys, to, keys), np.insert(self.begin, to, begin), np.insert(self.length, to, n)

    def _find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.minimum(np.searchsorted(self.keys, keys), max(0, len(self.keys) - 1))
        return i, self.keys[i] == keys if len(self.keys) else np.zeros(len(keys), bool)

    def encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids of all texts, the n + 1 places where each text's begin; pre-tokens' byte starts and their ids' places.

        Words are looked up by hash, and the result is then spelt out: only if every pre-token's ids spell its own
        bytes were all looked up right; else the buffer is encoded without the cache.

        Long buffers are cut before a single space between an ASCII letter and another, which begins a pre-token
        whatever stands around it; so memory follows PIECE, not a text's length, wherever a text holds such a place.
        """
        encoder.touch(self.path)
        if len(data) <= PIECE:
            return self._encode(data, off)
        letter = np.zeros(256, bool)
        letter[[*range(65, 91), *range(97, 123)]] = True
        cuts, at = [0], 0
        while len(data) - at > PIECE:
            look = at + PIECE // 2
            while look < len(data):
                d = data[look : look + PIECE // 2]
                hit = np.flatnonzero(letter[d[:-2]] & (d[1:-1] == 32) & letter[d[2:]])
                if len(hit):
                    break
                look += max(1, len(d) - 2)
            if look >= len(data):
                break
            at = look + int(hit[-1]) + 1
            cuts.append(at)
        cuts.append(len(data))
        ids, starts, places, n = [], [], [np.zeros(1, np.int64)], 0
        begin = np.zeros(len(off), np.int64)
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            inside = np.flatnonzero((off >= a) & (off < b) | (off == len(data)) & (b == len(data)))
            own = np.unique(np.concatenate([[0], off[inside] - a, [b - a]]))
            i, at_own, start, place = self._encode(data[a:b], own)
            begin[inside] = n + at_own[np.searchsorted(own, off[inside] - a)]
            ids.append(i)
            starts.append(start + a)
            places.append(place[1:] + n)
            n += len(i)
        return np.concatenate(ids), begin, np.concatenate(starts), np.concatenate(places)

    def _encode(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        start = pretokens(data, off, self.kinds, self.special)
        if not len(start):
            return np.zeros(0, self.dtype), np.zeros(len(off), np.int64), start, np.zeros(1, np.int64)
        end = np.append(start[1:], len(data))
        keys, one, back = np.unique(word_hash(data, start, end), return_index=True, return_inverse=True)
        if len(self.keys) + len(keys) > CACHE:
            self._forget()  # what this buffer needs is learnt again, so the cache is CACHE words and one buffer's at most
        new = ~self._find(keys)[1]
        if new.any():
            self._learn(data, start[one[new]], end[one[new]], keys[new])
        i = self._find(keys)[0][back]
        n = self.length[i].astype(np.int64)
        places = np.zeros(len(n) + 1, np.int64)
        np.cumsum(n, out=places[1:])
        ids = self.flat[np.repeat(self.begin[i] - places[:-1], n) + np.arange(places[-1])]
        if not self._spells(ids, places, data, np.append(start, len(data))):
            raw = data.tobytes()
            each = [self.word(raw[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            places = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int64)
            ids = np.fromiter(chain.from_iterable(each), self.dtype, int(places[-1]))
        return ids, places[np.searchsorted(start, off)], start, places

    def _spells(self, ids: np.ndarray, places: np.ndarray, data: np.ndarray, at: np.ndarray) -> bool:
        """Whether the ids from places[i] on spell the bytes from at[i] on, for every i."""
        to = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(self.size[ids], out=to[1:])
        if not np.array_equal(to[places], at):
            return False
        return all(np.array_equal(self._spelt(ids[a : a + 65536]), data[to[a] : to[min(a + 65536, len(ids))]]) for a in range(0, len(ids), 65536))

    def _spelt(self, ids: np.ndarray) -> np.ndarray:
        n = self.size[ids]
        return self.spelt[np.repeat(self.spelt_at[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]

    def texts(self, values: list[str]) -> list[np.ndarray]:
        data, off = buffers(pa.array(values, pa.large_string()))
        ids, at, _, _ = self.encode(data, off)
        return [ids[a:b] for a, b in zip(at[:-1], at[1:], strict=True)]

    def raw(self, ids) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def decode(self, ids) -> str:
        return self.raw(ids).decode("utf-8", "replace")


#: One encoder for each file and Python worker, as long as tasks use it.
encoder = Idle(Encoder)


class Part:
    """An encoded stretch of a text: its bytes, ids, pre-tokens' starts and the ids' places there."""

    def __init__(self, raw: bytes, ids: np.ndarray, start: np.ndarray, place: np.ndarray):
        self.raw, self.ids, self.start, self.place = raw, ids, start, place

    @classmethod
    def encode(cls, enc: Encoder, raw: bytes) -> Part:
        ids, _, start, place = enc.encode(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        return cls(raw, ids, start, place)

    @classmethod
    def of(cls, enc: Encoder, raw: bytes, ids: np.ndarray) -> Part:
        start = pretokens(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]), enc.kinds, enc.special)
        at = np.zeros(len(ids) + 1, np.int64)
        np.cumsum(enc.size[ids], out=at[1:])
        return cls(raw, ids, start, np.searchsorted(at, np.append(start, len(raw))))


def concatenate(enc: Encoder, left: Part, right: Part) -> Part:
    """The encoding of two parts' concatenation, by a window around the join that grows until both sides agree.

    What follows a stretch of text changes its last two pre-tokens at most, so the window begins before them and must
    begin with the left part's own pre-token. It ends where a boundary of the window, clear of the window's end, is
    one of the right part's.
    """
    if not left.raw or not right.raw:
        return right if not left.raw else left
    size = 8
    while True:
        i, j = max(0, len(left.start) - size), min(len(right.start), size)
        begin, end = int(left.start[i]), int(right.start[j]) if j < len(right.start) else len(right.raw)
        window = Part.encode(enc, left.raw[begin:] + right.raw[:end])
        ahead = len(left.raw) - begin
        if j == len(right.start):
            cut, to = len(window.start), j
        else:
            near = window.start[: max(0, len(window.start) - 3)]
            both = near[(near >= ahead) & np.isin(near - ahead, right.start)]
            cut, to = (int(np.searchsorted(window.start, both[0])), int(np.searchsorted(right.start, both[0] - ahead))) if len(both) else (0, 0)
        same = i == 0 or len(window.start) > 1 and window.start[1] == left.start[i + 1] - begin
        if cut and same:
            return Part(
                left.raw + right.raw,
                np.concatenate([left.ids[: left.place[i]], window.ids[: window.place[cut]], right.ids[right.place[to] :]]),
                np.concatenate([left.start[:i], window.start[:cut] + begin, right.start[to:] + len(left.raw)]),
                np.concatenate([left.place[:i], window.place[:cut] + left.place[i], right.place[to:] - right.place[to] + left.place[i] + window.place[cut]]),
            )
        size *= 4


def tree(enc: Encoder, parts: list[Part]) -> Part:
    while len(parts) > 1:
        parts = [concatenate(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def encode_rows(docs: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """doc_id and ids (binary, little-endian of the encoder's width) of every row's whole text; null: empty.

    Texts up to `leaf` characters are encoded where they are read. Longer ones, equal rows together, are cut into
    leaves that are dealt to all tasks, and their encodings joined as a tree. Repeated rows and rows without doc_id
    give rows of their own; no rows give no rows; columns beside doc_id and text are ignored.
    """
    bounded(docs.sparkSession)
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        enc = encoder(path)
        for batch in batches:
            for part in slices(batch, size=SLICE):
                ids, at, _, _ = enc.encode(*buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), binary(ids, at)], ["doc_id", "ids"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        enc = encoder(path)
        for batch in batches:
            for part in slices(batch, size=SLICE):
                ids, at, _, _ = enc.encode(*buffers(part.column("text")))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("doc_id", "h", "n", "leaf", "text")), binary(ids, at)], ["doc_id", "h", "n", "leaf", "text", "ids"])

    def joined(key, t):
        tidy()
        enc = encoder(path)
        rows = sorted(t.to_pylist(), key=lambda r: r["leaf"])
        whole = tree(enc, [Part.of(enc, r["text"].encode(), np.frombuffer(r["ids"], enc.dtype)) for r in rows])
        return pa.table({"doc_id": pa.array([key[0].as_py()], pa.int64()), "n": pa.array([rows[0]["n"]], pa.int64()), "ids": pa.array([whole.ids.tobytes()], pa.binary())})

    out = "doc_id long, ids binary"
    length = F.length("text")
    long = texts.where(length > leaf).groupBy("doc_id", "text").agg(F.count("*").alias("n"))
    cut = long.select("doc_id", F.xxhash64("text").alias("h"), "n", F.explode(F.sequence(F.lit(0), F.expr(f"cast((length(text) - 1) div {leaf} as int)"))).alias("leaf"), "text")
    cut = cut.select("doc_id", "h", "n", "leaf", F.expr(f"substring(text, leaf * {leaf} + 1, {leaf})").alias("text"))
    spread = cut.repartition("doc_id", "leaf").mapInArrow(leaves, "doc_id long, h long, n long, leaf int, text string, ids binary")
    whole = spread.groupBy("doc_id", "h").applyInArrow(joined, "doc_id long, n long, ids binary")
    # copies are made one row at a time, after the encoding
    whole = whole.withColumn("copy", F.explode(F.expr("sequence(1L, n)"))).select("doc_id", "ids")
    return texts.where(length <= leaf).mapInArrow(short, out).union(whole)


def binary(values: np.ndarray, at: np.ndarray) -> pa.Array:
    """Slices of an array as an Arrow binary column."""
    size = values.dtype.itemsize
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * size).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(values))])


def digests(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of decimal ids between commas) and decoded_sha256 (of the decoded text's UTF-8)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        enc = encoder(path)
        for b in batches:
            n, i, d = [], [], []
            for raw in b.column("ids"):
                ids = np.frombuffer(raw.as_buffer(), enc.dtype).tolist()
                n.append(len(ids))
                i.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                d.append(hashlib.sha256(enc.decode(ids).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(i, pa.string()), pa.array(d, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return encoded.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

"""Hidden Markov language model: Baum-Welch counts summed over partitions, exact likelihood by the scaled forward.

A token is one of the model's symbols: a frequent word, the end of a text, or the class of all other words with the
same ending. States emit symbols; within a class words follow their smoothed counts. So a text's probability is the
forward sum over its symbols times its rarer words' shares of their classes, and sums to one over all words.

Word counts come from all training texts. Words of at least one in HEAD tokens, HEAD at most whatever the input, are
broadcast; the rest are looked up by a join. Training and scoring run over whole texts. Long ones are cut into
stretches of SPAN symbols that run side by side: for every stretch the recursion from each state at once gives a
matrix, a text's matrices multiply in order, and what they carry from stretch to stretch, forward and for training
backward too, is what one recursion over the whole text would carry. Only a text's own first symbol counts as a start.
A time's states of all stretches lie side by side, and are scaled at every SCALED-th time; texts of one stretch need no
matrix.

The most frequent words (`frequent`) are symbols of their own; every other word is one of `endings` classes. Both are
arguments, up to 65,535 symbols in all: states tell more words apart as they grow, and no word is left out.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.kernels import SPACE, buffers, slices, word_offsets, words
from foliospark.llm.shared import bounded, materialize, temporary, tidy

STATES, FREQUENT, ENDINGS, HEAD, SPAN, ROUNDS = 4, 8192, 256, 1 << 20, 512, 4
#: Words that a task holds before it sums them, symbols of one pass of the recursions, and steps between two scalings.
HELD, BLOCK, SCALED = 1 << 20, 1 << 18, 8
#: Of the smoothing that the plain counts have too.
ADD = 0.1


def held_out(column: str = "doc_id"):
    """True on rows that aren't learnt from: crc32 of the id as text is divisible by 10, or there is no id."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 10 == 0, F.lit(True))


def _tokens(b: pa.RecordBatch, endings: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word hashes, ending classes, and the words' places by text."""
    data, off = buffers(b.column("text"))
    start, end, h = words(data, off, SPACE)
    low = np.where((data >= 65) & (data <= 90), data + 32, data)
    k = np.zeros(len(h), np.int64)
    for j in (1, 2, 3):
        at = end - j
        k = k * 257 + np.where(at >= start, low[np.maximum(at, 0)].astype(np.int64) if len(low) else 0, 256)
    return h, (k * 2654435761 >> 13) % endings, word_offsets(start, off)


def _merged(h: np.ndarray, k: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(h)
    h = h[order]
    one = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else order
    return h[one], k[order[one]], np.add.reduceat(c[order], one) if len(h) else c


def summed(words: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes, classes and counts of the words that come. They are summed when HELD of them are there, not as they come,
    and go on when that gains too little: so a word is sorted a few times at most, however many there are."""
    held, rows = [], 0
    for h, k in words:
        held.append((h, k, np.ones(len(h), np.int64)))
        rows += len(h)
        if rows > HELD:
            held = [_merged(*map(np.concatenate, zip(*held, strict=True)))]
            rows = len(held[0][0])
            if 2 * rows > HELD:
                yield held.pop()
                rows = 0
    if held:
        yield _merged(*map(np.concatenate, zip(*held, strict=True)))


def count_words(texts: DataFrame, endings: int = ENDINGS) -> DataFrame:
    """h, k, c: hash, ending class and count of every word; a task sums its own words before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        yield from map(out, summed(_tokens(b, endings)[:2] for batch in batches for b in slices(batch)))

    def out(x) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], ["h", "k", "c"])

    return texts.mapInArrow(run, "h long, k int, c long").groupBy("h").agg(F.first("k").alias("k"), F.sum("c").alias("c"))


@dataclass
class Counts:
    """Sorted hashes, classes and counts of the head words, and the corpus's totals."""

    h: np.ndarray
    k: np.ndarray
    c: np.ndarray
    total: int
    distinct: int
    ends: int
    frequent: np.ndarray
    class_total: np.ndarray
    class_distinct: np.ndarray
    top: int = FREQUENT

    @property
    def end(self) -> int:
        """The symbol of a text's end, the last one."""
        return self.top + len(self.class_total)

    def __post_init__(self):
        self.base_floor = np.log10(self.total + ADD * (self.distinct + 1)) if self.distinct else np.log10(ADD)
        self.class_floor = np.log10(self.class_total + ADD * (self.class_distinct + 1))

    @functools.cached_property
    def _table(self) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Where hashes of the same leading bits begin, and by head word: hash, symbol if frequent (or -1), log10 of its count."""
        bits = max(1, int(len(self.h)).bit_length())
        first = np.searchsorted(self.h, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)).astype(np.int32)
        symbol = np.full(len(self.h) + 1, -1, np.int32)
        symbol[np.searchsorted(self.h, self.frequent)] = np.arange(len(self.frequent))
        return bits, first, np.append(self.h, np.uint64(0xFFFFFFFFFFFFFFFF)), symbol, np.append(np.log10(self.c + ADD), 0.0)

    def look(self, h: np.ndarray, k: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words are in the head, log10 of their smoothed counts there (else 0), and every word's symbol."""
        bits, first, own, symbol, log = self._table
        i = first[(h >> np.uint64(64 - bits)).astype(np.int64)]
        behind = np.flatnonzero(own[i] < h)
        while len(behind):
            i[behind] += 1
            behind = behind[own[i[behind]] < h[behind]]
        known = (own[i] == h) & (i < len(self.h))
        found = np.where(known, symbol[i], -1)
        return known, np.where(known, log[i], 0.0), np.where(found >= 0, found, self.top + k).astype(np.uint16)


def totals(vocabulary: DataFrame, ends: int, frequent: int = FREQUENT, endings: int = ENDINGS) -> tuple[Counts, int]:
    """The counts to broadcast, and the least count of a head word."""
    r = vocabulary.agg(F.sum("c").alias("n"), F.count("*").alias("v")).first()
    n, v = (r["n"] or 0) + ends, r["v"] + (ends > 0)
    least = max(1, -(-n // HEAD))
    head = vocabulary.where(F.col("c") >= least).toArrow()  # n / least <= HEAD words
    h, k, c = head.column("h").to_numpy().view(np.uint64), head.column("k").to_numpy(), head.column("c").to_numpy()
    order = np.argsort(h)
    h, k, c = h[order], k[order], c[order]
    top = np.sort(np.lexsort((h, -c))[:frequent])
    by = np.zeros((2, endings), np.int64)
    for r in vocabulary.groupBy("k").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # one row a class
        by[:, r["k"]] = r["n"], r["v"]
    by[0] -= np.bincount(k[top], weights=c[top], minlength=endings).astype(np.int64)
    by[1] -= np.bincount(k[top], minlength=endings)
    counts = Counts(h, k, c, n, v, ends, h[top], by[0], by[1], frequent)
    return counts, least


@dataclass
class Model:
    start: np.ndarray
    step: np.ndarray
    emit: np.ndarray  # symbols x states

    @classmethod
    def initial(cls, counts: Counts, states: int) -> Model:
        """The corpus's own distribution, tilted differently for each state."""
        own = np.full(counts.end + 1, 0.5)
        own[: len(counts.frequent)] += counts.c[np.searchsorted(counts.h, counts.frequent)]
        own[counts.top : counts.end] += counts.class_total
        own[counts.end] += counts.ends
        tilt = np.exp(0.7 * np.random.default_rng(5).standard_normal((len(own), states)))
        emit = own[:, None] * tilt
        step = np.full((states, states), 0.02 / max(1, states - 1))
        np.fill_diagonal(step, 0.98 if states > 1 else 1.0)
        return cls(np.full(states, 1 / states), step, emit / emit.sum(0))

    def updated(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray) -> Model:
        start, step = start + 0.1, step + 0.1
        emit = emit + 0.2 * emit.sum(1, keepdims=True) / max(emit.sum(), 1e-300) + 1e-3
        return Model(start / start.sum(), step / step.sum(1, keepdims=True), emit / emit.sum(0))


def _stretches(at: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequences cut every `span` symbols: each stretch's sequence, first symbol and length."""
    n = -(-np.diff(at) // span)
    seq = np.repeat(np.arange(len(n)), n)
    first = at[seq] + span * (np.arange(len(seq)) - np.repeat(np.cumsum(n) - n, n))
    return seq, first, np.minimum(span, at[seq + 1] - first)


def _blocks(size: np.ndarray) -> list[np.ndarray]:
    """Stretches, the longest first, in groups of about BLOCK symbols."""
    order = np.argsort(-size, kind="stable")
    group = (np.cumsum(size[order]) - 1) // BLOCK
    return np.split(order, np.flatnonzero(np.diff(group)) + 1) if len(order) else []


def _by_time(x: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of stretches, the longest first, time by time, and where each time begins."""
    live = np.searchsorted(-size, -np.arange(size[0]))  # longer than t
    at = np.concatenate([[0], np.cumsum(live)])
    time = np.repeat(np.arange(size[0]), live)
    return x[first[np.arange(at[-1]) - at[time]] + time], at


def _transfers(model: Model, x: np.ndarray, seq: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each stretch's transfer matrix, scaled, and the log10 of its scale. A text's first symbol takes no step."""
    s = len(model.start)
    head = np.ones(len(seq), bool)
    head[1:] = seq[1:] != seq[:-1]
    mats, logs = np.zeros((len(seq), s, s)), np.zeros(len(seq))
    step, emission = np.ascontiguousarray(model.step.T), np.ascontiguousarray(model.emit.T)
    for i in _blocks(size):
        sym, o = _by_time(x, first[i], size[i])
        e, log = np.take(emission, sym, axis=1), np.zeros(len(i))
        m = np.where(head[i], np.eye(s)[:, :, None], model.step[:, :, None])  # from, to, stretch
        places = [*zip(o[:-1].tolist(), o[1:].tolist(), strict=True), (0, 0)]
        for t, ((a, b), (c, d)) in enumerate(zip(places[:-1], places[1:], strict=True)):
            m = np.matmul(step, m[:, :, : b - a]) if t else m
            m *= e[:, a:b]
            if t % SCALED == SCALED - 1 or t == len(places) - 2:
                z = m.max(axis=(0, 1))
                m /= z
                log[: b - a] += np.log10(z)
            if d - c < b - a:
                mats[i[d - c : b - a]] = m[:, :, d - c :].transpose(2, 0, 1)
        logs[i] = log
    return mats, logs


def _turns(seq: np.ndarray) -> list[np.ndarray]:
    """The stretches that are their texts' first, second, and so on."""
    turn = np.arange(len(seq)) - np.searchsorted(seq, seq)
    order = np.argsort(turn, kind="stable")
    return np.split(order, np.cumsum(np.bincount(turn))[:-1]) if len(seq) else []


def _carried(model: Model, x: np.ndarray, seq: np.ndarray, first: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What each stretch gets from those before it (state weights at its end of theirs) and after it, each of sum one."""
    s = len(model.start)
    ahead, behind = np.tile(model.start, (len(seq), 1)), np.ones((len(seq), s))
    several = np.flatnonzero(np.bincount(seq)[seq] > 1)
    if len(several):
        own = seq[several]
        mats, _ = _transfers(model, x, own, first[several], size[several])
        turns = _turns(own)
        for now, then in zip(turns[:-1], turns[1:], strict=True):
            now = now[np.isin(own[now], own[then])]
            v = np.einsum("ni,nij->nj", ahead[several[now]], mats[now])
            ahead[several[then]] = v / v.sum(1, keepdims=True)
        for then, now in zip(turns[:0:-1], turns[-2::-1], strict=True):
            now = now[np.isin(own[now], own[then])]
            v = np.einsum("nij,nj->ni", mats[then], behind[several[then]])
            behind[several[now]] = v / v.sum(1, keepdims=True)
    return ahead, behind


def _forward(model: Model, e: np.ndarray, at: np.ndarray, v: np.ndarray, out: np.ndarray) -> np.ndarray:
    """Fill `out` with state weights time by time, from `v` at the first, and give the log10 of what they were divided by."""
    step, log = np.ascontiguousarray(model.step.T), np.zeros(v.shape[1])
    for t, (a, b) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), strict=True)):
        if t:
            v = step @ v[:, : b - a]
        v = np.multiply(v, e[:, a:b], out=out[:, a:b])
        if t % SCALED == SCALED - 1:
            z = v.sum(0)
            v /= z
            log[: b - a] += np.log10(z)
    return log


def expected(model: Model, x: np.ndarray, at: np.ndarray, span: int = SPAN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of starts, steps and symbols by state, over the whole sequences."""
    s = len(model.start)
    begin, step, emit, emission = np.zeros(s), np.zeros((s, s)), np.zeros(model.emit.shape), np.ascontiguousarray(model.emit.T)
    seq, first, size = _stretches(at, span)
    before, after = (np.ascontiguousarray(y.T) for y in _carried(model, x, seq, first, size))
    starts = np.ones(len(seq), bool)
    starts[1:] = seq[1:] != seq[:-1]
    for i in _blocks(size):
        head, came = starts[i], before[:, i]
        sym, o = _by_time(x, first[i], size[i])
        e = np.take(emission, sym, axis=1)
        ahead, back, ends = np.empty_like(e), np.empty_like(e), after[:, i]
        _forward(model, e, o, np.where(head, came, model.step.T @ came), ahead)
        places = list(zip(o[:-1].tolist(), o[1:].tolist(), strict=True))
        w = e[:, :0]  # what a time and all after it weigh, in the place of e
        for t in range(len(places) - 1, -1, -1):
            a, b = places[t]
            k = w.shape[1]
            np.matmul(model.step, w, out=back[:, a : a + k])
            back[:, a + k : b] = ends[:, k : b - a]
            w = np.multiply(e[:, a:b], back[:, a:b], out=e[:, a:b])
            if t % SCALED == 0:
                w /= w.sum(0)
        ahead /= np.einsum("sn,sn->n", ahead, back)
        steps = np.zeros((s, s))
        for (a, _), (c, d) in zip(places[:-1], places[1:], strict=True):
            steps += ahead[:, a : a + d - c] @ e[:, c:d].T
        came, w = came[:, ~head], w[:, ~head]  # the step from the stretch before
        steps += (came / np.einsum("sn,sn->n", came, model.step @ w)) @ w.T
        step += model.step * steps
        back *= ahead
        begin += back[:, : len(i)][:, head].sum(1)
        for k in range(s):
            emit[:, k] += np.bincount(sym, weights=back[k], minlength=len(emit))
    return begin, step, emit


def likelihood(model: Model, x: np.ndarray, at: np.ndarray, span: int = SPAN) -> np.ndarray:
    """log10 probability of every whole sequence: by its states' weights, or its stretches' matrices multiplied in order."""
    seq, first, size = _stretches(at, span)
    several = np.bincount(seq, minlength=len(at) - 1)[seq] > 1
    out, v = np.zeros(len(at) - 1), np.tile(model.start, (len(at) - 1, 1))
    emission, single = np.ascontiguousarray(model.emit.T), np.flatnonzero(~several)
    for i in _blocks(size[single]):
        i = single[i]
        sym, o = _by_time(x, first[i], size[i])
        e = np.take(emission, sym, axis=1)
        log = _forward(model, e, o, np.repeat(model.start[:, None], len(i), axis=1), e)
        out[seq[i]] = log + np.log10(e[:, o[size[i] - 1] + np.arange(len(i))].sum(0))
    seq, first, size = seq[several], first[several], size[several]
    mats, logs = _transfers(model, x, seq, first, size)
    for i in _turns(seq):
        d = seq[i]
        w = np.einsum("ni,nij->nj", v[d], mats[i])
        z = w.sum(1)
        v[d] = w / z[:, None]
        out[d] += logs[i] + np.log10(z)
    return out


def code(texts: DataFrame, counts) -> DataFrame:
    """Each row's symbols, its head words' share of both scores, and the words to look up (rare)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        own = counts.value
        end_base = np.log10(own.ends + ADD) - own.base_floor
        for batch in batches:
            for b in slices(batch):
                h, k, at = _tokens(b, len(own.class_total))
                head, log, sym = own.look(h, k)
                base = np.where(head, log - own.base_floor, 0)
                share = np.where(head & (sym >= own.top), log - own.class_floor[k], 0)
                sums = [np.concatenate([[0], np.cumsum(y)]) for y in (base, share, head.astype(np.int64))]
                base, share, known = (np.diff(y[at]) for y in sums)
                n = np.diff(at)
                ids = np.insert(sym, at[1:], own.end)
                ends = at + np.arange(len(at))
                rare = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(~head)])[at].astype(np.int32)), pa.StructArray.from_arrays([pa.array(h[~head].view(np.int64)), pa.array(k[~head].astype(np.int32))], ["h", "k"]))
                seqs = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * 2).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(ids))])
                yield pa.RecordBatch.from_arrays(
                    [b.column("doc_id"), b.column("rid"), b.column("held_out"), pa.array(n + 1), pa.array(known + (own.ends > 0)), pa.array(base + end_base), pa.array(share), seqs, rare],
                    ["doc_id", "rid", "held_out", "n_tokens", "known", "base", "share", "seq", "rare"],
                )

    return texts.mapInArrow(run, "doc_id long, rid long, held_out boolean, n_tokens long, known long, base double, share double, seq binary, rare array<struct<h: long, k: int>>")


def _sequences(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    at = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return np.frombuffer(column.buffers()[2], np.uint16)[at[0] // 2 : at[-1] // 2], (at - at[0]) // 2


def train(coded: DataFrame, counts: Counts, states: int = STATES, rounds: int = ROUNDS) -> Model:
    """Baum-Welch over every training row; each round sums one matrix a task, in slices, and keeps the sums."""
    model, spark = Model.initial(counts, states), coded.sparkSession
    symbols = counts.end + 1
    size = symbols * states
    parts = 16
    width = -(-size // parts)

    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            tidy()
            total = None
            for b in batches:
                if b.num_rows:
                    for lo in range(0, b.num_rows, 1000):
                        new = expected(shared.value, *_sequences(b.column("seq").slice(lo, 1000)))
                        total = new if total is None else tuple(x + y for x, y in zip(total, new, strict=True))
            if total is not None:
                flat = np.concatenate([total[2].ravel(), np.zeros(parts * width - size)]).reshape(parts, width)
                rows = [*flat, np.concatenate([total[0], total[1].ravel()])]
                yield pa.RecordBatch.from_arrays([pa.array(range(parts + 1), pa.int32()), pa.array([r.tobytes() for r in rows], pa.binary())], ["part", "sums"])

        def add(key, t):
            tidy()
            total = sum(np.frombuffer(x, np.float64) for x in sorted(t.column("sums").to_pylist()))
            return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

        sums = {r["part"]: np.frombuffer(r["sums"], np.float64) for r in coded.where("not held_out").select("seq").mapInArrow(run, "part int, sums binary").groupBy("part").applyInArrow(add, "part int, sums binary").collect()}
        if not sums:
            break
        rest = sums[parts]
        model = model.updated(rest[:states], rest[states:].reshape(states, states), np.concatenate([sums[i] for i in range(parts)])[:size].reshape(symbols, states))
    return model


def _texts(docs: DataFrame) -> DataFrame:
    bounded(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumns({"held_out": held_out(), "rid": F.xxhash64("doc_id", "text")})


def _coded(texts: DataFrame, frequent: int, endings: int, more: tuple[str, ...]) -> tuple[DataFrame, DataFrame, Counts]:
    """The coded texts, with further columns of the model, the sums of their looked-up words, and the counts."""
    spark, learnt = texts.sparkSession, texts.where("not held_out")
    with temporary(spark) as keep:
        vocabulary = materialize(count_words(learnt.select("text"), endings), "words")
        counts, least = totals(vocabulary, learnt.count(), frequent, endings)
        coded = code(texts, spark.sparkContext.broadcast(counts)).select("doc_id", "rid", "held_out", "n_tokens", "known", "base", *more, "rare")
        coded = keep(materialize(coded, "coded"))

        # the rest of the words, looked up
        rare = vocabulary.where(F.col("c") < least).select("h", "c")
        floor = F.array(*[F.lit(float(x)) for x in counts.class_floor])
        asked = coded.where(F.size("rare") > 0).select("rid", F.explode("rare").alias("w")).select("rid", "w.h", "w.k")
        told = asked.join(rare, "h", "left").select("rid", F.log10(F.coalesce("c", F.lit(0)) + ADD).alias("l"), F.element_at(floor, F.col("k") + 1).alias("f"), F.col("c").isNotNull().cast("long").alias("seen"))
        told = keep(materialize(told.groupBy("rid").agg(F.sum(F.col("l") - float(counts.base_floor)).alias("more_base"), F.sum(F.col("l") - F.col("f")).alias("more_share"), F.sum("seen").alias("more_known"), F.count("*").alias("words")), "rare"))
    return coded, told, counts


def _whole(rows: DataFrame, coded: DataFrame, told: DataFrame, counts: Counts, *more) -> DataFrame:
    """Rows with the sums of their looked-up words; rows of one id and text share them, and each has them once."""
    none = F.lit(0.0)
    return rows.join(told.join(_copies(coded), "rid"), "rid", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce(F.col("more_known") / F.col("rows"), none)).cast("long").alias("n_known"), F.lit(counts.total).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce(F.col("more_base") / F.col("rows"), none)).alias("base_score"), *more,
    )


def base(docs: DataFrame, frequent: int = FREQUENT, endings: int = ENDINGS) -> DataFrame:
    """What `score` gives but for the model's score, by the same steps; no model is trained for it."""
    coded, told, counts = _coded(_texts(docs), frequent, endings, ())
    return _whole(coded, coded, told, counts)


def score(docs: DataFrame, states: int = STATES, rounds: int = ROUNDS, frequent: int = FREQUENT, endings: int = ENDINGS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    A null or empty text is its end alone. Rows with a null id are scored but not learnt from; equal rows, and rows
    that share an id, are texts of their own. Without training rows every token is unknown. No rows give no rows;
    columns beside doc_id and text are ignored.
    """
    spark = docs.sparkSession
    coded, told, counts = _coded(_texts(docs), frequent, endings, ("share", "seq"))
    model = spark.sparkContext.broadcast(train(coded, counts, states, rounds))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in part.schema.names[:-1]), pa.array(likelihood(model.value, *_sequences(part.column("seq"))))], [*part.schema.names[:-1], "forward"])

    shape = "doc_id long, rid long, held_out boolean, n_tokens long, known long, base double, share double"
    main = coded.select("doc_id", "rid", "held_out", "n_tokens", "known", "base", "share", "seq").mapInArrow(run, shape + ", forward double")
    return _whole(main, coded, told, counts, (F.col("forward") + F.col("share") + F.coalesce(F.col("more_share") / F.col("rows"), F.lit(0.0))).alias("score"))


def _copies(coded: DataFrame) -> DataFrame:
    return coded.groupBy("rid").agg(F.count("*").alias("rows"))

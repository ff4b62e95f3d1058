"""Toxicity by a weighted lexicon, matched with Aho-Corasick over folded text.

Folding lower-cases, maps look-alike letters of other scripts to Latin ones and, inside words that hold a letter,
digits and signs to the letters they stand for. Terms are whole words or word beginnings; their weights are smoothed
log odds of document frequencies, learnt from labelled rows. Phrases of two words that hold a term but keep to
non-toxic rows become exceptions: a match inside one doesn't count. The score grows with matched weight per
square root of the text's length, so that one term in a long text counts less than in a short one, by a logistic
curve fitted on the same rows.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from foliospark.llm.shared import bounded, tidy

#: Letters of other scripts that look like Latin ones, and signs that stand for letters.
LOOKALIKES = dict(zip("аеорсухіјѕԁһԛԝɡαορνικτυ", "aeopcyxijsdhqwgaopviktu", strict=True))
SIGNS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i"}
_FOLD = str.maketrans(LOOKALIKES | {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)} | dict.fromkeys("\u200b\u200c\u200d\u2060\ufeff\u00ad"))
_ODD = re.compile("[" + "".join(map(chr, _FOLD)) + "]")
_SIGN = str.maketrans(SIGNS)
#: A sign or digit beside a letter, and then the whole word that it stands in.
_NEAR = re.compile(r"[^\W\d_][0-9@$]|[0-9@$][^\W\d_]|[^\W\d_]![^\W\d_]")
_MIXED = re.compile(r"[\w@$]+(?:![\w@$]+)*")

#: At most so many labelled rows, those of the smallest hashes, of so many characters in all, are read to fit the lexicon.
SAMPLE, CHARACTERS = 8_000, 64_000_000
STEMS = (4, 5, 6)
_WORD = re.compile(r"[^\W_]+")


def _unsign(m: re.Match) -> str:
    w = m[0]
    return w.translate(_SIGN) if _NEAR.search(w) else w


def fold(text: str) -> str:
    """The text in lower case, look-alikes as Latin letters, and signs as letters in words that hold both."""
    t = text.lower()
    if _ODD.search(t):
        t = t.translate(_FOLD)
    return _MIXED.sub(_unsign, t) if _NEAR.search(t) else t


@dataclass
class Lexicon:
    """terms: a word, or a stem with '*' after it, to its weight; exceptions: two words whose matches are harmless."""

    terms: dict[str, float] = field(default_factory=dict)
    exceptions: tuple[str, ...] = ()
    slope: float = 1.0
    bias: float = -4.0

    def automaton(self):
        a = ahocorasick.Automaton()
        both = dict(self.terms)
        for term in {t.rstrip("*") for t in both}:
            a.add_word(term, (len(term), both.get(term, 0.0), both.get(f"{term}*", 0.0)))
        for phrase in self.exceptions:
            a.add_word(phrase, (len(phrase), None, None))
        if len(a):
            a.make_automaton()
        return a


def matches(folded: str, automaton) -> dict[int, tuple[int, float]]:
    """First character to end and weight of each word with a term; words inside exceptions don't count."""
    if not len(automaton):
        return {}
    best: dict[int, tuple[int, float]] = {}
    void, n = [], len(folded)
    for end, (size, word, stem) in automaton.iter(folded):
        a, b = end - size + 1, end + 1
        if a and folded[a - 1].isalnum():
            continue
        whole = b == n or not folded[b].isalnum()
        if word is None:
            if whole:
                void.append((a, b))
        elif w := max(word if whole else 0.0, stem if not whole else 0.0):
            best[a] = max(best.get(a, (b, 0.0)), (b, w), key=lambda x: x[1])
    if not void:
        return best
    void.sort()
    first, reach = [p for p, _ in void], list(accumulate((q for _, q in void), max))
    return {a: x for a, x in best.items() if not (i := bisect_right(first, a)) or reach[i - 1] < x[0]}


def density(folded: str, automaton) -> float:
    """Weight of the distinct words matched, over the square root of one and the length in hundreds of words."""
    found = matches(folded, automaton)
    return sum({folded[a:b]: w for a, (b, w) in found.items()}.values()) / math.sqrt(1 + folded.count(" ") / 100) if found else 0.0


def score(folded: str, automaton, lexicon: Lexicon) -> float:
    x = lexicon.slope * density(folded, automaton) + lexicon.bias
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, x))))


def _features(folded: str) -> set[str]:
    own = set(_WORD.findall(folded))
    return own | {f"{w[:n]}*" for w in own for n in STEMS if len(w) > n}


def fit(rows: Iterable[tuple[str | None, int | None]], least: int = 10, odds: float = 3.5) -> Lexicon:
    """A lexicon from (text, toxic) rows; null texts are empty, rows without a label are left out, repeats count once.

    A stem is kept where its words are many and share its weight; a word or longer stem that begins with a stem
    already kept is dropped unless it tells clearly more.
    """
    seen = sorted({(fold(t or ""), int(y)) for t, y in rows if y is not None})
    n1 = sum(y for _, y in seen)
    n0 = len(seen) - n1
    if not n1 or not n0:
        return Lexicon()
    df1: Counter = Counter()
    for t, y in seen:
        if y:
            df1.update(_features(t))
    candidates = {f for f, n in df1.items() if n >= least}
    df0: Counter = Counter()
    for t, y in seen:
        if not y:
            df0.update(candidates & _features(t))
    weight = {f: w for f in candidates if (w := math.log((df1[f] + 0.5) / (n1 + 1)) - math.log((df0[f] + 0.5) / (n0 + 1))) >= odds}
    single = {f[: n] + "*" for f in weight if f[-1] != "*" for n in STEMS if df1[f] >= 0.8 * df1[f[:n] + "*"]}  # one word, no stem
    terms: dict[str, float] = {}
    for f in sorted(weight.keys() - single, key=lambda f: (f[-1] != "*", len(f), f)):
        kin = [terms[s] for n in STEMS if n < len(f.rstrip("*")) and (s := f"{f[:n]}*") in terms]
        if not kin or max(kin) < weight[f] - 1:
            terms[f] = weight[f]
    auto = Lexicon(terms).automaton()
    pairs: dict[int, Counter] = {0: Counter(), 1: Counter()}
    for t, y in seen:
        found = set()
        for a, (b, _) in matches(t, auto).items():
            m = _WORD.match(t, a)
            b = m.end() if m else b
            if n := _WORD.match(t, b + 1):
                found.add(t[a : n.end()])
            if a and (w := _WORD.findall(t[max(0, a - 40) : a - 1])) and t.startswith(w[-1], a - 1 - len(w[-1])):
                found.add(t[a - 1 - len(w[-1]) : b])
        pairs[y].update(found)
    exceptions = tuple(sorted(p for p, n in pairs[0].items() if n >= 5 and n / n0 > 3 * (pairs[1][p] + 0.5) / n1))
    lexicon = Lexicon(terms, exceptions)
    auto = lexicon.automaton()
    x = np.array([density(t, auto) for t, _ in seen])
    y = np.array([v for _, v in seen], float)
    x, y = np.append(x, [0.0, 20.0]), np.append(y, [0.0, 1.0])
    a, b = 1.0, -3.0
    for _ in range(200):  # Newton steps of a ridge logistic fit in one variable
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        g = np.array([((p - y) * x).sum() + 0.1 * a, (p - y).sum()])
        v = p * (1 - p)
        h = np.array([[(v * x * x).sum() + 0.1, (v * x).sum()], [(v * x).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -1, 1))
        if abs(step).max() < 1e-8:
            break
    return Lexicon(terms, exceptions, max(a, 1e-6), b)


def held_out(column: str = "doc_id"):
    """True on rows kept from learning: crc32 of the id as text, modulo 3, is 1. A null id is never learnt from."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, characters: int = CHARACTERS) -> Lexicon:
    """Fit on at most `sample` labelled rows that aren't held out, those of the smallest id hashes; a text that would take
    them over `characters` characters is passed by, and those after it are not.

    Ids labelled more than once count by their largest label; of an id's several texts the shortest counts, ties to
    the smaller hash. Both bounds make the broadcast of ids and what reaches the driver of fixed size, repeated ids
    and very long texts included.
    """
    bounded(docs.sparkSession)
    own = labels.where("toxic is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    chosen = own.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    sized = docs.select("doc_id", F.struct(F.coalesce(F.length("text"), F.lit(0)).alias("size"), F.xxhash64("text").alias("h")).alias("text"))
    sized = sized.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    picked, total = [], 0
    for r in sized.select("doc_id", "toxic", "text.size", "text.h").orderBy(F.xxhash64("doc_id"), "doc_id").collect():  # `sample` rows
        if total + r["size"] > characters:
            continue
        total += r["size"]
        picked.append((r["doc_id"], r["toxic"], r["h"]))
    if not picked:
        return Lexicon()
    # by Arrow, since a list of rows would pass through Python workers of its own
    picked = docs.sparkSession.createDataFrame(pa.table(dict(zip(("doc_id", "toxic", "h"), zip(*picked, strict=True), strict=True))))
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("h")).join(F.broadcast(picked), ["doc_id", "h"]).groupBy("doc_id").agg(F.first("text").alias("text"), F.first("toxic").alias("toxic"))
    return fit((r["text"], r["toxic"]) for r in rows.select("text", "toxic").toLocalIterator())


def scored(docs: DataFrame, lexicon: Lexicon, below: float | None = None) -> DataFrame:
    """docs with their `score`, 0 to 1, as the last column; or, with `below`, only those that score less, without it.

    Null and empty texts score as no match does; columns of any name pass.
    """
    bounded(docs.sparkSession)
    # all columns travel as one, so that none of their names can clash
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.coalesce("text", F.lit("")).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        auto = lexicon.automaton()
        for b in batches:
            found = pa.array([score(fold(t), auto, lexicon) for t in b.column("text").to_pylist()], pa.float64())
            out = pa.RecordBatch.from_arrays([b.column("row"), found], ["row", "score"])
            yield out if below is None else out.filter(pa.array(found.to_numpy() < below))

    kind = rows.select("row").schema
    out = rows.mapInArrow(run, StructType([*kind.fields, StructField("score", DoubleType())]))
    return out.select("row.*", "score") if below is None else out.select("row.*")


def scores(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score of every row; other columns are ignored, and no rows give no rows."""
    return scored(docs.select("doc_id", "text"), lexicon).select("doc_id", "score")

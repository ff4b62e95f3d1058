"""A part-of-speech tagger: an averaged perceptron, trained where the sentences lie.

Each round, every partition goes over its sentences once from the weights of the round before; their weights are averaged
and are those to go on from. Features are hashed into DIMS rows, so a model is of bounded size whatever the corpus:
DIMS x tags numbers are sent to every task and one such table a partition comes back, summed by slices.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.sources.scratch import materialize, scope

#: Rows of hashed features, slices of a table on its way, tags at most, and partitions that train.
DIMS, SLICES, MOST, PARTS = 1 << 15, 32, 100, 32
SENTENCES = "sentence_id long, tokens array<string>, tags array<string>"


def _row(feature: str) -> int:
    return zlib.crc32(feature.encode()) % DIMS


def _shape(word: str) -> str:
    return "d" if any(c.isdigit() for c in word) else "U" if word.isupper() else "T" if word[:1].isupper() else "l"


def _fixed(words: list[str], i: int) -> list[int]:
    """The features of a word that do not depend on tags: its own, and its neighbours'."""
    w, low = words[i], words[i].lower()
    before, after = words[i - 1].lower() if i else "<s>", words[i + 1].lower() if i + 1 < len(words) else "</s>"
    return [_row(f) for f in ("bias", f"w={low}", f"e3={low[-3:]}", f"e2={low[-2:]}", f"e1={low[-1:]}", f"b={low[:2]}", f"s={_shape(w)}", f"n={len(w)}", f"p={before}", f"pe={before[-3:]}", f"a={after}", f"ae={after[-3:]}")]


def _tags_before(one: int, two: int) -> list[int]:
    return [_row(f"t1={one}"), _row(f"t2={two},{one}")]


def _guess(weights: np.ndarray, rows: list[int]) -> int:
    return int(weights[rows].sum(axis=0).argmax())


@dataclass(frozen=True)
class Tagger:
    """Tags, and a weight for each hashed feature and tag."""

    tags: tuple[str, ...]
    weights: np.ndarray

    def tag(self, words: list[str]) -> list[str]:
        one = two = -1
        out = []
        for i in range(len(words)):
            two, one = one, _guess(self.weights, _fixed(words, i) + _tags_before(one, two))
            out.append(self.tags[one])
        return out


def sentences(rows: DataFrame, key: str = "query_id") -> DataFrame:
    """(key, tokens, tags) from (key, pos, token[, tag]), words in their order; a null word is empty. A sentence is one row."""
    tag = F.col("tag") if "tag" in rows.columns else F.lit(None).cast("string")
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token", F.lit("")).alias("token"), tag.alias("tag")))).alias("l"))
    return listed.select(key, F.transform("l", lambda x: x["token"]).alias("tokens"), F.transform("l", lambda x: x["tag"]).alias("tags"))


def _epoch(start: np.ndarray, tags: tuple[str, ...], pairs: Iterable[tuple[list[str], list[str]]]) -> tuple[np.ndarray, np.ndarray]:
    """Weights after one pass over the sentences, and their average over its steps."""
    w, late, step, at = start.copy(), np.zeros_like(start), 1, {t: i for i, t in enumerate(tags)}
    for words, right in pairs:
        one = two = -1
        for i, t in enumerate(right):
            if t not in at:
                two, one = one, -1
                continue
            rows, want = _fixed(words, i) + _tags_before(one, two), at[t]
            got = _guess(w, rows)
            if got != want:
                for r in rows:
                    w[r, want] += 1
                    w[r, got] -= 1
                    late[r, want] += step
                    late[r, got] -= step
            step += 1
            two, one = one, got
    return w, w - late / step


def learn(tagged: DataFrame, key: str = "query_id", rounds: int = 5, parts: int = PARTS) -> Tagger:
    """A tagger from rows (key, pos, token, tag). Rows without a tag are context only."""
    spark = tagged.sparkSession
    tags = tuple(r["tag"] for r in tagged.where("tag is not null").select("tag").distinct().orderBy("tag").limit(MOST + 1).collect())
    if not tags or len(tags) > MOST:
        raise ValueError(f"between 1 and {MOST} tags are needed")
    width = DIMS // SLICES
    with scope(spark):
        texts = materialize(sentences(tagged, key).select("tokens", "tags").repartition(parts), "sentences")
        start = np.zeros((DIMS, len(tags)), np.float32)
        average = start
        for _ in range(rounds):
            sent = spark.sparkContext.broadcast(start)

            def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
                pairs = ((r["tokens"], r["tags"]) for b in batches for r in b.to_pylist())
                first = next(pairs, None)
                if first is not None:
                    found = _epoch(sent.value, tags, (p for own in ([first], pairs) for p in own))
                    cut = [x[i * width : (i + 1) * width].tobytes() for x in found for i in range(SLICES)]
                    yield pa.RecordBatch.from_arrays([pa.array(range(2 * SLICES), pa.int32()), pa.array(cut, pa.binary())], ["slice", "w"])

            def mean(t):  # one row a partition, at most `parts`
                tables = [np.frombuffer(x.as_py(), np.float32).astype(np.float64) for x in t.column("w")]
                return pa.table({"slice": t.column("slice").slice(0, 1), "w": pa.array([(sum(tables) / len(tables)).astype(np.float32).tobytes()], pa.binary())})

            whole = np.zeros((2 * SLICES, width, len(tags)), np.float32)
            for r in texts.mapInArrow(train, "slice int, w binary").groupBy("slice").applyInArrow(mean, "slice int, w binary").collect():  # one table
                whole[r["slice"]] = np.frombuffer(r["w"], np.float32).reshape(width, len(tags))
            start, average = (x.reshape(DIMS, len(tags)) for x in (whole[:SLICES], whole[SLICES:]))
    return Tagger(tags, average)


def tagged(query: DataFrame, tagger: Tagger, key: str = "query_id") -> DataFrame:
    """(key, pos, token, tag) of rows (key, pos, token), each text tagged as one sentence, in the order of pos."""
    sent = query.sparkSession.sparkContext.broadcast(tagger)
    kind = query.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [sent.value.tag(words) for words in b.column("tokens").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("at"), b.column("pos"), b.column("tokens"), pa.array(found, pa.list_(pa.string()))], ["at", "pos", "tokens", "tags"])

    listed = query.groupBy(F.col(key).alias("at")).agg(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("token", F.lit("")).alias("token")))).alias("l"))
    place = query.schema["pos"].dataType.simpleString()
    rows = listed.select("at", F.transform("l", lambda x: x["pos"]).alias("pos"), F.transform("l", lambda x: x["token"]).alias("tokens"))
    found = rows.mapInArrow(run, f"at {kind}, pos array<{place}>, tokens array<string>, tags array<string>")
    return found.select(F.col("at").alias(key), F.inline(F.arrays_zip("pos", F.col("tokens").alias("token"), F.col("tags").alias("tag")))).toDF(key, "pos", "token", "tag")

"""N-gram Jaccard join by rare-first prefix filtering, and the components of its links.

A text's set holds the 64-bit hashes of its distinct word shingles. Sets are ordered rarest first by a count sketch
of all texts' shingles (ties by hash), so any two sets agree on the order. Two sets that reach the threshold share a
shingle within their prefixes; only prefix shingles that two different sets hold are kept, equal sets being one.
Candidates pass a length filter, a positional filter (what two prefixes' places leave at most, and before them the
shingles that other sets hold at all), and a second prefix filter: two prefixes must share so many shingles that one is
among the first of those which others hold, in both. A suffix filter follows (the counts of both sets' shingles by
hash range differ no more than the threshold allows), and what is left is verified once on whole sets.

Within a large group of near copies not all pairs are made. First every set is verified against one leader, that
which shares most of its prefix shingles, in LED rounds; what that links becomes components. Then all pairs across
components are joined, but for those already verified: a pair left out within a component has its link's effect
already, so components are exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.components import components
from foliospark.llm.kernels import SPACE, buffers, shingles, slices, word_offsets, words
from foliospark.llm.shared import bloom, bounded, folded, in_bloom, materialize, member, temporary, tidy

#: Slots of the sketch that count to 3, and those that go on; the slices it is summed in; ranges of the suffix filter;
#: sets remembered by a task; rounds of leaders.
BITS, HEAVY, PARTS, RANGES, SEEN, LED = 26, 20, 64, 32, 200_000, 2


def _sets(b: pa.RecordBatch, n: int) -> list[np.ndarray]:
    data, off = buffers(b.column("text"))
    start, _, h = words(data, off, SPACE)
    return list(shingles(h, word_offsets(start, off), n))


def _sid(s: np.ndarray) -> int | None:
    return int.from_bytes(blake2b(s.tobytes(), digest_size=8).digest(), "little", signed=True) if len(s) else None


class Sketch:
    """How many sets hold a shingle: 0 to 3 in 2**BITS slots of two bits, and beyond, to 65,535, in 2**HEAVY counters; 18 MB."""

    def __init__(self):
        self.low, self.high = (np.zeros((1 << BITS) // 8, np.uint8) for _ in range(2))
        self.heavy = np.zeros(1 << HEAVY, np.uint16)

    @staticmethod
    def _places(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slot = s >> np.uint64(64 - BITS)
        return (slot >> np.uint64(3)).astype(np.int64), (slot & np.uint64(7)).astype(np.uint8)

    @staticmethod
    def _heavy(s: np.ndarray) -> np.ndarray:
        return (s & np.uint64((1 << HEAVY) - 1)).astype(np.int64)

    def _few(self, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
        return (self.low[at] >> bit & 1) + 2 * (self.high[at] >> bit & 1)

    def add(self, s: np.ndarray) -> None:
        """Count the shingles of several sets, put end to end."""
        slot, n = np.unique(self._heavy(s), return_counts=True)
        self.heavy[slot] = np.minimum(self.heavy[slot] + n, 0xFFFF)
        _, one, n = np.unique(s >> np.uint64(64 - BITS), return_index=True, return_counts=True)
        at, bit = self._places(s[one])
        now = np.minimum(self._few(at, bit) + n, 3)
        for plane, on in ((self.low, now & 1 == 1), (self.high, now & 2 == 2)):
            np.bitwise_and.at(plane, at, ~(np.uint8(1) << bit))
            np.bitwise_or.at(plane, at[on], np.uint8(1) << bit[on])

    def count(self, s: np.ndarray) -> np.ndarray:
        few = self._few(*self._places(s)).astype(np.uint64)
        return np.where(few < 3, few, 3 + self.heavy[self._heavy(s)].astype(np.uint64))

    def slices(self) -> list[bytes]:
        """PARTS compressed slices, of which equal ones of several sketches can be summed."""
        return [pa.compress(x.tobytes() + y.tobytes() + z.tobytes(), codec="zstd", asbytes=True) for x, y, z in zip(self.low.reshape(PARTS, -1), self.high.reshape(PARTS, -1), self.heavy.reshape(PARTS, -1), strict=True)]

    WIDTH = (1 << BITS) // 8 // PARTS

    @classmethod
    def _unpacked(cls, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        x = np.frombuffer(pa.decompress(raw, 2 * cls.WIDTH + 2 * (1 << HEAVY) // PARTS, codec="zstd", asbytes=True), np.uint8)
        return x[: 2 * cls.WIDTH].reshape(2, -1), x[2 * cls.WIDTH :].view(np.uint16)

    @classmethod
    def more(cls, held: tuple[np.ndarray, np.ndarray] | None, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """A slice's counts with those of another added."""
        planes, heavy = cls._unpacked(raw)
        few = np.unpackbits(planes[0]) + 2 * np.unpackbits(planes[1])
        return (few, heavy.astype(np.uint32)) if held is None else (np.minimum(held[0] + few, 3), np.minimum(held[1] + heavy, 0xFFFF))

    @staticmethod
    def packed(held: tuple[np.ndarray, np.ndarray]) -> bytes:
        return pa.compress(np.packbits(held[0] & 1).tobytes() + np.packbits(held[0] >> 1).tobytes() + held[1].astype(np.uint16).tobytes(), codec="zstd", asbytes=True)

    def put(self, part: int, raw: bytes) -> None:
        planes, heavy = self._unpacked(raw)
        for own, x in ((self.low, planes[0]), (self.high, planes[1]), (self.heavy, heavy)):
            own.reshape(PARTS, -1)[part] = x


class Seen:
    """Remembers the last sets of a task, SEEN of them."""

    def __init__(self):
        self.own: set[int] = set()

    def new(self, sid: int | None) -> bool:
        if sid is None or sid in self.own:
            return False
        if len(self.own) >= SEEN:
            self.own.clear()
        self.own.add(sid)
        return True


def describe(texts: DataFrame, n: int) -> tuple[DataFrame, Sketch]:
    """(rid, sid, size) of every row, and the sketch of the shingles of all sets, but for a task's repeats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        sketch, seen, any_set = Sketch(), Seen(), False
        for batch in batches:
            for b in slices(batch):
                sets = _sets(b, n)
                sids = [_sid(s) for s in sets]
                if fresh := [s for s, sid in zip(sets, sids, strict=True) if seen.new(sid)]:
                    any_set = True
                    sketch.add(np.concatenate(fresh))
                none = pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(sids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), *none], ["rid", "sid", "size", "part", "counts"])
        if any_set:
            none = [pa.nulls(PARTS, pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([*none, pa.array(range(PARTS), pa.int32()), pa.array(sketch.slices(), pa.binary())], ["rid", "sid", "size", "part", "counts"])

    both = materialize(texts.mapInArrow(run, "rid long, sid long, size long, part int, counts binary"), "sets")
    sketch = Sketch()
    for r in folded(both.where("part is not null").select("part", "counts"), Sketch.more, Sketch.packed).toLocalIterator():  # 18 MB, whatever the input
        sketch.put(r["part"], r["counts"])
    return both.where("part is null").select("rid", "sid", "size"), sketch


def prefix_size(size, num: int, den: int):
    """Shingles of a set of which one at least is shared with any set that reaches the threshold num / den."""
    return size + (-size * num) // den + 1


def _prefixes(texts: DataFrame, n: int, num: int, den: int, sketch, only=None) -> DataFrame:
    """token, sid, size, pos: each set's prefix, rarest first. A task passes over sets that it has just seen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        seen = Seen()
        for batch in batches:
            for b in slices(batch):
                out: list[tuple] = []
                for s in _sets(b, n):
                    sid = _sid(s)
                    if not seen.new(sid):
                        continue
                    size = prefix_size(len(s), num, den)
                    key = (sketch.value.count(s) << np.uint64(46)) | (s >> np.uint64(18))
                    first = np.argpartition(key, size - 1)[:size] if size < len(s) else np.arange(len(s))
                    first = first[np.argsort(key[first], kind="stable")]
                    token, pos = s[first].view(np.int64), np.arange(len(first), dtype=np.int32)
                    if only:
                        keep = in_bloom(only.value, token)
                        token, pos = token[keep], pos[keep]
                    out.append((token, np.full(len(token), sid), np.full(len(token), len(s), np.int32), pos))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["token", "sid", "size", "pos"])

    return texts.mapInArrow(run, "token long, sid long, size int, pos int")


def _need(na: str, nb: str, num: int, den: int) -> Column:
    """The overlap that two sets need: |x and y| >= num / (num + den) * (|x| + |y|)."""
    return F.expr(f"cast((({num} * cast({na} + {nb} as long)) + {num + den - 1}) div {num + den} as int)")


def _shared(num: int, den: int, na: str = "na", nb: str = "nb") -> Column:
    """The prefix shingles that two sets must share: an overlap's rest lies beyond the prefix that ends first."""
    return _need(na, nb, num, den) - F.greatest(*[F.expr(f"cast((({num} * cast({n} as long)) + {den - 1}) div {den} as int) - 1") for n in (na, nb)])


def _bucket(size: Column, num: int, den: int) -> Column:
    return F.floor(F.log(size) / F.log(F.lit(den / num)) + 1e-9)


def _members(texts: DataFrame, rows: DataFrame, used: DataFrame, n: int) -> DataFrame:
    """sid, ranges, hashes of the sets in `used`, from one text of each."""
    of = materialize(rows.join(used, "sid").groupBy("sid").agg(F.min("rid").alias("rid")), "owners")
    wanted = bloom(of, "rid", of.count())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for batch in batches:
            if wanted:
                batch = batch.filter(pa.array(in_bloom(wanted.value, batch.column("rid").to_numpy())))
            for b in slices(batch):
                sets = _sets(b, n)
                spread = [np.minimum(np.bincount((s >> np.uint64(59)).astype(np.int64), minlength=RANGES), 1 << 30).astype(np.int32).tobytes() for s in sets]
                yield pa.RecordBatch.from_arrays([b.column("rid"), pa.array(spread, pa.binary()), pa.array([s.tobytes() for s in sets], pa.binary())], ["rid", "ranges", "hashes"])

    return materialize(texts.mapInArrow(run, "rid long, ranges binary, hashes binary").join(of, "rid").select("sid", "ranges", "hashes"), "members")


def _verified(texts: DataFrame, rows: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Of the pairs (a, b, na, nb), those that reach the threshold, each verified once on the whole sets."""
    members = _members(texts, rows, pairs.select(F.explode(F.array("a", "b")).alias("sid")).distinct(), n)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for t in batches:
            x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.int32).reshape(-1, RANGES).astype(np.int64) for c in ("ra", "rb"))
            total = t.column("na").to_numpy().astype(np.int64) + t.column("nb").to_numpy()
            # |x| + |y| - 2 need is the largest difference that the threshold allows
            keep = np.abs(x - y).sum(1) <= total - 2 * (-(-num * total // (num + den)))
            yield t.select(["a", "b", "na", "nb"]).filter(pa.array(keep))

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tidy()
        for t in batches:
            keep = []
            for x, y in zip(t.column("ha"), t.column("hb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(den * same >= num * (len(x) + len(y) - same))
            yield t.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    def side(kept: str, key: str, value: str) -> DataFrame:
        return members.select(F.col("sid").alias(key), F.col(kept).alias(value))

    near = pairs.join(side("ranges", "a", "ra"), "a").join(side("ranges", "b", "rb"), "b").select("a", "b", "na", "nb", "ra", "rb")
    near = materialize(near.mapInArrow(apart, "a long, b long, na int, nb int"), "near")
    whole = near.join(side("hashes", "a", "ha"), "a").join(side("hashes", "b", "hb"), "b").select("a", "b", "ha", "hb")
    return materialize(whole.mapInArrow(check, "a long, b long"), "links")


def _pair(x: str, y: str, nx: str, ny: str) -> list[Column]:
    """Two sets in the order of their ids, with their sizes."""
    first = F.col(x) < F.col(y)
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(first, F.col(nx)).otherwise(F.col(ny)).alias("na"), F.when(first, F.col(ny)).otherwise(F.col(nx)).alias("nb")]


def _placed(posts: DataFrame, of: DataFrame) -> DataFrame:
    """Postings with the components known so far, of shingles that several components hold; how many of these come
    before each in its set, and how many its set has."""
    posts = materialize(posts.join(of.withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("component", "sid")), "placed")
    apart = posts.groupBy("token").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("token")
    posts = posts.join(materialize(apart, "apart"), "token")
    own = Window.partitionBy("sid")
    return materialize(posts.withColumns({"before": F.row_number().over(own.orderBy("pos")) - 1, "held": F.count("*").over(own).cast("int")}), "open")


def _led(posts: DataFrame, tried: DataFrame | None, num: int, den: int) -> DataFrame:
    """(a, b, na, nb): each set and the leader, of another component, that shares most of its prefix shingles.

    A shingle's leader in each size range is the set with the fewest rarer shingles before it: of near copies the one
    that is edited least, to which the others are nearer than to each other. A leader need not share all that a member
    has, so half of what a link takes is asked for.
    """
    leaders = posts.groupBy("token", "bucket").agg(F.min(F.struct("pos", "size", "sid", "component")).alias("l"), F.count("*").alias("c")).where("c > 1").select("token", "bucket", "l")
    met = posts.join(materialize(leaders, "leaders"), ["token", "bucket"]).where("component <> l.component")
    met = met.select("sid", "size", F.col("l.sid").alias("leader"), F.col("l.size").alias("of"))
    met = met.groupBy("sid", "size", "leader", "of").agg(F.count("*").alias("c")).select("sid", "leader", "c", *_pair("sid", "leader", "size", "of"))
    if tried is not None:
        met = met.join(tried, ["a", "b"], "left_anti")
    best = met.where(F.col("c") * 2 >= _shared(num, den)).groupBy("sid").agg(F.min(F.struct(-F.col("c"), "leader", "a", "b", "na", "nb")).alias("m"))
    return materialize(best.select("m.a", "m.b", "m.na", "m.nb").distinct(), "led")


def links(texts: DataFrame, n: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """(rid, sid, size) of every row, and links (a, b) between set ids whose components are those of all links."""
    spark = texts.sparkSession
    bounded(spark)
    rows, counts = describe(texts, n)
    sketch = spark.sparkContext.broadcast(counts)
    shared = _prefixes(texts, n, num, den, sketch).groupBy("token").agg(F.min("sid").alias("lo"), F.max("sid").alias("hi"))
    shared = materialize(shared.where("lo <> hi").select("token"), "tokens")
    only = bloom(shared, "token", shared.count())
    posts = _prefixes(texts, n, num, den, sketch, only).join(shared, "token")
    posts = posts.groupBy("token", "sid").agg(F.first("size").alias("size"), F.first("pos").alias("pos"))
    posts = materialize(posts.withColumn("bucket", _bucket(F.col("size"), num, den).cast("int")), "postings")
    sketch.unpersist()
    found, tried, open_posts = None, None, posts.withColumn("component", F.col("sid"))
    for _ in range(LED):
        led = _led(open_posts, tried, num, den)
        star = _verified(texts, rows, led, n, num, den)
        tried = led.select("a", "b") if tried is None else tried.union(led.select("a", "b"))
        found = star if found is None else found.union(star)
        open_posts = _placed(posts, components(found))
    # pairs across components
    x = open_posts.select("token", "bucket", F.col("sid").alias("x"), F.col("size").alias("nx"), F.col("pos").alias("px"), F.col("before").alias("bx"), F.col("held").alias("hx"), F.col("component").alias("cx"))
    y = open_posts.select("token", F.explode(F.array(F.col("bucket"), F.col("bucket") - 1)).alias("bucket"), F.col("sid").alias("y"), F.col("size").alias("ny"), F.col("pos").alias("py"), F.col("before").alias("by"), F.col("held").alias("hy"), F.col("component").alias("cy"))
    # two sets share at most what both hold from here on and, of what comes before, shingles that others hold too
    fits = (F.col("nx") * den >= F.col("ny") * num) & (F.least(F.col("nx") - F.col("px"), F.col("ny") - F.col("py")) + F.least("bx", "by") >= _need("nx", "ny", num, den))
    # of the shingles that others hold they must share so many that one is among the first of both
    least = _shared(num, den, "nx", "ny")
    fits &= (F.col("bx") <= F.col("hx") - least) & (F.col("by") <= F.col("hy") - least)
    pairs = x.join(y, ["token", "bucket"]).where("cx <> cy and (nx < ny or nx = ny and x < y)").where(fits)
    near = pairs.groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("c"), F.min(F.least(F.col("hx") - F.col("bx"), F.col("hy") - F.col("by")) - 1).alias("rest"))
    near = near.where(F.col("c") + F.col("rest") >= least).select(*_pair("x", "y", "nx", "ny"))
    near = near.join(tried, ["a", "b"], "left_anti").select("a", "b", "na", "nb")
    return rows, found.union(_verified(texts, rows, materialize(near, "pairs"), n, num, den))


def classes(docs: DataFrame, n: int, num: int, den: int, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns kept, n_shingles and component_id of every row; 100 * shared >= threshold * all in whole numbers.

    component_id is the smallest doc_id reachable by links. Texts that are null, empty or white space have an empty
    set and link with nothing; so does no row with itself. Equal rows, and rows that share an id, keep rows of their
    own. A null id is the component of a row only where it has no other. No rows give no rows.
    """
    texts = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), *[c for c in keep if c not in ("doc_id", "text")])
    texts = texts.withColumn("rid", F.xxhash64("doc_id", "text"))
    with temporary(docs.sparkSession) as keep_table:
        rows, found = links(texts.select("rid", "text"), n, num, den)
        of = components(found)
        known = materialize(rows.distinct().join(of.withColumnRenamed("node", "sid"), "sid", "left").select("rid", "size", F.coalesce("component", "sid").alias("group")), "known")
        ids = texts.select("rid", *keep)
        placed = keep_table(materialize(ids.join(known, "rid"), "rows"))
        least = keep_table(materialize(placed.where("group is not null").groupBy("group").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")).where("n > 1").select("group", "least"), "least"))
    return placed.join(least, "group", "left").select(*keep, F.col("size").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """docs without all but the first row, by doc_id, of each component; equal rows are one.

    Texts stay where they are read but for the few rows of components with several.
    """
    rid = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    with temporary(docs.sparkSession) as keep:
        rows, found = links(docs.select(rid.alias("rid"), F.coalesce("text", F.lit("")).alias("text")), n, num, den)
        of = components(found)
        placed = rows.where("sid is not null").join(of.withColumnRenamed("node", "sid"), "sid", "left").select("rid", F.coalesce("component", "sid").alias("group"))
        ids = docs.select(rid.alias("rid"), "doc_id").distinct()
        placed = materialize(placed.groupBy("rid", "group").agg(F.count("*").alias("copies")).join(ids, "rid"), "placed")
        first = placed.groupBy("group").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid")).alias("f"), F.sum("copies").alias("all")).where("all > 1").select(F.col("group"), F.col("f.rid").alias("first"))
        first = materialize(first, "first")
        several = keep(materialize(placed.join(first, "group").select("rid", (F.col("rid") == F.col("first")).alias("_stays")), "several"))
    # all columns travel as one, so that none of their names can clash
    marked = docs.select(F.struct(*docs.columns).alias("row"), rid.alias("rid"))
    near = member(bloom(several, "rid", several.count()))("rid")
    met = marked.where(near).join(several, "rid", "left")
    kept = met.where("_stays").dropDuplicates(["rid"]).union(met.where("_stays is null"))
    return marked.where(~near).select("row.*").union(kept.select("row.*"))

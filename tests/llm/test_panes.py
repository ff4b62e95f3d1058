"""Pane revisions against a plain replay of the batches."""

import binascii
import datetime as dt
import math
from collections import defaultdict
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from foliospark.llm import panes
from foliospark.llm.queries import QUERIES
from foliospark.sources import scratch

EPOCH = dt.datetime(1970, 1, 1)
SCHEMA = "click_id long, ts timestamp_ntz, arrived_at timestamp_ntz, client_id long, kind string, value double, batch string"


def micros(t):
    return (t - EPOCH) // dt.timedelta(microseconds=1)


def replay(rows, batches=8):
    """The definition, batch after batch, over rows (click_id, ts, arrived_at, kind, value)."""
    once = {}
    for i, ts, arrived, kind, value in rows:
        if ts is not None:
            order = tuple((x is not None, x if x is not None else 0) for x in (arrived, ts, kind, value))
            if i not in once or order < once[i][0]:
                once[i] = (order, ts, arrived, kind, value)
    fed = [[] for _ in range(batches)]
    for i, (_, ts, arrived, kind, value) in once.items():
        day = micros(arrived or ts) // panes.DAY
        q = day % batches
        b = min(batches - 1, q + max(0, binascii.crc32(str(i if i is not None else "").encode()) % 30 - 23))
        event = micros(ts) - (day - q) * panes.DAY
        usable = value is not None and math.isfinite(value) and abs(100 * value + 0.5) <= 1 << 53
        fed[b].append((i, kind if kind is not None else "none", event // panes.HOUR, event, math.floor(100 * value + 0.5) if usable else 0))
    out, held, clock = [], {}, -math.inf
    for b, batch in enumerate(fed):
        end = lambda h: (h + 1) * panes.HOUR
        before = {p: list(v) for p, v in held.items()}
        for i, kind, hour, _, cents in batch:
            if clock >= end(hour) + 96 * panes.HOUR:
                out.append((b, hour, i, 1, cents, "late", kind))
            else:
                pane = held.setdefault((kind, hour), [0, 0, False])
                pane[0] += 1
                pane[1] += cents
        for (kind, hour), v in list(held.items()):
            old = before.get((kind, hour), [0, 0, False])
            if not v[2] and clock >= end(hour) + 6 * panes.HOUR:
                v[2] = True
                out.append((b, hour, -1, v[0], v[1], "emit", kind))
            elif v[2] and v[0] != old[0]:
                out.append((b, hour, -1, old[0], old[1], "retract", kind))
                out.append((b, hour, -1, v[0], v[1], "replace", kind))
            elif not v[2] and b == batches - 1:
                out.append((b, hour, -1, v[0], v[1], "final", kind))
            if clock >= end(hour) + 96 * panes.HOUR:
                del held[kind, hour]
        clock = max([clock, *(r[3] for r in batch)])
    return sorted(map(str, out))


def found(df):
    return sorted(str(tuple(r)) for r in df.select("batch", "hour", "click_id", "n_rows", "cents", "record", "kind").collect())


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/clicks.parquet").select("click_id", "ts", "arrived_at", "kind", "value").collect()]
    want = replay(rows)
    assert {r.split("'")[1] for r in want} >= {"late", "emit", "retract", "replace", "final"}
    assert found(QUERIES["op11_panes"](spark, sf)) == want


def at(day, hour=0, minute=0):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=day, hours=hour, minutes=minute)


def test_odd_rows(spark):
    # only some batches have rows: 2024-01-01 is day 19723, q = 3
    rows = [(i, at(0, i % 5), at(0, 6), ["a", None, "", "none"][i % 4], [1.005, None, float("nan"), float("inf"), -0.5, 1e300][i % 6]) for i in range(60)]
    rows += [(1000, at(-9), at(4, 1), "a", 2.0), (1001, None, at(0), "a", 1.0), (1002, at(1), None, "a", 1.0), (None, at(0, 1), at(0, 2), "a", 1.0), (None, at(0, 3), at(0, 4), "b", 1.0)]
    rows += [(1, at(0, 4), at(0, 7), "z", 9.0), (2, at(0, 2), at(0, 6), None, 1.0), *rows[:9]]
    docs = spark.createDataFrame([(i, ts, a, 0, k, v, "x") for i, ts, a, k, v in rows], SCHEMA)
    assert found(panes.revisions(docs)) == replay(rows)


def test_empty(spark):
    assert found(panes.revisions(spark.createDataFrame([], SCHEMA))) == []


def test_sums_wait_for_the_punctuation(spark):
    """Rows of one batch in two feeds: shards hold what they add up until the punctuation comes with the second."""
    with scratch.scope(spark):
        root = scratch.folder(spark, "panes")
        schema = ", ".join(panes.ROWS.split(", "))
        first = [(s, False, s, "k", 5, 10) for s in range(6)]
        second = [(s, False, 10 + s, "k", 5, 1) for s in range(2)] + [(s, True, 0, "", 0, 0) for s in range(6)]
        with panes._settings(spark):
            for name, rows in (("b0", first), ("b1", second)):
                spark.createDataFrame(rows, schema).write.parquet(f"{root}/fed/{name}")
                panes.start(spark, root, 0, panes.NEVER, name == "b1", 6, 96)
        assert found(spark.read.schema(panes.RESULT).parquet(f"{root}/out")) == ["(0, 5, -1, 8, 62, 'final', 'k')"]


def test_days_do_not_follow_the_zone(spark):
    t = spark.sql("select timestamp_ntz'1969-12-31 23:59:59.999999' a, timestamp_ntz'2024-03-31 02:30:00.5' b")
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        assert tuple(t.select(panes.micros("a"), panes.micros("b")).first()) == (-1, micros(dt.datetime(2024, 3, 31, 2, 30, 0, 500_000)))
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)


@pytest.mark.parametrize("salts", [1, 8])
def test_a_hot_pane_is_spread(spark, salts):
    rows = spark.range(8000).select(F.lit(0).alias("batch"), F.col("id").alias("click_id"), F.lit("k").alias("kind"), F.lit(3).cast("long").alias("hour"), F.lit(1).cast("long").alias("cents"), F.lit(0).cast("long").alias("event"))
    with scratch.scope(spark):
        root = scratch.folder(spark, "panes")
        panes.staged(rows, 1, salts, root)
        counts = [r["count"] for r in spark.read.schema(f"batch int, {panes.ROWS}").parquet(f"{root}/staged").where("not mark").groupBy("shard").count().collect()]
    assert len(counts) == salts and max(counts) < 1.3 * 8000 / salts


def test_no_store_stays_open(spark):
    """A start's stores are closed with its tasks: those of 8 starts, open at once, took an executor's memory."""
    stores = spark._jvm.org.apache.spark.sql.execution.streaming.state.RocksDBMemoryManager
    with scratch.scope(spark):
        root = scratch.folder(spark, "panes")
        rows = [(s, mark, s, "k", 5, 10) for s in range(6) for mark in (False, True)]
        spark.createDataFrame(rows, ", ".join(panes.ROWS.split(", "))).write.parquet(f"{root}/fed/b0")
        before = stores.getNumRocksDBInstances(True)
        with panes._settings(spark):
            panes.start(spark, root, 0, panes.NEVER, True, 6, 96)
        assert stores.getNumRocksDBInstances(True) <= before


def test_a_start_opens_one_store_a_partition_and_none_in_native_memory(spark):
    """RocksDB kept native memory of closed stores; two keyed stages opened two stores a partition in each of 8 starts."""
    with scratch.scope(spark):
        root = scratch.folder(spark, "panes")
        rows = [(s, mark, s, "k", 5, 10) for s in range(6) for mark in (False, True)]
        spark.createDataFrame(rows, ", ".join(panes.ROWS.split(", "))).write.parquet(f"{root}/fed/b0")
        with panes._settings(spark):
            panes.start(spark, root, 0, panes.NEVER, True, 6, 96)
        state = Path(root.removeprefix("file:").replace("//", "")) / "checkpoint" / "state"
        assert [p.name for p in state.iterdir()] == ["0"]
        kinds = {p.suffix for p in state.glob("0/[0-9]*/*") if p.is_file() and not p.name.startswith(".")}
        assert kinds - {".crc"} == {".delta"}


@pytest.mark.parametrize("pending", [1, 7, 1 << 16])
def test_a_task_adds_up_its_rows(monkeypatch, pending):
    """Sums by pane are whole however many rows a task holds; late rows and punctuations pass as they are."""
    monkeypatch.setattr(panes, "PENDING", pending)
    rows = [((3 if i % 11 == 5 else -1), i % 11 == 7, f"k{i % 3}", i % 2, i, 1, i * i) for i in range(300)]
    names = [c.split()[0] for c in panes.SENT.split(", ")]
    batches = [pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[a : a + 20]], pa.schema([("lane", pa.int32()), ("mark", pa.bool_()), ("kind", pa.string())] + [pa.field(n, pa.int64(), n != "n_rows") for n in names[3:]])) for a in range(0, 300, 20)]
    got = pa.Table.from_batches(panes.sums(iter(batches))).to_pylist()
    alone = [tuple(r.values()) for r in got if r["mark"] or r["lane"] >= 0]
    assert sorted(alone) == sorted(r for r in rows if r[1] or r[0] >= 0)
    want, found = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0])
    for into, all_rows in ((want, rows), (found, [tuple(r.values()) for r in got])):
        for lane, mark, kind, hour, _, n, cents in all_rows:
            if lane < 0 and not mark:
                into[kind, hour][0] += n
                into[kind, hour][1] += cents
    assert found == want and len(want) == 6

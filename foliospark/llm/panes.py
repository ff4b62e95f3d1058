"""Window panes with revisions: totals by kind and event hour, published when due, corrected later, forgotten at last.

One keyed stage of a Structured Streaming query, and a stateless one before it. The tasks that read a batch add up its
rows by pane as they come, so a pane of a third of all rows is no single task; late rows pass, in lanes of their own. The
sums go to shards, a pane's to one: a shard keeps the totals of its open panes and what was added since. At a batch's
punctuation, which goes to every shard, it says what is published, corrected and closed.

Each batch carries its clock, the latest event time of the batches before; the query is started anew for each on one
checkpoint. A start that fails is started again with the same files, so it neither loses nor repeats rows: state, offsets
and the result's file log are committed together.

Defined results: rows of equal click_id are one, the earliest by (arrived_at, ts, kind, value), and a null click_id is an
id like others; a null kind is `none`; values that are null, not finite, or of more than 2^53 cents count 0; without
arrived_at the day is that of ts; timestamps with a zone are read in the session's. An empty table gives no rows. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from foliospark.llm.shared import tidy
from foliospark.sources.scratch import PLAIN_FILES, delete, folder, parallelism, rename, scope

HOUR = 3_600_000_000
DAY = 24 * HOUR
#: Lanes that one pane's late rows are dealt over, and the least number of shards.
SALTS = 64
#: Rows that a task holds before it adds them up.
PENDING = 1 << 16
#: A clock before any event, and what stands for a null click_id on the way (a null would make the column inexact).
NEVER = NAMELESS = -(1 << 62)

ROWS = "shard int, mark boolean, click_id long, kind string, hour long, cents long"
#: lane: where a late row passes, -1 for sums and punctuations.
SENT = "lane int, mark boolean, kind string, hour long, click_id long, n_rows long, cents long"
#: A shard's panes: totals as of the last punctuation, what was added since, and whether they were published.
HELD = "kind array<string>, hour array<long>, n_rows array<long>, cents array<long>, more_rows array<long>, more_cents array<long>, emitted array<boolean>"
RESULT = "batch long, hour long, click_id long, n_rows long, cents long, record string, kind string"


def micros(c: str) -> Column:
    """Microseconds of a wall-clock time since 1970, whatever the session's zone."""
    clock = F.hour(c) * 3600 + F.minute(c) * 60
    return F.unix_date(F.col(c).cast("date")).cast("long") * DAY + clock.cast("long") * 1_000_000 + (F.date_part(F.lit("SECOND"), F.col(c)) * 1_000_000).cast("long")


def clicks(table: DataFrame, batches: int) -> DataFrame:
    """(batch, click_id, kind, hour, event, cents): each click once, its event time folded into the batches' days.

    A click's batch is its day of arrival modulo the batches, or up to six later for some.
    """
    order = F.struct("arrived_at", "ts", "kind", "value")
    once = table.where("ts is not null").select("click_id", order.alias("c")).groupBy("click_id").agg(F.min("c").alias("c")).select("click_id", "c.*")
    day = F.unix_date(F.coalesce("arrived_at", "ts").cast("date")).cast("long")
    timed = once.withColumn("day", day).withColumn("q", F.pmod("day", F.lit(batches)))
    delay = F.greatest(F.lit(0), F.crc32(F.coalesce(F.col("click_id").cast("string"), F.lit(""))) % 30 - 23)
    event = micros("ts") - (F.col("day") - F.col("q")) * DAY
    cents = F.col("value") * 100 + 0.5
    fits = F.abs(cents) <= float(1 << 53)  # false for NaN, which is larger than any number
    timed = timed.select(F.least(F.lit(batches - 1), F.col("q") + delay).cast("int").alias("batch"), F.coalesce("click_id", F.lit(NAMELESS)).alias("click_id"), F.coalesce("kind", F.lit("none")).alias("kind"), event.alias("event"), F.when(fits, F.floor(cents)).otherwise(0).cast("long").alias("cents"))
    return timed.withColumn("hour", F.expr(f"(event - pmod(event, {HOUR}L)) div {HOUR}L"))


def _past(hour: int, clock: int, grace: int) -> bool:
    """Whether the clock stands `grace` hours or more after the hour's end."""
    return clock >= (hour + 1 + grace) * HOUR


def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's rows added up by pane, and its late rows and punctuations as they are (columns of SENT)."""
    tidy()
    names = [c.split()[0] for c in SENT.split(", ")]
    held, rows = [], 0

    def added() -> pa.Table:
        t = pa.concat_tables(held).group_by(["kind", "hour"]).aggregate([("n_rows", "sum"), ("cents", "sum")])
        return t.rename_columns({"n_rows_sum": "n_rows", "cents_sum": "cents"}).select(["kind", "hour", "n_rows", "cents"])

    def sent(t: pa.Table) -> Iterator[pa.RecordBatch]:
        n = len(t)
        same = {"lane": pa.repeat(pa.scalar(-1, pa.int32()), n), "mark": pa.repeat(False, n), "click_id": pa.repeat(-1, n)}
        yield from pa.table([same[c] if c in same else t.column(c) for c in names], names=names).to_batches()

    for b in batches:
        b = pa.RecordBatch.from_arrays(b.columns, b.schema.names)  # literals come as not null, sums would not
        alone = pc.or_(b.column("mark"), pc.greater_equal(b.column("lane"), 0))
        if pc.any(alone).as_py():
            yield b.filter(alone).select(names)
        held.append(pa.Table.from_batches([b.filter(pc.invert(alone)).select(["kind", "hour", "n_rows", "cents"])]))
        rows += len(held[-1])
        if rows >= PENDING:
            held = [added()]
            if 2 * len(held[0]) >= PENDING:  # adding up gains too little
                yield from sent(held.pop())
            rows = sum(map(len, held))
    if held:
        yield from sent(added())


def totals(batch: int, clock: int, last: bool, due: int, closed: int) -> Callable:
    """Keeps the totals of a shard's panes, and says at the punctuation what of them is written in a batch."""

    def run(key, rows: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tidy()
        panes = {(k, h): list(held) for k, h, *held in zip(*state.get, strict=True)} if state.exists else {}
        marked = False
        for frame in rows:
            mark, late = frame["mark"].to_numpy(bool), frame["lane"].to_numpy() >= 0
            marked |= bool(mark.any())
            if late.any():
                part = frame[late]
                yield pd.DataFrame({"batch": batch, "hour": part["hour"], "click_id": part["click_id"], "n_rows": 1, "cents": part["cents"], "record": "late", "kind": part["kind"]})
            more = frame[~(mark | late)]
            for kind, hour, n, cents in zip(*(more[c].tolist() for c in ("kind", "hour", "n_rows", "cents")), strict=True):
                held = panes.setdefault((kind, hour), [0, 0, 0, 0, False])
                held[2] += n
                held[3] += cents
        if marked and (out := list(_written(panes))):
            record, hour, kind, n, cents = zip(*out, strict=True)
            yield pd.DataFrame({"batch": batch, "hour": hour, "click_id": -1, "n_rows": n, "cents": cents, "record": record, "kind": kind})
        if panes:
            state.update(tuple(map(list, zip(*((*pane, *held) for pane, held in panes.items()), strict=True))))
        elif state.exists:
            state.remove()

    def _written(panes: dict) -> Iterator[tuple]:
        """(record, hour, kind, n_rows, cents); closed panes are taken out."""
        for (kind, hour), (old_rows, old_cents, n, c, emitted) in list(panes.items()):
            new = hour, kind, old_rows + n, old_cents + c
            now = _past(hour, clock, due)
            if now and not emitted:
                yield "emit", *new
            elif emitted and n:
                yield "retract", hour, kind, old_rows, old_cents
                yield "replace", *new
            elif last and not emitted:
                yield "final", *new
            panes[kind, hour] = [*new[2:], 0, 0, emitted or now]
            if last or _past(hour, clock, closed):
                del panes[kind, hour]

    return run


@contextmanager
def _settings(spark: SparkSession, local: bool = False) -> Iterator[None]:
    """Keyed state in the executors' heap, while the query runs; the session's own settings come back after.

    It is a row a shard with its open panes. With RocksDB native memory grew from start to start, though its stores were
    closed, and each start opens one a partition.

    local: the checkpoint lies on a mounted folder. Hadoop starts a process for each file that it makes there by way of
    its file contexts, and twice as many with Spark's own checksums beside those of the local file system.
    """
    state = "spark.sql.streaming.stateStore"
    wanted = {
        f"{state}.providerClass": "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider",
        f"{state}.unloadOnCommit": "true",  # a start runs one batch: no store is asked twice, and none stays open for the next
        "spark.sql.streaming.noDataMicroBatches.enabled": "false",
    }
    if local:
        wanted |= {"spark.sql.streaming.checkpoint.fileChecksum.enabled": "false", "spark.sql.streaming.checkpointFileManagerClass": "org.apache.spark.sql.execution.streaming.checkpointing.FileSystemBasedCheckpointFileManager"}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def staged(rows: DataFrame, batches: int, shards: int, root: str) -> list[int]:
    """Write the batches and a punctuation for each, a folder a batch, and give each batch's clock."""
    spark = rows.sparkSession
    salt = F.pmod(F.xxhash64("click_id"), F.lit(min(SALTS, shards)))
    shard = F.pmod(F.xxhash64("kind", "hour") + salt, F.lit(shards)).cast("int")
    data = rows.select("batch", shard.alias("shard"), F.lit(False).alias("mark"), "click_id", "kind", "hour", "cents", "event")
    data.write.options(**PLAIN_FILES).partitionBy("batch").parquet(f"{root}/staged")
    marks = spark.range(batches, numPartitions=1).select(F.col("id").cast("int").alias("batch"), F.lit(0).alias("shard"), F.lit(True).alias("mark"), F.lit(0).cast("long").alias("click_id"), F.lit("").alias("kind"), F.lit(0).cast("long").alias("hour"), F.lit(0).cast("long").alias("cents"))
    marks.write.options(**PLAIN_FILES).partitionBy("batch").mode("append").parquet(f"{root}/staged")
    written = spark.read.schema(f"batch int, event long, {ROWS}").parquet(f"{root}/staged")
    latest = {r["batch"]: r["latest"] for r in written.groupBy("batch").agg(F.max("event").alias("latest")).collect()}  # one row a batch
    clocks, clock = [], NEVER
    for b in range(batches):
        clocks.append(clock)
        clock = max(clock, latest.get(b) if latest.get(b) is not None else NEVER)
    return clocks


def start(spark: SparkSession, root: str, batch: int, clock: int, last: bool, due: int, closed: int, shards: int = SALTS) -> None:
    """Feed what lies in the folder and was not fed yet, as one batch."""
    fed = spark.readStream.schema(ROWS).parquet(f"{root}/fed/*")
    late = ~F.col("mark") & (F.col("hour") <= clock // HOUR - 1 - closed)
    fed = fed.select(F.when(late, F.col("shard")).otherwise(-1).alias("lane"), "mark", "kind", "hour", "click_id", F.lit(1).cast("long").alias("n_rows"), "cents")
    every, own = F.sequence(F.lit(0), F.lit(shards - 1)), F.pmod(F.xxhash64("kind", "hour"), F.lit(shards)).cast("int")
    sent = fed.mapInArrow(sums, SENT).withColumn("to", F.explode(F.when(F.col("mark"), every).otherwise(F.array(F.when(F.col("lane") >= 0, F.col("lane")).otherwise(own)))))
    out = sent.groupBy("to").applyInPandasWithState(totals(batch, clock, last, due, closed), RESULT, HELD, "append", GroupStateTimeout.NoTimeout)
    query = out.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()


def revisions(table: DataFrame, batches: int = 8, due: int = 6, closed: int = 96, shards: int | None = None) -> DataFrame:
    """Rows (batch, hour, click_id, n_rows, cents, record, kind): what each batch writes.

    due, closed: hours after a pane's end. shards: keys that hold totals; by the session's partitions, if not given.
    """
    spark = table.sparkSession
    shards = shards or max(SALTS, parallelism(spark))
    with scope(spark) as own:
        root = folder(spark, "panes")
        clocks = staged(clicks(table, batches), batches, shards, root)
        with _settings(spark, root.startswith("file:")):
            for b, clock in enumerate(clocks):
                rename(spark, f"{root}/staged/batch={b}", f"{root}/fed/b{b}")
                start(spark, root, b, clock, b == batches - 1, due, closed, shards)
        for used in ("fed", "staged", "checkpoint"):
            delete(spark, f"{root}/{used}")
        own.kept.add(root)
    found = spark.read.schema(RESULT).parquet(f"{root}/out")
    return found.withColumn("click_id", F.nullif("click_id", F.lit(NAMELESS)))

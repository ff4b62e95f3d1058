"""Intermediate tables in the folder all executors share, and the scopes that own them."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: On a mounted folder Hadoop's default starts two processes (chmod) for each part file, and each of them shares the
#: executor's memory for a moment; this one starts none. It concerns `file:` paths alone. Parquet pages have checksums.
PLAIN_FILES = {"fs.file.impl": "org.apache.hadoop.fs.RawLocalFileSystem", "fs.file.impl.disable.cache": "true"}


def shared_dir(spark: SparkSession) -> str:
    """`spark.checkpoint.dir`; only where the session names none and runs on this machine alone, a temporary folder."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="folio-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


class Scope:
    """Owns the folders and catalog tables written while it is the open scope of its thread, failed writes included."""

    def __init__(self, spark: SparkSession):
        self.spark, self.owned, self.kept = spark, {}, set()  # path to the name of its catalog table, if it has one

    def own(self, path: str, table: str | None = None) -> None:
        self.owned[path] = table

    def keep(self, df: DataFrame) -> DataFrame:
        """Let a materialized table outlive this scope: the scope around it owns it then."""
        self.kept.add(df._folio_path)
        return df

    def drop(self, path: str) -> None:
        """Delete one of its folders now. Folders of other scopes stay."""
        if path in self.owned:
            if table := self.owned.pop(path):
                self.spark.sql(f"DROP TABLE IF EXISTS {table}")
            delete(self.spark, path)

    def close(self) -> None:
        """Delete all that it owns."""
        for path in list(self.owned):
            self.drop(path)


_open: ContextVar[Scope | None] = ContextVar("scope", default=None)
_roots: dict[str, Scope] = {}
_lock = threading.Lock()


def current(spark: SparkSession) -> Scope:
    """The thread's open scope; outside of any, that of the whole application, which `close` empties."""
    if found := _open.get():
        return found
    with _lock:
        return _roots.setdefault(spark.sparkContext.applicationId, Scope(spark))


@contextmanager
def scope(spark: SparkSession) -> Iterator[Scope]:
    """A scope for the tables written inside, by this thread alone, so that queries of other threads keep theirs.

    When it ends, what it owns is deleted, but for what it was told to keep: that goes to the scope around it. A
    DataFrame returned from inside may read only kept tables and sources.
    """
    around, own = current(spark), Scope(spark)
    token = _open.set(own)
    try:
        yield own
    finally:
        _open.reset(token)
        for path in own.kept & own.owned.keys():
            around.own(path, own.owned.pop(path))
        own.close()


@contextmanager
def lasting() -> Iterator[None]:
    """What is written inside belongs to the application, whatever scope is open: for tables that many queries share."""
    token = _open.set(None)
    try:
        yield
    finally:
        _open.reset(token)


def close(spark: SparkSession) -> None:
    """Delete every table that the application wrote outside of scopes or kept from them."""
    with _lock:
        found = _roots.pop(spark.sparkContext.applicationId, None)
    if found:
        found.close()


def folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, owned by the open scope."""
    path = f"{shared_dir(spark)}/folio-{uuid.uuid4().hex}-{name}"
    current(spark).own(path)
    return path


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """df written to the shared folder and read back: no lineage, no loss with an executor.

    The table carries no partitioning, so a later join may split skewed keys. The open scope owns it.
    """
    path = folder(df.sparkSession, name)
    df.write.options(**PLAIN_FILES).mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._folio_path = path
    return out


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def rename(spark: SparkSession, old: str, new: str) -> None:
    """Give a file or folder another name, in a folder that may not be there yet."""
    jvm = spark._jvm.org.apache.hadoop.fs
    fs = jvm.Path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(jvm.Path(new).getParent())
    if not fs.rename(jvm.Path(old), jvm.Path(new)):
        raise OSError(f"{old} can't take the name {new}")


def discard(df: DataFrame) -> None:
    """Delete a table that `materialize` gave in this scope, once nothing reads it any more; other tables stay."""
    if path := getattr(df, "_folio_path", None):
        current(df.sparkSession).drop(path)


class Bucketed:
    """A table bucketed and sorted by a column in the shared folder, so that joins and sums on it need no shuffle.

    observed: an observation and its aggregates, filled in as the rows are written, after the last shuffle.
    """

    def __init__(self, df: DataFrame, column: str, buckets: int, observed: tuple = ()):
        self.spark, self.column, self.buckets = df.sparkSession, column, buckets
        self.name = f"folio_{uuid.uuid4().hex}"
        self.path = f"{shared_dir(self.spark)}/{self.name}"
        self.scope = current(self.spark)
        self.scope.own(self.path, self.name)
        rows = df.repartition(buckets, column).sortWithinPartitions(column)
        rows = rows.observe(*observed) if observed else rows
        rows.write.bucketBy(buckets, column).sortBy(column).option("path", self.path).saveAsTable(self.name)

    def read(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        self.scope.drop(self.path)


def parallelism(spark: SparkSession) -> int:
    """Partitions for a shuffle whose tasks compute more than they read."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, part: int = 4 << 20, known: int = 1 << 50) -> int:
    """Partitions for a shuffle of df: by the size that the optimizer expects, and no fewer than all tasks need.

    A size over `known` is the optimizer's way to say that it has none.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return max(parallelism(df.sparkSession), size // part if size < known else 0)

"""Committed versions of a stored index: one pointer file names the tables of a version and is replaced in one step.

Tables are never changed once a pointer names them. A change writes new tables beside them and commits a new pointer, so
a failure at any point leaves the version before it; `vacuum` deletes what no pointer names.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

from foliospark.sources import scratch

POINTER = "current.json"


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    return scratch.exists(spark, f"{path}/{POINTER}")


def read(spark: SparkSession, path: str) -> dict | None:
    """The committed version, if there is one."""
    if not exists(spark, path):
        return None
    p, fs = _fs(spark, f"{path}/{POINTER}")
    stream = fs.open(p)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def commit(spark: SparkSession, path: str, version: dict) -> None:
    """Make the version the current one. The pointer is written whole under another name and takes its name then."""
    jvm = spark._jvm.org.apache.hadoop.fs
    new, fs = _fs(spark, f"{path}/{POINTER}.{uuid.uuid4().hex}")
    stream = fs.create(new, True)
    try:
        stream.write(bytearray(json.dumps(version).encode()))
    finally:
        stream.close()
    kind = getattr(jvm, "Options$Rename")
    options = spark.sparkContext._gateway.new_array(kind, 1)
    options[0] = kind.OVERWRITE
    old = jvm.Path(f"{path}/{POINTER}")
    jvm.FileContext.getFileContext(old.toUri(), spark._jsc.hadoopConfiguration()).rename(jvm.FileContext.getFileContext(new.toUri(), spark._jsc.hadoopConfiguration()).makeQualified(new), jvm.FileContext.getFileContext(old.toUri(), spark._jsc.hadoopConfiguration()).makeQualified(old), options)


def fresh(name: str) -> str:
    """A table's name within the index's folder that no version has."""
    return f"{name}-{uuid.uuid4().hex}"


def named(version: dict) -> set[str]:
    """Tables that a version names."""
    found = {version["splitters"], *version["stats"], *version["display"]}
    return found | {s[k] for s in version["segments"] for k in ("blocks", "vocabulary")}


def vacuum(spark: SparkSession, path: str) -> list[str]:
    """Delete the tables that the current version does not name; to be called when nothing reads or writes older ones."""
    p, fs = _fs(spark, path)
    kept = named(read(spark, path)) | {POINTER}
    gone = sorted(f.getPath().getName() for f in fs.listStatus(p) if f.getPath().getName() not in kept and not f.getPath().getName().endswith(".crc"))
    for name in gone:
        scratch.delete(spark, f"{path}/{name}")
    return gone

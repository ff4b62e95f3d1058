"""Code-point histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def characters(docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """(property, ch, cnt) over code points, the most frequent first; list columns count each element."""
    out = None
    for c in columns:
        kind = docs.schema[c].dataType.simpleString()
        texts = docs.select(F.explode(c).alias("x")) if kind.startswith("array") else docs.select(F.col(c).cast("string").alias("x"))
        rows = texts.where("x <> ''").select(F.lit(c).alias("property"), F.explode(F.split("x", "")).alias("ch")).where("ch <> ''")
        out = rows if out is None else out.union(rows)
    return out.groupBy("property", "ch").agg(F.count("*").alias("cnt")).orderBy("property", F.desc("cnt"), "ch")

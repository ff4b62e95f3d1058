"""Readers: the JSON-lines corpus and its projections, judgements, stop words, word vectors, thesaurus."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from foliospark.functions.scalars import author_ids, author_names, record_size
from foliospark.sources.scratch import discard, materialize

_STRINGS = T.ArrayType(T.StringType())
DOCUMENT = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("paperAbstract", T.StringType()),
        T.StructField("entities", _STRINGS),
        T.StructField("fieldsOfStudy", _STRINGS),
        T.StructField("authors", T.ArrayType(T.StructType([T.StructField("name", T.StringType()), T.StructField("ids", _STRINGS)]))),
        T.StructField("year", T.IntegerType()),
        T.StructField("venue", T.StringType()),
        T.StructField("journalName", T.StringType()),
        T.StructField("sources", _STRINGS),
        T.StructField("inCitations", _STRINGS),
        T.StructField("outCitations", _STRINGS),
    ]
)
JUDGEMENT = T.StructType(
    [
        T.StructField("query", T.StringType()),
        T.StructField("documents", T.ArrayType(T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("relevance", T.LongType())]))),
    ]
)


def defaulted(raw: DataFrame) -> DataFrame:
    """Rows with an id; missing strings empty, missing arrays empty, a missing year 0, a missing author name empty."""
    strings = ("title", "paperAbstract", "venue", "journalName")
    arrays = ("entities", "fieldsOfStudy", "sources", "inCitations", "outCitations")
    cols = {c: F.coalesce(c, F.lit("")) for c in strings if c in raw.columns} | {c: F.coalesce(c, F.array().cast("array<string>")) for c in arrays if c in raw.columns}
    if "year" in raw.columns:
        cols["year"] = F.coalesce("year", F.lit(0))
    if "authors" in raw.columns:
        named = F.transform("authors", lambda a: F.struct(F.coalesce(a["name"], F.lit("")).alias("name"), F.coalesce(a["ids"], F.array().cast("array<string>")).alias("ids")))
        cols["authors"] = F.coalesce(named, F.array().cast("array<struct<name:string,ids:array<string>>>"))
    return raw.where("id is not null").withColumns(cols)


def listing(spark: SparkSession, folder: str) -> list[str]:
    """The plain files of a folder itself, by name; hidden ones, which Spark doesn't read either, are left out."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(p)
    names = [(f.getPath().getName(), f.getPath().toString()) for f in found if f.isFile()]
    return [path for name, path in sorted(names) if name[0] not in "._"]


def documents(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object a line, malformed lines and lines without id left out. Only the columns used are parsed."""
    return defaulted(spark.read.schema(DOCUMENT).option("mode", "PERMISSIVE").json(path))


def parsed(lines: DataFrame, column: str = "value") -> DataFrame:
    """The same from a column of JSON text."""
    return defaulted(lines.select(F.from_json(column, DOCUMENT).alias("d")).select("d.*"))


def ids(docs: DataFrame) -> DataFrame:
    return docs.select("id")


def citations(docs: DataFrame) -> DataFrame:
    return docs.select("id", "outCitations", "inCitations")


def require_unique(docs: DataFrame, column: str = "id") -> DataFrame:
    """docs, if no id stands twice; citations of an id that does would have no one target."""
    twice = docs.groupBy(column).count().where("count > 1").first()
    if twice:
        raise ValueError(f"{column} {twice[column]!r} stands {twice['count']} times")
    return docs


def numbered(docs: DataFrame, order: str = "id", unique: bool = False) -> DataFrame:
    """doc_id from 0, dense, in the order of a column; with `unique`, a value that stands twice is refused.

    Documents are read once and written. Range partitions of what is written are sorted and counted, and each row adds
    its place to the rows before its partition, so no task sees more than its own rows.
    """
    whole = materialize(docs, "documents")
    if unique:
        require_unique(whole, order)
    ranged = whole.repartitionByRange(order).sortWithinPartitions(order).withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1))
    ranged = materialize(ranged, "ranged")
    discard(whole)
    counts = ranged.groupBy("_part").count()  # one row a partition
    before = counts.withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    return ranged.join(F.broadcast(before), "_part").withColumn("doc_id", F.col("_before") + F.col("_at")).drop("_part", "_at", "_before")


def string_ids(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(doc_id, id) of the wanted doc_ids; those that no document has are left out."""
    return docs.select("doc_id", "id").join(wanted.select("doc_id").distinct(), "doc_id")


def display(docs: DataFrame) -> DataFrame:
    """The record shown for a result: year, title, author names and ids, journal, and its size in bytes."""
    shown = docs.select("*", author_names(F.col("authors")).alias("author_names"), author_ids(F.col("authors")).alias("author_ids"))
    size = record_size(F.col("title"), F.col("author_names"), F.col("author_ids"), F.col("journalName"))
    return shown.select("id", "year", "title", "author_names", "author_ids", F.col("journalName").alias("journal_name"), size.alias("record_bytes"))


def judgements(spark: SparkSession, path: str) -> DataFrame:
    """(query, doc, relevance), one row for each judged document; bad lines are left out."""
    rows = spark.read.schema(JUDGEMENT).option("mode", "PERMISSIVE").json(path).where("query is not null")
    return rows.select("query", F.explode("documents").alias("d")).select("query", F.col("d.doc_id").alias("doc"), F.col("d.relevance").alias("relevance"))


def stopwords(spark: SparkSession, path: str, most: int = 10_000) -> list[str]:
    """The words of a file, one a line, once each. A list of over `most` words is refused, since it is sent to every task."""
    words = [r["value"] for r in spark.read.text(path).where("value <> ''").distinct().limit(most + 1).collect()]
    if len(words) > most:
        raise ValueError(f"more than {most} stop words in {path}")
    return sorted(words)


def word_vectors(spark: SparkSession, path: str) -> DataFrame:
    """(word, vector) from lines of a word and its components between spaces."""
    parts = F.split("value", " ")
    return spark.read.text(path).where("value <> ''").select(F.get(parts, F.lit(0)).alias("word"), F.transform(F.slice(parts, 2, 1 << 20), lambda x: x.cast("float")).alias("vector"))


def thesaurus(spark: SparkSession, path: str) -> DataFrame:
    """(pos, lemma, sense, rank, word) from Parquet: the rank-th word of a lemma's sense."""
    return spark.read.parquet(path).select("pos", "lemma", "sense", "rank", "word")

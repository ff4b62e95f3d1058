"""What people read: result listings, the evaluation report, histograms; as lines of text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions.scalars import duration
from foliospark.operators import graph
from foliospark.operators.evaluation import summary, timing

#: The order in which a result's properties are shown; others follow in the order they were asked for.
ORDER = ("title", "author_names", "author_ids", "year", "journal_name", "pagerank", "vsm_weight", "token_count", "max_tf", "record_bytes")
RULE, DASHES = " ---------------------------------------", "------------------------------------------------"


def listing(results: DataFrame, total: int, start: int = 0, end: int | None = None, properties: Iterable[str] = (), key: str = "doc_id") -> list[str]:
    """Lines for results of one query (rank from 1, `key`, properties) at places start to end, from 0 and included.

    Places are clamped to the `total` results; without results there are no lines. Only the range asked for is read.
    """
    if not total:
        return []
    first, last = max(start, 0), total - 1 if end is None else min(end, total - 1)
    if first > last:
        return ["", "No results found in the specified range"]
    names = sorted(properties, key=lambda p: ORDER.index(p) if p in ORDER else len(ORDER))
    lines = ["", f"Displaying results {first} to {last}", ""]
    for r in results.where(F.col("rank").between(first + 1, last + 1)).orderBy("rank").select("rank", key, *names).toLocalIterator():
        lines += [f"{r['rank'] - 1}{RULE}", f"DOC_ID: {r[key]}", *(f"{p.upper()}: {r[p]}" for p in names), ""]
    return lines


def _number(c: Column) -> Column:
    """Rounded half up to four digits; NaN as such."""
    return F.when(F.isnan(c), F.lit("NaN")).otherwise(F.round(c, 4).cast("string"))


def _lines(rows: DataFrame, section: int, place: Column, parts: list[Column]) -> DataFrame:
    return rows.select(F.lit(section).alias("section"), place.cast("long").alias("place"), F.posexplode(F.array(*parts)).alias("n", "line"))


def evaluation(runs: DataFrame, options: dict[str, object], total_ns: int) -> DataFrame:
    """(section, place, n, line): the report over (place, query, ns, results, avep, ndcg), whose order sorts its lines.

    A head with the options, a part for each query, and a summary; averages, least and most leave NaN out.
    """
    spark, say = runs.sparkSession, F.concat
    head = spark.range(1).select(F.lit(0).alias("section"), F.lit(0).cast("long").alias("place"), F.posexplode(F.array(*[F.lit(x) for x in ("-> Evaluation options:", *(f"{k}: {v}" for k, v in options.items()), "")])).alias("n", "line"))
    each = _lines(
        runs, 1, F.col("place"),
        [say(F.lit("Query: "), "query"), say(F.lit("Search time: "), duration(F.col("ns"))), say(F.lit("Results: "), F.col("results").cast("string")),
         say(F.lit("Average precision: "), _number(F.col("avep"))), say(F.lit("nDCG: "), _number(F.col("ndcg"))), F.lit("")],
    )
    marks = summary(runs)
    means = [_lines(marks.where(F.col("metric") == c), 2 + k, F.lit(0), [*lead, F.lit(f"[{title}]"), *(say(F.lit(f"{name}: "), _number(F.col(of))) for name, of in (("Average", "average"), ("Min", "least"), ("Max", "most"))), F.lit("")])
             for k, (c, title, lead) in enumerate((("avep", "Average precision", [F.lit(DASHES), F.lit("-> Summary"), F.lit("")]), ("ndcg", "nDCG", [])))]
    times = _lines(
        timing(runs.select("query", "ns", "results")), 4, F.lit(0),
        [F.lit("-> Search time"), say(F.lit("Total: "), duration(F.col("total"))), say(F.lit("Average per query: "), duration(F.col("mean"))),
         say(F.lit("Average per "), F.col("rate").cast("string"), F.lit(" results: "), duration(F.col("per_rate"))),
         say(F.lit("Min: "), duration(F.col("least")), F.lit(" for query: "), "quickest"), say(F.lit("Max: "), duration(F.col("most")), F.lit(" for query: "), "slowest"), F.lit(""),
         say(F.lit("-> Total time: "), duration(F.lit(total_ns)))],
    )
    out = head.union(each)
    for part in (*means, times):
        out = out.union(part)
    return out


def write(lines: DataFrame, path: str, order: tuple[str, ...] = ("section", "place", "n")) -> None:
    """Lines of text in one file, in order: a report is read by people, one part a query."""
    lines.orderBy(*order).select("line").coalesce(1).write.mode("overwrite").text(path)


def histogram_lines(rows: DataFrame, key: str, count: str, by_count: bool = False) -> DataFrame:
    """(place, line) of a histogram, `key count`: keys ascending, or counts descending with ties by key."""
    order = [F.desc(count), F.col(key)] if by_count else [F.col(key)]
    return rows.orderBy(*order).select(key, count, F.concat_ws(" ", F.col(key).cast("string"), F.col(count).cast("string")).alias("line"))


# The lines of the statistics of a citation graph, each with its counter, and the heads of the histograms.
COUNTERS = (
    ("documents", "Documents: "), ("sinks", "Sinks: "), ("sinks_true", "Sinks +(self references): "),
    ("in_edges_true", "In edges -(self references + multiple same references): "), ("in_edges", "In edges: "),
    ("out_edges_true", "Out edges -(self references + multiple same references): "), ("out_edges", "Out edges: "),
    ("duplicate_in_edges", "Duplicate In edges -(self references): "), ("docs_duplicate_in", "Documents with duplicate In edges -(self references): "),
    ("duplicate_out_edges", "Duplicate Out edges -(self references): "), ("docs_duplicate_out", "Documents with duplicate Out edges -(self references): "),
    ("docs_self_in", "Self referencing documents via In edges: "), ("self_in_edges", "Self referencing In edges: "),
    ("docs_self_out", "Self referencing documents via Out edges: "), ("self_out_edges", "Self referencing Out edges: "),
    ("inconsistent_in_edges", "In edges which are not listed in the Out edges of the source node: "),
    ("inconsistent_out_edges", "Out edges which are not listed in the In edges of the source node: "),
)
HEADS = {
    "in_edges": "Number of In edges | Number of documents",
    "out_edges": "Number of Out edges | Number of documents",
    "in_edges_true": "Number of In edges -(self references + multiple same references) | Number of documents",
    "out_edges_true": "Number of Out edges -(self references + multiple same references) | Number of documents",
    "in_edges_not_found": "Number of not found In edges -(multiple same references) | Number of documents",
    "out_edges_not_found": "Number of not found Out edges -(multiple same references) | Number of documents",
}


def graph_report(out: DataFrame, inn: DataFrame, nodes: DataFrame) -> DataFrame:
    """(file, n, line): the statistics of a citation graph and its histograms, the lines of each file by n.

    A histogram's line stands at its degree, after a head at -1; the counters' lines stand in their own order.
    """
    stats = graph.edge_stats(out, inn, nodes)
    lines = F.array(*[F.concat(F.lit(label), F.col(name).cast("string")) for name, label in COUNTERS])
    found = stats.select(F.lit("citations_stats").alias("file"), F.posexplode(lines).alias("n", "line")).select("file", F.col("n").cast("long").alias("n"), "line")
    degrees = {"in": graph.degrees(inn, nodes), "out": graph.degrees(out, nodes)}
    missing = {"in": graph.not_found(inn, nodes), "out": graph.not_found(out, nodes)}
    for name, head in HEADS.items():
        side = name.split("_")[0]
        column = "missing" if name.endswith("not_found") else "true" if name.endswith("true") else "raw"
        rows = histogram_lines(graph.histogram(missing[side] if column == "missing" else degrees[side], column), "degree", "documents")
        first = nodes.sparkSession.createDataFrame([(-1, head)], "n long, line string")
        found = found.union(first.union(rows.select(F.col("degree").cast("long"), "line")).select(F.lit(name), "n", "line"))
    return found


def write_files(lines: DataFrame, path: str) -> None:
    """Each file's lines, in order, as text in a folder of its name; the rows of a report, not of a table."""
    for r in lines.select("file").distinct().collect():
        write(lines.where(F.col("file") == r["file"]), f"{path}/{r['file']}", ("n",))

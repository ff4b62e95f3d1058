"""A training corpus from `documents`: toxic documents go, one of each group of near copies stays, repeated passages
are cut out, and what is left is packed into sequences of 1024 tokens.

Every stage takes null, empty and very long texts, null and repeated ids, repeated rows and further columns of any
name; all but the last return the columns that they got. No rows give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from foliospark.llm import jaccard, packing, suffixes, toxicity
from foliospark.llm.queries import vocabulary
from foliospark.llm.shared import discard, materialize, table


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.7. A null or empty text scores as one without a match; equal rows stay or go together."""
    lexicon = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    return toxicity.scored(docs, lexicon, below=0.7)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a Jaccard similarity of 0.8 or more of five-word shingles: that of the
    smallest doc_id, a null one last, ties by a hash of id and text. Texts without a word are in no group, so all stay."""
    return jaccard.one_of_each(docs, 5, 80, 100)


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the strings of 200 bytes that start twice among them, null ones empty; every row stays, if only
    with an empty text. Characters that a cut leaves in part go as well, and n_chars follows."""
    return suffixes.cleaned(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 tokens. A null or empty text is its end token alone."""
    return packing.pack(docs, vocabulary())


STAGES = [("toxicity", without_toxic), ("ngram_jaccard", without_near_copies), ("suffix_dedup", without_repeats), ("packing", packed)]

#: The stages aren't SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; the tables between stages are deleted once the next has been written."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)
    out = STAGES[-1][1](spark, docs, sf_dir)  # writes its tokens before it returns
    discard(docs)
    return out

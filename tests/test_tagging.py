"""The tagger learns from neighbours, and its tags feed the thesaurus."""

import random

import pytest

from foliospark.functions import tokens
from foliospark.operators import expansion, tagging
from foliospark.plans import queries

NOUNS, VERBS, BOTH = ["dog", "cat", "house", "river"], ["see", "want", "find"], ["run", "walk", "watch", "park"]


def text(rng):
    """Sentences in which some words are nouns after an article and verbs after a pronoun."""
    out = []
    for _ in range(rng.randint(1, 3)):
        out += [(rng.choice(["they", "we"]), "PRP"), (rng.choice(VERBS + BOTH), "VBP"), (rng.choice(["the", "a"]), "DT")]
        out += [(f"{rng.choice(['glor', 'fam', 'nerv'])}ious", "JJ")] * rng.randint(0, 1) + [(rng.choice(NOUNS + BOTH), "NN"), (f"{rng.choice(VERBS)}ly", "RB")]
    return out


def rows(spark, texts):
    data = [(i, p, w, t) for i, words in enumerate(texts) for p, (w, t) in enumerate(words)]
    return spark.createDataFrame(data, "query_id int, pos int, token string, tag string")


@pytest.fixture(scope="module")
def tagger(spark):
    rng = random.Random(2)
    return tagging.learn(rows(spark, [text(rng) for _ in range(300)]), rounds=4, parts=5)


def test_held_out_accuracy(spark, tagger):
    rng = random.Random(77)
    held = rows(spark, [text(rng) for _ in range(100)])
    found = {(r["query_id"], r["pos"]): r["tag"] for r in tagging.tagged(held.drop("tag"), tagger).collect()}
    right = [(found[r["query_id"], r["pos"]] == r["tag"], r["token"]) for r in held.collect()]
    assert sum(ok for ok, _ in right) / len(right) > 0.97
    both = [ok for ok, w in right if w in BOTH]  # only neighbours tell
    assert sum(both) / len(both) > 0.95


def test_odd_rows(spark, tagger):
    data = [(1, 5, "dog"), (1, 0, "they"), (1, 2, "run"), (2, 0, None), (3, 0, "")]
    found = tagging.tagged(spark.createDataFrame(data, "query_id int, pos int, token string"), tagger).collect()
    got = {(r["query_id"], r["pos"]): r["tag"] for r in found}
    assert len(got) == 5 and got[1, 0] == "PRP" and got[1, 2] == "VBP"
    assert tagging.tagged(spark.createDataFrame([], "query_id int, pos int, token string"), tagger).count() == 0
    with pytest.raises(ValueError):
        tagging.learn(spark.createDataFrame([], "query_id int, pos int, token string, tag string"))


def test_tags_choose_the_sense(spark, tagger):
    thesaurus = spark.createDataFrame([("noun", "walk", 1, 1, "stroll"), ("verb", "walk", 1, 1, "go")], "pos string, lemma string, sense int, rank int, word string")
    asked = spark.createDataFrame([(1, "they walk the dog"), (2, "we want the walk")], "query_id int, query string")
    words = asked.select("query_id", queries.F.posexplode(tokens.tokens(queries.F.col("query"), tokens.QUERY)).alias("pos", "token"))
    found = expansion.by_thesaurus(tagging.tagged(words, tagger), thesaurus)
    assert {(r["query_id"], r["term"]) for r in found.collect() if r["cand"]} == {(1, "go"), (2, "stroll")}


def test_benchmark(spark):
    found = queries.wordnet_tagged(spark, "/root/testdata/sf0.001")
    plain = queries.wordnet_expand(spark, "/root/testdata/sf0.001")
    same = found.join(plain, found.columns, "left_semi").count() / plain.count()
    assert same > 0.9  # tags follow words' lengths, which the tagger learns almost without fault

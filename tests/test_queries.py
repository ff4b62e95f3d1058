"""Every query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

from foliospark.plans.registry import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(p):
    def plain(v):
        v = v.item() if hasattr(v, "item") else v
        if v is None or v != v:
            return "null"
        return repr(round(v, 8) + 0.0) if isinstance(v, float) and math.isfinite(v) else str(v)

    return sorted(tuple(plain(v) for v in r) for r in p[sorted(p.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, duck, name):
    ours, theirs = QUERIES[name](spark, SF).toPandas(), duck.sql(SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)


def test_every_query_has_sql():
    assert QUERIES.keys() - SQL.keys() == {"wordnet_tagged"}  # what a tagger learns is tested by its accuracy

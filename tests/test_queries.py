"""Every query with SQL against DuckDB, at the smallest size."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from lexmill import plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6)
    return str(v)[:19] if hasattr(v, "isoformat") else v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_same_as_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=str)
    want = duck.sql(plans.SQL[name])
    assert sorted(want.columns) == cols
    at = [want.columns.index(c) for c in cols]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=str)


def test_entry(spark):
    r = entry.entry(spark).collect()
    assert len(r) == 1 and r[0]["tokens"] > 0 and 0 <= r[0]["rho"] <= 1


def test_every_query_has_sql():
    assert set(plans.QUERIES) - set(plans.SQL) == {"bpe_train", "bpe_pieces", "word_cut", "word_cut_scores", "en_disambiguate", "en_validate", "en_rejection_rate"}

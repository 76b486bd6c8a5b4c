"""Bundles of words: odd words against DuckDB, and rules that are not moved to every word of the texts."""

import duckdb
import pytest

from lexmill import plans

TEXTS = ["ly ing ed er est s", "Early eager over oldest Older undER Ended ending Endings", "éed Ses ses A a the The x" * 3, "elegant-er usest (Apples) apples öest ást éer öler abled", "Zed zest Äs eest Er EST inged", "", None, "123 ?!", "a", "Under under under UNDER"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("words")
    rows = [(i, t, "en", "web", len(t or "")) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").coalesce(1).write.parquet(f"{at}/documents.parquet")
    return str(at)


@pytest.fixture(scope="module")
def duck(folder):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    return con


def same(spark, duck, folder, name):
    want = duck.sql(plans.SQL[name])
    got = plans.QUERIES[name](spark, folder).select(*want.columns)
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows and rows == sorted(want.fetchall(), key=str)


def filters_of_words(spark, folder, name):
    """What is asked of each word before it is counted."""
    plan = plans.QUERIES[name](spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    return [x for x in plan[plan.index("Aggregate") : plan.index("Generate")].split("\n") if "Filter " in x]


def test_odd_words_singleton_tokens(spark, duck, folder):
    same(spark, duck, folder, "singleton_tokens")


def test_odd_words_bundles(spark, duck, folder):
    from lexmill.plans.measured import BUNDLES_SQL, bundles

    got = bundles(spark, folder)
    assert got.columns == ["w", "pos", "k1", "v1", "k2", "v2", "tags", "bundle"]
    assert sorted(map(tuple, got.collect())) == sorted(duck.sql(f"SELECT * FROM {BUNDLES_SQL}").fetchall())


def test_singleton_tokens_filters_bundles(spark, folder):
    assert filters_of_words(spark, folder, "singleton_tokens") == []


def test_odd_words_classify_rejection(spark, duck, folder):
    same(spark, duck, folder, "classify_rejection")


def test_classify_rejection_filters_counts(spark, folder):
    assert filters_of_words(spark, folder, "classify_rejection") == []

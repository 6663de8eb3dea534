import pytest

import __spark_entry__ as driver


def test_keys():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_flagship(spark):
    rows = driver.entry(spark)
    assert rows.columns == ["token", "n", "score"] and rows.count() > 0


FAST = [
    "chi2_words_3class", "vocab_presence", "split_nested", "surrogate_ids", "presence_nb_predict",
    "class_prf", "tfidf", "lang_filter", "write_counts", "sentiments_checked", "upsert_full",
]


@pytest.mark.parametrize("name", FAST)
def test_query_matches_sql(spark, folder, name):
    duckdb = pytest.importorskip("duckdb")
    from tools.check import TABLES, normal
    import pandas as pd

    store = duckdb.connect()
    for table in TABLES:
        store.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    mine = driver.queries()[name](spark, folder).toPandas()
    theirs = store.execute(driver.oracle_sql()[name]).fetchdf()
    pd.testing.assert_frame_equal(normal(mine), normal(theirs), check_dtype=False)

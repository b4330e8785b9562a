"""Every registered query with SQL is held against DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from medialake.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v if isinstance(v, int | str | bool) or v is None else str(v)


def rows(names, found):
    order = sorted(names)
    return sorted((tuple(plain(dict(zip(names, r))[c]) for c in order) for r in found), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_matches_sql(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    sql = duck.execute(registry.oracle_sql()[name])
    names = [c[0] for c in sql.description]
    assert sorted(df.columns) == sorted(names)
    expected = sql.fetchall()
    assert expected, "two empty results show nothing"
    assert rows(df.columns, df.collect()) == rows(names, expected)


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    found = df.collect()
    assert found and len(found) == df.count()


def test_search_for_what_is_not_wanted(spark):
    from medialake.operators import search

    docs = spark.createDataFrame([(1, "this one"), (2, "that one")], "id long, t string")
    assert search.search(docs, "NOT this", "id", ["t"]).count() == 0
    assert [r.id for r in search.search(docs, "one NOT this", "id", ["t"]).collect()] == [2]


def test_entry_imports_without_session():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_capture_times_of_large_ids(spark, tmp_path):
    """Ids whose birth times lie on the catalogue's clock, or years after it: what the query's SQL says."""
    ids = [*range(283_700, 283_760), *range(286_640, 286_700), *range(289_500, 289_560), *range(1_120_400, 1_120_460), *range(2_999_900, 2_999_960)]
    spark.createDataFrame([(i, "some words", "en", "web", 10) for i in ids], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(ids[0], 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"create view {t} as select * from read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    sql = con.execute(registry.oracle_sql()["sf16_taken_at"])
    names, df = [c[0] for c in sql.description], registry.queries()["sf16_taken_at"](spark, str(tmp_path))
    assert rows(df.columns, df.collect()) == rows(names, sql.fetchall())

"""Each query against its SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry_points
from recordloom import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"create view {t} as select * from '{D}/{t}.parquet'")
    return c


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, con, name):
    df = catalog.queries()[name](spark, D)
    order = sorted(df.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in order)) for r in df.collect())
    rel = con.sql(catalog.oracle_sql()[name])
    at = [rel.columns.index(c) for c in order]
    assert sorted(rel.columns) == order
    want = sorted(repr(tuple(plain(r[i]) for i in at)) for r in rel.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_runs(spark, name):
    assert len(catalog.queries()[name](spark, D).collect()) >= 0


def test_entry(spark):
    rows = entry_points.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"o_orderkey", "header_total", "line_total", "sum_matches"}
    assert set(entry_points.oracle_sql()) <= set(entry_points.queries())


def test_null_texts_are_no_copies(spark, con, tmp_path):
    spark.createDataFrame([(1, "a"), (2, None), (3, None), (4, "a")], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = catalog.queries()["exact_duplicates"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, None, 1, 2), (2, None, 2, 1), (3, None, 3, 1), (4, 1, 1, 2)]
    sql = catalog.oracle_sql()["exact_duplicates"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(duckdb.sql(sql).fetchall()) == [tuple(r) for r in rows]


def test_reading_places_of_ties_and_nulls(spark, tmp_path):
    """Ties of the SQL have one result whatever the order of the rows; nulls stand where the SQL has them."""
    tied = [(1, 6, 9.0, 80567.78), (1, 6, 9.0, 80553.84), (1, 7, 31.0, 6195.57), (2, 1, 5.0, 80553.84), (2, 1, 5.0, 80553.84)]
    columns = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double"
    want = [(1, 6, 2, 2), (1, 6, 3, 3), (1, 7, 1, 1), (2, 1, 1, 1), (2, 1, 2, 2)]
    for i, rows in enumerate([tied, tied[::-1]]):
        spark.createDataFrame(rows, columns).coalesce(1).write.parquet(f"{tmp_path}/{i}/lineitem.parquet")
        assert sorted(tuple(r) for r in catalog.queries()["reading_places"](spark, f"{tmp_path}/{i}").collect()) == want
    odd = [(3, 1, None, 50.0), (3, 2, 4.0, 50.0), (3, 3, 4.0, None), (None, 4, 1.0, 1.0), (3, None, 4.0, 50.0)]
    spark.createDataFrame(odd, columns).coalesce(1).write.parquet(f"{tmp_path}/odd/lineitem.parquet")
    got = sorted(repr(tuple(r)) for r in catalog.queries()["reading_places"](spark, f"{tmp_path}/odd").collect())
    sql = catalog.oracle_sql()["reading_places"].replace("FROM lineitem", f"FROM '{tmp_path}/odd/lineitem.parquet/*.parquet'")
    assert got == sorted(map(repr, duckdb.sql(sql).fetchall()))

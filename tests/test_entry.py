import glob
import os

import duckdb
import pytest

import __spark_entry__ as e

D = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in glob.glob(f"{D}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


def test_entry(spark):
    assert e.entry(spark).columns == ["doc_id", "score", "url", "title", "description"]


@pytest.mark.skipif(not os.path.isdir(D), reason="no test data")
@pytest.mark.parametrize("name", sorted(set(e.core.SQL) & set(e.core.QUERIES)))
def test_query_matches_sql(spark, duck, name):
    got, want = e.queries()[name](spark, D), duck.execute(e.oracle_sql()[name])
    columns = sorted(got.columns)
    key = lambda rows: sorted(repr([round(x, 6) if isinstance(x, float) else x for x in r]) for r in rows)
    frame = want.fetchall()
    names = [c[0] for c in want.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    strip = lambda x: x.replace(tzinfo=None) if hasattr(x, "tzinfo") else x
    assert key([[strip(r[c]) for c in columns] for r in got.collect()]) == key([[strip(r[i]) for i in order] for r in frame])

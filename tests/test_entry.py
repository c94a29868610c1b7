import pytest

import __spark_entry__ as entry
from kelpline.jobs.registry import ORACLES, QUERIES


def test_queries_and_sql_have_the_same_names():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(ORACLES) == set(QUERIES)


@pytest.mark.parametrize("name", ["kb_overview", "merge_short", "fuse", "dense_recall"])
def test_query_equals_sql(spark, name):
    import duckdb

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "benchmark", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    got = QUERIES[name](spark, folder)
    want = con.sql(ORACLES[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    rows = lambda all_: sorted([str(tuple(float(v) if isinstance(v, (int, float)) else v for v in r)) for r in all_])
    assert rows(tuple(r) for r in got.select(columns).collect()) == rows(con.sql(f"SELECT {', '.join(columns)} FROM ({ORACLES[name]})").fetchall())

"""The entry module: names, and every core query against its SQL on the smallest tables."""

import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def test_every_oracle_has_a_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    return value.replace(tzinfo=None) if hasattr(value, "tzinfo") else value


def test_core_queries_equal_their_sql(spark):
    import duckdb

    from corpusloom.plans import oracle, queries

    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    wrong = []
    for name, query in queries.QUERIES.items():
        df = query(spark, DATA)
        columns = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        if name in oracle.SQL:
            result = con.sql(oracle.SQL[name])
            at = [result.columns.index(c) for c in columns]
            want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
            if got != want:
                wrong.append(name)
    assert not wrong

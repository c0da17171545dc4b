"""Every query of the text operators that has SQL, against it, on the smallest tables."""

import glob
import os

import pytest

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables here")


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


def test_text_queries_equal_their_sql(spark):
    import duckdb

    from corpusloom.llm import queries

    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    wrong = []
    for name, sql in queries.SQL.items():
        df = queries.QUERIES[name](spark, DATA)
        columns = sorted(df.columns)
        got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
        result = con.sql(sql)
        want = sorted((tuple(plain(r[result.columns.index(c)]) for c in columns) for r in result.fetchall()), key=repr)
        if got != want:
            wrong.append(name)
    assert not wrong


def test_items_and_their_masked_texts_agree(spark):
    """No value found in a text stands in its masked text beside its placeholder's count."""
    from corpusloom.llm import pii, queries

    found = {}
    for r in queries.p4_found(spark, DATA).collect():
        found.setdefault((r["item_kind"], r["item_id"]), []).append((r["pii_type"], r["pii_value"]))
    masked = queries.p4_masked(spark, DATA).collect()
    assert {(r["item_kind"], r["item_id"]) for r in masked} >= set(found)
    for r in masked:
        kinds = {kind for kind, _ in found.get((r["item_kind"], r["item_id"]), [])}
        assert all(pii.PLACEHOLDER[kind] in r["masked"] for kind in kinds)
        if not kinds:
            assert not any(p in r["masked"] for p in pii.PLACEHOLDER.values())

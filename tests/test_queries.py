"""Every query with SQL, against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__
from sonagraph.plans.queries import oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    con = duckdb.connect()
    for f in os.listdir(FOLDER):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{FOLDER}/{f}'")
    df = queries()[name](spark, FOLDER)
    rel = con.sql(oracle_sql()[name])
    assert sorted(df.columns) == sorted(rel.columns)
    cols = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr)
    at = [rel.columns.index(c) for c in cols]
    want = sorted((tuple(plain(r[i]) for i in at) for r in rel.fetchall()), key=repr)
    assert got == want


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the driver's tables aren't here")
def test_entry(spark):
    row = __spark_entry__.entry(spark).first()
    assert (row["song_id"], row["alignment_frames"]) == (2, 40) and row["votes"] > 150


def test_no_join_without_a_key(spark):
    for name in ("fan_out_hashes", "best_match", "local_maxima"):
        plan = queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan

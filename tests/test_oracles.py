"""The registered queries against their SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_points

FOLDER = "/root/testdata/sf0.001"
SLOW = {"variant_summary", "variant_summary_v2", "variant_summary_v4",
        "convergence", "convergence_gated", "workflow_v0", "workflow_v1", "workflow_v3", "model_wins",
        "pr_comparison", "metrics_long", "pr_highlights", "votes_wide", "vote_tally",
        "gate_route_basic", "gate_route_gated", "tied_docs", "validation_sample_size"}
ORACLES = entry_points.oracle_sql()

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    return value


def test_every_oracle_has_a_query():
    assert ORACLES.keys() <= entry_points.queries().keys()


@pytest.mark.parametrize("name", sorted(set(ORACLES) - SLOW))
def test_matches_sql(spark, duck, name):
    df = entry_points.queries()[name](spark, FOLDER)
    columns = sorted(df.columns)
    cursor = duck.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    expected = sorted((tuple(plain(r[k]) for k in at) for r in cursor.fetchall()), key=str)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert got == expected


def test_entry(spark):
    assert entry_points.entry(spark).count() > 0

"""Registered queries against their SQL on the smallest tables.

All of them run with RECOLLECT_ALL_QUERIES=1; by default the headline queries run and the
SQL of all others is only bound.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
import bench
from recollect.plans import catalog

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
QUERIES, ORACLES = catalog.all_queries(), catalog.all_oracles()
EVERY = bool(os.environ.get("RECOLLECT_ALL_QUERIES"))

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else float(f"{value:.9g}")
    return value


def same_rows(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in frame.collect()), key=repr)
    result = duck.execute(ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert got == want and got


def test_names_agree():
    assert QUERIES.keys() <= entry.queries().keys() and ORACLES.keys() <= entry.oracle_sql().keys()
    assert set(ORACLES) <= set(QUERIES) and set(bench.HEADLINES) <= set(QUERIES)
    assert set(QUERIES) - set(ORACLES) == {"artifact_manifest"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle_binds(duck, name):
    duck.execute("explain " + ORACLES[name])


@pytest.mark.parametrize("name", sorted(ORACLES) if EVERY else sorted(bench.HEADLINES))
def test_query_equals_its_oracle(spark, duck, name):
    same_rows(spark, duck, name)


@pytest.mark.parametrize("name, scans, exchanges", [("resume_plan", 2, 3), ("usage_totals", 1, 2), ("apportion_usage", 5, 7), ("metrics_table", 6, 6)])
def test_sources_are_read_once(spark, name, scans, exchanges):
    """Scans and shuffles of the plan before the adaptive part changes it."""
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("FileScan parquet") <= scans
    prepared = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    assert prepared.count("Exchange hashpartitioning") <= exchanges


def test_long_conversations_do_not_share_documents(spark, tmp_path):
    """One conversation of 10,000 turns, the next ids after it short."""
    path = str(tmp_path)
    sized = "select 1L as conv_id, explode(sequence(0L, 9999L)) as turn union all select id, explode(sequence(0L, 5L)) from range(2, 5)"
    rows = spark.sql(f"select *, if(turn % 2 = 0, 'user', 'assistant') as role, concat('text ', turn) as text from ({sized})")
    rows.write.parquet(f"{path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{path}/conversations.parquet/*.parquet'")
    for name in ("read_conversation_dataset", "read_question_dataset", "enumerate_questions"):
        frame = QUERIES[name](spark, path)
        names = [c[0] for c in con.execute(f"describe {ORACLES[name]}").fetchall()]
        got = sorted(map(tuple, frame.select(*names).collect()), key=repr)
        assert got == sorted(con.execute(ORACLES[name]).fetchall(), key=repr)
        assert name == "enumerate_questions" or len(got) == -(-10_000 // 64) + 3


def test_entry_has_a_stable_schema(spark):
    frame = entry.entry(spark)
    assert frame.columns[:3] == ["scope", "group", "n"] and frame.count() > 0

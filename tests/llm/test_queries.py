"""The registered queries: names, and their SQL on the smallest tables."""

import math

import duckdb
import pytest

import __spark_entry__ as entry
from recollect.llm.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"


def plain(value):
    return (float(f"{value:.9g}") if not math.isnan(value) else "nan") if isinstance(value, float) else value


def test_all_operators_and_the_pipeline_are_registered():
    names = entry.queries().keys()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)] == [1] * 13
    assert "pipeline" in names and set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    frame = QUERIES[name](spark, DATA)
    columns = sorted(frame.columns)
    got = sorted(repr(tuple(plain(r[c]) for c in columns)) for r in frame.collect())
    result = con.execute(ORACLES[name])
    at = [[d[0] for d in result.description].index(c) for c in columns]
    assert got == sorted(repr(tuple(plain(r[i]) for i in at)) for r in result.fetchall()) and got

"""Queries against their SQL on a small table."""

from __future__ import annotations

import os

import pytest

from meterlake.llm import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_spelling_variants", "op12_conversation_repair"])
def test_same_as_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    db = duckdb.connect()
    for t in os.listdir(SF):
        db.execute(f"create view {t.removesuffix('.parquet')} as select * from '{SF}/{t}'")
    got, want = queries.queries()[name](spark, SF), db.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(tuple, got.select(*columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)

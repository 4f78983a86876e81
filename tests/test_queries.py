"""Every query of the engine's own against its SQL oracle at sf0.001, where the tables are at hand."""

import os

import duckdb
import pytest

from filmloom.plans import descriptors, films, media, modes, pictures, queries, reports, streams  # noqa: F401
from filmloom.plans.registry import ORACLES, QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"create view {f.split('.')[0]} as select * from read_parquet('{SF}/{f}')")
    got = QUERIES[name](spark, SF)
    want = con.sql(ORACLES[name])
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda r: tuple(str(x) for x in r)
    assert sorted((tuple(r[c] for c in cols) for r in got.collect()), key=key) == sorted(want.project(", ".join(f'"{c}"' for c in cols)).fetchall(), key=key)

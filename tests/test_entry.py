"""The driver contract, and oracles of a few queries at the smallest scale."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from meridian.sources.bindings import TABLES

SF = "/root/testdata/sf0.001"
SAMPLE = ("S1", "J1", "J4", "J11", "W8", "C1", "A6", "A11", "M14", "F5", "K1", "S12", "C17", "F6", "F14", "X7", "D3", "Q6", "A19", "A22")


def test_entry_gives_rows(spark):
    assert entry_module.entry(spark).count() == 2


def test_every_oracle_has_a_query():
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    return repr(v) if isinstance(v, float) else str(v)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry_module.queries()[name](spark, SF)
    want = con.execute(entry_module.oracle_sql()[name])
    names = [c[0] for c in want.description]
    got = [tuple(map(plain, r)) for r in df.select(*names).collect()] if set(names) == set(df.columns) else None
    key = lambda r: tuple(map(str, r))
    assert got is not None and sorted(got, key=key) == sorted((tuple(map(plain, r)) for r in want.fetchall()), key=key)

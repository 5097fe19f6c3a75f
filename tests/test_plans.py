"""How often the fact table is read."""

import re

import pytest

from meridian import queries
from meridian.operators import portfolio
from meridian.plans import model_queries
from meridian.sources import bindings


@pytest.mark.parametrize("key", ["M12", "M13", "M14", "M15", "M16", "W16", "W17"])
def test_portfolio_queries_read_lineitem_twice_at_most(spark, monkeypatch, key):
    plans = []

    def noted(df, name, real=bindings.written):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, name)

    for module in (bindings, portfolio, model_queries):
        monkeypatch.setattr(module, "written", noted)
    plans.append(queries.queries()[key](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString())
    assert 1 <= sum(len(re.findall(r"FileScan parquet [^\n]*l_shipdate", p)) for p in plans) <= 2

"""Features of events without wide shuffles; bars of the benchmark from those of the tickers."""

from datetime import date as D

from meridian.operators import features
from meridian.plans.model_queries import MODEL, features_of
from meridian.sources.bindings import BINDINGS, Tables

SF = "/root/testdata/sf0.001"


def plain(df):
    return sorted(map(str, map(tuple, df.collect())))


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_priors_from_one_sort(spark):
    rows = [(f"e{k}{t}", t, ("sec_filing", "earnings_call", None)[k % 3], f"{k:02d}", D(2024, 1, 1 + k // 4) if k < 20 else None, "10-K", "2024Q1", None if k % 5 == 0 else float(k)) for k in range(23) for t in ("A", None)]
    x = spark.createDataFrame(rows, "event_key string, ticker string, event_source string, event_id string, event_date date, form_type string, fiscal_period string, v double")
    got, dates = features.with_priors(x, "v")
    want = features.event_prior(features.calendar_features(x), "v")
    assert plain(got.select(*want.columns)) == plain(want)
    assert plain(dates) == plain(x.select("ticker", "event_date").distinct())


def test_features_are_joined_without_a_shuffle_of_events(spark):
    x = features_of(Tables(spark, SF))
    assert "hashpartitioning" not in plan_of(x)
    few = features_of(Tables(spark, SF), MODEL)
    assert not {*features.SENTIMENT, *features.TOPIC} & set(few.columns)
    assert plain(few.select("event_key", *MODEL)) == plain(x.select("event_key", *MODEL))


def test_bars_read_line_items_once(spark):
    t = Tables(spark, SF)
    for name in ("bars_daily", "bars_weekly"):
        got = getattr(t, name)
        assert sum("FileScan" in line and "l_shipdate" in line for line in plan_of(got).splitlines()) == 1
        assert plain(got) == plain(t.sql(BINDINGS[name])) and got.schema == t.sql(BINDINGS[name]).schema



def test_parts_of_tree_tables_are_bounded(spark, monkeypatch):
    import numpy as np

    from meridian.operators import models
    from meridian.sources.workspace import written

    monkeypatch.setattr(models, "PART_ROWS", 100)
    rows = written(spark.range(1000).selectExpr("CAST(id AS STRING) AS event_key", "CAST(id AS DOUBLE) AS y", "array(CAST(id AS DOUBLE)) AS x", "array(IF(id < 900, 1, 0)) AS roles"), "rows")
    one = np.zeros((1, 1))
    x = models.vectors(rows, models.Inputs(one, one, np.zeros((1, 2)), np.ones((1, 2))), 0)
    sizes = x.rdd.mapPartitions(lambda r: [sum(1 for _ in r)]).collect()
    assert sum(sizes) == 900 and len(sizes) == 9 and max(sizes) < 200

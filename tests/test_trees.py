"""Trees of all fits grown side by side against MLlib's; equal events counted once; weighted figures."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_models import ROWS, frame

from meridian.operators import features as feat
from meridian.operators import metrics as met
from meridian.operators import models as mod
from meridian.operators import trees
from meridian.plans.model_queries import fold_trees, for_events, model_cases, model_rows
from meridian.sources.bindings import Tables
from meridian.sources.workspace import written

SF = "/root/testdata/sf0.001"


def sample(seed=0, n=600):
    """Features of few values, some missing, and two fits."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, 4)) * 2)
    x[rng.random((n, 4)) < 0.2] = np.nan
    x[:, 2] = 2.5  # does not vary
    y = np.nan_to_num(x[:, 0]) ** 2 - 3.0 * np.isnan(x[:, 1]) + np.nan_to_num(x[:, 3]) + 0.3 * rng.normal(size=n)
    roles = np.stack([np.where(np.arange(n) < 400, 1, 2), np.where(np.arange(n) % 3 == 0, 2, np.where(np.arange(n) % 7 == 1, 0, 1))], axis=1)
    return x, y, roles


def values(found):
    return {(r.fit, r.model, r.event_key): r.prediction for r in found.collect()}


@pytest.mark.parametrize("early, depth", [(True, 2), (False, 3)])
def test_boosted_trees_are_those_of_mllib(spark, early, depth):
    from pyspark.ml.regression import GBTRegressor

    rows = frame(spark, *sample())
    codes = trees.learn_codes(rows, 2, 4)
    models = [trees.Boosted(k, 12, depth, 0.4, early, share=1.0) for k in (0, 1)]
    trees.boost(trees.blocks_of(rows, codes, 2), codes, models)
    got = values(trees.tree_predictions(rows, codes, [("boosted", m) for m in models]))
    inputs, size = mod.learn_inputs(rows, 2, 4), 0
    for k in (0, 1):
        x = mod.vectors(rows, inputs, k)
        more = {"validationIndicatorCol": "held", "validationTol": 1e-4} if early else {}
        theirs = GBTRegressor(maxIter=12, maxDepth=depth, stepSize=0.4, minInstancesPerNode=5, maxBins=32, **more).fit(x if early else x.where("NOT held"))
        assert len(models[k].trees) == theirs.getNumTrees
        for r in theirs.transform(x.where("held")).collect():
            assert got[k, "boosted", r.event_key] == pytest.approx(r.prediction, abs=1e-9)
            size += 1
    assert size == len(got)


def test_rounds_end_where_held_rows_gain_no_more(spark):
    rng = np.random.default_rng(1)
    x, roles = rng.normal(size=(500, 3)), np.where(np.arange(500) < 300, 1, 2)[:, None]
    rows = frame(spark, x, rng.normal(size=500), roles)  # nothing to learn
    codes = trees.learn_codes(rows, 1, 3)
    m = trees.Boosted(0, 20, 2, 0.1, True)
    trees.boost(trees.blocks_of(rows, codes, 1), codes, [m])
    assert 1 <= len(m.trees) < 20


def test_rows_that_stand_for_several(spark, monkeypatch):
    x, y, roles = sample(3, 300)
    n = 1 + np.arange(300) % 4
    one = written(frame(spark, x, y, roles).withColumn("n", 1 + F.substring("event_key", 2, 9).cast("int") % 4), "counted")
    many = frame(spark, *(np.repeat(a, n, axis=0) for a in (x, y, roles)))
    monkeypatch.setattr(trees, "BLOCK_ROWS", 50)
    found = []
    for rows in (one, many):
        inputs, codes = mod.learn_inputs(rows, 2, 4), trees.learn_codes(rows, 2, 4)
        moments = mod.normal_equations(rows, inputs)
        m = trees.Boosted(0, 5, 2, 0.4, False, share=1.0)
        trees.boost(trees.blocks_of(rows, codes, 2), codes, [m])
        found.append([inputs.medians, inputs.missing, inputs.means, inputs.scales, moments[1].spread, moments[1].covered, m.predict(codes.of(x, 0), codes.middle[0])])
        assert [m.n for m in moments] == [n[roles[:, k] == 1].sum() for k in (0, 1)]
    for a, b in zip(*found):
        assert np.allclose(a, b, atol=1e-9)


def test_drawn_events_of_equal_ones():
    n = np.repeat([1.0, 3.0, 1000.0], 4000)
    for again, share, spread in ((False, 0.8, 0.16), (True, 1.0, 1.0)):
        got = trees.draws(7, 1, 2, 3, n, share, again)
        assert (got == trees.draws(7, 1, 2, 3, n, share, again)).all() and (got != trees.draws(7, 1, 3, 3, n, share, again)).any()
        assert again or (got <= n).all()
        for k in (1.0, 3.0, 1000.0):
            some = got[n == k]
            assert some.mean() == pytest.approx(k * share, rel=0.05) and some.var() == pytest.approx(k * spread, rel=0.1)


def test_ranges_are_quantiles_of_all_values(spark):
    rng = np.random.default_rng(5)
    x = np.stack([rng.normal(size=700), np.where(rng.random(700) < 0.5, 0.0, rng.normal(size=700)), rng.integers(0, 3, 700)], axis=1)
    x[:50, 0] = np.nan
    rows = frame(spark, x, x[:, 2], np.ones((700, 1)))
    codes = trees.learn_codes(rows, 1, 3)
    v = np.sort(x[50:, 0])
    assert (codes.ends[0][0] == v[np.arange(1, 32) * 650 // 32]).all()
    assert (codes.of(np.array([[0, 0.0, 0]]), 0)[1] == 1 + codes.of(np.array([[0, -1e-9, 0]]), 0)[1]).all()  # half are 0.0: a range by itself
    assert (codes.of(np.array([[0, 1e-9, 0]]), 0)[1] == 1 + codes.of(np.array([[0, 0.0, 0]]), 0)[1]).all()
    assert codes.ends[0][2].tolist() == [0.5, 1.5]
    assert (codes.of(x, 0)[0, :50] == trees.GONE).all() and codes.middle[0, 0] == np.searchsorted(codes.ends[0][0], np.median(v))


def test_infinite_values_are_ranges_of_their_own():
    v = np.array([-np.inf, -1.0, 2.0, np.inf])
    assert trees.between(v).tolist() == [-np.inf, 0.5, 2.0]
    assert trees.Codes([[trees.between(v)]], np.zeros((1, 1), int)).of(v[:, None], 0).tolist() == [[0, 1, 2, 3]]


def test_a_forest_learns_and_is_the_same_again(spark):
    x, y, roles = sample(4, 2000)
    rows = frame(spark, x, y, roles)
    got, again = (values(fold_trees(rows, 2, 4)) for _ in range(2))
    assert got == pytest.approx(again, abs=1e-9)
    for k in (0, 1):
        held = np.flatnonzero(roles[:, k] == 2)
        for name in ("boosted", "forest"):
            p = np.array([got[k, name, f"e{i}"] for i in held])
            assert ((y[held] - p) ** 2).mean() < 0.35 * y[held].var()
    assert len(got) == 2 * (roles == 2).sum()


def test_no_held_rows_and_no_rows(spark):
    x, y, roles = sample(4, 60)
    for rows in (frame(spark, x, y, np.ones((60, 2))), frame(spark, x[:0], y[:0], np.ones((0, 2))), spark.createDataFrame([], ROWS)):
        assert fold_trees(rows, 2, 4).collect() == []


def test_cases_stand_for_all_events(spark):
    t = Tables(spark, SF)
    events, cases = model_cases(t)
    seen = {r.event_key: r for r in model_rows(t).collect()}
    assert cases.agg(F.sum("n")).first()[0] == len(seen)
    each = cases.select("event_key", F.lit(0).alias("fit"), F.lit("m").alias("model"), F.col("y").alias("actual"), F.lit(0.5).alias("prediction"))
    got = for_events(each, cases, events).collect()
    assert sorted(r.event_key for r in got) == sorted(seen) and all(r.actual == seen[r.event_key].y for r in got)
    same = F.to_json(F.struct("x", "y", "roles", "anchor_trading_date", "target_trading_date"))
    rows = model_rows(t).select(same.alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    assert rows.exceptAll(cases.select(same.alias("k"), "n").groupBy("k").agg(F.sum("n").alias("n"))).isEmpty()


def test_more_equal_events_make_no_more_cases(spark):
    t = Tables(spark, SF)
    t.stored("bars_daily", "eps_results")
    from meridian.plans.source_queries import items_of

    x, _, texts = feat.events_in_order(t.corp_events, items_of(t))
    events = feat.keyed(x, texts).where("text_key IS NULL")
    more = events.withColumn("event_key", F.concat("event_key", F.lit("-again")))
    once, twice = (feat.alike(x).agg(F.count(F.lit(1)).alias("cases"), F.sum("n").alias("n")).first() for x in (events, events.unionByName(more)))
    assert twice.cases == once.cases and twice.n == 2 * once.n


def test_weighted_figures_are_those_of_all_rows(spark):
    rng = np.random.default_rng(6)
    rows = [(m, float(np.round(a, 1)), float(np.round(b, 1)) if m != "flat" else 0.25, int(n)) for m in ("a", "b", "flat") for a, b, n in zip(rng.normal(size=80), rng.normal(size=80), rng.integers(1, 5, 80))]
    x = spark.createDataFrame(rows, "model string, actual double, prediction double, n bigint")
    got = {r.model: r for r in met.forecast_metrics(x, ["model"], "n").collect()}
    want = {r.model: r for r in met.forecast_metrics(x.withColumn("_", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))), ["model"]).collect()}
    for m, r in want.items():
        for c in met.METRICS:
            assert getattr(got[m], c) == pytest.approx(getattr(r, c), abs=1e-9) if getattr(r, c) is not None else getattr(got[m], c) is None
    assert want["flat"].pearson_ic is None



"""Medians by radix search, linear fits against their optimality conditions, selection and refit."""

import datetime as dt

import math

import numpy as np
import pytest

from meridian.operators import models as mod
from meridian.plans.model_queries import select_and_refit
from meridian.sources.workspace import written

ROWS = "event_key string, y double, x array<double>, roles array<int>"


def sample(seed=0, n=400, features=5):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, features))
    x[:, 1] = np.round(x[:, 1])  # ties
    x[rng.random((n, features)) < 0.2] = np.nan
    x[:, 3] = np.nan  # never there
    x[:, 4] = 2.5  # does not vary
    y = np.nan_to_num(x[:, 0]) - 0.5 * np.isnan(x[:, 1]) + 0.1 * rng.normal(size=n)
    roles = np.stack([np.where(np.arange(n) < 250, 1, 2), np.where(np.arange(n) % 3 == 0, 2, np.where(np.arange(n) % 3 == 1, 1, 0))], axis=1)
    return x, y, roles


def frame(spark, x, y, roles, gone=None):
    rows = [(f"e{k}", float(b), [gone if np.isnan(v) else float(v) for v in a], [int(r) for r in c]) for k, (a, b, c) in enumerate(zip(x, y, roles))]
    return written(spark.createDataFrame(rows, ROWS).repartition(5), "test-rows")


def test_integers_keep_the_order_of_doubles():
    x = np.sort(np.array([-np.inf, -1e300, -1.5, -1e-310, 0.0, 5e-324, 1.0, 1.0000000000000002, 1e300, np.inf]))
    u = mod.ordered(x)
    assert (np.diff(u.astype(object)) > 0).all() and (mod.unordered(u) == x).all() and mod.ordered(np.array([-0.0]))[0] == mod.ordered(np.array([0.0]))[0]


@pytest.mark.parametrize("gone", [None, float("nan")])
def test_medians_of_all_fits_and_features(spark, gone):
    x, y, roles = sample()
    medians, missing = mod.exact_medians(frame(spark, x, y, roles, gone), 2, 5)
    for k in range(2):
        train = x[roles[:, k] == 1]
        for f in range(5):
            some = train[~np.isnan(train[:, f]), f]
            assert missing[k, f] == len(train) - len(some)
            assert medians[k, f] == np.median(some) if len(some) else np.isnan(medians[k, f])


def by_hand(x, train):
    """Standardised inputs as the description says."""
    gone = np.isnan(x)
    medians = np.array([np.median(c[~np.isnan(c)]) if (~np.isnan(c)).any() else 0.0 for c in x[train].T])
    full = np.concatenate([np.where(gone, medians, x), gone], axis=1)
    mean, std = full[train].mean(axis=0), full[train].std(axis=0)
    return (full - mean) / np.where(std > 1e-12, std, 1.0)


def test_linear_fits_meet_their_optimality_conditions(spark):
    x, y, roles = sample(1)
    rows = frame(spark, x, y, roles)
    inputs = mod.learn_inputs(rows, 2, 5)
    moments = mod.normal_equations(rows, inputs)
    models = []
    for k, m in enumerate(moments):
        train = roles[:, k] == 1
        z, mean, n = by_hand(x, train)[train], y[train].mean(), train.sum()
        assert m.n == n and m.mean == pytest.approx(mean)
        for alpha in (1.0, 100.0):
            w = mod.ridge(m, alpha)
            assert np.abs(-2 * z.T @ (y[train] - mean - z @ w) + 2 * alpha * w).max() < 1e-8
            models.append((k, f"ridge-{alpha:g}", w, m.mean))
        for alpha, share in ((0.001, 0.1), (0.05, 0.5), (10.0, 1.0)):
            w = mod.elastic_net(m, alpha, share)
            slope = -z.T @ (y[train] - mean - z @ w) / n + alpha * (1 - share) * w
            assert np.abs(slope[w != 0] + alpha * share * np.sign(w[w != 0])).max(initial=0) < 1e-8
            assert (np.abs(slope[w == 0]) <= alpha * share + 1e-8).all()
            models.append((k, f"net-{alpha:g}", w, m.mean))
        assert not mod.elastic_net(m, 10.0, 1.0).any()
    got = {(r.fit, r.model, r.event_key): r.prediction for r in mod.linear_predictions(rows, inputs, models).collect()}
    want = {(k, name, f"e{i}"): p for k, name, w, mean in models for i, p in enumerate(by_hand(x, roles[:, k] == 1) @ w + mean) if roles[i, k] == 2}
    assert got.keys() == want.keys() and all(got[key] == pytest.approx(want[key], abs=1e-8) for key in want)


def test_no_rows_and_rows_of_no_fit(spark):
    x, y, _ = sample()
    for rows in (frame(spark, x[:0], y[:0], np.zeros((0, 2))), frame(spark, x[:9], y[:9], np.zeros((9, 2)))):
        inputs = mod.learn_inputs(rows, 2, 5)
        moments = mod.normal_equations(rows, inputs)
        assert not inputs.medians.any() and (inputs.scales == 1).all() and [m.n for m in moments] == [0, 0]
        assert not mod.ridge(moments[0], 1.0).any() and not mod.elastic_net(moments[0], 0.1, 0.5).any()
        assert mod.linear_predictions(rows, inputs, [(0, "none", np.zeros(10), 0.0)]).count() == 0


def test_choice_refit_and_one_test_evaluation(spark):
    x, y, _ = sample(2, 300)
    day = lambda k: dt.date(1997, 1, 1) + dt.timedelta(days=int(k))
    rows = [(f"e{k}", float(b), [None if np.isnan(v) else float(v) for v in a], day(4 * k), day(4 * k + 30)) for k, (a, b) in enumerate(zip(x, y))]
    kind = "event_key string, y double, x array<double>, anchor_trading_date date, target_trading_date date"
    got = {(r.split, r.model): r for r in select_and_refit(written(spark.createDataFrame(rows, kind), "test-rows"), features=5).collect()}
    anchors, targets = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
    v, e = dt.date(1998, 1, 1), dt.date(1999, 1, 1)
    train, valid, late = (anchors < v) & (targets < v), (anchors >= v) & (anchors < e) & (targets < e), anchors >= e

    def errors(fit, on, alpha):
        z = by_hand(x, fit)
        w = np.linalg.solve(z[fit].T @ z[fit] + alpha * np.eye(10), z[fit].T @ (y[fit] - y[fit].mean()))
        return np.abs(y[on] - y[fit].mean() - z[on] @ w).mean()

    by_alpha = {a: errors(train, valid, a) for a in (1.0, 10.0, 100.0)}
    for a, mae in by_alpha.items():
        row = got["validation", f"ridge-{a:g}"]
        assert row.rows == valid.sum() and row.mae == pytest.approx(mae)
    assert got["test", "mean"].mae == pytest.approx(np.abs(y[late] - y[train | valid].mean()).mean())
    picked = [m for s, m in got if s == "test" and m not in ("zero", "mean")]
    assert len(picked) == 2 and all(got["test", m].chosen and got["validation", m].chosen for m in picked)
    best = min((r for (s, m), r in got.items() if s == "validation" and m.startswith(("ridge", "elastic"))), key=lambda r: (r.mae, r.rmse)).model
    assert best in picked and sum(r.chosen for (s, _), r in got.items() if s == "validation") == 2
    if best.startswith("ridge"):
        assert got["test", best].mae == pytest.approx(errors(train | valid, late, float(best[6:])))
    tree = next(m for m in picked if m.startswith("boosted"))
    assert got["test", tree].rounds == got["validation", tree].rounds <= 20 and got["test", tree].rows == late.sum()


def test_correlations_of_columns_that_do_not_vary(spark):
    from meridian.plans.model_queries import correlations

    x = spark.createDataFrame([(1.0, 1.0, None, 1.0, 0.5), (1.0, 2.0, None, float("inf"), 0.75), (1.0, 3.0, None, 2.0, 0.5)], "flat double, up double, gone double, wild double, y double")
    got = {r.feature: r.correlation for r in correlations(x, ["flat", "up", "gone", "wild"], "y").collect()}
    assert math.isnan(got["flat"]) and got["up"] == 0.0 and got["gone"] is None and math.isnan(got["wild"])

"""Features, splits, preprocessing, model metrics, portfolios and the prospective ledger."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.numeric import r, ratio, rounded
from meridian.operators import features as feat
from meridian.operators import metrics as met
from meridian.operators import models as mod
from meridian.operators import portfolio as port
from meridian.operators import trees
from meridian.operators.indicators import MARKET
from meridian.operators.splits import FOLDS, fold_of, purged_split, with_folds
from meridian.plans.aggregate_queries import labels_of
from meridian.plans.registry import oracle_view, query
from meridian.plans.source_queries import items_of
from meridian.sources.workspace import few, written

EVENT_SQL = """CAST(event_source = 'earnings_call' AS INT) AS is_earnings_call, CAST(event_source = 'sec_filing' AS INT) AS is_sec_filing, CAST(coalesce(upper(form_type) = '10-K', FALSE) AS INT) AS is_10k, CAST(coalesce(upper(form_type) = '10-Q', FALSE) AS INT) AS is_10q,
  TRY_CAST(nullif(regexp_extract(fiscal_period, 'Q([1-4])', 1), '') AS INT) AS fiscal_quarter, sin(month(event_date) * (2 * pi() / 12)) AS event_month_sin, cos(month(event_date) * (2 * pi() / 12)) AS event_month_cos,
  CAST(event_date - lag(event_date) OVER (PARTITION BY ticker ORDER BY event_date, event_source, event_id) AS INT) AS days_since_prior_company_event,
  CAST(event_date - lag(event_date) OVER (PARTITION BY ticker, event_source ORDER BY event_date, event_source, event_id) AS INT) AS days_since_prior_source_event"""
oracle_view("calendar_features", f"SELECT event_key, {EVENT_SQL} FROM corp_events")
oracle_view(
    "features",
    f"""SELECT l.event_key, l.ticker, l.event_source, l.event_id, l.event_date, l.anchor_trading_date, l.target_trading_date, l.target_available, l.target_error, l.excess_return,
  {', '.join(f'p.{c}' for c in MARKET)}, {', '.join(f'c.{x}' for x in feat.EVENT)}, {', '.join(f's.{x}' for x in feat.SENTIMENT[:8])}, s.management_sentiment_score - s.analyst_sentiment_score AS management_analyst_gap,
  s.sentiment_score - lag(s.sentiment_score) OVER (PARTITION BY l.ticker, l.event_source ORDER BY l.event_date, l.event_source, l.event_id) AS sentiment_change_from_prior,
  {', '.join(f'e.{x}' for x in feat.EPS)}, e.earnings_date AS earnings_result_date, {', '.join(f'f.{x}' for x in feat.TOPIC)}
  FROM labels30 l LEFT JOIN panel p ON p.ticker = l.ticker AND p.trading_date = l.anchor_trading_date LEFT JOIN calendar_features c ON c.event_key = l.event_key
  LEFT JOIN event_sentiment s ON s.event_key = l.event_key LEFT JOIN eps_match e ON e.event_key = l.event_key LEFT JOIN topic_features f ON f.event_key = l.event_key""",
)


def features_of(t, names=None) -> DataFrame:
    """All features, or those that `names` need."""
    t.stored("bars_daily", "eps_results")
    return feat.feature_dataset(t.corp_events, t.bars_daily, t.eps_results, items_of(t), names=names)


ALL = feat.allowed()
INTS = {"is_earnings_call", "is_sec_filing", "is_10k", "is_10q", "fiscal_quarter", "days_since_prior_company_event", "days_since_prior_source_event", "sentiment_scored_items", "sentiment_token_count"}


def cell(c: str) -> str:
    return c if c in INTS else f"{r(c, 5)} AS {c}"


def cells(names) -> list:
    return [F.col(c) if c in INTS else rounded(c, 5).alias(c) for c in names]


@query("C4", f"SELECT event_key, anchor_trading_date, target_available, {r('excess_return', 5)} AS excess_return, {', '.join(cell(c) for c in ALL)} FROM features")
def c4(t):
    return features_of(t).select("event_key", "anchor_trading_date", "target_available", rounded("excess_return", 5).alias("excess_return"), *cells(ALL))


@query("P8", f"SELECT event_key, {', '.join(cell(c) for c in feat.allowed(False))} FROM features")
def p8(t):
    return features_of(t, feat.allowed(False)).select("event_key", *cells(feat.allowed(False)))


@query("F8", "SELECT event_key, is_earnings_call, is_sec_filing, is_10k, is_10q, fiscal_quarter, " + f"{r('event_month_sin')} AS event_month_sin, {r('event_month_cos')} AS event_month_cos FROM calendar_features")
def f8(t):
    return feat.calendar_features(t.corp_events).select("event_key", *feat.EVENT[:5], *(rounded(c).alias(c) for c in feat.EVENT[5:7]))


@query("W13", f"SELECT event_key, {r('sentiment_score', 5)} AS sentiment_score, {r('sentiment_change_from_prior', 5)} AS sentiment_change_from_prior FROM features")
def w13(t):
    x = t.corp_events.join(feat.event_sentiment(items_of(t)).select("event_key", "sentiment_score"), "event_key", "left")
    x = feat.event_prior(x, "sentiment_score")
    return x.select("event_key", rounded("sentiment_score", 5).alias("sentiment_score"), rounded(F.col("sentiment_score") - F.col("sentiment_score_prior"), 5).alias("sentiment_change_from_prior"))


@query(
    "C5",
    """SELECT count(*) - count(DISTINCT event_key) AS duplicate_keys, count(*) FILTER (anchor_trading_date <= event_date) AS anchor_not_after_event, count(*) FILTER (earnings_result_date > anchor_trading_date) AS result_after_anchor,
  count(*) FILTER (event_source <> 'earnings_call' AND earnings_result_date IS NOT NULL) AS result_on_filing, CAST(0 AS BIGINT) AS infinite_values FROM features""",
)
def c5(t):
    x = features_of(t)
    doubles = [c for c in ALL if c not in INTS]
    infinite = F.greatest(*(F.abs(F.col(c).cast("double")) for c in doubles)) >= float("inf")  # NaN is the greatest
    return x.agg(
        (F.count(F.lit(1)) - F.countDistinct("event_key")).alias("duplicate_keys"), F.count_if(F.col("anchor_trading_date") <= F.col("event_date")).alias("anchor_not_after_event"),
        F.count_if(F.col("earnings_result_date") > F.col("anchor_trading_date")).alias("result_after_anchor"), F.count_if((F.col("event_source") != "earnings_call") & F.col("earnings_result_date").isNotNull()).alias("result_on_filing"),
        F.count_if(infinite).alias("infinite_values"),
    )


SCAN = [*MARKET, *feat.EPS, *feat.SENTIMENT]


@query("A23", " UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'corr({c}, excess_return)', 4)} AS correlation FROM features WHERE target_available AND isfinite({c})" for c in SCAN))
def a23(t):
    x = features_of(t, SCAN).where("target_available")
    return correlations(x, SCAN, "excess_return")


def correlations(x: DataFrame, names, label: str) -> DataFrame:
    """Correlation of each column with the label over the rows where it is finite: null without rows, NaN where either does not vary."""
    y, out = F.col(label), []
    for c in names:
        v = F.col(c).cast("double")
        ok = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        v, w = F.when(ok, v), F.when(ok, y)
        flat = (F.min(v) == F.max(v)) | (F.min(F.when(v.isNotNull(), w)) == F.max(F.when(v.isNotNull(), w)))
        # F.corr itself divides by a spread of 0, an error in ANSI mode
        some = F.try_divide(F.covar_pop(v, w), F.stddev_pop(F.when(w.isNotNull(), v)) * F.stddev_pop(w))
        out.append(F.when(flat, F.lit(float("nan"))).otherwise(rounded(some, 4)).alias(c))
    return x.agg(*out).unpivot([], list(names), "feature", "correlation")


@query("A24", " UNION ALL ".join(f"SELECT '{c}' AS feature, count({c}) AS present, count(*) - count({c}) AS missing, {r(f'count({c}) / count(*)')} AS ratio FROM features WHERE target_available" for c in ALL))
def a24(t):
    return coverage(features_of(t).where("target_available"))


def coverage(x: DataFrame) -> DataFrame:
    """Present and missing values of each allowed feature, from one pass."""
    counts = x.agg(F.count(F.lit(1)).alias("_n"), *(F.count(c).alias(c) for c in ALL))
    rows = counts.unpivot(["_n"], ALL, "feature", "present")
    return rows.select("feature", "present", (F.col("_n") - F.col("present")).alias("missing"), rounded(F.col("present") / F.col("_n")).alias("ratio"))


# splits

oracle_view("fold_windows", "SELECT * FROM (VALUES " + ", ".join(f"({k}, DATE '{a}', DATE '{b}')" for k, a, b in FOLDS) + ") w(fold, a, b)")
oracle_view(
    "folded",
    """SELECT f.*, CAST(w.fold AS INT) AS fold, CASE WHEN anchor_trading_date < a AND target_trading_date < a THEN 'train' WHEN anchor_trading_date >= a AND anchor_trading_date < b AND target_trading_date < b THEN 'validation' ELSE 'purged' END AS role
  FROM features f CROSS JOIN fold_windows w WHERE target_available""",
)


def folded_of(t) -> DataFrame:
    return with_folds(features_of(t).where("target_available"), "anchor_trading_date", "target_trading_date")


@query(
    "J12",
    """SELECT event_key, CAST(w.fold AS INT) AS fold, CASE WHEN anchor_trading_date < a AND target_trading_date < a THEN 'train' WHEN anchor_trading_date >= a AND anchor_trading_date < b AND target_trading_date < b THEN 'validation' ELSE 'purged' END AS role
  FROM labels30 CROSS JOIN fold_windows w WHERE target_available""",
)
def j12(t):
    return with_folds(labels_of(t).where("target_available"), "anchor_trading_date", "target_trading_date").select("event_key", "fold", "role")


@query(
    "J13",
    f"""SELECT a.event_key, a.anchor_trading_date, b.target_trading_date, b.target_available, {r('b.excess_return')} AS excess_return_10d FROM labels30 a JOIN labels10 b ON b.event_key = a.event_key
  AND a.anchor_trading_date IS NOT DISTINCT FROM b.anchor_trading_date""",
)
def j13(t):
    return other_horizon(labels_of(t), labels_of(t, 10), 10).select("event_key", "anchor_trading_date", "target_trading_date", "target_available", rounded("excess_return_10d").alias("excess_return_10d"))


def other_horizon(base: DataFrame, labels: DataFrame, horizon: int) -> DataFrame:
    """Base rows with the labels of another horizon; keys that do not match one to one or anchors that differ drop out and are seen in the count."""
    stale = ["target_trading_date", "stock_return", "benchmark_return", "excess_return", "target_available", "target_error"]
    new = labels.select("event_key", F.col("anchor_trading_date").alias("_anchor"), "target_trading_date", "target_available", F.col("excess_return").alias(f"excess_return_{horizon}d"))
    return base.drop(*stale).join(new, "event_key").where(F.col("anchor_trading_date").eqNullSafe(F.col("_anchor"))).drop("_anchor")


@query(
    "M1",
    """SELECT event_key, CASE WHEN anchor_trading_date < DATE '1998-01-01' AND target_trading_date < DATE '1998-01-01' THEN 'train' WHEN anchor_trading_date >= DATE '1998-01-01' AND anchor_trading_date < DATE '1999-01-01' AND target_trading_date < DATE '1999-01-01' THEN 'validation'
  WHEN anchor_trading_date >= DATE '1999-01-01' THEN 'test' ELSE 'purged' END AS role FROM labels30 WHERE target_available""",
)
def m1(t):
    return purged_split(labels_of(t).where("target_available"), "1998-01-01", "1999-01-01", "anchor_trading_date", "target_trading_date").select("event_key", "role")


@query("M2", "SELECT fold, role, count(*) AS n, min(anchor_trading_date) AS first_anchor, max(target_trading_date) AS last_target FROM folded GROUP BY fold, role")
def m2(t):
    x = with_folds(labels_of(t).where("target_available"), "anchor_trading_date", "target_trading_date")
    return x.groupBy("fold", "role").agg(F.count(F.lit(1)).alias("n"), F.min("anchor_trading_date").alias("first_anchor"), F.max("target_trading_date").alias("last_target"))


@query("U3", "SELECT CAST(a.fold AS INT) AS fold_a, CAST(b.fold AS INT) AS fold_b, CAST(0 AS BIGINT) AS shared FROM fold_windows a JOIN fold_windows b ON a.fold < b.fold")
def u3(t):
    """Validation sets of two folds must share no key."""
    v = with_folds(labels_of(t).where("target_available"), "anchor_trading_date", "target_trading_date").where("role = 'validation'").select("event_key", "fold")
    by_key = v.groupBy("event_key").agg(*(F.bool_or(F.col("fold") == k).alias(f"in_{k}") for k, *_ in FOLDS))
    pairs = [(a, b) for i, (a, *_) in enumerate(FOLDS) for b, *_ in FOLDS[i + 1 :]]
    shared = by_key.agg(*(F.count_if(F.col(f"in_{a}") & F.col(f"in_{b}")).alias(f"n_{a}_{b}") for a, b in pairs))
    rows = F.array(*(F.struct(F.lit(a).alias("fold_a"), F.lit(b).alias("fold_b"), F.col(f"n_{a}_{b}").alias("shared")) for a, b in pairs))
    return shared.select(F.inline(rows))


MODEL = ("momentum_21d", "volatility_21d", "beta_63d", "volume_ratio_20d", "eps_surprise_pct", "days_since_prior_company_event")


def model_rows(t, names=ALL) -> DataFrame:
    """Labelled events for the models, written once: (event_key, y, x, roles, anchor and target dates), a role in each walk-forward fold."""
    return written(labelled(features_of(t, names), names), "model-rows")


def labelled(x: DataFrame, names, *more: str) -> DataFrame:
    """The rows of `model_rows` from a feature dataset, with `more` of its columns."""
    x = x.where("target_available")
    f, u = F.col("anchor_trading_date"), F.col("target_trading_date")
    day = lambda s: F.lit(s).cast("date")
    roles = mod.roles_of(*(((f < day(a)) & (u < day(a)), (f >= day(a)) & (f < day(b)) & (u < day(b))) for _, a, b in FOLDS))
    return x.select("event_key", F.col("excess_return").alias("y"), F.array(*(F.col(c).cast("double") for c in names)).alias("x"), roles.alias("roles"), "anchor_trading_date", "target_trading_date", *more)


def model_cases(t) -> tuple[DataFrame, DataFrame]:
    """Events (event_key and what their features follow from), and the rows of `model_rows` once for all events that agree in it, with their number.

    The event_key of such a row is a number of its own. All rows stand in about equal parts.
    """
    t.stored("bars_daily", "eps_results")
    x, dates, texts = feat.events_in_order(t.corp_events, items_of(t))
    events = feat.keyed(x, texts)
    cases = labelled(feat.with_features(feat.alike(events), dates, texts, t.bars_daily, t.eps_results), ALL, "n", *feat.ALIKE)
    cases = cases.repartition(int(t.spark.conf.get("spark.sql.shuffle.partitions")), *feat.ALIKE)
    return events, written(cases.withColumn("event_key", F.monotonically_increasing_id().cast("string")), "model-cases")


def for_events(found: DataFrame, cases: DataFrame, events: DataFrame) -> DataFrame:
    """Predictions of cases for each of their events."""
    keys = [c for c in cases.columns if c in feat.ALIKE]
    found = few(written(found.join(cases.select("event_key", *keys), "event_key").withColumnRenamed("event_key", "case"), "case-predictions"))
    same = reduce(Column.__and__, (found[c].eqNullSafe(events[c]) for c in keys))
    return events.join(found, same).select("fit", "model", events["event_key"], "actual", "prediction")


def by_fold_and_feature(t, columns: str, cells, names) -> DataFrame:
    """A frame of one row a fold and feature from arrays of that shape."""
    rows = [(k, c, *(a[i][j].item() for a in cells)) for i, (k, *_) in enumerate(FOLDS) for j, c in enumerate(names)]
    return t.spark.createDataFrame(rows, f"fold int, feature string, {columns}")


oracle_view("train_long", " UNION ALL ".join(f"SELECT fold, role, event_key, '{c}' AS feature, CAST({c} AS DOUBLE) AS x FROM folded" for c in MODEL))
oracle_view("fold_medians", "SELECT fold, feature, coalesce(quantile_cont(x, 0.5), 0) AS median, count(*) - count(x) AS missing FROM train_long WHERE role = 'train' GROUP BY fold, feature")


@query("M3", f"SELECT fold, feature, {r('median')} AS median, missing, missing > 0 AS flagged FROM fold_medians")
def m3(t):
    medians, missing = mod.exact_medians(model_rows(t, MODEL), len(FOLDS), len(MODEL))
    x = by_fold_and_feature(t, "median double, missing bigint", (np.nan_to_num(medians), missing.astype(int)), MODEL)
    return x.select("fold", "feature", rounded("median").alias("median"), "missing", (F.col("missing") > 0).alias("flagged"))


oracle_view("imputed", "SELECT l.fold, l.role, l.event_key, l.feature, coalesce(l.x, m.median) AS x FROM train_long l JOIN fold_medians m ON m.fold = l.fold AND m.feature = l.feature")
oracle_view("scales", "SELECT fold, feature, avg(x) AS mean, CASE WHEN stddev_pop(x) = 0 THEN 1 ELSE stddev_pop(x) END AS std FROM imputed WHERE role = 'train' GROUP BY fold, feature")


@query("M4", f"SELECT fold, feature, {r('mean', 5)} AS mean, {r('std', 5)} AS std FROM scales")
def m4(t):
    inputs = mod.learn_inputs(model_rows(t, MODEL), len(FOLDS), len(MODEL))
    x = by_fold_and_feature(t, "mean double, std double", (inputs.means, inputs.scales), MODEL)
    return x.select("fold", "feature", rounded("mean", 5).alias("mean"), rounded("std", 5).alias("std"))


oracle_view("train_means", "SELECT fold, avg(excess_return) AS mean FROM folded WHERE role = 'train' GROUP BY fold")
oracle_view("oof", "SELECT f.fold, m.model, f.event_key, f.event_source, f.excess_return AS actual, CASE WHEN m.model = 'zero' THEN 0.0::DOUBLE ELSE t.mean END AS prediction FROM folded f JOIN train_means t ON t.fold = f.fold CROSS JOIN (VALUES ('zero'), ('mean')) m(model) WHERE f.role = 'validation'")


def baselines(x: DataFrame) -> DataFrame:
    """Out-of-fold predictions of the zero and the historical-mean model for every validation row."""
    means = F.broadcast(x.where("role = 'train'").groupBy("fold").agg(F.avg("excess_return").alias("mean")))
    v = x.where("role = 'validation'").join(means, "fold")
    models = F.explode(F.array(F.struct(F.lit("zero").alias("model"), F.lit(0.0).alias("prediction")), F.struct(F.lit("mean").alias("model"), F.col("mean").alias("prediction")))).alias("m")
    return v.select("fold", "event_key", "event_source", F.col("excess_return").alias("actual"), models).select("fold", "m.model", "event_key", "event_source", "actual", "m.prediction")


def label_folds(t) -> DataFrame:
    return with_folds(labels_of(t).where("target_available"), "anchor_trading_date", "target_trading_date")


@query("M5", f"SELECT fold, model, event_key, {r('prediction')} AS prediction FROM oof")
def m5(t):
    return baselines(label_folds(t)).select("fold", "model", "event_key", rounded("prediction").alias("prediction"))


@query("M9", f"SELECT fold, model, event_key, {r('prediction')} AS prediction, {r('actual - prediction')} AS residual, (actual > 0) = (prediction > 0) AS direction_correct FROM oof")
def m9(t):
    x = baselines(label_folds(t))
    return x.select("fold", "model", "event_key", rounded("prediction").alias("prediction"), rounded(F.col("actual") - F.col("prediction")).alias("residual"), ((F.col("actual") > 0) == (F.col("prediction") > 0)).alias("direction_correct"))


# fits


def walk_forward(found: DataFrame) -> DataFrame:
    """Predictions by fold number."""
    fold = F.element_at(F.array(*(F.lit(k) for k, *_ in FOLDS)), F.col("fit") + 1)
    return found.select(fold.alias("fold"), "model", "event_key", F.col("actual").alias("label"), "prediction")


RIDGE, NETS = (1.0, 10.0, 100.0), ((0.001, 0.1), (0.01, 0.5))


def linear_models(moments: list, fits) -> list[tuple]:
    """The linear candidates of every fit, with the two baselines."""
    out = []
    for k in fits:
        m = moments[k]
        none = np.zeros(len(m.covered))
        out += [(k, "zero", none, 0.0), (k, "mean", none, m.mean)]
        out += [(k, f"ridge-{a:g}", mod.ridge(m, a), m.mean) for a in RIDGE]
        out += [(k, f"elastic-net-{a:g}-{s:g}", mod.elastic_net(m, a, s), m.mean) for a, s in NETS]
    return out


@query("M6")
def m6(t):
    """Ridge and elastic net on all model features and missing flags: a fit a fold, predictions for its validation rows."""
    rows = model_rows(t)
    inputs = mod.learn_inputs(rows, len(FOLDS), len(ALL))
    return walk_forward(mod.linear_predictions(rows, inputs, linear_models(mod.normal_equations(rows, inputs), range(len(FOLDS)))))


@query("M7")
def m7(t):
    """Boosted trees (stopped early by the fold's validation rows) and a forest, a fit a fold."""
    events, cases = model_cases(t)
    return walk_forward(for_events(fold_trees(cases, len(FOLDS)), cases, events))


def fold_trees(rows: DataFrame, fits: int, features: int = len(ALL)) -> DataFrame:
    """Predictions of boosted trees and a forest for the held rows of every fit that has training and held rows."""
    fits_of = mod.with_both(rows, fits)
    codes = trees.learn_codes(rows, fits, features)
    boosted, forests = [trees.Boosted(k, 20, 2, 0.1, True) for k in fits_of], [trees.forest(k, 20, 4) for k in fits_of]
    if fits_of:
        blocks = trees.blocks_of(rows, codes, fits)
        trees.boost(blocks, codes, boosted)
        trees.grow(blocks, codes, forests)
    return trees.tree_predictions(rows, codes, [*(("boosted", m) for m in boosted), *(("forest", m) for m in forests)])


VALIDATION, TEST = "1998-01-01", "1999-01-01"
TREES = ((20, 2, 0.1), (20, 3, 0.1))


@query("M8")
def m8(t):
    """Candidates scored on validation rows, the best by (MAE, RMSE, order) fitted again on train and validation, and scored once on test rows."""
    return select_and_refit(model_cases(t)[1])


def select_and_refit(rows: DataFrame, validation: str = VALIDATION, test: str = TEST, features: int = len(ALL)) -> DataFrame:
    """Metrics (split, model, rounds, chosen, METRICS) of all candidates on validation and of the chosen ones and baselines on test.

    Linear and boosted candidates are chosen apart. Labels that cross a border are in no part.
    Boosted candidates stop early on the validation rows; the refit takes as many rounds.
    """
    spark, day = rows.sparkSession, lambda s: F.lit(s).cast("date")
    f, u, v, e = F.col("anchor_trading_date"), F.col("target_trading_date"), day(validation), day(test)
    train, valid, late = (f < v) & (u < v), (f >= v) & (f < e) & (u < e), f >= e
    rows = written(rows.withColumn("roles", mod.roles_of((train, valid), (train | valid, late))), "split-rows")
    inputs = mod.learn_inputs(rows, 2, features)
    moments = mod.normal_equations(rows, inputs)
    linear = linear_models(moments, (0, 1))
    found, boosted, fits_of = [mod.linear_predictions(rows, inputs, [m for m in linear if m[0] == 0])], {}, mod.with_both(rows, 2)
    if 0 in fits_of:
        codes = trees.learn_codes(rows, 2, features)
        blocks = trees.blocks_of(rows, codes, 2)
        boosted = {f"boosted-{n}": trees.Boosted(0, rounds, depth, step, True) for n, (rounds, depth, step) in enumerate(TREES, 1)}
        trees.boost(blocks, codes, [*boosted.values()])
        found.append(trees.tree_predictions(rows, codes, [*boosted.items()]))
    names = ["split", "model"]
    scored = written(met.forecast_metrics(mod.union_of(found).withColumn("split", F.lit("validation")), names, "n"), "validation-metrics")
    order = {m[1]: k for k, m in enumerate(x for x in linear if x[0] == 0)} | {c: k for k, c in enumerate(boosted)}
    ranked = sorted(scored.select("model", "mae", "rmse").collect(), key=lambda c: (c.mae, c.rmse, order[c.model]))  # one row a candidate
    best = [next((c.model for c in ranked if c.model.startswith(kind)), None) for kind in (("ridge", "elastic"), "boosted")]
    chosen = [b for b in best if b]
    found = [mod.linear_predictions(rows, inputs, [m for m in linear if m[0] == 1 and m[1] in ("zero", "mean", *chosen)])]
    if best[1] and 1 in fits_of:
        m = boosted[best[1]]
        again = trees.Boosted(1, len(m.trees), m.depth, m.step, False)
        trees.boost(blocks, codes, [again])
        found.append(trees.tree_predictions(rows, codes, [(best[1], again)]))
    tested = met.forecast_metrics(mod.union_of(found).withColumn("split", F.lit("test")), names, "n")
    counts = spark.createDataFrame([(k, len(m.trees)) for k, m in boosted.items()], "model string, rounds int")
    return scored.unionByName(tested).join(F.broadcast(counts), "model", "left").withColumn("chosen", F.col("model").isin(chosen))


# metrics


def ranks_sql(source: str, keys: str) -> str:
    part = f"PARTITION BY {keys}" if keys else ""
    more = f"{keys}, " if keys else ""
    return f"SELECT *, rank() OVER ({part} ORDER BY actual) + (count(*) OVER (PARTITION BY {more}actual) - 1) / 2 AS ra, rank() OVER ({part} ORDER BY prediction) + (count(*) OVER (PARTITION BY {more}prediction) - 1) / 2 AS rp FROM {source} WHERE actual IS NOT NULL AND prediction IS NOT NULL"


def metrics_sql(source: str, keys: str) -> str:
    return f"""SELECT {keys}, count(*) AS rows, avg(abs(actual - prediction)) AS mae, sqrt(avg((actual - prediction) * (actual - prediction))) AS rmse,
  1 - sum((actual - prediction) * (actual - prediction)) / nullif(sum(actual * actual) - sum(actual) * sum(actual) / count(*), 0) AS r2, avg(CASE WHEN (actual > 0) = (prediction > 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS directional_accuracy,
  CASE WHEN stddev_pop(prediction) > 1e-12 THEN corr(actual, prediction) END AS pearson_ic, CASE WHEN stddev_pop(prediction) > 1e-12 THEN corr(ra, rp) END AS spearman_ic, avg(prediction) AS prediction_mean, stddev_pop(prediction) AS prediction_std, avg(actual) AS actual_mean
  FROM ({ranks_sql(source, keys)}) GROUP BY {keys}"""


ROUNDED = ", ".join(f"{r(c, 5)} AS {c}" for c in met.METRICS[1:])
oracle_view("sliced", "SELECT 'overall' AS slice, actual, prediction FROM predictions UNION ALL SELECT 'source:' || event_source, actual, prediction FROM predictions UNION ALL SELECT 'ticker:' || ticker, actual, prediction FROM predictions")


@query("A17", f"SELECT slice, rows, {ROUNDED} FROM ({metrics_sql(chr(40) + 'SELECT * FROM sliced WHERE slice NOT LIKE ' + repr('ticker:%') + chr(41), 'slice')})")
def a17(t):
    x = slices(t.predictions).where("slice NOT LIKE 'ticker:%'")
    return met.rounded_metrics(met.forecast_metrics(x, ["slice"]), ["slice"])


def slices(rows: DataFrame) -> DataFrame:
    """Each row under overall, its source and its ticker."""
    name = F.explode(F.array(F.lit("overall"), F.concat(F.lit("source:"), "event_source"), F.concat(F.lit("ticker:"), "ticker"))).alias("slice")
    return rows.select(name, "actual", "prediction")


@query("A19", f"SELECT slice, rows, {r('mae', 5)} AS mae, {r('rmse', 5)} AS rmse, {r('directional_accuracy', 5)} AS directional_accuracy, {r('prediction_mean - actual_mean', 5)} AS bias FROM ({metrics_sql('sliced', 'slice')})")
def a19(t):
    x = met.forecast_metrics(slices(t.predictions), ["slice"]).withColumn("bias", F.col("prediction_mean") - F.col("actual_mean"))
    return met.rounded_metrics(x, ["slice"], ("mae", "rmse", "directional_accuracy", "bias"))


oracle_view(
    "arms",
    "SELECT w.fold::INT AS fold, m.model, p.event_key, p.event_source, p.actual, CASE m.model WHEN 'signal' THEN p.prediction WHEN 'inverse' THEN -p.prediction ELSE 0.0 END AS prediction FROM predictions p JOIN fold_windows w ON p.feature_as_of_date >= w.a AND p.feature_as_of_date < w.b CROSS JOIN (VALUES ('signal'), ('inverse'), ('zero')) m(model) WHERE p.actual IS NOT NULL",
)


def arms(t) -> DataFrame:
    """Three deterministic models over the folds: the signal, its inverse and zero."""
    t.stored("predictions")
    x = fold_of(t.predictions.where("actual IS NOT NULL"), "feature_as_of_date").where("fold IS NOT NULL")
    m = F.array(*(F.struct(F.lit(n).alias("model"), c.alias("prediction")) for n, c in (("signal", F.col("prediction")), ("inverse", -F.col("prediction")), ("zero", F.lit(0.0)))))
    return x.select("fold", "event_key", "event_source", "actual", F.explode(m).alias("m")).select("fold", "m.model", "event_key", "event_source", "actual", "m.prediction")


SUMMARY = ("mean_mae", "std_mae", "worst_mae", "mean_rmse", "mean_accuracy", "mean_ic", "pooled_mae", "pooled_ic")
oracle_view("by_fold", metrics_sql("arms", "fold, model"))
oracle_view("pooled", metrics_sql("arms", "model"))
oracle_view(
    "candidates",
    f"""SELECT *, CAST(row_number() OVER (ORDER BY {r('mean_mae', 9)}, {r('std_mae', 9)}, {r('pooled_mae', 9)}, model) AS INT) AS rank FROM (SELECT f.model, count(*) AS folds, avg(f.mae) AS mean_mae, stddev_pop(f.mae) AS std_mae, max(f.mae) AS worst_mae, avg(f.rmse) AS mean_rmse, avg(f.directional_accuracy) AS mean_accuracy, avg(f.spearman_ic) AS mean_ic,
    max(p.mae) AS pooled_mae, max(p.spearman_ic) AS pooled_ic FROM by_fold f JOIN pooled p ON p.model = f.model GROUP BY f.model)""",
)


def candidates(t) -> DataFrame:
    x = arms(t)
    return met.candidate_summary(met.forecast_metrics(x, ["fold", "model"]), met.forecast_metrics(x, ["model"]))


@query("A18", f"SELECT model, folds, {', '.join(f'{r(c, 5)} AS {c}' for c in SUMMARY)}, rank FROM candidates")
def a18(t):
    return candidates(t).select("model", "folds", *(rounded(c, 5).alias(c) for c in SUMMARY), "rank")


@query(
    "M10",
    """WITH wins AS (SELECT a.model, count(*) FILTER (a.mae < z.mae) AS won, count(*) AS folds FROM by_fold a JOIN by_fold z ON z.fold = a.fold AND z.model = 'zero' WHERE a.model <> 'zero' GROUP BY a.model)
  SELECT c.model, c.rank, w.won, c.mean_mae < z.mean_mae AS beats_mean, 2 * w.won > w.folds AS majority, coalesce(c.pooled_ic > 0, FALSE) AS positive_ic, c.mean_mae < z.mean_mae AND 2 * w.won > w.folds AND coalesce(c.pooled_ic > 0, FALSE) AS holdout_candidate
  FROM candidates c JOIN wins w ON w.model = c.model, (SELECT mean_mae FROM candidates WHERE model = 'zero') z""",
)
def m10(t):
    x = arms(t)
    by_fold = met.forecast_metrics(x, ["fold", "model"])
    base = F.broadcast(by_fold.where("model = 'zero'").select("fold", F.col("mae").alias("base")))
    wins = by_fold.where("model <> 'zero'").join(base, "fold").groupBy("model").agg(F.count_if(F.col("mae") < F.col("base")).alias("won"), F.count(F.lit(1)).alias("n"))
    summary = met.candidate_summary(by_fold, met.forecast_metrics(x, ["model"]))
    zero = F.broadcast(summary.where("model = 'zero'").select(F.col("mean_mae").alias("zero_mae")))
    beats, majority, ic = F.col("mean_mae") < F.col("zero_mae"), 2 * F.col("won") > F.col("n"), F.coalesce(F.col("pooled_ic") > 0, F.lit(False))
    return summary.join(wins, "model").join(zero).select("model", "rank", "won", beats.alias("beats_mean"), majority.alias("majority"), ic.alias("positive_ic"), (beats & majority & ic).alias("holdout_candidate"))


HORIZONS = (5, 10, 20, 30, 60)


def horizon_sql(h: int) -> str:
    from meridian.plans.oracle_views import labels_sql

    return f"SELECT CAST({h} AS INT) AS horizon, event_date, excess_return FROM ({labels_sql(h)}) WHERE target_available"


@query(
    "M11",
    f"""WITH x AS ({' UNION ALL '.join(horizon_sql(h) for h in HORIZONS)}), m AS (SELECT horizon, avg(excess_return) AS mean FROM x WHERE event_date < DATE '1998-01-01' GROUP BY horizon)
  SELECT x.horizon, count(*) AS rows, {r('avg(abs(excess_return))', 5)} AS mae_zero, {r('avg(abs(excess_return - m.mean))', 5)} AS mae_mean, {r('1 - avg(abs(excess_return - m.mean)) / avg(abs(excess_return))', 4)} AS gain
  FROM x JOIN m ON m.horizon = x.horizon WHERE event_date >= DATE '1998-01-01' GROUP BY x.horizon""",
)
def m11(t):
    """Label noise and the gain of the historical mean by horizon."""
    x = reduce(DataFrame.unionByName, [labels_of(t, h).where("target_available").select(F.lit(h).alias("horizon"), "event_date", "excess_return") for h in HORIZONS])
    mean = F.broadcast(x.where("event_date < DATE '1998-01-01'").groupBy("horizon").agg(F.avg("excess_return").alias("mean")))
    y = x.where("event_date >= DATE '1998-01-01'").join(mean, "horizon")
    zero, hist = F.avg(F.abs("excess_return")), F.avg(F.abs(F.col("excess_return") - F.col("mean")))
    return y.groupBy("horizon").agg(F.count(F.lit(1)).alias("rows"), rounded(zero, 5).alias("mae_zero"), rounded(hist, 5).alias("mae_mean"), rounded(1 - F.try_divide(hist, zero), 4).alias("gain"))


# portfolio

oracle_view("cal", "SELECT trading_date, row_number() OVER (ORDER BY trading_date) AS i FROM (SELECT DISTINCT trading_date FROM bars_weekly)")
oracle_view(
    "traded",
    "SELECT trading_date, next_date, next_return AS spy_return, row_number() OVER (ORDER BY trading_date) AS day FROM next_returns WHERE ticker = 'SPY' AND next_return IS NOT NULL AND trading_date BETWEEN (SELECT min(feature_as_of_date) FROM predictions) AND (SELECT max(target_trading_date) FROM predictions)",
)
oracle_view(
    "weights",
    """SELECT day, trading_date, ticker, event_key, prediction, position, CASE position WHEN 'long' THEN 0.5 ELSE -0.5 END / n AS long_short_weight, CASE position WHEN 'long' THEN 1.0 / n ELSE 0.0 END::DOUBLE AS long_only_weight FROM (
    SELECT *, CASE WHEN rk > m - n THEN 'long' WHEN rk <= n THEN 'short' END AS position FROM (
      SELECT *, least(2, m // 2) AS n FROM (SELECT *, count(*) OVER (PARTITION BY day) AS m, row_number() OVER (PARTITION BY day ORDER BY prediction, ticker) AS rk FROM (
        SELECT d.day, d.trading_date, p.ticker, p.event_key, p.prediction, count(*) OVER (PARTITION BY d.day) AS a, row_number() OVER (PARTITION BY d.day, p.ticker ORDER BY p.feature_as_of_date DESC, p.event_key DESC) AS k
        FROM traded d JOIN predictions p ON p.feature_as_of_date <= d.trading_date AND p.target_trading_date > d.trading_date) WHERE a >= 4 AND k = 1) WHERE m >= 4)) WHERE position IS NOT NULL""",
)
oracle_view(
    "moved",
    """SELECT d.day, d.trading_date, coalesce(sum(abs(coalesce(a.long_short_weight, 0) - coalesce(b.long_short_weight, 0))), 0) AS long_short_turnover, coalesce(sum(abs(coalesce(a.long_only_weight, 0) - coalesce(b.long_only_weight, 0))), 0) AS long_only_turnover
  FROM traded d LEFT JOIN (SELECT DISTINCT day, ticker FROM weights UNION SELECT DISTINCT day + 1, ticker FROM weights) k ON k.day = d.day LEFT JOIN weights a ON a.day = k.day AND a.ticker = k.ticker LEFT JOIN weights b ON b.day = k.day - 1 AND b.ticker = k.ticker GROUP BY d.day, d.trading_date""",
)
oracle_view(
    "daily",
    """SELECT d.day, d.trading_date, d.next_date, d.spy_return, m.long_short_turnover, m.long_only_turnover, coalesce(g.lp, 0) AS long_positions, coalesce(g.sp, 0) AS short_positions, coalesce(g.miss, 0) AS missing_returns,
  coalesce(g.ls, 0) AS long_short_gross, coalesce(g.lo, 0) AS long_only_gross, coalesce(g.ls, 0) - m.long_short_turnover * 0.001 AS long_short_net, coalesce(g.lo, 0) - m.long_only_turnover * 0.001 AS long_only_net
  FROM traded d JOIN moved m ON m.day = d.day LEFT JOIN (SELECT w.day, count(*) FILTER (position = 'long') AS lp, count(*) FILTER (position = 'short') AS sp, count(*) FILTER (n.next_return IS NULL) AS miss, sum(long_short_weight * n.next_return) AS ls, sum(long_only_weight * n.next_return) AS lo
    FROM weights w LEFT JOIN next_returns n ON n.ticker = w.ticker AND n.trading_date = w.trading_date GROUP BY w.day) g ON g.day = d.day""",
)


@query("M12", f"SELECT trading_date, ticker, event_key, {r('prediction')} AS prediction, position, {r('long_short_weight')} AS long_short_weight, {r('long_only_weight')} AS long_only_weight FROM weights")
def m12(t):
    t.stored("bars_weekly", "predictions")
    x = port.signal_weights(t.predictions, t.bars_weekly)
    return x.select("trading_date", "ticker", "event_key", rounded("prediction").alias("prediction"), "position", rounded("long_short_weight").alias("long_short_weight"), rounded("long_only_weight").alias("long_only_weight"))


@query("M13", f"SELECT trading_date, {r('long_short_turnover')} AS long_short_turnover, {r('long_only_turnover')} AS long_only_turnover FROM moved")
def m13(t):
    t.stored("bars_weekly", "predictions")
    days = written(port.traded_days(t.predictions, t.bars_weekly), "traded-days")
    x = port.turnover(written(port.signal_weights(t.predictions, t.bars_weekly, traded=days), "weights"), days)
    return x.select("trading_date", rounded("long_short_turnover").alias("long_short_turnover"), rounded("long_only_turnover").alias("long_only_turnover"))


def daily_of(t) -> DataFrame:
    """Daily returns of the signal portfolio, from bars and predictions written once; written itself, one row a session."""
    t.stored("bars_weekly", "predictions")
    return written(port.daily_returns(t.predictions, t.bars_weekly), "daily-returns")


DAILY = ("spy_return", "long_short_turnover", "long_only_turnover", "long_short_gross", "long_only_gross", "long_short_net", "long_only_net")


@query("M14", f"SELECT trading_date, next_date, long_positions, short_positions, missing_returns, {', '.join(f'{r(c)} AS {c}' for c in DAILY)} FROM daily")
def m14(t):
    x = daily_of(t)
    return x.select("trading_date", "next_date", "long_positions", "short_positions", "missing_returns", *(rounded(c).alias(c) for c in DAILY))


oracle_view("arms_daily", " UNION ALL ".join(f"SELECT '{p}_{k}' AS strategy, trading_date, {p}_{k} AS ret, {p}_turnover AS turnover FROM daily" for p in ("long_short", "long_only") for k in ("gross", "net")) + " UNION ALL SELECT 'spy_buy_and_hold', trading_date, spy_return, NULL FROM daily")
PERF = ("log_growth", "annualized_log_growth", "annualized_volatility", "sharpe", "max_drawdown", "positive_day_rate", "average_daily_turnover", "total_turnover")


def performance_sql(source: str, keys: str) -> str:
    w = f"OVER (PARTITION BY {keys} ORDER BY trading_date ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT *, ln(total_return + 1) AS log_growth, ln(total_return + 1) * 252 / trading_days AS annualized_log_growth FROM (SELECT {keys}, count(*) AS trading_days, product(1 + ret) - 1 AS total_return, stddev_pop(ret) * sqrt(252.0) AS annualized_volatility,
  CASE WHEN stddev_pop(ret) > 1e-12 THEN avg(ret) / stddev_pop(ret) * sqrt(252.0) END AS sharpe, min(dd) AS max_drawdown, avg(CASE WHEN ret > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS positive_day_rate, avg(turnover) AS average_daily_turnover, sum(turnover) AS total_turnover
  FROM (SELECT *, wealth / max(wealth) {w} - 1 AS dd FROM (SELECT *, product(1 + ret) {w} AS wealth FROM {source})) GROUP BY {keys})"""


@query("M15", f"SELECT strategy, trading_days, {', '.join(f'{r(c, 5)} AS {c}' for c in PERF)} FROM ({performance_sql('arms_daily', 'strategy')})")
def m15(t):
    return port.performance(port.strategies(daily_of(t)), ["strategy"]).select("strategy", "trading_days", *(rounded(c, 5).alias(c) for c in PERF))


@query("W16", f"SELECT strategy, trading_date, {r('ln(wealth)', 5)} AS log_wealth, {r('wealth / max(wealth) OVER (PARTITION BY strategy ORDER BY trading_date ROWS UNBOUNDED PRECEDING) - 1', 5)} AS drawdown FROM (SELECT *, product(1 + ret) OVER (PARTITION BY strategy ORDER BY trading_date ROWS UNBOUNDED PRECEDING) AS wealth FROM arms_daily)")
def w16(t):
    w = Window.partitionBy("strategy").orderBy("trading_date").rowsBetween(Window.unboundedPreceding, 0)
    x = port.strategies(daily_of(t)).withColumn("wealth", F.product(F.col("ret") + 1).over(w))
    return x.select("strategy", "trading_date", rounded(F.ln("wealth"), 5).alias("log_wealth"), rounded(ratio(F.col("wealth"), F.max("wealth").over(w)) - 1, 5).alias("drawdown"))


@query("W17", f"SELECT trading_date, {r('CASE WHEN count(long_short_turnover) OVER w = 5 THEN avg(long_short_turnover) OVER w END')} AS turnover_5d FROM daily WINDOW w AS (ORDER BY trading_date ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)")
def w17(t):
    w = Window.orderBy("trading_date").rowsBetween(-4, 0)  # one row a session
    x = daily_of(t).select("trading_date", "long_short_turnover")
    return x.select("trading_date", rounded(F.when(F.count("long_short_turnover").over(w) == 5, F.avg("long_short_turnover").over(w))).alias("turnover_5d"))


@query(
    "M16",
    f"""SELECT fold, trading_days, active_days, {', '.join(f'{r(c, 5)} AS {c}' for c in PERF)} FROM ({performance_sql("(SELECT CAST(w.fold AS INT) AS fold, d.trading_date, d.long_short_net AS ret, d.long_short_turnover AS turnover FROM daily d JOIN fold_windows w ON d.trading_date >= w.a AND d.trading_date < w.b)", 'fold')}) p
  JOIN (SELECT CAST(w.fold AS INT) AS fold, count(*) FILTER (d.long_positions > 0) AS active_days FROM daily d JOIN fold_windows w ON d.trading_date >= w.a AND d.trading_date < w.b GROUP BY w.fold) a USING (fold)""",
)
def m16(t):
    x = fold_of(daily_of(t), "trading_date").where("fold IS NOT NULL")
    perf = port.performance(x.select("fold", "trading_date", F.col("long_short_net").alias("ret"), F.col("long_short_turnover").alias("turnover")), ["fold"])
    active = x.groupBy("fold").agg(F.count_if(F.col("long_positions") > 0).alias("active_days"))
    return perf.join(active, "fold").select("fold", "trading_days", "active_days", *(rounded(c, 5).alias(c) for c in PERF))


@query("M17", f"SELECT fold, {r('directional_accuracy', 5)} AS hit_rate, {r('directional_accuracy', 5)} AS directional_accuracy, TRUE AS equal FROM by_fold WHERE model = 'signal'")
def m17(t):
    """The hit rate of single events must equal the directional accuracy of the forecast."""
    x = arms(t).where("model = 'signal'")
    hits = x.groupBy("fold").agg(F.avg(((F.col("actual") > 0) == (F.col("prediction") > 0)).cast("double")).alias("hit_rate"))
    acc = met.forecast_metrics(x, ["fold"]).select("fold", "directional_accuracy")
    return hits.join(acc, "fold").select("fold", rounded("hit_rate", 5).alias("hit_rate"), rounded("directional_accuracy", 5).alias("directional_accuracy"), (F.abs(F.col("hit_rate") - F.col("directional_accuracy")) < 1e-9).alias("equal"))


# linear replay

PARAMETERS = [("momentum_21d", 0.0, 0.01, 0.2, 0.012), ("volatility_21d", 3.0, 3.1, 0.8, -0.004), ("beta_63d", 1.0, 0.9, 0.7, 0.003), ("volume_ratio_20d", 1.0, 1.05, 0.6, 0.002), ("eps_surprise_pct", 0.0, 0.1, 0.5, 0.009), ("days_since_prior_company_event", 5.0, 6.0, 4.0, -0.001)]
INTERCEPT = 0.0015
oracle_view("contribs", " UNION ALL ".join(f"SELECT event_key, event_source, event_date, '{n}' AS feature, (coalesce(CAST({n} AS DOUBLE), {m}) - {a}) / {s} AS z, (coalesce(CAST({n} AS DOUBLE), {m}) - {a}) / {s} * {b} AS contribution FROM features" for n, m, a, s, b in PARAMETERS))


def contributions_of(t) -> DataFrame:
    return met.contributions(features_of(t, MODEL), PARAMETERS)


@query("M18", f"SELECT event_key, {r(f'sum(contribution) + {INTERCEPT}')} AS score FROM contribs GROUP BY event_key")
def m18(t):
    return contributions_of(t).groupBy("event_key").agg(rounded(F.sum("contribution") + INTERCEPT).alias("score"))


def importance_sql(keys: str) -> str:
    return f"SELECT {keys}, feature, avg(abs(contribution)) AS importance, avg(contribution) AS mean, stddev_pop(contribution) AS std, avg(CASE WHEN contribution <> 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS nonzero FROM contribs GROUP BY {keys}, feature"


def importance(x: DataFrame, *keys) -> DataFrame:
    return x.groupBy(*keys, "feature").agg(F.avg(F.abs("contribution")).alias("importance"), F.avg("contribution").alias("mean"), F.stddev_pop("contribution").alias("std"), F.avg((F.col("contribution") != 0).cast("double")).alias("nonzero"))


@query("M19", f"SELECT event_source, feature, {', '.join(f'{r(c)} AS {c}' for c in ('importance', 'mean', 'std', 'nonzero'))}, CAST(row_number() OVER (PARTITION BY event_source ORDER BY {r('importance', 9)} DESC, feature) AS INT) AS rank FROM ({importance_sql('event_source')})")
def m19(t):
    x = importance(contributions_of(t), "event_source")
    order = Window.partitionBy("event_source").orderBy(rounded("importance", 9).desc(), "feature")
    return x.select("event_source", "feature", *(rounded(c).alias(c) for c in ("importance", "mean", "std", "nonzero")), F.row_number().over(order).alias("rank"))


@query("K8", f"SELECT event_key, feature, {r('contribution')} AS contribution, CASE WHEN contribution > 0 THEN 'raises' WHEN contribution < 0 THEN 'lowers' ELSE 'neutral' END AS direction, CAST(n AS INT) AS n FROM (SELECT *, row_number() OVER (PARTITION BY event_key ORDER BY {r('abs(contribution)', 9)} DESC, feature) AS n FROM contribs) WHERE n <= 3")
def k8(t):
    x = met.contributions(features_of(t, MODEL), PARAMETERS, first=3)
    return x.select("event_key", "feature", rounded("contribution").alias("contribution"), F.when(F.col("contribution") > 0, "raises").when(F.col("contribution") < 0, "lowers").otherwise("neutral").alias("direction"), "n")


@query(
    "U4",
    f"""WITH i AS (SELECT year(event_date) AS y, feature, avg(abs(contribution)) AS v FROM contribs GROUP BY 1, 2), k AS (SELECT *, row_number() OVER (PARTITION BY y ORDER BY {r('v', 9)} DESC, feature) AS n FROM i)
  SELECT CAST(a.y AS INT) AS year_a, CAST(b.y AS INT) AS year_b, count(*) FILTER (a.n <= 3 AND b.n <= 3) AS shared, count(*) FILTER (a.n <= 3 OR b.n <= 3) AS either, {r('corr(a.n, b.n)', 5)} AS spearman FROM k a JOIN k b ON b.y = a.y + 1 AND b.feature = a.feature GROUP BY a.y, b.y""",
)
def u4(t):
    """Overlap of the three most important features of consecutive years, and the rank correlation of all."""
    x = contributions_of(t).groupBy(F.year("event_date").alias("y"), "feature").agg(F.avg(F.abs("contribution")).alias("v"))
    x = written(x, "importance")  # a row a year and feature
    k = x.select("y", "feature", F.row_number().over(Window.partitionBy("y").orderBy(rounded("v", 9).desc(), "feature")).alias("n"))
    both = k.select(F.col("y").alias("year_a"), (F.col("y") + 1).alias("year_b"), "feature", F.col("n").alias("a")).join(k.select(F.col("y").alias("year_b"), "feature", F.col("n").alias("b")), ["year_b", "feature"])
    return both.groupBy("year_a", "year_b").agg(F.count_if((F.col("a") <= 3) & (F.col("b") <= 3)).alias("shared"), F.count_if((F.col("a") <= 3) | (F.col("b") <= 3)).alias("either"), rounded(met.correlation("a", "b"), 5).alias("spearman"))


@query(
    "M20",
    f"""SELECT model_mae < zero_mae AND coalesce(sharpe > 0, FALSE) AS promote, array_to_string(list_filter_null, ',') AS reasons FROM (SELECT *, [x FOR x IN [CASE WHEN NOT model_mae < zero_mae THEN 'mae_not_better' END, CASE WHEN NOT coalesce(sharpe > 0, FALSE) THEN 'net_sharpe_not_positive' END] IF x IS NOT NULL] AS list_filter_null
  FROM (SELECT max(mae) FILTER (model = 'signal') AS model_mae, max(mae) FILTER (model = 'zero') AS zero_mae FROM pooled), (SELECT sharpe FROM ({performance_sql('arms_daily', 'strategy')}) WHERE strategy = 'long_short_net'))""",
)
def m20(t):
    pooled = met.forecast_metrics(arms(t), ["model"]).agg(F.max(F.when(F.col("model") == "signal", F.col("mae"))).alias("model_mae"), F.max(F.when(F.col("model") == "zero", F.col("mae"))).alias("zero_mae"))
    sharpe = port.performance(port.strategies(daily_of(t)), ["strategy"]).where("strategy = 'long_short_net'").select("sharpe")
    better, positive = F.col("model_mae") < F.col("zero_mae"), F.coalesce(F.col("sharpe") > 0, F.lit(False))
    reasons = F.array_compact(F.array(F.when(~better, "mae_not_better"), F.when(~positive, "net_sharpe_not_positive")))
    return pooled.join(F.broadcast(sharpe)).select((better & positive).alias("promote"), F.array_join(reasons, ",").alias("reasons"))


@query("M21", " UNION ALL ".join(f"SELECT CAST({i} AS INT) AS position, '{c}' AS feature, {r(f'avg(({c} IS NULL)::INT) FILTER (event_date < DATE {chr(39)}1999-01-01{chr(39)})')} AS development_missing, {r(f'avg(({c} IS NULL)::INT) FILTER (event_date >= DATE {chr(39)}1999-01-01{chr(39)})')} AS test_missing FROM features WHERE target_available" for i, c in enumerate(ALL)))
def m21(t):
    x = features_of(t).where("target_available").withColumn("_dev", F.col("event_date") < F.lit("1999-01-01").cast("date"))
    share = lambda c, dev: F.avg(F.when(F.col("_dev") == dev, F.col(c).isNull().cast("int")))
    wide = x.agg(*(F.struct(F.lit(i).alias("position"), F.lit(c).alias("feature"), rounded(share(c, True)).alias("development_missing"), rounded(share(c, False)).alias("test_missing")).alias(c) for i, c in enumerate(ALL)))
    return wide.select(F.explode(F.array(*(F.col(c) for c in ALL))).alias("x")).select("x.*")


@query("M22", "SELECT event_key, anchor_trading_date, target_trading_date FROM labels30 WHERE target_available AND anchor_trading_date <= DATE '1998-12-31' AND target_trading_date <= DATE '1998-12-31'")
def m22(t):
    return observable(labels_of(t), "1998-12-31").select("event_key", "anchor_trading_date", "target_trading_date")


def observable(labels: DataFrame, cutoff: str) -> DataFrame:
    """Rows whose label could be known at the cutoff."""
    c = F.lit(cutoff).cast("date")
    return labels.where(F.col("target_available") & (F.col("anchor_trading_date") <= c) & (F.col("target_trading_date") <= c))


def add_weekdays(date, n: int):
    """The n-th weekday after a date; from a weekend day counting starts on the Friday before."""
    day = F.weekday(date)
    base = F.when(day > 4, F.date_sub(date, day - 4)).otherwise(date)
    return F.date_add(base, (n + 2 * F.floor((F.weekday(base) + n) / 5)).cast("int"))


WEEKDAYS = "(CASE WHEN isodow({d}) > 5 THEN {d} - CAST(isodow({d}) - 5 AS INT) ELSE {d} END)"


def weekdays_sql(d: str, n: int) -> str:
    b = WEEKDAYS.format(d=d)
    return f"({b} + CAST({n} + 2 * ((isodow({b}) - 1 + {n}) // 5) AS INT))"


@query("F9", f"SELECT event_key, event_date, {weekdays_sql('event_date', 10)} AS deadline FROM corp_events")
def f9(t):
    return t.corp_events.select("event_key", "event_date", add_weekdays(F.col("event_date"), 10).alias("deadline"))


@query(
    "M23",
    f"""SELECT f.event_key, {weekdays_sql('f.anchor_trading_date', 30)} AS deadline, s.score FROM features f JOIN (SELECT event_key, {r(f'sum(contribution) + {INTERCEPT}')} AS score FROM contribs GROUP BY event_key) s ON s.event_key = f.event_key
  WHERE f.target_error = 'incomplete_forward_window' AND f.anchor_trading_date IS NOT NULL AND {weekdays_sql('f.anchor_trading_date', 30)} > (SELECT max(trading_date) FROM bars_daily) AND f.event_key NOT IN (SELECT event_key FROM ledger)""",
)
def m23(t):
    """New forecasts for events whose window is not complete and whose deadline lies ahead; recorded ones are left out."""
    x = features_of(t, MODEL).where("target_error = 'incomplete_forward_window' AND anchor_trading_date IS NOT NULL").withColumn("deadline", add_weekdays(F.col("anchor_trading_date"), 30))
    now = F.broadcast(t.bars_daily.agg(F.max("trading_date").alias("now")))
    x = x.join(now, F.col("deadline") > F.col("now")).join(t.ledger.select("event_key"), "event_key", "left_anti")
    score = met.contributions(x, PARAMETERS).groupBy("event_key").agg(rounded(F.sum("contribution") + INTERCEPT).alias("score"))
    snapshot = F.to_json(F.struct(*(c for c, *_ in PARAMETERS))).alias("snapshot")
    return x.select("event_key", "deadline", snapshot).join(score, "event_key").select("event_key", "deadline", "score")


STATUS_SQL = """CASE WHEN l.status <> 'PENDING' THEN l.status WHEN p.actual IS NULL THEN 'PENDING' WHEN p.target_trading_date <= l.feature_as_of_date THEN 'INVALID' WHEN l.prediction_generated_at >= p.target_trading_date THEN 'INVALID' ELSE 'MATURED' END"""
oracle_view("matured", f"SELECT l.event_key, l.ticker, l.event_source, l.feature_as_of_date, l.predicted_excess_return, l.baseline_predicted_excess_return, {STATUS_SQL} AS status, p.target_trading_date, CASE WHEN {STATUS_SQL} = 'MATURED' THEN p.actual END AS realized FROM ledger l LEFT JOIN predictions p ON p.event_key = l.event_key")


def mature(ledger: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Pending forecasts with an outcome become MATURED, or INVALID if target or recording time is wrong; terminal rows stay."""
    x = ledger.drop("target_trading_date", "realized_excess_return").join(outcomes.select("event_key", "target_trading_date", "actual"), "event_key", "left")
    status = (
        F.when(F.col("status") != "PENDING", F.col("status")).when(F.col("actual").isNull(), "PENDING")
        .when(F.col("target_trading_date") <= F.col("feature_as_of_date"), "INVALID").when(F.col("prediction_generated_at") >= F.col("target_trading_date"), "INVALID").otherwise("MATURED")
    )
    return x.withColumn("status", status).withColumn("realized", F.when(F.col("status") == "MATURED", F.col("actual")))


@query("M24", f"SELECT event_key, status, {r('realized')} AS realized FROM matured")
def m24(t):
    return mature(t.ledger, t.predictions).select("event_key", "status", rounded("realized").alias("realized"))


oracle_view("ledger_rows", "SELECT 'model' AS model, realized AS actual, predicted_excess_return AS prediction FROM matured WHERE status = 'MATURED' UNION ALL SELECT 'frozen_mean', realized, baseline_predicted_excess_return FROM matured WHERE status = 'MATURED'")


@query(
    "M25",
    f"""SELECT m.model, rows, {r('mae', 5)} AS mae, {r('spearman_ic', 5)} AS spearman_ic, c.total, c.pending, c.matured, c.invalid, c.matured >= 40 AS enough, min(mae) FILTER (m.model = 'model') OVER () < min(mae) FILTER (m.model = 'frozen_mean') OVER () AS mae_beats_mean
  FROM ({metrics_sql('ledger_rows', 'model')}) m, (SELECT count(*) AS total, count(*) FILTER (status = 'PENDING') AS pending, count(*) FILTER (status = 'MATURED') AS matured, count(*) FILTER (status = 'INVALID') AS invalid FROM matured) c""",
)
def m25(t):
    x = mature(t.ledger, t.predictions)
    count = lambda s: F.count_if(F.col("status") == s)
    counts = x.agg(F.count(F.lit(1)).alias("total"), count("PENDING").alias("pending"), count("MATURED").alias("matured"), count("INVALID").alias("invalid"))
    both = F.explode(F.array(F.struct(F.lit("model").alias("model"), F.col("predicted_excess_return").alias("prediction")), F.struct(F.lit("frozen_mean").alias("model"), F.col("baseline_predicted_excess_return").alias("prediction")))).alias("m")
    rows = x.where("status = 'MATURED'").select(F.col("realized").alias("actual"), both).select("actual", "m.*")
    scored = met.forecast_metrics(rows, ["model"])
    pair = scored.agg(F.min(F.when(F.col("model") == "model", F.col("mae"))).alias("a"), F.min(F.when(F.col("model") == "frozen_mean", F.col("mae"))).alias("b"))
    out = scored.join(F.broadcast(counts)).join(F.broadcast(pair))
    return out.select("model", "rows", rounded("mae", 5).alias("mae"), rounded("spearman_ic", 5).alias("spearman_ic"), "total", "pending", "matured", "invalid", (F.col("matured") >= 40).alias("enough"), (F.col("a") < F.col("b")).alias("mae_beats_mean"))


@query("K6", f"SELECT event_key, {r('momentum_21d', 5)} AS momentum_21d FROM (SELECT *, row_number() OVER (ORDER BY event_date, event_key) - 1 AS i, count(*) OVER () AS n FROM features WHERE target_available) WHERE i IN (SELECT CAST(floor(p * (n - 1) / 49.0) AS BIGINT) FROM range(50) x(p))")
def k6(t):
    from meridian.plans.market_queries import evenly_spaced

    x = features_of(t, MODEL).where("target_available").select(F.lit(1).alias("one"), "event_key", "event_date", "momentum_21d")
    return evenly_spaced(x, ["one"], ["event_date", "event_key"], 50, half_even=False).select("event_key", rounded("momentum_21d", 5).alias("momentum_21d"))


@query("K7", "SELECT ticker, event_key, anchor_trading_date FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_date DESC, anchor_trading_date DESC NULLS LAST, event_key DESC) AS n FROM labels30) WHERE n = 1")
def k7(t):
    order = Window.partitionBy("ticker").orderBy(F.desc("event_date"), F.desc_nulls_last("anchor_trading_date"), F.desc("event_key"))
    return labels_of(t).withColumn("n", F.row_number().over(order)).where("n = 1").select("ticker", "event_key", "anchor_trading_date")

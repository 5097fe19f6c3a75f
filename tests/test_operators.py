"""Scenarios on small frames: anchors, leakage, labels, portfolios, weights, sinks, chunks."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from meridian.functions import packing, text, udfs
from meridian.functions.checks import require_columns
from meridian.operators import asof, metrics, portfolio
from meridian.operators.indicators import MARKET, market_panel
from meridian.operators.labels import forward_labels
from meridian.operators.splits import check_windows, with_folds
from meridian.plans.model_queries import add_weekdays
from meridian.sources.bindings import holding
from meridian.sources.workspace import latest_wins, replace_children, scratch, upsert, written

D = dt.date
DAY = dt.timedelta(days=1)
EVENT = "event_key string, event_source string, event_id string, ticker string, event_date date"


def bars(spark, tickers=("AAA", "SPY"), n=40, start=D(2024, 1, 1), step=1.0):
    rows = [(t, start + k * DAY, 100.0 + k * step * (i + 1), 1000 + k) for i, t in enumerate(tickers) for k in range(n)]
    return spark.createDataFrame(rows, "ticker string, trading_date date, adjusted_close double, volume bigint")


def event(spark, date, ticker="AAA"):
    return spark.createDataFrame([("earnings_call:1", "earnings_call", "1", ticker, date)], EVENT)


def test_anchor_is_strictly_after_the_event(spark):
    sessions = asof.number_sessions(bars(spark))
    row = asof.forward_anchor(event(spark, D(2024, 1, 5)), sessions).first()
    assert row.anchor_date == D(2024, 1, 6) and row.near
    assert asof.backward(event(spark, D(2024, 1, 5)), sessions, "event_date").first().asof_date == D(2024, 1, 5)


@pytest.mark.parametrize(
    "date, ticker, reason",
    [
        (D(2023, 12, 1), "AAA", "missing_near_event_anchor"),
        (D(2024, 2, 20), "AAA", "missing_post_event_anchor"),
        (D(2024, 2, 5), "AAA", "incomplete_forward_window"),
        (D(2024, 1, 5), "ZZZ", "missing_ticker_prices"),
        (None, "AAA", "missing_event_date"),
        (D(2024, 1, 5), "AAA", None),
    ],
)
def test_label_reasons(spark, date, ticker, reason):
    row = forward_labels(event(spark, date, ticker), bars(spark), horizon=10).first()
    assert row.target_error == reason and row.target_available == (reason is None)
    if reason is None:
        assert row.excess_return == pytest.approx((115 / 105 - 1) - (130 / 110 - 1))


def test_later_prices_do_not_move_features(spark):
    before = bars(spark, n=150)
    after = before.withColumn("adjusted_close", F.when(F.col("trading_date") > D(2024, 5, 14), F.col("adjusted_close") * 10).otherwise(F.col("adjusted_close")))
    at = F.col("trading_date") == D(2024, 5, 14)
    a, b = (market_panel(x).where(at).orderBy("ticker").select(*MARKET).collect() for x in (before, after))
    assert a == b and a[0].momentum_126d is not None


def test_rolling_values_need_full_frames(spark):
    panel = market_panel(bars(spark, n=30)).where("ticker = 'AAA'").orderBy("trading_date").collect()
    assert panel[18].sma_ratio_20d is None and panel[19].sma_ratio_20d is not None and panel[-1].sma_ratio_50d is None


def test_nearest_result_prefers_the_later_date_and_never_looks_ahead(spark):
    e = event(spark, D(2024, 1, 10)).withColumn("anchor_trading_date", F.lit("2024-01-11").cast("date"))
    rows = [("AAA", D(2024, 1, 9), 1.0), ("AAA", D(2024, 1, 11), 2.0), ("AAA", D(2024, 1, 12), 3.0)]
    found = asof.nearest_result(e, spark.createDataFrame(rows, "ticker string, earnings_date date, eps double")).first()
    assert found.eps == 2.0 and found.match_days == 1


def test_no_nested_loops_over_time(spark):
    s = asof.number_sessions(bars(spark))
    plan = asof.forward_anchor(event(spark, D(2024, 1, 5)), s)._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def signals(spark):
    rows = [(f"e{k}", t, D(2024, 1, 1), D(2024, 1, 5), float(k)) for k, t in enumerate("ABCD")]
    return spark.createDataFrame(rows, "event_key string, ticker string, feature_as_of_date date, target_trading_date date, prediction double")


def test_portfolio_starts_expires_and_balances(spark):
    prices = bars(spark, (*"ABCD", "SPY"), 10)
    w = portfolio.signal_weights(signals(spark), prices, top_k=1, min_signals=4).collect()
    assert {x.trading_date for x in w} == {D(2024, 1, k) for k in range(1, 5)}
    assert sum(x.long_short_weight for x in w) == 0 and {x.ticker for x in w if x.position == "long"} == {"D"}
    days = portfolio.daily_returns(signals(spark), prices, top_k=1).orderBy("trading_date").collect()
    assert days[0].long_short_turnover == 1.0 and days[1].long_short_turnover == 0.0 and days[4].long_short_turnover == 1.0
    assert days[0].long_short_net == pytest.approx(days[0].long_short_gross - 0.001)


def test_folds_purge_crossing_labels(spark):
    rows = [("a", D(1997, 1, 1), D(1997, 2, 1)), ("b", D(1997, 12, 20), D(1998, 1, 20)), ("c", D(1998, 2, 1), D(1998, 3, 1))]
    x = with_folds(spark.createDataFrame(rows, "k string, f date, t date"), "f", "t").where("fold = 1")
    assert {r.k: r.role for r in x.collect()} == {"a": "train", "b": "purged", "c": "validation"}
    with pytest.raises(ValueError):
        check_windows([(1, "2000-01-01", "1999-01-01")])


def test_spearman_shares_ranks_of_ties_and_constant_predictions_have_none(spark):
    rows = [("m", 1.0, 1.0), ("m", 2.0, 1.0), ("m", 3.0, 2.0), ("c", 1.0, 0.0), ("c", 2.0, 0.0)]
    x = {r.model: r for r in metrics.forecast_metrics(spark.createDataFrame(rows, "model string, actual double, prediction double"), ["model"]).collect()}
    assert x["m"].spearman_ic == pytest.approx(0.8660254) and x["c"].spearman_ic is None


def test_upsert_is_idempotent_and_children_are_replaced(spark):
    path = scratch(spark, "test")
    one = spark.createDataFrame([("a", 1, 2020), ("b", 1, 2021)], "k string, v int, year int")
    two = spark.createDataFrame([("b", 2, 2021), ("c", 2, 2021)], "k string, v int, year int")
    for x in (one, two, two):
        out = upsert(path, x, ["k"], "year")
    assert {(r.k, r.v) for r in out.collect()} == {("a", 1), ("b", 2), ("c", 2)}
    assert {r.k for r in replace_children(one, two.where("k = 'c'"), "year").collect()} == {"a", "c"}
    assert latest_wins(one.union(two), ["year"], "v").count() == 2


def test_chunks_overlap_and_stop_at_the_end(spark):
    docs = spark.createDataFrame([(1, " ".join(map(str, range(25)))), (2, "a  b"), (3, "")], "id int, t string")
    got = docs.select("id", F.explode(text.chunks(F.col("t"), 10, 8)).alias("c")).select("id", "c.*").collect()
    assert [(r["id"], r["index"], r["tokens"]) for r in got] == [(1, 0, 10), (1, 1, 10), (1, 2, 9), (2, 0, 2), (3, 0, 0)]
    spark.udtf.register("split_words", udfs.SplitTokens)
    assert spark.sql("SELECT count(*) FROM split_words('a b c d e', 3, 2)").first()[0] == 2


def test_turns_are_packed_whole_and_long_ones_cut(spark):
    turns = spark.createDataFrame([(1, 0, "operator", "a b"), (1, 1, "analyst", "c d"), (1, 2, "executive", " ".join("x" * 12)), (1, 3, "analyst", "e")], "transcript_id int, turn_index int, speaker_role string, content string")
    got = packing.pack_turns(turns, 6).orderBy("chunk_index").collect()
    assert [r.tokens for r in got] == [6, 6, 6, 1, 2] and got[0].speakers == "analyst,operator"


def test_batches_are_bounded(spark):
    rows = spark.createDataFrame([(k, 4, 0) for k in range(7)], "chunk_id bigint, tokens int, g int")
    got = [r.batch for r in packing.bounded_batches(rows, "g", 3, 9).orderBy("chunk_id").collect()]
    assert got == [0, 0, 1, 1, 2, 2, 3]


def test_weekdays(spark):
    d = spark.createDataFrame([(D(2024, 1, 5),), (D(2024, 1, 6),)], "d date")
    assert [r[0] for r in d.select(add_weekdays(F.col("d"), 1)).collect()] == [D(2024, 1, 8)] * 2


def test_a_failing_text_harms_no_other(spark):
    class Picky(udfs.LexiconScorer):
        def score_many(self, texts):
            if "bad" in texts:
                raise ValueError
            return super().score_many(texts)

    rows = spark.createDataFrame([(1, "gain"), (2, "bad"), (3, "loss")], "k int, t string")
    assert {r.k: r.status for r in udfs.score_texts(rows, "k", "t", Picky).collect()} == {1: "SCORED", 2: "FAILED", 3: "SCORED"}


def test_missing_columns_are_named(spark):
    with pytest.raises(ValueError, match="b"):
        require_columns(spark.createDataFrame([(1,)], "a int"), "a", "b")


def test_ranks_and_quantiles_with_ties(spark):
    rng = np.random.default_rng(5)
    x = pd.DataFrame({"k": rng.choice(["a", "b"], 3000), "v": np.where(rng.random(3000) < 0.4, 0.0, rng.normal(size=3000).round(2))})
    rows = written(spark.createDataFrame(x), "ranked")
    got = metrics.average_ranks(rows, ["k"], "v").toPandas()
    assert len(got) == 3000 and (got.v_rank == got.groupby("k").v.rank()).all()
    q = {r.k: r.q for r in metrics.exact_quantiles(rows, ["k"], "v", (0.0, 0.3, 0.5, 1.0)).collect()}
    for k, part in x.groupby("k"):
        assert q[k] == pytest.approx(list(part.v.quantile([0.0, 0.3, 0.5, 1.0])))


def test_quantiles_of_nothing_and_of_one_value(spark):
    rows = written(spark.createDataFrame([("a", None), ("b", 2.0), ("b", None)], "k string, v double"), "few")
    assert [tuple(r) for r in metrics.exact_quantiles(rows, ["k"], "v", (0.5,)).collect()] == [("b", [2.0])]


def test_texts_held_by_documents(spark):
    docs = [(1, "so one two three four five six seven end"), (2, "one two three four five six sevens"), (3, "xone two three four five six seveny"), (4, "one  two three four five six seven"), (5, None), (6, "a short"), (7, "")]
    items = [(1, "one two three four five six seven"), (2, "short"), (3, "nowhere at all to be found in it"), (4, None)]
    found = holding(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, wanted string")).collect()
    want = {(i, d) for i, w in items for d, x in docs if w and x and w in x}
    assert want <= {tuple(r) for r in found} and len(set(found)) == len(found)
    assert want == {(1, 1), (1, 2), (1, 3), (2, 6)}


def test_batches_are_bounded_and_in_order(spark):
    sizes = [5, 5, 5, 20, 1, 1, 1, 1, 9]
    rows = spark.createDataFrame([(0, k, n) for k, n in enumerate(sizes)], "part int, chunk_id long, tokens int")
    got = sorted((r.chunk_id, r.batch) for r in packing.bounded_batches(rows, "part", 3, 12).collect())
    assert [b for _, b in got] == [0, 0, 1, 2, 3, 3, 3, 4, 4]


def test_prior_events_over_days_and_within_a_day(spark):
    """Priors equal those of one window over all events of a ticker and source; no task has all of a ticker's events."""
    from pyspark.sql import Window

    from meridian.operators import features

    rows = [(f"e{k}", t, ("sec_filing", "earnings_call")[k % 3 == 0], f"{k:02d}", D(2024, 1, 1 + k // 4) if k < 20 else None, "10-K", "2024Q1", None if k % 5 == 0 else float(k)) for k in range(22) for t in ("A", None)]
    x = spark.createDataFrame(rows, "event_key string, ticker string, event_source string, event_id string, event_date date, form_type string, fiscal_period string, v double")
    order = ("event_date", "event_source", "event_id")
    over = lambda *keys: Window.partitionBy(*keys).orderBy(*order)
    gap = lambda *keys: F.datediff("event_date", F.lag("event_date").over(over(*keys)))
    want = x.select("ticker", "event_key", gap("ticker"), gap("ticker", "event_source"), F.lag("v").over(over("ticker", "event_source")))
    got = features.event_prior(features.calendar_features(x), "v")
    names = "ticker event_key days_since_prior_company_event days_since_prior_source_event v_prior".split()
    plain = lambda df: sorted(map(str, map(tuple, df.collect())))
    assert plain(got.select(*names)) == plain(want)
    windows = [line for line in features.calendar_features(x)._jdf.queryExecution().executedPlan().toString().splitlines() if "row_number()" in line and "Window" in line]
    assert windows and all("event_date" in w.split("],")[1] for w in windows)


def test_greatest_contributions(spark):
    from meridian.operators import metrics

    x = spark.createDataFrame([("e", 1.0, -3.0, 3.0, None)], "event_key string, a double, b double, c double, d double")
    got = metrics.contributions(x, [(k, 0.0, 0.0, 1.0, 1.0) for k in "cbad"], first=3).orderBy("n").collect()
    assert [(r.feature, r.contribution, r.n) for r in got] == [("b", -3.0, 1), ("c", 3.0, 2), ("a", 1.0, 3)]


def test_ranks_do_not_pass_through_the_driver(spark):
    from meridian.operators import metrics
    from meridian.sources.workspace import written

    rows = written(spark.createDataFrame([("m", float(k % 3)) for k in range(7)], "model string, v double"), "ranks")
    out = metrics.average_ranks(rows, ["model"], "v")
    assert sorted((r.v, r.v_rank) for r in out.collect()) == [(0.0, 2.0)] * 3 + [(1.0, 4.5)] * 2 + [(2.0, 6.5)] * 2
    joins = [line for line in out._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join Inner" in line]
    assert "strategy=merge" in joins[0]  # the join of rows and ranks is the outermost

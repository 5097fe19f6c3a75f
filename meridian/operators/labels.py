"""Forward excess-return labels of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.operators.asof import forward_anchor, number_sessions


def forward_labels(events: DataFrame, prices: DataFrame, horizon: int = 30, benchmark: str = "SPY", max_gap: int = 7) -> DataFrame:
    """Events with anchor and target session, stock, benchmark and excess return, or the reason why not.

    Labels depend on ticker and date alone, so they are made for those and joined with the events. The anchor is the first session strictly after the event, the target `horizon` sessions later;
    sessions without a price still count. Reasons are tested in the order of the `when` chain.
    """
    labels = date_labels(events.select("ticker", "event_date").distinct(), prices, horizon, benchmark, max_gap)
    return at_dates(events, labels)


def at_dates(events: DataFrame, found: DataFrame) -> DataFrame:
    """Events with what was found for their ticker and date (null ones too): an equi-join in which tickers spread over dates."""
    found = found.withColumnsRenamed({"ticker": "_ticker", "event_date": "_date"})
    same = events["ticker"].eqNullSafe(found["_ticker"]) & events["event_date"].eqNullSafe(found["_date"])
    return events.join(found, same, "left").drop("_ticker", "_date")


def date_labels(points: DataFrame, prices: DataFrame, horizon: int = 30, benchmark: str = "SPY", max_gap: int = 7) -> DataFrame:
    """The labels of distinct (ticker, event_date): no more rows than days, however many events they have."""
    sessions = number_sessions(prices)
    known = sessions.select("ticker").distinct().withColumn("_known", F.lit(True))
    target = sessions.select("ticker", F.col("idx").alias("_t"), F.col("trading_date").alias("_target"), F.col("adjusted_close").alias("_target_close"))
    bench = prices.where(F.col("ticker") == benchmark).select("trading_date", "adjusted_close")
    at = lambda name: F.broadcast(bench.select(F.col("trading_date").alias(f"_{name}"), F.col("adjusted_close").alias(f"_bench_{name}"), F.lit(True).alias(f"_has_{name}")))
    x = forward_anchor(points, sessions, max_gap).withColumn("_t", F.col("anchor_idx") + horizon)
    x = x.join(target, ["ticker", "_t"], "left").join(known, "ticker", "left")
    x = x.withColumnRenamed("anchor_date", "_anchor").join(at("anchor"), "_anchor", "left").join(at("target"), "_target", "left")
    prices_ok = F.least("anchor_close", "_target_close", "_bench_anchor", "_bench_target") > 0
    some_null = F.col("anchor_close").isNull() | F.col("_target_close").isNull() | F.col("_bench_anchor").isNull() | F.col("_bench_target").isNull()
    error = (
        F.when(F.col("event_date").isNull(), "missing_event_date")
        .when(F.col("_known").isNull(), "missing_ticker_prices")
        .when(F.col("_anchor").isNull(), "missing_post_event_anchor")
        .when(~F.col("near"), "missing_near_event_anchor")
        .when(F.col("_target").isNull(), "incomplete_forward_window")
        .when(F.lit(False), "missing_benchmark_prices")
        .when(F.col("_has_anchor").isNull() | F.col("_has_target").isNull(), "missing_benchmark_dates")
        .when(some_null | ~prices_ok, "invalid_adjusted_close")
    )
    x = x.withColumn("target_error", error)
    ok = F.col("target_error").isNull()
    stock = F.when(ok, F.try_divide("_target_close", "anchor_close") - 1)
    spy = F.when(ok, F.try_divide("_bench_target", "_bench_anchor") - 1)
    return x.select(
        "ticker",
        "event_date",
        F.col("_anchor").alias("anchor_trading_date"),
        F.when(F.col("near"), F.col("_target")).alias("target_trading_date"),
        stock.alias("stock_return"),
        spy.alias("benchmark_return"),
        (stock - spy).alias("excess_return"),
        ok.alias("target_available"),
        "target_error",
    )

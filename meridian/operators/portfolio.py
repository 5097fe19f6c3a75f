"""Signal portfolios on a shared trading calendar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.numeric import ratio
from meridian.operators.asof import active_on, number_calendar
from meridian.sources.workspace import written


def next_session_returns(bars: DataFrame) -> DataFrame:
    """Return to the next date of any ticker; null where the ticker has no price on it."""
    calendar = number_calendar(bars)
    following = calendar.select((F.col("i") - 1).alias("i"), F.col("trading_date").alias("next_date"))
    dates = F.broadcast(calendar.join(following, "i", "left").drop("i"))
    ahead = bars.select("ticker", F.col("trading_date").alias("next_date"), F.col("adjusted_close").alias("_next"))
    x = bars.select("ticker", "trading_date", "adjusted_close").join(dates, "trading_date").join(ahead, ["ticker", "next_date"], "left")
    return x.withColumn("next_return", ratio("_next", "adjusted_close") - 1).drop("_next")


def traded_days(signals: DataFrame, bars: DataFrame, benchmark: str = "SPY") -> DataFrame:
    """Days of the signals' range on which the benchmark has a next return, numbered (day)."""
    span = signals.agg(F.min("feature_as_of_date").alias("a"), F.max("target_trading_date").alias("b"))
    bench = next_session_returns(bars).where((F.col("ticker") == benchmark) & F.col("next_return").isNotNull())
    days = bench.join(F.broadcast(span), F.col("trading_date").between(F.col("a"), F.col("b"))).select("trading_date", "next_date", F.col("next_return").alias("spy_return"))
    return days.withColumn("day", F.row_number().over(Window.orderBy("trading_date")))  # one row a session


def signal_weights(signals: DataFrame, bars: DataFrame, top_k: int = 2, min_signals: int = 4, traded: DataFrame | None = None) -> DataFrame:
    """Cross-sectional weights by day: the latest signal of each ticker, the best k long, the worst k short.

    `traded` are the `traded_days`, where the caller has them.
    """
    days = F.broadcast((traded_days(signals, bars) if traded is None else traded).select("trading_date", "day"))  # one row a session
    live = active_on(signals, number_calendar(bars), "feature_as_of_date", "target_trading_date").join(days, "trading_date")
    by_day = Window.partitionBy("day")
    live = live.withColumn("_all", F.count(F.lit(1)).over(by_day)).where(F.col("_all") >= min_signals)
    newest = Window.partitionBy("day", "ticker").orderBy(F.desc("feature_as_of_date"), F.desc("event_key"))
    one = live.withColumn("_n", F.row_number().over(newest)).where("_n = 1")
    one = one.withColumns({"m": F.count(F.lit(1)).over(by_day), "rank": F.row_number().over(by_day.orderBy("prediction", "ticker"))})
    one = one.where(F.col("m") >= min_signals).withColumn("n", F.least(F.lit(top_k), F.floor(F.col("m") / 2)).cast("int")).where("n >= 1")
    position = F.when(F.col("rank") > F.col("m") - F.col("n"), "long").when(F.col("rank") <= F.col("n"), "short")
    picked = one.withColumn("position", position).where("position IS NOT NULL")
    side = F.when(F.col("position") == "long", 0.5).otherwise(-0.5)
    return picked.select(
        "day", "trading_date", "ticker", "event_key", "prediction", "position", (side / F.col("n")).alias("long_short_weight"), F.when(F.col("position") == "long", F.lit(1.0) / F.col("n")).otherwise(0.0).alias("long_only_weight")
    )


def turnover(weights: DataFrame, days: DataFrame) -> DataFrame:
    """Sum of absolute weight changes from the previous traded day, for every traded day."""
    names = ("long_short_weight", "long_only_weight")
    now = weights.select("day", "ticker", *names)
    before = weights.select((F.col("day") + 1).alias("day"), "ticker", *(F.col(c).alias(f"_{c}") for c in names))
    both = now.join(before, ["day", "ticker"], "full_outer").na.fill(0.0)
    moved = both.groupBy("day").agg(*(F.sum(F.abs(F.col(c) - F.col(f"_{c}"))).alias(c.replace("weight", "turnover")) for c in names))
    return days.select("day", "trading_date").join(moved, "day", "left").na.fill(0.0)


def daily_returns(signals: DataFrame, bars: DataFrame, top_k: int = 2, min_signals: int = 4, cost_bps: float = 10.0) -> DataFrame:
    """Gross and net returns of both portfolios by day; positions without a next return are counted."""
    days = written(traded_days(signals, bars), "traded-days")
    weights = written(signal_weights(signals, bars, top_k, min_signals, days), "weights")
    moves = next_session_returns(bars).select("ticker", "trading_date", "next_return")
    held = weights.join(moves, ["ticker", "trading_date"], "left")
    sums = held.groupBy("day").agg(
        F.count_if(F.col("position") == "long").alias("long_positions"),
        F.count_if(F.col("position") == "short").alias("short_positions"),
        F.count_if(F.col("next_return").isNull()).alias("missing_returns"),
        F.sum(F.col("long_short_weight") * F.col("next_return")).alias("long_short_gross"),
        F.sum(F.col("long_only_weight") * F.col("next_return")).alias("long_only_gross"),
    )
    out = days.join(turnover(weights, days).drop("trading_date"), "day").join(sums, "day", "left").na.fill(0).na.fill(0.0)
    net = {f"{p}_net": F.col(f"{p}_gross") - F.col(f"{p}_turnover") * (cost_bps / 10_000) for p in ("long_short", "long_only")}
    return out.withColumns(net)


def performance(returns: DataFrame, keys: list[str], value: str = "ret", moved: str = "turnover", order: str = "trading_date") -> DataFrame:
    """Return, risk and turnover statistics of daily returns by `keys`; there is one row a day in a group."""
    so_far = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    x = returns.where(F.col(value).isNotNull()).withColumn("_wealth", F.product(F.col(value) + 1).over(so_far))
    x = x.withColumn("_drawdown", ratio(F.col("_wealth"), F.max("_wealth").over(so_far)) - 1)
    agg = x.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("trading_days"),
        (F.product(F.col(value) + 1) - 1).alias("total_return"),
        F.avg(value).alias("_mean"),
        F.stddev_pop(value).alias("_std"),
        F.min("_drawdown").alias("max_drawdown"),
        F.avg((F.col(value) > 0).cast("double")).alias("positive_day_rate"),
        F.avg(moved).alias("average_daily_turnover"),
        F.sum(moved).alias("total_turnover"),
    )
    year = F.sqrt(F.lit(252.0))
    return agg.select(
        *keys, "trading_days", "total_return", F.ln(F.col("total_return") + 1).alias("log_growth"),
        (F.ln(F.col("total_return") + 1) * 252 / F.col("trading_days")).alias("annualized_log_growth"),
        (F.pow(F.col("total_return") + 1, F.lit(252.0) / F.col("trading_days")) - 1).alias("annualized_return"),
        (F.col("_std") * year).alias("annualized_volatility"),
        F.when(F.col("_std") > 1e-12, F.try_divide("_mean", "_std") * year).alias("sharpe"),
        "max_drawdown", "positive_day_rate", "average_daily_turnover", "total_turnover",
    )


def strategies(daily: DataFrame) -> DataFrame:
    """Daily returns as rows (strategy, trading_date, ret, turnover)."""
    arms = [(f"{p}_{kind}", f"{p}_{kind}", f"{p}_turnover") for p in ("long_short", "long_only") for kind in ("gross", "net")]
    rows = [F.struct(F.lit(n).alias("strategy"), F.col(c).alias("ret"), F.col(m).alias("turnover")) for n, c, m in arms]
    rows.append(F.struct(F.lit("spy_buy_and_hold").alias("strategy"), F.col("spy_return").alias("ret"), F.lit(None).cast("double").alias("turnover")))
    return daily.select("trading_date", F.explode(F.array(*rows)).alias("x")).select("x.strategy", "trading_date", "x.ret", "x.turnover")

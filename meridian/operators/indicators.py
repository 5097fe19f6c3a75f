"""Trailing market indicators: all frames of a ticker share one window order, so there is one sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.numeric import ratio

def by_ticker():
    return Window.partitionBy("ticker").orderBy("trading_date")


def trailing(n: int):
    return by_ticker().rowsBetween(1 - n, 0)


def full(agg, x: str | Column, n: int) -> Column:
    """An aggregate over the last n rows; null unless they hold n values."""
    return F.when(F.count(x).over(trailing(n)) == n, agg(x).over(trailing(n)))


def lag_return(n: int = 1, x: str = "adjusted_close") -> Column:
    return ratio(F.col(x), F.lag(x, n).over(by_ticker())) - 1


def own_indicators(prices: DataFrame) -> DataFrame:
    """Indicators of each ticker's own history."""
    base = prices.select("ticker", "trading_date", "adjusted_close", "volume").withColumn("return_1d", lag_return())
    mean20, std20 = full(F.avg, "volume", 20), full(F.stddev_samp, "volume", 20)
    px = F.col("adjusted_close")
    return base.select(
        "*",
        *(lag_return(n).alias(f"momentum_{n}d") for n in (5, 21, 63, 126)),
        *((full(F.stddev_samp, "return_1d", n) * F.sqrt(F.lit(252.0))).alias(f"volatility_{n}d") for n in (21, 63)),
        *((ratio(px, full(F.avg, "adjusted_close", n)) - 1).alias(f"sma_ratio_{n}d") for n in (20, 50, 126)),
        ratio(F.col("volume").cast("double"), mean20).alias("volume_ratio_20d"),
        ratio(F.col("volume") - mean20, F.nullif(std20, F.lit(0.0))).alias("volume_zscore_20d"),
        (ratio(px, full(F.max, "adjusted_close", 126)) - 1).alias("drawdown_126d"),
    )


def benchmark_columns(panel: DataFrame, benchmark: str) -> DataFrame:
    """The benchmark's series by date: one row a session, small enough to broadcast at any scale of tickers."""
    return panel.where(F.col("ticker") == benchmark).select(
        "trading_date",
        F.col("return_1d").alias("spy_return_1d"),
        F.col("momentum_21d").alias("spy_momentum_21d"),
        F.col("momentum_63d").alias("spy_momentum_63d"),
        F.col("volatility_21d").alias("spy_volatility_21d"),
    )


def market_panel(prices: DataFrame, benchmark: str = "SPY") -> DataFrame:
    """All indicators with the benchmark's, relative momentum and rolling beta."""
    own = own_indicators(prices)
    panel = own.join(F.broadcast(benchmark_columns(own, benchmark)), "trading_date", "left")
    pairs = F.count(F.when(F.col("return_1d").isNotNull(), F.col("spy_return_1d"))).over(trailing(63))
    cov = F.covar_samp("return_1d", "spy_return_1d").over(trailing(63))
    var = full(F.var_samp, "spy_return_1d", 63)
    return panel.select(
        "*",
        (F.col("momentum_21d") - F.col("spy_momentum_21d")).alias("relative_momentum_21d"),
        (F.col("momentum_63d") - F.col("spy_momentum_63d")).alias("relative_momentum_63d"),
        F.when(pairs == 63, ratio(cov, F.nullif(var, F.lit(0.0)))).alias("beta_63d"),
    )


MARKET = (
    "return_1d momentum_5d momentum_21d momentum_63d momentum_126d volatility_21d volatility_63d sma_ratio_20d sma_ratio_50d sma_ratio_126d "
    "volume_ratio_20d volume_zscore_20d drawdown_126d beta_63d spy_momentum_21d spy_momentum_63d spy_volatility_21d relative_momentum_21d relative_momentum_63d"
).split()

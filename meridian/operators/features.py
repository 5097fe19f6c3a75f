"""The point-in-time feature dataset of events."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.text import TOPICS
from meridian.operators.asof import nearest_to_dates
from meridian.operators.indicators import MARKET, market_panel
from meridian.operators.labels import at_dates, date_labels
from meridian.operators.sentiment import event_sentiment, topic_features
from meridian.sources.workspace import FEW_WIDE_ROWS, few, written

EVENT = "is_earnings_call is_sec_filing is_10k is_10q fiscal_quarter event_month_sin event_month_cos days_since_prior_company_event days_since_prior_source_event".split()
SENTIMENT = "sentiment_score sentiment_confidence sentiment_dispersion sentiment_coverage sentiment_scored_items sentiment_token_count management_sentiment_score analyst_sentiment_score management_analyst_gap sentiment_change_from_prior".split()
EPS = "eps_estimate reported_eps eps_surprise eps_surprise_pct eps_surprise_direction prior_eps_surprise_pct eps_surprise_change".split()
TOPIC = [f"topic_{k}_{x}" for k in TOPICS for x in ("sentiment", "share")]
FORBIDDEN = ("target", "return_forward", "excess", "stock_return", "benchmark_return")


def allowed(topics: bool = True) -> list[str]:
    """The model inputs in their fixed order; nothing of the label is among them."""
    names = [*MARKET, *EVENT, *SENTIMENT, *EPS, *(TOPIC if topics else [])]
    if leak := [n for n in names if n.startswith(FORBIDDEN)]:
        raise ValueError(f"label columns among the inputs: {leak}")
    return names


def event_prior(df: DataFrame, value: str) -> DataFrame:
    """Adds the value of the previous event of the ticker and source.

    Within a day it is the event before; a day's first event takes the last of the day before, found among one row a day,
    ticker and source. So the rows of a ticker spread over its days.
    """
    keys, order = ("ticker", "event_source"), ("event_date", "event_id")
    lasts = df.groupBy(*keys, "event_date").agg(F.max_by(F.struct(value), F.struct(*order)).alias("_last"))
    lasts = lasts.withColumn("_before", F.lag("_last").over(Window.partitionBy(*keys).orderBy("event_date"))[value]).drop("_last")
    day = Window.partitionBy(*keys, "event_date").orderBy("event_id")
    x = df.withColumns({"_n": F.row_number().over(day), "_lag": F.lag(value).over(day)})
    x = joined(x, lasts, (*keys, "event_date"))
    return x.withColumn(f"{value}_prior", F.when(F.col("_n") == 1, F.col("_before")).otherwise(F.col("_lag"))).drop("_n", "_lag", "_before")


def joined(x: DataFrame, found: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Left join on keys that may be null."""
    found = found.withColumnsRenamed({k: f"_{k}" for k in keys})
    same = reduce(Column.__and__, (x[k].eqNullSafe(found[f"_{k}"]) for k in keys))
    return x.join(found, same, "left").drop(*(f"_{k}" for k in keys))


def calendar_features(events: DataFrame) -> DataFrame:
    """Source and form flags, fiscal quarter, month on the circle, days since the prior events.

    An event that is not the first of its day has its prior on the same day; for the others days are compared, one row each.
    """
    days = events.select("ticker", "event_source", "event_date").distinct()
    earlier = lambda *keys: F.lag("event_date").over(Window.partitionBy(*keys).orderBy("event_date"))
    company = days.select("ticker", "event_date").distinct().withColumn("_company", earlier("ticker"))
    days = joined(days.withColumn("_source", earlier("ticker", "event_source")), company, ("ticker", "event_date"))
    day = Window.partitionBy("ticker", "event_date").orderBy("event_source", "event_id")
    events = events.withColumns({"_n": F.row_number().over(day), "_same": F.lag(F.struct("event_source")).over(day)})
    events = joined(events, days, ("ticker", "event_source", "event_date"))
    other = F.col("_same").isNull() | ~F.col("_same.event_source").eqNullSafe(F.col("event_source"))
    return events.withColumns({**event_flags(), **gaps(F.col("_n") == 1, other)}).drop("_n", "_same", "_company", "_source")


def gaps(first: Column, first_of_source: Column) -> dict[str, Column]:
    """Days since the prior events; the first events of a day look back at `_company` and `_source`, others at their own day."""
    gap = lambda first, before: F.datediff("event_date", F.when(first, F.col(before)).otherwise(F.col("event_date")))
    return {"days_since_prior_company_event": gap(first, "_company"), "days_since_prior_source_event": gap(first_of_source, "_source")}


def event_flags() -> dict[str, Column]:
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    angle = F.month("event_date") * F.lit(2 * math.pi / 12)
    form = F.upper("form_type")
    return {
        "is_earnings_call": flag(F.col("event_source") == "earnings_call"), "is_sec_filing": flag(F.col("event_source") == "sec_filing"),
        "is_10k": flag(form == "10-K"), "is_10q": flag(form == "10-Q"),
        "fiscal_quarter": F.expr("try_cast(nullif(regexp_extract(fiscal_period, 'Q([1-4])', 1), '') AS INT)"),
        "event_month_sin": F.sin(angle), "event_month_cos": F.cos(angle),
    }


def with_priors(events: DataFrame, value: str) -> tuple[DataFrame, DataFrame]:
    """Calendar features and the prior value of `event_prior` from one sort of the events, and the distinct tickers and dates.

    Events of a source stand together within a day, so one window serves both priors. What a day's first events look back
    at is found among one row a day, ticker and source; the sorted events are written once.
    """
    keys = ("ticker", "event_source", "event_date")
    day = Window.partitionBy("ticker", "event_date").orderBy("event_source", "event_id")
    x = events.withColumns({"_n": F.row_number().over(day), "_same": F.lag(F.struct("event_source", F.col(value).alias("v"))).over(day), "_next": F.lead(F.struct("event_source")).over(day)})
    starts = lambda near: F.col(near).isNull() | ~F.col(f"{near}.event_source").eqNullSafe(F.col("event_source"))
    x = x.select(*events.columns, (F.col("_n") == 1).alias("_first"), starts("_same").alias("_first_of_source"), starts("_next").alias("_last"), F.col("_same.v").alias("_lag"))
    x = written(x, "events-in-order")
    earlier = lambda c, *by: F.lag(c).over(Window.partitionBy(*by).orderBy("event_date"))
    days = x.where("_last").select(*keys, F.col(value).alias("_v"))
    days = days.withColumns({"_source": earlier("event_date", "ticker", "event_source"), "_before": earlier("_v", "ticker", "event_source")}).drop("_v")
    dates = days.select("ticker", "event_date").distinct()
    days = written(joined(days, dates.withColumn("_company", earlier("event_date", "ticker")), ("ticker", "event_date")), "event-days")
    x = joined(x, few(days), keys)
    x = x.withColumns({**event_flags(), **gaps(F.col("_first"), F.col("_first_of_source")), f"{value}_prior": F.when(F.col("_first_of_source"), F.col("_before")).otherwise(F.col("_lag"))})
    return x.drop("_first", "_first_of_source", "_last", "_lag", "_source", "_before", "_company"), days.select("ticker", "event_date").distinct()


def feature_dataset(events: DataFrame, bars: DataFrame, results: DataFrame, items: DataFrame, horizon: int = 30, names: list[str] | None = None) -> DataFrame:
    """Labels joined with market state at the anchor, matched result, sentiment, topics and calendar.

    What depends on ticker and date, and what comes from texts, is made once a day and ticker, or once an event with
    texts, written, and joined last: broadcast where its rows are few. So events are sorted once, by few columns, and no wide
    rows of events are shuffled. Without any of `names` from the texts, their columns are left out.
    """
    return with_features(*events_in_order(events, items, names), bars, results, horizon)


#: What the label and all features of an event follow from, once its own columns are made: of an event with texts, its key and prior score too.
ALIKE = ["ticker", "event_source", "event_date", "is_10k", "is_10q", "fiscal_quarter", "days_since_prior_company_event", "days_since_prior_source_event", "text_key", "text_prior"]
EVENT_REST = [c for c in EVENT if c not in ALIKE]


def keyed(x: DataFrame, texts: DataFrame | None) -> DataFrame:
    """Events (event_key, ALIKE, and what else `with_features` reads) of `events_in_order`."""
    with_text = x.withColumn("text_key", F.lit(None).cast("string")) if texts is None else x.join(texts.select("event_key", F.col("event_key").alias("text_key")), "event_key", "left")
    prior = F.when(F.col("text_key").isNotNull(), F.col("sentiment_score_prior")).alias("text_prior")
    return with_text.select("event_key", *ALIKE[:-1], prior, *EVENT_REST, "sentiment_score")


def alike(x: DataFrame) -> DataFrame:
    """Of `keyed` events those that agree in ALIKE as one row, with their number (n); its event_key is that of their texts, if any.

    Events without texts have no more of these than days, sources and forms, however many there are.
    """
    one = x.groupBy(*ALIKE).agg(F.count(F.lit(1)).alias("n"), *(F.max(c).alias(c) for c in (*EVENT_REST, "sentiment_score")))
    return one.withColumns({"event_key": F.col("text_key"), "sentiment_score_prior": F.col("text_prior")})


def events_in_order(events: DataFrame, items: DataFrame, names: list[str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """Events with calendar features and prior score, their distinct tickers and dates, and the features of texts (None: not wanted)."""
    wanted = set(allowed() if names is None else names)
    texts = None
    if wanted & {*SENTIMENT, *TOPIC}:
        texts = event_sentiment(items)
        if wanted & set(TOPIC):
            texts = texts.join(topic_features(items), "event_key", "left")
        texts = few(written(texts, "text-features"), FEW_WIDE_ROWS)
    score = "sentiment_score"
    x = events.withColumn(score, F.lit(None).cast("double")) if texts is None else events.join(texts.select("event_key", score), "event_key", "left")
    return *with_priors(x, score), texts


def with_features(x: DataFrame, dates: DataFrame, texts: DataFrame | None, bars: DataFrame, results: DataFrame, horizon: int = 30) -> DataFrame:
    """Rows of `events_in_order`, or of `alike`, with label and features."""
    from meridian.plans.market_queries import eps_features

    score = "sentiment_score"
    at = ["ticker", "event_date", "anchor_trading_date"]
    days = date_labels(dates, bars, horizon)
    panel = market_panel(bars).select("ticker", F.col("trading_date").alias("anchor_trading_date"), *MARKET)
    matched = nearest_to_dates(days.select(*at).where("anchor_trading_date IS NOT NULL"), eps_features(results)).withColumnRenamed("earnings_date", "earnings_result_date")
    found = [c for c in matched.columns if c not in at]
    days = days.join(panel, ["ticker", "anchor_trading_date"], "left").join(matched, at, "left")
    days = few(written(days, "day-features"), FEW_WIDE_ROWS)
    call = F.col("event_source") == "earnings_call"
    x = at_dates(x, days).withColumns({c: F.when(call, F.col(c)) for c in found})
    if texts is None:
        return x.drop(score, f"{score}_prior")
    x = x.withColumn("sentiment_change_from_prior", F.col(score) - F.col(f"{score}_prior")).drop(score, f"{score}_prior")
    return x.join(texts, "event_key", "left")

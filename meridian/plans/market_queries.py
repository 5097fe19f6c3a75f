"""Sources, as-of joins, trailing windows, labels and market analytics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.numeric import r, ratio, rounded
from meridian.operators import asof, indicators
from meridian.operators.indicators import MARKET, by_ticker, full, lag_return
from meridian.operators.labels import forward_labels
from meridian.plans import oracle_views as v
from meridian.plans.registry import query

LONG = lambda c: F.col(c).cast("long").alias(c)


# joins


@query(
    "J1",
    """SELECT e.event_key, e.ticker, e.event_date, a.trading_date AS anchor_date, a.trading_date - e.event_date <= 7 AS near
  FROM anchored e LEFT JOIN sessions a ON a.ticker = e.ticker AND a.idx = e.anchor_idx""",
)
def j1(t):
    return asof.forward_anchor(t.corp_events, asof.number_sessions(t.bars_daily)).select("event_key", "ticker", "event_date", "anchor_date", "near")


@query(
    "J2",
    """SELECT a.ticker, a.trading_date, b.trading_date AS offset_date, b.adjusted_close AS offset_close
  FROM sessions a JOIN sessions b ON a.ticker = b.ticker AND b.idx = a.idx + 10""",
)
def j2(t):
    s = asof.number_sessions(t.bars_daily)
    later = s.select("ticker", (F.col("idx") - 10).alias("idx"), F.col("trading_date").alias("offset_date"), F.col("adjusted_close").alias("offset_close"))
    return s.join(later, ["ticker", "idx"]).select("ticker", "trading_date", "offset_date", "offset_close")


@query(
    "J3",
    """SELECT e.event_key, e.ticker, s.trading_date AS asof_date, s.adjusted_close AS asof_close
  FROM corp_events e ASOF LEFT JOIN sessions s ON e.ticker = s.ticker AND e.event_date >= s.trading_date""",
)
def j3(t):
    return asof.backward(t.corp_events, asof.number_sessions(t.bars_daily), "event_date").select("event_key", "ticker", "asof_date", "asof_close")


v.oracle_view(
    "eps_features",
    """SELECT *, sign(eps_surprise_pct) AS eps_surprise_direction, lag(eps_surprise_pct) OVER (PARTITION BY ticker ORDER BY earnings_date) AS prior_eps_surprise_pct,
  eps_surprise_pct - lag(eps_surprise_pct) OVER (PARTITION BY ticker ORDER BY earnings_date) AS eps_surprise_change FROM eps_results WHERE reported_eps IS NOT NULL""",
)
v.oracle_view(
    "eps_match",
    """SELECT * FROM (SELECT l.event_key, e.*, abs(e.earnings_date - l.event_date) AS match_days,
    row_number() OVER (PARTITION BY l.event_key ORDER BY abs(e.earnings_date - l.event_date), e.earnings_date DESC) AS n
  FROM labels30 l JOIN eps_features e ON e.ticker = l.ticker AND abs(e.earnings_date - l.event_date) <= 3 AND e.earnings_date <= l.anchor_trading_date
  WHERE l.event_source = 'earnings_call') WHERE n = 1""",
)
EPS = ("eps_estimate", "reported_eps", "eps_surprise", "eps_surprise_pct", "eps_surprise_direction", "prior_eps_surprise_pct", "eps_surprise_change")


def eps_features(results: DataFrame) -> DataFrame:
    """Announced results with the prior one's surprise, the change and the direction."""
    order = Window.partitionBy("ticker").orderBy("earnings_date")
    prior = F.lag("eps_surprise_pct").over(order)
    return results.where("reported_eps IS NOT NULL").select(
        "*", F.signum("eps_surprise_pct").alias("eps_surprise_direction"), prior.alias("prior_eps_surprise_pct"), (F.col("eps_surprise_pct") - prior).alias("eps_surprise_change")
    )


@query("J4", f"SELECT event_key, earnings_date, CAST(match_days AS INT) AS match_days, {', '.join(f'{r(c)} AS {c}' for c in EPS)} FROM eps_match")
def j4(t):
    found = asof.nearest_result(forward_labels(t.corp_events, t.bars_daily), eps_features(t.eps_results))
    return found.select("event_key", "earnings_date", F.col("match_days").cast("int"), *(rounded(c).alias(c) for c in EPS))


@query(
    "J5",
    f"""SELECT l.event_key, l.anchor_trading_date, {r('p.return_1d')} AS return_1d, {r('p.momentum_21d')} AS momentum_21d, {r('p.beta_63d')} AS beta_63d
  FROM labels30 l LEFT JOIN panel p ON p.ticker = l.ticker AND p.trading_date = l.anchor_trading_date""",
)
def j5(t):
    panel = indicators.market_panel(t.bars_daily).withColumnRenamed("trading_date", "anchor_trading_date")
    out = forward_labels(t.corp_events, t.bars_daily).join(panel, ["ticker", "anchor_trading_date"], "left")
    return out.select("event_key", "anchor_trading_date", *(rounded(c).alias(c) for c in ("return_1d", "momentum_21d", "beta_63d")))


@query(
    "J6",
    f"""SELECT a.ticker, a.trading_date, {r('a.adjusted_close')} AS close, {r('b.adjusted_close')} AS benchmark_close
  FROM bars_daily a LEFT JOIN bars_daily b ON b.ticker = 'SPY' AND b.trading_date = a.trading_date WHERE a.ticker <> 'SPY'""",
)
def j6(t):
    bench = t.bars_daily.where("ticker = 'SPY'").select("trading_date", F.col("adjusted_close").alias("benchmark_close"))
    out = t.bars_daily.where("ticker <> 'SPY'").join(F.broadcast(bench), "trading_date", "left")
    return out.select("ticker", "trading_date", rounded("adjusted_close").alias("close"), rounded("benchmark_close").alias("benchmark_close"))


@query("J10", "SELECT count(*) AS rows_without_benchmark FROM bars_daily a WHERE ticker <> 'SPY' AND NOT EXISTS (SELECT 1 FROM bars_daily b WHERE b.ticker = 'SPY' AND b.trading_date = a.trading_date)")
def j10(t):
    bench = t.bars_daily.where("ticker = 'SPY'").select("trading_date")
    return t.bars_daily.where("ticker <> 'SPY'").join(bench, "trading_date", "left_anti").agg(F.count(F.lit(1)).alias("rows_without_benchmark"))


@query(
    "J11",
    """WITH c AS (SELECT DISTINCT trading_date FROM bars_weekly) SELECT c.trading_date, p.ticker, p.event_key, p.prediction
  FROM predictions p JOIN c ON c.trading_date >= p.feature_as_of_date AND c.trading_date < p.target_trading_date""",
)
def j11(t):
    calendar = asof.number_calendar(t.bars_weekly)
    return asof.active_on(t.predictions, calendar, "feature_as_of_date", "target_trading_date").select("trading_date", "ticker", "event_key", "prediction")


@query(
    "J17",
    """SELECT c.ticker, c.sector, coalesce(k.calls, 0) AS calls, coalesce(f.filings, 0) AS filings, coalesce(b.sessions, 0) AS sessions, k.last_call, f.last_filing
  FROM companies c LEFT JOIN (SELECT ticker, count(*) AS calls, max(event_date) AS last_call FROM corp_events WHERE event_source = 'earnings_call' GROUP BY ticker) k ON k.ticker = c.ticker
  LEFT JOIN (SELECT ticker, count(*) AS filings, max(event_date) AS last_filing FROM corp_events WHERE event_source = 'sec_filing' GROUP BY ticker) f ON f.ticker = c.ticker
  LEFT JOIN (SELECT ticker, count(*) AS sessions FROM bars_daily GROUP BY ticker) b ON b.ticker = c.ticker""",
)
def j17(t):
    part = lambda source, n, last: t.corp_events.where(F.col("event_source") == source).groupBy("ticker").agg(F.count(F.lit(1)).alias(n), F.max("event_date").alias(last))
    sessions = t.bars_daily.groupBy("ticker").agg(F.count(F.lit(1)).alias("sessions"))
    out = t.companies.join(part("earnings_call", "calls", "last_call"), "ticker", "left").join(part("sec_filing", "filings", "last_filing"), "ticker", "left").join(sessions, "ticker", "left")
    return out.na.fill(0, ["calls", "filings", "sessions"]).select("ticker", "sector", "calls", "filings", "sessions", "last_call", "last_filing")


# windows


def prices(t):
    return t.bars_daily.select("ticker", "trading_date", "adjusted_close", "volume")


@query("W1", f"SELECT ticker, trading_date, {r('return_1d')} AS return_1d FROM returns1")
def w1(t):
    return prices(t).select("ticker", "trading_date", rounded(lag_return()).alias("return_1d"))


@query("W2", f"SELECT ticker, trading_date, {', '.join(f'{r(v.lagged(n))} AS momentum_{n}d' for n in (5, 21, 63, 126))} FROM bars_daily")
def w2(t):
    return prices(t).select("ticker", "trading_date", *(rounded(lag_return(n)).alias(f"momentum_{n}d") for n in (5, 21, 63, 126)))


def panel_columns(key: str, *names: str) -> None:
    """A query that gives some columns of the panel; Spark prunes the others."""

    @query(key, f"SELECT ticker, trading_date, {', '.join(f'{r(n)} AS {n}' for n in names)} FROM panel")
    def run(t):
        return indicators.market_panel(t.bars_daily).select("ticker", "trading_date", *(rounded(n).alias(n) for n in names))


panel_columns("W3", "volatility_21d", "volatility_63d")
panel_columns("W4", "sma_ratio_20d", "sma_ratio_50d", "sma_ratio_126d")
panel_columns("W5", "volume_ratio_20d", "volume_zscore_20d")
panel_columns("W6", "drawdown_126d")
panel_columns("W7", "beta_63d")
panel_columns("W8", *MARKET)


@query(
    "W9",
    f"""SELECT ticker, max(trading_date) FILTER (n = 1) AS latest_date, {r('max(adjusted_close) FILTER (n = 1)')} AS latest, {r('max(adjusted_close) FILTER (n = 2)')} AS previous,
  {r('max(adjusted_close) FILTER (n = 1) / max(adjusted_close) FILTER (n = 2) - 1')} AS return_1d
  FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trading_date DESC) AS n FROM bars_daily) WHERE n <= 2 GROUP BY ticker""",
)
def w9(t):
    return latest_two(t.bars_daily).select("ticker", "latest_date", rounded("latest").alias("latest"), rounded("previous").alias("previous"), rounded("return_1d").alias("return_1d"))


def latest_two(bars: DataFrame) -> DataFrame:
    newest = Window.partitionBy("ticker").orderBy(F.desc("trading_date"))
    two = bars.withColumn("n", F.row_number().over(newest)).where("n <= 2")
    pick = lambda c, n: F.max(F.when(F.col("n") == n, F.col(c)))
    out = two.groupBy("ticker").agg(pick("trading_date", 1).alias("latest_date"), pick("adjusted_close", 1).alias("latest"), pick("adjusted_close", 2).alias("previous"))
    return out.withColumn("return_1d", ratio("latest", "previous") - 1)


@query(
    "W10",
    """SELECT ticker, event_source, event_key, event_date FROM (SELECT *, row_number() OVER (PARTITION BY ticker, event_source ORDER BY event_date DESC, event_key DESC) AS n FROM corp_events) WHERE n = 1""",
)
def w10(t):
    newest = F.max_by(F.struct("event_key", "event_date"), F.struct("event_date", "event_key")).alias("x")
    return t.corp_events.groupBy("ticker", "event_source").agg(newest).select("ticker", "event_source", "x.event_key", "x.event_date")


PRIOR = "ORDER BY event_date, event_source, event_id"


@query(
    "W11",
    f"""SELECT event_key, CAST(event_date - lag(event_date) OVER (PARTITION BY ticker {PRIOR}) AS INT) AS days_since_prior_company_event,
  CAST(event_date - lag(event_date) OVER (PARTITION BY ticker, event_source {PRIOR}) AS INT) AS days_since_prior_source_event FROM corp_events""",
)
def w11(t):
    return with_spacing(t.corp_events).select("event_key", "days_since_prior_company_event", "days_since_prior_source_event")


def with_spacing(events: DataFrame) -> DataFrame:
    order = ("event_date", "event_source", "event_id")
    gap = lambda *keys: F.datediff("event_date", F.lag("event_date").over(Window.partitionBy(*keys).orderBy(*order)))
    return events.withColumns({"days_since_prior_company_event": gap("ticker"), "days_since_prior_source_event": gap("ticker", "event_source")})


@query("W12", f"SELECT ticker, earnings_date, {r('prior_eps_surprise_pct')} AS prior_eps_surprise_pct, {r('eps_surprise_change')} AS eps_surprise_change, eps_surprise_direction + 0.0::DOUBLE AS eps_surprise_direction FROM eps_features")
def w12(t):
    return eps_features(t.eps_results).select("ticker", "earnings_date", rounded("prior_eps_surprise_pct").alias("prior_eps_surprise_pct"), rounded("eps_surprise_change").alias("eps_surprise_change"), "eps_surprise_direction")


v.oracle_view(
    "next_returns",
    """SELECT a.ticker, a.trading_date, c.nd AS next_date, b.adjusted_close / a.adjusted_close - 1 AS next_return
  FROM bars_weekly a JOIN (SELECT trading_date, lead(trading_date) OVER (ORDER BY trading_date) AS nd FROM (SELECT DISTINCT trading_date FROM bars_weekly)) c ON c.trading_date = a.trading_date
  LEFT JOIN bars_weekly b ON b.ticker = a.ticker AND b.trading_date = c.nd""",
)


@query("W15", f"SELECT ticker, trading_date, next_date, {r('next_return')} AS next_return FROM next_returns")
def w15(t):
    from meridian.operators.portfolio import next_session_returns

    return next_session_returns(t.bars_weekly).select("ticker", "trading_date", "next_date", rounded("next_return").alias("next_return"))


# labels


LABEL_COLUMNS = ("event_key", "ticker", "event_source", "event_date", "anchor_trading_date", "target_trading_date", "target_available", "target_error")
RETURNS = ("stock_return", "benchmark_return", "excess_return")


@query("C1", f"SELECT {', '.join(LABEL_COLUMNS)}, {', '.join(f'{r(c)} AS {c}' for c in RETURNS)} FROM labels30")
def c1(t):
    return forward_labels(t.corp_events, t.bars_daily).select(*LABEL_COLUMNS, *(rounded(c).alias(c) for c in RETURNS))


v.oracle_view(
    "horizon_audit",
    """SELECT e.event_key, e.event_source, e.event_date, a.trading_date AS anchor_date, t.trading_date AS target_date,
    CASE WHEN e.event_date IS NULL THEN 'missing_event_date' WHEN a.trading_date IS NULL THEN 'missing_post_event_anchor' WHEN a.trading_date - e.event_date > 7 THEN 'missing_near_event_anchor'
         WHEN t.trading_date IS NULL THEN 'incomplete_forward_window' END AS reason
  FROM anchored e LEFT JOIN sessions a ON a.ticker = e.ticker AND a.idx = e.anchor_idx LEFT JOIN sessions t ON t.ticker = e.ticker AND t.idx = e.anchor_idx + 30""",
)


def horizon_audit(events: DataFrame, bars: DataFrame, horizon: int = 30) -> DataFrame:
    """Whether a full forward window exists for each event, without prices or benchmark."""
    s = asof.number_sessions(bars.where("ticker <> 'SPY'"))
    later = s.select("ticker", (F.col("idx") - horizon).alias("anchor_idx"), F.col("trading_date").alias("target_date"))
    x = asof.forward_anchor(events, s).join(later, ["ticker", "anchor_idx"], "left")
    reason = F.when(F.col("event_date").isNull(), "missing_event_date").when(F.col("anchor_date").isNull(), "missing_post_event_anchor").when(~F.col("near"), "missing_near_event_anchor").when(F.col("target_date").isNull(), "incomplete_forward_window")
    return x.withColumn("reason", reason)


@query("C2", "SELECT event_key, anchor_date, target_date, reason FROM horizon_audit")
def c2(t):
    return horizon_audit(t.corp_events, t.bars_daily).select("event_key", "anchor_date", "target_date", "reason")


@query(
    "C3",
    """SELECT count(*) - count(DISTINCT event_key) AS duplicate_keys, count(*) FILTER (anchor_trading_date <= event_date) AS anchor_not_after_event,
  count(*) FILTER (target_trading_date <= anchor_trading_date) AS target_not_after_anchor, count(*) FILTER (target_available AND excess_return IS NULL) AS missing_labels FROM labels30""",
)
def c3(t):
    return label_invariants(forward_labels(t.corp_events, t.bars_daily))


def label_invariants(labels: DataFrame) -> DataFrame:
    """One row of violation counts; all must be 0."""
    return labels.agg(
        (F.count(F.lit(1)) - F.countDistinct("event_key")).alias("duplicate_keys"),
        F.count_if(F.col("anchor_trading_date") <= F.col("event_date")).alias("anchor_not_after_event"),
        F.count_if(F.col("target_trading_date") <= F.col("anchor_trading_date")).alias("target_not_after_anchor"),
        F.count_if(F.col("target_available") & F.col("excess_return").isNull()).alias("missing_labels"),
    )


# snapshots

SPANS = {"1M": 30, "3M": 90, "1Y": 365, "5Y": 1825}
v.oracle_view(
    "trailing_returns",
    "SELECT l.ticker, w.span, p.trading_date AS start_date, l.adjusted_close / p.adjusted_close - 1 AS ret FROM (SELECT ticker, max(trading_date) AS d, arg_max(adjusted_close, trading_date) AS adjusted_close FROM bars_daily GROUP BY ticker) l "
    "CROSS JOIN (VALUES ('1M', 30), ('3M', 90), ('1Y', 365), ('5Y', 1825)) w(span, days) ASOF LEFT JOIN sessions p ON p.ticker = l.ticker AND l.d - CAST(w.days AS INT) >= p.trading_date",
)


def trailing_returns(bars: DataFrame) -> DataFrame:
    """Return from the latest session on or before each calendar span's start to the last session."""
    last = bars.groupBy("ticker").agg(F.max("trading_date").alias("last_date"), F.max_by("adjusted_close", "trading_date").alias("last_close"))
    spans = F.explode(F.array(*(F.struct(F.lit(k).alias("span"), F.lit(d).alias("days")) for k, d in SPANS.items()))).alias("w")
    points = last.select("ticker", "last_close", "last_date", spans).select("ticker", "last_close", "w.span", F.date_sub("last_date", F.col("w.days")).alias("from_date"))
    return asof.backward(points, asof.number_sessions(bars), "from_date").withColumn("ret", ratio("last_close", "asof_close") - 1)


@query("C6", f"SELECT ticker, span, start_date, {r('ret')} AS ret FROM trailing_returns")
def c6(t):
    return trailing_returns(t.bars_daily).select("ticker", "span", F.col("asof_date").alias("start_date"), rounded("ret").alias("ret"))


@query("C7", f"SELECT a.ticker, a.span, {r('a.ret - b.ret')} AS relative FROM trailing_returns a JOIN trailing_returns b ON b.ticker = 'SPY' AND b.span = a.span WHERE a.ticker <> 'SPY'")
def c7(t):
    x = trailing_returns(t.bars_daily).select("ticker", "span", "ret")
    bench = x.where("ticker = 'SPY'").select("span", F.col("ret").alias("bench"))
    return x.where("ticker <> 'SPY'").join(F.broadcast(bench), "span").select("ticker", "span", rounded(F.col("ret") - F.col("bench")).alias("relative"))


v.oracle_view(
    "realised",
    """SELECT ticker, CASE WHEN count(x) >= 2 THEN stddev_samp(x) * sqrt(252.0) END AS volatility FROM (
    SELECT ticker, n, CASE WHEN px > 0 AND prev > 0 THEN px / prev - 1 END AS x FROM (
      SELECT ticker, adjusted_close AS px, lag(adjusted_close) OVER (PARTITION BY ticker ORDER BY trading_date) AS prev, row_number() OVER (PARTITION BY ticker ORDER BY trading_date DESC) AS n FROM bars_daily))
  WHERE n <= 252 GROUP BY ticker""",
)


def realised_volatility(bars: DataFrame) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("trading_date")))
    prev = F.lag("adjusted_close").over(by_ticker())
    x = bars.select("ticker", newest.alias("n"), F.when((F.col("adjusted_close") > 0) & (prev > 0), ratio(F.col("adjusted_close"), prev) - 1).alias("x")).where("n <= 252")
    return x.groupBy("ticker").agg(F.when(F.count("x") >= 2, F.stddev_samp("x") * F.sqrt(F.lit(252.0))).alias("volatility"))


@query("C8", f"SELECT ticker, {r('volatility')} AS volatility FROM realised")
def c8(t):
    return realised_volatility(t.bars_daily).select("ticker", rounded("volatility").alias("volatility"))


v.oracle_view("recent_volume", "SELECT ticker, avg(volume) AS average_volume FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trading_date DESC) AS n FROM bars_daily) WHERE n <= 30 GROUP BY ticker")


def recent_volume(bars: DataFrame) -> DataFrame:
    newest = F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("trading_date")))
    return bars.withColumn("n", newest).where("n <= 30").groupBy("ticker").agg(F.avg("volume").alias("average_volume"))


@query("C9", f"SELECT ticker, {r('average_volume', 4)} AS average_volume FROM recent_volume")
def c9(t):
    return recent_volume(t.bars_daily).select("ticker", rounded("average_volume", 4).alias("average_volume"))


@query(
    "C10",
    f"""SELECT b.ticker, b.n AS sessions, b.d AS last_date, {r('b.px')} AS last_close, {', '.join(f"{r(f'x{k}')} AS return_{k}" for k in SPANS)}, {r('v.volatility')} AS volatility, {r('a.average_volume', 4)} AS average_volume
  FROM (SELECT ticker, count(*) AS n, max(trading_date) AS d, arg_max(adjusted_close, trading_date) AS px FROM bars_daily GROUP BY ticker) b
  JOIN (SELECT ticker, {', '.join(f"max(ret) FILTER (span = '{k}') AS x{k}" for k in SPANS)} FROM trailing_returns GROUP BY ticker) r USING (ticker)
  JOIN realised v USING (ticker) JOIN recent_volume a USING (ticker)""",
)
def c10(t):
    return ticker_snapshot(t.bars_daily)


def ticker_snapshot(bars: DataFrame) -> DataFrame:
    """Latest price, trailing returns, volatility and volume of every ticker; all parts share the ticker's partitioning."""
    base = bars.groupBy("ticker").agg(F.count(F.lit(1)).alias("sessions"), F.max("trading_date").alias("last_date"), F.max_by("adjusted_close", "trading_date").alias("last_close"))
    wide = trailing_returns(bars).groupBy("ticker").agg(*(F.max(F.when(F.col("span") == k, F.col("ret"))).alias(f"return_{k}") for k in SPANS))
    out = base.join(wide, "ticker").join(realised_volatility(bars), "ticker").join(recent_volume(bars), "ticker")
    return out.select("ticker", "sessions", "last_date", *(rounded(c).alias(c) for c in ("last_close", *(f"return_{k}" for k in SPANS), "volatility")), rounded("average_volume", 4).alias("average_volume"))


@query(
    "C11",
    f"""SELECT e.event_key, b.trading_date AS baseline_date, {r('s1.adjusted_close / b.adjusted_close - 1')} AS reaction_1d, {r('s5.adjusted_close / b.adjusted_close - 1')} AS reaction_5d
  FROM anchored e LEFT JOIN sessions b ON b.ticker = e.ticker AND b.idx = e.anchor_idx - 1 LEFT JOIN sessions s1 ON s1.ticker = e.ticker AND s1.idx = b.idx + 1 LEFT JOIN sessions s5 ON s5.ticker = e.ticker AND s5.idx = b.idx + 5""",
)
def c11(t):
    return event_reactions(t.corp_events, t.bars_daily).select("event_key", "baseline_date", rounded("reaction_1d").alias("reaction_1d"), rounded("reaction_5d").alias("reaction_5d"))


def event_reactions(events: DataFrame, bars: DataFrame) -> DataFrame:
    """Returns 1 and 5 sessions after the last session on or before each event."""
    ahead = lambda n: F.lead("adjusted_close", n).over(by_ticker())
    s = asof.number_sessions(bars)
    moves = s.select("ticker", "idx", F.col("trading_date").alias("baseline_date"), *((ratio(ahead(n), F.col("adjusted_close")) - 1).alias(f"reaction_{n}d") for n in (1, 5)))
    return asof.last_index(events, s, "event_date").join(moves, ["ticker", "idx"], "left")


v.oracle_view("indexed", "SELECT ticker, trading_date, adjusted_close / first_value(adjusted_close) OVER (PARTITION BY ticker ORDER BY trading_date) * 100 AS value, row_number() OVER (PARTITION BY ticker ORDER BY trading_date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM bars_daily")


def indexed_series(bars: DataFrame) -> DataFrame:
    """Price over the first price, times 100."""
    first = F.first("adjusted_close").over(by_ticker().rowsBetween(Window.unboundedPreceding, 0))
    return bars.select("ticker", "trading_date", (ratio(F.col("adjusted_close"), first) * 100).alias("value"))


@query("F15", f"SELECT ticker, trading_date, {r('value')} AS value FROM indexed")
def f15(t):
    return indexed_series(t.bars_daily).select("ticker", "trading_date", rounded("value").alias("value"))


def evenly_spaced(rows: DataFrame, keys: list[str], order: list[str], points: int, half_even: bool = True) -> DataFrame:
    """At most `points` rows of each key, evenly spaced, with the first and the last."""
    w = Window.partitionBy(*keys)
    x = rows.withColumns({"_i": F.row_number().over(w.orderBy(*order)) - 1, "_n": F.count(F.lit(1)).over(w)})
    at = F.col("_p") * (F.col("_n") - 1) / (points - 1)
    wanted = x.select(*keys, "_n").distinct().where(F.col("_n") > points).withColumn("_p", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    wanted = wanted.select(*keys, (F.bround(at, 0) if half_even else F.floor(at)).cast("int").alias("_i")).distinct()
    short = x.where(F.col("_n") <= points)
    return short.unionByName(x.where(F.col("_n") > points).join(wanted, [*keys, "_i"], "left_semi").select(*short.columns)).drop("_i", "_n")


#: Greatest number of points of a chart.
POINTS = 420
SPACED = "SELECT ticker, trading_date, value FROM indexed WHERE n <= {m} OR i IN (SELECT CAST(round_even(p * (n - 1) / CAST({m1} AS DOUBLE), 0) AS INT) FROM range({m}) x(p))"


@query("K5", f"SELECT ticker, trading_date, {r('value')} AS value FROM ({SPACED.format(m=POINTS, m1=POINTS - 1)})")
def k5(t):
    return evenly_spaced(indexed_series(t.bars_daily), ["ticker"], ["trading_date"], POINTS).select("ticker", "trading_date", rounded("value").alias("value"))


@query(
    "C12",
    f"""WITH top AS (SELECT ticker FROM (SELECT ticker, count(*) AS n FROM bars_daily WHERE ticker <> 'SPY' GROUP BY ticker) ORDER BY n DESC, ticker LIMIT 4),
  primary_ AS (SELECT max(trading_date) AS d FROM bars_daily WHERE ticker = (SELECT min(ticker) FROM top)),
  w AS (SELECT ticker, trading_date, adjusted_close FROM bars_daily, primary_ WHERE (ticker = 'SPY' OR ticker IN (SELECT ticker FROM top)) AND trading_date BETWEEN d - 365 AND d),
  x AS (SELECT ticker, trading_date, adjusted_close / first_value(adjusted_close) OVER (PARTITION BY ticker ORDER BY trading_date) * 100 AS value, row_number() OVER (PARTITION BY ticker ORDER BY trading_date) - 1 AS i, count(*) OVER (PARTITION BY ticker) AS n FROM w),
  k AS (SELECT ticker, trading_date, value FROM x WHERE n <= {POINTS} OR i IN (SELECT CAST(round_even(p * (n - 1) / CAST({POINTS - 1} AS DOUBLE), 0) AS INT) FROM range({POINTS}) y(p)))
  SELECT k.ticker, k.trading_date, {r('k.value')} AS value, coalesce(e.events, 0) AS events FROM k LEFT JOIN (SELECT ticker, event_date, count(*) AS events FROM corp_events GROUP BY ticker, event_date) e ON e.ticker = k.ticker AND e.event_date = k.trading_date""",
)
def c12(t):
    bars = t.bars_daily
    top = bars.where("ticker <> 'SPY'").groupBy("ticker").count().orderBy(F.desc("count"), "ticker").limit(4).select("ticker")
    scope = top.union(t.spark.createDataFrame([("SPY",)], "ticker string"))
    last = bars.join(F.broadcast(top.agg(F.min("ticker").alias("ticker"))), "ticker").agg(F.max("trading_date").alias("d"))
    window = bars.join(F.broadcast(scope), "ticker").join(F.broadcast(last), F.col("trading_date").between(F.date_sub("d", 365), F.col("d")))
    series = evenly_spaced(indexed_series(window), ["ticker"], ["trading_date"], POINTS)
    dated = t.corp_events.groupBy("ticker", F.col("event_date").alias("trading_date")).agg(F.count(F.lit(1)).alias("events"))
    out = series.join(dated, ["ticker", "trading_date"], "left")
    return out.select("ticker", "trading_date", rounded("value").alias("value"), F.coalesce("events", F.lit(0)).alias("events"))

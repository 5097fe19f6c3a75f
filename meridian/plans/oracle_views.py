"""Plain SQL of what the operators derive at run time, for the DuckDB queries."""

from meridian.functions.numeric import r
from meridian.operators.indicators import MARKET
from meridian.plans.registry import oracle_view

oracle_view("sessions", "SELECT ticker, trading_date, adjusted_close, volume, row_number() OVER (PARTITION BY ticker ORDER BY trading_date) AS idx FROM bars_daily")
oracle_view("anchored", "SELECT e.*, coalesce(s.idx, 0) + 1 AS anchor_idx FROM corp_events e ASOF LEFT JOIN sessions s ON e.ticker = s.ticker AND e.event_date >= s.trading_date")


def labels_sql(h: int) -> str:
    return f"""
  SELECT *, CASE WHEN target_error IS NULL THEN tc / ac - 1 END AS stock_return, CASE WHEN target_error IS NULL THEN bt / ba - 1 END AS benchmark_return,
         CASE WHEN target_error IS NULL THEN (tc / ac - 1) - (bt / ba - 1) END AS excess_return, target_error IS NULL AS target_available
  FROM (SELECT e.event_key, e.event_source, e.event_id, e.ticker, e.event_date, e.form_type, e.fiscal_period, a.trading_date AS anchor_trading_date,
      CASE WHEN a.trading_date - e.event_date <= 7 THEN t.trading_date END AS target_trading_date, a.adjusted_close AS ac, t.adjusted_close AS tc, p.adjusted_close AS ba, q.adjusted_close AS bt,
      CASE WHEN e.event_date IS NULL THEN 'missing_event_date' WHEN NOT EXISTS (SELECT 1 FROM sessions k WHERE k.ticker = e.ticker) THEN 'missing_ticker_prices'
           WHEN a.trading_date IS NULL THEN 'missing_post_event_anchor' WHEN a.trading_date - e.event_date > 7 THEN 'missing_near_event_anchor'
           WHEN t.trading_date IS NULL THEN 'incomplete_forward_window' WHEN p.trading_date IS NULL OR q.trading_date IS NULL THEN 'missing_benchmark_dates'
           WHEN coalesce(least(a.adjusted_close, 1e300) <= 0 OR t.adjusted_close <= 0 OR p.adjusted_close <= 0 OR q.adjusted_close <= 0, TRUE) THEN 'invalid_adjusted_close' END AS target_error
    FROM anchored e LEFT JOIN sessions a ON a.ticker = e.ticker AND a.idx = e.anchor_idx
    LEFT JOIN sessions t ON t.ticker = e.ticker AND t.idx = e.anchor_idx + {h}
    LEFT JOIN sessions p ON p.ticker = 'SPY' AND p.trading_date = a.trading_date LEFT JOIN sessions q ON q.ticker = 'SPY' AND q.trading_date = t.trading_date)"""


oracle_view("labels30", labels_sql(30))
oracle_view("labels10", labels_sql(10))

W = "OVER (PARTITION BY ticker ORDER BY trading_date)"


def frame(agg: str, x: str, n: int) -> str:
    w = f"OVER (PARTITION BY ticker ORDER BY trading_date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({x}) {w} = {n} THEN {agg}({x}) {w} END"


def lagged(n: int) -> str:
    return f"adjusted_close / lag(adjusted_close, {n}) {W} - 1"


oracle_view("returns1", f"SELECT *, {lagged(1)} AS return_1d FROM bars_daily")
oracle_view(
    "own_panel",
    f"""SELECT ticker, trading_date, adjusted_close, volume, return_1d,
  {', '.join(f'{lagged(n)} AS momentum_{n}d' for n in (5, 21, 63, 126))},
  {', '.join(f'({frame("stddev_samp", "return_1d", n)}) * sqrt(252.0) AS volatility_{n}d' for n in (21, 63))},
  {', '.join(f'adjusted_close / ({frame("avg", "adjusted_close", n)}) - 1 AS sma_ratio_{n}d' for n in (20, 50, 126))},
  volume / ({frame("avg", "volume", 20)}) AS volume_ratio_20d,
  (volume - ({frame("avg", "volume", 20)})) / nullif({frame("stddev_samp", "volume", 20)}, 0) AS volume_zscore_20d,
  adjusted_close / ({frame("max", "adjusted_close", 126)}) - 1 AS drawdown_126d FROM returns1""",
)
oracle_view(
    "joined_panel",
    """SELECT p.*, b.return_1d AS spy_return_1d, b.momentum_21d AS spy_momentum_21d, b.momentum_63d AS spy_momentum_63d, b.volatility_21d AS spy_volatility_21d
  FROM own_panel p LEFT JOIN own_panel b ON b.ticker = 'SPY' AND b.trading_date = p.trading_date""",
)
W63 = "OVER (PARTITION BY ticker ORDER BY trading_date ROWS BETWEEN 62 PRECEDING AND CURRENT ROW)"
oracle_view(
    "panel",
    f"""SELECT *, momentum_21d - spy_momentum_21d AS relative_momentum_21d, momentum_63d - spy_momentum_63d AS relative_momentum_63d,
  CASE WHEN count(CASE WHEN return_1d IS NOT NULL THEN spy_return_1d END) {W63} = 63 THEN covar_samp(return_1d, spy_return_1d) {W63} / nullif({frame("var_samp", "spy_return_1d", 63)}, 0) END AS beta_63d
  FROM joined_panel""",
)
PANEL_ROUNDED = ", ".join(f"{r(c)} AS {c}" for c in MARKET)

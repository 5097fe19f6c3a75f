"""Views over the driver's tables that feed the operators; the SQL runs on Spark and DuckDB alike."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meridian.sources.workspace import written

TABLES = frozenset("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split())

BINDINGS: dict[str, str] = {
    "bars_daily": """
WITH li AS (
  SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS trading_date, l_extendedprice / l_quantity AS px,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS ext, CAST(l_quantity AS DECIMAL(18,2)) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey),
 x AS (SELECT * FROM li UNION ALL SELECT 'SPY', trading_date, px, ext, qty FROM li)
SELECT ticker, trading_date,
       (min(px) + max(px)) / 2 AS open, max(px) AS high, min(px) AS low,
       CAST(sum(ext) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS close,
       CAST(sum(ext) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS adjusted_close,
       CAST(sum(qty) AS BIGINT) AS volume
  FROM x GROUP BY ticker, trading_date""",
    "bars_weekly": """
WITH li AS (
  SELECT p_type AS ticker, CAST(date_trunc('week', l_shipdate) AS DATE) AS trading_date, l_extendedprice / l_quantity AS px,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS ext, CAST(l_quantity AS DECIMAL(18,2)) AS qty
  FROM lineitem JOIN part ON l_partkey = p_partkey),
 x AS (SELECT * FROM li UNION ALL SELECT 'SPY', trading_date, px, ext, qty FROM li)
SELECT ticker, trading_date,
       (min(px) + max(px)) / 2 AS open, max(px) AS high, min(px) AS low,
       CAST(sum(ext) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS close,
       CAST(sum(ext) AS DOUBLE) / CAST(sum(qty) AS DOUBLE) AS adjusted_close,
       CAST(sum(qty) AS BIGINT) AS volume
  FROM x GROUP BY ticker, trading_date""",
    "corp_events": """
WITH t AS (SELECT l_orderkey, min(p_brand) AS ticker
             FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey)
SELECT concat(CASE WHEN o_orderstatus = 'F' THEN 'sec_filing:' ELSE 'earnings_call:' END,
              CAST(o_orderkey AS STRING)) AS event_key,
       CASE WHEN o_orderstatus = 'F' THEN 'sec_filing' ELSE 'earnings_call' END AS event_source,
       CAST(o_orderkey AS STRING) AS event_id, ticker, CAST(o_orderdate AS DATE) AS event_date,
       CASE WHEN o_orderstatus = 'F' THEN
            CASE WHEN o_orderpriority = '1-URGENT' THEN '10-K' ELSE '10-Q' END END AS form_type,
       CASE WHEN o_orderstatus <> 'F' THEN
            concat(CAST(year(o_orderdate) AS STRING), 'Q', CAST(quarter(o_orderdate) AS STRING)) END AS fiscal_period
  FROM orders JOIN t ON o_orderkey = l_orderkey""",
    "eps_results": """
WITH r AS (SELECT p_brand AS ticker, CAST(l_shipdate AS DATE) AS earnings_date,
             min(p_retailprice) AS eps_estimate, min(l_extendedprice / l_quantity) AS reported_eps
        FROM lineitem JOIN part ON l_partkey = p_partkey
       WHERE l_linenumber = 1 GROUP BY p_brand, CAST(l_shipdate AS DATE))
SELECT ticker, earnings_date, eps_estimate, reported_eps,
       reported_eps - eps_estimate AS eps_surprise,
       (reported_eps - eps_estimate) / abs(eps_estimate) AS eps_surprise_pct
  FROM r""",
    "turns": """
SELECT conv_id AS transcript_id, turn AS turn_index, conv_id * 1000 + turn AS turn_id,
       concat('T', CAST(conv_id % 10 AS STRING)) AS ticker,
       CASE role WHEN 'system' THEN 'operator' WHEN 'user' THEN 'analyst' ELSE 'executive' END AS speaker_role,
       text AS content
  FROM conversations""",
    "turn_scores": """
SELECT turn_id,
       CASE WHEN speaker_role = 'operator' THEN 'SKIPPED' WHEN turn_id % 11 = 3 THEN 'FAILED' ELSE 'SCORED' END AS status,
       CASE WHEN speaker_role <> 'operator' AND turn_id % 11 <> 3
            THEN (length(content) % 201 - 100) / CAST(100 AS DOUBLE) END AS sentiment_score,
       CASE WHEN speaker_role <> 'operator' AND turn_id % 11 <> 3
            THEN (50 + length(content) % 51) / CAST(100 AS DOUBLE) END AS confidence,
       CAST(length(content) % 300 AS INT) AS token_count
  FROM turns WHERE turn_id % 7 <> 5""",
    "filing_chunks": """
SELECT doc_id AS chunk_id, source AS ticker,
       concat('acc-', CAST(doc_id % 40 AS STRING)) AS accession_number,
       CASE lang WHEN 'en' THEN '10-K' ELSE '10-Q' END AS form_type,
       CASE doc_id % 3 WHEN 0 THEN 'item_7_mda' WHEN 1 THEN 'item_1a_risk_factors'
                       ELSE 'item_8_financial_statements' END AS section_key,
       date_add(DATE '2020-01-01', CAST(doc_id % 40 AS INT) * 30) AS filing_date,
       text AS content, n_chars
  FROM documents""",
    "chunk_scores": """
SELECT l.doc_id AS chunk_id, 'SCORED' AS status,
       CAST(quality - toxic AS DOUBLE) AS sentiment_score,
       CASE WHEN quality = toxic THEN CAST(0.5 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END AS confidence,
       CAST(n_chars % 500 AS INT) AS token_count
  FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "companies": """
SELECT p_brand AS ticker, min(p_type) AS sector FROM part GROUP BY p_brand""",
    "chunk_vectors": """
SELECT vec_id AS chunk_id, concat('src', CAST(label AS STRING)) AS ticker,
       CASE WHEN vec_id % 2 = 0 THEN 'filings' ELSE 'transcripts' END AS corpus, embedding
  FROM embeddings""",
    "watchlist_items": """
SELECT CAST(1 + length(sector) % 3 AS INT) AS watchlist_id, ticker,
       date_add(DATE '2024-01-01', CAST(length(ticker) + length(sector) AS INT)) AS added_at
  FROM companies""",
    "stage_runs": """
SELECT user_id AS run_id, event_type AS stage,
       CASE WHEN max(value) > 180 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status,
       min(ts) AS started_at, max(ts) AS completed_at
  FROM events GROUP BY user_id, event_type""",
    "alerts_in": """
SELECT event_id, ts AS created_at, concat('T', CAST(user_id % 10 AS STRING)) AS ticker,
       CASE WHEN event_type IN ('purchase', 'signup') THEN 'filing' ELSE 'earnings' END AS event_type,
       concat('r', CAST(event_id % 700 AS STRING)) AS source_record_id
  FROM events""",
    "predictions": """
WITH cal AS (SELECT trading_date, row_number() OVER (ORDER BY trading_date) AS i
               FROM bars_weekly WHERE ticker = 'SPY'),
 t AS (SELECT DISTINCT ticker FROM bars_weekly WHERE ticker <> 'SPY')
SELECT concat(t.ticker, ':', CAST(a.i AS STRING)) AS event_key, t.ticker,
       CASE WHEN a.i % 2 = 0 THEN 'earnings_call' ELSE 'sec_filing' END AS event_source,
       a.trading_date AS feature_as_of_date, b.trading_date AS target_trading_date,
       ((a.i * 37 + length(t.ticker) * 11) % 97 - 48) / CAST(1000 AS DOUBLE) AS prediction,
       (p1.adjusted_close / p0.adjusted_close) - (s1.adjusted_close / s0.adjusted_close) AS actual
  FROM cal a JOIN cal b ON b.i = a.i + 6 CROSS JOIN t
  LEFT JOIN bars_weekly p0 ON p0.ticker = t.ticker AND p0.trading_date = a.trading_date
  LEFT JOIN bars_weekly p1 ON p1.ticker = t.ticker AND p1.trading_date = b.trading_date
  LEFT JOIN bars_weekly s0 ON s0.ticker = 'SPY' AND s0.trading_date = a.trading_date
  LEFT JOIN bars_weekly s1 ON s1.ticker = 'SPY' AND s1.trading_date = b.trading_date
 WHERE (a.i + length(t.ticker)) % 4 = 0""",
    "ledger": """
SELECT event_key, ticker, event_source, feature_as_of_date,
       feature_as_of_date AS prediction_generated_at, prediction AS predicted_excess_return,
       CAST(0 AS DOUBLE) AS baseline_predicted_excess_return,
       CASE WHEN target_trading_date < DATE '1999-06-01' THEN 'MATURED' ELSE 'PENDING' END AS status,
       CASE WHEN target_trading_date < DATE '1999-06-01' THEN target_trading_date END AS target_trading_date,
       CASE WHEN target_trading_date < DATE '1999-06-01' THEN actual END AS realized_excess_return
  FROM predictions WHERE feature_as_of_date <= DATE '1999-06-01'""",
    "eval_cases": """
SELECT b.item_id AS case_id, d.doc_id, d.source AS ticker, d.lang
  FROM benchmark b JOIN documents d ON contains(d.text, b.text)""",
}


def eval_cases(t: Tables) -> DataFrame:
    """The rows of the binding, found by an equi-join on windows of words instead of a nested loop."""
    docs, items = t.documents.select("doc_id", "text", "source", "lang"), t.benchmark.select("item_id", F.col("text").alias("wanted"))
    pairs = holding(docs.select("doc_id", "text"), items)
    x = pairs.join(items, "item_id").join(docs, "doc_id").where(F.contains("text", "wanted"))
    return x.select(F.col("item_id").alias("case_id"), "doc_id", F.col("source").alias("ticker"), "lang")


def bars(t: Tables, ticker: str, date: str) -> DataFrame:
    """The rows of the bindings of bars; the benchmark's are added up from those of the tickers, not from the line items again.

    Sums are of decimals, so they are the same in any order.
    """
    items = t.sql(
        f"""SELECT {ticker} AS ticker, CAST({date} AS DATE) AS trading_date, l_extendedprice / l_quantity AS px,
       CAST(l_extendedprice AS DECIMAL(18,2)) AS ext, CAST(l_quantity AS DECIMAL(18,2)) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey"""
    )
    of = lambda low, high, ext, qty: (F.min(low).alias("low"), F.max(high).alias("high"), F.sum(ext).alias("ext"), F.sum(qty).alias("qty"))
    own = items.groupBy("ticker", "trading_date").agg(*of("px", "px", "ext", "qty"))
    both = own.withColumn("ticker", F.explode(F.array("ticker", F.lit("SPY")))).groupBy("ticker", "trading_date").agg(*of("low", "high", "ext", "qty"))
    close = F.col("ext").cast("double") / F.col("qty").cast("double")
    return both.select(
        "ticker", "trading_date", ((F.col("low") + F.col("high")) / 2).alias("open"), "high", "low",
        close.alias("close"), close.alias("adjusted_close"), F.col("qty").cast("bigint").alias("volume"),
    )


#: Bindings whose rows are made by an operator, not by their SQL.
DERIVED = {
    "eval_cases": eval_cases,
    "bars_daily": lambda t: bars(t, "p_brand", "l_shipdate"),
    "bars_weekly": lambda t: bars(t, "p_type", "date_trunc('week', l_shipdate)"),
}


def holding(docs: DataFrame, items: DataFrame, size: int = 4) -> DataFrame:
    """Distinct (item_id, doc_id) where a document may contain an item's `wanted` text.

    The words between blanks of a contained text, but for its first and last, are words of the
    document in the same order; of an item the first `size` of these are looked up. An item of
    fewer than `size` + 2 words is compared with every document: such items are few and short.
    """
    cut = items.select("item_id", "wanted", F.split("wanted", " ").alias("w"))
    long = cut.where(F.size("w") >= size + 2).select("item_id", F.array_join(F.slice("w", 2, size), " ").alias("window"))
    w = F.transform(F.array(F.split("text", " ")), lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - size)), lambda i: F.array_join(F.slice(w, i + 1, size), " ")))[0]
    found = docs.select("doc_id", F.explode(F.array_distinct(w)).alias("window")).join(long, "window").select("item_id", "doc_id")
    short = cut.where(F.size("w") < size + 2).select("item_id", "wanted")
    return found.unionByName(docs.join(short, F.contains("text", "wanted")).select("item_id", "doc_id")).distinct()


def names_in(sql: str, known) -> list[str]:
    return [n for n in known if re.search(rf"(?<![\w.'])\b{n}\b", sql)]


class Tables:
    """Driver tables and bindings by attribute, as DataFrames."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir, self.made, self.kept = spark, sf_dir.rstrip("/"), {}, set()

    def __getattr__(self, name: str) -> DataFrame:
        made = self.__dict__["made"]
        if name not in made:
            if name in TABLES:
                made[name] = self.spark.read.parquet(f"{self.dir}/{name}.parquet")
            elif name in BINDINGS:
                if name == "predictions":  # six readings of the weekly bars
                    self.stored("bars_weekly")
                made[name] = DERIVED[name](self) if name in DERIVED else self.sql(BINDINGS[name])
            else:
                raise AttributeError(name)
        return made[name]

    def stored(self, *names: str) -> Tables:
        """Writes bindings once, for queries that use them several times; whatever is made of them afterwards reads these files."""
        for name in names:
            if name not in self.kept:
                self.made[name] = written(getattr(self, name), name)
                self.kept.add(name)
        return self

    def sql(self, query: str) -> DataFrame:
        """SQL over tables and bindings; names are resolved when this is called."""
        for name in names_in(query, [*TABLES, *BINDINGS]):
            getattr(self, name).createOrReplaceTempView(name)
        return self.spark.sql(query)

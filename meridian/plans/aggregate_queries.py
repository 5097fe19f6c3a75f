"""Joins on versions and backlogs, aggregations, sentiment summaries and set operations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.numeric import r, ratio, rounded
from meridian.functions.text import TOPICS, speaker_group
from meridian.operators import sentiment as sent
from meridian.operators.labels import forward_labels
from meridian.operators.metrics import exact_quantiles
from meridian.plans.market_queries import horizon_audit, label_invariants
from meridian.plans.registry import oracle_view, query
from meridian.plans.source_queries import items_of
from meridian.sources.bindings import TABLES
from meridian.sources.workspace import written


def n_rows():
    return F.count(F.lit(1))


def labels_of(t, horizon: int = 30) -> DataFrame:
    t.stored("corp_events", "bars_daily")
    return forward_labels(t.corp_events, t.bars_daily, horizon)


# versions and backlogs


@query("J7", "SELECT t.turn_id, t.transcript_id, s.status, s.sentiment_score, s.token_count FROM turns t LEFT JOIN turn_scores s ON s.turn_id = t.turn_id")
def j7(t):
    versions = t.turn_scores.withColumn("model_revision", F.lit("v2")).unionByName(t.turn_scores.withColumns({"model_revision": F.lit("v1"), "sentiment_score": F.lit(0.0)}))
    return versioned(t.turns, versions, "turn_id", "v2").select("turn_id", "transcript_id", "status", "sentiment_score", "token_count")


def versioned(items: DataFrame, scores: DataFrame, key: str, revision: str) -> DataFrame:
    """Left join on the key with the scores of one revision, which is chosen before the join."""
    return items.join(scores.where(F.col("model_revision") == revision).drop("model_revision"), key, "left")


@query("J8", "SELECT t.turn_id, s.status FROM turns t LEFT JOIN turn_scores s ON s.turn_id = t.turn_id WHERE s.turn_id IS NULL OR s.status = 'FAILED'")
def j8(t):
    return pending(t.turns, t.turn_scores, "turn_id", True).select("turn_id", "status")


def pending(items: DataFrame, scores: DataFrame, key: str, retry_failed: bool) -> DataFrame:
    """Items without a result, or also those whose result failed."""
    if not retry_failed:
        return items.join(scores, key, "left_anti").withColumn("status", F.lit(None).cast("string"))
    return items.join(scores.select(key, "status"), key, "left").where("status IS NULL OR status = 'FAILED'")


@query("J9", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT chunk_id FROM filing_chunks WHERE accession_number <> 'acc-3')")
def j9(t):
    done = t.filing_chunks.where("accession_number <> 'acc-3'").select(F.col("chunk_id").alias("doc_id")).distinct()
    return t.documents.select("doc_id").join(done, "doc_id", "left_anti")


# coverage and audits


@query("A1", "SELECT ticker, count(*) AS n, min(trading_date) AS first_date, max(trading_date) AS last_date, count(adjusted_close) AS closes, count(volume) AS volumes FROM bars_daily GROUP BY ticker")
def a1(t):
    return t.bars_daily.groupBy("ticker").agg(n_rows().alias("n"), F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"), F.count("adjusted_close").alias("closes"), F.count("volume").alias("volumes"))


QUALITY = {
    "missing_price_rows": "open IS NULL OR high IS NULL OR low IS NULL OR close IS NULL OR adjusted_close IS NULL",
    "nonpositive_price_rows": "open <= 0 OR high <= 0 OR low <= 0 OR close <= 0 OR adjusted_close <= 0",
    "invalid_ohlc_rows": "high < low OR high < open OR high < close OR low > open OR low > close",
    "invalid_volume_rows": "volume IS NULL OR volume < 0",
}
oracle_view(
    "quality",
    " UNION ALL ".join(
        [f"SELECT '{k}' AS metric, count(*) AS value FROM bars_daily WHERE {c}" for k, c in QUALITY.items()]
        + ["SELECT 'rows_without_spy', count(*) FROM bars_daily a WHERE ticker <> 'SPY' AND NOT EXISTS (SELECT 1 FROM bars_daily b WHERE b.ticker = 'SPY' AND b.trading_date = a.trading_date)"]
    ),
)


def ohlcv_quality(bars: DataFrame) -> DataFrame:
    """Counts of rows that break a rule, as rows (metric, value)."""
    spy = bars.where("ticker = 'SPY'").select("trading_date", F.lit(True).alias("_spy"))
    x = bars.join(F.broadcast(spy), "trading_date", "left")
    counts = x.agg(*(F.count_if(F.expr(c)).alias(k) for k, c in QUALITY.items()), F.count_if(F.expr("ticker <> 'SPY' AND _spy IS NULL")).alias("rows_without_spy"))
    return counts.unpivot([], counts.columns, "metric", "value")


@query("A2", "SELECT metric, value FROM quality")
def a2(t):
    return ohlcv_quality(t.bars_daily)


@query("A3", " UNION ALL ".join(f"SELECT '{k}' AS dataset, count(*) AS n, count(*) > 0 AS available FROM {k}" for k in sorted(TABLES)))
def a3(t):
    return reduce(DataFrame.unionByName, [getattr(t, k).agg(n_rows().alias("n")).select(F.lit(k).alias("dataset"), "n", (F.col("n") > 0).alias("available")) for k in sorted(TABLES)])


oracle_view("horizon_summary", f"SELECT event_source, count(*) AS events, count(event_date) AS dated, count(*) FILTER (reason IS NULL) AS complete, {r('count(*) FILTER (reason IS NULL) / count(*)', 4)} AS coverage FROM horizon_audit GROUP BY event_source")


def horizon_summary(audit: DataFrame) -> DataFrame:
    done = F.count_if(F.col("reason").isNull())
    return audit.groupBy("event_source").agg(n_rows().alias("events"), F.count("event_date").alias("dated"), done.alias("complete"), rounded(done / n_rows(), 4).alias("coverage"))


@query("A4", "SELECT * FROM horizon_summary")
def a4(t):
    return horizon_summary(horizon_audit(t.corp_events, t.bars_daily))


oracle_view(
    "score_coverage",
    f"""SELECT corpus, count(*) AS total, count(*) FILTER (eligible) AS eligible, count(*) FILTER (status = 'SCORED') AS scored, count(*) FILTER (status = 'SKIPPED') AS skipped, count(*) FILTER (status = 'FAILED') AS failed,
  {r("count(*) FILTER (status = 'SCORED') / count(*) FILTER (eligible)", 4)} AS coverage FROM (
    SELECT 'transcripts' AS corpus, status, speaker_role <> 'operator' AND trim(content) <> '' AS eligible FROM turns t LEFT JOIN turn_scores s ON s.turn_id = t.turn_id
    UNION ALL SELECT 'filings', status, section_key IN ('item_7_mda', 'item_1a_risk_factors') FROM filing_chunks c LEFT JOIN chunk_scores s ON s.chunk_id = c.chunk_id) GROUP BY corpus""",
)


def score_coverage(t) -> DataFrame:
    turns = t.turns.join(t.turn_scores, "turn_id", "left").select(F.lit("transcripts").alias("corpus"), "status", F.expr("speaker_role <> 'operator' AND trim(content) <> ''").alias("eligible"))
    chunks = t.filing_chunks.join(t.chunk_scores, "chunk_id", "left").select(F.lit("filings").alias("corpus"), "status", F.col("section_key").isin(*sent.SECTIONS).alias("eligible"))
    count = lambda s: F.count_if(F.col("status") == s)
    agg = turns.unionByName(chunks).groupBy("corpus").agg(n_rows().alias("total"), F.count_if("eligible").alias("eligible"), count("SCORED").alias("scored"), count("SKIPPED").alias("skipped"), count("FAILED").alias("failed"))
    return agg.withColumn("coverage", rounded(ratio("scored", "eligible"), 4))


@query("A5", "SELECT * FROM score_coverage")
def a5(t):
    return score_coverage(t)


@query(
    "A6",
    f"""SELECT event_source, count(*) AS events, count(*) FILTER (target_available) AS available, {r('count(*) FILTER (target_available) / count(*)', 4)} AS coverage, {r('avg(stock_return)')} AS mean_stock, {r('avg(benchmark_return)')} AS mean_benchmark,
  {r('avg(excess_return)')} AS mean_excess, {r('median(excess_return)')} AS median_excess, {r('avg(CASE WHEN excess_return > 0 THEN 1.0::DOUBLE WHEN excess_return IS NOT NULL THEN 0.0::DOUBLE END)')} AS share_positive FROM labels30 GROUP BY event_source""",
)
def a6(t):
    return label_summary(labels_of(t))


def label_summary(labels: DataFrame) -> DataFrame:
    ok = F.count_if("target_available")
    mean = lambda c, name: rounded(F.avg(c)).alias(name)
    labels = written(labels.select("event_source", "target_available", "stock_return", "benchmark_return", "excess_return"), "labels")
    middle = exact_quantiles(labels, ["event_source"], "excess_return", (0.5,)).select("event_source", rounded(F.col("q")[0]).alias("median_excess"))  # a row per source
    found = labels.groupBy("event_source").agg(
        n_rows().alias("events"), ok.alias("available"), rounded(ok / n_rows(), 4).alias("coverage"), mean("stock_return", "mean_stock"), mean("benchmark_return", "mean_benchmark"), mean("excess_return", "mean_excess"),
        rounded(F.avg((F.col("excess_return") > 0).cast("double"))).alias("share_positive"),
    )
    return found.join(middle, "event_source", "left")


@query("A7", "SELECT target_error, count(*) AS n FROM labels30 WHERE target_error IS NOT NULL GROUP BY target_error")
def a7(t):
    return labels_of(t).where("target_error IS NOT NULL").groupBy("target_error").agg(n_rows().alias("n"))


@query(
    "A8",
    f"""SELECT 'ticker' AS kind, ticker AS key, count(*) AS n, {r('avg(excess_return)')} AS mean_excess, {r('avg(CASE WHEN excess_return > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS share_positive, CAST(NULL AS BIGINT) AS calls, CAST(NULL AS BIGINT) AS filings FROM labels30 WHERE target_available GROUP BY ticker
  UNION ALL SELECT 'year', CAST(year(event_date) AS VARCHAR), count(*), NULL, NULL, count(*) FILTER (event_source = 'earnings_call'), count(*) FILTER (event_source = 'sec_filing') FROM labels30 WHERE target_available GROUP BY year(event_date)""",
)
def a8(t):
    x = labels_of(t).where("target_available")
    by_ticker = x.groupBy(F.col("ticker").alias("key")).agg(n_rows().alias("n"), rounded(F.avg("excess_return")).alias("mean_excess"), rounded(F.avg((F.col("excess_return") > 0).cast("double"))).alias("share_positive"))
    by_year = x.groupBy(F.year("event_date").cast("string").alias("key")).pivot("event_source", ["earnings_call", "sec_filing"]).count().na.fill(0)
    by_year = by_year.select("key", (F.col("earnings_call") + F.col("sec_filing")).alias("n"), F.col("earnings_call").alias("calls"), F.col("sec_filing").alias("filings"))
    out = by_ticker.withColumn("kind", F.lit("ticker")).unionByName(by_year.withColumn("kind", F.lit("year")), allowMissingColumns=True)
    return out.select("kind", "key", "n", "mean_excess", "share_positive", "calls", "filings")


# sentiment

WT = "greatest(coalesce(token_count, 1), 1)::DOUBLE"
OK = "(status = 'SCORED' AND sentiment_score IS NOT NULL)"


def mean_sql(x: str, ok: str = OK) -> str:
    return f"sum({WT} * {x}) FILTER ({ok}) / nullif(sum({WT}) FILTER ({ok}), 0)"


MEAN = mean_sql("sentiment_score")
oracle_view(
    "event_sentiment",
    f"""SELECT event_key, {MEAN} AS sentiment_score, {mean_sql('confidence')} AS sentiment_confidence, sqrt(greatest(0, {mean_sql('sentiment_score * sentiment_score')} - ({MEAN}) * ({MEAN}))) AS sentiment_dispersion,
  count(*) FILTER ({OK}) / count(*) AS sentiment_coverage, count(*) FILTER ({OK}) AS sentiment_scored_items, CAST(coalesce(sum({WT}) FILTER ({OK}), 0) AS BIGINT) AS sentiment_token_count,
  {mean_sql('sentiment_score', OK + " AND speaker_group = 'management'")} AS management_sentiment_score, {mean_sql('sentiment_score', OK + " AND speaker_group = 'analyst'")} AS analyst_sentiment_score FROM sentiment_items GROUP BY event_key""",
)
BASIC = ("sentiment_score", "sentiment_confidence", "sentiment_dispersion")


@query("A9", f"SELECT event_key, {', '.join(f'{r(c, 5)} AS {c}' for c in BASIC)}, sentiment_scored_items, sentiment_token_count FROM event_sentiment")
def a9(t):
    agg = items_of(t).groupBy("event_key").agg(*sent.weighted(items_of(t), ["event_key"]))
    return agg.select("event_key", *(rounded(c, 5).alias(c) for c in BASIC), "sentiment_scored_items", "sentiment_token_count")


@query(
    "A10",
    f"""SELECT event_key, {r('sentiment_score', 5)} AS sentiment_score, {r('sentiment_coverage', 5)} AS sentiment_coverage, {r('management_sentiment_score', 5)} AS management_sentiment_score, {r('analyst_sentiment_score', 5)} AS analyst_sentiment_score,
  {r('management_sentiment_score - analyst_sentiment_score', 5)} AS management_analyst_gap FROM event_sentiment""",
)
def a10(t):
    names = ("sentiment_score", "sentiment_coverage", "management_sentiment_score", "analyst_sentiment_score", "management_analyst_gap")
    return sent.event_sentiment(items_of(t)).select("event_key", *(rounded(c, 5).alias(c) for c in names))


PLAIN = "(' ' || trim(regexp_replace(lower(content), '[^a-z0-9]+', ' ', 'g')) || ' ')"


def has_topic(k: str, words: str = "w") -> str:
    return "(" + " OR ".join(f"contains({words}, ' {x} ')" for x in TOPICS[k].split("|")) + ")"


oracle_view("topic_population", f"SELECT event_key, sentiment_score, {WT} AS wt, {PLAIN} AS w FROM sentiment_items WHERE status = 'SCORED' AND (event_source = 'sec_filing' OR speaker_group = 'management')")
oracle_view(
    "topic_agg",
    "SELECT event_key, "
    + ", ".join(f"sum(wt * sentiment_score) FILTER ({has_topic(k)}) / sum(wt) FILTER ({has_topic(k)}) AS topic_{k}_sentiment, count(*) FILTER ({has_topic(k)}) / count(*) AS topic_{k}_share" for k in TOPICS)
    + " FROM topic_population GROUP BY event_key",
)
oracle_view("topic_features", "SELECT i.event_key, " + ", ".join(f"topic_{k}_sentiment, coalesce(topic_{k}_share, 0) AS topic_{k}_share" for k in TOPICS) + " FROM (SELECT DISTINCT event_key FROM sentiment_items) i LEFT JOIN topic_agg a ON a.event_key = i.event_key")
TOPIC_COLUMNS = [f"topic_{k}_{x}" for k in TOPICS for x in ("sentiment", "share")]


@query("A11", f"SELECT event_key, {', '.join(f'{r(c, 5)} AS {c}' for c in TOPIC_COLUMNS)} FROM topic_features")
def a11(t):
    return sent.topic_features(items_of(t)).select("event_key", *(rounded(c, 5).alias(c) for c in TOPIC_COLUMNS))


GROUP = "CASE WHEN lower(speaker_role) LIKE '%operator%' THEN 'operator' WHEN lower(speaker_role) LIKE '%analyst%' THEN 'analyst' ELSE 'management' END"
PROB = "(1 - confidence) / 2"
oracle_view(
    "service_rows",
    f"""SELECT t.transcript_id, t.ticker, t.turn_id, t.content, {GROUP} AS speaker_group, s.status, s.token_count, s.confidence, CASE WHEN sentiment_score > 0 THEN confidence WHEN sentiment_score IS NOT NULL THEN {PROB} END AS p_positive,
  CASE WHEN sentiment_score < 0 THEN confidence WHEN sentiment_score IS NOT NULL THEN {PROB} END AS p_negative, CASE WHEN sentiment_score = 0 THEN confidence WHEN sentiment_score IS NOT NULL THEN {PROB} END AS p_neutral, {PLAIN} AS w
  FROM turns t LEFT JOIN turn_scores s ON s.turn_id = t.turn_id""",
)
oracle_view(
    "filing_rows",
    f"""SELECT c.accession_number, c.section_key, c.filing_date, c.ticker, c.content, s.status, s.token_count, s.confidence, CASE WHEN sentiment_score > 0 THEN confidence WHEN sentiment_score IS NOT NULL THEN {PROB} END AS p_positive,
  CASE WHEN sentiment_score < 0 THEN confidence WHEN sentiment_score IS NOT NULL THEN {PROB} END AS p_negative, CASE WHEN sentiment_score = 0 THEN confidence WHEN sentiment_score IS NOT NULL THEN {PROB} END AS p_neutral, {PLAIN} AS w
  FROM filing_chunks c LEFT JOIN chunk_scores s ON s.chunk_id = c.chunk_id""",
)


def summary_sql(source: str, keys: str) -> str:
    """A12 and A13 over rows of a source by keys."""
    mean = lambda x: r(f"sum({WT} * {x}) FILTER (status = 'SCORED') / nullif(sum({WT}) FILTER (status = 'SCORED'), 0)")
    inner = f"SELECT {keys}, {mean('p_positive')} AS positive, {mean('p_negative')} AS negative, {mean('p_neutral')} AS neutral, {mean('confidence')} AS confidence, count(*) FILTER (status = 'SCORED') AS scored, count(*) FILTER (status IS NULL OR status <> 'SKIPPED') AS eligible FROM {source} GROUP BY {keys}"
    label = "CASE WHEN positive IS NULL THEN NULL WHEN positive >= negative AND positive >= neutral THEN 'positive' WHEN negative >= neutral THEN 'negative' ELSE 'neutral' END"
    return f"SELECT *, {r('positive - negative')} AS score, {label} AS label, {r('scored / nullif(eligible, 0)')} AS coverage FROM ({inner})"


SUMMARY = ("positive", "negative", "neutral", "confidence", "scored", "score", "label")


def service(t) -> DataFrame:
    return sent.service_rows(t.turns, t.turn_scores)


def filing_rows(t) -> DataFrame:
    return t.filing_chunks.join(t.chunk_scores, "chunk_id", "left").withColumns(sent.probabilities())


@query("A12", f"SELECT transcript_id, {', '.join(SUMMARY)} FROM ({summary_sql('service_rows', 'transcript_id')})")
def a12(t):
    return sent.labelled(service(t).groupBy("transcript_id").agg(*sent.summary())).select("transcript_id", *SUMMARY)


@query("A13", f"SELECT ticker, {', '.join(SUMMARY)}, eligible, coverage FROM ({summary_sql('service_rows', 'ticker')})")
def a13(t):
    return sent.labelled(service(t).groupBy("ticker").agg(*sent.summary())).select("ticker", *SUMMARY, "eligible", "coverage")


def topic_rows_sql(source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT *, '{k}' AS topic, [x FOR x IN [{', '.join(repr(x) for x in TOPICS[k].split('|'))}] IF contains(w, ' ' || x || ' ')] AS found FROM {source} WHERE {has_topic(k)}" for k in TOPICS
    )


oracle_view("turn_topics", topic_rows_sql("service_rows"))
oracle_view("filing_topics", topic_rows_sql("filing_rows"))


@query(
    "A14",
    f"SELECT s.topic, {', '.join(SUMMARY)}, eligible, coverage, x.terms FROM ({summary_sql('turn_topics', 'topic')}) s JOIN (SELECT topic, string_agg(DISTINCT k, ',' ORDER BY k) AS terms FROM (SELECT topic, unnest(found) AS k FROM turn_topics) GROUP BY topic) x ON x.topic = s.topic",
)
def a14(t):
    return sent.by_topic(service(t), []).select("topic", *SUMMARY, "eligible", "coverage", "terms")


@query(
    "A15",
    f"""SELECT transcript_id, 'overall' AS part, {', '.join(SUMMARY)} FROM ({summary_sql("(SELECT * FROM service_rows WHERE speaker_group <> 'operator')", 'transcript_id')})
  UNION ALL SELECT transcript_id, speaker_group, {', '.join(SUMMARY)} FROM ({summary_sql("(SELECT * FROM service_rows WHERE speaker_group <> 'operator')", 'transcript_id, speaker_group')})
  UNION ALL SELECT transcript_id, 'topic:' || topic, {', '.join(SUMMARY)} FROM ({summary_sql("(SELECT * FROM turn_topics WHERE speaker_group = 'management')", 'transcript_id, topic')})""",
)
def a15(t):
    return transcript_summary(service(t)).select("transcript_id", "part", *SUMMARY)


def transcript_summary(rows: DataFrame) -> DataFrame:
    """Overall without operators, by speaker group, and management's topics."""
    said = rows.where("speaker_group <> 'operator'")
    overall = sent.labelled(said.groupBy("transcript_id").agg(*sent.summary())).withColumn("part", F.lit("overall"))
    groups = sent.labelled(said.groupBy("transcript_id", F.col("speaker_group").alias("part")).agg(*sent.summary()))
    topics = sent.by_topic(said.where("speaker_group = 'management'"), ["transcript_id"]).withColumn("part", F.concat(F.lit("topic:"), "topic")).drop("topic", "terms")
    return overall.unionByName(groups).unionByName(topics)


@query(
    "A16",
    f"""SELECT accession_number, 'overall' AS part, {', '.join(SUMMARY)} FROM ({summary_sql('filing_rows', 'accession_number')})
  UNION ALL SELECT accession_number, section_key, {', '.join(SUMMARY)} FROM ({summary_sql('filing_rows', 'accession_number, section_key')})
  UNION ALL SELECT accession_number, 'topic:' || topic, {', '.join(SUMMARY)} FROM ({summary_sql('filing_topics', 'accession_number, topic')})""",
)
def a16(t):
    rows = filing_rows(t)
    overall = sent.labelled(rows.groupBy("accession_number").agg(*sent.summary())).withColumn("part", F.lit("overall"))
    sections = sent.labelled(rows.groupBy("accession_number", F.col("section_key").alias("part")).agg(*sent.summary()))
    topics = sent.by_topic(rows, ["accession_number"]).withColumn("part", F.concat(F.lit("topic:"), "topic")).drop("topic", "terms")
    return overall.unionByName(sections).unionByName(topics).select("accession_number", "part", *SUMMARY)


@query(
    "W14",
    f"""WITH o AS ({summary_sql('service_rows', 'ticker, transcript_id')}), tp AS ({summary_sql("(SELECT * FROM turn_topics WHERE speaker_group = 'management')", 'ticker, transcript_id, topic')}),
  seq AS (SELECT ticker, transcript_id, row_number() OVER (PARTITION BY ticker ORDER BY transcript_id) AS n FROM o),
  x AS (SELECT ticker, transcript_id, 'overall' AS part, score FROM o UNION ALL SELECT ticker, transcript_id, topic, score FROM tp)
  SELECT a.ticker, a.transcript_id, a.part, a.score, {r('a.score - b.score')} AS change FROM x a JOIN seq s ON s.ticker = a.ticker AND s.transcript_id = a.transcript_id
  LEFT JOIN seq p ON p.ticker = s.ticker AND p.n = s.n - 1 LEFT JOIN x b ON b.ticker = p.ticker AND b.transcript_id = p.transcript_id AND b.part = a.part""",
)
def w14(t):
    return sentiment_timeline(service(t)).select("ticker", "transcript_id", "part", "score", rounded("change").alias("change"))


def sentiment_timeline(rows: DataFrame) -> DataFrame:
    """Scores by event, overall and by topic, and their change from the event just before; a topic absent there has no change."""
    overall = sent.labelled(rows.groupBy("ticker", "transcript_id").agg(*sent.summary()))
    seq = overall.select("ticker", "transcript_id", F.row_number().over(Window.partitionBy("ticker").orderBy("transcript_id")).alias("n"))
    topics = sent.by_topic(rows.where("speaker_group = 'management'"), ["ticker", "transcript_id"]).withColumnRenamed("topic", "part")
    x = overall.withColumn("part", F.lit("overall")).select("ticker", "transcript_id", "part", "score").unionByName(topics.select("ticker", "transcript_id", "part", "score"))
    x = x.join(seq, ["ticker", "transcript_id"])
    before = x.select("ticker", (F.col("n") + 1).alias("n"), "part", F.col("score").alias("_before"))
    return x.join(before, ["ticker", "n", "part"], "left").withColumn("change", F.col("score") - F.col("_before"))


# sizes, catalogues, buckets

SIZES = "CASE WHEN n < 100 THEN '000-099' WHEN n < 300 THEN '100-299' WHEN n < 500 THEN '300-499' WHEN n < 650 THEN '500-649' ELSE '650+' END"


@query("A20", f"SELECT {SIZES} AS bucket, count(*) AS chunks, CAST(min(n) AS INT) AS least, {r('avg(n)', 4)} AS mean, CAST(max(n) AS INT) AS most FROM (SELECT length(content) // 6 AS n FROM filing_chunks) GROUP BY 1")
def a20(t):
    x = t.filing_chunks.select(F.floor(F.length("content") / 6).cast("int").alias("n"))
    return x.groupBy(F.expr(SIZES).alias("bucket")).agg(n_rows().alias("chunks"), F.min("n").alias("least"), rounded(F.avg("n"), 4).alias("mean"), F.max("n").alias("most"))


@query(
    "A21",
    """SELECT 'form' AS kind, form_type AS name, count(*) AS n FROM filing_chunks GROUP BY form_type UNION ALL SELECT 'section', section_key, count(*) FROM filing_chunks GROUP BY section_key
  UNION ALL SELECT 'transcripts', ticker, count(DISTINCT transcript_id) FROM turns GROUP BY ticker""",
)
def a21(t):
    part = lambda df, kind, c, n: df.groupBy(F.col(c).alias("name")).agg(n.alias("n")).select(F.lit(kind).alias("kind"), "name", "n")
    return part(t.filing_chunks, "form", "form_type", n_rows()).unionByName(part(t.filing_chunks, "section", "section_key", n_rows())).unionByName(part(t.turns, "transcripts", "ticker", F.countDistinct("transcript_id")))


@query(
    "A22",
    f"""WITH q AS (SELECT quantile_cont(excess_return, [0.2, 0.4, 0.6, 0.8]) AS e FROM labels30 WHERE target_available)
  SELECT 'outcome' AS kind, CASE WHEN eps_surprise > 0 THEN 'Beat' WHEN eps_surprise < 0 THEN 'Miss' ELSE 'Met' END AS bucket, count(*) AS n, CAST(NULL AS DOUBLE) AS mean_excess FROM eps_results GROUP BY 2
  UNION ALL SELECT 'quintile', 'q' || (1 + (excess_return > e[1])::INT + (excess_return > e[2])::INT + (excess_return > e[3])::INT + (excess_return > e[4])::INT), count(*), {r('avg(excess_return)')} FROM labels30, q WHERE target_available GROUP BY 2""",
)
def a22(t):
    outcome = F.when(F.col("eps_surprise") > 0, "Beat").when(F.col("eps_surprise") < 0, "Miss").otherwise("Met")
    first = t.eps_results.groupBy(outcome.alias("bucket")).agg(n_rows().alias("n")).select(F.lit("outcome").alias("kind"), "bucket", "n", F.lit(None).cast("double").alias("mean_excess"))
    x = labels_of(t).where("target_available").select("excess_return")
    x = written(x.withColumn("part", F.lit("all")), "excess")
    edges = exact_quantiles(x, ["part"], "excess_return", (0.2, 0.4, 0.6, 0.8)).select(F.col("q").alias("e"))  # one row
    rank = F.lit(1) + sum(((F.col("excess_return") > F.col("e")[k]).cast("int") for k in range(4)), F.lit(0))
    second = x.join(F.broadcast(edges)).groupBy(F.concat(F.lit("q"), rank.cast("string")).alias("bucket")).agg(n_rows().alias("n"), rounded(F.avg("excess_return")).alias("mean_excess"))
    return first.unionByName(second.select(F.lit("quintile").alias("kind"), "bucket", "n", "mean_excess"))


# sets


@query("U1", "SELECT event_source, ticker, count(*) AS n FROM corp_events GROUP BY event_source, ticker")
def u1(t):
    calls, filings = (t.corp_events.where(F.col("event_source") == s).select("event_source", "ticker", c) for s, c in (("earnings_call", "fiscal_period"), ("sec_filing", "form_type")))
    return calls.unionByName(filings, allowMissingColumns=True).groupBy("event_source", "ticker").agg(n_rows().alias("n"))


@query("U2", "SELECT ticker FROM watchlist_items UNION SELECT 'SPY'")
def u2(t):
    return t.watchlist_items.select("ticker").union(t.bars_daily.where("ticker = 'SPY'").select("ticker")).distinct()


@query(
    "C17",
    """SELECT 'The earnings results hold ' || count(*)::VARCHAR || ' announced values.' AS finding FROM eps_results
  UNION ALL SELECT 'Prices cover ' || count(DISTINCT ticker)::VARCHAR || ' tickers from ' || min(trading_date)::VARCHAR || ' to ' || max(trading_date)::VARCHAR || '.' FROM bars_daily
  UNION ALL SELECT 'Price checks flagged ' || sum(value)::BIGINT::VARCHAR || ' rows.' FROM quality
  UNION ALL SELECT event_source || ': ' || complete::VARCHAR || ' of ' || events::VARCHAR || ' events have a complete forward window.' FROM horizon_summary
  UNION ALL SELECT corpus || ': ' || scored::VARCHAR || ' of ' || eligible::VARCHAR || ' eligible items are scored.' FROM score_coverage""",
)
def c17(t):
    """Findings in words from the audit tables."""
    say = lambda df, *parts: df.select(F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts)).alias("finding"))
    txt = lambda c: F.col(c).cast("string")
    rows = [
        say(t.eps_results.agg(n_rows().alias("n")), "The earnings results hold ", txt("n"), " announced values."),
        say(t.bars_daily.agg(F.countDistinct("ticker").alias("n"), F.min("trading_date").alias("a"), F.max("trading_date").alias("b")), "Prices cover ", txt("n"), " tickers from ", txt("a"), " to ", txt("b"), "."),
        say(ohlcv_quality(t.bars_daily).agg(F.sum("value").alias("n")), "Price checks flagged ", txt("n"), " rows."),
        say(horizon_summary(horizon_audit(t.corp_events, t.bars_daily)), F.col("event_source"), ": ", txt("complete"), " of ", txt("events"), " events have a complete forward window."),
        say(score_coverage(t), F.col("corpus"), ": ", txt("scored"), " of ", txt("eligible"), " eligible items are scored."),
    ]
    return reduce(DataFrame.unionByName, rows)

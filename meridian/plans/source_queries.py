"""Scans, sources, sinks, projections and predicates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions.numeric import r, ratio, rounded
from meridian.functions.text import CALL_TERMS, DOCUMENT_TERMS, FILING_TERMS, HISTORY_TERMS, LATEST_TERMS, MARKET_TERMS, SINGLE_CALL_TERMS, route, speaker_group
from meridian.operators.sentiment import scored_items
from meridian.plans.registry import oracle_view, query
from meridian.sources.workspace import latest_wins, replace_children, scratch, upsert

FIELDS = ("open", "high", "low", "close", "adjusted_close", "volume")


def unpivot_wide(wide: DataFrame, tickers: list[str], date: str = "trading_date") -> DataFrame:
    """A provider frame with columns `TICKER_field` as rows (ticker, session); all-null price rows go, the first row of a session wins."""
    if missing := [f"{k}_{f}" for k in tickers for f in FIELDS if f"{k}_{f}" not in wide.columns]:
        raise ValueError(f"missing columns: {', '.join(missing[:5])}")
    per = [F.struct(F.lit(k).alias("ticker"), *(F.col(f"`{k}_{f}`").cast("double").alias(f) for f in FIELDS)) for k in tickers]
    rows = wide.select(date, F.explode(F.array(*per)).alias("x")).select("x.ticker", date, *(f"x.{f}" for f in FIELDS))
    rows = rows.dropna(subset=[date]).dropna(how="all", subset=["open", "high", "low", "close"])
    first = Window.partitionBy("ticker", date).orderBy(F.lit(1))
    rows = rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")
    return rows.withColumn("volume", F.round("volume").cast("long"))


@query("S1", f"SELECT ticker, trading_date, {', '.join(f'{r(f)} AS {f}' for f in FIELDS[:5])}, volume FROM bars_daily")
def s1(t):
    tickers = [*sorted(x[0] for x in t.companies.select("ticker").collect()), "SPY"]  # the company dimension
    wide = t.bars_daily.groupBy("trading_date").pivot("ticker", tickers).agg(*(F.first(f).alias(f) for f in FIELDS))
    return unpivot_wide(wide, tickers).select("ticker", "trading_date", *(rounded(f).alias(f) for f in FIELDS[:5]), "volume")


@query("S2", f"SELECT ticker, trading_date, {r('adjusted_close')} AS adjusted_close, volume FROM bars_daily")
def s2(t):
    return t.bars_daily.select("ticker", "trading_date", rounded("adjusted_close").alias("adjusted_close"), "volume")


@query(
    "S3",
    """SELECT event_key, event_source, event_id, ticker, event_date, CASE WHEN event_source = 'earnings_call' THEN 'earnings_call' ELSE form_type END AS event_subtype, fiscal_period, form_type, CAST(NULL AS DATE) AS report_date
  FROM corp_events WHERE event_source = 'earnings_call' OR form_type IN ('10-K', '10-Q')""",
)
def s3(t):
    return event_table(t.corp_events)


def event_table(events: DataFrame) -> DataFrame:
    """Calls and filings (two forms) as one table with a synthetic key."""
    key = F.concat("event_source", F.lit(":"), "event_id").alias("event_key")
    base = (key, "event_source", "event_id", "ticker", "event_date")
    calls = events.where("event_source = 'earnings_call'").select(*base, F.lit("earnings_call").alias("event_subtype"), "fiscal_period")
    filings = events.where("event_source = 'sec_filing' AND form_type IN ('10-K', '10-Q')").select(*base, F.col("form_type").alias("event_subtype"), "form_type")
    both = calls.unionByName(filings, allowMissingColumns=True).withColumn("report_date", F.lit(None).cast("date"))
    return both.select("event_key", "event_source", "event_id", "ticker", "event_date", "event_subtype", "fiscal_period", "form_type", "report_date")


oracle_view(
    "sentiment_items",
    """SELECT 'earnings_call:' || t.transcript_id AS event_key, 'earnings_call' AS event_source, CASE WHEN lower(t.speaker_role) LIKE '%analyst%' THEN 'analyst' ELSE 'management' END AS speaker_group,
    t.content, s.status, s.sentiment_score, s.confidence, s.token_count FROM turns t LEFT JOIN turn_scores s ON s.turn_id = t.turn_id WHERE trim(t.content) <> '' AND lower(t.speaker_role) NOT LIKE '%operator%'
  UNION ALL SELECT 'sec_filing:' || c.accession_number, 'sec_filing', 'filing', c.content, s.status, s.sentiment_score, s.confidence, s.token_count
    FROM filing_chunks c LEFT JOIN chunk_scores s ON s.chunk_id = c.chunk_id WHERE c.section_key IN ('item_7_mda', 'item_1a_risk_factors')""",
)


def items_of(t) -> DataFrame:
    return scored_items(t.turns, t.turn_scores, t.filing_chunks, t.chunk_scores)


@query("S4", "SELECT event_key, event_source, speaker_group, CAST(length(content) AS INT) AS n_chars, status, sentiment_score, confidence, token_count FROM sentiment_items")
def s4(t):
    return items_of(t).select("event_key", "event_source", "speaker_group", F.length("content").alias("n_chars"), "status", "sentiment_score", "confidence", "token_count")


PAGE = "accession array<string>, form array<string>, filed array<string>"


def columnar_pages(filings: DataFrame, parts: int = 2) -> DataFrame:
    """Filings of a ticker as JSON pages of parallel arrays; pages overlap by some rows, as a provider's may."""
    x = filings.withColumn("_n", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("event_date"), "event_id")))
    pages = [x.where((F.col("_n") > 20 * k - 5) & (F.col("_n") <= 20 * (k + 1) if k + 1 < parts else F.lit(True))).withColumn("page", F.lit(k)) for k in range(parts)]
    rows = F.array_sort(F.collect_list(F.struct("_n", F.col("event_id").alias("accession"), F.col("form_type").alias("form"), F.date_format("event_date", "yyyy-MM-dd").alias("filed"))))
    packed = reduce(DataFrame.unionByName, pages).groupBy("ticker", "page").agg(rows.alias("x"))
    return packed.select("ticker", "page", F.to_json(F.struct(*(F.col(f"x.{c}").alias(c) for c in ("accession", "form", "filed")))).alias("payload"))


def filings_from_pages(pages: DataFrame, years: int = 5) -> DataFrame:
    """Parallel arrays zipped to rows; two forms, a trailing window of years, the first row of an accession."""
    parsed = pages.withColumn("p", F.from_json("payload", PAGE)).select("ticker", "page", F.posexplode(F.arrays_zip("p.accession", "p.form", "p.filed")).alias("pos", "x"))
    rows = parsed.select("ticker", "page", "pos", "x.accession", "x.form", F.expr("try_cast(x.filed AS DATE)").alias("filing_date")).where("form IN ('10-K', '10-Q') AND filing_date IS NOT NULL")
    since = rows.agg(F.add_months(F.max("filing_date"), -12 * years).alias("since"))
    rows = rows.join(F.broadcast(since), F.col("filing_date") >= F.col("since"))
    first = Window.partitionBy("accession").orderBy("page", "pos")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select("ticker", "accession", "form", "filing_date")


@query(
    "S5",
    """SELECT ticker, event_id AS accession, form_type AS form, event_date AS filing_date FROM corp_events WHERE event_source = 'sec_filing'
  AND event_date >= (SELECT max(event_date) FROM corp_events WHERE event_source = 'sec_filing') - INTERVAL 5 YEAR""",
)
def s5(t):
    return filings_from_pages(columnar_pages(t.corp_events.where("event_source = 'sec_filing'")))


def announced_eps(raw: DataFrame) -> DataFrame:
    """Provider rows as typed results: percent to rate, surprise, rows without a reported value left out, the latest stamp wins."""
    x = raw.select(
        "ticker", F.to_date("stamp").alias("earnings_date"), F.to_timestamp("stamp").alias("at"),
        F.expr("try_cast(estimate AS DOUBLE)").alias("eps_estimate"), F.expr("try_cast(reported AS DOUBLE)").alias("reported_eps"), (F.expr("try_cast(surprise_percent AS DOUBLE)") / 100).alias("eps_surprise_rate"),
    ).where("reported_eps IS NOT NULL")
    return latest_wins(x.withColumn("eps_surprise", F.col("reported_eps") - F.col("eps_estimate")), ["ticker", "earnings_date"], "at")


@query("S6", f"SELECT ticker, earnings_date, {r('eps_estimate')} AS eps_estimate, {r('reported_eps')} AS reported_eps, {r('eps_surprise')} AS eps_surprise, {r('eps_surprise_pct')} AS eps_surprise_rate FROM eps_results")
def s6(t):
    stamp = lambda hour: F.concat(F.col("earnings_date").cast("string"), F.lit(f" {hour}:00:00"))
    text = lambda c: F.col(c).cast("string")
    raw = t.eps_results.select("ticker", stamp("21").alias("stamp"), text("eps_estimate").alias("estimate"), text("reported_eps").alias("reported"), (F.col("eps_surprise_pct") * 100).cast("string").alias("surprise_percent"))
    early = raw.withColumn("reported", F.lit("0.01")).withColumn("stamp", F.replace("stamp", F.lit(" 21:"), F.lit(" 06:")))
    future = raw.withColumn("reported", F.lit("n/a"))
    out = announced_eps(raw.unionByName(early).unionByName(future))
    return out.select("ticker", "earnings_date", *(rounded(c).alias(c) for c in ("eps_estimate", "reported_eps", "eps_surprise", "eps_surprise_rate")))


TURN = "array<struct<speaker:string,role:string,content:string,text:string>>"


def turn_payloads(turns: DataFrame) -> DataFrame:
    """One JSON list of turns per transcript; every other transcript names the text differently."""
    even = F.col("transcript_id") % 2 == 0
    item = F.struct("turn_index", F.col("speaker_role").alias("role"), F.when(even, F.col("content")).alias("content"), F.when(~even, F.col("content")).alias("text"))
    return turns.groupBy("transcript_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("payload"))


def turns_from_payload(payloads: DataFrame) -> DataFrame:
    """Ordered turns with their raw and compacted positions; blank turns are dropped."""
    x = payloads.select("transcript_id", F.posexplode(F.from_json("payload", TURN)).alias("turn_index", "x"))
    text = F.coalesce(F.nullif(F.trim("x.content"), F.lit("")), F.nullif(F.trim("x.text"), F.lit("")))
    x = x.select("transcript_id", "turn_index", F.coalesce("x.speaker", "x.role").alias("speaker"), text.alias("content")).where("content IS NOT NULL")
    order = Window.partitionBy("transcript_id").orderBy("turn_index")
    return x.withColumn("compact_index", F.row_number().over(order) - 1)


@query(
    "S7",
    """SELECT transcript_id, CAST(pos AS INT) AS turn_index, CAST(row_number() OVER (PARTITION BY transcript_id ORDER BY pos) - 1 AS INT) AS compact_index, speaker_role AS speaker, md5(trim(content)) AS digest
  FROM (SELECT *, row_number() OVER (PARTITION BY transcript_id ORDER BY turn_index) - 1 AS pos FROM turns) WHERE trim(content) <> ''""",
)
def s7(t):
    return turns_from_payload(turn_payloads(t.turns)).select("transcript_id", "turn_index", "compact_index", "speaker", F.md5("content").alias("digest"))


def transcript_records(turns: DataFrame, least: int = 500) -> DataFrame:
    """Full text of a transcript with speaker headings, its counts and period; short ones are rejected."""
    parts = F.array_sort(F.collect_list(F.struct("turn_index", F.concat("speaker_role", F.lit(": "), "content").alias("said"))))
    x = turns.groupBy("transcript_id").agg(parts.alias("parts"), F.count(F.lit(1)).alias("turn_count"))
    x = x.withColumn("content", F.array_join(F.col("parts.said"), "\n\n")).where(F.length("content") >= least)
    year, quarter = F.lit(2020) + F.col("transcript_id") % 5, F.lit(1) + F.col("transcript_id") % 4
    return x.where(quarter.between(1, 4)).select("transcript_id", "content", F.length("content").cast("long").alias("char_count"), "turn_count", F.concat(year.cast("string"), F.lit("Q"), quarter.cast("string")).alias("period"))


@query(
    "S8",
    """SELECT transcript_id, md5(content) AS digest, length(content) AS char_count, turn_count, (2020 + transcript_id % 5)::VARCHAR || 'Q' || (1 + transcript_id % 4)::VARCHAR AS period
  FROM (SELECT transcript_id, string_agg(speaker_role || ': ' || content, chr(10) || chr(10) ORDER BY turn_index) AS content, count(*) AS turn_count FROM turns GROUP BY transcript_id) WHERE length(content) >= 500""",
)
def s8(t):
    return transcript_records(t.turns).withColumn("digest", F.md5("content")).drop("content")


@query(
    "S9",
    f"SELECT ticker, trading_date, {r('adjusted_close')} AS adjusted_close, CASE WHEN trading_date >= DATE '1995-01-01' THEN volume ELSE volume + 1 END AS volume FROM bars_daily",
)
def s9(t):
    bars = t.bars_daily.select("ticker", "trading_date", "adjusted_close", "volume", F.year("trading_date").alias("year"))
    early = bars.withColumn("volume", F.col("volume") + 1)
    path, keys = scratch(t.spark, "bars"), ["ticker", "trading_date"]
    upsert(path, early, keys, "year")
    late = bars.where("trading_date >= DATE '1995-01-01'")
    upsert(path, late, keys, "year")
    out = upsert(path, late, keys, "year")  # once more: nothing changes
    return out.select("ticker", "trading_date", rounded("adjusted_close").alias("adjusted_close"), "volume")


@query("S10", "SELECT chunk_id, accession_number, n_chars FROM filing_chunks WHERE ticker <> 'src1' OR chunk_id % 2 = 0 OR accession_number NOT IN (SELECT accession_number FROM filing_chunks WHERE ticker = 'src1' AND chunk_id % 2 = 0)")
def s10(t):
    old = t.filing_chunks.select("chunk_id", "accession_number", "ticker", "n_chars")
    parents = old.where("ticker = 'src1' AND chunk_id % 2 = 0").select("accession_number").distinct()
    new = old.join(parents, "accession_number", "left_semi").where("ticker <> 'src1' OR chunk_id % 2 = 0")
    return replace_children(old, new, "accession_number").select("chunk_id", "accession_number", "n_chars")


@query(
    "S11",
    """SELECT count(*) AS before, count(*) FILTER (keep) AS after, count(*) - count(*) FILTER (keep) AS deleted FROM (
  SELECT ticker IN (SELECT ticker FROM watchlist_items WHERE watchlist_id <> 2) AND event_date >= (SELECT max(event_date) FROM corp_events) - INTERVAL 5 YEAR AS keep FROM corp_events WHERE event_source = 'sec_filing')""",
)
def s11(t):
    filings = t.corp_events.where("event_source = 'sec_filing'")
    kept = prune_scope(filings, t.watchlist_items.where("watchlist_id <> 2").select("ticker"), t.corp_events.agg(F.add_months(F.max("event_date"), -60).alias("since")))
    n = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    return n(filings, "before").crossJoin(n(kept, "after")).withColumn("deleted", F.col("before") - F.col("after"))  # one row each


def prune_scope(filings: DataFrame, scope: DataFrame, since: DataFrame) -> DataFrame:
    """Filings of the tickers in scope that are not older than the cutoff."""
    return filings.join(scope.distinct(), "ticker", "left_semi").join(F.broadcast(since), F.col("event_date") >= F.col("since")).drop("since")


@query("S12", "SELECT ticker, count(*) AS sessions, min(trading_date) AS first_date, max(trading_date) AS last_date, TRUE AS same FROM bars_daily GROUP BY ticker")
def s12(t):
    """The ticker coverage written as CSV and nested JSON and read back."""
    report = t.bars_daily.groupBy("ticker").agg(F.count(F.lit(1)).alias("sessions"), F.min("trading_date").alias("first_date"), F.max("trading_date").alias("last_date"))
    flat, nested = scratch(t.spark, "report-csv"), scratch(t.spark, "report-json")
    report.write.option("header", True).csv(flat)
    report.select("ticker", F.struct("sessions", F.struct("first_date", "last_date").alias("span")).alias("coverage")).write.json(nested)
    back = t.spark.read.schema("ticker string, coverage struct<sessions:bigint, span:struct<first_date:date,last_date:date>>").json(nested)
    csv = t.spark.read.schema("ticker string, sessions bigint, first_date date, last_date date").option("header", True).csv(flat)
    return csv.join(back, "ticker").select("ticker", "sessions", "first_date", "last_date", (F.col("coverage.sessions") == F.col("sessions")).alias("same"))


# predicates


def normalise_scope(lists: DataFrame, most: int | None = None) -> DataFrame:
    """Trimmed, upper-case, non-empty tickers of an array column, first occurrence kept."""
    clean = F.array_distinct(F.filter(F.transform("tickers", lambda x: F.upper(F.trim(x))), lambda x: x != ""))
    return lists.withColumn("tickers", F.slice(clean, 1, most) if most else clean)


@query("P1", "SELECT watchlist_id, array_to_string(list_slice(list(upper(ticker) ORDER BY ticker), 1, 4), ',') AS tickers FROM watchlist_items GROUP BY watchlist_id")
def p1(t):
    raw = F.concat(F.transform("x", lambda k: F.concat(F.lit("  "), F.lower(k))), F.array(F.lit(" "), F.lit("")), F.col("x"))
    lists = t.watchlist_items.groupBy("watchlist_id").agg(F.array_sort(F.collect_list("ticker")).alias("x")).select("watchlist_id", raw.alias("tickers"))
    return normalise_scope(lists, 4).select("watchlist_id", F.array_join("tickers", ",").alias("tickers"))


@query(
    "P2",
    """SELECT 'all' AS scope, ticker, CAST(row_number() OVER (ORDER BY ticker) AS INT) AS pos FROM companies WHERE ticker <> 'SPY'
  UNION ALL SELECT 'watchlist', ticker, CAST(row_number() OVER (ORDER BY added_at, ticker) AS INT) FROM watchlist_items WHERE watchlist_id = 2
  UNION ALL SELECT 'union', ticker, CAST(row_number() OVER (ORDER BY min(added_at), ticker) AS INT) FROM watchlist_items GROUP BY ticker""",
)
def p2(t):
    return reduce(DataFrame.unionByName, [resolve_scope(t, "all"), resolve_scope(t, "watchlist", 2), resolve_scope(t, "union")])


def resolve_scope(t, scope: str, watchlist: int | None = None, explicit: list[str] | None = None) -> DataFrame:
    """Tickers of a scope in order; an explicit list beats the scope. Scopes are dimensions, so one sort is enough."""
    if explicit:
        rows = t.spark.createDataFrame([(k, i) for i, k in enumerate(dict.fromkeys(x.strip().upper() for x in explicit if x.strip()))], "ticker string, at int")
    elif scope == "all":
        rows = t.companies.where("ticker <> 'SPY'").select("ticker", F.lit(0).alias("at"))
    elif scope == "watchlist":
        rows = t.watchlist_items.where(F.col("watchlist_id") == watchlist).select("ticker", F.col("added_at").alias("at"))
    else:
        rows = t.watchlist_items.groupBy("ticker").agg(F.min("added_at").alias("at"))
    return rows.select(F.lit(scope).alias("scope"), "ticker", F.row_number().over(Window.orderBy("at", "ticker")).alias("pos"))


@query("P3", f"SELECT ticker, trading_date, {r('coalesce(adjusted_close, close)')} AS price FROM bars_daily WHERE trading_date BETWEEN DATE '1994-01-01' AND DATE '1995-12-31' AND coalesce(adjusted_close, close) IS NOT NULL")
def p3(t):
    price = F.coalesce("adjusted_close", "close")
    return t.bars_daily.where(F.col("trading_date").between(F.lit("1994-01-01").cast("date"), F.lit("1995-12-31").cast("date")) & price.isNotNull()).select("ticker", "trading_date", rounded(price).alias("price"))


def metadata_filter(df: DataFrame, exact: dict | None = None, folded: dict | None = None) -> DataFrame:
    """Rows that meet the given filters; None means no filter, `folded` ones ignore case."""
    for c, v in (exact or {}).items():
        df = df if v is None else df.where(F.col(c) == v)
    for c, v in (folded or {}).items():
        df = df if v is None else df.where(F.upper(c) == v.strip().upper())
    return df


@query("P4", "SELECT chunk_id, ticker, form_type, section_key FROM filing_chunks WHERE upper(ticker) = 'SRC1' AND upper(form_type) = '10-K' AND section_key = 'item_7_mda'")
def p4(t):
    return metadata_filter(t.filing_chunks, {"section_key": "item_7_mda", "accession_number": None}, {"ticker": "src1", "form_type": "10-k"}).select("chunk_id", "ticker", "form_type", "section_key")


GROUP = "CASE WHEN lower(speaker_role) LIKE '%operator%' THEN 'operator' WHEN lower(speaker_role) LIKE '%analyst%' THEN 'analyst' ELSE 'management' END"


@query("P5", f"SELECT turn_id, {GROUP} AS speaker_group FROM turns")
def p5(t):
    return t.turns.select("turn_id", speaker_group(F.col("speaker_role")).alias("speaker_group"))


@query("P6", f"SELECT turn_id, trim(coalesce(content, '')) = '' OR {GROUP} = 'operator' AS skip FROM turns")
def p6(t):
    return t.turns.select("turn_id", skip(False).alias("skip"))


def skip(include_operators: bool):
    blank = F.trim(F.coalesce("content", F.lit(""))) == ""
    return blank if include_operators else blank | (speaker_group(F.col("speaker_role")) == "operator")


def any_of(terms: list[str]) -> str:
    return "(" + " OR ".join(f"contains(lower(content), '{x}')" for x in terms) + ")"


def routed_sql(key: str, source: str) -> str:
    """Routing of the questions of a source."""
    return f"""SELECT {key}, content, CASE WHEN {any_of(CALL_TERMS)} AND NOT {any_of(FILING_TERMS)} THEN 'transcripts' WHEN {any_of(FILING_TERMS)} AND NOT {any_of(CALL_TERMS)} THEN 'filings' ELSE 'filings,transcripts' END AS corpora,
  NOT {any_of([*HISTORY_TERMS, 'all calls', 'previous calls', 'past calls'])} AND ({any_of(LATEST_TERMS)} OR (NOT contains(lower(content), 'calls') AND {any_of(SINGLE_CALL_TERMS)})) AS latest_call,
  NOT {any_of([*HISTORY_TERMS, 'all filings', 'previous filings', 'past filings'])} AND {any_of(['latest', 'most recent', 'newest'])} AS latest_filing,
  {any_of(MARKET_TERMS)} AS wants_market, NOT {any_of(MARKET_TERMS)} OR {any_of(DOCUMENT_TERMS)} AS wants_text FROM {source}"""


oracle_view("routed", routed_sql("turn_id", "turns WHERE speaker_role = 'analyst'"))


@query("P7", "SELECT turn_id, corpora, latest_call, latest_filing, wants_market, wants_text FROM routed")
def p7(t):
    return t.turns.where("speaker_role = 'analyst'").select("turn_id", *(c.alias(k) for k, c in route(F.col("content")).items()))

"""Text functions, retrieval, composite services, evaluation suites, incremental jobs and UDFs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.functions import html, packing, text, udfs
from meridian.functions.numeric import r, ratio, rounded
from meridian.operators import sentiment as sent
from meridian.operators.batching import sequential_batches
from meridian.operators.retrieval import top_k, unit
from meridian.plans.aggregate_queries import WT, filing_rows, service, summary_sql, topic_rows_sql
from meridian.plans.market_queries import latest_two
from meridian.plans.registry import oracle_view, query
from meridian.plans.source_queries import routed_sql
from meridian.sources.workspace import few, scratch, written
from meridian.streaming import jobs

ONE = lambda: F.count(F.lit(1))
WORDS = "[w FOR w IN string_split_regex({}, '[ \\t\\n\\r\\f\\x0B]+') IF w <> '']"

# text functions


@query("F1")
def f1(t):
    x = html.html_to_text(t.pages, "page_id", "html")
    return x.where(F.length("text") >= 1000).select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("digest"))


#: Filings are made of documents: a table of contents, then each section twice, the second time over two lines.
HEADINGS = {
    "10-K": [("Item 1. Business", "Item 1.\nBusiness"), ("Item 1A. Risk Factors", "Item 1A.\nRisk Factors"), ("Item 1B. Unresolved", "Item 2. Properties"), ("Item 7. Management's Discussion", "Item 7:\nManagement’s Discussion and Analysis"), ("Item 7A. Quantitative and Qualitative Disclosures", "Item 7A -\nQuantitative and Qualitative"), ("Item 8. Financial Statements", "Item 8.\nFinancial Statements"), ("Item 9. Changes", "Part III")],
    "10-Q": [("Item 1. Financial Statements", "Item 1.\nFinancial Statements"), ("Item 2. Management's Discussion", "Item 2:\nManagement’s Discussion"), ("Item 3. Quantitative and Qualitative Disclosures", "Item 3 -\nQuantitative and Qualitative"), ("Item 4. Controls and Procedures", "Item 4.\nControls and Procedures"), ("Part II", "Part II"), ("Item 1A. Risk Factors", "Item 1A.\nRisk Factors"), ("Item 6. Exhibits", "Item 5. Other")],
}


def filing_pieces(form: str) -> list[str]:
    """Literal pieces of a filing of a form; a document's text, in turn as it is and reversed, goes between them."""
    contents = "TABLE OF CONTENTS\n" + "".join(f"{a} ..... {5 * k + 5}\n" for k, (a, _) in enumerate(HEADINGS[form]))
    return [contents + "intro " * 400 + "\n"] + [f"\n{x}\n" for pair in zip(*HEADINGS[form]) for x in pair]


def filings_with_headings(t, form: str) -> DataFrame:
    docs = t.filing_chunks.where(F.col("form_type") == form)
    parts = [F.lit(p) if n == 0 else F.concat("content", F.lit(p)) if n % 2 else F.concat(F.reverse("content"), F.lit(p)) for n, p in enumerate(filing_pieces(form))]
    return docs.select(F.col("chunk_id").alias("doc_id"), F.concat(*parts).alias("body"))


def headed_sql(form: str) -> str:
    quoted = [p.replace("'", "''") for p in filing_pieces(form)]
    body = " || ".join(f"'{p}'" if n == 0 else f"content || '{p}'" if n % 2 else f"reverse(content) || '{p}'" for n, p in enumerate(quoted))
    return f"SELECT chunk_id AS doc_id, {body} AS body FROM filing_chunks WHERE form_type = '{form}'"


def candidates_sql(form: str, section: str) -> str:
    """Candidates cut by DuckDB's own regular expressions."""
    start, ends = (x if isinstance(x, str) else "|".join(x) for x in html.SECTIONS[form][section])
    start, ends = start.replace("'", "''"), ends.replace("'", "''")
    return f"""SELECT doc_id, body, '{section}' AS section_key, position, heading, trim(heading || string_split_regex(substr(body, CAST(position + length(heading) + 1 AS BIGINT)), '(?im){ends}')[1], ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS content FROM (
      SELECT doc_id, body, list_sum([length(p) FOR p IN parts[1:k]]) AS position, regexp_extract(parts[k + 1], '(?im)({start})', 1) AS heading FROM (
        SELECT doc_id, body, parts, unnest(range(1, len(parts))) AS k FROM (SELECT doc_id, body, string_split(regexp_replace(body, '(?im)({start})', chr(1) || '\\1', 'g'), chr(1)) AS parts FROM ({headed_sql(form)}))))"""


CANDIDATES = " UNION ALL ".join(candidates_sql(form, k) for form in html.SECTIONS for k in html.SECTIONS[form])
oracle_view("section_candidates", f"SELECT *, length(content) AS n FROM ({CANDIDATES}) WHERE length(content) >= 50")
oracle_view(
    "scored_candidates",
    r"""SELECT *, CASE WHEN contains(upper(substr(body, greatest(1, CAST(position AS BIGINT) - 1499), least(CAST(position AS BIGINT), 1500))), 'TABLE OF CONTENTS') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(trim(heading, chr(10) || chr(13) || ' '), '\.{3,}\s*\d+\s*$') THEN 2 ELSE 0 END
  + CASE WHEN len(regexp_extract_all(substr(body, CAST(position AS BIGINT) + 1, 3000), '(?im)^\s*ITEM\s+\d+[A-Z]?\b.*$')) >= 3 THEN 1 ELSE 0 END + CASE WHEN position < length(body) * 0.15 THEN 1 ELSE 0 END AS toc FROM section_candidates""",
)


def candidates(t) -> DataFrame:
    """All candidates of both forms: a scan a form."""
    return reduce(DataFrame.unionByName, [html.section_candidates(filings_with_headings(t, form), "doc_id", "body", form) for form in html.SECTIONS])


@query("F2", "SELECT doc_id, section_key, CAST(position AS INT) AS position, CAST(n AS INT) AS length FROM section_candidates")
def f2(t):
    return candidates(t).select("doc_id", "section_key", "position", "length")


@query("F3", "SELECT doc_id, section_key, CAST(position AS INT) AS position, CAST(toc AS INT) AS toc, toc >= 3 AS is_toc FROM scored_candidates")
def f3(t):
    return candidates(t).select("doc_id", "section_key", "position", "toc", (F.col("toc") >= 3).alias("is_toc"))


@query(
    "F4",
    """WITH a AS (SELECT *, min(CAST(toc >= 3 AS INT)) OVER (PARTITION BY doc_id, section_key) AS least FROM scored_candidates), b AS (SELECT *, max(n) OVER (PARTITION BY doc_id, section_key) AS longest FROM a WHERE CAST(toc >= 3 AS INT) = least),
  c AS (SELECT *, row_number() OVER (PARTITION BY doc_id, section_key ORDER BY position DESC) AS k FROM b WHERE n >= 0.4 * longest) SELECT doc_id, section_key, CAST(position AS INT) AS position, CAST(n AS INT) AS length, md5(content) AS digest FROM c WHERE k = 1""",
)
def f4(t):
    found = candidates(t).select("doc_id", "section_key", "position", "length", "toc", F.md5("content").alias("digest"))  # contents are not shuffled
    return html.best_candidate(found).select("doc_id", "section_key", "position", "length", "digest")


@query(
    "F5",
    f"""WITH d AS (SELECT doc_id, text, {WORDS.format('text')} AS w FROM documents), n AS (SELECT *, len(w) AS n, CAST(greatest(0, ceil((len(w) - 700) / 600.0)) AS INT) AS k FROM d),
  e AS (SELECT *, unnest(range(k + 1)) AS i FROM n)
  SELECT doc_id, CAST(i AS INT) AS chunk_index, CAST(least(700, n - i * 600) AS INT) AS tokens, md5(CASE WHEN n <= 700 THEN text ELSE array_to_string(w[i * 600 + 1 : i * 600 + 700], ' ') END) AS digest FROM e""",
)
def f5(t):
    return t.documents.select("doc_id", F.explode(text.chunks(F.col("text"))).alias("c")).select("doc_id", F.col("c.index").alias("chunk_index"), "c.tokens", F.md5("c.text").alias("digest"))


oracle_view("said", f"SELECT transcript_id, speaker_role, speaker_role || ': ' || content AS text, {WORDS.format("speaker_role || ': ' || content")} AS w, row_number() OVER (PARTITION BY transcript_id ORDER BY turn_index) AS k FROM turns")
#: A turn after another: the number of its first chunk, that of the open chunk and its size after it (0: none is open).
oracle_view(
    "turn_chunks",
    """WITH RECURSIVE step AS (SELECT DISTINCT transcript_id, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS first, CAST(0 AS BIGINT) AS chunk, CAST(0 AS BIGINT) AS open FROM said
  UNION ALL SELECT s.transcript_id, s.k, CASE WHEN p.open > 0 AND p.open + len(w) > 700 THEN p.chunk + 1 ELSE p.chunk END,
      CASE WHEN p.open > 0 AND p.open + len(w) > 700 THEN p.chunk + 1 ELSE p.chunk END + CASE WHEN len(w) > 700 THEN (len(w) + 699) // 700 ELSE 0 END,
      CASE WHEN len(w) > 700 THEN 0 WHEN p.open > 0 AND p.open + len(w) <= 700 THEN p.open + len(w) ELSE len(w) END
    FROM step p JOIN said s ON s.transcript_id = p.transcript_id AND s.k = p.k + 1) SELECT * FROM step""",
)


@query(
    "F6",
    """SELECT transcript_id, CAST(chunk AS INT) AS chunk_index, CAST(sum(n) AS INT) AS tokens, array_to_string(list_sort(list(DISTINCT speaker_role)), ',') AS speakers, md5(string_agg(part, chr(10) || chr(10) ORDER BY k)) AS digest FROM (
    SELECT transcript_id, k, first AS chunk, speaker_role, text AS part, len(w) AS n FROM said JOIN turn_chunks USING (transcript_id, k) WHERE len(w) <= 700
    UNION ALL SELECT transcript_id, k, first + i, speaker_role, array_to_string(w[i * 700 + 1 : i * 700 + 700], ' '), least(700, len(w) - i * 700) FROM (SELECT *, unnest(range((len(w) + 699) // 700)) AS i FROM said JOIN turn_chunks USING (transcript_id, k) WHERE len(w) > 700)
  ) GROUP BY transcript_id, chunk""",
)
def f6(t):
    return packing.pack_turns(t.turns).select("transcript_id", "chunk_index", "tokens", "speakers", F.md5("content").alias("digest"))


DOC_WORDS = "(SELECT doc_id, ' ' || trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) || ' ' AS w FROM documents)"


@query("F7", "SELECT doc_id, topic, array_to_string(found, ',') AS terms FROM (" + topic_rows_sql(DOC_WORDS) + ")")
def f7(t):
    return t.documents.select("doc_id", F.explode(text.topic_matches(F.col("text"))).alias("m")).select("doc_id", "m.topic", F.array_join("m.terms", ",").alias("terms"))


@query(
    "F10",
    """SELECT p.period, CAST(p.y AS INT) AS year, CAST(p.q AS INT) AS quarter, CAST(row_number() OVER (ORDER BY y DESC, q DESC) AS INT) AS pos FROM (SELECT y, q, y::VARCHAR || 'Q' || q::VARCHAR AS period FROM range(
    (SELECT CAST(year(max(event_date)) - 2 AS BIGINT) FROM corp_events), (SELECT CAST(year(max(event_date)) + 1 AS BIGINT) FROM corp_events)) a(y), range(1, 5) b(q)) p""",
)
def f10(t):
    return period_grid(t.corp_events.agg(F.year(F.max("event_date")).alias("last")), 3)


def period_grid(last: DataFrame, years: int) -> DataFrame:
    """Fiscal periods of the last years, newest first, made as labels and parsed back with validation."""
    label = F.explode(F.flatten(F.transform(F.sequence(F.col("last") - years + 1, F.col("last")), lambda y: F.transform(F.sequence(F.lit(1), F.lit(4)), lambda q: F.concat(y.cast("string"), F.lit("Q"), q.cast("string"))))))
    x = last.select(label.alias("period")).where(F.col("period").rlike(r"^\d{4}Q[1-4]$"))
    x = x.select("period", F.regexp_extract("period", r"^(\d{4})", 1).cast("int").alias("year"), F.regexp_extract("period", r"Q([1-4])$", 1).cast("int").alias("quarter"))
    return x.withColumn("pos", F.row_number().over(Window.orderBy(F.desc("year"), F.desc("quarter"))))  # a few dozen rows


SIGNS = " ‘’“”–—•−"


@query("F11", f"SELECT doc_id, md5(replace(translate(concat('“…— ', text), '{SIGNS}', ' ''''\"\"----'), '…', '...')) AS digest FROM documents")
def f11(t):
    return t.documents.select("doc_id", F.md5(text.ascii_punctuation(F.concat(F.lit("“…— "), "text"))).alias("digest"))


CITED = "content || ' [S' || (turn_id % 4)::VARCHAR || '] and [S1] [S1]'"


@query("F12", f"SELECT turn_id, array_to_string(list_distinct_ordered, ',') AS labels, md5(regexp_replace({CITED}, '\\s*\\[S\\d+\\]', '', 'g')) AS stripped FROM (SELECT *, CASE WHEN turn_id % 4 = 1 THEN ['S1'] ELSE ['S' || (turn_id % 4)::VARCHAR, 'S1'] END AS list_distinct_ordered FROM turns)")
def f12(t):
    said = F.concat("content", F.lit(" [S"), (F.col("turn_id") % 4).cast("string"), F.lit("] and [S1] [S1]"))
    return t.turns.select("turn_id", F.array_join(citations(said), ",").alias("labels"), F.md5(without_citations(said)).alias("stripped"))


def citations(answer):
    """Cited labels, each once, in order of first use."""
    return F.array_distinct(F.regexp_extract_all(answer, F.lit(r"\[(S\d+)\]"), F.lit(1)))


def without_citations(answer):
    return F.regexp_replace(answer, r"\s*\[S\d+\]", "")


@query("F13", """SELECT event_key, sha256('{"version":"v1","ticker":"' || ticker || '","event":"' || event_key || '","date":"' || CAST(event_date AS VARCHAR) || '"}') AS cache_key FROM corp_events""")
def f13(t):
    scope = F.struct(F.lit("v1").alias("version"), "ticker", F.col("event_key").alias("event"), F.date_format("event_date", "yyyy-MM-dd").alias("date"))
    return t.corp_events.select("event_key", F.sha2(F.to_json(scope), 256).alias("cache_key"))


#: Leading hex digits of a row's hash that name its node, from the leaves to the root.
FINGERPRINT_LEVELS = (6, 4, 2, 0)


def fingerprint_sql(row: str, source: str) -> str:
    sql = f"SELECT sha256({row}) AS b, sha256({row}) AS h, 1 AS n FROM {source}"
    for digits in FINGERPRINT_LEVELS:
        sql = f"SELECT substr(b, 1, {digits}) AS b, sha256(string_agg(h, ',' ORDER BY b, h)) AS h, sum(n)::BIGINT AS n FROM ({sql}) GROUP BY 1"
    return f"SELECT h AS fingerprint, n AS rows FROM ({sql})"


@query("F14", fingerprint_sql("event_key || '|' || ticker || '|' || CAST(event_date AS VARCHAR)", "corp_events"))
def f14(t):
    return fingerprint(t.corp_events, ["event_key", "ticker", "event_date"])


def fingerprint(df: DataFrame, names: list[str]) -> DataFrame:
    """Order-insensitive hash of a dataset: a tree of 16 M buckets of row hashes, then at most 256 nodes under each node."""
    nodes = df.select(F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in names)), 256).alias("b")).select("b", F.col("b").alias("h"), F.lit(1).cast("long").alias("n"))
    for digits in FINGERPRINT_LEVELS:
        joined = F.array_join(F.array_sort(F.collect_list(F.struct("b", "h")))["h"], ",")
        nodes = nodes.groupBy(F.substring("b", 1, digits).alias("b")).agg(F.sha2(joined, 256).alias("h"), F.sum("n").alias("n"))
    return nodes.select(F.col("h").alias("fingerprint"), F.col("n").alias("rows"))


@query(
    "F16",
    f"""SELECT transcript_id, {r('p', 8)} AS positive, {r('n', 8)} AS negative, {r('u', 8)} AS neutral, {r('p - n', 8)} AS score FROM (SELECT transcript_id, sum({WT} * p_positive / (p_positive + p_negative + p_neutral)) / sum({WT}) AS p, sum({WT} * p_negative / (p_positive + p_negative + p_neutral)) / sum({WT}) AS n,
  sum({WT} * p_neutral / (p_positive + p_negative + p_neutral)) / sum({WT}) AS u FROM service_rows WHERE p_positive IS NOT NULL GROUP BY transcript_id)""",
)
def f16(t):
    x = service(t).where("p_positive IS NOT NULL")
    total, w = F.col("p_positive") + F.col("p_negative") + F.col("p_neutral"), F.greatest(F.coalesce("token_count", F.lit(1)), F.lit(1)).cast("double")
    share = lambda c: F.try_divide(F.sum(w * F.try_divide(F.col(c), total)), F.sum(w))
    agg = x.groupBy("transcript_id").agg(share("p_positive").alias("p"), share("p_negative").alias("n"), share("p_neutral").alias("u"))
    return agg.select("transcript_id", *(rounded(F.col(a), 8).alias(b) for a, b in (("p", "positive"), ("n", "negative"), ("u", "neutral"))), rounded(F.col("p") - F.col("n"), 8).alias("score"))


@query("F17", "SELECT event_id, json_extract_string(j, '$.kind') AS kind, CAST(json_extract(j, '$.value') AS DOUBLE) AS value FROM (SELECT event_id, json_object('kind', event_type, 'value', floor(value * 100) / 100) AS j FROM events)")
def f17(t):
    packed = t.events.select("event_id", F.to_json(F.struct(F.col("event_type").alias("kind"), (F.floor(F.col("value") * 100) / 100).alias("value"))).alias("j"))
    return packed.select("event_id", F.from_json("j", "kind string, value double").alias("x")).select("event_id", "x.kind", "x.value")


# retrieval

oracle_view("vectors", "SELECT chunk_id, ticker, corpus, CAST(embedding AS DOUBLE[]) AS v FROM chunk_vectors")
SCORE = r("list_dot_product(i.v, q.v) / (sqrt(list_dot_product(i.v, i.v)) * sqrt(list_dot_product(q.v, q.v)))")


def index_of(t) -> DataFrame:
    return t.chunk_vectors.withColumn("unit", unit("embedding"))


def queries_of(t, every: int = 50) -> DataFrame:
    """The stated query set: every vector whose id is divisible by `every`."""
    return index_of(t).where(F.col("chunk_id") % every == 0).select(F.col("chunk_id").alias("query_id"), F.col("unit").alias("q"))


def ranked_sql(where: str, within: str, k: int, more: str = "") -> str:
    return f"SELECT * FROM (SELECT q.chunk_id AS query_id, i.chunk_id, i.ticker, i.corpus, {SCORE} AS score, CAST(row_number() OVER (PARTITION BY q.chunk_id{within} ORDER BY {SCORE} DESC, i.chunk_id) AS INT) AS rank FROM vectors q JOIN vectors i ON q.chunk_id % 50 = 0 AND {where} {more}) WHERE rank <= {k}"


oracle_view("top10", ranked_sql("TRUE", "", 10))


@query("K1", "SELECT query_id, chunk_id, score, rank FROM top10")
def k1(t):
    return top_k(index_of(t), queries_of(t), 10).select("query_id", "chunk_id", "score", "rank")


@query("K2", f"SELECT query_id, chunk_id, score, rank FROM ({ranked_sql(chr(39) + 'filings' + chr(39) + ' = i.corpus AND upper(i.ticker) = ' + chr(39) + 'SRC1' + chr(39), '', 5)})")
def k2(t):
    return top_k(index_of(t).where("corpus = 'filings' AND upper(ticker) = 'SRC1'"), queries_of(t), 5).select("query_id", "chunk_id", "score", "rank")


@query("K3", f"SELECT query_id, ticker, corpus, chunk_id, score, rank FROM ({ranked_sql('TRUE', ', i.ticker, i.corpus', 2)})")
def k3(t):
    return top_k(index_of(t), queries_of(t), 2, ("ticker", "corpus")).select("query_id", "ticker", "corpus", "chunk_id", "score", "rank")


oracle_view("newest_chunks", "SELECT chunk_id FROM filing_chunks WHERE filing_date = (SELECT max(filing_date) FROM filing_chunks)")


@query("K4", f"SELECT query_id, chunk_id, score, rank FROM ({ranked_sql('i.chunk_id IN (SELECT chunk_id FROM newest_chunks)', '', 5)})")
def k4(t):
    last = F.broadcast(t.filing_chunks.agg(F.max("filing_date").alias("filing_date")))
    newest = t.filing_chunks.join(last, "filing_date").select("chunk_id")
    return top_k(index_of(t).join(newest, "chunk_id", "left_semi"), queries_of(t), 5).select("query_id", "chunk_id", "score", "rank")


@query("K9", "SELECT event_id, created_at, ticker, event_type FROM alerts_in ORDER BY created_at DESC, event_id DESC LIMIT 50")
def k9(t):
    return t.alerts_in.orderBy(F.desc("created_at"), F.desc("event_id")).limit(50).select("event_id", "created_at", "ticker", "event_type")


@query("J14", "SELECT p.query_id, p.rank, p.chunk_id, c.accession_number, c.section_key, c.filing_date FROM top10 p JOIN filing_chunks c ON c.chunk_id = p.chunk_id")
def j14(t):
    return top_k(index_of(t), queries_of(t), 10).select("query_id", "rank", "chunk_id").join(t.filing_chunks, "chunk_id").select("query_id", "rank", "chunk_id", "accession_number", "section_key", "filing_date")


@query("J15", "SELECT coalesce(v.chunk_id, c.chunk_id) AS chunk_id, CASE WHEN c.chunk_id IS NULL THEN 'pruned' WHEN v.chunk_id IS NULL THEN 'pending' ELSE 'embedded' END AS state FROM chunk_vectors v FULL JOIN filing_chunks c ON c.chunk_id = v.chunk_id")
def j15(t):
    index, rows = t.chunk_vectors.select("chunk_id", F.lit(1).alias("a")), t.filing_chunks.select("chunk_id", F.lit(1).alias("b"))
    state = F.when(F.col("b").isNull(), "pruned").when(F.col("a").isNull(), "pending").otherwise("embedded")
    return index.join(rows, "chunk_id", "full_outer").select("chunk_id", state.alias("state"))


#: Aliases made by hand, beside ticker and name of every company: what people call it.
HAND_ALIASES = [("Brand#11", "acme"), ("Brand#12", "ørsted"), ("Brand#13", "électricité de l'est"), ("Brand#21", "big blue"), ("Brand#22", "müller & söhne"), ("Brand#31", "3m"), ("Brand#32", "the house of brand")]
#: Questions name a company by its ticker, its name or a hand-made alias, or not at all.
oracle_view("named_companies", "SELECT ticker, lower(ticker) || ' ' || lower(sector) AS name, row_number() OVER (ORDER BY ticker) - 1 AS i, count(*) OVER () AS n FROM companies")
HAND_SQL = ", ".join("('{}', '{}')".format(t, a.replace("'", "''")) for t, a in HAND_ALIASES)
oracle_view(
    "questions",
    f"""SELECT t.turn_id, CASE turn_id % 4 WHEN 0 THEN content || ' And ' || upper(c.name) || '?' WHEN 1 THEN content || ' And ' || c.ticker || '?' WHEN 2 THEN content || ' And ' || upper(h.alias) || '?' ELSE content END AS content
  FROM turns t JOIN named_companies c ON c.i = t.turn_id % c.n JOIN (SELECT alias, row_number() OVER (ORDER BY ticker) - 1 AS k FROM (VALUES {HAND_SQL}) v(ticker, alias)) h ON h.k = t.turn_id % {len(HAND_ALIASES)} WHERE t.speaker_role = 'analyst'""",
)
oracle_view("aliases", f"SELECT alias, max(ticker) AS ticker FROM (SELECT ticker, lower(ticker) AS alias FROM companies UNION ALL SELECT ticker, name FROM named_companies UNION ALL SELECT c.ticker, h.alias FROM companies c JOIN (VALUES {HAND_SQL}) h(ticker, alias) ON h.ticker = c.ticker) GROUP BY alias")


def mentions_sql(key: str, source: str) -> str:
    """Mentions in the questions of a source."""
    return rf"""SELECT {key}, ticker, min(pos) AS pos FROM (SELECT {key}, ticker, length(regexp_extract(' ' || lower(content), '(?s)^(.*?)[^\p{{L}}\p{{N}}_]' || regexp_escape(alias) || '(?:[^\p{{L}}\p{{N}}_]|$)', 1)) AS pos
  FROM {source} JOIN aliases ON regexp_matches(' ' || lower(content), '[^\p{{L}}\p{{N}}_]' || regexp_escape(alias) || '([^\p{{L}}\p{{N}}_]|$)')) GROUP BY {key}, ticker"""


oracle_view("mentions", mentions_sql("turn_id", "questions"))


def questions(t) -> DataFrame:
    names = named_companies(t).withColumns({"i": F.row_number().over(Window.orderBy("ticker")) - 1, "n": F.count(F.lit(1)).over(Window.partitionBy())})  # a row per company
    name, one = F.upper("name"), F.col("turn_id") % 4
    hand = F.upper(F.element_at(F.array(*(F.lit(a) for _, a in sorted(HAND_ALIASES))), (F.col("turn_id") % len(HAND_ALIASES) + 1).cast("int")))
    asked = t.turns.where("speaker_role = 'analyst'").join(F.broadcast(names.drop("alias")), F.expr("turn_id % n = i"))
    return asked.select("turn_id", F.when(one == 0, F.concat("content", F.lit(" And "), name, F.lit("?"))).when(one == 1, F.concat("content", F.lit(" And "), names["ticker"], F.lit("?"))).when(one == 2, F.concat("content", F.lit(" And "), hand, F.lit("?"))).otherwise(F.col("content")).alias("content"))


def named_companies(t) -> DataFrame:
    return t.companies.select("ticker", F.concat(F.lower("ticker"), F.lit(" "), F.lower("sector")).alias("name"))


def alias_map(t) -> DataFrame:
    """Aliases (alias, ticker): ticker, name and hand-made ones; the greatest ticker keeps an alias of several."""
    hand = t.spark.createDataFrame(HAND_ALIASES, "ticker string, alias string").join(t.companies.select("ticker"), "ticker", "left_semi")
    named = named_companies(t)
    every = named.select("ticker", F.lower("ticker").alias("alias")).unionByName(named.select("ticker", F.col("name").alias("alias"))).unionByName(hand)
    return every.groupBy("alias").agg(F.max("ticker").alias("ticker"))


def mentions(asked: DataFrame, aliases: DataFrame) -> DataFrame:
    """Tickers that a question names by an alias at word borders, with the first position (from 0).

    A text is split at word borders; every phrase of as many pieces as the longest alias has meets the
    dictionary on equality, so the cost does not grow with the dictionary. An alias begins with a letter, digit or _.
    """
    aliases = written(aliases, "aliases")
    word, other = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]"
    pieces = lambda c: F.filter(F.split(c, f"(?<={word})(?={other})|(?<={other})(?={word})"), lambda p: p != "")
    longest = F.broadcast(aliases.agg(F.coalesce(F.max(F.size(pieces("alias"))), F.lit(1)).alias("most")))
    x = asked.join(longest, F.lit(True)).select("turn_id", "most", pieces(F.lower("content")).alias("p"))
    x = x.select("turn_id", "most", "p", F.explode(F.sequence(F.lit(1), F.greatest(F.size("p"), F.lit(1)))).alias("k")).where(F.try_element_at("p", F.col("k")).rlike(f"^{word}"))
    x = x.select("turn_id", "p", "k", F.explode(F.expr("sequence(1, most, 2)")).alias("m")).where("k + m - 1 <= size(p)")
    x = x.withColumn("alias", F.array_join(F.slice("p", F.col("k"), F.col("m")), "")).join(few(aliases), "alias")
    pos = F.length(F.array_join(F.slice("p", F.lit(1), F.col("k") - 1), ""))
    return x.groupBy("turn_id", "ticker").agg(F.min(pos).alias("pos"))


@query("J16", "SELECT turn_id, ticker, CAST(row_number() OVER (PARTITION BY turn_id ORDER BY pos, ticker) AS INT) AS n FROM mentions")
def j16(t):
    x = mentions(questions(t), alias_map(t))
    return x.select("turn_id", "ticker", F.row_number().over(Window.partitionBy("turn_id").orderBy("pos", "ticker")).alias("n"))


# composite services


@query(
    "C13",
    f"""WITH lp AS (SELECT ticker, max(trading_date) FILTER (n = 1) AS latest_date, max(adjusted_close) FILTER (n = 1) AS latest, max(adjusted_close) FILTER (n = 2) AS previous FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY trading_date DESC) AS n FROM bars_daily) WHERE n <= 2 GROUP BY ticker),
  le AS (SELECT ticker, event_key, event_date FROM (SELECT *, row_number() OVER (PARTITION BY ticker ORDER BY event_date DESC, event_source, event_key DESC) AS n FROM corp_events) WHERE n = 1)
  SELECT w.watchlist_id, w.ticker, m.score AS management_score, m.label AS management_label, lp.latest_date, {r('lp.latest')} AS latest, {r('lp.latest / lp.previous - 1')} AS return_1d, le.event_key AS latest_event, le.event_date AS latest_event_date FROM watchlist_items w LEFT JOIN lp ON lp.ticker = w.ticker LEFT JOIN le ON le.ticker = w.ticker
  LEFT JOIN (SELECT ticker, score, label FROM ({summary_sql("(SELECT s.* FROM service_rows s JOIN (SELECT ticker, max(transcript_id) AS last FROM turns GROUP BY ticker) l ON l.ticker = s.ticker AND l.last = s.transcript_id WHERE s.speaker_group = 'management' AND s.status IS NOT NULL)", 'ticker')})) m ON m.ticker = 'T' || right(w.ticker, 1)""",
)
def c13(t):
    order = Window.partitionBy("ticker").orderBy(F.desc("event_date"), "event_source", F.desc("event_key"))
    newest = t.corp_events.withColumn("n", F.row_number().over(order)).where("n = 1").select("ticker", F.col("event_key").alias("latest_event"), F.col("event_date").alias("latest_event_date"))
    last = t.turns.groupBy("ticker").agg(F.max("transcript_id").alias("transcript_id"))  # calls of a company go by its last digit
    said = service(t).where("speaker_group = 'management' AND status IS NOT NULL").join(last, ["ticker", "transcript_id"], "left_semi")
    mood = sent.labelled(said.groupBy("ticker").agg(*sent.summary())).select(F.col("ticker").alias("calls"), F.col("score").alias("management_score"), F.col("label").alias("management_label"))
    x = t.watchlist_items.join(latest_two(t.bars_daily), "ticker", "left").join(newest, "ticker", "left").join(mood, F.concat(F.lit("T"), F.right("ticker", F.lit(1))) == F.col("calls"), "left")
    return x.select("watchlist_id", "ticker", "management_score", "management_label", "latest_date", rounded("latest").alias("latest"), rounded("return_1d").alias("return_1d"), "latest_event", "latest_event_date")


RUNS = "SELECT run_id, max(CASE WHEN status = 'FAILED' THEN 1 ELSE 0 END) AS failed, max(completed_at) AS done_at FROM stage_runs GROUP BY run_id"
oracle_view("runs", RUNS)


@query(
    "C14",
    """WITH now AS (SELECT max(completed_at) AS n FROM stage_runs), tracked AS (SELECT ticker FROM watchlist_items UNION SELECT 'SPY'), day AS (SELECT max(trading_date) AS d FROM bars_daily),
  m AS (SELECT t.ticker, max(b.trading_date) AS latest FROM tracked t LEFT JOIN bars_daily b ON b.ticker = t.ticker GROUP BY t.ticker),
  a AS (SELECT count(*) AS tracked, count(*) FILTER (d - latest <= 5) AS fresh FROM m, day), s AS (SELECT max(done_at) FILTER (failed = 0) AS ok, arg_max(failed, struct_pack(a := done_at, b := run_id)) AS last_failed FROM runs)
  SELECT tracked, fresh, array_to_string([x FOR x IN [CASE WHEN fresh < tracked THEN 'market_data_stale' END, CASE WHEN ok IS NULL THEN 'scheduler_never_succeeded' WHEN epoch(n) - epoch(ok) > 72 * 3600 THEN 'scheduler_stale' END, CASE WHEN last_failed = 1 THEN 'latest_scheduler_failed' END] IF x IS NOT NULL], ',') AS issues, fresh = tracked AND ok IS NOT NULL AND epoch(n) - epoch(ok) <= 72 * 3600 AND last_failed = 0 AS ready, activity FROM a, s, now,
  (SELECT string_agg(source || ':' || n::VARCHAR || ':' || coalesce(seen::VARCHAR, '-'), ',' ORDER BY source) AS activity FROM (SELECT CASE event_source WHEN 'sec_filing' THEN 'sec_filings' ELSE 'earnings_transcripts' END AS source, count(*) AS n, max(event_date) AS seen FROM corp_events GROUP BY 1
    UNION ALL SELECT 'prospective_predictions', count(*), max(feature_as_of_date) FROM ledger
    UNION ALL SELECT 'sentiment', sum(n)::BIGINT, max(seen) FROM (SELECT count(*) AS n, max(DATE '2024-01-01' + CAST(turn_id % 365 AS INT)) AS seen FROM turn_scores UNION ALL SELECT count(*), max(DATE '2023-01-01' + CAST(chunk_id % 365 AS INT)) FROM chunk_scores)))""",
)
def c14(t):
    return freshness(t)


def freshness(t, price_days: int = 5, run_hours: int = 72) -> DataFrame:
    """Age of prices and of the last good run against their limits, as issue codes, and what each source has and since when."""
    tracked = t.watchlist_items.select("ticker").union(t.bars_daily.where("ticker = 'SPY'").select("ticker")).distinct()
    latest = t.bars_daily.groupBy("ticker").agg(F.max("trading_date").alias("latest"))
    day = t.bars_daily.agg(F.max("trading_date").alias("d"))
    market = tracked.join(latest, "ticker", "left").join(F.broadcast(day)).agg(ONE().alias("tracked"), F.count_if(F.datediff("d", "latest") <= price_days).alias("fresh"))
    runs = t.stage_runs.groupBy("run_id").agg(F.max(F.when(F.col("status") == "FAILED", 1).otherwise(0)).alias("failed"), F.max(F.col("completed_at").cast("timestamp")).alias("at"))
    state = runs.agg(F.max(F.when(F.col("failed") == 0, F.col("at"))).alias("ok"), F.max_by("failed", F.struct("at", "run_id")).alias("last_failed"), F.max("at").alias("now"))
    age = F.unix_micros("now") - F.unix_micros("ok")
    codes = F.array(
        F.when(F.col("fresh") < F.col("tracked"), "market_data_stale"),
        F.when(F.col("ok").isNull(), "scheduler_never_succeeded").when(age > run_hours * 3_600_000_000, "scheduler_stale"),
        F.when(F.col("last_failed") == 1, "latest_scheduler_failed"),
    )
    scored = t.turn_scores.agg(ONE().alias("n"), F.max(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("turn_id") % 365).cast("int"))).alias("at"))
    scored = scored.union(t.chunk_scores.agg(ONE(), F.max(F.date_add(F.lit("2023-01-01").cast("date"), (F.col("chunk_id") % 365).cast("int")))))
    source = F.when(F.col("event_source") == "sec_filing", "sec_filings").otherwise("earnings_transcripts").alias("source")
    activity = t.corp_events.groupBy(source).agg(ONE().alias("n"), F.max("event_date").alias("at"))
    activity = activity.unionByName(t.ledger.agg(F.lit("prospective_predictions").alias("source"), ONE().alias("n"), F.max("feature_as_of_date").alias("at")))
    activity = activity.unionByName(scored.agg(F.lit("sentiment").alias("source"), F.sum("n").alias("n"), F.max("at").alias("at")))  # the later of the two
    line = F.concat_ws(":", "source", F.col("n").cast("string"), F.coalesce(F.col("at").cast("string"), F.lit("-")))
    activity = activity.agg(F.array_join(F.array_sort(F.collect_list(line)), ",").alias("activity"))  # four rows
    issues = F.array_join(F.array_compact(codes), ",")
    return market.join(F.broadcast(state)).join(F.broadcast(activity)).select("tracked", "fresh", issues.alias("issues"), (issues == "").alias("ready"), "activity")


@query(
    "C15",
    f"""WITH f AS (SELECT ticker, accession_number, row_number() OVER (PARTITION BY ticker ORDER BY filing_date DESC, accession_number DESC) AS k FROM (SELECT DISTINCT ticker, accession_number, filing_date FROM filing_chunks)),
  s AS ({summary_sql('filing_topics', 'ticker, accession_number, topic')}), x AS (SELECT s.*, row_number() OVER (PARTITION BY s.ticker, s.accession_number ORDER BY eligible DESC, topic) AS n FROM s JOIN f ON f.ticker = s.ticker AND f.accession_number = s.accession_number AND f.k <= 2)
  SELECT ticker, accession_number, string_agg(topic || ':' || coalesce(label, '-'), ',' ORDER BY n) AS signals FROM x WHERE n <= 6 GROUP BY ticker, accession_number""",
)
def c15(t):
    rows = filing_rows(t)
    newest = rows.select("ticker", "accession_number", "filing_date").distinct().withColumn("k", F.row_number().over(Window.partitionBy("ticker").orderBy(F.desc("filing_date"), F.desc("accession_number")))).where("k <= 2").select("ticker", "accession_number")
    topics = sent.by_topic(rows, ["ticker", "accession_number"]).join(newest, ["ticker", "accession_number"], "left_semi")
    top = topics.withColumn("n", F.row_number().over(Window.partitionBy("ticker", "accession_number").orderBy(F.desc("eligible"), "topic"))).where("n <= 6")
    parts = F.array_sort(F.collect_list(F.struct("n", F.concat("topic", F.lit(":"), F.coalesce("label", F.lit("-"))).alias("s"))))
    return top.groupBy("ticker", "accession_number").agg(parts.alias("p")).select("ticker", "accession_number", F.array_join(F.col("p.s"), ",").alias("signals"))


@query(
    "C16",
    """WITH m AS (SELECT turn_id, string_agg(ticker, ',' ORDER BY pos, ticker) AS tickers FROM mentions GROUP BY turn_id), q AS (SELECT r.turn_id, r.corpora, m.tickers, r.turn_id % s.n * 50 AS query_id FROM routed r CROSS JOIN (SELECT max(chunk_id) // 50 + 1 AS n FROM vectors) s LEFT JOIN m ON m.turn_id = r.turn_id WHERE r.wants_text),
  x AS (SELECT q.turn_id, q.tickers, p.corpus, p.chunk_id, row_number() OVER (PARTITION BY q.turn_id ORDER BY p.corpus, p.rank) AS n FROM q JOIN top10 p ON p.query_id = q.query_id AND contains(q.corpora, p.corpus))
  SELECT turn_id, coalesce(tickers, '') AS tickers, 'S' || n::VARCHAR AS label, corpus, chunk_id FROM x""",
)
def c16(t):
    """Numbered sources of each question: mentioned tickers, routed corpora, nearest chunks."""
    asked = t.turns.where("speaker_role = 'analyst'")
    routed = asked.select("turn_id", *(c.alias(k) for k, c in text.route(F.col("content")).items())).where("wants_text")
    named = mentions(questions(t), alias_map(t)).groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ticker"))).alias("m")).select("turn_id", F.array_join(F.col("m.ticker"), ",").alias("tickers"))
    near = top_k(index_of(t), queries_of(t), 10).select("query_id", "chunk_id", "corpus", "rank")
    asked_for = t.chunk_vectors.agg((F.floor(F.max("chunk_id") / 50) + 1).alias("n"))  # questions go round all query vectors
    routed = routed.join(F.broadcast(asked_for), F.lit(True)).withColumn("query_id", F.col("turn_id") % F.col("n") * 50)
    x = routed.join(near, "query_id").where(F.expr("contains(corpora, corpus)")).join(named, "turn_id", "left")
    n = F.row_number().over(Window.partitionBy("turn_id").orderBy("corpus", "rank"))
    return x.select("turn_id", F.coalesce("tickers", F.lit("")).alias("tickers"), F.concat(F.lit("S"), n.cast("string")).alias("label"), "corpus", "chunk_id")


# evaluation suites

oracle_view("case_questions", "SELECT b.item_id AS case_id, c.ticker, b.text || ' And the stock of ' || c.ticker || '?' AS content FROM benchmark b JOIN named_companies c ON c.i = b.item_id % c.n")
oracle_view("case_mentions", mentions_sql("case_id", "(SELECT case_id, content FROM case_questions)"))
oracle_view("case_routes", routed_sql("case_id", "case_questions"))
PERIOD = "CAST(year(filing_date) AS VARCHAR) || 'Q' || CAST(quarter(filing_date) AS VARCHAR)"
ALLOWED_PERIODS = ("2020Q1", "2020Q2", "2020Q3", "2021Q1", "2021Q4")
oracle_view(
    "graded",
    f"""WITH e AS (SELECT case_id, list(DISTINCT e.ticker) AS tickers, list(DISTINCT lang) AS langs, list(DISTINCT form_type) AS forms, list(DISTINCT {PERIOD}) AS periods, list(DISTINCT section_key) AS sections, count(*) AS n,
    bool_or(contains(lower(content), 'the') OR contains(lower(content), 'der')) AS terms FROM eval_cases e JOIN filing_chunks f ON f.chunk_id = e.doc_id GROUP BY case_id),
  m AS (SELECT case_id, string_agg(ticker, ',' ORDER BY pos, ticker) AS found FROM case_mentions GROUP BY case_id),
  x AS (SELECT e.*, q.ticker AS asked, coalesce(found, '') AS found, corpora, wants_text, CASE WHEN wants_market THEN coalesce(found, '') ELSE '' END AS market FROM e JOIN case_questions q ON q.case_id = e.case_id JOIN case_routes r ON r.case_id = e.case_id LEFT JOIN m ON m.case_id = e.case_id)
  SELECT case_id, unnest(['detected_tickers', 'routed_source_types', 'text_search_enabled', 'min_sources', 'max_sources', 'required_source_types', 'required_source_tickers', 'allowed_types', 'fiscal_periods', 'form_types', 'section_keys', 'content_terms_any', 'min_market_snapshots', 'market_tickers']) AS name,
    unnest([found = asked, corpora = 'filings,transcripts', wants_text, n >= 1, n <= 2, list_contains(langs, 'en'), list_contains(tickers, 'src' || (case_id % 20)::VARCHAR), len([y FOR y IN langs IF y NOT IN ('en', 'fr')]) = 0, len([y FOR y IN periods IF y NOT IN {ALLOWED_PERIODS}]) = 0,
      len([y FOR y IN forms IF y <> '10-K']) = 0, list_contains(sections, 'item_7_mda'), terms, market <> '', market = asked]) AS passed FROM x""",
)


def graded(t) -> DataFrame:
    """Check rows (case_id, name, passed) of retrieval cases: what was detected, routed, found and priced for each."""
    company = named_companies(t).withColumns({"i": F.row_number().over(Window.orderBy("ticker")) - 1, "count": F.count(F.lit(1)).over(Window.partitionBy())})  # a row per company
    asked = t.benchmark.join(F.broadcast(company), F.expr("item_id % count = i")).select(F.col("item_id").alias("case_id"), F.col("ticker").alias("asked"), F.concat("text", F.lit(" And the stock of "), "ticker", F.lit("?")).alias("content"))
    found = mentions(asked.withColumnRenamed("case_id", "turn_id"), alias_map(t)).groupBy("turn_id").agg(F.array_sort(F.collect_list(F.struct("pos", "ticker"))).alias("m"))
    routed = asked.select("case_id", "asked", *(c.alias(k) for k, c in text.route(F.col("content")).items()))
    routed = routed.join(found.select(F.col("turn_id").alias("case_id"), F.col("m.ticker").alias("found")), "case_id", "left").withColumn("found", F.coalesce("found", F.array().cast("array<string>")))
    sources = t.eval_cases.join(t.filing_chunks.withColumnRenamed("ticker", "_ticker"), F.col("chunk_id") == F.col("doc_id"))
    period = F.concat(F.year("filing_date").cast("string"), F.lit("Q"), F.quarter("filing_date").cast("string"))
    e = sources.groupBy("case_id").agg(
        *(F.collect_set(c).alias(n) for c, n in (("ticker", "tickers"), ("lang", "langs"), ("form_type", "forms"), (period, "periods"), ("section_key", "sections"))),
        ONE().alias("n"), F.bool_or(F.lower("content").contains("the") | F.lower("content").contains("der")).alias("terms"),
    )
    within = lambda c, allowed: (F.size(c) > 0) & (F.size(F.array_except(c, F.array(*(F.lit(a) for a in allowed)))) == 0)
    market = F.when(F.col("wants_market"), F.col("found")).otherwise(F.array().cast("array<string>"))
    checks = {
        "detected_tickers": F.col("found") == F.array("asked"), "routed_source_types": F.col("corpora") == "filings,transcripts", "text_search_enabled": F.col("wants_text"),
        "min_sources": F.col("n") >= 1, "max_sources": F.col("n") <= 2, "required_source_types": F.array_contains("langs", "en"),
        "required_source_tickers": F.array_contains("tickers", F.concat(F.lit("src"), (F.col("case_id") % 20).cast("string"))),
        "allowed_types": within("langs", ("en", "fr")), "fiscal_periods": within("periods", ALLOWED_PERIODS), "form_types": within("forms", ("10-K",)), "section_keys": F.array_contains("sections", "item_7_mda"),
        "content_terms_any": F.col("terms"), "min_market_snapshots": F.size(market) >= 1, "market_tickers": market == F.array("asked"),
    }
    return e.join(routed, "case_id").select("case_id", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), c.alias("passed")) for k, c in checks.items()))).alias("x")).select("case_id", "x.name", "x.passed")


@query("Q1", "SELECT case_id, name, passed FROM graded")
def q1(t):
    return graded(t)


#: Phrases by which an answer abstains.
ABSTENTIONS = ("did not find", "does not provide enough", "do not provide enough", "insufficient evidence", "not enough evidence")
oracle_view(
    "answers",
    f"""WITH a AS (SELECT turn_id, ticker, lower(content) AS low, trim(content) <> '' AS said, CASE WHEN turn_id % 4 = 1 THEN ['S1'] ELSE ['S' || (turn_id % 4)::VARCHAR, 'S1'] END AS labels FROM turns WHERE speaker_role = 'executive')
  SELECT turn_id, unnest(['non_empty_answer', 'valid_citation_labels', 'citations_present', 'max_sources', 'required_source_types', 'required_source_tickers', 'required_cited_source_tickers', 'required_market_tickers', 'answer_terms_any', 'answer_terms_all', 'abstention_behavior']) AS name,
    unnest([said, len([x FOR x IN labels IF x NOT IN ('S1', 'S2')]) = 0, TRUE, TRUE, TRUE, ticker IN ('T1', 'T2'), ticker = 'T1' OR list_contains(labels, 'S2'), turn_id % 2 = 0, contains(low, 'the') OR contains(low, 'der'), contains(low, 'the') AND contains(low, 'of'),
      ({' OR '.join(f"contains(low, '{x}')" for x in ABSTENTIONS)}) = (turn_id % 5 = 0)]) AS passed FROM a""",
)


def graded_answers(turns: DataFrame) -> DataFrame:
    """Check rows (turn_id, name, passed) of answers: labels, sources, cited sources, prices, terms, abstention.

    An answer has two sources: its own call and a filing of T1; every second one has a price snapshot.
    """
    said = F.concat("content", F.lit(" [S"), (F.col("turn_id") % 4).cast("string"), F.lit("] and [S1] [S1]"))
    source = lambda label, ticker, kind: F.struct(F.lit(label).alias("source"), ticker.alias("ticker"), F.lit(kind).alias("type"))
    a = turns.where("speaker_role = 'executive'").withColumn("labels", citations(said)).withColumn("sources", F.array(source("S1", F.col("ticker"), "transcripts"), source("S2", F.lit("T1"), "filings")))
    a = a.withColumn("market", F.when(F.col("turn_id") % 2 == 0, F.array("ticker")).otherwise(F.array().cast("array<string>")))
    a = a.withColumn("cited", F.filter("sources", lambda s: F.array_contains(F.col("labels"), s["source"])))
    low = F.lower("content")
    has = lambda c, *values: F.size(F.array_except(F.array(*values), F.col(c))) == 0
    checks = {
        "non_empty_answer": F.trim("content") != "", "valid_citation_labels": F.size(F.array_except("labels", F.col("sources.source"))) == 0, "citations_present": F.size("labels") > 0,
        "max_sources": F.size("sources") <= 2, "required_source_types": has("sources.type", F.lit("transcripts"), F.lit("filings")), "required_source_tickers": F.size(F.array_except("sources.ticker", F.array(F.lit("T1"), F.lit("T2")))) == 0,
        "required_cited_source_tickers": has("cited.ticker", F.lit("T1")), "required_market_tickers": F.col("market") == F.array("ticker"),
        "answer_terms_any": low.contains("the") | low.contains("der"), "answer_terms_all": low.contains("the") & low.contains("of"),
        "abstention_behavior": text.has_any(F.col("content"), list(ABSTENTIONS)) == (F.col("turn_id") % 5 == 0),
    }
    return a.select("turn_id", F.explode(F.array(*(F.struct(F.lit(k).alias("name"), c.alias("passed")) for k, c in checks.items()))).alias("x")).select("turn_id", "x.name", "x.passed")


@query("Q2", "SELECT turn_id, name, passed FROM answers")
def q2(t):
    return graded_answers(t.turns)


REPORT = "SELECT suite, count(DISTINCT id) AS cases, count(DISTINCT id) - count(DISTINCT id) FILTER (NOT passed) AS cases_passed, count(*) AS checks, count(*) FILTER (passed) AS checks_passed FROM (SELECT 'retrieval' AS suite, case_id AS id, passed FROM graded UNION ALL SELECT 'responses', turn_id, passed FROM answers) GROUP BY suite"
oracle_view("suite_report", REPORT)


def suite_report(t) -> DataFrame:
    rows = graded(t).select(F.lit("retrieval").alias("suite"), F.col("case_id").alias("id"), "passed").unionByName(graded_answers(t.turns).select(F.lit("responses").alias("suite"), F.col("turn_id").alias("id"), "passed"))
    by_case = rows.groupBy("suite", "id").agg(F.bool_and("passed").alias("ok"), ONE().alias("n"), F.count_if("passed").alias("p"))
    return by_case.groupBy("suite").agg(ONE().alias("cases"), F.count_if("ok").alias("cases_passed"), F.sum("n").alias("checks"), F.sum("p").alias("checks_passed"))


#: Dimensions that a judge scores, each from 1 to 5.
DIMENSIONS = ("groundedness", "relevance", "completeness", "citation_quality")
JUDGED = ", ".join(r(f"avg(CAST(turn_id % {5 - k} + {k + 1} AS DOUBLE))", 2) + f" AS {d}" for k, d in enumerate(DIMENSIONS))


@query("Q3", f"SELECT s.*, {r('checks_passed / checks', 4)} AS rate, {', '.join(DIMENSIONS)} FROM suite_report s LEFT JOIN (SELECT 'responses' AS suite, {JUDGED} FROM turns WHERE speaker_role = 'executive' AND turn_id % 3 = 0) j ON j.suite = s.suite")
def q3(t):
    """Report with the judge's average score per dimension; every third answer has been judged."""
    judged = t.turns.where("speaker_role = 'executive' AND turn_id % 3 = 0").select(*((F.col("turn_id") % (5 - k) + k + 1).cast("double").alias(d) for k, d in enumerate(DIMENSIONS)))
    means = judged.agg(*(rounded(F.avg(d), 2).alias(d) for d in DIMENSIONS)).withColumn("suite", F.lit("responses"))
    return suite_report(t).withColumn("rate", rounded(ratio("checks_passed", "checks"), 4)).join(F.broadcast(means), "suite", "left")


@query("Q4", "SELECT count(*) AS cases, count(*) - count(DISTINCT item_id) AS duplicate_ids, count(*) FILTER (item_id IS NULL) AS missing_ids, count(*) FILTER (trim(coalesce(text, '')) = '') AS blank_questions, CAST(0 AS BIGINT) AS unsupported FROM benchmark")
def q4(t):
    cases = t.benchmark.withColumn("expect", F.create_map(F.lit("min_sources"), F.lit("1"), F.lit("required_source_types"), F.lit("en")))
    unsupported = F.size(F.array_except(F.map_keys("expect"), F.array(*(F.lit(k) for k in ("min_sources", "max_sources", "required_source_types", "required_source_tickers"))))) > 0
    return cases.agg(ONE().alias("cases"), (ONE() - F.countDistinct("item_id")).alias("duplicate_ids"), F.count_if(F.col("item_id").isNull()).alias("missing_ids"), F.count_if(F.trim(F.coalesce("text", F.lit(""))) == "").alias("blank_questions"), F.count_if(unsupported).alias("unsupported"))


@query(
    "Q5",
    f"""SELECT turn_id, CAST(len([x FOR x IN c IF x]) AS INT) AS passed, {r('len([x FOR x IN c IF x]) / 7', 3)} AS score, len([x FOR x IN c IF x]) = 7 AS accepted FROM (
  SELECT turn_id, [turn_id % 7 <> 0, length(trim(content)) >= 80, turn_id % 6 <> 5, turn_id % 6 <> 5 AND turn_id % 4 IN (1, 2), turn_id % 6 <> 5 AND ticker IN ('T' || (turn_id % 3)::VARCHAR, 'T3'), turn_id % 6 <> 5 AND turn_id % 5 <> 0, turn_id % 2 <> 0 OR turn_id % 3 <> 0] AS c FROM turns WHERE speaker_role = 'executive')""",
)
def q5(t):
    """Briefs over calls: some lack a section, sources, a price reaction, or have a source of another call."""
    n, none = F.col("turn_id"), F.lit(None).cast("string")
    brief = F.struct(
        F.lit("h").alias("headline"), F.col("content").alias("executive_summary"), F.array(F.lit("x")).alias("key_developments"), F.array().cast("array<string>").alias("topic_signals"), F.when(n % 3 == 0, "").otherwise("up").alias("market_reaction"),
        F.concat(F.lit("see [S"), (n % 4).cast("string"), F.lit("]")).alias("risks"), F.array().cast("array<string>").alias("watch_items"), F.when(n % 7 == 0, none).otherwise("none").alias("limitations"),
    )
    call = F.col("transcript_id")
    source = lambda label, ticker, of: F.struct(F.lit(label).alias("source"), ticker.alias("ticker"), of.alias("transcript_id"))
    two = F.array(source("S1", F.concat(F.lit("T"), (n % 3).cast("string")), call), source("S2", F.lit("T3"), F.when(n % 5 == 0, call + 1).otherwise(call)))
    x = t.turns.where("speaker_role = 'executive'").select("turn_id", "ticker", "transcript_id", F.to_json(brief).alias("brief"), F.when(n % 6 == 5, F.slice(two, 1, 0)).otherwise(two).alias("sources"), (n % 2 == 0).alias("has_market"))
    return brief_gate(x)


SECTIONS = ("headline", "executive_summary", "key_developments", "topic_signals", "market_reaction", "risks", "watch_items", "limitations")
LISTS = ("key_developments", "topic_signals", "watch_items")


def brief_gate(briefs: DataFrame) -> DataFrame:
    """Seven checks of a JSON brief (turn_id, ticker, transcript_id, brief, sources, has_market), which must all pass.

    All sections, a summary of substance, sources, citations of these alone, the ticker among them, no
    source of another call, prices told where there are any.
    """
    schema = ", ".join(f"{s} {'array<string>' if s in LISTS else 'string'}" for s in SECTIONS)
    x = briefs.withColumn("b", F.from_json("brief", schema))
    cited = citations(F.concat_ws("\n", *(F.col(f"b.{s}") for s in SECTIONS)))
    some = F.size("sources") > 0
    checks = [
        F.expr(" AND ".join(f"b.{s} IS NOT NULL" for s in SECTIONS)), (F.length(F.trim("b.executive_summary")) >= 80) & (F.size("b.key_developments") > 0), some,
        (F.size(cited) > 0) & (F.size(F.array_except(cited, F.col("sources.source"))) == 0), F.array_contains(F.transform("sources.ticker", F.upper), F.upper("ticker")),
        some & F.forall("sources", lambda s: s["transcript_id"] == F.col("transcript_id")), ~F.col("has_market") | (F.coalesce("b.market_reaction", F.lit("")) != ""),
    ]
    n = sum((F.coalesce(c, F.lit(False)).cast("int") for c in checks), F.lit(0))
    return x.select("turn_id", n.alias("passed"), rounded(n / len(checks), 3).alias("score"), (n == len(checks)).alias("accepted"))


@query("Q6", f"SELECT suite, CASE WHEN suite = 'responses' THEN 'response' ELSE 'retrieval' END AS kind, cases, {r('cases_passed / cases', 4)} AS case_rate FROM suite_report")
def q6(t):
    packed = suite_report(t).select(F.to_json(F.struct("suite", F.struct("cases", "cases_passed").alias("summary"))).alias("report"))
    x = packed.select(F.from_json("report", "suite string, summary struct<cases:bigint, cases_passed:bigint>").alias("r"))
    kind = F.when(F.col("r.suite") == "responses", "response").otherwise("retrieval")
    return x.select("r.suite", kind.alias("kind"), "r.summary.cases", rounded(ratio(F.col("r.summary.cases_passed"), F.col("r.summary.cases")), 4).alias("case_rate"))


@query("U5", "SELECT suite, CAST(day AS INT) AS day, cases FROM suite_report, range(3) d(day)")
def u5(t):
    """Archived and latest reports, one of each suite and day, the archived copy wins nothing."""
    report = suite_report(t).select("suite", "cases")
    archived = report.withColumns({"day": F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))), "source": F.lit("archive")})
    latest = report.withColumns({"day": F.lit(2), "source": F.lit("latest")})
    order = Window.partitionBy("suite", "day").orderBy(F.desc("source"))
    return archived.unionByName(latest).withColumn("n", F.row_number().over(order)).where("n = 1").select("suite", "day", "cases")


# incremental jobs


@query("X1", f"SELECT ticker, trading_date, {r('adjusted_close')} AS adjusted_close, volume FROM bars_daily")
def x1(t):
    bars = t.bars_daily.select("ticker", "trading_date", "adjusted_close", "volume")
    landed, cut = scratch(t.spark, "landed"), F.lit("1996-01-01").cast("date")
    first = bars.where(F.col("trading_date") < cut).withColumn("volume", F.when(F.col("trading_date") >= F.date_sub(cut, 14), 0).otherwise(F.col("volume")))
    second = bars.where(F.col("trading_date") >= F.date_sub(cut, 14))
    for k, part in enumerate((first, second)):
        part.withColumn("loaded", F.lit(k)).write.mode("append").parquet(landed)
    schema = t.spark.read.parquet(landed).schema
    return jobs.refresh_bars(t.spark, landed, schema, jobs.Place.fresh(t.spark, "bars")).select("ticker", "trading_date", rounded("adjusted_close").alias("adjusted_close"), "volume")


@query("X2", "SELECT event_type, source_record_id, count(DISTINCT 1) AS n FROM alerts_in WHERE ticker IN ('T1', 'T2', 'T3') GROUP BY event_type, source_record_id")
def x2(t):
    landed = scratch(t.spark, "records")
    t.alerts_in.withColumn("created_at", F.col("created_at").cast("timestamp")).repartition(3, "event_id").write.parquet(landed)
    stream = jobs.read_files(t.spark, landed, t.spark.read.parquet(landed).schema)
    watched = t.alerts_in.select("ticker").where("ticker IN ('T1', 'T2', 'T3')")
    return jobs.new_alerts(t.spark, stream, watched, jobs.Place.fresh(t.spark, "alerts")).groupBy("event_type", "source_record_id").agg(ONE().alias("n"))


def lexicon_sql() -> str:
    """The shipped scorer over turns: shares of words by segments of 256, weighted by their size."""
    among = lambda words: "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"
    share = lambda words: f"sum(greatest(1, len(s)) * ((1 + len([x FOR x IN s IF x IN {among(words)}])) / (greatest(1, len(s)) + 3))) / sum(greatest(1, len(s)))"
    return f"""SELECT turn_id, CASE WHEN p >= n AND p >= u THEN 'positive' WHEN n >= u THEN 'negative' ELSE 'neutral' END AS label, round(p - n, 8) AS score, round(greatest(p, n, u), 8) AS confidence, CAST(tokens AS INT) AS tokens, CAST(segments AS INT) AS segments, 'SCORED' AS status FROM (
      SELECT *, greatest(0.0::DOUBLE, 1 - p - n) AS u FROM (SELECT turn_id, {share(udfs.POSITIVE)} AS p, {share(udfs.NEGATIVE)} AS n, sum(len(s)) AS tokens, count(*) AS segments FROM (
        SELECT turn_id, unnest([w[i * 256 + 1 : i * 256 + 256] FOR i IN range(greatest(1, (len(w) + 255) // 256))]) AS s FROM (SELECT turn_id, {WORDS.format('lower(content)')} AS w FROM turns)) GROUP BY turn_id))"""


oracle_view("lexicon", lexicon_sql())


@query("X3", "SELECT * FROM lexicon WHERE turn_id NOT IN (SELECT turn_id FROM turn_scores)")
def x3(t):
    landed = scratch(t.spark, "turns")
    t.turns.select("turn_id", "content").repartition(2, "turn_id").write.parquet(landed)
    stream = jobs.read_files(t.spark, landed, "turn_id bigint, content string")
    return jobs.score_backlog(t.spark, stream, t.turn_scores, "turn_id", "content", jobs.Place.fresh(t.spark, "scores"))


@query(
    "X4",
    f"""WITH x AS (SELECT *, feature_as_of_date + 60 AS deadline, max(greatest(feature_as_of_date + 1, CASE WHEN actual IS NOT NULL THEN target_trading_date END)) OVER () - 366 AS clock FROM predictions)
  SELECT event_key, CASE WHEN actual IS NOT NULL THEN CASE WHEN target_trading_date <= deadline THEN 'MATURED' ELSE 'EXPIRED' END WHEN deadline < clock THEN 'EXPIRED' ELSE 'PENDING' END AS status,
    {r('prediction')} AS forecast, CASE WHEN target_trading_date <= deadline THEN {r('actual')} END AS realized FROM x""",
)
def x4(t):
    """Forecasts and outcomes land year by year; a forecast without an outcome expires 60 days on, by a timer."""
    day = lambda c: F.datediff(c, F.lit("1970-01-01").cast("date")).cast("long")
    made, none = day("feature_as_of_date"), F.lit(None)
    event = lambda kind, at, deadline, value: F.struct(F.lit(kind).alias("kind"), at.alias("at"), deadline.cast("long").alias("deadline"), value.cast("double").alias("value"))
    again = event("forecast", made + 1, made + 60, F.lit(9.0))  # a second forecast changes nothing
    kinds = F.array(event("forecast", made, made + 60, F.col("prediction")), again, event("outcome", day("target_trading_date"), none, F.col("actual")))
    # one pass: of a union of three readings adaptive execution lost all outcomes where it reused their exchanges
    rows = t.predictions.select("event_key", F.explode(kinds).alias("x")).select("event_key", "x.*").where("kind = 'forecast' OR value IS NOT NULL")
    every, landed = written(rows, "ledger-rows"), scratch(t.spark, "ledger-events")
    first, last = every.agg(F.min(F.floor(F.col("at") / 366)), F.max(F.floor(F.col("at") / 366))).first()
    for year in range(first, last + 1) if first is not None else []:
        every.where(F.floor(F.col("at") / 366) == year).write.mode("append").parquet(landed)
    if first is None:
        every.write.parquet(landed)
    stream = jobs.read_files(t.spark, landed, every.schema, 8)
    out = jobs.ledger_stream(t.spark, stream, jobs.Place.fresh(t.spark, "ledger"))
    return out.select("event_key", "status", rounded("forecast").alias("forecast"), rounded("realized").alias("realized"))


@query(
    "X5",
    """SELECT event_id, created_at, state FROM (SELECT *, ['PENDING', 'FAILED', 'REJECTED', 'READY', 'SKIPPED', 'GENERATING'][event_id % 6 + 1] AS state, CASE WHEN event_id % 7 > 0 THEN created_at + INTERVAL 1 MINUTE * (event_id % 3 * 30) END AS last_attempt, max(created_at) OVER () AS now FROM alerts_in)
  WHERE ticker IN ('T1', 'T2', 'T3', 'T4') AND event_id % 4 < 3 AND (state IN ('PENDING', 'FAILED', 'REJECTED') OR state = 'GENERATING' AND (last_attempt IS NULL OR last_attempt < now - INTERVAL 1 HOUR)) ORDER BY created_at, event_id LIMIT 100""",
)
def x5(t):
    """Retryable alerts of the scope, oldest first: see `work_queue`; state and attempts follow from the id."""
    state = F.element_at(F.array(*(F.lit(s) for s in ("PENDING", "FAILED", "REJECTED", "READY", "SKIPPED", "GENERATING"))), (F.col("event_id") % 6 + 1).cast("int"))
    tried = F.when(F.col("event_id") % 7 > 0, F.col("created_at") + F.make_interval(mins=F.col("event_id") % 3 * 30))
    x = t.alerts_in.withColumns({"state": state, "attempts": F.col("event_id") % 4, "last_attempt": tried})
    return work_queue(x, ["T1", "T2", "T3", "T4"], t.alerts_in.agg(F.max("created_at").alias("now"))).select("event_id", "created_at", "state")


def work_queue(alerts: DataFrame, tickers: list[str], now: DataFrame, most_attempts: int = 3, limit: int = 100) -> DataFrame:
    """Pending, failed or rejected alerts, and those generating for over an hour, with attempts left; oldest first."""
    stale = (F.col("state") == "GENERATING") & (F.col("last_attempt").isNull() | (F.col("last_attempt") < F.col("now") - F.expr("INTERVAL 1 HOUR")))
    x = alerts.where(F.col("ticker").isin(*tickers) & (F.col("attempts") < most_attempts)).join(F.broadcast(now), F.lit(True))
    return x.where(F.col("state").isin("PENDING", "FAILED", "REJECTED") | stale).orderBy("created_at", "event_id").limit(limit)


@query(
    "X6",
    """SELECT run_id, CASE WHEN count(*) FILTER (state = 'FAILED') > 0 THEN 'FAILED' ELSE 'SUCCEEDED' END AS status, count(*) AS stages, coalesce(string_agg(stage, ',' ORDER BY stage) FILTER (state = 'FAILED'), '') AS failed_stages, count(*) FILTER (state = 'FAILED') > 0 AS dependants_blocked, count(*) FILTER (orphaned) AS orphaned, max(closed_at) AS completed_at
  FROM (SELECT run_id, stage, run_id % 9 = 4 AND stage = 'click' AS orphaned, CASE WHEN run_id % 9 = 4 AND stage = 'click' THEN 'FAILED' ELSE status END AS state, CASE WHEN run_id % 9 = 4 AND stage = 'click' THEN max(completed_at) OVER () ELSE completed_at END AS closed_at FROM stage_runs) GROUP BY run_id""",
)
def x6(t):
    """Rollup of runs, some of which were left in a running stage."""
    left = F.expr("run_id % 9 = 4 AND stage = 'click'")
    runs = t.stage_runs.withColumns({"completed_at": F.when(~left, F.col("completed_at")), "status": F.when(left, "RUNNING").otherwise(F.col("status"))})
    return run_history(close_orphans(runs, t.stage_runs.agg(F.max("completed_at").alias("now"))))


def close_orphans(stages: DataFrame, now: DataFrame) -> DataFrame:
    """Stages still RUNNING when the next run starts have failed, and end then."""
    lost = F.col("status") == "RUNNING"
    x = stages.join(F.broadcast(now), F.lit(True)).withColumn("orphaned", lost)
    return x.withColumns({"status": F.when(lost, "FAILED").otherwise(F.col("status")), "completed_at": F.when(lost, F.col("now")).otherwise(F.col("completed_at"))}).drop("now")


def run_history(stages: DataFrame) -> DataFrame:
    """Final status, failed stages, blocked dependants and orphans of each run."""
    failed = F.col("status") == "FAILED"
    names = F.array_join(F.array_sort(F.collect_list(F.when(failed, F.col("stage")))), ",")
    return stages.groupBy("run_id").agg(
        F.when(F.bool_or(failed), "FAILED").otherwise("SUCCEEDED").alias("status"), ONE().alias("stages"), names.alias("failed_stages"), F.bool_or(failed).alias("dependants_blocked"),
        F.count_if("orphaned").alias("orphaned"), F.max("completed_at").alias("completed_at"),
    )


oracle_view("to_batch", "SELECT chunk_id, CAST(greatest(1, length(content) // 4) AS INT) AS tokens, row_number() OVER (ORDER BY chunk_id) AS k FROM filing_chunks")
oracle_view(
    "batched",
    """WITH RECURSIVE b AS (SELECT k, 0 AS batch, 1 AS n, tokens AS total FROM to_batch WHERE k = 1
  UNION ALL SELECT x.k, b.batch + CAST(b.n >= 256 OR b.total + x.tokens > 180000 AS INT), CASE WHEN b.n >= 256 OR b.total + x.tokens > 180000 THEN 1 ELSE b.n + 1 END, CASE WHEN b.n >= 256 OR b.total + x.tokens > 180000 THEN x.tokens ELSE b.total + x.tokens END
    FROM b JOIN to_batch x ON x.k = b.k + 1) SELECT * FROM b""",
)


@query("X7", "SELECT chunk_id, tokens, CAST(batch AS BIGINT) AS batch FROM to_batch JOIN batched USING (k)")
def x7(t):
    rows = t.filing_chunks.select("chunk_id", F.greatest(F.lit(1), F.length("content") / 4).cast("int").alias("tokens"))
    return sequential_batches(rows, "chunk_id", 256, 180_000)


# UDFs


@query("D1", "SELECT * FROM lexicon")
def d1(t):
    return udfs.score_texts(t.turns, "turn_id", "content")


@query(
    "D2",
    f"""WITH w AS (SELECT doc_id, unnest({WORDS.format('lower(text)')}) AS w FROM documents), s AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS k, count(*) AS n FROM w GROUP BY ALL),
  u AS (SELECT doc_id, k, n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)) AS x FROM s) SELECT d.doc_id, CAST(k AS INT) AS slot, {r('x')} AS value, 'EMBEDDED' AS status FROM documents d JOIN u USING (doc_id)""",
)
def d2(t):
    """Vectors as rows of their slots that are not 0."""
    x = udfs.embed_texts(t.documents, "doc_id", "text").select("doc_id", "status", F.posexplode("embedding").alias("slot", "value"))
    return x.where("value <> 0").select("doc_id", "slot", rounded("value").alias("value"), "status")


@query(
    "D3",
    f"""SELECT doc_id, CAST(i AS INT) AS chunk_index, CAST(least(700, len(w) - i * 600) AS INT) AS tokens, md5(CASE WHEN len(w) <= 700 THEN text ELSE array_to_string(w[i * 600 + 1 : i * 600 + 700], ' ') END) AS digest
  FROM (SELECT doc_id, text, w, unnest(range(1 + CAST(greatest(0, ceil((len(w) - 700) / 600.0)) AS INT))) AS i FROM (SELECT doc_id, text, {WORDS.format('text')} AS w FROM documents))""",
)
def d3(t):
    pieces = udfs.SplitTokens(F.col("text").outer(), F.lit(700), F.lit(600))
    return t.documents.lateralJoin(pieces).select("doc_id", "chunk_index", "tokens", F.md5("content").alias("digest"))

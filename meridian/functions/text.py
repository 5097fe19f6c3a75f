"""Text columns: topics, word chunks, speakers, punctuation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Topics and their terms.
TOPICS = {
    "margins_profitability": "gross margin|operating margin|profit margin|margin expansion|margin pressure|margin rate|margins|margin|profitability|operating leverage|deleverage|gross profit|operating income",
    "guidance_outlook": "guidance|outlook|forecast|full year|next quarter|expectations|projected|projection|raise our|lower our",
    "revenue_growth": "revenue growth|revenues|revenue|net sales|sales growth|same store sales|comparable sales|organic growth|top line",
    "demand_consumer": "consumer spending|customer traffic|store traffic|unit volume|market share|transactions|bookings|backlog|orders|demand",
    "costs_efficiency": "operating expense|operating expenses|cost reduction|cost savings|labor cost|freight cost|restructuring|productivity|efficiency|automation|headcount|expenses",
    "pricing_inflation": "price increases|price increase|price investment|pricing|inflation|deflation|markdowns|markdown|promotions|promotion",
    "supply_chain_inventory": "supply chain|distribution center|lead time|inventories|inventory|logistics|fulfillment|shortages|shortage|suppliers|supplier",
    "capital_allocation": "capital allocation|capital expenditures|capital expenditure|free cash flow|share repurchase|stock repurchase|debt repayment|buybacks|buyback|dividends|dividend|capex",
    "risk_regulation": "cyber security|cybersecurity|data breach|foreign exchange|interest rate|geopolitical|regulatory|regulation|litigation|tariffs|tariff|risks|risk",
    "technology_ai": "artificial intelligence|generative ai|machine learning|digital transformation|technology investment|data centers|data center|online marketplace|e commerce|ecommerce|cloud|ai",
}


def plain_words(text: Column) -> Column:
    """Lower-case words of a-z and 0-9, one space before and after each."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " ")), F.lit(" "))


def bound(value: Column, use) -> Column:
    """`use` of a value that is computed once a row, however often `use` names it."""
    return F.transform(F.array(value), use)[0]


def terms_in(words: Column, topic: str) -> Column:
    """Terms of a topic among plain words, in the taxonomy's order."""
    terms = F.array(*(F.lit(x) for x in TOPICS[topic].split("|")))
    return F.filter(terms, lambda x: words.contains(F.concat(F.lit(" "), x, F.lit(" "))))


def matched_terms(text: Column, topic: str) -> Column:
    """Terms of a topic that a text has, in the taxonomy's order."""
    return bound(plain_words(text), lambda w: terms_in(w, topic))


def topic_flags(text: Column) -> Column:
    """Struct with a boolean for each topic: whether the text has a term of it."""
    return bound(plain_words(text), lambda w: F.struct(*((F.size(terms_in(w, k)) > 0).alias(k) for k in TOPICS)))


def topic_matches(text: Column) -> Column:
    """Array of (topic, terms) of the topics with a matched term."""
    every = bound(plain_words(text), lambda w: F.array(*(F.struct(F.lit(k).alias("topic"), terms_in(w, k).alias("terms")) for k in TOPICS)))
    return F.filter(every, lambda x: F.size(x["terms"]) > 0)


def words(text: Column) -> Column:
    """White-space words: the tokens of the chunk arithmetic."""
    return F.filter(F.split(text, r"[ \t\n\r\f\x0B]+"), lambda w: w != "")


def chunks(text: Column, size: int = 700, step: int = 600) -> Column:
    """Array of (index, text, tokens): overlapping word chunks; a short text is one chunk as it is."""

    def cut(w: Column) -> Column:
        n = F.size(w)
        last = F.greatest(F.lit(0), F.ceil((n - size) / F.lit(step))).cast("int")
        piece = lambda k: F.when(n <= size, text).otherwise(F.array_join(F.slice(w, k * step + 1, size), " "))
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(k.alias("index"), piece(k).alias("text"), F.least(F.lit(size), n - k * step).alias("tokens")))

    return bound(words(text), cut)


def speaker_group(role: Column) -> Column:
    """operator, analyst or management by what the speaker's role says."""
    low = F.lower(role)
    return F.when(low.contains("operator"), "operator").when(low.contains("analyst"), "analyst").otherwise("management")


def ascii_punctuation(text: Column) -> Column:
    """Typographic signs as ASCII."""
    signs = " ‘’“”–—•−"
    return F.replace(F.translate(text, signs, " ''\"\"----"), F.lit("…"), F.lit("..."))


def has_any(text: Column, terms: list[str]) -> Column:
    """Whether a lower-cased text contains one of the terms."""
    return F.exists(F.array(*(F.lit(x) for x in terms)), lambda x: F.lower(text).contains(x))


#: Question terms by purpose.
CALL_TERMS = "earnings call|call|transcript|management said|management say|analyst|q&a|qa|guidance".split("|")
FILING_TERMS = "sec|filing|10-k|10-q|annual report|quarterly report|risk factor|item 1a".split("|")
HISTORY_TERMS = "over time|historical|history|trend|trends".split("|")
LATEST_TERMS = "latest|most recent|recent|last quarter|this quarter".split("|")
SINGLE_CALL_TERMS = "the earnings call|the call|on earnings call|management say|management said".split("|")
MARKET_TERMS = "stock|share price|price|market|performance|perform|return|returns|volatility|volume|trading|spy|benchmark".split("|")
DOCUMENT_TERMS = "filing|sec|10-k|10-q|risk|transcript|earnings call|management|analyst|fundamental|business|margin|revenue".split("|")


def route(question: Column) -> dict[str, Column]:
    """Corpora to search, recency preferences and kinds of evidence that a question asks for."""
    calls, filings, market = has_any(question, CALL_TERMS), has_any(question, FILING_TERMS), has_any(question, MARKET_TERMS)
    past = has_any(question, HISTORY_TERMS)
    latest = has_any(question, LATEST_TERMS)
    one_call = latest | (~F.lower(question).contains("calls") & has_any(question, SINGLE_CALL_TERMS))
    return {
        "corpora": F.when(calls & ~filings, "transcripts").when(filings & ~calls, "filings").otherwise("filings,transcripts"),
        "latest_call": ~(past | has_any(question, ["all calls", "previous calls", "past calls"])) & one_call,
        "latest_filing": ~(past | has_any(question, ["all filings", "previous filings", "past filings"])) & has_any(question, ["latest", "most recent", "newest"]),
        "wants_market": market,
        "wants_text": ~market | has_any(question, DOCUMENT_TERMS),
    }

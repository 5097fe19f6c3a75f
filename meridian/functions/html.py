"""Pages as text, filings as sections: columns over regular expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


class VisibleText(HTMLParser):
    """Text pieces of a page: one between tags, broken at <br>; scripts, styles and noscript are left out."""

    def __init__(self, html: str):
        super().__init__(convert_charrefs=True)
        self.pieces: list[str] = []
        self.hidden: list[str] = []
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ("script", "style", "noscript"):
            self.hidden.append(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in self.hidden:
            del self.hidden[self.hidden.index(tag) :]

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.pieces.append(data)


def visible_text(html: str | None) -> str:
    """Visible text, a line for each piece; blanks collapsed, empty lines removed, character references decoded."""
    try:
        pieces = VisibleText(html or "").pieces
    except AssertionError:  # the parser gives up on some broken declarations
        pieces = VisibleText(re.sub(r"(?is)<!(?!--|doctype)[^>]*(>|$)", " ", html or "")).pieces
    lines = (" ".join(line.split()) for piece in pieces for line in piece.split("\n"))
    return "\n".join(line for line in lines if line)


def html_to_text(pages: DataFrame, id_col: str, html_col: str) -> DataFrame:
    """Rows (id, text) of pages. A worker gets a hundred pages at a time, so its memory does not depend on the size of a partition or of an Arrow batch."""
    parse = F.udf(visible_text, "string", useArrow=False).asNondeterministic()  # parsed once, however often the text is used
    return pages.select(id_col, parse(html_col).alias("text"))


#: By form and section the pattern of the heading that starts it and those of headings that end it.
SECTIONS = {
    "10-K": {
        "item_1_business": (r"^\s*ITEM\s+1[\.\s:\-]+BUSINESS\b.*$", (r"^\s*ITEM\s+1A\b.*$",)),
        "item_1a_risk_factors": (r"^\s*ITEM\s+1A[\.\s:\-]+RISK\s+FACTORS\b.*$", (r"^\s*ITEM\s+1B\b.*$", r"^\s*ITEM\s+1C\b.*$", r"^\s*ITEM\s+2\b.*$")),
        "item_7_mda": (r"^\s*ITEM\s+7[\.\s:\-]+MANAGEMENT['’]?S\s+DISCUSSION.*$", (r"^\s*ITEM\s+7A\b.*$", r"^\s*ITEM\s+8\b.*$")),
        "item_7a_market_risk": (r"^\s*ITEM\s+7A[\.\s:\-]+QUANTITATIVE\s+AND\s+QUALITATIVE.*$", (r"^\s*ITEM\s+8\b.*$",)),
        "item_8_financial_statements": (r"^\s*ITEM\s+8[\.\s:\-]+FINANCIAL\s+STATEMENTS.*$", (r"^\s*ITEM\s+9\b.*$", r"^\s*PART\s+III\b.*$")),
    },
    "10-Q": {
        "part1_item1_financial_statements": (r"^\s*ITEM\s+1[\.\s:\-]+FINANCIAL\s+STATEMENTS\b.*$", (r"^\s*ITEM\s+2[\.\s:\-]+MANAGEMENT.*$",)),
        "part1_item2_mda": (r"^\s*ITEM\s+2[\.\s:\-]+MANAGEMENT['’]?S\s+DISCUSSION.*$", (r"^\s*ITEM\s+3\b.*$",)),
        "part1_item3_market_risk": (r"^\s*ITEM\s+3[\.\s:\-]+QUANTITATIVE\s+AND\s+QUALITATIVE.*$", (r"^\s*ITEM\s+4\b.*$",)),
        "part1_item4_controls": (r"^\s*ITEM\s+4[\.\s:\-]+CONTROLS\s+AND\s+PROCEDURES\b.*$", (r"^\s*PART\s+II\b.*$",)),
        "part2_item1a_risk_factors": (r"^\s*ITEM\s+1A[\.\s:\-]+RISK\s+FACTORS\b.*$", (r"^\s*ITEM\s+2\b.*$", r"^\s*ITEM\s+3\b.*$", r"^\s*ITEM\s+4\b.*$", r"^\s*ITEM\s+5\b.*$", r"^\s*ITEM\s+6\b.*$")),
    },
}
#: How every one of these headings begins.
HEADING = re.compile(r"^\s*(?:ITEM\s+\d+[A-Z]?\b|PART\s+I+\b)", re.I | re.M)
ITEM_LINE = re.compile(r"^\s*ITEM\s+\d+[A-Z]?\b.*$", re.I | re.M)
LEADER = re.compile(r"\.{3,}\s*\d+\s*$")


def toc_score(text: str, position: int, heading: str) -> int:
    """Evidence that a heading belongs to a table of contents; 3 or more means it does."""
    before, after = text[max(0, position - 1500) : position], text[position : position + 3000]
    return 3 * ("TABLE OF CONTENTS" in before.upper()) + 2 * bool(LEADER.search(heading)) + (len(ITEM_LINE.findall(after)) >= 3) + (position < 0.15 * len(text))


def find_sections(text: str, form: str, least: int = 50) -> list[tuple[str, int, str, str, int]]:
    """Candidates (section, position, heading, content, toc) of a filing, from one pass over its headings.

    All headings are listed first; each is then asked which sections it starts and ends. A section runs from each
    of its starts to the next heading that ends it, or to the end of the text; short ones go.
    """
    places = [m.start() for m in HEADING.finditer(text)]
    found = []
    for section, (start, ends) in SECTIONS[form].items():
        begins, stops = re.compile(start, re.I | re.M), re.compile("|".join(ends), re.I | re.M)
        end = len(text)
        for at in reversed(places):
            if m := begins.match(text, at):
                content = (m.group() + text[m.end() : max(m.end(), end)]).strip()
                if len(content) >= least:
                    found.append((section, at, m.group(), content, toc_score(text, at, m.group())))
            if stops.match(text, at):
                end = at
    return sorted(found)


def section_candidates(docs: DataFrame, id_col: str, text_col: str, form: str, least: int = 50) -> DataFrame:
    """Rows (id, section_key, position, heading, content, length, toc) of all sections of a form, from one scan. A null text has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 100):
                part = batch.slice(start, 100)
                rows = [(k, *c, len(c[3])) for k, x in enumerate(part.column(1)) for c in find_sections(x.as_py() or "", form, least)]
                who, section, position, heading, content, toc, length = zip(*rows) if rows else [()] * 7
                cols = [part.column(0).take(pa.array(who, pa.int64())), pa.array(section, pa.string()), pa.array(position, pa.int32()), pa.array(heading, pa.string()), pa.array(content, pa.string()), pa.array(length, pa.int32()), pa.array(toc, pa.int32())]
                yield pa.RecordBatch.from_arrays(cols, names=[id_col, "section_key", "position", "heading", "content", "length", "toc"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, section_key string, position int, heading string, content string, length int, toc int")


def best_candidate(cands: DataFrame) -> DataFrame:
    """Per document and section: not of the contents if possible, of those with 40 % of the longest the last."""
    w = Window.partitionBy("doc_id", "section_key")
    x = cands.withColumn("_toc", (F.col("toc") >= 3).cast("int"))
    x = x.withColumn("_least", F.min("_toc").over(w)).where("_toc = _least")
    x = x.withColumn("_longest", F.max("length").over(w)).where(F.col("length") >= 0.4 * F.col("_longest"))
    return x.withColumn("_n", F.row_number().over(w.orderBy(F.desc("position")))).where("_n = 1").drop("_toc", "_least", "_longest", "_n")

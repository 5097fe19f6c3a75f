"""Pages, filing sections and company names against plain Python."""

import random
import re

from pyspark.sql import functions as F

from meridian.functions import html
from meridian.plans.text_queries import mentions

PAGES = {
    1: ("<html><head><style>p{}</style><title>T</title></head><body>a<br>b <b>c</b>  d<p> e\n\n f </p></body>", "T\na\nb\nc\nd\ne\nf"),
    2: ("<script>x<1</script>kept &amp; &eacute;<noscript>no</noscript>", "kept & é"),
    3: (None, ""),
    4: ("   ", ""),
    5: ("<!bad <p>one</p>", None),
    6: ("plain text only", "plain text only"),
    7: ("<p>un<i>closed<script>gone", "un\nclosed"),
}


def test_visible_text_of_pages(spark):
    rows = spark.createDataFrame([(k, v[0], "x") for k, v in PAGES.items()], "page_id int, html string, text string")
    got = {r.page_id: r.text for r in html.html_to_text(rows, "page_id", "html").collect()}
    assert got.keys() == PAGES.keys() and all(got[k] == want for k, (_, want) in PAGES.items() if want is not None)


def by_pattern(text, form, least=50):
    """Each section looked for on its own: starts by its pattern, ends by the first of its end patterns behind."""
    out = []
    for section, (start, ends) in html.SECTIONS[form].items():
        stops = [m for e in ends for m in re.finditer(e, text, re.I | re.M)]
        for m in re.finditer(start, text, re.I | re.M):
            end = min((x.start() for x in stops if x.start() >= m.end()), default=len(text))
            content = (m.group() + text[m.end() : end]).strip()
            if len(content) >= least:
                out.append((section, m.start(), m.group(), content))
    return sorted(out)


def test_sections_by_one_pass(spark):
    rng, docs = random.Random(5), []
    lines = ["Item 1. Business", "ITEM 1A: Risk Factors", "Item 1B.", "Item 2 - Properties", "item 7.\nManagement’s Discussion and Analysis", "Item 7A. Quantitative and Qualitative", "Item 8. Financial Statements .... 9", "Part III", "Item 9.", "Item 2. Management's Discussion", "  \n\n Item 3. Quantitative and Qualitative", "Item 4. Controls and Procedures", "Part II", "Item 1. Financial Statements", "see Item 8. Financial Statements", "Item 10", "words of a paragraph that is long enough to count as a section", ""]
    for k in range(60):
        docs.append((k, "\n".join(rng.choice(lines) for _ in range(rng.randint(1, 40)))))
    docs += [(90, None), (91, ""), (92, "Item 1. Business"), (93, "Item 1. Business\n" + "é" * 60)]
    for form in html.SECTIONS:
        got = html.section_candidates(spark.createDataFrame(docs, "doc_id int, body string"), "doc_id", "body", form).collect()
        want = [(k, *c) for k, t in docs for c in by_pattern(t or "", form)]
        assert sorted((r.doc_id, r.section_key, r.position, r.heading, r.content) for r in got) == sorted(want) and len(want) > 3
        assert all(r.length == len(r.content) for r in got)


def test_the_best_candidate_is_not_of_the_contents(spark):
    contents = "TABLE OF CONTENTS\nItem 1. Business ..... 3\nItem 1A. Risk Factors ..... 5\nItem 2. Properties ..... 7\n"
    body = contents + "intro " * 700 + "\nItem 1. Business\n" + "We make things. " * 20 + "\nItem 1A. Risk Factors\n" + "It may rain. " * 30 + "\nItem 2. Properties\n"
    found = html.section_candidates(spark.createDataFrame([(1, body)], "doc_id int, body string"), "doc_id", "body", "10-K", 10)
    best = {r.section_key: r for r in html.best_candidate(found).collect()}
    assert best["item_1_business"].position == body.rindex("Item 1. Business") and best["item_1a_risk_factors"].content.endswith("It may rain.")


def test_names_in_questions(spark):
    aliases = {"acme": "A", "électricité de france": "E", "ørsted": "O", "acme holdings": "H", "3m": "M", "müller & söhne": "S", "brand#12": "B"}
    asked = {
        1: "ACME and Acme Holdings?", 2: "Électricité de France, ØRSTED", 3: "macme acmes ørstedt", 4: "Is 3M (not 33m) like Müller & Söhne?", 5: None, 6: "", 7: "brand#12's rise, brand#123", 8: "électricité  de france", 9: "acme, ørsted, acme",
    }
    got = mentions(spark.createDataFrame(list(asked.items()), "turn_id int, content string"), spark.createDataFrame(list(aliases.items()), "alias string, ticker string"))
    want = set()
    for k, q in asked.items():
        for a, t in aliases.items():
            if m := re.search(r"(?<!\w)" + re.escape(a) + r"(?!\w)", (q or "").lower()):
                want.add((k, t, m.start()))
    assert {tuple(r) for r in got.select("turn_id", "ticker", F.col("pos").cast("int")).collect()} == want and len(want) == 9


def test_pages_are_parsed_once_and_by_hundreds(spark):
    rows = spark.range(3).select(F.col("id").alias("page_id"), F.lit("<p>a&amp;b</p>").alias("html"))
    text = html.html_to_text(rows, "page_id", "html").where("length(text) > 1").select("page_id", F.length("text").alias("n"), F.md5("text").alias("digest"))
    plan = text._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchEvalPython") == 1 and "InArrow" not in plan and "ArrowEvalPython" not in plan
    assert [r.n for r in text.collect()] == [3, 3, 3]


def test_contents_of_sections_are_not_shuffled(spark):
    from meridian.queries import queries

    plan = queries()["F4"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and "content#" not in plan[: plan.rindex("Window")]

"""Main-text extraction: boosted trees over DOM-node features with hierarchical decoding.

Each block node of a page gets features of its own (tag, attribute tokens, depth), of its subtree
(text and link density, paragraphs, tags per text), of its siblings (place, share of the parent's
text) and of its ancestors. Gradient-boosted trees score whether the node holds main text. Decoding
takes the best set of nodes in which every kept node's ancestors are kept: a node is kept if its
own score and the best of its children together are positive; a dropped node drops what is below.

The trees are trained on page layouts generated from rules (module `layouts`), whose main text is
known by construction; the number of layouts is a parameter. Text of kept blocks has its character
references decoded and white space turned into single spaces; blocks are joined by one space.

Null and empty pages and pages without main text give an empty text. Broken markup is read as far
as it goes. Repeated rows are extracted each. Columns not named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from meridian.llm.boosting import BoostedTrees

#: Fixed values of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title iframe svg button select option textarea object canvas audio video math".split())
#: What may stand in a head; anything else ends it, as its end tag may be left out.
IN_HEAD = frozenset("html head base basefont bgsound link meta title style script noscript noframes template".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var img".split())
CLOSES_P = frozenset("address article aside blockquote div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
TAGS = ("p", "div", "article", "section", "main", "nav", "header", "footer", "aside", "form", "ul", "li", "table", "h1", "h2", "blockquote", "pre", "figure", "body")
#: Words of class, id and role values that tell what a node is for.
PLAIN_WORDS = frozenset("article content post entry main body story text page copy prose column center primary hentry".split())
SIDE_WORDS = frozenset(
    "nav menu navbar navigation header top masthead banner footer bottom foot sidebar side aside widget rail ad ads advert advertisement sponsor promo cookie notice alert consent comment comments reply disqus discussion form search login subscribe newsletter signup share social related recommend breadcrumb pagination tags meta popup modal legal copyright secondary complementary contentinfo".split()
)
SPLIT = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[0-9])")
N_FEATURES = len(TAGS) + 24


class Page(HTMLParser):
    """Block nodes of a page in page order, with the text that each holds directly."""

    def __init__(self, html: str, labelled: bool = False):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.depth = ["body"], [-1], [0]
        self.words: list[list[str]] = [[]]
        self.label, self.labelled = [1], labelled
        self.parts: list[tuple[int, list[str]]] = []  # (node, text pieces), a new one at each block border
        self.linked, self.tags, self.chars = [0], [0], [0]
        self.stack: list[tuple[str, int]] = [("body", 0)]  # open elements with the block node they are in
        self.silent: list[str] = []  # open elements without text of the page, the outermost first
        self.links = 0
        self.fresh = True
        self.feed(html)
        self.close()

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if "head" in self.silent and (tag == "body" or self.silent[-1] == "head" and tag not in IN_HEAD):
            self._end_silent("head")
        if tag in ("option", "optgroup", "button") and self.silent[-1:] == [tag if tag == "button" else "option"]:
            self.silent.pop()
        elif tag == "select" and tag in self.silent:  # ends the open one
            return self._end_silent(tag)
        if self.silent or tag in SILENT:
            if tag in SILENT and not (tag == "head" and tag in self.silent):
                self.silent.append(tag)
                self.fresh = True
            return
        if tag in ("html", "body"):
            self.words[0] += self._attribute_words(attrs)
            return
        if tag == "p" or tag in CLOSES_P:
            self._close("p", CLOSES_P - {"p"})
        elif tag == "li":
            self._close("li", frozenset(("ul", "ol")))
        elif tag in ("td", "th", "tr"):
            self._close(tag, frozenset(("table",) if tag == "tr" else ("table", "tr")))
        node = self.stack[-1][1]
        self.tags[node] += 1
        if tag in VOID:
            self.fresh |= tag in ("br", "hr")
            return
        if tag in INLINE:
            self.links += tag == "a"
        else:
            parent, node = node, len(self.tag)
            self.tag.append(tag)
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
            self.words.append(self._attribute_words(attrs))
            self.label.append(int(self.labelled and dict(attrs).get("data-main") == "1"))
            for column in (self.linked, self.tags, self.chars):
                column.append(0)
            self.fresh = True
        self.stack.append((tag, node))

    def _attribute_words(self, attrs: list[tuple[str, str | None]]) -> list[str]:
        return [w for k, v in attrs if v and k in ("class", "id", "role") for w in SPLIT.split(v.lower()) if w]

    def _close(self, tag: str, walls: frozenset) -> None:
        """Close the innermost open `tag`, unless one of `walls` is open inside it."""
        for k in range(len(self.stack) - 1, 0, -1):
            name = self.stack[k][0]
            if name == tag:
                self._pop(k)
                return
            if name in walls:
                return

    def _pop(self, k: int) -> None:
        for name, _ in self.stack[k:]:
            self.links -= name == "a"
            self.fresh |= name not in INLINE
        del self.stack[k:]

    def _end_silent(self, tag: str) -> None:
        """Close the innermost open silent `tag` and all inside it."""
        if tag in self.silent:
            del self.silent[len(self.silent) - 1 - self.silent[::-1].index(tag) :]

    def handle_endtag(self, tag: str) -> None:
        if self.silent == ["option"] and any(name == tag for name, _ in self.stack[1:]):
            self.silent.clear()  # the end of what holds an option ends it
        if self.silent:
            self._end_silent(tag)
            return
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k][0] == tag:
                self._pop(k)
                return

    def handle_data(self, data: str) -> None:
        if self.silent == ["head"] and not data.isspace():
            self.silent.clear()
        if self.silent:
            return
        node = self.stack[-1][1]
        if data.isspace():
            if not self.fresh and self.parts:
                self.parts[-1][1].append(" ")
            return
        if self.fresh or not self.parts or self.parts[-1][0] != node:
            self.parts.append((node, []))
            self.fresh = False
        self.parts[-1][1].append(data)
        n = len(data)
        self.chars[node] += n
        if self.links:
            self.linked[node] += n

    def features(self) -> np.ndarray:
        n = len(self.tag)
        parent, depth = np.array(self.parent), np.array(self.depth, float)
        own = np.array(self.chars, float)
        plain = np.array([sum(w in PLAIN_WORDS for w in ws) for ws in self.words], float)
        side = np.array([sum(w in SIDE_WORDS for w in ws) for ws in self.words], float)
        kind = {t: np.array([x == t for x in self.tag], float) for t in TAGS}
        down = np.stack([own, np.array(self.linked, float), np.array(self.tags, float), kind["p"], kind["li"], np.where(kind["p"] > 0, own, 0), np.ones(n), kind["h1"]])
        for k in range(n - 1, 0, -1):  # children stand behind their parents
            down[:, parent[k]] += down[:, k]
        chars, linked, tags, ps, lis, p_chars, nodes, h1 = down
        up = np.zeros((5, n))  # plain words, side words, in article or main, in nav/aside/footer/form, in header
        marks = np.stack([plain, side, kind["article"] + kind["main"], kind["nav"] + kind["aside"] + kind["footer"] + kind["form"], kind["header"]])
        place, siblings, last = np.zeros(n), np.zeros(n), {}
        for k in range(1, n):
            up[:, k] = up[:, parent[k]] + marks[:, parent[k]]
            place[k] = last[parent[k]] = last.get(parent[k], -1) + 1
        for k in range(1, n):
            siblings[k] = last[parent[k]] + 1
        at = np.maximum(parent, 0)
        more = [
            plain, side, depth, np.log1p(chars), np.log1p(own), linked / np.maximum(chars, 1), chars / (tags + 1), np.log1p(ps), np.log1p(lis), p_chars / np.maximum(chars, 1), np.log1p(nodes), np.minimum(h1, 2),
            place, siblings, place / np.maximum(siblings, 1), chars / np.maximum(chars[at], 1), chars / max(chars[0], 1.0), np.arange(n) / n, *np.minimum(up, 3), (linked[at] - linked) / np.maximum(chars[at] - chars, 1),
        ]
        return np.stack([*kind.values(), *more], 1)

    def text(self, logits: np.ndarray) -> str:
        """Text of the best ancestor-closed set of nodes."""
        best = logits.copy()
        best[0] = max(best[0], 0.0)
        for k in range(len(best) - 1, 0, -1):
            if best[k] > 0:
                best[self.parent[k]] += best[k]
        keep = best > 0
        for k in range(1, len(best)):
            keep[k] &= keep[self.parent[k]]
        blocks = (" ".join("".join(pieces).split()) for node, pieces in self.parts if keep[node])
        return " ".join(b for b in blocks if b)


def read_page(html: str | None, labelled: bool = False) -> Page:
    """The page; `labelled`: with the marks that generated layouts have on their main text."""
    try:
        return Page(html or "", labelled)
    except AssertionError:  # html.parser gives up on some broken declarations
        return Page(re.sub(r"(?is)<!(?!--|doctype)[^>]*(>|$)", " ", html or ""), labelled)


def train(layouts: int = 400, seed: int = 11) -> BoostedTrees:
    """Trees fitted on that many generated layouts."""
    from meridian.llm.layouts import generate

    pages = [read_page(html, True) for html in generate(layouts, seed)]
    y = []
    for page in pages:
        label = np.array(page.label)
        for k in range(len(label) - 1, 0, -1):
            label[page.parent[k]] |= label[k]
        y.append(label)
    return BoostedTrees().fit(np.concatenate([p.features() for p in pages]), np.concatenate(y).astype(float))


def main_text(pages: DataFrame, layouts: int = 400, seed: int = 11, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", rows_at_once: int = 64) -> DataFrame:
    """Rows (id, url, text, n_chars) with the main text of every whole page."""
    trees = train(layouts, seed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(start, rows_at_once)
                read = [read_page(h) for h in part.column(2).to_pylist()]
                x = [p.features() for p in read]
                scores = np.split(trees.logits(np.concatenate(x)), np.cumsum([len(a) for a in x])[:-1])
                texts = [p.text(s) for p, s in zip(read, scores)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[id_col, url_col, "text", "n_chars"])

    source = pages.select(id_col, url_col, html_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, `{url_col}` string, text string, n_chars bigint")

"""How the filters of a cascade interact, by count-weighted decision diagrams of failure masks.

Spark reduces the documents to counts by part and failure mask (2 ** filters masks at most). For each
part a decision diagram is built over these counts: a level for each filter of the current order, a
branch for passing and one for failing it, equal sub-diagrams shared, every node weighted by the
documents below it. Swapping adjacent levels leads from order to order until all have been seen, and
the path on which everything passes yields the steps of an order: what its next branch turns away is
removed there.

`facts` may repeat rows and parts; a null count is 0, a null part is the empty string, a null mask fails
nothing. No facts, no rows. In `failure_masks` a null text is empty, texts are read whole, and
repeated rows count as often as they come. Rows of one id are no copies of each other. A null id has no
label and counts as larger than all others. A repeated label holds if any of its rows says so. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import materialize, near

FILTERS = "ABCDE"
SPACE = r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
STEPS = "part string, filter_order string, step int, kept bigint, removed bigint, redundant bigint, unique_fails bigint, good_lost bigint, toxic_lost bigint, shapley bigint"

Counts = tuple[int, int, int]


class Diagram:
    """Counts by failure mask as a decision diagram; all paths have a node for every filter."""

    def __init__(self, counts: dict[int, Counts], order: str):
        self.order = list(order)
        self.kids: list[tuple[int, int] | None] = []  # of a node: where its filter passes, where it fails
        self.weight: list[Counts] = []
        self.known: dict[tuple, int] = {}
        self.root = self._build(counts, 0, 0)

    def _node(self, key: tuple, kids: tuple[int, int] | None, weight: Counts) -> int:
        if key not in self.known:
            self.known[key] = len(self.kids)
            self.kids.append(kids)
            self.weight.append(weight)
        return self.known[key]

    def _inner(self, passed: int, failed: int) -> int:
        a, b = self.weight[passed], self.weight[failed]
        return self._node(("node", passed, failed), (passed, failed), (a[0] + b[0], a[1] + b[1], a[2] + b[2]))

    def _build(self, counts: dict[int, Counts], level: int, mask: int) -> int:
        if level == len(self.order):
            weight = counts.get(mask, (0, 0, 0))
            return self._node(("leaf", *weight), None, weight)
        return self._inner(self._build(counts, level + 1, mask), self._build(counts, level + 1, mask | 1 << level))

    def swap(self, level: int) -> None:
        """Exchange the filters of `level` and the next level."""
        done: dict[tuple[int, int], int] = {}

        def below(node: int, depth: int) -> int:
            if (node, depth) not in done:
                passed, failed = self.kids[node]
                if depth:
                    done[node, depth] = self._inner(below(passed, depth - 1), below(failed, depth - 1))
                else:
                    pp, pf = self.kids[passed]
                    fp, ff = self.kids[failed]
                    done[node, depth] = self._inner(self._inner(pp, fp), self._inner(pf, ff))
            return done[node, depth]

        self.root = below(self.root, level)
        self.order[level], self.order[level + 1] = self.order[level + 1], self.order[level]

    def steps(self) -> list[tuple[str, Counts, int]]:
        """Along the path on which everything passes: filter, counts removed, documents kept."""
        found, node = [], self.root
        for name in self.order:
            node, failed = self.kids[node]
            found.append((name, self.weight[failed], self.weight[node][0]))
        return found


def adjacent_swaps(n: int) -> Iterator[int]:
    """Levels to swap one after the other so that all orders of n filters come up once."""
    if n < 2:
        return
    inner, turns = adjacent_swaps(n - 1), 0
    while True:
        down = turns % 2 == 0
        yield from range(n - 2, -1, -1) if down else range(n - 1)
        if (step := next(inner, None)) is None:
            return
        yield step + 1 if down else step  # the largest stands in front of the others, or behind them
        turns += 1


def audit_rows(part: str, counts: dict[int, Counts], filters: str) -> list[tuple]:
    """Rows of STEPS for all orders of one part."""
    diagram = Diagram(counts, filters)
    orders = [("".join(diagram.order), diagram.steps())]
    for level in adjacent_swaps(len(filters)):
        diagram.swap(level)
        orders.append(("".join(diagram.order), diagram.steps()))
    fails, alone, shapley = {}, {}, dict.fromkeys(filters, 0)
    for _, steps in orders:
        for k, (name, removed, _) in enumerate(steps):
            shapley[name] += removed[0]
            if k == 0:
                fails[name] = removed[0]
            if k == len(filters) - 1:  # all others pass
                alone[name] = removed[0]
    return [
        (part, order, k, kept, gone[0], fails[name] - gone[0], alone[name], gone[1], gone[2], shapley[name])
        for order, steps in orders
        for k, (name, gone, kept) in enumerate(steps, 1)
    ]


def audit_orders(facts: DataFrame, filters: str = FILTERS) -> DataFrame:
    """Steps of all orders by part; `facts`: (part, mask, n, good, toxic), bit k of mask: fails filters[k].

    A group holds one row a mask, so no task gets more than 2 ** len(filters) rows of a part.
    """

    def run(key: tuple, group: pa.Table) -> pa.Table:
        counts = {m: (n, good, toxic) for m, n, good, toxic in zip(*(group.column(c).to_pylist() for c in ("mask", "n", "good", "toxic")))}
        rows = audit_rows(key[0].as_py(), counts, filters)
        kinds = [pa.string(), pa.string(), pa.int32()] + [pa.int64()] * 7
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=[x.split()[0] for x in STEPS.split(", ")])

    whole = facts.groupBy(F.coalesce("part", F.lit("")).alias("part"), F.coalesce("mask", F.lit(0)).alias("mask"))
    whole = whole.agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("n", "good", "toxic")))
    return whole.groupBy("part").applyInArrow(run, STEPS)


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Counts (part, mask, n, good, toxic) of the five filters over documents.

    Fails A: under 50 words; B: 100 * distinct words < 65 * words; C: 100 * capitals (A-Z) > 5 * code
    points; D: one of `#$%&*|`; E: the text of a smaller id. Equal texts share A to D, so copies are
    counted before they meet: first by text, part and id, then by text and part, where a group of
    copies is one row a map task.
    """
    text = docs.select("doc_id", F.coalesce("source", F.lit("")).alias("part"), F.coalesce("text", F.lit("")).alias("text"))
    words = text.withColumn("words", F.array_remove(F.split("text", SPACE), ""))
    capitals = F.length("text") - F.length(F.translate("text", CAPITALS, ""))
    bits = (
        F.when(F.size("words") < 50, 1).otherwise(0)
        + F.when(100 * F.size(F.array_distinct("words")) < 65 * F.size("words"), 2).otherwise(0)
        + F.when(100 * capitals > 5 * F.length("text"), 4).otherwise(0)
        + F.when(F.col("text").rlike("[#$%&*|]"), 8).otherwise(0)
    )
    facts = words.select("doc_id", "part", bits.alias("bits"), F.unhex(F.sha2("text", 256)).alias("digest"))
    rows = facts.groupBy("digest", "part", "bits", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(*(F.max(F.coalesce((F.col(c) == 1).cast("long"), F.lit(0))).alias(k) for c, k in (("quality", "good"), ("toxic", "toxic"))))
    rows = rows.join(near(materialize(marks, "marks")), "doc_id", "left")
    sums = ["n", *((F.col("n") * F.coalesce(c, F.lit(0))).alias(c) for c in ("good", "toxic"))]
    rows = rows.select("digest", "part", "bits", F.col("doc_id").isNull().alias("last"), "doc_id", *sums)
    least = F.min(F.struct("last", "doc_id", "n", "good", "toxic"))
    texts = rows.groupBy("digest", "part", "bits").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")), least.alias("first"))
    same = Window.partitionBy("digest")  # a row a part
    key = F.struct("first.last", "first.doc_id")
    texts = texts.withColumn("own", F.min(key).over(same) == key)
    own = lambda c: F.when(F.col("own"), F.col(f"first.{c}")).otherwise(0)
    originals = F.struct(F.col("bits").alias("mask"), *(own(c).alias(c) for c in ("n", "good", "toxic")))
    copies = F.struct((F.col("bits") + 16).alias("mask"), *((F.col(c) - own(c)).alias(c) for c in ("n", "good", "toxic")))
    masks = texts.select("part", F.explode(F.array(originals, copies)).alias("x")).select("part", "x.*")
    return masks.groupBy("part", "mask").agg(*(F.sum(c).alias(c) for c in ("n", "good", "toxic")))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Steps of all 120 orders of the five filters by part, zeros included."""
    return audit_orders(failure_masks(docs, labels))

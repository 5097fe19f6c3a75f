"""Boosted trees and forests over several chronological fits at once.

Rows are those of `models`; a row may stand for n equal events. Inputs are the features with the training median in place
of missing values, then a flag a feature that says whether it is missing. Values are coded once by at most BINS ranges
a feature and fit and kept in blocks; a pass over the blocks grows all trees of a step, of all fits, by a level: tasks
add up counts and labels by node, feature and range, so what they send depends on the trees and not on the rows.

Trees are grown as MLlib grows them: splits of the greatest gain in variance, boosting on the residuals with a first
tree of full weight. Each event is drawn by itself: of n equal ones a binomial or, with replacement, a Poisson number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.operators.models import BITS, HELD, PART_ROWS, TRAIN, added, held_predictions, matrices, ordered, summed, unordered, used
from meridian.sources.workspace import written

#: Ranges of a feature's values; the code after the last one means missing.
BINS = 32
GONE = BINS
#: Rows of a block, about.
BLOCK_ROWS = 4096


def order_statistics(rows: DataFrame, fits: int, features: int, ranks: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Values at `ranks(n)` (ranks, fits, features) among a feature's n training values, exactly, and n; NaN if there are none.

    The search of `exact_medians` for any number of ranks: a pass counts the next BITS bits of the values behind every prefix
    that a rank has so far.
    """
    most = len(ranks(np.zeros((fits, features))))
    known, rank, total = np.zeros((most, fits, features), np.uint64), None, None
    for step in range(64 // BITS):
        shift = np.uint64(64 - BITS * (step + 1))
        prefixes = [[np.unique(known[:, k, f]) for f in range(features)] for k in range(fits)]

        def count(x: np.ndarray, roles: np.ndarray, _: np.ndarray, n: np.ndarray, step=step, shift=shift, prefixes=prefixes) -> np.ndarray:
            out = np.zeros((fits * features, most, 1 << BITS))
            for f in range(features):
                there = ~np.isnan(x[:, f])
                u, w, mine = ordered(x[there, f]), n[there], roles[there]
                digit = ((u >> shift) & np.uint64((1 << BITS) - 1)).astype(np.int64)
                upper = u >> (shift + np.uint64(BITS)) if step else np.zeros_like(u)
                for k in range(fits):
                    known = prefixes[k][f]
                    at = np.minimum(np.searchsorted(known, upper), len(known) - 1)
                    same = (known[at] == upper) & (mine[:, k] == TRAIN)
                    out[k * features + f] = np.bincount((at[same] << BITS) + digit[same], w[same], minlength=most << BITS).reshape(most, -1)
            return out

        counts = added(rows, count, (fits * features, most, 1 << BITS)).reshape(fits, features, most, -1)
        if rank is None:
            total = counts[:, :, 0].sum(axis=2)
            rank = ranks(total).astype(float)
        for k in range(fits):
            for f in range(features):
                at = np.searchsorted(prefixes[k][f], known[:, k, f])
                sums = np.cumsum(counts[k, f, at], axis=1)
                digit = np.minimum((sums <= rank[:, k, f, None]).sum(axis=1), (1 << BITS) - 1)
                rank[:, k, f] -= np.where(digit > 0, sums[np.arange(most), np.maximum(digit - 1, 0)], 0)
                known[:, k, f] = (known[:, k, f] << np.uint64(BITS)) | digit.astype(np.uint64)
    return np.where(total > 0, unordered(known), np.nan), total


def few_values(rows: DataFrame, fits: int, features: int) -> dict[tuple[int, int], np.ndarray]:
    """The sorted training values by (fit, feature) where there are at most BINS different ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = {(k, f): np.zeros(0) for k in range(fits) for f in range(features)}
        for batch in batches:
            if batch.num_rows:
                x, roles, _, _ = matrices(batch)
                for (k, f), some in found.items():
                    if len(some) <= BINS:
                        mine = x[roles[:, k] == TRAIN, f]
                        found[k, f] = np.unique(np.concatenate([some, mine[~np.isnan(mine)] + 0.0]))[: BINS + 1]
        at = [k * features + f for (k, f), some in found.items() for _ in some]
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(np.concatenate([*found.values(), np.zeros(0)]))], names=["at", "v"])

    values = used(rows).mapInArrow(run, "at int, v double").groupBy("at").agg(F.slice(F.array_sort(F.collect_set("v")), 1, BINS + 1).alias("v"))
    return {divmod(r.at, features): np.array(r.v) for r in values.collect() if len(r.v) <= BINS}  # at most fits x features rows


@dataclass(frozen=True)
class Codes:
    """How values are coded: by fit and feature the upper ends of all ranges but the last, and the code of the median."""

    ends: list[list[np.ndarray]]
    middle: np.ndarray

    def of(self, x: np.ndarray, k: int) -> np.ndarray:
        """Codes (features, rows) for fit k."""
        out = np.empty(x.shape[::-1], np.uint8)
        for f, ends in enumerate(self.ends[k]):
            out[f] = np.where(np.isnan(x[:, f]), GONE, np.searchsorted(ends, x[:, f]))
        return out


def between(v: np.ndarray) -> np.ndarray:
    """The middles of neighbouring values; the lower one where either is infinite."""
    with np.errstate(invalid="ignore"):
        middle = v[:-1] + (v[1:] - v[:-1]) / 2
    return np.where(np.isfinite(middle), middle, v[:-1])


def learn_codes(rows: DataFrame, fits: int, features: int) -> Codes:
    """Ranges between neighbouring values where these are few, else between quantiles; a value that spans a whole range is one by itself."""
    share = np.arange(1, BINS)[:, None, None] / BINS
    ranks = lambda n: np.concatenate([np.floor(share * n), np.maximum(n - 1, 0)[None] // 2, n[None] // 2])
    found, n = order_statistics(rows, fits, features, ranks)
    few = few_values(rows, fits, features)
    medians = np.where(n > 0, found[-2] + (found[-1] - found[-2]) / 2, 0.0)
    ends = []
    for k in range(fits):
        ends.append([])
        for f in range(features):
            if (k, f) in few:
                ends[k].append(between(few[k, f]))
            elif not n[k, f]:
                ends[k].append(np.zeros(0))
            else:
                v, times = np.unique(found[:-2, k, f], return_counts=True)
                ends[k].append(np.unique(np.concatenate([v, np.nextafter(v[times > 1], -np.inf)])))
    middle = np.array([[np.searchsorted(ends[k][f], medians[k, f]) for f in range(features)] for k in range(fits)])
    return Codes(ends, middle.reshape(fits, features))


def blocks_of(rows: DataFrame, codes: Codes, fits: int) -> DataFrame:
    """The rows coded, in written blocks of about BLOCK_ROWS: which rows make a block follows from their contents."""
    size, names = rows.count(), ["block", "size", "codes", "roles", "y", "n"]
    blocks = max(1, -(-size // BLOCK_ROWS))
    parts = max(-(-size // PART_ROWS), min(blocks, rows.sparkSession.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x, roles, y, n = matrices(batch)
                coded = np.concatenate([codes.of(x, k) for k in range(fits)]).T  # (rows, fits x features)
                yield pa.RecordBatch.from_arrays([batch.column("mark"), *(pa.array([a.tobytes() for a in np.ascontiguousarray(b)], pa.binary()) for b in (coded, roles.astype(np.uint8))), pa.array(y), pa.array(n)], names=["mark", "codes", "roles", "y", "n"])

    def packed(table: pa.Table) -> pa.Table:
        table = table.combine_chunks().sort_by([("mark", "ascending"), ("y", "ascending")])
        bytes_of = lambda c: np.frombuffer(b"".join(table.column(c).to_pylist()), np.uint8).reshape(len(table), -1)
        wide = [np.ascontiguousarray(bytes_of(c).T).tobytes() for c in ("codes", "roles")]
        flat = [table.column(c).to_numpy().astype(float).tobytes() for c in ("y", "n")]
        row = [table.column("mark")[0].as_py() % blocks, len(table), *wide, *flat]
        return pa.table([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.int64(), *[pa.binary()] * 4))], names=names)

    coded = used(rows, F.xxhash64("x", "y", "roles").alias("mark")).mapInArrow(run, "mark bigint, codes binary, roles binary, y double, n double")
    coded = coded.withColumn("block", F.pmod("mark", F.lit(blocks))).repartition(parts, "block")
    return written(coded.groupBy("block").applyInArrow(packed, "block bigint, size bigint, codes binary, roles binary, y binary, n binary"), "tree-blocks")


@dataclass
class Tree:
    """Node k has the children 2k and 2k + 1; input -1: a leaf. Codes up to `end` go left; inputs after the features are flags."""

    depth: int
    input: np.ndarray = field(init=False)
    end: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        nodes = 2 << self.depth
        self.input, self.end, self.value = np.full(nodes, -1), np.zeros(nodes, int), np.zeros(nodes)

    def nodes(self, codes: np.ndarray, middle: np.ndarray) -> np.ndarray:
        """The node that rows end in."""
        at, features = np.ones(codes.shape[1], int), len(codes)
        for level in range(self.depth):
            for node in range(1 << level, 2 << level):
                if (j := self.input[node]) >= 0:
                    mine = np.flatnonzero(at == node)
                    c = codes[j % features][mine]
                    right = c == GONE if j >= features else np.where(c == GONE, middle[j], c) > self.end[node]
                    at[mine] = 2 * node + right
        return at

    def predict(self, codes: np.ndarray, middle: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(codes, middle)]


@dataclass
class Boosted:
    """Trees with weights; `early`: they end where the held rows gain no more."""

    fit: int
    rounds: int
    depth: int
    step: float
    early: bool
    share: float = 0.8
    least: int = 5
    seed: int = 7
    trees: list[Tree] = field(default_factory=list)
    done: bool = False
    best: tuple[int, float] | None = None

    def predict(self, codes: np.ndarray, middle: np.ndarray, rounds: int | None = None) -> np.ndarray:
        return sum(((self.step if k else 1.0) * t.predict(codes, middle) for k, t in enumerate(self.trees[:rounds])), np.zeros(codes.shape[1]))

    def judged(self, error: float, weight: float) -> None:
        """Ends the rounds or keeps them by the mean squared error of the held rows, as MLlib does with a tolerance of 1e-4."""
        now = error / max(weight, 1)
        if self.best is None:
            self.best = (len(self.trees), now)
        elif self.best[1] - now < 1e-4 * max(now, 0.01):
            self.done = True
        elif now < self.best[1]:
            self.best = (len(self.trees), now)
        if self.done or len(self.trees) == self.rounds:
            self.trees, self.done = self.trees[: self.best[0]], True


def draws(seed: int, fit: int, number: int, block: int, n: np.ndarray, share: float, again: bool) -> np.ndarray:
    """How many of n equal events a tree learns from, the same in every pass."""
    if not again and share >= 1:
        return n
    random = np.random.default_rng([seed, fit, number, block])
    return (random.poisson(n * share) if again else random.binomial(n.astype(np.int64), share)).astype(float)


def cells_of(codes: np.ndarray, place: np.ndarray, nodes: int, weight: np.ndarray, label: np.ndarray) -> np.ndarray:
    """Weights and weighted labels (nodes, features, 2 x (BINS + 1)) by node, feature and code; rows with place -1 do not count."""
    features, width = len(codes), BINS + 1
    mine = np.flatnonzero((place >= 0) & (weight > 0))
    w = weight[mine]
    at = (codes[:, mine].astype(np.int64) + (place[mine] * (features * width)) + (np.arange(features) * width)[:, None]).ravel()
    sums = (np.bincount(at, np.tile(v, features), nodes * features * width).reshape(nodes, features, width) for v in (w, w * label[mine]))
    return np.concatenate([*sums], axis=2)


def split(tree: Tree, level: int, cells: np.ndarray, codes: Codes, fit: int, least: int, inputs: Callable[[int], np.ndarray | None]) -> None:
    """Splits the nodes of a level by their cells; a split leaves `least` events on both sides."""
    width, middle, features = BINS + 1, codes.middle[fit], cells.shape[1]
    for node, cell in zip(range(1 << level, 2 << level), cells):
        w, s = cell[:, :width].copy(), cell[:, width:].copy()
        if not w[0].sum():
            continue
        gone = np.stack([w[:, GONE], s[:, GONE]])
        for a, b in ((w, gone[0]), (s, gone[1])):
            a[np.arange(features), middle] += b
        n, total = w[0, :GONE].sum(), s[0, :GONE].sum()
        if level == 0:
            tree.value[node] = total / n
        left = np.concatenate([np.cumsum(w[:, :GONE], axis=1)[:, :-1], np.zeros((features, BINS - 1))])
        sums = np.concatenate([np.cumsum(s[:, :GONE], axis=1)[:, :-1], np.zeros((features, BINS - 1))])
        left[features:, 0], sums[features:, 0] = n - gone[0], total - gone[1]
        with np.errstate(divide="ignore", invalid="ignore"):
            gain = sums**2 / left + (total - sums) ** 2 / (n - left) - total**2 / n
        gain[(left < least) | (n - left < least)] = -np.inf
        if (some := inputs(node)) is not None:
            gain[~some] = -np.inf
        j, end = np.unravel_index(np.argmax(gain), gain.shape)
        if gain[j, end] > 1e-12 * total**2 / n:
            tree.input[node], tree.end[node] = j, end
            tree.value[2 * node], tree.value[2 * node + 1] = sums[j, end] / left[j, end], (total - sums[j, end]) / (n - left[j, end])


@dataclass(frozen=True)
class Block:
    number: int
    codes: np.ndarray
    roles: np.ndarray
    y: np.ndarray
    n: np.ndarray


def blocks_in(batches: Iterator[pa.RecordBatch], fits: int) -> Iterator[Block]:
    for batch in batches:
        for i in range(batch.num_rows):
            number, size = (batch.column(c)[i].as_py() for c in ("block", "size"))
            codes, roles, y, n = (np.frombuffer(batch.column(c)[i].as_buffer(), kind) for c, kind in (("codes", np.uint8), ("roles", np.uint8), ("y", float), ("n", float)))
            yield Block(number, codes.reshape(fits, -1, size), roles.reshape(fits, size), y, n)


def boost(blocks: DataFrame, codes: Codes, models: list[Boosted]) -> None:
    """Grows all models side by side; a pass adds a level to each."""
    fits, features = codes.middle.shape
    growing: dict[int, tuple[Tree, int]] = {}
    while going := [(k, m) for k, m in enumerate(models) if not m.done]:
        for k, m in going:
            growing.setdefault(k, (Tree(m.depth), 0))
        starts = np.cumsum([0, *((1 << growing[k][1]) * features for k, _ in going)]).tolist()
        tail = starts[-1]

        def run(batches: Iterator[pa.RecordBatch], going=going, growing=growing, starts=starts, tail=tail) -> np.ndarray:
            total = np.zeros((tail + len(going), 2 * (BINS + 1)))
            for b in blocks_in(batches, fits):
                for i, (k, m) in enumerate(going):
                    (tree, level), mine, middle = growing[k], b.codes[m.fit], codes.middle[m.fit]
                    so_far = m.predict(mine, middle)
                    held, train = b.roles[m.fit] == HELD, b.roles[m.fit] == TRAIN
                    if m.early and level == 0 and m.trees:
                        total[tail + i, :2] += b.n[held] @ (b.y[held] - so_far[held]) ** 2, b.n[held].sum()
                    if len(m.trees) == m.rounds:
                        continue
                    label = 2 * (b.y - so_far) if m.trees else b.y
                    weight = draws(m.seed, m.fit, len(m.trees), b.number, b.n, m.share, False) * train
                    at = tree.nodes(mine, middle) - (1 << level)
                    total[starts[i] : starts[i + 1]] += cells_of(mine, at, 1 << level, weight, label).reshape(-1, total.shape[1])
            return total

        total = summed(blocks, run, tail + len(going), 2 * (BINS + 1))
        for i, (k, m) in enumerate(going):
            tree, level = growing[k]
            if m.early and level == 0 and m.trees:
                m.judged(*total[tail + i, :2])
                if m.done:
                    continue
            split(tree, level, total[starts[i] : starts[i + 1]].reshape(1 << level, features, -1), codes, m.fit, m.least, lambda node: None)
            growing[k] = (tree, level + 1)
            if level + 1 == m.depth:
                m.trees.append(tree)
                del growing[k]
                m.done = not m.early and len(m.trees) == m.rounds


@dataclass
class Forest:
    """Mean of trees that learn from drawn events (with replacement); a node splits by a drawn share of the inputs."""

    fit: int
    trees: list[Tree]
    least: int = 8
    inputs: float = 0.7
    seed: int = 7

    def predict(self, codes: np.ndarray, middle: np.ndarray) -> np.ndarray:
        return sum(t.predict(codes, middle) for t in self.trees) / len(self.trees)


def forest(fit: int, trees: int, depth: int, **more) -> Forest:
    return Forest(fit, [Tree(depth) for _ in range(trees)], **more)


def grow(blocks: DataFrame, codes: Codes, forests: list[Forest]) -> None:
    """Grows all trees of all forests side by side, a level a pass."""
    fits, features = codes.middle.shape
    trees = [(m, i, t) for m in forests for i, t in enumerate(m.trees)]
    for level in range(max((t.depth for *_, t in trees), default=0)):
        nodes = 1 << level

        def run(batches: Iterator[pa.RecordBatch], level=level, nodes=nodes) -> np.ndarray:
            total = np.zeros((len(trees), nodes, features, 2 * (BINS + 1)))
            for b in blocks_in(batches, fits):
                for k, (m, i, tree) in enumerate(trees):
                    weight = draws(m.seed, m.fit, i, b.number, b.n, 1.0, True) * (b.roles[m.fit] == TRAIN)
                    at = tree.nodes(b.codes[m.fit], codes.middle[m.fit]) - nodes
                    total[k] += cells_of(b.codes[m.fit], at, nodes, weight, b.y)
            return total.reshape(-1, total.shape[-1])

        found = summed(blocks, run, len(trees) * nodes * features, 2 * (BINS + 1)).reshape(len(trees), nodes, features, -1)
        for (m, i, tree), cells in zip(trees, found):

            def drawn(node: int, m=m, i=i) -> np.ndarray:
                some = np.random.default_rng([m.seed, m.fit, i, node, 1]).permutation(2 * features)[: -(-int(m.inputs * 2 * features * 1e6) // 10**6)]
                return np.isin(np.arange(2 * features), some)

            split(tree, level, cells, codes, m.fit, m.least, drawn)


def tree_predictions(rows: DataFrame, codes: Codes, models: list[tuple[str, Boosted | Forest]]) -> DataFrame:
    """Predictions, as those of `held_predictions`, of named models for the held rows of their fits."""

    def of(x: np.ndarray, k: int) -> Iterator[np.ndarray]:
        mine = codes.of(x, k)
        for _, m in models:
            if m.fit == k:
                yield m.predict(mine, codes.middle[k])

    return held_predictions(rows, [(m.fit, name) for name, m in models], of)

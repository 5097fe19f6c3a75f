"""Missing-aware regression over several chronological fits at once.

Rows are (event_key, y, x, roles): `x` an array of features (null or NaN: missing) and `roles` an array with
the row's part in each fit: TRAIN, HELD (validation or test) or OUT. With a column `n` a row stands for n equal events. A pass over the rows serves all
fits and features together: tasks reduce their rows to counts or sums whose size depends on fits and
features only, and Spark adds these up.

A linear model's inputs are the features with the training median in place of missing values, then a
flag a feature that says whether it is missing; all are standardised by the training rows. A feature
that is never there in training is 0; inputs that do not vary in training have no weight.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OUT, TRAIN, HELD = 0, 1, 2
#: Bits of a value that a pass of the median search settles.
BITS = 8
#: Rows of a part of a tree learner's table, about: its tasks read parts, again in every round.
PART_ROWS = 50_000
#: Columns of predictions; `n` events share a row's.
PREDICTIONS = "fit int, model string, event_key string, n bigint, actual double, prediction double"


def matrices(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """x (missing: NaN), roles, y and n of a batch with these columns; without a column n every row counts once."""
    wide = lambda c: batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    one = lambda c: batch.column(c).to_numpy(zero_copy_only=False).astype(float)
    return wide("x").astype(float), wide("roles"), one("y"), one("n") if "n" in batch.schema.names else np.ones(batch.num_rows)


def used(rows: DataFrame, *more: str) -> DataFrame:
    """The columns that `matrices` reads."""
    return rows.select(*more, "x", "roles", "y", *(c for c in ("n",) if c in rows.columns))


def lines_of(column: pa.Array, width: int) -> np.ndarray:
    """The doubles of a column of binaries that all hold `width` of them."""
    _, offsets, data = column.buffers()
    first = np.frombuffer(offsets, np.int32)[column.offset]
    return np.frombuffer(data, np.float64, len(column) * width, first).reshape(-1, width)


def summed(frame: DataFrame, part: Callable[[Iterator[pa.RecordBatch]], np.ndarray], lines: int, width: int) -> np.ndarray:
    """The sum of the tables (lines, width) that `part` makes of the tasks' rows; added up by line, so the driver gets one table."""
    names = ["at", "cells"]

    def sent(total: np.ndarray) -> Iterator[pa.RecordBatch]:
        at = np.flatnonzero(total.any(axis=1))
        for some in np.array_split(at, -(-len(at) // 4096)) if len(at) else []:
            ends = np.arange(len(some) + 1, dtype=np.int32) * np.int32(8 * width)
            cells = pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(ends), pa.py_buffer(total[some].tobytes())])
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), cells], names=names)

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sent(part(batches))

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((lines, width))
        for batch in batches:
            if batch.num_rows:
                at = batch.column("at").to_numpy()
                order = np.argsort(at, kind="stable")
                some, starts = np.unique(at[order], return_index=True)
                total[some] += np.add.reduceat(lines_of(batch.column("cells"), width)[order], starts, axis=0)
        yield from sent(total)

    form = "at bigint, cells binary"
    tasks = 1 + (lines * width >> 19)
    found = frame.mapInArrow(parts, form).repartition(tasks, "at").mapInArrow(together, form).toArrow()
    total = np.zeros((lines, width))
    for batch in found.to_batches():
        if batch.num_rows:
            total[batch.column("at").to_numpy()] = lines_of(batch.column("cells"), width)
    return total


def added(rows: DataFrame, part: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray], shape: tuple[int, ...]) -> np.ndarray:
    """The sum over all batches of `part(x, roles, y, n)`, an array of `shape` (fits, lines, width)."""
    fits, lines, width = shape

    def run(batches: Iterator[pa.RecordBatch]) -> np.ndarray:
        total = np.zeros(shape)
        for batch in batches:
            if batch.num_rows:
                total += part(*matrices(batch))
        return total.reshape(-1, width)

    return summed(used(rows), run, fits * lines, width).reshape(shape)


def ordered(x: np.ndarray) -> np.ndarray:
    """Doubles as unsigned integers of the same order; -0.0 is 0.0."""
    u = (x + 0.0).view(np.uint64)
    return np.where(u >> np.uint64(63), ~u, u | np.uint64(1 << 63))


def unordered(u: np.ndarray) -> np.ndarray:
    return np.where(u >> np.uint64(63), u & np.uint64((1 << 63) - 1), ~u).view(np.float64)


def exact_medians(rows: DataFrame, fits: int, features: int) -> tuple[np.ndarray, np.ndarray]:
    """Exact training medians and counts of missing values by fit and feature (median NaN: none there).

    All pairs are searched together, BITS bits of the order-preserving integer form a pass: how many values
    share the bits known so far is counted by their next bits, and the range with the middle is kept. Both middle
    values of an even number are followed.
    """
    sides, steps = 2, 64 // BITS
    known = np.zeros((sides, fits, features), np.uint64)
    rank = missing = None
    for step in range(steps):
        shift = np.uint64(64 - BITS * (step + 1))

        def count(x: np.ndarray, roles: np.ndarray, _: np.ndarray, n: np.ndarray, step=step, shift=shift) -> np.ndarray:
            u, there, out = ordered(x), ~np.isnan(x), np.zeros((sides, fits, features, (1 << BITS) + 1))
            place = ((u >> shift) & np.uint64((1 << BITS) - 1)).astype(np.int64) + (np.arange(features) << BITS)
            upper = u >> (shift + np.uint64(BITS)) if step else np.zeros_like(u)
            once = (n == 1).all()
            for k in range(fits):
                train = np.flatnonzero(roles[:, k] == TRAIN)
                here, prefix, at = there[train], upper[train], place[train]
                out[:, k, :, -1] = n[train] @ ~here
                for side in range(sides):
                    if side and (known[side, k] == known[0, k]).all():
                        out[side, k] = out[0, k]
                        continue
                    same = here & (prefix == known[side, k])
                    weights = None if once else np.broadcast_to(n[train, None], same.shape)[same]
                    out[side, k, :, :-1] = np.bincount(at[same], weights, minlength=features << BITS).reshape(features, -1)
            return out.reshape(sides * fits, features, -1)

        counts = added(rows, count, (sides * fits, features, (1 << BITS) + 1)).reshape(sides, fits, features, -1)
        sums = np.cumsum(counts[..., :-1], axis=3)
        if rank is None:
            n, missing = sums[0, :, :, -1], counts[0, :, :, -1]
            rank = np.stack([np.maximum(n - 1, 0) // 2, n // 2])
        digit = np.minimum((sums <= rank[..., None]).sum(axis=3), (1 << BITS) - 1)
        before = np.where(digit > 0, np.take_along_axis(sums, np.maximum(digit - 1, 0)[..., None], 3)[..., 0], 0)
        rank = rank - before
        known = (known << np.uint64(BITS)) | digit.astype(np.uint64)
    low, high = unordered(known)
    return np.where(n > 0, low + (high - low) / 2, np.nan), missing


@dataclass(frozen=True)
class Inputs:
    """How the inputs of every fit are made: medians, and means and scales of features and flags."""

    medians: np.ndarray
    missing: np.ndarray
    means: np.ndarray
    scales: np.ndarray

    def of(self, x: np.ndarray, k: int) -> np.ndarray:
        """Standardised inputs for fit k."""
        gone = np.isnan(x)
        return (np.concatenate([np.where(gone, self.medians[k], x), gone], axis=1) - self.means[k]) / self.scales[k]


def learn_inputs(rows: DataFrame, fits: int, features: int) -> Inputs:
    medians, missing = exact_medians(rows, fits, features)
    medians = np.where(np.isnan(medians), 0.0, medians)

    def moments(x: np.ndarray, roles: np.ndarray, _: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros((fits, 3, 2 * features))
        for k in range(fits):
            train = roles[:, k] == TRAIN
            mine, w = x[train], n[train]
            gone = np.isnan(mine)
            v = np.concatenate([np.where(gone, 0.0, mine - medians[k]), gone], axis=1)  # about the median: no cancellation
            out[k] = [np.full(2 * features, w.sum()), w @ v, w @ (v * v)]
        return out

    n, s, q = np.moveaxis(added(rows, moments, (fits, 3, 2 * features)), 1, 0)
    n = np.maximum(n, 1)
    spread = np.sqrt(np.maximum(q / n - (s / n) ** 2, 0))
    means = s / n + np.concatenate([medians, np.zeros_like(medians)], axis=1)
    return Inputs(medians, missing, means, np.where(spread > 1e-12 * (1 + np.abs(means)), spread, 1.0))


@dataclass(frozen=True)
class Moments:
    """Of the training rows of a fit: their number, the mean label, Z'Z and Z'(y - mean)."""

    n: int
    mean: float
    spread: np.ndarray
    covered: np.ndarray


def normal_equations(rows: DataFrame, inputs: Inputs) -> list[Moments]:
    """What linear models of any penalty need, for all fits from one pass."""
    fits, width = inputs.means.shape

    def products(x: np.ndarray, roles: np.ndarray, y: np.ndarray, n: np.ndarray) -> np.ndarray:
        out = np.zeros((fits, width + 2, width + 2))
        for k in range(fits):
            mine = roles[:, k] == TRAIN
            z = np.concatenate([inputs.of(x[mine], k), y[mine, None], np.ones((mine.sum(), 1))], axis=1)
            out[k] = z.T @ (z * n[mine, None])
        return out

    found = []
    for g in added(rows, products, (fits, width + 2, width + 2)):
        n = max(g[-1, -1], 1.0)
        mean = g[-1, -2] / n
        found.append(Moments(int(g[-1, -1]), mean, g[:width, :width], g[:width, width] - mean * g[:width, -1]))
    return found


def ridge(m: Moments, alpha: float) -> np.ndarray:
    """Weights that minimise |y - mean - Zw|^2 + alpha |w|^2."""
    return np.linalg.solve(m.spread + alpha * np.eye(len(m.covered)), m.covered)


def elastic_net(m: Moments, alpha: float, share: float, most: int = 50_000, close: float = 1e-12) -> np.ndarray:
    """Weights that minimise |y - mean - Zw|^2 / 2n + alpha (share |w|_1 + (1 - share) |w|^2 / 2).

    Accelerated proximal steps, started afresh where the momentum points uphill.
    """
    n = max(m.n, 1)
    g, c = m.spread / n + alpha * (1 - share) * np.eye(len(m.covered)), m.covered / n
    length = 1 / max(np.linalg.eigvalsh(g)[-1], 1e-300)
    w = ahead = np.zeros(len(c))
    speed = 1.0
    for _ in range(most):
        x = ahead - length * (g @ ahead - c)
        new = np.sign(x) * np.maximum(np.abs(x) - length * alpha * share, 0)
        if (ahead - new) @ (new - w) > 0:
            speed = 1.0
        faster = (1 + (1 + 4 * speed * speed) ** 0.5) / 2
        ahead = new + (speed - 1) / faster * (new - w)
        moved, w, speed = np.abs(new - w).max(initial=0), new, faster
        if moved <= close * (1 + np.abs(w).max(initial=0)):
            break
    return w


def linear_predictions(rows: DataFrame, inputs: Inputs, models: list[tuple[int, str, np.ndarray, float]]) -> DataFrame:
    """Predictions (fit, model, event_key, n, actual, prediction) of models (fit, name, weights, mean) for the held rows of their fits."""

    def of(x: np.ndarray, k: int, some: list) -> Iterator[np.ndarray]:
        z = inputs.of(x, k)
        for _, _, weights, mean in some:
            yield z @ weights + mean

    return held_predictions(rows, [m[:2] for m in models], lambda x, k: of(x, k, [m for m in models if m[0] == k]))


def held_predictions(rows: DataFrame, models: list[tuple[int, str]], of: Callable[[np.ndarray, int], Iterable[np.ndarray]]) -> DataFrame:
    """Predictions (fit, model, event_key, n, actual, prediction) of models (fit, name) for the held rows of their fits.

    `of(x, fit)` gives a fit's predictions for rows x, one array a model.
    """
    by_fit = {k: [name for fit, name in models if fit == k] for k in sorted({fit for fit, _ in models})}
    names = ["fit", "model", "event_key", "n", "actual", "prediction"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, roles, y, n = matrices(batch)
            for k, some in by_fit.items():
                held = np.flatnonzero(roles[:, k] == HELD)
                if not len(held):
                    continue
                size, keys = len(held), batch.column("event_key").take(pa.array(held))
                for name, found in zip(some, of(x[held], k)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(size, k, np.int32)), pa.array([name] * size, pa.string()), keys, pa.array(n[held].astype(np.int64)), pa.array(y[held]), pa.array(found)], names=names)

    return used(rows, "event_key").mapInArrow(run, PREDICTIONS)


def vectors(rows: DataFrame, inputs: Inputs, fit: int) -> DataFrame:
    """Rows (event_key, label, held, features) of one fit for MLlib's tree learners: imputed features and flags, not scaled.

    In parts of bounded rows, so that what a learner's task reads and keeps does not grow with the table. The trees of
    `trees` are compared with MLlib's on these.
    """
    from pyspark.ml.functions import array_to_vector

    gone = lambda v: v.isNull() | F.isnan(v)
    medians = F.array(*(F.lit(float(m)) for m in inputs.medians[fit]))
    filled = F.zip_with("x", medians, lambda v, m: F.when(gone(v), m).otherwise(v))
    features = F.concat(filled, F.transform("x", lambda v: gone(v).cast("double")))
    role = F.element_at("roles", fit + 1)
    mine = rows.where(role != OUT)
    parts = -(-mine.count() // PART_ROWS)
    if parts > 1:
        mine = mine.repartition(parts, "event_key")
    return mine.select("event_key", F.col("y").alias("label"), (role == HELD).alias("held"), array_to_vector(features).alias("features"))


def with_both(rows: DataFrame, fits: int) -> list[int]:
    """The fits that have training rows and held ones."""
    has = lambda k, role: F.coalesce(F.bool_or(F.element_at("roles", k + 1) == role), F.lit(False))
    found = rows.agg(*((has(k, TRAIN) & has(k, HELD)).alias(f"f{k}") for k in range(fits))).first()
    return [k for k in range(fits) if found[k]]


def roles_of(*conditions: tuple[Column, Column]) -> Column:
    """The array of roles from (train, held) conditions, one pair a fit."""
    return F.array(*(F.when(a, TRAIN).when(b, HELD).otherwise(OUT) for a, b in conditions))


def union_of(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

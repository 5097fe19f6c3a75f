"""Sequential batches over a whole ordered table, by pointer jumping within and across blocks of rows."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.sources.workspace import written

#: Rows of a block, and blocks (or groups of blocks) that a task composes.
BLOCK, FAN = 1 << 14, 256


def numbered(rows: DataFrame, key: str, *ties: str) -> DataFrame:
    """Adds `pos`, the row's place in the order of `key` (nulls first) and `ties`, from 0; written.

    Rows are sorted in key ranges, and a range's rows are numbered from the size of the ranges before.
    """
    spark, n = rows.sparkSession, rows.count()
    ranges = max(1, math.ceil(n / BLOCK))
    dealt = written(rows.repartitionByRange(ranges, F.col(key).asc_nulls_first(), *ties).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # one row a range
    place = F.row_number().over(Window.partitionBy("_range").orderBy(F.col(key).asc_nulls_first(), *ties))
    found = dealt.withColumn("_k", place).join(F.broadcast(before), "_range").withColumn("pos", F.col("_before") + F.col("_k") - 1)
    return written(found.drop("_range", "_k", "_before"), "numbered")


def next_starts(tokens: np.ndarray, rows: int, most_items: int, most_tokens: int) -> np.ndarray:
    """Where the next batch starts if one starts at each of the first `rows` places; `tokens` goes on behind them."""
    sums = np.concatenate([[0], np.cumsum(tokens)])
    at = np.arange(rows)
    fits = np.searchsorted(sums, sums[:rows] + most_tokens, side="right") - 1
    return np.minimum(np.maximum(at + 1, np.minimum(fits, at + most_items)), len(tokens))


def jumps(following: np.ndarray, most_items: int) -> tuple[np.ndarray, np.ndarray]:
    """For a first start at each of the first `most_items` places: the first start behind the block (from its end), and batches begun in it."""
    n = len(following)
    to, begun = following.copy(), np.ones(n, np.int64)
    while len(inside := np.flatnonzero(to < n)):
        begun[inside] += begun[to[inside]]
        to[inside] = to[to[inside]]
    entry = np.arange(most_items)
    short = np.minimum(entry, n - 1) if n else entry[:0]
    if not n:
        return entry, np.zeros(most_items, np.int64)
    return np.where(entry < n, to[short] - n, entry - n), np.where(entry < n, begun[short], 0)


def sequential_batches(rows: DataFrame, key: str, most_items: int, most_tokens: int, tokens: str = "tokens") -> DataFrame:
    """Adds `batch` from 0: rows in the order of `key` fill a batch until one more would pass so many items or tokens.

    A row over the limit is a batch of its own; rows of equal keys follow by tokens. A null or
    negative number of tokens is 0. What happens at a block's border depends only on where the first batch behind it starts: at
    one of `most_items` places. So every block gives a table of that size; tables of FAN blocks
    are composed, again and again up to one, and the way back down tells every block its first start and batch.
    """
    size = F.greatest(F.coalesce(tokens, F.lit(0)), F.lit(0)).cast("long")
    placed = numbered(rows.withColumn("_tokens", size), key, "_tokens")
    block = F.floor(F.col("pos") / BLOCK)
    if most_items > BLOCK:
        raise ValueError(f"at most {BLOCK} items")
    head = F.col("pos") % BLOCK < most_items  # the block before looks that far ahead
    blocks = F.when(head & (block > 0), F.array(block, block - 1)).otherwise(F.array(block))
    seen = written(placed.select("pos", "_tokens", F.explode(blocks).alias("block")), "blocks")

    def following(group: pd.DataFrame) -> tuple[pd.DataFrame, int, np.ndarray]:
        group = group.sort_values("pos", ignore_index=True)
        n = int((group["pos"] < (group["block"].iloc[0] + 1) * BLOCK).sum())
        return group, n, next_starts(group["_tokens"].to_numpy(), n, most_items, most_tokens)

    def table(number: int, to: np.ndarray, begun: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"block": [number], "to": [to.astype(np.int64).tobytes()], "begun": [begun.tobytes()]})

    def of_block(group: pd.DataFrame) -> pd.DataFrame:
        _, _, nxt = following(group)
        return table(group["block"].iloc[0], *jumps(nxt, most_items))

    def unpacked(group: pd.DataFrame):
        for number, to, begun in group.sort_values("block")[["block", "to", "begun"]].itertuples(index=False):
            yield number, np.frombuffer(to, np.int64), np.frombuffer(begun, np.int64)

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        at, total = np.arange(most_items), np.zeros(most_items, np.int64)
        for _, to, begun in unpacked(group):
            total, at = total + begun[at], to[at]
        return table(group["block"].iloc[0] // FAN, at, total)

    def descend(group: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        at, batch, out = int(above["entry"].iloc[0]), int(above["batch"].iloc[0]), []
        for number, to, begun in unpacked(group):
            out.append((number, at, batch))
            at, batch = int(to[at]), batch + int(begun[at])
        return pd.DataFrame(out, columns=["block", "entry", "batch"])

    form = "block bigint, to binary, begun binary"
    up = lambda df: df.groupBy(F.floor(F.col("block") / FAN).alias("up"))
    levels = [written(seen.groupBy("block").applyInPandas(of_block, form), "jumps")]
    last = placed.agg(F.max("pos")).first()[0]
    count = 1 if last is None else last // BLOCK + 1
    while count > 1:
        levels.append(written(up(levels[-1]).applyInPandas(compose, form), "jumps"))
        count = -(-count // FAN)
    entries = rows.sparkSession.createDataFrame([(0, 0, 0)], "block bigint, entry bigint, batch bigint")
    for level in reversed(levels[:-1]):
        entries = up(level).cogroup(entries.groupBy("block")).applyInPandas(descend, "block bigint, entry bigint, batch bigint")
    entries = written(entries, "entries")

    def assign(group: pd.DataFrame, entry: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"pos": [], "batch": []})
        group, n, nxt = following(group)
        starts, at = np.zeros(n, np.int64), int(entry["entry"].iloc[0])
        while at < n:
            starts[at], at = 1, nxt[at]
        return pd.DataFrame({"pos": group["pos"][:n], "batch": int(entry["batch"].iloc[0]) - 1 + np.cumsum(starts)})

    batches = seen.groupBy("block").cogroup(entries.groupBy("block")).applyInPandas(assign, "pos bigint, batch bigint")
    return placed.join(batches, "pos").drop("pos", "_tokens")

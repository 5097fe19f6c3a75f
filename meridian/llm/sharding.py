"""Uniform shuffle into shards of exact size by a hypergeometric communication matrix.

1. Local permutation: the rows of each source partition get a random order.
2. Matrix: for each source partition the numbers of rows that go to each shard are drawn from the
   multivariate hypergeometric law of a uniform shuffle with the shards' exact sizes (n // shards,
   one more for the first n % shards). Only partition sizes reach the driver.
3. Exchange: the first m(p, 0) rows of partition p go to shard 0, the next m(p, 1) to shard 1, ...
4. Permutation again: inside a shard rows get slots by a second random key. A shard is cut into
   key ranges of bounded size that are numbered one after the other, so no task sorts a whole shard.

Only DataFrame operations touch rows. The facts that both passes need (size, checksum, source
partition, random keys; no texts) are written to the checkpoint folder once, so all passes see the
same rows and keys, also after a lost executor. Null texts have size 1 and the checksum of an empty
text. Repeated rows and ids are separate rows with keys of their own. Extra columns are ignored.
"""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import materialize

#: Rows of a key range inside a shard, about.
RANGE_ROWS = 20_000


def stirling_rest(n: int) -> float:
    """log n! less Stirling's formula for it."""
    if n < 16:
        return math.lgamma(n + 1) - ((n + 0.5) * math.log(n) - n + 0.5 * math.log(2 * math.pi)) if n else 0.0
    return (1 / 12 - (1 / 360 - (1 / 1260 - 1 / 1680 / n**2) / n**2) / n**2) / n


def deviance(x: int, mean: float) -> float:
    """x log(x / mean) + mean - x without loss of digits where x is close to the mean."""
    d = (x - mean) / (x + mean)
    if abs(d) > 0.1:
        return x * math.log(x / mean) + mean - x
    total, power, k = (x - mean) * d, 2 * x * d, 1
    while True:
        power *= d * d
        k += 2
        if total + power / k == total:
            return total
        total += power / k


def binomial(x: int, n: int, p: float) -> float:
    """Probability of x of n at p, in saddle-point form: logarithms of huge factorials never cancel."""
    if x in (0, n):
        return math.exp(n * (math.log1p(-p) if x == 0 else math.log(p)))
    exponent = stirling_rest(n) - stirling_rest(x) - stirling_rest(n - x) - deviance(x, n * p) - deviance(n - x, n * (1 - p))
    return math.exp(exponent) * math.sqrt(n / (2 * math.pi * x * (n - x)))


def hypergeometric(rng: random.Random, good: int, bad: int, n: int) -> int:
    """How many of n draws without replacement from good + bad are good, to the precision of a double, any size.

    Inversion outwards from the mode: the expected number of steps is the standard deviation.
    """
    total = good + bad
    low, high = max(0, n - bad), min(n, good)
    if low == high:
        return low
    mode = min(high, max(low, (n + 1) * (good + 1) // (total + 2)))
    p = n / total
    peak = binomial(mode, good, p) * binomial(n - mode, bad, p) / binomial(n, total, p)
    u = rng.random() - peak
    if u < 0:
        return mode
    down, up, p_down, p_up = mode, mode, peak, peak
    while down > low or up < high:
        if up < high:
            p_up *= (good - up) * (n - up) / ((up + 1) * (bad - n + up + 1))
            up += 1
            u -= p_up
            if u < 0:
                return up
        if down > low:
            p_down *= down * (bad - n + down) / ((good - down + 1) * (n - down + 1))
            down -= 1
            u -= p_down
            if u < 0:
                return down
    return mode


def communication_matrix(rows: dict[int, int], shards: int, seed: int) -> dict[int, list[int]]:
    """Rows that each source partition sends to each shard; columns sum to the shards' exact sizes."""
    n = sum(rows.values())
    free = [n // shards + (s < n % shards) for s in range(shards)]
    rng, out = random.Random(seed), {}
    for part in sorted(rows):
        left, room, sent = rows[part], sum(free), []
        for s in range(shards):
            x = hypergeometric(rng, free[s], room - free[s], left)
            room -= free[s]
            sent.append(x)
            left -= x
        free = [a - b for a, b in zip(free, sent)]
        out[part] = sent
    return out


def shard_uniform(docs: DataFrame, shards: int = 8, seed: int = 20240117, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, size, text_crc32, law, shard, slot, grown_shard); see the module's text."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit(""))
    facts = docs.select(
        id_col,
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.spark_partition_id().alias("part"),
        F.monotonically_increasing_id().alias("row"),
    )
    facts = facts.withColumns({f"key_{k}": F.xxhash64(F.lit(seed + k), "row", "text_crc32") for k in (1, 2)})
    facts = materialize(facts, "facts")
    sizes = {r["part"]: r["count"] for r in facts.groupBy("part").count().collect()}  # one number per source partition
    n = sum(sizes.values())
    matrix = communication_matrix(sizes, shards, seed)
    ends = [(p, [sum(row[: s + 1]) for s in range(shards)]) for p, row in matrix.items()]
    ends = spark.createDataFrame(ends, "part int, ends array<long>")
    ranges = max(1, math.ceil(n / shards / RANGE_ROWS))

    local = Window.partitionBy("part").orderBy("key_1", "row")
    sent = facts.withColumn("rank", F.row_number().over(local)).join(ends, "part")
    sent = sent.withColumn("shard", F.size(F.filter("ends", lambda e: e < F.col("rank"))))
    sent = sent.withColumn("range", F.pmod(F.shiftright("key_2", 20), F.lit(ranges)).cast("int"))
    placed = sent.select(id_col, "size", "text_crc32", "shard", "range", "key_2", "row")
    in_range = placed.groupBy("shard", "range").count()
    before = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    first = in_range.select("shard", "range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first"))
    again = Window.partitionBy("shard", "range").orderBy("key_2", "row")
    return (
        placed.withColumn("nth", F.row_number().over(again))
        .join(first, ["shard", "range"])
        .select(id_col, "size", "text_crc32", F.lit("rows").alias("law"), "shard", (F.col("first") + F.col("nth") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
    )


"""Exact vector retrieval."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Vector elements of a block of queries or a part of the index (8 bytes each), and queries multiplied at a time.
BLOCK_NUMBERS, SLICE = 2_000_000, 128


def unit(v: str | Column) -> Column:
    """A vector as doubles of length 1; the zero vector stays."""
    x = F.transform(v, lambda e: e.cast("double"))
    norm = F.sqrt(F.aggregate(x, F.lit(0.0), lambda a, e: a + e * e))
    return F.transform(x, lambda e: F.coalesce(F.try_divide(e, norm), F.lit(0.0)))


def best_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Per row of scores the columns of its k best (equal scores: the smaller id), as row and column numbers."""
    least = np.partition(scores, -k, axis=1)[:, -k] if scores.shape[1] > k else np.full(len(scores), -np.inf)
    row, col = np.nonzero(scores >= least[:, None])
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    place = np.arange(len(row)) - np.searchsorted(row, row)
    return row[place < k], col[place < k]


def top_k(index: DataFrame, queries: DataFrame, k: int, within: tuple[str, ...] = ()) -> DataFrame:
    """The k nearest rows of `index` (chunk_id, unit, ...) for each query (query_id, q), per `within` if given.

    Queries are dealt to blocks and rows to parts, both of bounded size. Each pair of them is a group of its
    own: a matrix product in slices, of which a query's best k a group of `within` go on to the final ranking. The plan
    is the same for any number of queries. Vectors that are null or of another length than the queries' have no score.
    """
    sizes = lambda df, c: df.agg(F.coalesce(F.sum(F.size(c).cast("long")), F.lit(0)), F.coalesce(F.max(F.size(c)), F.lit(0))).first()
    (asked, dims), (held, _) = sizes(queries.where("q IS NOT NULL"), "q"), sizes(index.where("unit IS NOT NULL"), "unit")
    blocks, parts = max(1, math.ceil(asked / BLOCK_NUMBERS)), max(1, math.ceil(held / BLOCK_NUMBERS))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    kept = [c for c in index.columns if c not in ("unit", "embedding")]
    rows = index.where(F.size("unit") == dims).select(*kept, "unit", dealt("chunk_id", parts).alias("_part")).withColumn("_block", each(blocks))
    some = queries.where(F.size("q") == dims).select("query_id", "q", dealt("query_id", blocks).alias("_block")).withColumn("_part", each(parts))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        matrix = lambda t, c: t.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(t), -1)
        out, names = [], [*kept, "query_id", "score"]
        if len(left) and len(right):
            ids, groups = left.column("chunk_id").to_numpy(), np.zeros(len(left), np.int64)
            for c in within:
                groups = np.unique(np.stack([groups, left.column(c).combine_chunks().dictionary_encode("encode").indices.to_numpy()]), axis=1, return_inverse=True)[1].ravel()
            v, q = matrix(left, "unit"), matrix(right, "q")
            members = [np.flatnonzero(groups == g) for g in range(groups.max() + 1)]
            for at in range(0, len(q), SLICE):
                scores = np.floor(q[at : at + SLICE] @ v.T * 1e6 + 0.5) / 1e6
                for mine in members:
                    row, col = best_rows(scores[:, mine], ids[mine], k)
                    found = left.select(kept).take(pa.array(mine[col]))
                    found = found.append_column("query_id", right.column("query_id").take(pa.array(row + at)))
                    out.append(found.append_column("score", pa.array(scores[row, mine[col]])))
        none = pa.table({**{c: left.column(c).slice(0, 0) for c in kept}, "query_id": right.column("query_id").slice(0, 0), "score": pa.array([], pa.float64())})
        return pa.concat_tables([none, *out]).select(names)

    form = StructType([*(index.schema[c] for c in kept), queries.schema["query_id"], StructField("score", DoubleType())])
    near = rows.groupBy("_block", "_part").cogroup(some.groupBy("_block", "_part")).applyInArrow(best, form)
    order = Window.partitionBy("query_id", *within).orderBy(F.desc("score"), "chunk_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

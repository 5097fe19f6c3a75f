"""Top k against brute force over several blocks and parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meridian.operators import retrieval


def expected(rows, k, within):
    out = set()
    unit = {i: np.array(v) / (np.linalg.norm(v) or 1) for i, _, v in rows if v is not None and len(v) == 4}
    for q in unit:
        if q % 5:
            continue
        groups = {}
        for i, t, _ in rows:
            if i in unit:
                groups.setdefault(t if within else None, []).append((-np.floor(unit[q] @ unit[i] * 1e6 + 0.5) / 1e6, i))
        for some in groups.values():
            out |= {(q, i, n) for n, (_, i) in enumerate(sorted(some)[:k], 1)}
    return out


@pytest.mark.parametrize("numbers, within, k", [(40, ("ticker",), 2), (40, (), 3), (2_000_000, ("ticker",), 50), (12, (), 1)])
def test_top_k(spark, monkeypatch, numbers, within, k):
    monkeypatch.setattr(retrieval, "BLOCK_NUMBERS", numbers)
    rng = np.random.default_rng(k)
    rows = [(i, f"t{i % 3}" if i % 7 else None, rng.integers(-2, 3, 4).astype(float).tolist()) for i in range(60)]  # many ties
    rows += [(100, "t1", None), (101, "t1", [0.0] * 4), (102, "t1", [1.0, 2.0]), (105, "t1", None)]
    index = spark.createDataFrame(rows, "chunk_id bigint, ticker string, embedding array<double>").withColumn("unit", retrieval.unit("embedding"))
    queries = index.where("chunk_id % 5 = 0").select(F.col("chunk_id").alias("query_id"), F.col("unit").alias("q"))
    got = retrieval.top_k(index, queries, k, within)
    assert {(r.query_id, r.chunk_id, r.rank) for r in got.collect()} == expected(rows, k, within)
    assert retrieval.top_k(index, queries.limit(0), k, within).count() == 0 and retrieval.top_k(index.limit(0), queries, k, within).count() == 0

"""Sequential batches against a plain loop, across blocks of few rows."""

import random

import pytest

from meridian.operators import batching


def by_loop(rows, most_items, most_tokens):
    out, batch, n, total = [], -1, 0, 0
    for key, tokens in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, max(0, r[1] or 0))):
        tokens = max(0, tokens or 0)
        if batch < 0 or n >= most_items or total + tokens > most_tokens:
            batch, n, total = batch + 1, 0, 0
        n, total = n + 1, total + tokens
        out.append((key, batch))
    return sorted(out, key=str)


@pytest.mark.parametrize("block, fan, n", [(4, 2, 0), (4, 2, 1), (4, 2, 3), (4, 2, 101), (7, 3, 200), (1 << 14, 256, 150)])
def test_batches_do_not_depend_on_blocks(spark, monkeypatch, block, fan, n):
    monkeypatch.setattr(batching, "BLOCK", block)
    monkeypatch.setattr(batching, "FAN", fan)
    rng = random.Random(n)
    rows = [(k * 3, rng.choice([0, 1, 2, 5, 9, 40, None, -2])) for k in range(n)]
    rng.shuffle(rows)
    got = batching.sequential_batches(spark.createDataFrame(rows, "id bigint, tokens int"), "id", 4, 12)
    assert sorted(((r.id, r.batch) for r in got.collect()), key=str) == by_loop(rows, 4, 12)


def test_repeated_and_null_keys(spark, monkeypatch):
    monkeypatch.setattr(batching, "BLOCK", 5)
    rows = [(None, 3), (None, 1), (7, 4), (7, 4), (7, 2), (9, 13), (8, 1)] * 3
    got = batching.sequential_batches(spark.createDataFrame(rows, "id bigint, tokens int"), "id", 5, 12)
    assert sorted(((r.id, r.batch) for r in got.collect()), key=str) == by_loop(rows, 5, 12)

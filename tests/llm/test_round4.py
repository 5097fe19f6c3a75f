"""Blocks of the Jaccard join's second round, and the bit table of decontamination."""

from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from meridian.llm import decontamination as dc, jaccard_join as jj  # noqa: E402

MEMBERS = "head bigint, list bigint, weight bigint, fp bigint, size bigint, below boolean, count bigint, spare bigint, root bigint"


def test_sets_ask_only_where_their_lists_have_members(spark, monkeypatch):
    """One head with many short lists: a set's memberships meet those of the sets it shares lists with, not every slice."""
    monkeypatch.setattr(jj, "BLOCK_ROWS", 10)
    rows = [(1 + (fp % 4 == 0), 1000 + k, 1, fp, 50, False, 9, 0, fp) for k in range(200) for fp in (2 * k, 2 * k + 1)]  # pairs of sets
    rows += [(1 + (fp % 4 == 0), 5000 + k, 1, fp, 50, fp % 7 == 0, 9, 0, fp) for k in range(3) for fp in range(0, 60, 2)]  # long lists
    blocks = jj.blocks_of(spark.createDataFrame(rows, MEMBERS)).collect()
    asks, told = [r for r in blocks if r["asks"]], [r for r in blocks if not r["asks"]]
    length = Counter(x[1] for x in rows)
    assert len(asks) <= sum(length[x[1]] for x in rows if not x[5])
    assert max(Counter((r["part"], r["slice"], r["fp"], r["list"]) for r in blocks).values()) <= 2
    homes = defaultdict(set)
    for r in asks:
        homes[r["list"], r["part"], r["slice"]].add(r["fp"])
    met, shared = Counter(), Counter()
    for r in told:
        for u in homes[r["list"], r["part"], r["slice"]]:
            met[u, r["fp"], r["part"], r["slice"]] += 1
    for _, of, _, u, _, below, *_ in rows:
        if not below:
            shared.update((u, x[3]) for x in rows if x[1] == of)
    assert len({(u, v) for u, v, *_ in met}) == len(met)  # in one block
    assert {(u, v): n for (u, v, *_), n in met.items()} == dict(shared)  # with all that they share


def test_bits_of_the_table_are_looked_up_packed():
    rng = np.random.default_rng(3)
    h = rng.integers(0, 1 << 64, 5000, np.uint64)
    bits = np.zeros(1 << dc.TABLE_BITS, bool)
    bits[(h[:100] >> np.uint64(64 - dc.TABLE_BITS)).astype(np.int64)] = True
    packed = np.packbits(bits, bitorder="little")
    assert (dc.in_table(packed, h) == bits[(h >> np.uint64(64 - dc.TABLE_BITS)).astype(np.int64)]).all()


def test_models_learn_from_all_texts(spark):
    """Every position of every text and every word's count, however large the corpus is beside the steps."""
    import public_tokenizers as tok
    from pyspark.sql import functions as F

    from meridian.llm import attention, lm_scoring as lm

    path = tok.path("byte_bpe_multi_50k.tiktoken")
    encoder, end = lm.vocabulary(path, tok.PATTERN)
    long = " ".join(f"w{k % 97} the" for k in range(6000))
    docs = [(k, f"the word {k} again") for k in range(300)] + [(1000, long), (1001, None), (1002, "x" * 3000)]
    texts = spark.createDataFrame(docs, "id int, text string").select("text", F.lit(True).alias("learn"))
    rows = lm.training_lines(texts, path, tok.PATTERN, 3).collect()
    got, _ = lm.line_windows([bytes(r["line"]) for r in rows], [])
    want = [attention.windows(np.array([end, *(lm.pieces_of(w, encoder)[0] for w in lm.ascii_words(t, lower=True)), end], np.uint16), lm.BETWEEN) for _, t in docs]
    assert sorted(map(bytes, got)) == sorted(map(bytes, np.concatenate(want)))
    counts = lm.word_counts(texts)
    inner = lm.training_words(counts, path, tok.PATTERN, 3, 50).collect()
    z, weight = lm.inner_windows([bytes(r["line"]) for r in inner], [bytes(r["weight"]) for r in inner])
    have, need = Counter(), Counter()
    for a, w in zip(z, weight.tolist()):
        have[bytes(a)] += w
    for word, c in Counter(w for _, t in docs for w in lm.ascii_words(t, lower=True)).items():
        need.update({bytes(a): c for a in lm.word_windows([lm.pieces_of(word, encoder)], end)[0]} if word[:1] != b"x" else {})
        if word[:1] == b"x":
            need.update(bytes(a) for a in lm.word_windows([lm.pieces_of(word, encoder)], end)[0])
    assert weight.max() <= 50 and set(have) == set(need) and all(abs(have[k] - need[k]) < 1e-2 * need[k] for k in need)


def test_weights_stand_for_repeated_windows():
    from meridian.llm import attention

    rng = np.random.default_rng(0)
    made = attention.Lm(4, rng.integers(1, 60, 90), rng.integers(1, 9, 90), 70)
    flat = made.start(0) + rng.normal(0, 0.2, made.size).astype(np.float32)
    z = attention.windows(rng.integers(0, 90, 32), 4)
    times = np.arange(1, len(z) + 1)
    one, many = made.gradient(flat, *made.inputs(z), times.astype(np.float32)), made.gradient(flat, *made.inputs(np.repeat(z, times, axis=0)))
    assert abs(one[0] - many[0]) < 1e-4 and np.allclose(one[1], many[1], atol=1e-5)


def test_without_weak_sets_the_driver_makes_no_rows(spark):
    """Rows handed over by the driver start Python workers of another kind on every executor."""
    facts = spark.range(2).selectExpr("id AS fp", "0 AS weak")
    pairs = jj.weak_pairs(facts, spark.createDataFrame([(1, "a b")], "doc_id bigint, text string"), 5, None)
    assert pairs.collect() == [] and pairs.columns == ["u", "v"]
    assert "ExistingRDD" not in pairs._jdf.queryExecution().executedPlan().toString()

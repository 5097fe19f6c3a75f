"""Clustering, language-model scores and the filter audit against brute force, with edge cases."""

import hashlib
import math
import random
from collections import Counter
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

tok = pytest.importorskip("public_tokenizers")

from meridian.llm import attention, centroid_clusters as cc, filter_audit as fa, lm_scoring as lm  # noqa: E402

# 11

VECTORS = "vec_id bigint, embedding array<float>, n int, cluster string"


def vectors():
    rng = np.random.default_rng(5)
    rows = [(k, rng.normal(0, 0.3, 64).astype(np.float32).tolist(), 1, "x") for k in range(150)]
    rows += [(1000 + k, rows[3][1], 1, "x") for k in range(60)]  # copies
    rows += [(None, rows[4][1], 1, "x"), (7, rows[8][1], 1, "x"), (7, rows[7][1], 1, "x")]  # null, repeated ids
    bad = [None, [], [0.1] * 63, [0.1] * 65, [None] + [0.1] * 63, [float("nan")] + [0.1] * 63, [float("inf")] + [0.1] * 63]
    return rows + [(2000 + k, v, 1, "x") for k, v in enumerate(bad)]


def clusters_by_loop(rows, k=16, rounds=3):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v, *_ in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted((hashlib.sha256(f"1:{i}".encode()).hexdigest(), q) for i, q in kept if i is not None)[:k]
    centroids = [q for _, q in start]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), n) for n, c in enumerate(centroids))
    for _ in range(rounds):
        members = {}
        for _, q in kept:
            members.setdefault(near(q)[1], []).append(q)
        for n, some in members.items():
            centroids[n] = [sum(c) // len(some) for c in zip(*some)]
    found = [(i, *near(q)[::-1]) for i, q in kept]
    inertia = Counter()
    for _, n, d in found:
        inertia[n] += d
    return [(i, n, d, inertia[n], sum(inertia.values()), hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()) for i, n, d in found]


@pytest.mark.parametrize("part, width", [(1 << 15, 2), (20, 2), (50, 7), (1 << 15, 64)])
def test_clusters_by_brute_force(spark, monkeypatch, part, width):
    monkeypatch.setattr(cc, "PART", part)
    rows = vectors()
    got = cc.centroid_clusters(spark.createDataFrame(rows, VECTORS).repartition(3), width=width)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(clusters_by_loop(rows), key=str)


def test_few_none_and_huge_vectors(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    assert cc.centroid_clusters(frame([])).count() == 0 and cc.centroid_clusters(frame([(1, None), (2, [0.5])])).count() == 0
    assert {(r.cluster, r.distance) for r in cc.centroid_clusters(frame([(k, [k / 2.0] * 64) for k in range(3)])).collect()} == {(0, 0), (1, 0), (2, 0)}
    got = cc.centroid_clusters(frame([(k, [(-1) ** k * 1e300] * 64) for k in range(20)]), k=1).collect()
    assert len(got) == 20 and all(0 < r.distance < 1 << 63 for r in got) and got[0].inertia is None  # beyond 64 bits


def test_dictionaries_lose_nothing():
    rng = np.random.default_rng(1)
    for q in (rng.integers(-3, 4, (500, 10)), rng.integers(-(1 << 27), 1 << 27, (300, 10)), np.zeros((1, 10), np.int64)):
        for width in (1, 3, 10):
            blocks = cc.unpacked(len(q), 10, width, *cc.packed(cc.encode(q, width)))
            assert (np.concatenate([d[c] for d, c in blocks], axis=1) == q).all()
            c = rng.integers(-5, 6, (4, 10))
            near, distance = cc.assign(blocks, c, len(q))
            every = ((q[:, None].astype(object) - c[None]) ** 2).sum(axis=2)
            assert (distance == every.min(axis=1)).all() and (near == [list(r).index(min(r)) for r in every]).all()
            assert (cc.cluster_sums(blocks, near, 4) == [q[near == k].sum(axis=0) for k in range(4)]).all()


# 12


def corpus():
    rng = random.Random(6)
    words = ["the", "of", "tion", "ment", "pre", "con", "ly", "é", "ßa"]
    make = lambda n: " ".join("".join(rng.choices(words, k=rng.randint(1, 3))) for _ in range(n))
    rows = [(k, make(rng.choice([1, 7, 8, 9, 60, 400]))) for k in range(80)] + [(k, None) for k in (90, 91)] + [(92, ""), (93, " \n\t"), (94, "THE the The"), (95, "x" * 5000), (96, "\x00 � 字"), (None, "the of"), (1, "the of again")]
    return rows + [(100 + k, rows[5][1]) for k in range(30)]


def scored(spark, rows, **more):
    docs = spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id bigint, text string, word string, n int").repartition(3)
    return lm.lm_scores(docs, F.col("doc_id") % 5 != 1, tok.path("byte_bpe_multi_50k.tiktoken"), tok.PATTERN, **{"steps": (10, 10), **more}).collect()


@pytest.mark.parametrize("head", [200_000, 8, 0])
def test_base_scores_by_brute_force(spark, head):
    rows = corpus()
    words = lambda t: [*lm.ascii_words(t, lower=True), None]
    c = Counter(w for i, t in rows if i is not None and i % 5 != 1 for w in words(t))
    n, v = sum(c.values()), len(c)
    want = sorted(((i, len(words(t)), sum(c[w] > 0 for w in words(t)), n) for i, t in rows), key=str)
    got = scored(spark, rows, head_words=head)
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens) for r in got), key=str) == want
    by_text = Counter(round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words(t)), 6) for _, t in rows)
    assert Counter(round(r.base_score, 6) for r in got) == by_text
    assert all(r.score < 0 for r in got)


def test_nothing_to_learn_from_and_empty_tables(spark):
    got = scored(spark, [(1, "a b"), (6, None)])
    assert {(r.doc_id, r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got} == {(1, 3, 0, 0, 0.0), (6, 1, 0, 0, 0.0)} and all(r.score < 0 for r in got)
    assert scored(spark, []) == []


def model(block=4, seed=0, symbols=90, most=70):
    rng = np.random.default_rng(seed)
    counts = np.where(rng.random(symbols) < 0.2, 0, rng.integers(1, 60, symbols))
    made = attention.Lm(block, counts, rng.integers(0, 9, symbols), most)
    return made, made.start(seed) + rng.normal(0, 0.2, made.size).astype(np.float32)


def test_each_position_is_scored_once_in_its_window():
    made, flat = model()
    w = made.views(flat)
    rng = np.random.default_rng(3)
    for n in (2, 3, 5, 9, 30):
        line = rng.integers(0, 90, n)
        z = attention.windows(line, 4)
        x, y = made.inputs(z)
        assert y[y >= 0].tolist() == made.target[line[1:]].tolist()
        batched = made.log_probs(w, made.tables(w), x, y)
        alone = np.concatenate([made.log_probs(w, made.tables(w), a[None], b[None]) for a, b in zip(x, y)])
        assert np.allclose(batched, alone, atol=1e-5) and (batched[y < 0] == 0).all()


def test_probabilities_add_up_and_see_no_later_symbol():
    made, flat = model(seed=2)
    w = made.views(flat)
    z = attention.windows(np.random.default_rng(1).integers(0, 90, 12), 4)[1:2]
    every = np.repeat(z, 90, axis=0)
    for place in range(4):
        now = every.copy()
        now[:, 5 + place] = np.arange(90)  # the symbol that is predicted there
        x, y = made.inputs(now)
        p = np.exp(made.log_probs(w, made.tables(w), x, y).astype(float))
        assert p[:, place].sum() == pytest.approx(1, abs=1e-4)
        assert np.allclose(p[:, :place], p[0, :place], rtol=1e-4)  # what stands before does not change


def test_gradient_by_differences():
    made, flat = model(seed=4)
    x, y = made.inputs(attention.windows(np.random.default_rng(2).integers(0, 90, 23), 4))
    _, slope = made.gradient(flat, x, y)
    for name, g in made.views(slope).items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        ends = []
        for step in (1e-4, -1e-4):
            moved = flat.astype(np.float64)
            made.views(moved)[name][at] += step
            ends.append(made.gradient(moved, x, y)[0])
        assert g[at] == pytest.approx((ends[0] - ends[1]) / 2e-4, rel=2e-2, abs=1e-5), name


def test_training_beats_the_base_on_held_out_texts(spark):
    """Texts of words (each with a first piece of its own) in a fixed order: the model finds it, word counts cannot."""
    rng = random.Random(1)
    order = "apple river stone cloud seven green paper house light water north music".split()
    rows = [(k, " ".join(order[(s + j) % 12] for j in range(60))) for k, s in ((k, rng.randrange(12)) for k in range(400))]
    got = [r for r in scored(spark, rows, steps=(150, 100), rounds=2) if r.doc_id % 5 == 1]
    assert sum(r.score for r in got) > 0.5 * sum(r.base_score for r in got)  # less than half of the surprise


def test_parts_are_averaged(spark):
    rows = corpus() * 3
    one, many = scored(spark, rows, part_bytes=10**9), scored(spark, rows, part_bytes=3000)
    assert len(one) == len(many) == len(rows) and [r.score for r in one] != [r.score for r in many]
    assert scored(spark, rows, part_bytes=3000, rounds=1) and all(math.isfinite(r.score) for r in many)


# 13


def audited(docs, labels):
    """Rows of the audit by definition, one order after the other."""
    labels = [x for x in labels if x[0] is not None]
    good = {i for i, q, _ in labels if q == 1}
    toxic = {i for i, _, t in labels if t == 1}
    fails = []
    for i, t, source in docs:
        t = t or ""
        w = lm.ascii_words(t)
        copies = [j for j, u, _ in docs if (u or "") == t and (j is not None and (i is None or j < i))]
        bad = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in t for c in "#$%&*|"), "E": bool(copies)}
        fails.append((source or "", i, {k for k, x in bad.items() if x}))
    out, orders = {}, ["".join(p) for p in permutations("ABCDE")]
    for part in {f[0] for f in fails}:
        mine, shapley, rows = [f for f in fails if f[0] == part], Counter(), []
        for order in orders:
            left = mine
            for step, name in enumerate(order, 1):
                gone = [f for f in left if name in f[2]]
                left = [f for f in left if name not in f[2]]
                shapley[name] += len(gone)
                redundant = sum(name in f[2] for f in mine) - len(gone)
                rows.append((part, order, step, len(left), len(gone), redundant, sum(f[2] == {name} for f in mine), sum(f[1] in good for f in gone), sum(f[1] in toxic for f in gone)))
        out[part] = [(*r, shapley[r[1][r[2] - 1]]) for r in rows]
    return sorted(x for rows in out.values() for x in rows)


def test_audit_by_brute_force(spark):
    rng = random.Random(9)
    pool = ["a b", "x " * 60, " ".join(f"w{k}" for k in range(60)), "CAPITALS " + " ".join(f"v{k}" for k in range(55)), "50 % of it", "", None, " \t\n", "é " * 49 + "é", "é " * 50, "Σ|" * 30, " ".join(f"u{k}" for k in range(4000))]
    docs = [(k, rng.choice(pool) if rng.random() < 0.7 else f"{rng.choice(pool)} {k}", rng.choice(["s1", "s2", None, ""])) for k in range(120)]
    docs += [(None, "a b", "s1"), (None, "a b", "s1"), (None, "only null ids", "s1"), (3, docs[3][1], docs[3][2]), (5, "two texts of an id", "s2")]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for k in range(100)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame([(*d, 7, "m") for d in docs], "doc_id bigint, text string, source string, n int, mask string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    assert sorted(map(tuple, fa.filter_audit(frame, marks).collect())) == audited(docs, labels)
    assert fa.filter_audit(frame.limit(0), marks).count() == 0
    assert fa.filter_audit(frame, marks.limit(0)).agg(F.sum("good_lost") + F.sum("toxic_lost")).first()[0] == 0


def test_all_orders_by_adjacent_swaps():
    for n in range(1, 6):
        order = list("ABCDE"[:n])
        seen = ["".join(order)]
        for k in fa.adjacent_swaps(n):
            order[k], order[k + 1] = order[k + 1], order[k]
            seen.append("".join(order))
        assert len(set(seen)) == len(seen) == math.factorial(n)


def test_diagrams_share_and_keep_counts():
    rng = random.Random(2)
    counts = {m: (rng.randint(0, 5), rng.randint(0, 2), 0) for m in range(32)}
    d = fa.Diagram(counts, "ABCDE")
    for k in fa.adjacent_swaps(5):
        d.swap(k)
        left = counts
        for name, gone, kept in d.steps():
            bit = 1 << "ABCDE".index(name)
            assert gone == tuple(sum(c[i] for m, c in left.items() if m & bit) for i in range(3))
            left = {m: c for m, c in left.items() if not m & bit}
            assert kept == sum(c[0] for c in left.values())
    assert len(fa.Diagram({}, "ABCDE").kids) == 6  # one node a level


def test_facts_of_any_kind(spark):
    facts = spark.createDataFrame([("p", 1, 2, 1, 0), ("p", 1, 3, None, 0), (None, 0, 4, 0, 0), ("", None, 1, 0, 0)], "part string, mask int, n bigint, good bigint, toxic bigint")
    got = {(r.part, r.filter_order, r.step): r for r in fa.audit_orders(facts, "AB").collect()}
    assert len(got) == 8 and got["p", "AB", 1].removed == 5 and got["p", "AB", 1].good_lost == 1 and got["", "BA", 2].kept == 5 and got["p", "BA", 2].shapley == 10


# 2 and 3


def test_likelihood_ratios_by_brute_force(spark):
    """Counts of byte 4-grams by plain loops; every text's mean log ratio and verdict."""
    from meridian.llm.quality_rules import quality_rules

    rng = random.Random(3)
    make = lambda letters, n: " ".join("".join(rng.choices(letters, k=4)) for _ in range(n))
    rows = [(k, make("abcdé", 40) if k % 3 else make("wxyzß", 40)) for k in range(60)] + [(90, None), (91, ""), (92, "abc"), (93, make("abcdé", 3000)), (5, rows5 := make("abcdé", 25)), (6, rows5)]
    trusted = [(k,) for k in range(60) if k % 3] + [(5,), (93,), (None,), (777,)]
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id bigint, text string, bucket string, raw int").repartition(3)
    got = quality_rules(docs, spark.createDataFrame(trusted, "doc_id bigint")).collect()

    def grams(text):
        raw = b"\n" + text.encode() + b"\n" if text else b""
        return [(int.from_bytes(raw[k : k + 4], "little") * 0x9E3779B97F4A7C15 % (1 << 64)) >> 49 for k in range(len(raw) - 3)]

    good, size = {i for (i,) in trusted}, 1 << 15
    every, target = Counter(g for _, t in rows for g in grams(t)), Counter(g for i, t in rows if i in good for g in grams(t))
    log = lambda c, g: math.log((c[g] + 1) / (sum(c.values()) + size))
    ratio = {g: log(target, g) - log(every, g) for g in every}
    want = sorted((i, round(sum(map(ratio.get, g)) / len(g) if (g := grams(t)) else 0.0, 9)) for i, t in rows)
    assert sorted((r.doc_id, round(r.llr, 9)) for r in got) == want
    assert all(r.kept == (not r.base_failed and r.llr >= -0.2) for r in got) and 0 < sum(r.kept for r in got) < len(got)


def test_toxicity_in_four_languages(spark):
    """Toxic words have a stem of their own and any ending; ordinary words are made of the same syllables."""
    from meridian.llm.toxicity import score_toxicity

    rng = random.Random(4)
    tongues = {"en": ("th er ing an or st", "idiot"), "fr": ("é eau ment è qui ré", "réeuxê"), "de": ("sch keit ü ver ß ung", "achßlich"), "es": ("ción ñ mente ó que as", "ñbomente")}
    rows, toxic = [], {}
    for k in range(1600):
        syllables, stem = tongues[("en", "fr", "de", "es")[k % 4 if k % 8 < 5 else 0]]
        word = lambda n: "".join(rng.choices(syllables.split(), k=n))  # noqa: E731, B023
        text = [word(rng.randint(1, 4)) for _ in range(rng.randint(20, 80))]
        toxic[k] = int(rng.random() < 0.15)
        for _ in range(3 * toxic[k]):
            text.insert(rng.randrange(len(text)), stem + rng.choice(["", *syllables.split()]))
        rows.append((k, " ".join(text).upper() if k % 11 == 0 else " ".join(text), tongues_of(stem)))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    labels = spark.createDataFrame([(k, t) for k, t in toxic.items() if k % 3 != 1 and k // 8 % 2 == 0], "doc_id bigint, toxic int")
    got = {r.doc_id: r.predicted for r in score_toxicity(docs, labels).collect()}
    held = [(lang, toxic[k], got[k]) for k, _, lang in rows if k % 3 == 1]
    for lang in tongues:
        found = [p for x, t, p in held if x == lang and t]
        assert sum(found) >= 0.9 * len(found) > 0
    assert sum(p for _, t, p in held if not t) <= 0.02 * sum(not t for _, t, _ in held)


def tongues_of(stem):
    return {"idiot": "en", "réeuxê": "fr", "achßlich": "de", "ñbomente": "es"}[stem]

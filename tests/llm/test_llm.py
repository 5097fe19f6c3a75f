"""Brute-force counterparts and edge cases: nulls, empty and long texts, ties, repeated rows, empty tables, extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

tok = pytest.importorskip("public_tokenizers")

from meridian.llm import common, decontamination  # noqa: E402
from meridian.llm import jaccard_join as jj  # noqa: E402
from meridian.llm import substring_dedup as sd  # noqa: E402
from meridian.llm.components import components  # noqa: E402
from meridian.llm.decontamination import contaminated  # noqa: E402
from meridian.llm.html_text import main_text, read_page, train  # noqa: E402
from meridian.llm.packing import TokenIds, best_fit_decreasing, pack  # noqa: E402
from meridian.llm.quality_rules import base_counts, quality_rules  # noqa: E402
from meridian.llm.common import WordHashes  # noqa: E402
from meridian.llm.sharding import communication_matrix, hypergeometric, shard_uniform  # noqa: E402
from meridian.llm.substring_dedup import remove_repeats  # noqa: E402
from meridian.llm.token_counts import PieceCounter, token_counts  # noqa: E402
from meridian.llm.toxicity import choose_features, sample_texts, score_toxicity  # noqa: E402
from meridian.llm.url_filters import judge_urls  # noqa: E402

#: Extra columns have names that the operators use inside.
DOCS = "doc_id bigint, text string, fp string, block int, list string, hash string, n int"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def prose(rng, n):
    return " ".join("".join(rng.choices(["ka", "lo", "mi", "ne", "ru", "ta"], k=rng.randint(1, 4))) for _ in range(n))


def corpus():
    rng = random.Random(3)
    base = [prose(rng, rng.choice([3, 20, 90, 300])) for _ in range(12)]
    passage = prose(rng, 70)
    rows = [(k, t) for k, t in enumerate(base)]
    rows += [(20 + k, t) for k, t in enumerate(base[:4])]
    for k, t in enumerate(base[4:10]):  # near copies
        w = t.split()
        w[len(w) // 2] = "changed"
        rows.append((30 + k, " ".join(w).upper() if k == 0 else " ".join(w)))
    rows += [(40 + k, f"{prose(rng, 30)} {passage}\n{prose(rng, 5)}") for k in range(4)]
    rows += [(50, None), (51, ""), (52, " \n\t"), (53, "one"), (54, "one"), (55, "a b   c"), (56, prose(rng, 9000)), (57, "word " * 3000), (1, base[1])]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "x", 1, "y", "z", 7) for i, t in corpus()], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# 8, 9, 10


def test_token_counts_equal_the_library(spark, docs, none):
    import sentencepiece

    path = tok.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(1)
    odd = ["".join(rng.choice("ab  ▁\n\té😀字ÿ</s><unk>'.! the\xa0　\x00") for _ in range(rng.randint(0, 60))) for _ in range(500)]
    odd += ["a" * n for n in (399, 400, 401, 3000)] + [" " * 1000, "the " * 30 + "  " * 7]
    assert PieceCounter(path).count(odd) == [len(model.encode(x)) for x in odd]
    want = sorted(((i, len((t or "").encode()), n := len(model.encode(t or "")), n > 100) for i, t in corpus()), key=str)
    assert rows_of(token_counts(docs, path, 100)) == want
    assert token_counts(none, path).count() == 0


def test_long_sequences_take_few_rounds():
    import sentencepiece

    path = tok.path("piece_bpe_32k.model")
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(4)
    odd = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 900))) for letters in ("aentrsil", "ab", "theandi ng", "a.-") for _ in range(60)]
    odd += [c * n for c in " a.-\n" for n in (*range(20), 33, 401)] + [c * 10**6 for c in (" ", "a", "字")] + ["".join(rng.choice("aentrsil") for _ in range(50_000))]
    assert PieceCounter(path).count(odd) == [len(model.encode(x)) for x in odd]


@pytest.mark.parametrize("sign", [" ", "\n", "a", "\t"])
def test_ids_of_a_million_equal_characters(sign):
    ids = TokenIds(tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)
    text = f"x{sign * 10**6}y"
    assert ids.encode(text).tolist() == ids.exact.encode(text, add_special_tokens=False).ids


def test_fast_ids_equal_the_library():
    ids = TokenIds(tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN)
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab  \n\t'sé😀字１²ⅷ.!\xa0　 ́ǅ") for _ in range(rng.randint(0, 40))) for _ in range(800)] + ["x <|endoftext|> y", "I'll we've"]
    for t in texts:
        assert ids.encode(t).tolist() == ids.exact.encode(t, add_special_tokens=False).ids, t


def one_by_one(counts, window):
    open_ = []
    for length in sorted(counts, reverse=True):
        for _ in range(counts[length]):
            fits = [k for k, c in enumerate(open_) if c >= length]
            if not fits:
                open_.append(window)
                fits = [len(open_) - 1]
            best = min(fits, key=lambda k: open_[k])
            open_[best] -= length
    return sorted(open_)


def test_runs_equal_one_by_one_best_fit():
    for seed in range(60):
        rng = random.Random(seed)
        window = rng.choice([8, 16, 50])
        counts = {rng.randint(1, window): rng.randint(1, 12) for _ in range(rng.randint(1, 12))}
        used = Counter()
        for length, _, n, each, first, _ in best_fit_decreasing(counts, window).tolist():
            for k in range(n):
                used[first + k] += each * length
        assert sorted(window - x for x in used.values()) == one_by_one(counts, window)


def test_packing_is_an_exact_round_trip(docs, none):
    args = tok.path("byte_bpe_50k.json"), tok.path("byte_bpe_50k.tiktoken"), tok.PATTERN
    got = pack(docs, *args, window=128).toPandas()
    exact = TokenIds(*args)
    for seq, x in got.sort_values("offset").groupby("sequence_id"):
        assert (x.length.cumsum() - x.length == x.offset).all() and x.length.sum() <= 128
    pieces = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in got.itertuples())
    want = Counter()
    for i, t in corpus():
        ids = np.append(exact.encode(t or ""), 1).astype("<u4")
        want.update((i, s, len(ids[s : s + 128]), zlib.crc32(ids[s : s + 128].tobytes())) for s in range(0, len(ids), 128))
    assert pieces == want
    assert pack(none, *args).count() == 0


def test_shards_are_exact(spark, docs, none):
    got = shard_uniform(docs, 8).toPandas()
    assert sorted(Counter(got.shard).values()) == sorted(len(corpus()) // 8 + (s < len(corpus()) % 8) for s in range(8))
    for _, x in got.groupby("shard"):
        assert sorted(x.slot) == list(range(len(x)))
    want = Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in corpus())
    assert Counter(zip(got.doc_id, got["size"], got.text_crc32)) == want
    assert shard_uniform(none).count() == 0


def test_the_matrix_has_exact_margins_and_the_right_mean():
    m = communication_matrix({0: 17, 1: 0, 5: 1_000_003}, 8, 1)
    assert [sum(r) for r in m.values()] == [17, 0, 1_000_003]
    assert sorted(map(sum, zip(*m.values()))) == sorted(1_000_020 // 8 + (s < 1_000_020 % 8) for s in range(8))
    rng = random.Random(0)
    huge = [hypergeometric(rng, 10**11, 7 * 10**11, 10**8) for _ in range(50)]
    assert abs(np.mean(huge) - 12_500_000) < 4 * 3300 / 50**0.5
    draws = [hypergeometric(rng, 30, 70, 20) for _ in range(4000)]
    assert abs(np.mean(draws) - 6) < 0.1 and abs(np.var(draws) - 20 * 0.3 * 0.7 * 80 / 99) < 0.3


# 2, 3


def test_base_counts_by_brute_force():
    for _, t in corpus():
        w = WORD.findall(t or "")
        seen, cover = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7)), set()
        for k in range(len(w) - 7):
            if seen[tuple(w[k : k + 8])] > 1:
                cover |= set(range(k, k + 8))
        lines = [x for x in (t or "").split("\n") if WORD.search(x)]
        assert base_counts(t, WordHashes()) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), len(cover)), t


def test_quality_tells_junk_from_prose(spark, none):
    rng = random.Random(5)
    rows = [(k, prose(rng, 60)) for k in range(60)] + [(100 + k, " ".join(f"{w}%%%" for w in prose(rng, 60).split())) for k in range(20)] + [(200, None), (201, "short")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y", "z", 7) for i, t in rows], DOCS)
    trusted = spark.createDataFrame([(k,) for k in (*range(40), None, 3)], "doc_id bigint")
    got = {r.doc_id: r for r in quality_rules(docs, trusted, buckets=1 << 10).collect()}
    assert all(got[k].kept for k in range(60)) and not any(got[100 + k].kept for k in range(20)) and got[200].base_failed and got[201].base_failed
    assert quality_rules(none, trusted).count() == 0


def test_toxicity_on_held_out_rows(spark, none):
    rng = random.Random(6)
    rows = [(k, prose(rng, 40) + (" vileword " + prose(rng, 5) if k % 4 == 0 else "")) for k in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame([(i, t, "x", 1, "y", "z", 7) for i, t in rows], DOCS)
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(300)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r for r in score_toxicity(docs, labels).collect()}
    assert all(got[k].predicted == int(k % 4 == 0) for k in range(300, 400))
    assert got[900].score == got[901].score < 0.5 and len(got) == 402
    assert score_toxicity(none, labels).count() == 0 and {r.score for r in score_toxicity(docs, labels.where("toxic = 9")).collect()} == {score_toxicity(docs, labels.limit(0)).first().score}


def test_samples_are_bounded_whatever_is_repeated(spark):
    rows = [(7, f"text {k}") for k in range(3000)] + [(None, "null")] * 3000 + [(8, "same")] * 3000
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sample_texts(docs, 100, 100 / len(rows), 1, "doc_id", "text")
    assert len(got) <= 200 and got == sample_texts(docs.repartition(5), 100, 100 / len(rows), 1, "doc_id", "text")
    labels = spark.createDataFrame([(7, 1), (8, 0)], "doc_id bigint, toxic int")
    assert score_toxicity(docs, labels, positives=20, unlabelled=50).count() == 9000


@pytest.mark.parametrize("prior", [0.1, 0.01, 0.001])
def test_rare_toxicity_has_features(prior):
    toxic = [np.array([1 + k % 20, 100], np.uint64) for k in range(400)]  # codes 1 to 20 of toxic text only, 100 of all
    clean = [np.array([50 + k % 9, 100], np.uint64) for k in range(6000)]
    clean[: int(6000 * prior)] = toxic[: int(6000 * prior)]
    assert choose_features(toxic, clean, prior).tolist() == list(range(1, 21))


# 1, 4


def test_url_rules_and_mined_rules(spark):
    rows = [(k, f"http://spam{k % 3}.example.com/win/{k}") for k in range(60)] + [(100 + k, f"https://good{k % 3}.example.net/en/{k}") for k in range(60)]
    rows += [(200, None), (201, "no scheme"), (202, "https://X.ORG/a?b=c#d"), (203, "https://x.org"), (204, "http://a.example.org/es/1"), (205, "http://a.example.org/es/1")]
    pages = spark.createDataFrame([(i, u, "x", 1) for i, u in rows], "page_id bigint, url string, host string, row int")
    labelled = pages.where("page_id < 160").select("url", (F.col("page_id") < 100).alias("bad"))
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/")]
    got = {r.page_id: r for r in judge_urls(pages, labelled, rules, min_count=10).collect()}
    assert got[5].verdict == "block" and got[105].verdict == "allow" and (got[202].host, got[202].path, got[202].rule) == ("x.org", "/a", "org/")
    assert got[203].rule is None and got[204].rule == "example.org/es/" and got[204].verdict == "block" and (got[200].host, got[201].path) == ("", "")
    assert judge_urls(pages.limit(0), labelled.limit(0), rules).count() == 0


def test_hosts_paths_and_fixed_rules_by_brute_force(spark):
    rng = random.Random(8)
    urls = ["".join(rng.choice(["http", "://", "a.", "Example.org", "example.com", "/", "/es/", "/en/1", "?q", "#f", "x", "org", "."]) for _ in range(rng.randint(0, 7))) for _ in range(300)]
    urls += ["https://e.org/" + "y" * 100_000]
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, pages.limit(0).withColumn("bad", F.lit(True)), rules).collect()}
    for k, url in enumerate(urls):
        m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url)
        host, path = (m.group(1).lower(), m.group(2)) if m else ("", "")
        fits = [r for r in rules if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fits, key=lambda r: len(r[1] + r[2]), default=None)
        assert got[k] == (host, path, best and best[1] + best[2], best[0] if best else "allow"), url


PAGE = """<html><head><title>T</title><script>var a='<p>no</p>'</script></head><body><div class="cookie-notice"><p>We use cookies here.</p></div>
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>News</a></li></ul></nav><article><h1>A  headline</h1><p>First &amp; long paragraph of the story, {0}.<p>Second<b>bold</b>
line&nbsp;here, {0}.</p><div class="ad">Buy now</div><p>Last words {0}.</p></article><aside class="sidebar"><h3>Related</h3><ul><li><a href=/c>Other</a></li></ul></aside>
<section class="comments"><div class="comment"><p>Nice one!</p></div><div class="comment"><p>I do not agree.</p></div></section><footer>&copy; 2024 us</footer></body></html>"""


def test_main_text_of_a_page(spark):
    fill = " ".join(["tale"] * 30)
    want = f"A headline First & long paragraph of the story, {fill}. Secondbold line here, {fill}. Last words {fill}."
    rows = [(1, "u", PAGE.format(fill)), (2, "u", None), (3, "u", ""), (4, None, "<p>broken <![x <b"), (1, "u", PAGE.format(fill))]
    got = rows_of(main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), layouts=300))
    assert [r[2] for r in got if r[0] == 1] == [want, want] and all(r[3] == len(r[2]) for r in got) and [r[2] for r in got if r[0] in (2, 3)] == ["", ""]


def test_main_text_of_long_pages_and_empty_tables(spark):
    kinds = "page_id bigint, url string, html string, text string, n_chars int"
    fill = " ".join(["tale"] * 200_000)
    got = main_text(spark.createDataFrame([(1, "u", PAGE.format(fill), "x", 1)], kinds), layouts=300)
    assert got.first().text.count("tale") == 600_000 and main_text(spark.createDataFrame([], kinds), layouts=20).count() == 0


@pytest.mark.parametrize(
    "before",
    [
        "<select><option>A<option>B</select>", "<select><optgroup><option>A<optgroup><option>B</select>", "<datalist><option>A<option>B</datalist>", "<button>A<button>B</button>",
        "<head><title>t</title>", "<head><head><title>t</title></head>", "<head><title>t</title><body>", "<noscript><iframe></noscript>", "<svg><path/></svg><svg/>",
    ],
)
def test_silent_elements_end_without_end_tags(before):
    page = read_page(f"{before}<p>one</p>two")
    assert ["".join(pieces) for _, pieces in page.parts] == ["one", "two"]


def test_marks_of_layouts_are_read_in_training_only(spark):
    rows = [(1, "u", "<div data-main='true'>a</div>"), (2, "u", "<div data-main='1'>a</div>")]
    assert main_text(spark.createDataFrame(rows, "page_id bigint, url string, html string"), layouts=20).count() == 2
    assert read_page(rows[1][2]).label == [1, 0] and read_page(rows[1][2], True).label == [1, 1]


def test_decoding_never_keeps_a_child_of_a_dropped_node():
    page = read_page("<div><p>a</p><p>b</p></div><div><p>c</p></div>")
    assert page.text(np.array([1.0, -5, 1, 1, 1, 1])) == "c" and page.text(np.array([1.0, -1, 1, 1, -9, 1])) == "a b"
    assert train(20).logits(page.features()).shape == (6,)


# 5, 6, 7


def small_limits(monkeypatch):
    """Limits at which work is split and tables are joined by shuffles at the size of a test."""
    for module, values in ((common, {"BROADCAST_ROWS": 0}), (sd, {"FLUSH": 1, "SEED_BYTES": 9000, "WINDOW_BYTES": 9000, "SHARD_WORDS": 60, "STREAM_BYTES": 600}), (jj, {"FLUSH": 1, "BUCKET_BYTES": 9000, "BLOCK_ROWS": 7})):
        for name, value in values.items():
            monkeypatch.setattr(module, name, value)


@pytest.mark.parametrize("small", [False, True])
def test_repeats_by_brute_force(docs, none, monkeypatch, small):
    if small:
        small_limits(monkeypatch)
    rows, first = corpus(), {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        w = WORD.findall(t or "")
        for k in range(len(w) - 49):
            first.setdefault(tuple(w[k : k + 50]), i)
    want = []
    for i, t in rows:
        w = WORD.findall(t or "")
        gone = set()
        for k in range(len(w) - 49):
            if first[tuple(w[k : k + 50])] < i:
                gone |= set(range(k, k + 50))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        want.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256))
    assert rows_of(got) == sorted(want, key=str)
    assert remove_repeats(none).count() == 0


def test_the_automaton_finds_all_that_repeats():
    rng = random.Random(12)
    for _ in range(40):
        words = [str(k) for k in range(rng.choice([3, 60]))]
        passages = [(k, " ".join(rng.choices(words, k=rng.randint(10, 60)))) for k in range(6)]
        text = " ".join(" ".join(p.split()[rng.randint(0, 9) :]) if rng.random() < 0.7 else rng.choice(words) for _, p in rng.choices(passages, k=5))
        automaton, w = sd.PassageAutomaton(passages, 10, 5), text.split()
        known = {tuple(p.split()[j : j + 10]) for owner, p in passages if owner < 4 for j in range(len(p.split()) - 9)}
        want = {x for j in range(len(w) - 9) if tuple(w[j : j + 10]) in known for x in range(j, j + 10)}
        assert {x for a, b in automaton.find(4, text) for x in range(a, b)} == want
        automaton.automaton = type("Silent", (), {"iter": lambda self, chars: iter(())})()
        assert automaton.find(4, text) == []


def brute_components(rows):
    sets = {}
    for k, (i, t) in enumerate(rows):
        w = [re.sub("[A-Z]", lambda m: m.group().lower(), x) for x in WORD.findall(t or "")]
        sets[k] = set() if not w else {tuple(w)} if len(w) < 5 else {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    root = {k: k for k in sets}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                root[find(b)] = find(a)
    least = {}
    for k in sets:
        least[find(k)] = min(least.get(find(k), 1 << 60), rows[k][0])
    return sorted(((rows[k][0], len(sets[k]), least[find(k)] if sets[k] else rows[k][0]) for k in sets), key=str)


def chain():
    """Texts that share most words, of which only neighbours are linked, and texts of one long template that are not."""
    rng = random.Random(21)
    words = prose(rng, 260).split()
    rows = [(1000 + k, " ".join(words[9 * k : 9 * k + 120])) for k in range(14)]
    template = prose(rng, 100)
    return rows + [(2000 + k, f"{template} {prose(rng, 45)}") for k in range(30)]


@pytest.mark.parametrize("small", [False, True])
def test_near_duplicates_in_chains_and_templates(spark, monkeypatch, small):
    if small:
        small_limits(monkeypatch)
    rows = chain() + corpus()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    assert rows_of(jj.near_duplicates(docs)) == brute_components(rows)


def test_near_duplicates_by_brute_force(docs, none):
    assert rows_of(jj.near_duplicates(docs)) == brute_components(corpus())
    assert jj.near_duplicates(none).count() == 0


def test_signatures_miss_no_pair():
    rng = np.random.default_rng(0)
    for _ in range(300):
        n = int(rng.integers(20, 200))
        pool = np.unique(rng.integers(0, 2**63, 2 * n).astype(np.uint64))
        a = np.sort(rng.choice(pool[:n], n - int(rng.integers(0, n // 8)), replace=False))
        b = np.sort(rng.choice(pool[: n + n // 10], n - int(rng.integers(0, n // 8)), replace=False))
        both = len(np.intersect1d(a, b))
        if 100 * both >= 75 * (len(a) + len(b) - both):
            small, large = sorted((a, b), key=len)
            s = jj.band(len(small))
            x, y = jj.signatures(small, s, 75), jj.signatures(large, s, 75)
            assert jj.band(len(large)) - s in (0, 1) and (len(np.intersect1d(x[0], y[0])) or x[1] < jj.needs(len(small), False, 75))


def test_weak_sets_are_compared_by_tokens(spark, monkeypatch):
    monkeypatch.setattr(jj, "needs", lambda size, below, percent: 10**6)  # every set is weak
    rows = [r for r in corpus() if r[1] is None or len(r[1]) < 3000]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    facts = spark.createDataFrame([], "doc_id bigint, n bigint, fp bigint, weak bigint")
    assert jj.weak_pairs(facts, docs, 5, F.lit(True)).count() == 0
    fps = [jj.fingerprint(jj.shingle_set(t, WordHashes(), 5)) for _, t in rows]
    facts = spark.createDataFrame([(i, 1, f, 1) for (i, _), f in zip(rows, fps) if f], "doc_id bigint, n bigint, fp bigint, weak bigint")
    assert jj.weak_pairs(facts, docs, 5, F.lit(True)).count() >= 5


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(30)] + [(100, 101), (101, 101)], "u bigint, v bigint")
    got = dict(map(tuple, components(edges).collect()))
    assert all(got[k] == 0 for k in range(1, 31)) and got[101] == 100


def test_reparameterised_questions_are_found(spark, none):
    rng = random.Random(9)
    item = "Last week Anna bought 12 apples for 3 dollars each and Anna sold them to Boris for 50 dollars in total. What did she gain?"
    other = item.replace("Anna", "Clara").replace("12", "77").replace("Boris", "David").replace("50", "400")
    mixed = item.replace("Anna bought", "Clara bought").replace("Boris", "Anna")  # one name for two
    rows = [(1, f"{prose(rng, 40)}. {other} {prose(rng, 20)}"), (2, f"{prose(rng, 40)}.\n{item}"), (3, prose(rng, 200)), (4, mixed), (5, None), (6, ""), (7, "Four words only here"), (2, item)]
    docs = spark.createDataFrame([(i, t, "x", 1, "y", "z", 7) for i, t in rows], DOCS)
    bench = spark.createDataFrame([(10, item, 1), (11, None, 1), (12, "", 1), (13, "four words only here", 1), (14, "too short", 1)], "item_id bigint, text string, hash int")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench).collect()}
    assert got == {(1, 10), (2, 10), (7, 13)}
    assert contaminated(none, bench).count() == 0 and contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("together", [1, 50, 10**9])
def test_windows_stay_within_their_text(spark, monkeypatch, together):
    monkeypatch.setattr(decontamination, "TOGETHER", together)
    rng = random.Random(12)
    texts = [None, "", *(prose(rng, k) for k in (1, 3, 7, 8, 9, 30)), "--- ...", "He met Anna on 3 May, then Anna left. " * 4, "", prose(rng, 8)]
    got = decontamination.windows_of(spark.createDataFrame(list(enumerate(texts)), "id bigint, text string").coalesce(1), [8, 5], "bigint", np.full(1 << 23, 255, np.uint8), False)
    got = Counter((r.id, r.pos, r.kind, r.n_words, r.n, tuple(r.slots)) for r in got.collect())
    want = Counter()
    for k, text in enumerate(texts):
        words = [w for w in (text or "").split() if decontamination.surface(w.encode())]
        low = [decontamination.surface(w.encode()) for w in words]
        name = [w[:1].isupper() and i > 0 and words[i - 1][-1] not in ".!?:" for i, w in enumerate(words)]
        number = [w[:1].isdigit() for w in words]
        for width in (8, 5):
            for p in range(len(words) - width + 1):
                at = range(p, p + width)
                named = any(name[i] for i in at)
                for kind, slot in ((1, [a or b for a, b in zip(name, number)]), (2, number))[: 1 + named]:
                    want[k, p, kind if named else 3, len(words), len(words) - width + 1, tuple(low[i] for i in at if slot[i])] += 1
    assert got == want


def test_copies_in_other_case_are_found(spark):
    item = "Yesterday a man from Gro\u00dfenhain told Anna that I and he saw a bird near Lake Tana, \u00e1 mile off Bahir Dar. Which bird was it?"
    rows = [(1, item.upper()), (2, item.lower()), (3, item.title()), (4, item), (5, f"x y z. {item.upper()} X Y"), (6, " ".join(reversed(item.upper().split())))]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.share for r in contaminated(docs, spark.createDataFrame([(10, item)], "item_id bigint, text string")).collect()}
    assert got == {1: 1.0, 2: 1.0, 3: 1.0, 4: 1.0, 5: 1.0}


def test_pipeline_stages_with_null_and_repeated_ids(spark, tmp_path):
    import corpus_pipeline as cp

    rng = random.Random(5)
    a, b, c, d = (prose(rng, 90) for _ in range(4))
    item = "Which river did the old traveller cross before dawn on the way home to the hills?"
    spark.createDataFrame([(1, item)], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    ids = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    rows = [(None, a), (7, a), (8, a), (None, b), (None, b), (None, b + " ka"), (3, c), (3, d), (4, c + " ka"), (2, d + " ka"), (None, None), (9, "")]
    got = ids(cp.near_dedup(spark, frame(rows), str(tmp_path)))
    of_b = [r for r in got if r[1] in (b, b + " ka")]
    assert len(of_b) == 1 and [r for r in got if r not in of_b] == sorted([(7, a), (3, c), (2, d + " ka"), (None, None), (9, "")], key=str)
    rows = [(None, item), (None, a), (3, b), (3, f"{c} {item}")]
    assert ids(cp.decontamination(spark, frame(rows), str(tmp_path))) == sorted([(None, a), (3, b)], key=str)


def test_repeats_of_more_words_than_there_are_characters(spark):
    """Two equal documents of 1.25 million distinct words: all of the second goes."""
    text = " ".join(f"w{k}" for k in range(1_250_000))
    docs = spark.createDataFrame([(1, text), (2, text), (3, "a short one")], "doc_id bigint, text string")
    got = {r[0]: r[1:] for r in remove_repeats(docs).select("doc_id", "n_words", "n_removed").collect()}
    assert got == {1: (1_250_000, 0), 2: (1_250_000, 1_250_000), 3: (3, 0)}


@pytest.mark.parametrize("size", [30, 3])
def test_split_passages_and_loads_give_the_same(docs, monkeypatch, size):
    whole = rows_of(remove_repeats(docs))
    monkeypatch.setattr(sd, "SHARD_WORDS", size)
    monkeypatch.setattr(sd, "LOAD_WORDS", 2 * size)
    assert rows_of(remove_repeats(docs)) == whole


def rules_by_hand(rows, least, sure):
    """Rules {tokens: confidence} from all token sets of rows (tokens, bad), by definition."""
    from itertools import combinations

    tokens = sorted({t for items, _ in rows for t in items})
    conf = {}
    for k in range(1, len(tokens) + 1):
        for some in combinations(tokens, k):
            hit = [bad for items, bad in rows if set(some) <= set(items)]
            if sum(hit) >= least:
                conf[some] = sum(hit) / len(hit)
    return {x: c for x, c in conf.items() if c >= sure and not any(set(y) < set(x) and d >= c for y, d in conf.items())}


@pytest.mark.parametrize("seed", [1, 2])
def test_rules_by_brute_force(spark, seed):
    from meridian.llm.url_filters import BAD, mine_rules, token_classes

    rng, rows = random.Random(seed), []
    for _ in range(80):
        some = {t for t in "abcde" if rng.random() < 0.5}
        some |= {"twin", "twin2"} if "a" in some and rng.random() < 0.9 else set()
        rows.append((sorted(some), int(rng.random() < (0.9 if {"a", "c"} <= some else 0.3))))
    data = [(k, [*items, BAD] if bad else items) for k, (items, bad) in enumerate(rows)]
    frame = spark.createDataFrame(data, "row bigint, items array<string>")
    classes = {r.token: r.cls for r in token_classes(frame, 4).collect()}
    assert classes["twin2"] == classes["twin"] == "twin"
    classed = spark.createDataFrame([(sorted({classes.get(t, t) for t in items if t == BAD or t in classes}),) for _, items in data], "items array<string>")
    got = {tuple(r.antecedent): r.confidence for r in mine_rules(classed, 4 / len(rows), 0.6).collect()}
    spread = {}
    for x, c in got.items():  # a rule stands for one token of each class
        members = [[t for t, cls in classes.items() if cls == k] for k in x]
        spread |= {tuple(sorted(y)): c for y in __import__("itertools").product(*members)}
    want = rules_by_hand(rows, 4, 0.6)
    assert spread == pytest.approx(want) and len(want) > 1


def test_urls_of_thirty_tokens_that_occur_together(spark):
    path = "/".join(f"w{chr(97 + k)}x" for k in range(26))
    urls = [(k, f"https://a.b.site.org/{path}/{k}", k % 8 != 0) for k in range(40)] + [(100 + k, f"https://good.com/{k}", False) for k in range(60)]
    labelled = spark.createDataFrame([(u, b) for _, u, b in urls], "url string, bad boolean")
    pages = spark.createDataFrame([(k, u) for k, u, _ in urls] + [(200, "https://x.net/wcx/5"), (201, "https://x.net/other")], "page_id bigint, url string")
    got = {r.page_id: r for r in judge_urls(pages, labelled, [], min_count=20).collect()}
    assert all(got[k].verdict == "block" for k in range(40)) and all(got[100 + k].verdict == "allow" for k in range(60))
    assert got[200].verdict == "block" and got[200].mined == "path:wcx" and got[200].confidence == pytest.approx(35 / 40) and got[201].verdict == "allow"

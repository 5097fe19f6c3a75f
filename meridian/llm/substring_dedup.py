"""Substring dedup by repeated-phrase automata.

A window is `width` consecutive words. Every word covered by a window whose words also start in a
document with a smaller id is removed; windows are judged on the input.

1. Seeds. In every window the phrase of `seed` words with the least hash is its seed, so equal
   windows have equal seeds. Seeds that occur in several documents mark regions of their documents.
2. Confirmed passages. The windows of the regions are grouped by hash; the smallest document with a
   window that recurs owns it. Runs of windows that a document owns are its passages: together they
   hold every recurring window.
3. Automata. Passages are dealt to shards of bounded size by origin. A shard's phrases, the seeds of
   its passages' windows written with one character per distinct word, become an Aho-Corasick automaton
   (pyahocorasick); a phrase holds the windows that it is the seed of, with their passages and places.
4. Stream. A document's regions go to the shards that hold one of its seeds, shards with much to
   read are split. Where the automaton finds a phrase, the words around it are looked up among the
   phrase's windows and the match is extended word by word in both directions; `width` words or more
   of a smaller document are marked. A phrase of very many passages costs no more than another.
5. All documents are read once more and the marked words left out.

A seed or window that a scan meets in several documents is settled there: only its least and greatest
document take part in the shuffle by hash, so a phrase of all documents makes no large group.

Work between the steps is written to the checkpoint folder. Null and empty texts have no words.
Rows with one id are one document to others, each row is cut by its own text; a null id counts as
smaller than all. Ties (the same window twice in a document) are taken at the first place. Columns
not named are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import WordHashes, ascii_words, materialize, near, tasks_for, text_bytes, window_hashes

NULL_ID = -(1 << 63)
#: Hashes that a scan holds before it sends them on.
FLUSH = 400_000
#: Bytes of text whose seeds, and whose windows, a task compares, about.
SEED_BYTES, WINDOW_BYTES = 100_000_000, 12_000_000
#: Passage words in a shard, and bytes of regions that one task streams through it, about.
SHARD_WORDS, STREAM_BYTES, LOAD_WORDS = 80_000, 8_000_000, 800_000
#: Marks a place whose document's occurrences were sent apart.
SENT = np.uint32(1 << 31)


def sliding(a: np.ndarray, w: int, best) -> np.ndarray:
    """`best` (np.minimum or np.maximum) of every w consecutive values."""
    size = 1
    while 2 * size <= w:
        a = best(a[:-size], a[size:])
        size *= 2
    return best(a[: len(a) - (w - size)], a[w - size :]) if size < w else a


def seed_places(h: np.ndarray, width: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and hashes of the seeds of all windows, from word hashes."""
    if len(h) < width:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    g, w = window_hashes(h, seed), width - seed + 1
    least = sliding(g, w, np.minimum)
    edge = np.zeros(w - 1, np.uint64)
    most = sliding(np.concatenate([edge, least, edge]), w, np.maximum)  # of the windows that hold the phrase
    places = np.flatnonzero(most == g)
    return places, g[places]


PACKED = "bucket int, sent boolean, hashes binary, doc binary, pos binary, docs binary, fps binary"


def combined(hashes: np.ndarray, doc: np.ndarray, pos: np.ndarray, docs: np.ndarray, fps: np.ndarray, buckets: int, owners_only: bool) -> list[tuple]:
    """Rows (bucket, sent, hashes, local document numbers, places, documents, fingerprints) by hash range.

    Entries come in the order of (document, fingerprint, place). Of a hash with several documents the
    first and the last entry stay; unless `owners_only`, all its entries are sent apart besides.
    """
    order = np.argsort(hashes, kind="stable")
    hashes, doc, pos = hashes[order], doc[order], pos[order].astype(np.uint32)
    first = np.r_[True, hashes[1:] != hashes[:-1]]
    start = np.flatnonzero(first)
    size = np.diff(np.r_[start, len(hashes)])
    several = docs[doc[start]] != docs[doc[start + size - 1]]
    last = np.zeros(len(hashes), bool)
    last[(start + size - 1)[several]] = True
    rows = []

    def add(bucket: int, sent: bool, take: np.ndarray | slice, mark: np.ndarray | None = None) -> None:
        used, local = np.unique(doc[take], return_inverse=True)
        where = pos[take] if mark is None else pos[take] | np.where(mark[take], SENT, np.uint32(0))
        rows.append((bucket, sent, hashes[take].tobytes(), local.astype(np.uint32).tobytes(), where.tobytes(), docs[used].tobytes(), fps[used].tobytes()))

    shared = np.repeat(several, size)
    if owners_only:
        stay, mark = first | last, None
    else:
        stay, mark = ~shared | first | last, shared
        apart = np.flatnonzero(shared)
        apart = apart[np.argsort(doc[apart], kind="stable")]
        for k in range(0, len(apart), 50_000):  # spread by document, not by hash
            take = apart[k : k + 50_000]
            add(int(docs[doc[take[0]]]) * 0x9E3779B1 % buckets, True, take)
    stay = np.flatnonzero(stay)
    edge = np.searchsorted(((hashes[stay] >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32), np.arange(buckets + 1, dtype=np.uint64))
    for b in np.flatnonzero(np.diff(edge)).tolist():
        add(b, False, stay[edge[b] : edge[b + 1]], mark)
    return rows


def packed_hashes(source: DataFrame, buckets: int, width: int, seed: int | None) -> DataFrame:
    """Hashes of seeds (or, without `seed`, of all windows) of rows (doc_id, fp, start, text), packed by range."""
    most = min(4_000_000, max(FLUSH, 64 * buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        held, parts = 0, []

        def flush() -> pa.RecordBatch:
            parts.sort(key=lambda x: x[:3])
            docs, fps = (np.array([x[k] for x in parts], np.int64) for k in (0, 1))
            hashes, pos = np.concatenate([x[3] for x in parts]), np.concatenate([x[4] for x in parts])
            rows = combined(hashes, np.repeat(np.arange(len(parts)), [len(x[3]) for x in parts]), pos, docs, fps, buckets, not seed)
            cols = list(zip(*rows))
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), pa.array(cols[1]), *(pa.array(c, pa.binary()) for c in cols[2:])], names=["bucket", "sent", "hashes", "doc", "pos", "docs", "fps"])

        for batch in batches:
            for doc, fp, start, item in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                h = known.of(ascii_words(item.as_py()))
                if seed:
                    places, hashes = seed_places(h, width, seed)
                else:
                    hashes = window_hashes(h, width)
                    places = np.arange(len(hashes))
                if len(places):
                    parts.append((doc, fp, start, hashes, places + start))
                    held += len(places)
                if held >= most:
                    yield flush()
                    held, parts = 0, []
        if parts:
            yield flush()

    return source.mapInArrow(run, PACKED)


def recurring(packed: DataFrame, owners_only: bool) -> DataFrame:
    """Hashes that occur in several documents.

    Rows (doc_id, fp, hash, pos) of every occurrence; with `owners_only` rows (doc_id, fp, places)
    of the first place in the smallest document, packed by document.
    """

    def run(group: pa.Table) -> pa.Table:
        def read(rows: list[dict]) -> tuple[np.ndarray, ...]:
            column = lambda name, kind: [np.frombuffer(x[name], kind) for x in rows]
            ids = column("docs", np.int64)
            first = np.cumsum([0] + [len(x) for x in ids])
            which = [d.astype(np.int64) + f for d, f in zip(column("doc", np.uint32), first)]
            none = np.empty(0, np.int64)
            join = lambda arrays, kind: np.concatenate([none.astype(kind), *arrays])
            return join(ids, np.int64), join(column("fps", np.int64), np.int64), join(which, np.int64), join(column("hashes", np.uint64), np.uint64), join(column("pos", np.uint32), np.uint32)

        rows = group.to_pylist()
        ids, fps, which, hashes, pos = read([r for r in rows if not r["sent"]])
        place = (pos & ~SENT).astype(np.int64)
        order = np.lexsort((place, fps[which], ids[which], hashes))
        hashes, which, pos, place = hashes[order], which[order], pos[order], place[order]
        start = np.flatnonzero(np.r_[True, hashes[1:] != hashes[:-1]]) if len(hashes) else np.empty(0, np.int64)
        size = np.diff(np.r_[start, len(hashes)])
        several = ids[which[start]] != ids[which[start + size - 1]]  # ids are sorted in each run
        if owners_only:
            at = start[several]
            key = which[at]
            _, key = np.unique(np.stack([ids[key], fps[key]], 1), axis=0, return_inverse=True)
            key = key.ravel()
            order = np.argsort(key, kind="stable")
            at, key = at[order], key[order]
            cut = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.empty(0, np.int64)
            places = np.split(place[at].astype(np.uint32), cut[1:]) if len(cut) else []
            head = which[at[cut]]
            return pa.table({"doc_id": ids[head], "fp": fps[head], "places": pa.array([x.tobytes() for x in places], pa.binary())})
        keep = np.repeat(several, size) & ((pos & SENT) == 0)
        own = ids[which[keep]], fps[which[keep]], hashes[keep], place[keep]
        ids, fps, which, hashes, pos = read([r for r in rows if r["sent"]])
        doc, fp, code, at = (np.concatenate(x) for x in zip(own, (ids[which], fps[which], hashes, pos)))
        return pa.table({"doc_id": doc, "fp": fp, "hash": code.view(np.int64), "pos": at.astype(np.int32)})

    kind = "doc_id bigint, fp bigint, places binary" if owners_only else "doc_id bigint, fp bigint, hash bigint, pos int"
    return packed.groupBy("bucket").applyInArrow(run, kind)


def runs_of(starts: np.ndarray) -> list[tuple[int, int]]:
    """First and last of each run of consecutive values of a sorted array."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.r_[0, cut + 1]].tolist(), starts[np.r_[cut, len(starts) - 1]].tolist()))


def cut_out(source: DataFrame, width: int, seed: int | None) -> DataFrame:
    """Runs of windows as texts: rows (doc_id, fp, start, text, n_words).

    `source` has (doc_id, fp, start, text, places). Places are seeds' places and stand for all
    windows around them, or, without `seed`, packed window places.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, fp, start, item, places in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3), batch.column(4).to_pylist()):
                words = ascii_words(item.as_py())
                last = len(words) - width
                if last < 0:
                    continue
                mark = np.zeros(last + 1, bool)
                if seed:
                    for p in places:
                        mark[max(0, p - (width - seed)) : p + 1] = True
                else:
                    at = np.concatenate([np.frombuffer(x, np.uint32) for x in places]).astype(np.int64) - start
                    mark[at[(at >= 0) & (at <= last)]] = True
                for first, final in runs_of(np.flatnonzero(mark)):
                    for a in [first] if seed else range(first, final + 1, SHARD_WORDS):  # a passage of a shard: so many windows at most
                        b = final if seed else min(final, a + SHARD_WORDS - 1)
                        rows.append((doc, fp, start + a, b" ".join(words[a : b + width]), b + width - a))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary()).cast(pa.string()), pa.array(cols[4], pa.int64())],
                names=["doc_id", "fp", "start", "text", "n_words"],
            )

    return source.mapInArrow(run, "doc_id bigint, fp bigint, start bigint, text string, n_words bigint")


def seeds_of(passages: DataFrame, width: int, seed: int) -> DataFrame:
    """Seeds (doc_id, fp, start, hash) of passages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for *key, item in zip(*(batch.column(k).to_pylist() for k in range(3)), batch.column(3)):
                g = np.unique(seed_places(known.of(ascii_words(item.as_py())), width, seed)[1])
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(len(g), k, np.int64)) for k in key), pa.array(g.view(np.int64))], names=["doc_id", "fp", "start", "hash"])

    return passages.select("doc_id", "fp", "start", "text").mapInArrow(run, "doc_id bigint, fp bigint, start bigint, hash bigint")


def common_length(a: str, i: int, b: str, j: int, step: int) -> int:
    """How far a from i and b from j agree, forwards (step 1) or backwards (step -1, before i and j)."""
    room = min(len(a) - i, len(b) - j) if step > 0 else min(i, j)
    done, block = 0, 16
    while done < room:
        n = min(block, room - done)
        same = a[i + done : i + done + n] == b[j + done : j + done + n] if step > 0 else a[i - done - n : i - done] == b[j - done - n : j - done]
        if same:
            done, block = done + n, block * 2
        elif n == 1:
            break
        else:
            room, block = done + n - 1 if n > 1 else done, max(1, n // 2)
    return done


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The same places with spans that meet made one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def loads(passages: list[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Passages (doc_id, text) in lists of about LOAD_WORDS words, so that words fit into the character codes of an automaton."""
    some, have = [], 0
    for owner, text in passages:
        n = text.count(" ") + 1
        if some and have + n > LOAD_WORDS:
            yield some
            some, have = [], 0
        some.append((owner, text))
        have += n
    if some:
        yield some


class PassageAutomaton:
    """Aho-Corasick automaton over the phrases of passages (doc_id, text)."""

    def __init__(self, passages: list[tuple[int, str]], width: int, seed: int):
        import ahocorasick

        self.width, self.seed, self.code = width, seed, {}
        self.owner, self.chars = [], []
        known, phrases = WordHashes(), {}
        for owner, text in sorted(passages):
            words = ascii_words(text)
            for w in words:
                if w not in self.code:
                    k = len(self.code) + 2
                    self.code[w] = chr(k if k < 0xD800 else k + 0x800)  # no surrogates
            chars = "".join(map(self.code.__getitem__, words))
            if len(words) >= width:
                g = window_hashes(known.of(words), seed)
                place = np.lib.stride_tricks.sliding_window_view(g, width - seed + 1).argmin(1)
                for k, p in enumerate(place.tolist()):  # a window of several passages: the one of the least document
                    phrases.setdefault(chars[k + p : k + p + seed], {}).setdefault(chars[k : k + width], (len(self.owner), k))
            self.owner.append(owner)
            self.chars.append(chars)
        self.automaton = ahocorasick.Automaton()
        for phrase, windows in phrases.items():
            self.automaton.add_word(phrase, windows)
        self.automaton.make_automaton()

    def find(self, doc: int, text: str) -> list[tuple[int, int]]:
        """Word intervals of a text that passages of smaller documents cover."""
        get = self.code.get
        chars = "".join([get(x, "\x01") for x in ascii_words(text)])
        width, seed, owner, last = self.width, self.seed, self.owner, len(chars) - self.width
        out: list[tuple[int, int]] = []
        low = high = -1  # windows that start from low to high are marked
        for end, windows in self.automaton.iter(chars):
            i = end - seed + 1
            s, to = max(0, end + 1 - width), min(i, last)
            while s <= to:
                if low <= s <= high:
                    s = high + 1
                    continue
                found = windows.get(chars[s : s + width])
                if found is None or owner[found[0]] >= doc:
                    s += 1
                    continue
                other, o = self.chars[found[0]], found[1]
                low = s - common_length(chars, s, other, o, -1)
                high = s + common_length(chars, s, other, o, 1) - width
                out.append((low, high + width))
        return joined(out)


def repeats(docs: DataFrame, width: int, seed: int) -> DataFrame:
    """Rows (doc_id, fp, spans): packed (from, to) word places of `docs` (doc_id, fp, text) to remove."""
    spark = docs.sparkSession
    tasks = tasks_for(spark)
    whole = docs.select("doc_id", "fp", F.lit(0).cast("long").alias("start"), "text")
    buckets = max(tasks, math.ceil(text_bytes(docs) / SEED_BYTES))
    seeds = materialize(recurring(packed_hashes(whole, buckets, width, seed), False), "seeds")
    marked = materialize(seeds.groupBy("doc_id", "fp").agg(F.collect_list("pos").alias("places")), "marked")
    whole = whole.join(near(marked.select("doc_id", "fp")), ["doc_id", "fp"], "left_semi")
    regions = whole.join(marked, ["doc_id", "fp"]).select("doc_id", "fp", "start", "text", "places")
    regions = materialize(cut_out(regions, width, seed), "regions")

    buckets = max(1, tasks // 2, math.ceil(text_bytes(regions) / WINDOW_BYTES))
    owned = recurring(packed_hashes(regions.select("doc_id", "fp", "start", "text"), buckets, width, None), True)
    owned = materialize(owned.groupBy("doc_id", "fp").agg(F.collect_list("places").alias("places")), "owned")
    passages = regions.join(owned, ["doc_id", "fp"]).select("doc_id", "fp", "start", "text", "places")
    passages = materialize(cut_out(passages, width, None), "passages")
    # passages of near copies go together: by the smallest document that has one of their seeds
    place = ["doc_id", "fp", "start"]
    their = materialize(seeds_of(passages, width, seed), "passage-seeds")
    origin = their.join(seeds.groupBy("hash").agg(F.min("doc_id").alias("origin")), "hash").groupBy(*place).agg(F.min("origin").alias("origin"))
    passages = materialize(passages.join(origin, place).select(*place, "origin", "text", "n_words"), "placed")
    words = passages.agg(F.coalesce(F.sum("n_words"), F.lit(0))).first()[0]
    shards = max(tasks, -(-words // SHARD_WORDS))
    large = passages.groupBy("origin").agg(F.ceil(F.sum("n_words") / SHARD_WORDS).cast("int").alias("split")).where("split > 1")
    deal = F.pmod(F.xxhash64("origin", F.pmod(F.xxhash64(*place), F.coalesce("split", F.lit(1)))), F.lit(shards)).cast("int")
    passages = materialize(passages.join(large, "origin", "left").select(*place, deal.alias("shard"), "text"), "sharded")

    known = their.join(passages.select(*place, "shard"), place).select("hash", "shard").distinct()
    shards_of = materialize(seeds.select("doc_id", "fp", "hash").join(known, "hash").select("doc_id", "fp", "shard").distinct(), "routes")
    routed = regions.join(shards_of, ["doc_id", "fp"]).select("shard", "doc_id", "fp", "start", "text")
    load = regions.select("doc_id", "fp", F.octet_length("text").alias("bytes")).join(shards_of, ["doc_id", "fp"]).groupBy("shard").agg(F.ceil(F.sum("bytes") / STREAM_BYTES).cast("int").alias("parts"))
    load = materialize(load, "load")
    routed = routed.join(load, "shard").select("shard", F.pmod(F.xxhash64("doc_id", "fp", "start"), F.col("parts")).cast("int").alias("part"), "doc_id", "fp", "start", "text")
    dealt = passages.select("shard", "doc_id", "text").join(load.withColumnRenamed("shard", "_shard"), F.col("shard") == F.col("_shard"))
    dealt = dealt.select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "doc_id", "text")
    dealt, routed = materialize(dealt, "dealt"), materialize(routed, "routed")

    def stream(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(left) and len(right):
            for passages in loads(sorted(zip(left["doc_id"].tolist(), left["text"]))):
                automaton = PassageAutomaton(passages, width, seed)
                for doc, fp, start, text in zip(right["doc_id"].tolist(), right["fp"].tolist(), right["start"].tolist(), right["text"]):
                    if spans := automaton.find(doc, text):
                        out.append((doc, fp, (np.array(spans, np.int64) + start).astype(np.uint32).tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "fp", "spans"])

    found = dealt.groupBy("shard", "part").cogroup(routed.groupBy("shard", "part")).applyInPandas(stream, "doc_id bigint, fp bigint, spans binary")
    joined = F.aggregate(F.collect_list("spans"), F.lit(b""), lambda a, b: F.concat(a, b))
    return materialize(found.groupBy("doc_id", "fp").agg(joined.alias("spans")), "spans")


def remove_repeats(docs: DataFrame, width: int = 50, seed: int = 26, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """Rows (id, n_words, n_removed, kept, carried columns) for every document.

    `kept` joins the kept words by one space; it is the text itself where nothing is removed and
    columns are carried along.
    """
    other = {f"carried_{k}": c for k, c in enumerate(carry)}
    docs = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("text"), *(F.col(c).alias(k) for k, c in other.items())
    )
    spans = near(repeats(docs.select("doc_id", "fp", "text"), width, seed), "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part, rows = batch.slice(start, 200), []
                for item, packed in zip(part.column(1), part.column(2).to_pylist()):
                    words = ascii_words(item.as_py())
                    n, gone = len(words), 0
                    if packed:
                        drop = np.zeros(n + 1, np.int64)
                        for a, b in np.frombuffer(packed, np.uint32).reshape(-1, 2).tolist():
                            drop[a] += 1
                            drop[b] -= 1
                        keep = np.cumsum(drop)[:-1] == 0
                        gone = n - int(keep.sum())
                        words = [words[k] for k in np.flatnonzero(keep).tolist()]
                    rows.append((n, gone, (item.as_py() or "").encode() if other and not gone else b" ".join(words)))
                cols = list(zip(*rows))
                made = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.binary())]
                yield pa.RecordBatch.from_arrays([part.column(0), *made, *part.columns[3:]], names=["doc_id", "n_words", "n_removed", "kept", *other])

    marked = docs.join(spans, ["doc_id", "fp"], "left").select("doc_id", "text", "spans", *other)
    kinds = "".join(f", {k} {marked.schema[k].dataType.simpleString()}" for k in other)
    cut = marked.mapInArrow(run, f"doc_id bigint, n_words bigint, n_removed bigint, kept binary{kinds}")
    return cut.select(F.nullif("doc_id", F.lit(NULL_ID)).alias(id_col), "n_words", "n_removed", F.col("kept").cast("string").alias("kept"), *(F.col(k).alias(c) for k, c in other.items()))

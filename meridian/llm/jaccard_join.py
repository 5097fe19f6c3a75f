"""Exact n-gram Jaccard join by universe-partition pigeonhole.

A document's set holds the hashes of its word shingles. Two sets r, s with Jaccard similarity of at
least J differ in at most H = (1 - J) / (1 + J) * (|r| + |s|) tokens. For each size band the token
universe is cut into segments by hash; a token's high bits tell its segment. If the occupied
segments of a set number more than H, at least one of them is equal in every partner, so sets that
share no segment signature cannot be linked. The first few segments of a band are also indexed with
their one-deletion neighbourhoods: such a segment stays unmatched only if it differs in two tokens,
so it counts twice. `allocation` picks segments and neighbourhoods per band by expected rows. A set
takes part in its own band (with partners of its band and the next) and in the band below.

Scan: signatures of all sets, packed by signature range into binary rows. Index: a task per range
sorts its signatures and keeps the lists of sets that share one, equal lists once. First round: each
set with the list head it shares most with; exact verification; components. A list within one
component is settled. Second round, for the open lists: the argument above holds for any choice of
segments, so a set whose other segments still number more than H has no link to lose there and
leaves, and a pair must share more of them than the reserve of either set (a count filter). What
remains is compared exactly in blocks that emit links only. Equal sets share one
fingerprint and count as one. Verification loads each text once per block of pairs; blocks of a set
with many partners are split.

Sets whose contributions fall short of H + 1 (so unlikely that tests must force it) are compared by
single tokens instead. Null and empty texts have empty sets and are linked with nothing; a text with
fewer words than a shingle is one shingle. Ids are integers; repeated ids are rows of their own, and
the smallest id names the component. Columns not named are ignored. Set fingerprints have 64 bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import WordHashes, ascii_words, materialize, mix64, near, tasks_for, text_bytes, window_hashes
from meridian.llm.components import components

#: Sets up to this size have each token as a segment of its own.
TINY = 32
#: Shares of a band's segments that may have one-deletion neighbourhoods. In rows alone none would be
#: cheapest; the least share keeps a reserve for sets with common segments.
SHARES = (0.02, 0.05, 0.1, 0.2, 0.4)
#: Signatures that a scan holds before it sends them on.
FLUSH = 400_000
#: Bytes of text whose signatures a task indexes, about (30 bytes of arrays for each byte).
BUCKET_BYTES = 16_000_000
#: Members of a list in one row.
CHUNK = 4096
#: List memberships that ask, and that are asked, in a block of the second round, about.
BLOCK_ROWS = 40_000
#: Stands for a null id.
NULL_ID = -(1 << 63)


def band(size: int) -> int:
    """0 for sets up to TINY, then one band for each doubling."""
    return 0 if size <= TINY else int(math.log2((size - 1) / TINY)) + 1


def top(b: int) -> int:
    """Greatest size in a band."""
    return TINY << b


def reach(percent: int, size: int) -> int:
    """Greatest size of a partner."""
    return size * 100 // percent


def differ(percent: int, total: int) -> int:
    """Most tokens in which linked sets of that total size differ."""
    return (100 - percent) * total // (100 + percent)


@lru_cache(maxsize=256)
def allocation(b: int, percent: int) -> tuple[int, int]:
    """Segments of a band, and how many of them have one-deletion neighbourhoods, at least cost.

    Cost is the expected number of signatures of a set; a choice must leave six standard deviations
    between the expected contributions and H + 1 for every size that takes part in the band.
    """
    if b == 0:
        return 0, 0
    low, high = top(b - 1) + 1, top(b)
    sizes = sorted({low, (low + high) // 2, high, reach(percent, high)})
    best = None
    for load in (1.2, 1.4, 1.6, 1.8, 2.0, 2.2, 2.4, 2.6):
        m = math.ceil(high / load)
        for share in SHARES:
            q, safe, cost = math.ceil(m * share), True, 0.0
            for size in sizes:
                x = size / m
                one, two = 1 - math.exp(-x), 1 - math.exp(-x) * (1 + x)
                mean = m * one + q * two
                sd = math.sqrt(m * math.exp(-x) * (1 - (1 + x) * math.exp(-x)) + q * two * (1 - two))
                need = differ(percent, size + min(reach(percent, size), reach(percent, high)) if size <= high else high + size) + 1
                safe &= mean - 6 * sd >= need
                cost += (m * one + q * (x - x * math.exp(-x))) / size
            if safe and (best is None or cost < best[0]):
                best = cost, m, q
    if best is None:
        return math.ceil(high / 1.2), math.ceil(high / 1.2)
    return best[1], best[2]


def shingle_set(text: str | None, hashes: WordHashes, n: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a text, A-Z lower-cased."""
    words = ascii_words(text, lower=True)
    if not words:
        return np.empty(0, np.uint64)
    k = min(n, len(words))
    return np.unique(window_hashes(hashes.of(words), k) ^ np.uint64(n - k))


def fingerprint(s: np.ndarray) -> int:
    with np.errstate(over="ignore"):
        return int(mix64(np.array([mix64(s).sum() + np.uint64(len(s))], np.uint64))[0].astype(np.int64)) if len(s) else 0


def signatures(s: np.ndarray, b: int, percent: int) -> tuple[np.ndarray, int]:
    """Signatures of a set in a band's scheme (odd: of a segment with neighbourhoods), and its contributions."""
    with np.errstate(over="ignore"):
        salt = mix64(np.array([b + 1], np.uint64))[0]
        m, q = allocation(b, percent)
        if m == 0:
            return mix64(s + salt) & ~np.uint64(1), len(s)
        segment = ((s >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)
        starts = np.flatnonzero(np.r_[True, segment[1:] != segment[:-1]])
        total = np.add.reduceat(s, starts)
        own = segment[starts]
        size = np.diff(np.r_[starts, len(s)])
        near = own < q
        one = np.uint64(1)
        out = [(mix64(total + salt * (own + one)) & ~one) | near]
        count = len(own) + int((near & (size > 1)).sum())
        wide = near & (size > 1)
        if wide.any():
            end = int(starts[wide][-1] + size[wide][-1])
            of = np.repeat(np.arange(len(own)), size)[:end]
            take = np.flatnonzero(wide[of])
            of = of[take]
            out.append(mix64(total[of] - s[take] + salt * (own[of] + one)) | one)
        return np.concatenate(out), count


def needs(size: int, below: bool, percent: int) -> int:
    """Contributions that let a set of this size miss no partner in its own band's scheme, or in the one below."""
    if below:
        return differ(percent, top(band(size) - 1) + size) + 1
    return differ(percent, size + reach(percent, size)) + 1


PACKED = "bucket int, facts binary, fps binary, sigs binary, at binary"
#: Of a document: id, set size, fingerprint, whether the set is weak, contributions and reserve in its
#: own band's scheme and in the one below. A copy of a set that its scan knows leaves the last four to it.
FACTS = ("doc_id", "n", "fp", "weak", "own", "low", "own_spare", "low_spare")
#: No contributions to tell, and a reserve without end where a set takes no part in the band below.
UNKNOWN, ENDLESS = -(1 << 30), 1 << 30
LOW = np.uint64(0xFFFFFFFF)


def scan(docs: DataFrame, n: int, percent: int, buckets: int) -> DataFrame:
    """Binary rows by signature range, with the documents' facts spread over them.

    In a range a signature is its lower 32 bits (a collision only adds a candidate). They are sorted
    and stored as differences, byte plane by byte plane, so that the shuffle packs them well.
    """
    most = min(4_000_000, max(FLUSH, 64 * buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        facts: list[list[int]] = []
        sets: dict[int, int] = {}
        sigs: list[np.ndarray] = []
        at: list[np.ndarray] = []
        held = 0

        def flush() -> pa.RecordBatch:
            sig = np.concatenate(sigs) if sigs else np.empty(0, np.uint64)
            who = np.concatenate(at) if at else np.empty(0, np.uint16)
            place = ((sig >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)
            key = (place << np.uint64(32)) | (sig & LOW)
            order = np.argsort(key)
            key, who = key[order], who[order]
            edge = np.searchsorted(key, np.arange(buckets + 1, dtype=np.uint64) << np.uint64(32))
            fps = np.fromiter(sets, np.int64, len(sets))
            rows = []
            for b in range(buckets):
                mine = facts[b::buckets]
                lo, hi = edge[b], edge[b + 1]
                if lo == hi and not mine:
                    continue
                used, local = np.unique(who[lo:hi] >> 1, return_inverse=True)
                packed = (local.astype(np.uint16) << 1) | (who[lo:hi] & 1)
                step = np.diff((key[lo:hi] & LOW).astype(np.uint32), prepend=np.uint32(0))
                rows.append((b, np.array(mine, np.int64).tobytes(), fps[used].tobytes(), step.view(np.uint8).reshape(-1, 4).T.tobytes(), packed.tobytes()))
            cols = list(zip(*rows)) if rows else [()] * 5
            for x in (facts, sets, sigs, at):
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int32()), *(pa.array(c, pa.binary()) for c in cols[1:])], names=["bucket", "facts", "fps", "sigs", "at"])

        for batch in batches:
            for doc, item in zip(batch.column(0).to_pylist(), batch.column(1)):
                s = shingle_set(item.as_py(), hashes, n)
                fp = fingerprint(s)
                facts.append([doc, len(s), fp, 0, UNKNOWN, UNKNOWN, UNKNOWN, UNKNOWN])
                if not len(s) or fp in sets:
                    continue
                k = sets[fp] = len(sets)
                b = band(len(s))
                for below in (False, True):
                    if below and (b == 0 or len(s) > reach(percent, top(b - 1))):
                        facts[-1][5], facts[-1][7] = 0, ENDLESS
                        continue
                    sig, count = signatures(s, b - below, percent)
                    facts[-1][4 + below], facts[-1][6 + below] = count, count - needs(len(s), below, percent)
                    sigs.append(sig)
                    at.append(np.full(len(sig), 2 * k + below, np.uint16))
                    held += len(sig)
                facts[-1][3] = int(min(facts[-1][6:]) < 0)
                if held >= most or len(sets) >= 32_000:
                    yield flush()
                    held = 0
        yield flush()

    return docs.mapInArrow(run, PACKED)


LISTS = "doc_id bigint, n bigint, fp bigint, weak bigint, own bigint, low bigint, own_spare bigint, low_spare bigint, list bigint, chunk int, length bigint, weight bigint, members array<bigint>, below array<boolean>"


def index(packed: DataFrame) -> DataFrame:
    """Documents' facts, and the lists of sets that share a signature (equal lists of a range once).

    A list is rows of up to CHUNK members each; its number is a hash of all members.
    """

    def run(group: pa.Table) -> pa.Table:
        def column(name: str, kind) -> list[np.ndarray]:
            return [np.frombuffer(x, kind) for x in group.column(name).to_pylist()]

        facts = np.concatenate(column("facts", np.int64)).reshape(-1, len(FACTS))
        fps, at = column("fps", np.int64), column("at", np.uint16)
        first = np.cumsum([0] + [len(x) for x in fps])
        steps = (x.reshape(4, -1).T.copy().view(np.uint32).ravel() for x in column("sigs", np.uint8))
        sig = np.concatenate([np.cumsum(x, dtype=np.uint64) for x in steps])
        known, back = np.unique(np.concatenate(fps), return_inverse=True)
        # signature, set and scheme in one sortable number; a set counts once per signature and scheme
        key = np.concatenate([(back[(a >> 1).astype(np.int64) + f] << 1).astype(np.uint64) | (a & 1) for a, f in zip(at, first)])
        key = np.unique((sig << np.uint64(32)) | key)
        sig, who, below = key >> np.uint64(32), ((key & LOW) >> np.uint64(1)).astype(np.int64), (key & np.uint64(1)).astype(bool)
        starts = np.flatnonzero(np.r_[True, sig[1:] != sig[:-1]]) if len(sig) else np.empty(0, np.int64)
        lengths = np.diff(np.r_[starts, len(sig)])
        # every pair has the scheme of its smaller set's band, so a list without such a set is of no use
        shared = (lengths > 1) & (np.add.reduceat(~below, starts) > 0) if len(sig) else lengths > 1
        code = np.empty(0, np.uint64)
        if shared.any():
            with np.errstate(over="ignore"):
                code = mix64(np.add.reduceat(mix64(known[who].view(np.uint64) + below), starts) + lengths.astype(np.uint64))[shared]
        starts, lengths = starts[shared], lengths[shared]
        weight = 1 + (sig[starts] & np.uint64(1)).astype(np.int64)
        code, pick, back = np.unique(code, return_index=True, return_inverse=True)
        weight = np.bincount(back, weight, len(code)).astype(np.int64)
        starts, lengths = starts[pick], lengths[pick]
        # rows of up to CHUNK members
        several = -(-lengths // CHUNK)
        of = np.repeat(np.arange(len(code)), several)
        chunk = np.arange(len(of)) - np.repeat(np.cumsum(several) - several, several)
        size = np.minimum(CHUNK, lengths[of] - chunk * CHUNK)
        ends = np.cumsum(size)
        take = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[of] + chunk * CHUNK - (ends - size), size)
        offsets = pa.array(np.r_[0, ends], pa.int32())
        values = {
            "list": pa.array(code.view(np.int64)[of]), "chunk": pa.array(chunk, pa.int32()), "length": pa.array(lengths[of]), "weight": pa.array(weight[of]),
            "members": pa.ListArray.from_arrays(offsets, pa.array(known[who[take]])), "below": pa.ListArray.from_arrays(offsets, pa.array(below[take])),
        }
        columns = {c: pa.concat_arrays([pa.array(facts[:, j]), pa.nulls(len(of), pa.int64())]) for j, c in enumerate(FACTS)}
        columns |= {c: pa.concat_arrays([pa.nulls(len(facts), x.type), x]) for c, x in values.items()}
        return pa.table(columns)

    return packed.groupBy("bucket").applyInArrow(run, LISTS)


def verify(pairs: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int, rows: int) -> DataFrame:
    """Of pairs (u, v) of fingerprints those whose sets are linked. `reps`: (fp, doc_id); `rows`: number of pairs."""
    spark = pairs.sparkSession
    blocks = max(tasks_for(spark), rows // 2000)
    busy = pairs.groupBy("u").count().select("u", F.ceil(F.col("count") / 2000).cast("int").alias("parts"))
    parts = pairs.join(busy, "u").withColumn("block", F.pmod(F.xxhash64("u", F.pmod(F.xxhash64("v"), F.col("parts"))), F.lit(blocks)).cast("int"))
    parts = materialize(parts.select("block", "u", "v"), "pairs")
    wanted = materialize(parts.select("block", F.explode(F.array("u", "v")).alias("fp")).distinct(), "wanted")
    chosen = materialize(wanted.join(reps, "fp"), "chosen")  # with the blocks, so that a text is shuffled once
    texts = docs.join(near(chosen), "doc_id").select("block", "fp", "text")

    def check(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hashes, sets = WordHashes(), {}
        for fp, text in zip(left["fp"], left["text"]):
            s = shingle_set(text, hashes, n)
            if fingerprint(s) == fp:  # a repeated id may bring another text
                sets[fp] = s
        keep = []
        for u, v in zip(right["u"], right["v"]):
            a, b = sets[u], sets[v]
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= percent * (len(a) + len(b) - both))
        return right.loc[np.array(keep, bool), ["u", "v"]]

    return texts.groupBy("block").cogroup(parts.groupBy("block")).applyInPandas(check, "u bigint, v bigint")


def sharing(rows: pd.DataFrame, percent: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Of the asking sets of a block each with (its fingerprint, root, fingerprints, roots) of the sets that may be linked to it.

    Two sets may be if they share so many signatures, with what both may share in lists left out,
    that the tokens in which they then differ can be as few as a link allows.
    """
    q, t = rows[rows["asks"]].sort_values("fp"), rows[~rows["asks"]]
    key, who = np.unique(np.stack([t["fp"].to_numpy(), t["below"].to_numpy().astype(np.int64)], 1), axis=0, return_inverse=True)
    who = who.ravel()
    first = np.zeros(len(key), np.int64)
    first[who] = np.arange(len(t))
    size, count, spare, root, below = (t[c].to_numpy()[first] for c in ("size", "count", "spare", "root", "below"))
    fp = key[:, 0]
    names, lists = np.unique(t["list"].to_numpy(), return_inverse=True)
    by_list = np.argsort(lists, kind="stable")
    start = np.searchsorted(lists[by_list], np.arange(len(names) + 1))
    asked = np.searchsorted(names, q["list"].to_numpy())
    q_fp, q_weight, q_size, q_count, q_spare, q_root = (q[c].to_numpy() for c in ("fp", "weight", "size", "count", "spare", "root"))
    cut = np.flatnonzero(np.r_[True, q_fp[1:] != q_fp[:-1]]) if len(q) else np.empty(0, np.int64)
    for a, z in zip(cut.tolist(), [*cut[1:].tolist(), len(q)]):
        # every list of an asking set is here, but perhaps none of its members
        spans = [by_list[start[k] : start[k + 1]] if k < len(names) and names[k] == x else by_list[:0] for k, x in zip(asked[a:z].tolist(), q["list"].to_numpy()[a:z].tolist())]
        shared = np.bincount(who[np.concatenate(spans)], np.repeat(q_weight[a:z], [len(x) for x in spans]), len(key))
        most = (100 - percent) * (q_size[a] + size) // (100 + percent)  # tokens in which a linked pair may differ
        beyond = shared + np.maximum(spare, q_spare[a])
        ok = (shared > 0) & (beyond >= q_count[a] - most) & (beyond >= count - most) & (root != q_root[a])
        ok &= np.where(below, size > q_size[a], fp > q_fp[a]) & (100 * np.minimum(size, q_size[a]) >= percent * np.maximum(size, q_size[a]))
        if ok.any():
            order = np.flatnonzero(ok)[np.argsort(-shared[ok], kind="stable")]
            yield int(q_fp[a]), int(q_root[a]), fp[order], root[order]


def blocks_of(rows: DataFrame) -> DataFrame:
    """Memberships of open lists by block (part, slice): those of sets that ask, and those of sets that are asked.

    Sets with one head are dealt to a part, to several if they are many. A part's sets ask the lists
    that they are in; the members of these are dealt to slices of bounded size by head, so that a list
    lies in few of them. A membership asks only in slices that hold a member of its list, and all of an
    asked set's memberships in a part are in one slice, so what two sets share meets in one block.
    """
    parts = max(1, math.ceil(rows.count() / BLOCK_ROWS))
    many = rows.groupBy("head").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("split"))
    dealt = lambda split, n: F.pmod(F.xxhash64("head", F.pmod(F.xxhash64("fp"), split)), n).cast("int")
    facts = ("list", "weight", "fp", "size", "below", "count", "spare", "root")
    homes = materialize(rows.join(many, "head").select("head", *facts, dealt(F.col("split"), F.lit(parts)).alias("part")), "homes")
    ask = homes.where("NOT below").drop("head")
    told = materialize(homes.drop("part").join(ask.select("list", "part").distinct(), "list"), "told")
    number = F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int")
    # a row per part, and one per head of more rows than a block has: a number per BLOCK_ROWS memberships
    slices = F.broadcast(told.groupBy("part").agg(number.alias("slices")))
    wide = F.broadcast(told.groupBy("part", "head").agg(number.alias("wide")).where("wide > 1"))
    told = told.join(slices, "part").join(wide, ["part", "head"], "left").withColumn("slice", dealt(F.coalesce("wide", F.lit(1)), F.col("slices")))
    ask = ask.join(told.select("part", "slice", "list").distinct(), ["part", "list"])
    block = ("part", "slice")
    return told.select(*block, *facts, F.lit(False).alias("asks")).unionByName(ask.select(*block, *facts, F.lit(True).alias("asks")))


def settle(rows: DataFrame, reps: DataFrame, docs: DataFrame, n: int, percent: int) -> DataFrame:
    """Links between components among sets of open lists; `rows` are memberships.

    A first pass over the blocks names the sets that share enough with another component; the second
    gets the texts of these alone, compares exactly and emits links.
    """
    block = ("part", "slice")
    blocks = materialize(blocks_of(rows), "blocks")

    def screen(key: tuple, right: pd.DataFrame) -> pd.DataFrame:
        found: set[int] = set()
        for u, _, others, _ in sharing(right, percent):
            found.add(u)
            found.update(others.tolist())
        return pd.DataFrame({"part": key[0], "slice": key[1], "fp": np.fromiter(found, np.int64, len(found))}, columns=["part", "slice", "fp"])

    able = materialize(blocks.groupBy(*block).applyInPandas(screen, "part int, slice int, fp bigint"), "able")
    chosen = materialize(able.join(reps, "fp"), "chosen")  # with the blocks, so that a text is shuffled once
    texts = docs.join(near(chosen), "doc_id").select(*block, "fp", "text")
    rest = blocks.join(able, [*block, "fp"], "left_semi")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        hashes, sets, out = WordHashes(), {}, []
        for fp, text in zip(left["fp"].tolist(), left["text"]):
            s = shingle_set(text, hashes, n)
            if fingerprint(s) == fp:
                sets[fp] = s
        parent = {x: x for x in right["root"].unique().tolist()}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            return x

        for u, root, others, roots in sharing(right, percent):
            for v, other in zip(others.tolist(), roots.tolist()):
                a, b = find(root), find(other)
                if a != b:
                    x, y = sets[u], sets[v]
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    if 100 * both >= percent * (len(x) + len(y) - both):
                        parent[a] = b
                        out.append((u, v))
        return pd.DataFrame(out, columns=["u", "v"]).astype("int64")

    return texts.groupBy(*block).cogroup(rest.groupBy(*block)).applyInPandas(run, "u bigint, v bigint")


def weak_pairs(facts: DataFrame, docs: DataFrame, n: int, fits) -> DataFrame:
    """Pairs that share a token and have a weak set in them; nearly always there is no such set."""
    weak = facts.where("weak = 1").select("fp").distinct()
    if weak.isEmpty():
        return weak.where("false").select(F.col("fp").alias("u"), F.col("fp").alias("v"))  # rows made by the driver would start Python workers of another kind

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for item in batch.column(1):
                s = shingle_set(item.as_py(), hashes, n)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), fingerprint(s))), pa.array(np.full(len(s), len(s), np.int32)), pa.array(s.view(np.int64))], names=["fp", "size", "token"])

    tokens = docs.mapInArrow(run, "fp bigint, size int, token bigint").distinct()
    left = materialize(tokens.join(near(weak), "fp").select(F.col("fp").alias("fp_u"), F.col("size").alias("size_u"), "token"), "weak-tokens")
    theirs = near(materialize(left.select("token").distinct(), "tokens"))  # of all other sets only the tokens of weak ones are shuffled
    right = tokens.join(theirs, "token", "left_semi").select(F.col("fp").alias("fp_v"), F.col("size").alias("size_v"), "token")
    both = left.join(right, "token").where("fp_u <> fp_v").where(fits)
    return both.select(F.least("fp_u", "fp_v").alias("u"), F.greatest("fp_u", "fp_v").alias("v")).distinct()


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 75, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id, n_shingles, component_id) for every document; see the module's text."""
    spark = docs.sparkSession
    docs = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col(text_col).alias("text"))
    buckets = max(tasks_for(spark), math.ceil(text_bytes(docs) / BUCKET_BYTES))
    found = materialize(index(scan(docs, n, percent, buckets)), "lists")
    facts = found.where("list IS NULL").select(*FACTS)
    sets = facts.where("n > 0").groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("size"), *(F.max(c).alias(c) for c in FACTS[4:]))
    sets = materialize(sets, "sets")
    reps = sets.select("fp", "doc_id")
    lists = found.where("list IS NOT NULL").groupBy("list", "chunk").agg(F.sum("weight").alias("weight"), *(F.first(c).alias(c) for c in ("length", "members", "below")))
    fits = F.expr(f"100 * least(size_u, size_v) >= {percent} * greatest(size_u, size_v)")

    # first round: each set with the head of its lists that it shares most signatures with; the head
    # of a list is the member with the most and longest lists, such as the source of many near copies
    member = F.explode(F.arrays_zip(F.col("members").alias("fp"), F.col("below").alias("below"))).alias("x")
    rows = lists.select("list", "weight", "length", member).select("list", "weight", "length", "x.fp", "x.below")
    by_scheme = [F.when(F.col("below"), F.col(a)).otherwise(F.col(b)).alias(c) for a, b, c in (("low", "own", "count"), ("low_spare", "own_spare", "spare"))]
    rank = F.sum(F.col("weight") * F.col("length")).over(Window.partitionBy("fp"))  # a set's lists are bounded by its text
    rows = rows.join(sets, "fp").select("list", "weight", "length", "fp", "below", "size", *by_scheme, rank.alias("rank"))
    rows = materialize(rows, "members")
    of = lambda x: [F.col(c).alias(f"{c}_{x}") for c in ("size", "below", "count")]
    heads = rows.groupBy("list").agg(F.max_by(F.struct(F.col("fp").alias("u"), *of("u")), F.struct("rank", "fp")).alias("h")).select("list", "h.*")
    star = rows.select("list", "weight", F.col("fp").alias("v"), *of("v")).join(heads, "list").where("u <> v").where(fits)
    star = star.groupBy("u", "v", "below_u", "below_v").agg(F.sum("weight").alias("weight"), *(F.first(f"{c}_{x}").alias(f"{c}_{x}") for c in ("size", "count") for x in "uv"))
    # linked sets share all contributions but those of the tokens in which they may differ
    may = F.expr(f"NOT (below_u AND below_v) AND weight >= greatest(count_u, count_v) - ({100 - percent} * (size_u + size_v)) div {100 + percent}")
    star = star.groupBy("v").agg(F.max_by("u", F.struct("weight", "u")).alias("head"), F.max_by("u", F.when(may, F.struct("weight", "u"))).alias("u"))
    star = materialize(star, "star")
    pairs = star.where("u IS NOT NULL").select("u", "v")
    edges = materialize(verify(pairs, reps, docs, n, percent, pairs.count()), "links")
    roots = components(edges)

    # second round: pairs in different components that share enough signatures of open lists
    rows = rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    open_ = rows.groupBy("list").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("list")
    left = materialize(rows.join(open_, "list").drop("rank"), "open-lists")
    # a pair shares its shortest common list with both sets' lists short of the longest that fit in the reserve
    longest = Window.partitionBy("fp", "below").orderBy(F.desc("length"), F.desc("list")).rowsBetween(Window.unboundedPreceding, 0)
    left = left.withColumn("dropped", F.sum("weight").over(longest)).where("dropped > spare").drop("dropped")
    left = left.join(star.select(F.col("v").alias("fp"), "head"), "fp", "left").withColumn("head", F.coalesce("head", "fp"))
    left = materialize(left, "heavy-lists")
    more = settle(left, reps, docs, n, percent)
    weak = materialize(weak_pairs(facts, docs, n, fits), "weak-pairs")
    if n_weak := weak.count():
        more = more.unionByName(verify(weak, reps, docs, n, percent, n_weak))
    more = materialize(more, "more-links")
    if not more.isEmpty():
        roots = components(edges.unionByName(more))
    named = facts.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    named = materialize(named, "named")
    least = named.where("n > 0").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    out = named.where("n > 0").join(least, "root").select("doc_id", "n", "component_id")
    out = out.unionByName(named.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    null = lambda c: F.nullif(F.col(c), F.lit(NULL_ID))
    return out.select(null("doc_id").alias(id_col), F.col("n").alias("n_shingles"), null("component_id").alias("component_id"))

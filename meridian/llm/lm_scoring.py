"""Language-model scores of texts: causal self-attention models over the pieces of a public tokenizer.

The first piece of a word is predicted from the first pieces of the words before it, its further
pieces and its end from its own pieces; each by a model of its own (`attention`). So a text's
probability is a product over all its pieces, and what a word holds beyond its first piece is scored
once for all its occurrences in a task.

1. Words of all texts are counted (each task counts, Spark adds up); the words' counts give those of the
   pieces. Both grow with the corpus.
2. All texts to be learned from become training windows: the first pieces of every text for the model
   between words, and for the one inside words the distinct words, each with the weight of its count. Windows are
   dealt to parts, one for each `part_bytes` of text or `WORDS_PART` words. A round trains the models in numpy on
   every part's share of windows for it from the same weights; the mean of the parts' weights starts the next. All
   rounds together take every window once; a small part is gone through again for at least `steps` batches a round.
3. Texts are cut into overlapping windows of a block of context and a block of scored positions, so
   that each piece is scored once; windows are scored in batches under a causal mask.

The base score adds log10((c + 0.5) / (N + 0.5 * (V + 1))) over a text's words and its end. Words among the
`head_words` most frequent are looked up in a table of that size, all others joined with the counts.

A-Z is lower-cased; words are `[^\\x20\\x09-\\x0D]+`, each cut into pieces with a space before it
(in slices of 400 characters). The score is the log10 probability of all pieces and the end.
A null or empty text has only its end. Rows whose `learn` is null are not learned from. Repeated rows
count as often as they come and get equal scores. Without any text to learn from, base scores come from
N = V = 0 and all pieces are alike. An empty table gives no rows. Texts are read whole at any length; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meridian.llm.attention import NONE, Lm, windows
from meridian.llm.common import ASCII_LOWER, ascii_words, materialize, text_bytes

#: Words that a task counts before it sends counts on; windows and words scored at a time; words that a task knows.
COUNTED, BATCH, GROUP, KNOWN = 1_000_000, 2048, 20_000, 1_000_000
#: Blocks of both models: words behind each other, pieces in a word. Symbols (a multiple of BETWEEN) of a row of a text to train on.
BETWEEN, WITHIN, RUN = 8, 4, 4096
#: Distinct words for a training part.
WORDS_PART = 300_000
WORD_BYTES = 64


@lru_cache(1)
def vocabulary(path: str, pattern: str):
    """The tokenizer of a rank file, and how many pieces it has; that number stands for an end."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def pieces_of(word: bytes, encoder) -> list[int]:
    text = word.decode("utf-8", "surrogatepass")
    if len(text) < 400:
        return encoder.encode_ordinary(" " + text)
    return [i for at in range(0, len(text), 400) for i in encoder.encode_ordinary(text[at : at + 400] if at else " " + text[:400])]


def word_windows(words: list[list[int]], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows inside words (pieces), up to their end, and the word of each."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    blocks = -(-sizes // WITHIN)
    room = (blocks + 1) * WITHIN + 1
    start = np.cumsum(room) - room
    line = np.full(int(room.sum()), NONE, np.uint16)
    line[np.repeat(start + WITHIN - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())] = np.fromiter((i for w in words for i in w), np.uint16, int(sizes.sum()))
    line[start + WITHIN + sizes] = end
    owner = np.repeat(np.arange(len(words)), blocks)
    block = np.arange(len(owner)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return line[(start[owner] + WITHIN * block)[:, None] + np.arange(2 * WITHIN + 1)], owner


class Places(dict):
    """Word -> its number; words asked for the first time get the next one and are listed in `new`."""

    def __init__(self):
        super().__init__()
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        self.new.append(word)
        place = self[word] = len(self)
        return place


def word_counts(texts: DataFrame) -> DataFrame:
    """Rows (word, c, n): occurrences in texts to learn from, and in all; the empty word is the end of a text."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {True: Counter(), False: Counter()}

        def ship() -> pa.RecordBatch:
            words = list(counts[True].keys() | counts[False].keys())
            c = [counts[True][w] for w in words]
            n = [a + counts[False][w] for a, w in zip(c, words)]
            for x in counts.values():
                x.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(c, pa.int64()), pa.array(n, pa.int64())], names=["word", "c", "n"])

        for batch in batches:
            for item, learn in zip(batch.column(0), batch.column(1).to_pylist()):
                mine = counts[bool(learn)]
                mine.update(ascii_words(item.as_py(), lower=True))
                mine[b""] += 1
                if len(counts[True]) + len(counts[False]) >= COUNTED:
                    yield ship()
        yield ship()

    found = texts.select("text", "learn").mapInArrow(count, "word binary, c bigint, n bigint")
    return found.groupBy("word").agg(F.sum("c").alias("c"), F.sum("n").alias("n"))


def piece_counts(counts: DataFrame, path: str, pattern: str, ends: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences in the texts to learn from: first pieces and ends of texts; all pieces; further pieces and ends of words."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = vocabulary(path, pattern)
        first, more = np.zeros(end + 1, np.int64), np.zeros(end + 1, np.int64)
        for batch in batches:
            for word, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = pieces_of(word, encoder)
                first[ids[0]] += c
                for i in ids[1:]:
                    more[i] += c
        some = np.flatnonzero(first + more)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(first[some]), pa.array(more[some])], names=["piece", "first", "more"])

    words = counts.where((F.col("c") > 0) & (F.octet_length("word") > 0)).select("word", "c")
    rows = words.mapInArrow(count, "piece bigint, first bigint, more bigint").groupBy("piece").agg(F.sum("first").alias("first"), F.sum("more").alias("more")).collect()
    end = vocabulary(path, pattern)[1]
    first, more = np.zeros(end + 1, np.int64), np.zeros(end + 1, np.int64)
    for piece, a, b in rows:  # at most a row a piece
        first[piece], more[piece] = a, b
    every = first + more
    more[end], first[end] = first.sum(), ends
    return first, every, more


def frequent_words(counts: DataFrame, most: int) -> dict[bytes, int]:
    """Words (of bounded length) above some count, at most `most` of them, with their c."""
    level = F.floor(F.log2("n") * 8).cast("int")
    short = counts.where((F.octet_length("word") <= WORD_BYTES) & (F.octet_length("word") > 0)).withColumn("level", level)
    rows = sorted(short.groupBy("level").agg(F.count(F.lit(1)).alias("k")).collect(), reverse=True)  # 8 levels a power of two
    least, have = 1 << 30, 0
    for step, k in rows:
        have += k
        if have > most:
            break
        least = step
    return {bytes(w): c for w, c in short.where(F.col("level") >= least).select("word", "c").collect()}


class First(dict):
    """Word -> its first piece."""

    def __init__(self, encoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, word: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        piece = self[word] = pieces_of(word, self.encoder)[0]
        return piece


DEALT = "part int, line binary, weight binary"


def dealt_rows(part: list[int], line: list[bytes], weight: list[bytes | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(line, pa.binary()), pa.array(weight, pa.binary())], names=["part", "line", "weight"])


def training_lines(texts: DataFrame, path: str, pattern: str, parts: int) -> DataFrame:
    """Rows (part, line, no weight): the first pieces of all texts to learn from, in runs dealt in turn.

    A run starts with 1 if the block before it, which is context alone, was put in front, else with 0.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encoder, end), turn = vocabulary(path, pattern), TaskContext.get().partitionId() * 7919
        first = First(encoder)
        for batch in batches:
            part, lines = [], []
            for item in batch.column(0):
                words = ascii_words(item.as_py(), lower=True)
                line = np.full(len(words) + 2, end, np.uint16)
                line[1:-1] = np.fromiter(map(first.__getitem__, words), np.uint16, len(words))
                for at in range(0, len(line) - 1, RUN):
                    turn += 1
                    part.append(turn % parts)
                    lines.append(np.append(np.uint16(at > 0), line[max(at - BETWEEN, 0) : at + RUN + 1]).tobytes())
            yield dealt_rows(part, lines, [None] * len(part))

    return texts.where("learn").select("text").mapInArrow(cut, DEALT)


def line_windows(lines: list[bytes], _: list) -> tuple[np.ndarray, None]:
    runs = (np.frombuffer(x, np.uint16) for x in lines)
    return np.concatenate([windows(x[1:], BETWEEN)[x[0] :] for x in runs]), None


def training_words(counts: DataFrame, path: str, pattern: str, parts: int, most: int) -> DataFrame:
    """Rows (part, line, weight): the windows inside all words to learn from, dealt in turn; their weights add up to the words' counts.

    A window weighs `most` at most; those of a more frequent word come several times.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (encoder, end), turn = vocabulary(path, pattern), TaskContext.get().partitionId() * 7919
        for batch in batches:
            if not batch.num_rows:
                continue
            c = batch.column(1).to_numpy()
            times = -(-c // most)
            z, owner = word_windows([pieces_of(w, encoder) for w in batch.column(0).to_pylist()], end)
            at = np.repeat(np.arange(len(z)), times[owner])
            weight = (c / times)[owner[at]].astype(np.float32)
            of = (turn + np.arange(len(at))) % parts
            turn += len(at)
            order = np.argsort(of, kind="stable")
            some, first = np.unique(of[order], return_index=True)
            groups = np.split(order, first[1:])
            yield dealt_rows(some.tolist(), [z[at[g]].tobytes() for g in groups], [weight[g].tobytes() for g in groups])

    return counts.where((F.col("c") > 0) & (F.octet_length("word") > 0)).select("word", "c").mapInArrow(cut, DEALT)


def inner_windows(lines: list[bytes], weights: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(lines), np.uint16).reshape(-1, 2 * WITHIN + 1), np.frombuffer(b"".join(weights), np.float32)


def trained(lm: Lm, dealt: DataFrame, unpack, parts: int, rounds: int, steps: int, batch: int, rate: float, seed: int) -> np.ndarray:
    """Weights after `rounds` rounds in which every part trains on its share of windows for that round, all of it.

    `unpack` makes windows and weights from the lines and weights of a part.
    The parts' weights are added up in pieces of bounded length, at most 256 parts at a time.
    """
    weights = lm.start(seed)
    if not lm.n_head:
        return weights
    slab = 1 << 15
    for turn in range(rounds):

        def fit(key: tuple, group: pa.Table) -> pa.Table:
            rows = sorted(zip(group.column("line").to_pylist(), group.column("weight").to_pylist()), key=lambda r: (r[0], r[1] or b""))  # one order, however rows arrive
            z, weight = unpack(*map(list, zip(*rows)))
            mine = slice(turn, None, rounds) if len(z) >= rounds * batch * steps // 2 else slice(None)
            z, weight = z[mine], None if weight is None else weight[mine]
            flat = lm.train(weights, z, max(steps, -(-len(z) // batch)), batch, rate / (1 + turn), seed + turn, weight)
            flat = np.append(flat, 1.0).astype(np.float64)
            at = range(0, len(flat), slab)
            return pa.table({"part": pa.array([key[0].as_py()] * len(at), pa.int32()), "slab": pa.array([k // slab for k in at], pa.int32()), "w": pa.array([flat[k : k + slab].tobytes() for k in at], pa.binary())})

        def add(key: tuple, group: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(x, np.float64) for x in sorted(group.column("w").to_pylist()))
            return pa.table({"part": pa.array([key[1].as_py()], pa.int32()), "slab": pa.array([key[0].as_py()], pa.int32()), "w": pa.array([total.tobytes()], pa.binary())})

        form = "part int, slab int, w binary"
        made, left = dealt.groupBy("part").applyInArrow(fit, form), parts
        while left > 1:
            left = -(-left // 256)
            made = made.groupBy("slab", F.floor(F.col("part") / 256).cast("int").alias("up")).applyInArrow(add, form)
        rows = {r["slab"]: np.frombuffer(r["w"], np.float64) for r in made.collect()}  # one sum of weights
        if not rows:
            return weights
        total = np.concatenate([rows[k] for k in sorted(rows)])
        weights = (total[:-1] / total[-1]).astype(np.float32)
    return weights


def lm_scores(
    docs: DataFrame,
    learn: Column,
    path: str,
    pattern: str,
    head_words: int = 200_000,
    part_bytes: int = 50_000_000,
    rounds: int = 3,
    steps: tuple[int, int] = (100, 300),
    batch: int = 512,
    rate: float = 0.03,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (id, n_tokens, n_known, train_tokens, base_score, score).

    `learn` says which rows are learned from; `steps` are the least batches a round of both models (between words, inside words); `path` and `pattern` are a rank file of a byte-level tokenizer and
    its pattern.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    counts = materialize(word_counts(texts), "words")
    one = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.when(F.col("c") > 0, 1)), F.coalesce(F.max(F.when(F.octet_length("word") == 0, F.col("c"))), F.lit(0))).first()
    total, distinct, ends = one
    below = np.log10(total + 0.5 * (distinct + 1))
    head = frequent_words(counts, head_words)

    first, every, more = piece_counts(counts, path, pattern, ends)
    between, within = Lm(BETWEEN, first, first, hidden=32), Lm(WITHIN, more, every)
    parts = max(1, round(text_bytes(docs, text_col) / part_bytes))
    lines = materialize(training_lines(texts, path, pattern, parts), "lines")
    w_between = trained(between, lines, line_windows, parts, rounds, steps[0], batch, rate, seed)
    parts = max(1, round(distinct / WORDS_PART))
    words = materialize(training_words(counts, path, pattern, parts, max(1, 4 * total // max(distinct, 1))), "inner-windows")
    w_within = trained(within, words, inner_windows, parts, rounds, steps[1], 2 * batch, rate, seed)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, end = vocabulary(path, pattern)
        models = [(lm, w := lm.views(flat), lm.tables(w)) for lm, flat in ((between, w_between), (within, w_within))]

        def logs(which: int, z: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
            """Log probabilities of windows, added up by owner."""
            (lm, w, tables), out = models[which], np.zeros(n)
            for at in range(0, len(z), BATCH):
                p = lm.log_probs(w, tables, *lm.inputs(z[at : at + BATCH])).sum(axis=1, dtype=np.float64)
                out += np.bincount(owner[at : at + BATCH], p, n)
            return out

        #: By word: its place in three arrays of its first piece, the log probability of the rest, and its c (-1: not in the head).
        place = Places()
        arrays = [np.zeros(0, np.uint16), np.zeros(0), np.zeros(0, np.int64)]

        def learn_words(new: list[bytes]) -> None:
            cut = [pieces_of(x, encoder) for x in new]
            z, owner = word_windows(cut, end)
            rest = logs(1, z, owner, len(new)) if new else np.zeros(0)
            c = np.fromiter((head.get(x, -1) for x in new), np.int64, len(new))
            for k, values in enumerate(([x[0] for x in cut], rest, c)):
                arrays[k] = np.append(arrays[k], np.asarray(values, arrays[k].dtype))

        def score_texts(texts: list[list[bytes]]) -> list[tuple]:
            places = [np.fromiter(map(place.__getitem__, words), np.int64, len(words)) for words in texts]
            learn_words(place.new)
            place.new = []
            found, held, owner = [], [], []
            for k, (words, at) in enumerate(zip(texts, places)):
                c = arrays[2][at]
                tail = [words[i] for i in np.flatnonzero(c < 0)]
                c = np.append(c[c >= 0], ends)
                found.append((len(words) + 1, int((c > 0).sum()), float((np.log10(c + 0.5) - below).sum()), tail, arrays[1][at].sum()))
                held.append(windows(np.concatenate([[end], arrays[0][at], [end]]).astype(np.uint16), BETWEEN))
                owner.append(np.full(len(held[-1]), k))
            first = logs(0, np.concatenate(held), np.concatenate(owner), len(texts))
            if len(place) > KNOWN:
                place.clear()
                arrays[:] = [x[:0] for x in arrays]
            return [(*row[:4], (row[4] + x) / np.log(10)) for row, x in zip(found, first.tolist())]

        for records in batches:
            rows, group, have = [], [], 0
            for item in records.column(1):
                group.append(ascii_words(item.as_py(), lower=True))
                have += len(group[-1])
                if have >= GROUP:
                    rows += score_texts(group)
                    group, have = [], 0
            rows += score_texts(group) if group else []
            a = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.binary()), pa.float64()]
            yield pa.RecordBatch.from_arrays([records.column(0), *(pa.array(x, t) for x, t in zip(a, kinds))], names=["id", "n_tokens", "n_known", "base_score", "tail", "score"])

    scored = texts.select("id", "text").mapInArrow(score, f"id {kind}, n_tokens bigint, n_known bigint, base_score double, tail array<binary>, score double")
    scored = materialize(scored.withColumn("row", F.monotonically_increasing_id()), "scored")  # numbers of written rows
    rare = scored.select("row", F.explode("tail").alias("word")).join(counts.select("word", "c"), "word")
    rare = rare.groupBy("row").agg(F.sum((F.col("c") > 0).cast("long")).alias("more"), F.sum(F.log10(F.col("c") + 0.5) - F.lit(float(below))).alias("rest"))
    every = scored.drop("tail").join(rare, "row", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return every.select(
        F.col("id").alias(id_col),
        "n_tokens",
        (F.col("n_known") + zero("more")).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("base_score") + zero("rest")).alias("base_score"),
        "score",
    )

"""Best-fit-decreasing packing of tokenised documents into fixed windows.

A document longer than a window is first cut into full windows and a rest. Best-fit decreasing
looks at nothing but lengths, so it runs on the histogram of piece lengths: at most `window` counts,
however many documents there are. A segment tree indexed by remaining capacity finds the tightest
open window; all windows with the same contents move through it together, as one class with a
multiplicity, and all pieces of one length are placed class by class exactly as one-by-one
placement would. The outcome is a list of runs - pieces number k to k+m of length L go to these
windows at this offset - whose size depends on the window size alone. Pieces are numbered within
their length by a count per (task, length) and a window over those counts, and look their run up.

Null and empty texts hold the end id alone (one token, one piece). Equal lengths are taken in task
order. Repeated rows are packed as often as they come. Columns besides the two named are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from meridian.llm.common import materialize

PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, part int, nth bigint"
SPECIAL = "<|endoftext|>"


class TokenIds:
    """Token ids as the `tokenizers` library gives them for a byte-level BPE file.

    The same vocabulary in rank form is encoded by tiktoken, which gives the same ids several times
    faster; texts that hold the special string, and those with runs (of spaces, say) that its pattern
    cannot step back over, go to the library of the file itself.
    """

    def __init__(self, json_file: str, ranks_file: str | None, pattern: str | None):
        from tokenizers import Tokenizer

        self.exact, self.fast = Tokenizer.from_file(json_file), None
        if ranks_file:
            import base64

            import tiktoken

            with open(ranks_file, "rb") as lines:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> np.ndarray:
        if self.fast is None or SPECIAL in text:
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        try:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        except ValueError:  # the pattern's stack is bounded
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


def pieces_of(docs: DataFrame, json_file: str, ranks_file: str | None, pattern: str | None, window: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """One row per piece, numbered from 0 within (task, length)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, part = None, TaskContext.get().partitionId()
        seen = np.zeros(window + 1, np.int64)
        for batch in batches:
            tokens = tokens or TokenIds(json_file, ranks_file, pattern)
            out: list[tuple] = []
            for row, text in zip(range(batch.num_rows), batch.column(1)):
                ids = np.append(tokens.encode(text.as_py() or ""), end_id).astype("<u4")
                for start in range(0, len(ids), window):
                    piece = ids[start : start + window]
                    out.append((row, start, len(piece), zlib.crc32(piece), len(ids), part, seen[len(piece)]))
                    seen[len(piece)] += 1
            rows, *cols = zip(*out) if out else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64()]
            arrays = [batch.column(0).take(pa.array(rows, pa.int64()))] + [pa.array(c, k) for c, k in zip(cols, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, names=[id_col, "start", "length", "ids_crc32", "doc_tokens", "part", "nth"])

    source = docs.select(id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, {PIECES}")


class CapacityTree:
    """Segment tree over capacities 0..size; finds the least capacity >= x that has open windows."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.used = [False] * (2 * self.leaves)

    def set(self, capacity: int, used: bool) -> None:
        at = capacity + self.leaves
        self.used[at] = used
        while at > 1:
            at //= 2
            used = self.used[2 * at] or self.used[2 * at + 1]
            if self.used[at] == used:
                return
            self.used[at] = used

    def tightest(self, x: int) -> int | None:
        at = x + self.leaves
        if self.used[at]:
            return x
        while at > 1:
            if at % 2 == 0 and self.used[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.used[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], window: int) -> np.ndarray:
    """Runs (length, first, windows, each, first_window, offset) that place all pieces.

    Pieces number `first` to `first + windows * each` of `length` go, `each` to a window, into
    consecutive windows from `first_window` on, one behind the other from `offset` on.
    """
    tree = CapacityTree(window)
    open_: dict[int, list[tuple[int, int]]] = {}  # capacity -> classes (first window, windows)
    runs, opened = [], 0

    def put(capacity: int, first: int, n: int) -> None:
        if n and capacity:
            open_.setdefault(capacity, []).append((first, n))
            tree.set(capacity, True)

    for length in sorted((x for x, n in counts.items() if n), reverse=True):
        left, nth = counts[length], 0
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                capacity, first = window, opened
                n = -(-left // (window // length))
                opened += n
            else:
                first, n = open_[capacity].pop()
                if not open_[capacity]:
                    tree.set(capacity, False)
            each = capacity // length
            whole = min(n, left // each)
            if whole:
                runs.append((length, nth, whole, each, first, window - capacity))
                nth, left = nth + whole * each, left - whole * each
                put(capacity - each * length, first, whole)
                first, n = first + whole, n - whole
            if n and left:
                runs.append((length, nth, 1, left, first, window - capacity))
                put(capacity - left * length, first, 1)
                first, n, left = first + 1, n - 1, 0
            put(capacity, first, n)
    return np.array(runs, np.int64).reshape(-1, 6)


def pack(
    docs: DataFrame,
    json_file: str,
    ranks_file: str | None = None,
    pattern: str | None = None,
    window: int = 2048,
    end_id: int = 1,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per piece with its window (`sequence_id`) and place (`offset`); see the module's text."""
    pieces = materialize(pieces_of(docs, json_file, ranks_file, pattern, window, end_id, id_col, text_col), "pieces")
    by_part = pieces.groupBy("length", "part").count()
    counts = {r["length"]: r["n"] for r in by_part.groupBy("length").agg(F.sum("count").alias("n")).collect()}  # at most `window` rows
    runs = best_fit_decreasing(counts, window)
    order = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = by_part.select("length", "part", F.coalesce(F.sum("count").over(order), F.lit(0)).alias("before"))

    # runs of a length are consecutive, so (length, number) finds its run by one binary search
    base = np.int64(1) << np.int64(48)
    order_ = np.lexsort((runs[:, 1], runs[:, 0]))
    runs = runs[order_]
    keys = runs[:, 0] * base + runs[:, 1]
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, nth = batch["length"].to_numpy(), batch["nth"].to_numpy()
            run = runs[np.searchsorted(keys, length * base + nth, side="right") - 1]
            k = nth - run[:, 1]
            sequence, slot = run[:, 4] + k // np.maximum(run[:, 3], 1), k % np.maximum(run[:, 3], 1)
            yield pa.RecordBatch.from_arrays([*batch.select(names[:5]).columns, pa.array(sequence), pa.array(run[:, 5] + slot * length)], names=names)

    kind = pieces.schema[id_col].dataType.simpleString()
    numbered = pieces.join(before, ["length", "part"]).select(id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("nth") + F.col("before")).alias("nth"))
    return numbered.mapInArrow(place, f"`{id_col}` {kind}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint")

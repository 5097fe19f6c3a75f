"""Benchmark decontamination by template canonicalisation.

Texts become sequences of canonical words: lower-cased, without punctuation at the ends, with
numbers, units and names (capitalised words inside a sentence) replaced by typed placeholders.
Windows of `width` canonical words are hash-joined between documents and benchmark items, so a
question with other numbers or names still matches its template. Matches are grouped along
diagonals (document position minus item position); a diagonal counts if its slots are consistent:
each surface form of the item stands for one form in the document, and the reverse. A document is
contaminated by an item if consistent windows cover at least `min_share` of the item's windows.

Names are told by their capitals, so templates miss copies in capitals, in lower case or in title
case. Windows with names are therefore also matched literally: all words case-folded, names as
words, numbers and units as slots. On a diagonal whose slots are not consistent, those literal
windows still count whose slots have the item's own forms. A window counts by either kind.

The scan of the documents emits only windows that hit a bit table of the benchmark's hashes (of
fixed size, whatever the benchmark's); Spark joins these with the benchmark's windows by full hash.
Items with fewer than `width` canonical words match as a whole if they have `least_words`; shorter
ones, null and empty texts contaminate nothing. Repeated document ids are judged together, repeated
items each. Columns not named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import materialize, window_hashes

#: Units of measure that take a placeholder.
UNITS = frozenset("kg km cm mm mg ml lb lbs oz mph usd eur dollars dollar euros euro cents percent hours hour minutes minute seconds days weeks months years miles mile metres meters grams litres liters degrees celsius".split())
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*%?(st|nd|rd|th)?$")
NUMBER_UNIT = re.compile(r"[+-]?\d[\d.,]*[a-z]{1,3}$")
LINE = b"\x01"
#: Low bits of a word's value.
NAME_LIKE, ENDS, SLOT, WORD = 1, 2, 4, 8
FLAGS = np.uint64(15)
#: Bits of the table that the scan looks windows up in (8 MB).
TABLE_BITS = 26
#: Characters of texts whose windows are hashed at once, about; a longer text is taken alone.
TOGETHER = 60_000


def type_hash(name: str) -> int:
    return xxhash.xxh3_64_intdigest(f"<{name}>".encode()) & ~15


NAME_VALUE = np.uint64(type_hash("name"))
TYPE_NUMBER, TYPE_QUANTITY, TYPE_UNIT = map(type_hash, ("number", "quantity", "unit"))
ASCII_UNITS = frozenset(x.encode() for x in UNITS)
ASCII_SIGNS = bytes(c for c in range(128) if not chr(c).isalnum())
#: Signs that may stand before a name.
OPENING = b"\"'([{*_"


def folded(s: str) -> str:
    """The same for every way to write a word in capitals or small letters (sharp s, dotless i, final sigma)."""
    return s.upper().casefold()


def surface(word: bytes) -> str:
    """The word in lower case without signs at its ends."""
    s = word.decode("utf-8", "replace").lower()
    a, b = 0, len(s)
    while a < b and not s[a].isalnum():
        a += 1
    while b > a and not s[b - 1].isalnum():
        b -= 1
    return s[a:b]


class Canon(dict):
    """Word (bytes) -> canonical hash in the upper bits and flags in the lower four."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= 300_000:
            self.clear()
        value = ENDS if word == LINE or word[-1:] in b".!?:" else 0
        if word.isascii() and (plain := word.strip(ASCII_SIGNS)).isalpha():  # most words, without a detour by str
            low, raw = plain.lower(), word.lstrip(OPENING)
            value |= WORD | (TYPE_UNIT | SLOT if low in ASCII_UNITS else xxhash.xxh3_64_intdigest(low) & ~15)
            if not value & SLOT and raw[:1].isupper() and not (len(low) > 1 and raw.isupper()):
                value |= NAME_LIKE
        elif s := surface(word):
            raw = word.decode("utf-8", "replace").lstrip(OPENING.decode())
            value |= WORD
            if not s[0].isalpha() and NUMBER.match(s):
                value |= TYPE_NUMBER | SLOT
            elif not s[0].isalpha() and NUMBER_UNIT.match(s):
                value |= TYPE_QUANTITY | SLOT
            elif s in UNITS:
                value |= TYPE_UNIT | SLOT
            else:
                value |= xxhash.xxh3_64_intdigest(folded(s).encode("utf-8", "surrogatepass")) & ~15
                if raw[:1].isupper() and not (len(s) > 1 and raw.isupper()):
                    value |= NAME_LIKE
        self[word] = value
        return value


class Canonical(NamedTuple):
    """Texts one behind the other: their words, and of those that count place, text, hash and kind."""

    words: list[bytes]
    place: np.ndarray
    text: np.ndarray
    literal: np.ndarray
    name: np.ndarray
    typed: np.ndarray


def canonical(texts: list[str | None], canon: Canon) -> Canonical:
    words: list[bytes] = []
    starts = []
    for text in texts:
        starts.append(len(words))
        if text:
            words += text.encode("utf-8", "surrogatepass").replace(b"\n", b" \x01 ").split()
    sizes = np.diff([*starts, len(words)])
    value = np.fromiter(map(canon.__getitem__, words), np.uint64, len(words))
    flags = (value & FLAGS).astype(np.uint8)
    opens = np.ones(len(words), bool)
    opens[1:] = (flags[:-1] & ENDS) > 0
    opens[np.array(starts)[sizes > 0]] = True
    name = ((flags & NAME_LIKE) > 0) & ~opens
    place = np.flatnonzero(flags & WORD)
    return Canonical(words, place, np.repeat(np.arange(len(texts)), sizes)[place], value[place] & ~FLAGS, name[place], (flags[place] & SLOT) > 0)


def in_table(table: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether hashes hit a bit table (lowest bit first); it stays packed, since each task holds it."""
    at = (h >> np.uint64(64 - TABLE_BITS)).astype(np.int64)
    return (table[at >> 3] >> (at & 7).astype(np.uint8)) & 1 > 0


#: Kinds of windows; one without names is of both.
TEMPLATE, LITERAL = 1, 2
WINDOW = "hash bigint, pos int, slots array<string>, kind int"


def windows_of(source: DataFrame, widths: list[int], id_kind: str, table: np.ndarray | None, whole: bool) -> DataFrame:
    """Windows (id, hash, pos, slots, kind) of rows (id, text).

    With a bit table: windows of all widths that hit it. `whole`: only the width that fits the text
    (the first, or all words where there are fewer), and the number of the row's positions as `n`.
    """

    def windows(texts: list[str | None], first: int, canon: Canon) -> list[tuple]:
        words, place, text, literal, name, typed = canonical(texts, canon)
        sizes = np.bincount(text, minlength=len(texts))
        ends = np.cumsum(sizes)
        some = bool(name.any())
        template, slotted = (np.where(name, NAME_VALUE, literal), name | typed) if some else (literal, typed)
        before = np.concatenate(([0], np.cumsum(name)))
        rows = []
        for width in [min(widths[0], len(place))] if whole else widths:
            m = len(place) - width + 1
            if m <= 0 or width == 0:
                continue
            inside = np.arange(width, len(place) + 1) <= ends[text[:m]]  # within one text
            named = before[width:] > before[:m]
            for kind, hashes, is_slot in ((TEMPLATE, template, slotted), (LITERAL, literal, typed))[: 2 if some else 1]:
                h = window_hashes(hashes, width) ^ np.uint64(width)
                hit = inside if table is None else inside & in_table(table, h)
                for p in np.flatnonzero(hit if kind == TEMPLATE else hit & named).tolist():
                    k, n = int(text[p]), int(sizes[text[p]])
                    slots = [surface(words[place[p + i]]) for i in np.flatnonzero(is_slot[p : p + width]).tolist()]
                    rows.append((first + k, int(h[p].astype(np.int64)), p - int(ends[k]) + n, slots, kind if named[p] else TEMPLATE | LITERAL, n - width + 1, n))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canon = Canon()
        for batch in batches:
            rows: list[tuple] = []
            texts: list[str | None] = []
            held = first = 0
            for k, item in enumerate(batch.column(1)):
                texts.append(item.as_py())
                held += len(texts[-1] or "")
                if whole or held >= TOGETHER:
                    rows += windows(texts, first, canon)
                    texts, held, first = [], 0, k + 1
            if texts:
                rows += windows(texts, first, canon)
            cols = list(zip(*rows)) if rows else [()] * 7
            kinds = [pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(cols[0], pa.int64())), *(pa.array(c, t) for c, t in zip(cols[1:], kinds))], names=["id", "hash", "pos", "slots", "kind", "n", "n_words"])

    return source.mapInArrow(run, f"id {id_kind}, {WINDOW}, n int, n_words int")


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    width: int = 8,
    min_share: float = 0.5,
    least_words: int = 4,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """Pairs (id, item id, n_windows, n_matched, share) of contaminated documents; see the module's text."""
    items = benchmark.select(F.col(item_id_col).alias("id"), F.col(item_text_col).alias("text"))
    kinds = items.schema["id"].dataType.simpleString(), docs.schema[id_col].dataType.simpleString()
    known = materialize(windows_of(items, [width], kinds[0], None, True).where(F.col("n_words") >= least_words), "item-windows")
    widths = sorted({width, *(r[0] for r in known.where(F.col("n_words") < width).select("n_words").distinct().collect())}, reverse=True)  # at most `width`

    bits = F.shiftrightunsigned("hash", 64 - TABLE_BITS)
    packed = known.groupBy((bits / 64).cast("int").alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, CAST(pmod(shiftrightunsigned(hash, {64 - TABLE_BITS}), 64) AS INT))")).alias("bits"))
    table = np.zeros(1 << (TABLE_BITS - 6), np.int64)
    for r in packed.toLocalIterator():  # at most 2 ** 20 rows
        table[r["at"]] = r["bits"]

    hits = windows_of(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), widths, kinds[1], table.view(np.uint8), False)
    item = known.select("hash", F.col("id").alias("item"), F.col("pos").alias("item_pos"), F.col("slots").alias("item_slots"), F.col("kind").alias("item_kind"), F.col("n").alias("n_windows"))
    matches = hits.select("id", "hash", "pos", "slots", "kind").join(item, "hash").where(F.size("slots") == F.size("item_slots"))
    forms, kind = F.arrays_zip(F.col("item_slots").alias("a"), F.col("slots").alias("b")), F.col("kind").bitwiseAND(F.col("item_kind"))
    of = lambda k, c: F.collect_set(F.when(kind.bitwiseAND(F.lit(k)) > 0, c))
    diagonal = matches.groupBy("id", "item", "n_windows", (F.col("pos") - F.col("item_pos")).alias("diagonal")).agg(
        *(of(k, F.col("item_pos")).alias(f"at_{k}") for k in (TEMPLATE, LITERAL)),
        *(F.array_distinct(F.flatten(of(k, forms))).alias(f"forms_{k}") for k in (TEMPLATE, LITERAL)),
        of(LITERAL, F.when(F.col("slots") == F.col("item_slots"), F.col("item_pos"))).alias("same"),
    )
    fits = lambda k: (F.size(f"forms_{k}") == F.size(F.array_distinct(f"forms_{k}.a"))) & (F.size(f"forms_{k}") == F.size(F.array_distinct(f"forms_{k}.b")))
    none = F.array().cast("array<int>")
    at = F.array_union(F.when(fits(TEMPLATE), F.col(f"at_{TEMPLATE}")).otherwise(none), F.when(fits(LITERAL), F.col(f"at_{LITERAL}")).otherwise(F.col("same")))
    found = diagonal.select("id", "item", "n_windows", at.alias("at")).groupBy("id", "item", "n_windows").agg(F.size(F.array_distinct(F.flatten(F.collect_list("at")))).cast("long").alias("n_matched"))
    found = found.withColumn("share", F.col("n_matched") / F.col("n_windows")).where(F.col("share") >= min_share)
    return found.select(F.col("id").alias(id_col), F.col("item").alias(item_id_col), F.col("n_windows").cast("long").alias("n_windows"), "n_matched", "share")

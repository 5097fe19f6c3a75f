"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Pass 1 counts byte n-grams of every whole text, hashed into `buckets`, once for all documents (raw
multinomial) and once for trusted ones (target multinomial); tasks send their counts, Spark sums
them, and `buckets` sums reach the driver. Pass 2 scores every document with the mean over its
n-grams of log p_target - log p_raw (add-one smoothing), which is length-normalised, and keeps it if
the score is at least `threshold`. Byte n-grams see spelling, symbols and case and need no words, so
they behave alike in every language. Documents that break a base rule are not kept either.

Null and empty texts have no words, counts of 0, score 0 and fail the base rules. Repeated rows and
ids give repeated results; trusted ids count once. A score equal to the threshold keeps. Without trusted
documents all scores are 0; an empty table gives no rows. Texts of any length are read whole.
Columns besides the two named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import WordHashes, ascii_words, materialize, near, window_hashes

SYMBOLS = b"#*$%&|<>"
WHITE = b" \t\n\v\f\r"


def gram_buckets(text: str | None, n: int, buckets: int) -> np.ndarray:
    """Buckets of the byte n-grams (2 to 8 bytes) of a text between line ends."""
    if not text:
        return np.empty(0, np.int64)
    raw = np.frombuffer(b"\n" + text.encode("utf-8", "surrogatepass") + b"\n", np.uint8)
    m = len(raw) - n + 1
    if m <= 0:
        return np.empty(0, np.int64)
    code = raw[:m].astype(np.uint64)
    for k in range(1, n):
        code |= raw[k : m + k].astype(np.uint64) << np.uint64(8 * k)
    with np.errstate(over="ignore"):
        code *= np.uint64(0x9E3779B97F4A7C15)
    return (code >> np.uint64(64 - buckets.bit_length() + 1)).astype(np.int64)


def log_ratios(docs: DataFrame, trusted: DataFrame, n: int, buckets: int, id_col: str, text_col: str) -> np.ndarray:
    """log p_target - log p_raw by bucket, counted over all documents; `trusted`: the ids of the target."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, target = np.zeros(buckets, np.int64), np.zeros(buckets, np.int64)
        for batch in batches:
            for text, good in zip(batch.column(0), batch.column(1).to_pylist()):
                c = np.bincount(gram_buckets(text.as_py(), n, buckets), minlength=buckets)
                raw += c
                if good:
                    target += c
        some = np.flatnonzero(raw)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])

    ids = near(materialize(trusted.select(F.col(id_col).alias("_trusted_id")).dropna().distinct(), "trusted"))
    source = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(ids, F.col("_id") == F.col("_trusted_id"), "left")
    counts = source.select("_text", F.col("_trusted_id").isNotNull().alias("_good")).mapInArrow(count, "bucket bigint, raw bigint, target bigint")
    rows = counts.groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target")).collect()  # at most `buckets` rows
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for b, r, t in rows:
        raw[b], target[b] = r, t
    if not target.any():
        return np.zeros(buckets)
    p = lambda c: np.log((c + 1) / (c.sum() + buckets))
    return p(target) - p(raw)


def base_counts(text: str | None, hashes: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    words = ascii_words(text)
    if not words:
        return 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    white = len(raw) - len(raw.translate(None, WHITE))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x and not x.isspace()]
    repeat, w = 0, window_hashes(hashes.of(words), 8)
    if len(w) > 1:
        _, back, times = np.unique(w, return_inverse=True, return_counts=True)
        again = times[back] > 1
        if again.any():
            cover = np.zeros(len(words) + 1, np.int64)
            at = np.flatnonzero(again)
            np.add.at(cover, at, 1)
            np.add.at(cover, at + 8, -1)
            repeat = int((np.cumsum(cover)[:-1] > 0).sum())
    return len(words), len(text) - white, symbols, len(lines) - len(set(lines)), repeat


def quality_rules(
    docs: DataFrame,
    trusted: DataFrame,
    n: int = 4,
    buckets: int = 1 << 15,
    threshold: float = -0.2,
    min_words: int = 20,
    max_repeat_percent: int = 30,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, llr).

    `trusted` holds the ids of the target documents in `id_col`; `buckets` is a power of two.
    """
    ratio = log_ratios(docs, trusted, n, buckets, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            rows = []
            for item in batch.column(1):
                text = item.as_py()
                counts = base_counts(text, hashes)
                grams = gram_buckets(text, n, buckets)
                llr = float(ratio[grams].mean()) if len(grams) else 0.0
                failed = counts[0] < min_words or 100 * counts[4] > max_repeat_percent * counts[0]
                rows.append((*counts, failed, not failed and llr >= threshold, llr))
            cols = zip(*rows) if rows else [()] * 8
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names)

    names = [id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "llr"]
    source = docs.select(id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, llr double")

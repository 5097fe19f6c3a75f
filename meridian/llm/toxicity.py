"""Toxicity by non-negative positive-unlabelled learning.

A linear classifier (numpy, logistic loss) is trained from confirmed toxic examples and unlabelled
text by the class-prior-corrected risk  pi * R_p(+) + max(0, R_u(-) - pi * R_p(-)).  Features are
lower-cased words and their beginnings of 3 to 12 characters (as 64-bit codes) that confirmed examples
have far more often than unlabelled text, in any language; a document's features are the ones
present anywhere in the whole text.

The fit uses a bounded sample: about `positives` confirmed and `unlabelled` rows, taken by a hash at
a rate computed from the counts, so it is the same at every run; however often an id or a row is
repeated, twice these numbers are never passed, and at most 3000 features are used. Every document
is scored.
Null and empty texts have no feature and get the score of the intercept. Without any confirmed
example all scores are 0. Repeated rows get the same score. Columns not named are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: ASCII without letters becomes a space.
PLAIN = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Lengths in characters of the word beginnings that are features, besides whole words.
SHORTEST, LONGEST = 3, 12


def words_of(text: str | None) -> set[bytes]:
    """Distinct lower-cased words of a text, by ASCII characters that are no letters."""
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(PLAIN).split())


class Beginnings(dict):
    """Word -> codes of its beginnings and of the whole word, filled on demand, emptied at `limit` words."""

    def __init__(self, limit: int = 200_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> list[int]:
        if len(self) >= self.limit:
            self.clear()
        text = word.decode("utf-8", "surrogatepass")
        starts = [text[:k].encode("utf-8", "surrogatepass") + b"*" for k in range(SHORTEST, min(LONGEST, len(text)) + 1)]
        codes = self[word] = [xxhash.xxh3_64_intdigest(x) for x in (*starts, word)]
        return codes

    def of(self, text: str | None) -> np.ndarray:
        """Sorted distinct codes of a text."""
        found = {c for w in words_of(text) for c in self[w]}
        return np.unique(np.fromiter(found, np.uint64, len(found)))


class FeatureTable(dict):
    """Word -> which of a fixed set of codes it has (mostly none), filled on demand, emptied at `limit` words."""

    def __init__(self, codes: np.ndarray, limit: int = 500_000):
        super().__init__()
        self.place = {c: k for k, c in enumerate(codes.tolist())}
        self.begin, self.limit = Beginnings(1), limit

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= self.limit:
            self.clear()
        found = self[word] = tuple(self.place[c] for c in self.begin[word] if c in self.place)
        return found

    def present(self, text: str | None) -> np.ndarray:
        """Sorted places of the codes that a text has."""
        return np.array(sorted({k for w in words_of(text) for k in self[w]}), np.int64)


def choose_features(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, least_share: float = 0.004, purity: float = 0.7, doubt: int = 3, most: int = 3000) -> np.ndarray:
    """Codes in at least `least_share` of the confirmed examples that hardly occur outside toxic text.

    A code of toxic text alone is 1 / prior times as frequent in confirmed examples as in unlabelled
    text; `purity` is the share of that which is asked for. `doubt` is added to the occurrences in
    unlabelled text, so that rare codes need not be taken on trust.

    Where toxic text is so rare that a code of `least_share` could not show that ratio even if no
    unlabelled text had it, `purity` is asked of the ratio that a code of toxic text alone is expected
    to show in this sample. The limit of that: at a prior far below `doubt` by the number of unlabelled
    texts, a code may occur about once in them, so its share of toxic text is then not certain.
    """
    if not positive:
        return np.empty(0, np.uint64)
    codes, n_pos = np.unique(np.concatenate(positive), return_counts=True)
    keep = n_pos >= max(3, least_share * len(positive))
    codes, n_pos = codes[keep], n_pos[keep]
    n_unl = np.zeros(len(codes), np.int64)
    for g in unlabelled:
        at = np.searchsorted(codes, g)
        ok = at < len(codes)
        at = at[ok]
        n_unl[at[codes[at] == g[ok]]] += 1
    share = n_pos / len(positive)
    odds = share / ((n_unl + doubt) / (len(unlabelled) + doubt))
    asked = np.full(len(codes), purity / prior)
    if least_share * (len(unlabelled) + doubt) / doubt < purity / prior:
        asked = purity * share * (len(unlabelled) + doubt) / (prior * share * len(unlabelled) + doubt)
    good = np.flatnonzero(odds >= np.maximum(2.0, asked))
    best = good[np.lexsort((codes[good], -share[good] * np.log(odds[good])))][:most]
    return np.sort(codes[best])


def fit_nnpu(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, steps: int = 400, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and intercept by Adam on the non-negative PU risk with logistic loss."""
    w, b = np.zeros(x_pos.shape[1], np.float32), np.float32(-1.0)
    m, v = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    for t in range(1, steps + 1):
        f_p, f_u = x_pos @ w + b, x_unl @ w + b
        negative_risk = np.logaddexp(0, f_u).mean() - prior * np.logaddexp(0, f_p).mean()
        # d/df of the loss: -(1 - s(f)) for label +, s(f) for label -
        g_plus = -prior * (1 - sigmoid(f_p)) / len(f_p)
        g_neg_p, g_neg_u = -prior * sigmoid(f_p) / len(f_p), sigmoid(f_u) / len(f_u)
        if negative_risk >= 0:
            d_p, d_u = g_plus + g_neg_p, g_neg_u
        else:  # step back from over-fitting the unlabelled rows
            d_p, d_u = -g_neg_p, -g_neg_u
        g = np.append(x_pos.T @ d_p + x_unl.T @ d_u + decay * w, d_p.sum() + d_u.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1].astype(np.float32), np.float32(b - step[-1])
    return w.astype(np.float64), float(b)


def sample_texts(docs: DataFrame, about: int, share: float, seed: int, id_col: str, text_col: str) -> list[str | None]:
    """Texts of that share of the rows, chosen by a hash of id and text, and never more than twice as many as `about`."""
    code = F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col))
    chosen = docs.where(F.pmod(code, F.lit(1_000_000)) < int(1_000_000 * min(1.0, share)))
    return [r[0] for r in chosen.select(text_col, code.alias("_code")).orderBy("_code").limit(2 * about).collect()]


def score_toxicity(
    docs: DataFrame,
    labels: DataFrame,
    positives: int = 1500,
    unlabelled: int = 6000,
    threshold: float = 0.7,
    seed: int = 7,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Rows (id, score, predicted); `labels` has (id, toxic) of the rows that may be learned from."""
    labels = labels.select(F.col(id_col).alias("_id"), "toxic").dropna()
    known = {r["toxic"]: r["n"] for r in labels.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n_pos, n_docs = known.get(1, 0), docs.count()
    prior = min(0.9, max(0.001, n_pos / max(1, sum(known.values()))))
    codes, weights, intercept = np.empty(0, np.uint64), np.empty(0), -50.0
    if n_pos and n_docs:
        slot = F.pmod(F.xxhash64(F.lit(seed), F.col("_id")), F.lit(1_000_000))
        chosen = labels.where((F.col("toxic") == 1) & (slot < int(1_000_000 * min(1.0, positives / n_pos)))).select("_id").distinct()
        chosen = chosen.limit(2 * positives)  # about `positives` ids
        pairs = docs.select(F.col(id_col).alias("_doc"), F.col(text_col).alias("_text")).join(F.broadcast(chosen), F.col("_doc") == F.col("_id"))
        begin = Beginnings()
        pos = [begin.of(t) for t in sample_texts(pairs, positives, 1.0, seed, "_doc", "_text")]
        unl = [begin.of(t) for t in sample_texts(docs, unlabelled, unlabelled / n_docs, seed + 1, id_col, text_col)]
        codes = choose_features(pos, unl, prior)
        if len(codes) and pos and unl:

            def matrix(rows: list[np.ndarray]) -> np.ndarray:
                x = np.zeros((len(rows), len(codes)), np.float32)
                for k, g in enumerate(rows):
                    at = np.minimum(np.searchsorted(codes, g), len(codes) - 1)
                    x[k, at[codes[at] == g]] = 1
                return x

            weights, intercept = fit_nnpu(matrix(pos), matrix(unl), prior)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = FeatureTable(codes)
        for batch in batches:
            z = np.array([weights[table.present(t.as_py())].sum() + intercept if len(weights) else intercept for t in batch.column(1)], float)
            score = 1 / (1 + np.exp(-np.clip(z, -50, 50))) if len(z) else z
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=[id_col, "score", "predicted"])

    source = docs.select(id_col, text_col)
    return source.mapInArrow(run, f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, score double, predicted int")

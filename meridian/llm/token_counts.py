"""Token counts by rank-synchronous array merging (BPE with byte fallback, SentencePiece models).

A text is cut into pre-tokens (a run of spaces and the non-space characters after it); no piece of
the vocabulary has a space mark behind another character (checked when the model is read), so
merges never cross a cut. Nor do they cross two neighbouring characters that no piece holds side by
side, so pre-tokens are cut there into sequences. The sequences of a batch that are not counted yet
lie in one flat numpy array of symbol ids. In each round every sequence applies its pair of lowest
rank wherever it stands, from the left, and all sequences do so at once. A merge whose result makes
a pair of a lower rank with a neighbour is the last of its sequence in that round, as the library
would merge that pair next. If it makes a pair of the same rank (as runs of spaces do, whose pieces
rank alike), the sequence's merges of that rank are done in one walk from the left. Sequences with no
pair left leave the array, and their surviving symbols are counted. So rounds go by the number of
ranks in a sequence, not by its length.

Null and empty texts have 0 bytes and 0 tokens. Repeated rows and ids give repeated results.
Columns of the input other than the two named are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
NO_RANK = np.int64(1 << 40)
#: Counted pre-tokens that a Python worker remembers, and their greatest length.
MEMORY, LONGEST = 250_000, 200
PRE_TOKEN = re.compile(" +[^ ]*")


class PieceCounter:
    """Counts the tokens of texts as the SentencePiece BPE model in `model_file` would."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        usable = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
        if any(SPACE in pieces[i].lstrip(SPACE) for i in usable):
            raise ValueError("a piece has a space behind another character")
        if model.encode("ﬁ  a", out_type=str)[:2] != [SPACE, "ﬁ"]:
            raise ValueError("the model normalises texts")
        score = {pieces[i]: model.get_score(i) for i in usable}
        symbols: dict[str, int] = {p: k for k, p in enumerate(score)}
        halves = ((p, p[:j], p[j:]) for p in score for j in range(1, len(p)))
        merges = [(-score[p], symbols[a], symbols[b], symbols[p]) for p, a, b in halves if a in symbols and b in symbols]
        self.symbols = symbols
        self.width = np.int64(len(symbols) + 1)
        distinct = {s: r for r, s in enumerate(sorted({m[0] for m in merges}))}
        keys = np.array([a * int(self.width) + b for _, a, b, _ in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys = keys[order]
        self.ranks = np.array([distinct[m[0]] for m in merges], np.int64)[order]
        self.made = np.array([m[3] for m in merges], np.int64)[order]
        # characters that some piece holds side by side
        self.joins = np.unique(np.array([ord(a) << 21 | ord(b) for p in usable for a, b in zip(pieces[p], pieces[p][1:])], np.int64))
        self.cache: dict[str, int] = {}
        self.pairs: dict[tuple[int, int], tuple[int, int]] = {}

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and merged symbol of each pair; NO_RANK where the vocabulary has none."""
        key = left * self.width + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (left >= 0) & (right >= 0)
        return np.where(hit, self.ranks[at], NO_RANK), self.made[at]

    def _count_new(self, words: list[str]) -> np.ndarray:
        """Tokens of each of many distinct pre-tokens (spaces already replaced by the mark)."""
        counts = np.zeros(len(words), np.int64)
        text, get = "".join(words), self.symbols.get
        if not text:
            return counts
        sym = np.fromiter((get(c, -1) for c in text), np.int64, len(text))
        code = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        seq = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        unknown = sym < 0
        if unknown.any():  # an unknown character survives and becomes its bytes
            extra = (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
            counts += np.bincount(seq[unknown], weights=extra[unknown], minlength=len(words)).astype(np.int64)
        pair = code[:-1] << 21 | code[1:]
        last = np.ones(len(sym), bool)  # of its sequence
        last[:-1] = (seq[1:] != seq[:-1]) | (self.joins[np.minimum(np.searchsorted(self.joins, pair), len(self.joins) - 1)] != pair)
        rank, made = np.full(len(sym), NO_RANK), np.zeros(len(sym), np.int64)
        rank[:-1], made[:-1] = self._look_up(sym[:-1], sym[1:])
        rank[last] = NO_RANK
        while len(sym):
            starts = np.flatnonzero(np.r_[True, last[:-1]])
            sizes = np.diff(np.r_[starts, len(sym)])
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == NO_RANK
            if done.any():
                np.add.at(counts, seq[starts[done]], sizes[done])
                keep = np.repeat(~done, sizes)
                sym, seq, rank, made, last = sym[keep], seq[keep], rank[keep], made[keep], last[keep]
                starts = np.flatnonzero(np.r_[True, last[:-1]]) if len(sym) else starts[:0]
                sizes, lowest = sizes[~done], lowest[~done]
                if not len(sym):
                    break
            at, tied = self._apply_at(sym, rank, made, last, np.flatnonzero(rank == np.repeat(lowest, sizes)))
            if len(tied):
                keep = np.ones(len(sym), bool)
                for a, n, r in zip(starts[tied].tolist(), sizes[tied].tolist(), lowest[tied].tolist()):
                    rest = self._merge_from_left(sym[a : a + n].tolist(), r)
                    z = a + len(rest)
                    sym[a:z], last[a:z], keep[z : a + n] = rest, False, False
                    rank[a : z - 1], made[a : z - 1] = self._look_up(sym[a : z - 1], sym[a + 1 : z])
                    last[z - 1], rank[z - 1] = True, NO_RANK
                sym, seq, rank, made, last = sym[keep], seq[keep], rank[keep], made[keep], last[keep]
                continue
            sym[at] = made[at]
            last[at] = last[at + 1]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            at = at - np.arange(len(at))
            sym, seq, rank, made, last = sym[keep], seq[keep], rank[keep], made[keep], last[keep]
            prev = at[(at > 0)]
            prev = prev[~last[prev - 1]] - 1
            for where in (at[~last[at]], prev):
                rank[where], made[where] = self._look_up(sym[where], sym[where + 1])
            rank[at[last[at]]] = NO_RANK
        return counts

    def _apply_at(self, sym: np.ndarray, rank: np.ndarray, made: np.ndarray, last: np.ndarray, hits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the places of the sequences' lowest pairs those to merge in this round, and the sequences to walk through instead."""
        # of overlapping places every other one, from the left
        run = np.r_[True, hits[1:] != hits[:-1] + 1]
        at = hits[(np.arange(len(hits)) - np.flatnonzero(run)[np.cumsum(run) - 1]) % 2 == 0]
        of = np.cumsum(last)[at] - last[at]  # number of the sequence
        first = np.r_[True, of[1:] != of[:-1]]
        if first.all():
            return at, at[:0]
        several = ~first | np.r_[~first[1:], False]
        w, first = at[several], first[several]
        m = made[w]
        close = np.r_[False, w[1:] == w[:-1] + 2] & ~first  # the symbol before is merged as well
        left = np.where(close, np.r_[-1, m[:-1]], np.where((w > 0) & ~last[w - 1], sym[w - 1], -1))
        right = np.where(last[w + 1], -1, sym[np.minimum(w + 2, len(sym) - 1)])
        least = np.minimum(self._look_up(left, m)[0], self._look_up(m, right)[0])
        bad = least < rank[w]
        before = np.cumsum(bad) - bad
        fine = before == before[np.flatnonzero(first)][np.cumsum(first) - 1]
        return np.sort(np.r_[at[~several], w[fine]]), np.unique(of[several][fine & (least == rank[w])])

    def _merge_from_left(self, symbols: list[int], rank: int) -> list[int]:
        """All merges of the lowest rank of one sequence, each time the leftmost, until a lower rank comes up."""
        done: list[int] = []
        for k, x in enumerate(symbols):
            while done:
                r, m = self._pair(done[-1], x)
                if r != rank:
                    break
                done.pop()
                x = m
                after = symbols[k + 1] if k + 1 < len(symbols) else -1
                if min(self._pair(done[-1], x)[0] if done else NO_RANK, self._pair(x, after)[0]) < rank:
                    return [*done, x, *symbols[k + 1 :]]
            done.append(x)
        return done

    def _pair(self, left: int, right: int) -> tuple[int, int]:
        """Rank and merged symbol of one pair, remembered."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= MEMORY:
                self.pairs.clear()
            rank, made = self._look_up(np.array([left]), np.array([right]))
            found = self.pairs[left, right] = int(rank[0]), int(made[0])
        return found

    def count(self, texts: list[str]) -> list[int]:
        split = []
        for t in texts:
            if not t:
                split.append(())
                continue
            t = " " + t.replace(SPACE, " ") if SPACE in t else " " + t
            words = t[1:].split(" ")
            split.append(PRE_TOKEN.findall(t) if "" in words else words)
        new = set().union(*split) - self.cache.keys() if split else set()
        if new:
            if len(self.cache) + len(new) > MEMORY:
                self.cache.clear()
                new = set().union(*split)
            new = list(new)
            # a plain word stands for the word behind one space
            marked = [w.replace(" ", SPACE) if w[:1] == " " else SPACE + w for w in new]
            self.cache.update(zip(new, self._count_new(marked).tolist()))
        get = self.cache.__getitem__
        counts = [sum(map(get, words)) for words in split]
        for w in new:
            if len(w) > LONGEST:
                del self.cache[w]
        return counts


def token_counts(docs: DataFrame, model_file: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", rows_at_once: int = 256) -> DataFrame:
    """Rows (id, n_bytes, n_tokens, over_limit) of every whole text; see the module's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = None
        for batch in batches:
            counter = counter or PieceCounter(model_file)
            for start in range(0, batch.num_rows, rows_at_once):
                part = batch.slice(start, rows_at_once)
                texts = part.column(1).to_pylist()
                n = counter.count(texts)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(t.encode()) if t else 0 for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n])],
                    names=[id_col, "n_bytes", "n_tokens", "over_limit"],
                )

    source = docs.select(id_col, text_col)
    kind = source.schema[id_col].dataType.simpleString()
    return source.mapInArrow(run, f"`{id_col}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")

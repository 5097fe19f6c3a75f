"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: Rows and bytes up to which a table is broadcast.
BROADCAST_ROWS, BROADCAST_BYTES = 400_000, 32_000_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names; without one only a local session has a folder, of its own."""
    if named := spark.conf.get("spark.checkpoint.dir", None):
        return named
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return f"{tempfile.gettempdir()}/checkpoints"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write `df` as Parquet into the shared checkpoint folder and read it back.

    Cuts the lineage: a lost executor costs only the reading of these files again.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/meridian/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def near(written: DataFrame, *sized: str) -> DataFrame:
    """A written table for a join: broadcast if its rows, and the bytes in its columns `sized`, are few; else as it is."""
    size = F.sum(sum((F.octet_length(c) for c in sized), F.lit(0)))
    rows, size = written.agg(F.count(F.lit(1)), F.coalesce(size, F.lit(0))).first()
    return F.broadcast(written) if rows <= BROADCAST_ROWS and size <= BROADCAST_BYTES else written


def text_bytes(docs: DataFrame, text_col: str = "text") -> int:
    """Bytes of all texts, to cut work by."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text_col).cast("long")), F.lit(0))).first()[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def tasks_for(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


class WordHashes(dict):
    """Word (bytes) -> 64-bit hash, filled on demand and emptied when it has `limit` words."""

    def __init__(self, limit: int = 100_000):
        super().__init__()
        self.limit = limit

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


#: Lower-cases A-Z and nothing else.
ASCII_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def ascii_words(text: str | None, lower: bool = False) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+` of a text as UTF-8; None has none."""
    if not text:
        return []
    raw = text.encode("utf-8", "surrogatepass")
    return (raw.translate(ASCII_LOWER) if lower else raw).split()


MIX = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective mixing of 64-bit values."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def window_hashes(h: np.ndarray, k: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Polynomial hashes (mod 2^64, mixed) of every k consecutive values; none if fewer than k."""
    n = len(h) - k + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    b = np.uint64(base | 1)
    level, size, step = h, 1, b  # hashes of `size` values; step = b ** size
    have, width, left = None, 0, k
    with np.errstate(over="ignore"):
        while left:
            if left & 1:
                if have is None:
                    have, width = level, size
                else:
                    m = min(len(have), len(level) - width)
                    have, width = have[:m] * step + level[width : width + m], width + size
            left >>= 1
            if left:
                level = level[: len(level) - size] * step + level[size:]
                size, step = size * 2, step * step
        return mix64(have[:n])


def hash_rows(*cols: str):
    """xxhash64 of columns as a non-negative long."""
    return F.xxhash64(*cols).bitwiseAND(F.lit(0x7FFFFFFFFFFFFFFF))

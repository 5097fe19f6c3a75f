"""Centroid clustering on subvector dictionaries.

Vectors are quantised to integers and dealt to parts of bounded size. In a part, each block of
`width` dimensions is dictionary-encoded without loss: its distinct subvectors and a code for every
vector. A round then takes exact integer distances of the distinct subvectors to the centroids once,
sums them by code for every vector, and gives the nearest centroid. Sums of a cluster are counts of
codes times subvectors. Parts send k sums each; Spark adds them up and the k centroids go to the driver.

Kept are vectors with exactly `dims` components, none null or not finite. An integer component beyond
2 ** 27 in size counts as 2 ** 27, so that squared distances fit into 64 bits; an inertia beyond them is
null. Repeated rows and ids are vectors of their own. A null id is clustered but starts no centroid; equal
ids are ordered by their components. Fewer vectors than `k` start fewer centroids; without any (or
an empty table) there are no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meridian.llm.common import materialize

LIMIT = 1 << 27
#: Vectors of a part, and vectors whose distances are summed at a time.
PART, CHUNK = 1 << 15, 1 << 12


def quantised(batch: pa.RecordBatch, dims: int, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows of (id, vector) are kept, and their integer components."""
    column = batch.column(1)
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    kept = np.flatnonzero(lengths == dims)
    values = column.take(pa.array(kept)).flatten()
    x = values.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)  # null: NaN
    fine = np.isfinite(x).all(axis=1)
    with np.errstate(over="ignore"):
        q = np.clip(np.floor(x[fine] * scale), -LIMIT, LIMIT).astype(np.int64)
    return kept[fine], q


def encode(q: np.ndarray, width: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per block of dimensions: distinct subvectors, and the code of every vector."""
    blocks = []
    for at in range(0, q.shape[1], width):
        part = q[:, at : at + width]
        low = part.min(axis=0)
        spread = part.max(axis=0) - low + 1
        if np.prod(spread.astype(float)) < 2.0**62:  # one number for a subvector
            key = (part - low) @ np.append(np.cumprod(spread[:0:-1])[::-1], 1).astype(np.int64)
            _, first, code = np.unique(key, return_index=True, return_inverse=True)
            found = part[first]
        else:
            found, code = np.unique(part, axis=0, return_inverse=True)
        blocks.append((found, code.ravel().astype(np.uint16 if len(found) <= 1 << 16 else np.uint32)))
    return blocks


def packed(blocks: list[tuple[np.ndarray, np.ndarray]]) -> tuple[bytes, bytes, list[int], int]:
    """Dictionaries, codes, sizes of the dictionaries and bytes of a code."""
    wide = max(code.itemsize for _, code in blocks)
    kind = np.uint16 if wide == 2 else np.uint32
    return b"".join(d.astype("<i4").tobytes() for d, _ in blocks), b"".join(c.astype(kind).tobytes() for _, c in blocks), [len(d) for d, _ in blocks], wide


def unpacked(n: int, dims: int, width: int, dictionaries: bytes, codes: bytes, sizes: list[int], wide: int) -> list[tuple[np.ndarray, np.ndarray]]:
    values = np.frombuffer(dictionaries, "<i4").astype(np.int64)
    code, blocks, start = np.frombuffer(codes, np.uint16 if wide == 2 else np.uint32).reshape(len(sizes), n), [], 0
    for k, size in enumerate(sizes):
        w = min(width, dims - k * width)
        blocks.append((values[start : start + size * w].reshape(size, w), code[k]))
        start += size * w
    return blocks


def assign(blocks: list[tuple[np.ndarray, np.ndarray]], centroids: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centroid (ties: the smaller number) and squared distance of every vector."""
    tables, at = [], 0
    for found, _ in blocks:
        w = found.shape[1]
        tables.append(((found[:, None, :] - centroids[None, :, at : at + w]) ** 2).sum(axis=2))
        at += w
    cluster, distance = np.empty(n, np.int64), np.empty(n, np.int64)
    for start in range(0, n, CHUNK):
        total = np.zeros((min(CHUNK, n - start), len(centroids)), np.int64)
        for table, (_, code) in zip(tables, blocks):
            total += table[code[start : start + CHUNK]]
        best = total.argmin(axis=1)
        cluster[start : start + CHUNK] = best
        distance[start : start + CHUNK] = total[np.arange(len(best)), best]
    return cluster, distance


def cluster_sums(blocks: list[tuple[np.ndarray, np.ndarray]], cluster: np.ndarray, k: int) -> np.ndarray:
    """Component sums of every cluster, from how often it has each code."""
    sums = []
    for found, code in blocks:
        times = np.bincount(cluster * len(found) + code, minlength=k * len(found)).reshape(k, len(found))
        sums.append(times @ found)
    return np.concatenate(sums, axis=1)


def centroid_clusters(
    vectors: DataFrame,
    k: int = 16,
    rounds: int = 3,
    dims: int = 64,
    scale: int = 64,
    seed: int = 1,
    width: int = 2,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Rows (id, cluster, distance, cluster_inertia, inertia, centroid_sha256)."""
    spark = vectors.sparkSession
    source = vectors.select(id_col, vector_col)
    kind = source.schema[id_col].dataType.simpleString()

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, held, have = [], [], 0

        def ship() -> pa.RecordBatch:
            every, q = pa.concat_arrays(ids), np.concatenate(held)
            row = [[len(q)], [every], *([x] for x in packed(encode(q, width)))]
            kinds = [pa.int64(), pa.list_(every.type), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(row, kinds)], names=["n", "ids", "dictionaries", "codes", "sizes", "wide"])

        for batch in batches:
            for start in range(0, batch.num_rows, PART):
                piece = batch.slice(start, PART)
                kept, q = quantised(piece, dims, scale)
                if len(q):
                    ids.append(piece.column(0).take(pa.array(kept)))
                    held.append(q)
                    have += len(q)
                if have >= PART:
                    yield ship()
                    ids, held, have = [], [], 0
        if have:
            yield ship()

    coded = materialize(source.mapInArrow(parts, f"n bigint, ids array<{kind}>, dictionaries binary, codes binary, sizes array<bigint>, wide int"), "subvectors")

    # the first centroids: those of the smallest hashes, a top-k
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    whole = F.transform(vector_col, lambda x: F.floor(F.greatest(F.lit(-float(LIMIT)), F.least(F.lit(float(LIMIT)), x.cast("double") * scale))))
    usable = source.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) == dims) & finite)
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256)
    first = usable.select(order.alias("h"), whole.alias("q")).orderBy("h", "q").limit(k).collect()
    schema = f"`{id_col}` {kind}, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"
    if not first:
        return spark.createDataFrame([], schema)
    centroids = np.array([r["q"] for r in first], np.int64)

    def blocks_of(batch: pa.RecordBatch, i: int) -> tuple[int, list]:
        n, _, *rest = (batch.column(c)[i].as_py() if batch.schema.names[c] != "ids" else None for c in range(6))
        return n, unpacked(n, dims, width, *rest)

    for _ in range(rounds):

        def sums(batches: Iterator[pa.RecordBatch], centroids=centroids) -> Iterator[pa.RecordBatch]:
            total, count = np.zeros((len(centroids), dims), np.int64), np.zeros(len(centroids), np.int64)
            for batch in batches:
                for i in range(batch.num_rows):
                    n, blocks = blocks_of(batch, i)
                    cluster, _ = assign(blocks, centroids, n)
                    total += cluster_sums(blocks, cluster, len(centroids))
                    count += np.bincount(cluster, minlength=len(centroids))
            some = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(count[some]), pa.array(total[some].tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "sums"])

        found = coded.mapInArrow(sums, "cluster bigint, n bigint, sums array<bigint>")
        # exact beyond 64 bits, k x dims rows
        found = found.select("cluster", "n", F.posexplode("sums").alias("d", "x")).groupBy("cluster", "d")
        found = found.agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("x"), F.sum("n").alias("n")).collect()
        for r in found:
            centroids[r["cluster"], r["d"]] = int(r["x"]) // r["n"]

    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]

    def final(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                n, blocks = blocks_of(batch, i)
                cluster, distance = assign(blocks, centroids, n)
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, pa.array(cluster, pa.int32()), pa.array(distance)], names=[id_col, "cluster", "distance"])

    result = coded.mapInArrow(final, f"`{id_col}` {kind}, cluster int, distance bigint")
    inertia = result.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("s")).collect()  # k rows
    inside = {r["cluster"]: int(r["s"]) for r in inertia}
    fits = lambda x: x if x < 1 << 63 else None
    total = fits(sum(inside.values()))
    known = spark.createDataFrame([(c, fits(inside[c]), total, digests[c]) for c in sorted(inside)], "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return result.join(F.broadcast(known), "cluster").select(id_col, "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

"""Clustering around centroids by progressive search in the Walsh-Hadamard domain.

Components are integers, and so is every step.  The transform of a vector (padded with zeros to a
power of two) multiplies squared distances by its length, and its first coefficients, in the order of
sign changes, hold the coarse part of the vector.  A vector's distances to all centroids are
accumulated coefficient by coefficient, coarse to fine.  After the first part the nearest centroid so
far is finished; a centroid whose part is already larger than that whole distance is strictly worse
and leaves the search.  Those that remain are finished, all coefficients, and the nearest wins; of
equal ones the smaller number.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scratch

# Components up to here: all sums of squares of 64 transformed differences fit 64 bits.
NARROW = 2**24
MOST = 2**63 - 1


def walsh(rows: np.ndarray) -> np.ndarray:
    """The Walsh-Hadamard transform of each row, coefficients by number of sign changes."""
    n, size = rows.shape
    out, half = rows.copy(), 1
    while half < size:
        pairs = out.reshape(n, size // (2 * half), 2, half)
        out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(n, size)
        half *= 2
    bits = size.bit_length() - 1
    place = np.arange(size) ^ (np.arange(size) >> 1)  # sign changes follow a Gray code of reversed bits
    reverse = [int(format(p, f"0{bits}b")[::-1], 2) if bits else 0 for p in place.tolist()]
    return out[:, reverse]


def nearest(rows: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For transformed rows and centroids, the number of the nearest centroid and the distance
    times the number of coefficients."""
    n, size = rows.shape
    ends = [1 << k for k in range(size.bit_length() - 1) if 1 << k >= min(8, size)] + [size]
    part = ((rows[:, None, : ends[0]] - centroids[None, :, : ends[0]]) ** 2).sum(axis=2)
    first = np.arange(n), part.argmin(axis=1)
    whole = part[first] + ((rows[:, ends[0] :] - centroids[first[1], ends[0] :]) ** 2).sum(axis=1)
    row, number = np.nonzero(part <= whole[:, None])
    so_far = part[row, number]
    for low, high in zip(ends, ends[1:], strict=False):
        so_far = so_far + ((rows[row, low:high] - centroids[number, low:high]) ** 2).sum(axis=1)
        stays = so_far <= whole[row]
        row, number, so_far = row[stays], number[stays], so_far[stays]
    order = np.lexsort((number, so_far, row))  # the finished one of each row is among them
    row = row[order]
    head = order[np.r_[True, row[1:] != row[:-1]]] if n else order
    return number[head], so_far[head]


def _integers(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x); 64-bit where every later step fits, exact numbers of any size elsewhere."""
    scaled = values.astype(np.float64) * scale
    if not np.isfinite(scaled).all():  # scale * x is beyond a double, x is a whole number then
        return np.array([[math.floor(x * scale) if math.isfinite(x * scale) else int(x) * scale for x in r] for r in values.tolist()], object)
    scaled = np.floor(scaled)
    if np.abs(scaled).max(initial=0) <= NARROW and values.shape[1] <= 64:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in r] for r in scaled.tolist()], object).reshape(values.shape)


def _padded(rows: np.ndarray) -> np.ndarray:
    size = 1 << max(0, rows.shape[1] - 1).bit_length()
    return np.concatenate([rows, np.zeros((len(rows), size - rows.shape[1]), rows.dtype)], axis=1)


def _searched(b: pa.RecordBatch, dims: int, scale: int, centroids: np.ndarray):
    """Integers, cluster and distance of the vectors of a batch."""
    flat = b.column("v").flatten().to_numpy(zero_copy_only=False)
    rows = _integers(flat.reshape(-1, dims), scale)
    exact = object if rows.dtype == object or centroids.dtype == object else np.int64
    moved, transformed = walsh(_padded(centroids).astype(exact)), walsh(_padded(rows).astype(exact))
    number, distance = nearest(transformed, moved)
    return rows, number, distance // moved.shape[1]


def _long(x: int | None) -> int | None:
    return x if x is not None and x <= MOST else None


def _slices(batches: Iterator[pa.RecordBatch], most: int = 4096) -> Iterator[pa.RecordBatch]:
    for b in batches:
        yield from (b.slice(at, most) for at in range(0, b.num_rows, most))


def _good(vector: Column, dims: int) -> Column:
    """Exactly ``dims`` components, none null or non-finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) == dims) & ~bad, F.lit(False))


def _starts(rows: DataFrame, k: int, seed: str, dims: int, scale: int) -> np.ndarray:
    """The vectors whose ids have the smallest SHA-256, in its order; rows without id are none."""
    place = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).alias("place")
    first = rows.select(place, "v").where("place is not null").orderBy("place", "v").limit(k).collect()
    return _integers(np.array([r.v for r in first], float).reshape(-1, dims), scale)


def _sums(rows: DataFrame, dims: int, scale: int, centroids: np.ndarray) -> DataFrame:
    """``cluster, n, total``: members of each cluster and their componentwise sums, which are
    exact whatever their size (decimal numbers in text), from one row per task and cluster."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in _slices(batches):
            vectors, number, _ = _searched(b, dims, scale, centroids)
            for c in np.unique(number).tolist():
                mine = vectors[number == c]
                n, total = held.get(c, (0, np.zeros(dims, object)))
                held[c] = n + len(mine), total + mine.sum(axis=0).astype(object)
        columns = [
            pa.array(held.keys(), pa.int32()),
            pa.array([n for n, _ in held.values()], pa.int64()),
            pa.array([[str(x) for x in t] for _, t in held.values()], pa.list_(pa.string())),
        ]
        yield pa.RecordBatch.from_arrays(columns, ["cluster", "n", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = [str(sum(map(int, x))) for x in zip(*table["total"].to_pylist(), strict=True)]
        n = sum(table["n"].to_pylist())
        names = ["cluster", "lane", "n", "total"]
        lane = table["lane"][0].as_py()
        return pa.table([pa.array([table["cluster"][0].as_py()], pa.int32()), pa.array([lane], pa.int32()), pa.array([n]), pa.array([total])], names)

    schema = "cluster int, n long, total array<string>"
    partial = rows.select("v").mapInArrow(run, schema).withColumn("lane", F.pmod(F.spark_partition_id(), F.lit(64)))
    merged = partial.groupBy("cluster", "lane").applyInArrow(add, "cluster int, lane int, n long, total array<string>")
    return merged.withColumn("lane", F.lit(0)).groupBy("cluster").applyInArrow(add, "cluster int, lane int, n long, total array<string>")


def clustered(vectors: DataFrame, dims: int = 64, scale: int = 256, k: int = 40, rounds: int = 5, seed: str = "2:") -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` of every vector kept.

    ``vectors`` has ``vec_id, embedding``; kept are those with exactly ``dims`` components, none
    null or non-finite, each turned into floor(scale * x).  Centroids start as the ``k`` kept
    vectors with the smallest SHA-256 of ``seed`` and the id (fewer, if there are fewer; rows that
    repeat an id are taken in the order of their vectors, rows without id are never a start).  In
    every round non-empty centroids become the componentwise floor of their vectors' mean, empty
    ones stay.  Distances beyond a 64-bit number, and sums over them, are null; the search itself is
    exact for components of any size.  Repeated rows count each.  Without a start (no vector with an
    id) there are no rows.  Other columns are ignored.
    """
    scratch = Scratch(vectors.sparkSession, "centroids")
    kept = vectors.select("vec_id", F.col("embedding").alias("v")).where(_good(F.col("embedding"), dims))
    kept = scratch.put(kept, "kept")
    # the centroids are k vectors, whatever the size of the table
    centroids = _starts(kept, k, seed, dims, scale)
    if not len(centroids):
        schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
        return vectors.sparkSession.createDataFrame([], schema)
    for _ in range(rounds):
        moved = centroids.astype(object)
        for r in _sums(kept, dims, scale, centroids).collect():
            moved[r.cluster] = [int(x) // r.n for x in r.total]
        narrow = max(abs(int(x)) for x in moved.ravel()) <= NARROW and dims <= 64
        centroids = moved.astype(np.int64) if narrow else moved

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            _, number, distance = _searched(b, dims, scale, centroids)
            found = [_long(d) for d in distance.tolist()]
            columns = [b.column("vec_id"), pa.array(number, pa.int32()), pa.array(found, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    assigned = scratch.put(kept.mapInArrow(run, "vec_id long, cluster int, distance long"), "assigned")
    per = assigned.groupBy("cluster").agg(
        F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.count("*").alias("n"), F.count("distance").alias("known")
    )
    totals = {r.cluster: int(r.total) if r.n == r.known else None for r in per.collect()}  # k rows at most
    inertia = None if None in totals.values() else _long(sum(totals.values()))
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids.tolist()]
    rows = [(c, _long(total), inertia, digests[c]) for c, total in totals.items()]
    schema = "cluster int, cluster_inertia long, inertia long, centroid_sha256 string"
    summed = F.broadcast(vectors.sparkSession.createDataFrame(rows, schema))
    result = assigned.join(summed, "cluster")
    return result.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

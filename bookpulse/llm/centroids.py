"""Centroid clustering of integer vectors in which most exact distances are screened away by segment norms.

Vectors are kept as integers, floor(scale * component), beside the norms of their segments of ``SEGMENT`` components. By
the Cauchy-Schwarz inequality two vectors' segments lie no nearer than their norms differ, so the squared differences of
norms, summed over segments, bound the squared distance from below. The centroid of least bound gets an exact distance
first; any other gets one only where its bound, less what rounding may add, doesn't exceed the best distance so far. All
distances, sums and quotients are exact integers.

A round is one pass without a shuffle of vectors: tasks add up their own sums, so that a task sends one row a centroid,
and the driver gets at most centroids x components numbers. Vectors of another length, or with a component that is null
or not finite, are left out; a null vec_id counts (as first centroid it comes last); repeated rows count each. With fewer
vectors than centroids there are as many centroids as vectors, with none an empty result. Components beyond ``LARGEST``,
whose squared distances a long may not hold, raise an error.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bookpulse.llm.common import discard, materialize

DIMENSIONS, SEGMENT, SCALE, CENTROIDS, ROUNDS = 64, 8, 64, 16, 3
#: Of an integer component; 64 squared differences of such stay below 2 to the 63.
LARGEST = 1 << 27
#: Share of the squared norms that rounding of norms can't exceed.
ROUNDING = 1e-12
#: Vectors of which distances are held at a time.
BLOCK = 4096


def kept(embedding: Column, dimensions: int = DIMENSIONS) -> Column:
    """Whether a vector takes part."""
    return F.coalesce((F.size(embedding) == dimensions) & F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _rows(c: pa.Array) -> np.ndarray:
    """A list column without nulls as a matrix."""
    return c.flatten().to_numpy(zero_copy_only=False).reshape(len(c), -1)


def norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt(np.square(x.astype(np.float64)).reshape(len(x), -1, SEGMENT).sum(2))


def compress(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", dimensions: int = DIMENSIONS, scale: int = SCALE) -> DataFrame:
    """vec_id, v (integers) and norms (of v's segments) of the vectors that take part."""
    if dimensions % SEGMENT:
        raise ValueError(f"segments of {SEGMENT} have to fill {dimensions} components")
    large = F.exists("e", lambda x: F.abs(x * scale) > LARGEST)
    checked = F.when(large, F.raise_error(F.concat(F.lit("too large a component in vector "), F.coalesce(F.col("vec_id").cast("string"), F.lit("null"))))).otherwise(F.transform("e", lambda x: F.floor(x * scale).cast("int")))
    rows = table.where(kept(F.col(embedding), dimensions)).select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("e"))
    rows = rows.select("vec_id", checked.alias("v"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lengths = norms(_rows(b.column(1))) if b.num_rows else np.zeros((0, 1))
            listed = pa.FixedSizeListArray.from_arrays(pa.array(lengths.reshape(-1)), max(1, lengths.shape[1])).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), listed], names=["vec_id", "v", "norms"])

    return rows.mapInArrow(run, f"vec_id {dict(rows.dtypes)['vec_id']}, v array<int>, norms array<double>")


def first_centroids(vectors: DataFrame, count: int = CENTROIDS, seed: int = 1) -> list[list[int]]:
    """The ``count`` vectors with smallest SHA-256 of ``seed:vec_id``; vectors that share a vec_id in order of components."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r.v) for r in vectors.select("v", order.alias("o")).orderBy(F.col("o").asc_nulls_last(), "v").limit(count).collect()]


def nearest(x: np.ndarray, x_norms: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each vector the nearest centroid (the smaller number of equals), the squared distance, and how many exact ones it took."""
    c_norms, at = norms(c), np.arange(len(x))
    bound = sum(np.square(x_norms[:, s, None] - c_norms[None, :, s]) for s in range(c_norms.shape[1]))
    bound -= ROUNDING * (np.square(x_norms).sum(1)[:, None] + np.square(c_norms).sum(1)[None, :])
    label = bound.argmin(1)
    best, taken = np.square(x - c[label]).sum(1), np.ones(len(x), np.int32)
    first = label.copy()
    for k in range(len(c)):
        rows = at[(bound[:, k] <= best) & (first != k)]
        d = np.square(x[rows] - c[k]).sum(1)
        taken[rows] += 1
        better = (d < best[rows]) | ((d == best[rows]) & (k < label[rows]))
        label[rows[better]], best[rows[better]] = k, d[better]
    return label.astype(np.int32), best, taken


def _assigned(centroids: list[list[int]], b: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray, tuple]]:
    c = np.array(centroids, dtype=np.int64)
    for i in range(0, b.num_rows, BLOCK):
        part = b.slice(i, BLOCK)
        x = _rows(part.column(1)).astype(np.int64)
        yield part, x, nearest(x, _rows(part.column(2)), c)


def assign(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster, distance (squared), n_exact (exact distances that weren't screened away) of compressed vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part, _, found in _assigned(centroids, b):
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, found)], names=["vec_id", "cluster", "distance", "n_exact"])

    return vectors.select("vec_id", "v", "norms").mapInArrow(run, f"vec_id {dict(vectors.dtypes)['vec_id']}, cluster int, distance long, n_exact int")


def step(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The centroids after one round: floors of their vectors' means; one without vectors stays."""
    shape = (len(centroids), len(centroids[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = np.zeros(shape[0], np.int64), np.zeros(shape, np.int64)
        for b in batches:
            for _, x, (label, _, _) in _assigned(centroids, b):
                n += np.bincount(label, minlength=shape[0])
                for k in np.unique(label):
                    sums[k] += x[label == k].sum(0)
        for k in np.flatnonzero(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(shape[1], k, np.int32)), pa.array(np.arange(shape[1], dtype=np.int32)), pa.array(np.full(shape[1], n[k])), pa.array(sums[k])], names=["cluster", "i", "n", "s"])

    parts = vectors.select("vec_id", "v", "norms").mapInArrow(run, "cluster int, i int, n long, s long")
    whole = lambda c: F.sum(F.col(c).cast("decimal(38,0)"))
    out = [list(c) for c in centroids]
    for r in parts.groupBy("cluster", "i").agg(whole("n").alias("n"), whole("s").alias("s")).collect():  # centroids x components at most
        out[r.cluster][r.i] = int(r.s) // int(r.n)
    return out


def fit(vectors: DataFrame, count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1, each: Callable[[list], None] = lambda c: None) -> list[list[int]]:
    """Centroids after ``rounds`` rounds over compressed vectors; ``each`` sees those of every round."""
    centroids = first_centroids(vectors, count, seed)
    for _ in range(rounds if centroids else 0):
        each(centroids)
        centroids = step(vectors, centroids)
    return centroids


def digest(centroid: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, centroid)).encode()).hexdigest()


def cluster(table: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", count: int = CENTROIDS, rounds: int = ROUNDS, seed: int = 1) -> DataFrame:
    """vec_id, cluster, distance, n_exact, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    vectors = materialize(compress(table, vec_id, embedding))
    centroids = fit(vectors, count, rounds, seed)
    found = materialize(assign(vectors, centroids))
    discard(vectors)
    sums = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}  # a row a centroid
    rows = [(k, s, sum(sums.values()), digest(centroids[k])) for k, s in sums.items()]
    known = table.sparkSession.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return found.join(F.broadcast(known), "cluster").select("vec_id", "cluster", "distance", "n_exact", "cluster_inertia", "inertia", "centroid_sha256")

"""Centroid clustering of integer vectors with block-norm screening.

Vectors become integers once and are stored with the norms of their blocks
(their compressed form). In a round every vector gets, from its block norms
and those of the centroids, a lower bound of each distance by Cauchy and
Schwarz: |x - c|^2 >= |x|^2 + |c|^2 - 2 * sum over blocks of |x_b| * |c_b|.
The centroid of the least bound is measured first, and of the others only
those whose bound does not exceed the best distance; measured distances are
exact integers. A round is one pass over the stored vectors that sends, for
each task and cluster, componentwise sums; only the k new centroids reach the
driver.

Defined cases: vectors that are null, of another length, or with null, NaN or
infinite components are left out; integers saturate at +-2^27 (|x| over
131,072 at scale 1024), so that a squared distance fits a long; an inertia
over the largest long is null; with fewer vectors than k there are as many
centroids; repeated rows are rows like others (equal hashes of ids go by the
vectors' bytes), equal centroids leave the larger number empty; a null vec_id
is hashed as the empty string; no vectors give an empty result; extra columns
are ignored.
"""

from __future__ import annotations

import hashlib
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataframe.llm._common import slices, stage_table

#: Integers are kept within this distance of 0.
LARGEST = 1 << 27


def block_norms(x: np.ndarray, blocks: int) -> np.ndarray:
    """Euclidean norms of ``blocks`` runs of components, per row."""
    at = np.linspace(0, x.shape[1], blocks + 1).astype(int)[:-1]
    return np.sqrt(np.add.reduceat(x.astype(np.float64) ** 2, at, axis=1))


def _integers(dim: int, scale: int, blocks: int):
    def run(batches):
        for whole in batches:
            for b in slices(whole, 1, rows=8192, size=1 << 20):
                fits = pc.fill_null(pc.equal(pc.list_value_length(b.column(1)), dim), False)
                kept = b.filter(fits)
                values = kept.column(1).flatten()
                x = values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                good = np.isfinite(x).all(axis=1)  # a null component is NaN here
                x = np.clip(np.floor(scale * x[good]), -LARGEST, LARGEST).astype("<i4")
                norms = block_norms(x, blocks).astype("<f8")
                yield pa.record_batch([kept.column(0).filter(pa.array(good)), _rows_of(x), _rows_of(norms)], names=["vec_id", "vector", "norms"])

    return run


def _rows_of(x: np.ndarray) -> pa.Array:
    """Rows of a matrix as binary values."""
    width = x.shape[1] * x.itemsize
    offsets = pa.py_buffer((np.arange(len(x) + 1, dtype=np.int32) * width).tobytes())
    return pa.Array.from_buffers(pa.binary(), len(x), [None, offsets, pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _matrix(col: pa.Array, dtype: str, width: int) -> np.ndarray:
    """Binary values of one width as the rows of a matrix."""
    return np.frombuffer(b"".join(col.to_pylist()), dtype).reshape(-1, width)


def prepared(vectors: DataFrame, dim: int = 64, scale: int = 1024, blocks: int = 8) -> DataFrame:
    """vec_id, vector (integers) and norms (of its blocks) of the vectors that are kept."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(_integers(dim, scale, blocks), "vec_id long, vector binary, norms binary")


class Screen:
    """Centroids with the norms of their blocks."""

    def __init__(self, centroids: list[list[int]], blocks: int):
        self.c = np.array(centroids, np.int64)
        self.norms = block_norms(self.c, blocks)

    def nearest(self, x: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Nearest centroid (ties: smaller number) and exact squared distance of each row; how many distances were measured."""
        x = x.astype(np.int64)
        squares = (norms**2).sum(axis=1)[:, None] + (self.norms**2).sum(axis=1)[None, :]
        # far more slack than double precision needs, so no nearest centroid is screened out
        low = squares * (1 - 1e-9) - 2 * (norms @ self.norms.T) - 1
        first = low.argmin(axis=1)
        best, number, measured = _distances(x, self.c[first]), first.copy(), len(x)
        for j in range(len(self.c)):
            rows = np.flatnonzero((low[:, j] <= best) & (first != j))
            d = _distances(x[rows], self.c[j])
            won = (d < best[rows]) | ((d == best[rows]) & (j < number[rows]))
            best[rows[won]], number[rows[won]] = d[won], j
            measured += len(rows)
        return number, best, measured


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    gap = x - c
    return np.einsum("ij,ij->i", gap, gap)


def _sums(screen: Screen, dim: int, blocks: int):
    """Per task and cluster: component sums, then the number of vectors (component dim) and their inertia (dim + 1)."""

    def run(batches):
        k = len(screen.c)
        total, inertia = np.zeros((k, dim + 1), np.int64), [0] * k
        for b in batches:
            x = _matrix(b.column(0), "<i4", dim)
            number, best, _ = screen.nearest(x, _matrix(b.column(1), "<f8", blocks))
            for j in np.unique(number).tolist():
                mine = number == j
                total[j, :dim] += x[mine].sum(axis=0, dtype=np.int64)
                total[j, dim] += mine.sum()
                d = best[mine]
                inertia[j] += (int((d >> 31).sum()) << 31) + int((d & 0x7FFFFFFF).sum())
        for j in np.flatnonzero(total[:, dim]).tolist():
            values = [Decimal(v) for v in [*total[j].tolist(), inertia[j]]]
            yield pa.record_batch([pa.array([j] * (dim + 2), pa.int32()), pa.array(range(dim + 2), pa.int32()), pa.array(values, pa.decimal128(38, 0))], names=["cluster", "component", "value"])

    return run


def _totals(stored: DataFrame, screen: Screen, dim: int, blocks: int) -> dict[int, list[int]]:
    """The sums of every non-empty cluster; k * (dim + 2) rows reach the driver."""
    parts = stored.select("vector", "norms").mapInArrow(_sums(screen, dim, blocks), "cluster int, component int, value decimal(38,0)")
    out: dict[int, list[int]] = {}
    for r in parts.groupBy("cluster", "component").agg(F.sum("value").cast("decimal(38,0)").alias("value")).collect():
        out.setdefault(r.cluster, [0] * (dim + 2))[r.component] = int(r.value)
    return out


def _assigned(screen: Screen, dim: int, blocks: int):
    def run(batches):
        for b in batches:
            number, best, _ = screen.nearest(_matrix(b.column(1), "<i4", dim), _matrix(b.column(2), "<f8", blocks))
            yield pa.record_batch([b.column(0), pa.array(number, pa.int32()), pa.array(best, pa.int64())], names=["vec_id", "cluster", "distance"])

    return run


_RESULT = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, seed: int = 3, dim: int = 64, scale: int = 1024, blocks: int = 8) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    stored = stage_table(prepared(vectors, dim, scale, blocks), "vectors")
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = stored.select(order.alias("hash"), "vector").orderBy("hash", "vector").limit(k).collect()
    if not first:
        return vectors.sparkSession.createDataFrame([], _RESULT)
    centroids = [np.frombuffer(r.vector, "<i4").tolist() for r in first]
    for _ in range(rounds):
        for j, total in _totals(stored, Screen(centroids, blocks), dim, blocks).items():
            centroids[j] = [v // total[dim] for v in total[:dim]]
    screen = Screen(centroids, blocks)
    last = {j: total[dim + 1] for j, total in _totals(stored, screen, dim, blocks).items()}
    fits = lambda v: v if v < 1 << 63 else None
    names = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    facts = [(j, fits(inertia), fits(sum(last.values())), names[j]) for j, inertia in last.items()]
    facts = vectors.sparkSession.createDataFrame(facts, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    found = stored.mapInArrow(_assigned(screen, dim, blocks), "vec_id long, cluster int, distance long")
    # k rows at most
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")

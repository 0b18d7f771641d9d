"""An index for nearest neighbours: rows in the cells of fitted centroids, probed by joins of both sides.

Centroids and the number of cells to probe are fitted on a bounded sample;
every row is indexed. Rows and queries meet in blocks of a cell by a shuffle:
neither side is collected or broadcast, and a cell that holds a third of the
rows, or is asked by a third of the queries, is many blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataframe.operators.retrieval import TILE, _nearest, top_k

#: Most cells, most sampled rows of all, and sampled rows that calibrate the probes.
MOST_CELLS, SAMPLE_ROWS, CALIBRATION = 4096, 65_536, 256
#: Rows and queries of a block of a cell.
ROW_BLOCK, QUERY_BLOCK = 8192, 1024


@dataclass(frozen=True)
class Cells:
    """Centroids (at most MOST_CELLS), and how many cells a query probes."""

    centroids: np.ndarray
    probes: int

    def near(self, v: np.ndarray, n: int) -> np.ndarray:
        """The n nearest cells of each vector, nearest first."""
        d = (self.centroids**2).sum(axis=1)[None] - 2 * v @ self.centroids.T
        if n < d.shape[1]:
            part = np.argpartition(d, n - 1, axis=1)[:, :n]
            return np.take_along_axis(part, np.take_along_axis(d, part, axis=1).argsort(axis=1, kind="stable"), axis=1)
        return d.argsort(axis=1, kind="stable")


def _kmeans(x: np.ndarray, cells: int, rounds: int = 10) -> np.ndarray:
    rng = np.random.default_rng(11)
    c = x[rng.choice(len(x), cells, replace=False)].copy()
    for _ in range(rounds):
        at = np.concatenate([((c**2).sum(1)[None] - 2 * x[i : i + 4096] @ c.T).argmin(axis=1) for i in range(0, len(x), 4096)])
        n = np.bincount(at, minlength=cells)
        total = np.zeros_like(c)
        np.add.at(total, at, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
    return c


def _calibrated(x: np.ndarray, centroids: np.ndarray, k: int, target: float) -> int:
    """The fewest cells that give sampled queries ``target`` of their k nearest sampled rows."""
    cells, q = Cells(centroids, 1), x[:: max(1, len(x) // CALIBRATION)]
    home = np.concatenate([cells.near(x[i : i + 4096], 1)[:, 0] for i in range(0, len(x), 4096)])
    d = (x**2).sum(1)[None] - 2 * q @ x.T
    near = np.argpartition(d, min(k, len(x) - 1), axis=1)[:, : min(k, len(x))]
    place = np.empty((len(q), len(centroids)), np.int64)
    np.put_along_axis(place, cells.near(q, len(centroids)), np.arange(len(centroids))[None].repeat(len(q), axis=0), axis=1)
    needed = np.sort(np.take_along_axis(place, home[near], axis=1).ravel()) + 1
    return int(needed[min(len(needed) - 1, int(np.ceil(target * len(needed))))])


def fit(corpus: DataFrame, key: str, vector: str, k: int = 15, target: float = 0.95, sample_rows: int = SAMPLE_ROWS) -> Cells:
    """Cells of a corpus, about the square root of its rows, and probes for a recall of ``target`` at k.

    The sample, at most about ``sample_rows`` rows drawn by a hash of the key,
    is all that the driver sees.
    """
    some = corpus.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    n = some.count()
    if not n:
        return Cells(np.zeros((0, 0)), 0)
    draw = F.pmod(F.xxhash64(F.lit("cells"), "id"), F.lit(1 << 30)) < int((1 << 30) * min(1.0, sample_rows / n)) + 1
    x = np.array([r[0] for r in some.filter(draw).select("v").limit(2 * sample_rows).collect()], np.float64)
    if not len(x):
        x = np.array([some.first()["v"]], np.float64)
    c = _kmeans(x, max(1, min(MOST_CELLS, round(n**0.5), len(x))))
    return Cells(c, _calibrated(x, c, k, target))


def index(corpus: DataFrame, key: str, vector: str, cells: Cells) -> DataFrame:
    """key, vector, cell of every row with a vector; ``write`` it by ``repartition("cell")`` so that a cell lies together."""
    held = corpus.sparkSession.sparkContext.broadcast(cells)

    def run(batches):
        for b in batches:
            if b.num_rows:
                v = np.stack(b.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(held.value.near(v, 1)[:, 0].astype(np.int32))], names=[key, vector, "cell"])

    rows = corpus.filter(F.col(vector).isNotNull()).select(F.col(key).cast("long").alias(key), F.col(vector).cast("array<double>").alias(vector))
    return rows.mapInArrow(run, f"{key} long, {vector} array<double>, cell int")


def save(indexed: DataFrame, cells: Cells, path: str) -> None:
    """Rows sorted by cell, and the cells beside them."""
    spark = indexed.sparkSession
    indexed.repartition("cell").sortWithinPartitions("cell").write.mode("overwrite").parquet(f"{path}/rows")
    rows = [(i, c, cells.probes) for i, c in enumerate(cells.centroids.tolist())]
    spark.createDataFrame(rows, "cell int, centroid array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{path}/cells")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, Cells]:
    rows = sorted(spark.read.parquet(f"{path}/cells").collect(), key=lambda r: r.cell)
    return spark.read.parquet(f"{path}/rows"), Cells(np.array([r.centroid for r in rows]), rows[0].probes if rows else 0)


def _probed(q_key: str, q_vector: str, held):
    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                v = np.stack(part.column(1).to_numpy(zero_copy_only=False)).astype(np.float64)
                near = held.value.near(v, held.value.probes)
                rows = pa.array(np.repeat(np.arange(len(v)), near.shape[1]))
                yield pa.record_batch([part.column(0).take(rows), part.column(1).take(rows), pa.array(near.ravel().astype(np.int32))], names=[q_key, q_vector, "cell"])

    return run


def _met(q_key: str, q_vector: str, key: str, vector: str, k: int):
    def run(asks: pa.Table, rows: pa.Table) -> pa.Table:
        matrix = lambda t, c: np.stack(t.column(c).combine_chunks().to_numpy(zero_copy_only=False)).astype(np.float64)
        found = []
        if asks.num_rows and rows.num_rows:
            qid, qv, own, v = asks.column(q_key).to_numpy(), matrix(asks, q_vector), rows.column(key).to_numpy(), matrix(rows, vector)
            found = [_nearest(qid[i : i + TILE], qv[i : i + TILE], own, v, k) for i in range(0, len(qid), TILE)]
        col = lambda i, kind: pa.array(np.concatenate([f[i] for f in found]) if found else [], kind)
        return pa.table([col(0, pa.int64()), col(1, pa.int64()), col(2, pa.float64())], names=[q_key, key, "distance"])

    return run


def search(indexed: DataFrame, cells: Cells, key: str, vector: str, queries: DataFrame, q_key: str, q_vector: str, k: int, probes: int | None = None) -> DataFrame:
    """q_key, key, distance, score = 1 / (1 + squared L2), rank: the k nearest rows within the probed cells of each query.

    With ``probes`` of all cells the answer is exact. Queries without a vector
    have no rows.
    """
    spark = indexed.sparkSession
    if not len(cells.centroids):
        return spark.createDataFrame([], f"{q_key} long, {key} long, distance double, rank long, score double")
    held = spark.sparkContext.broadcast(Cells(cells.centroids, min(probes or cells.probes, len(cells.centroids))))
    own = queries.filter(F.col(q_vector).isNotNull()).select(F.col(q_key).cast("long").alias(q_key), F.col(q_vector).cast("array<double>").alias(q_vector))
    asks = own.mapInArrow(_probed(q_key, q_vector, held), f"{q_key} long, {q_vector} array<double>, cell int")
    # a row for each cell, MOST_CELLS at most
    blocks = lambda df, size, name: df.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = F.broadcast(blocks(indexed, ROW_BLOCK, "n_rows").join(blocks(asks, QUERY_BLOCK, "n_asks"), "cell"))
    dealt = lambda df, k_, n, other: df.join(sizes, "cell").select(*df.columns, F.pmod(F.xxhash64(k_), F.col(n)).cast("int").alias("mine"), F.explode(F.sequence(F.lit(0), F.col(other) - 1)).alias("theirs"))
    a = dealt(asks, q_key, "n_asks", "n_rows").select("cell", F.col("mine").alias("qb"), F.col("theirs").alias("rb"), q_key, q_vector)
    r = dealt(indexed, key, "n_rows", "n_asks").select("cell", F.col("theirs").alias("qb"), F.col("mine").alias("rb"), key, vector)
    met = a.groupBy("cell", "qb", "rb").cogroup(r.groupBy("cell", "qb", "rb")).applyInArrow(_met(q_key, q_vector, key, vector, k), f"{q_key} long, {key} long, distance double")
    return top_k(met, q_key, k, F.round("distance", 9), F.col(key)).withColumn("score", 1 / (1 + F.col("distance")))

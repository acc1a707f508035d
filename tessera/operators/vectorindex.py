"""An approximate vector index: vectors in cells about centroids, searches that read the nearest cells, and the recall that this gives."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Vectors that centroids are fitted on, and vectors that recall is measured with, at most or about.
FIT, TRIALS = 100_000, 64


def usable(vector: Column) -> Column:
    """Whether a vector has a direction: no null, no component that is null or not finite, not all 0."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce((F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _sampled(df: DataFrame, size: int, salt: int) -> DataFrame:
    """About ``size`` rows by a hash of their id, or all where there are no more."""
    n = df.count()
    return df if n <= size else df.where(F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1 << 20)) < math.ceil(size / n * (1 << 20)))


def _cells(df: DataFrame, centroids: np.ndarray) -> DataFrame:
    """``id, vector, cell``: unit vectors with the centroid nearest by angle."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype("float64")
                flat = flat / np.linalg.norm(flat, axis=1, keepdims=True)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array((flat @ centroids.T).argmax(axis=1).astype("int32"))], names=["id", "vector", "cell"])

    return df.mapInArrow(place, df.select("id", "vector").schema.add("cell", "integer"))


def build(df: DataFrame, folder: str, *, id_col: str, vector: str, cells: int | None = None, recall: float = 0.95, k: int = 50, seed: int = 7) -> None:
    """Write the index of ``df``'s vectors, all of one length, to ``folder``: ``vectors`` (id, vector), partitioned by cell, and ``about``.

    Centroids are fitted by spherical k-means on about ``FIT`` vectors, by hash of their ids; every vector is placed, in the cell of the centroid
    nearest by angle. There are about as many cells as the root of the vectors, 4,096 at most (the centroids are held by each task), or ``cells``.
    Then recall is measured: ``TRIALS`` or so vectors are searched exactly and in ever more of their nearest cells, and ``about`` gets the number of cells that
    finds ``recall`` of their ``k`` nearest, with what it has found. Vectors without a direction are left out; if there are
    no others, that is a ``ValueError``.
    """
    spark = df.sparkSession
    good = df.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")).where(usable(F.col("vector")))
    n = good.count()
    if not n:
        raise ValueError("no vector has a direction")
    cells = cells or max(1, min(4096, round(math.sqrt(n))))
    sample = _sampled(good, FIT, 1).select(array_to_vector(F.col("vector").cast("array<double>")).alias("features"))
    fitted = KMeans(k=cells, seed=seed, maxIter=10, distanceMeasure="cosine", initMode="random").fit(sample).clusterCenters() if n > cells > 1 else [r["vector"] for r in good.orderBy("id").limit(1).collect()]
    centroids = np.array(fitted, "float64").reshape(len(fitted), -1)
    centroids /= np.maximum(np.linalg.norm(centroids, axis=1, keepdims=True), 1e-12)
    # A cell of many vectors is dealt to several tasks and files.
    _cells(good, centroids).repartitionByRange("cell", "id").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{folder}/vectors")
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centroids)], "cell int, centroid array<double>").coalesce(1).write.parquet(f"{folder}/centroids")
    stored = spark.read.parquet(f"{folder}/vectors")
    probes, found = _calibrated(stored, centroids, recall, k)
    spark.createDataFrame([(probes, float(found), len(centroids), k)], "probes int, recall double, cells int, k int").coalesce(1).write.json(f"{folder}/about")


def _calibrated(stored: DataFrame, centroids: np.ndarray, recall: float, k: int) -> tuple[int, float]:
    """The least number of nearest cells in which ``recall`` of the ``k`` nearest of a sample of vectors lie, and that share.

    For each sampled vector its nearest ``k`` are found among all; how near a cell each lies in gives the recall of every number of cells at once.
    """
    trials = [(r["id"], list(r["vector"])) for r in _sampled(stored.select("id", "vector"), TRIALS, 2).orderBy(F.xxhash64("id"), "id").limit(4 * TRIALS).collect()]
    if not trials:
        return 1, 1.0
    asked = np.array([v for _, v in trials], "float64")
    asked /= np.linalg.norm(asked, axis=1, keepdims=True)
    order = np.argsort(-(asked @ centroids.T), axis=1, kind="stable")
    place = np.empty_like(order)
    np.put_along_axis(place, order, np.arange(len(centroids))[None, :].repeat(len(asked), 0), 1)

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype("float64")
                score = asked @ (flat / np.linalg.norm(flat, axis=1, keepdims=True)).T
                top = np.argsort(-score, axis=1)[:, :k]
                cell = batch.column(1).to_numpy()
                t = np.repeat(np.arange(len(asked)), top.shape[1])
                yield pa.RecordBatch.from_arrays([pa.array(t), pa.array(np.take_along_axis(score, top, 1).ravel()), pa.array(place[t, cell[top.ravel()]])], names=["trial", "score", "place"])

    near = stored.select("vector", "cell").mapInArrow(best, "trial long, score double, place long")
    first = near.withColumn("n", F.row_number().over(Window.partitionBy("trial").orderBy(F.desc("score")))).where(F.col("n") <= k)
    held = {r["place"]: r["count"] for r in first.groupBy("place").count().collect()}  # a row for each cell at most
    total, seen = sum(held.values()), 0
    for i in range(len(centroids)):
        seen += held.get(i, 0)
        if seen >= recall * total:
            return i + 1, seen / total
    return len(centroids), 1.0


@dataclass(frozen=True)
class Near:
    """A search's rows ``id, score``, and the cells that it read of those there are."""

    rows: DataFrame
    read: int
    cells: int


class VectorIndex:
    """An index that ``build`` has written, opened for searches."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        about = spark.read.schema("probes int, recall double, cells int, k int").json(f"{folder}/about").first()
        self.probes, self.recall, self.cells = about["probes"], about["recall"], about["cells"]

    def vectors(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/vectors")

    def search(self, query: list[float], *, limit: int, allowed: DataFrame | None = None, probes: int | None = None) -> Near:
        """The ``limit`` nearest by cosine, ties by id, among the vectors in the ``probes`` cells nearest to ``query`` (those of the build if none is given).

        Only those cells' partitions are read. With ``allowed(id)``, which restricts the vectors before they are ranked, cells are added, nearest first and
        twice as many each time, until ``limit`` allowed vectors lie in them, so that a narrow filter does not leave the result short.
        """
        asked = np.asarray(query, "float64")
        if asked.ndim != 1 or not np.isfinite(asked).all() or not asked.any():
            raise ValueError("a query is one vector of finite components, not all 0")
        rows = self.spark.read.parquet(f"{self.folder}/centroids").collect()  # 4,096 at most
        order = [r["cell"] for r in sorted(rows, key=lambda r: (-float(np.dot(asked, r["centroid"])), r["cell"]))]
        n = min(probes or self.probes, len(order))
        while True:
            read = self.vectors().where(F.col("cell").isin(order[:n])).select("id", "vector")
            read = read if allowed is None else read.join(allowed, "id", "left_semi")
            if n == len(order) or read.limit(limit).count() >= limit:
                break
            n = min(2 * n, len(order))
        probe = F.array(*(F.lit(float(x)) for x in asked))
        dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
        score = F.try_divide(dot(F.col("vector"), probe), F.sqrt(dot(F.col("vector"), F.col("vector"))) * F.sqrt(dot(probe, probe)))
        return Near(read.select("id", score.alias("score")).orderBy(F.desc("score"), "id").limit(limit), n, len(order))

"""An approximate vector index: cells of nearest centroids, a few of which are searched, with exact similarities."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import small_batches
from . import search

#: Vectors that the centroids are fitted on, at most; every vector is indexed.
SAMPLE = 20_000
ROUNDS = 10


def unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def centroids_of(vectors: np.ndarray, cells: int, seed: int = 0) -> np.ndarray:
    """Spherical k-means: unit centroids; one that loses all its vectors starts again at a random one."""
    rng = np.random.default_rng(seed)
    x = unit_rows(vectors)
    out = x[rng.choice(len(x), min(cells, len(x)), replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(x @ out.T, axis=1)
        sums = np.zeros_like(out)
        np.add.at(sums, own, x)
        lost = np.bincount(own, minlength=len(out)) == 0
        sums[lost] = x[rng.choice(len(x), int(lost.sum()))]
        out = unit_rows(sums)
    return out


def probes_for(vectors: np.ndarray, centers: np.ndarray, recall: float, k: int = 10, queries: int = 200, seed: int = 0) -> int:
    """How many cells a search must read to find that share of the k nearest, by a full search among ``vectors``.

    Neighbours in the whole table are nearer than in a sample of it, so their cells are no further down.
    """
    x = unit_rows(vectors)
    picks = np.random.default_rng(seed).choice(len(x), min(queries, len(x)), replace=False)
    sims = x[picks] @ x.T
    sims[np.arange(len(picks)), picks] = -np.inf
    near = np.argsort(-sims, axis=1, kind="stable")[:, : min(k, len(x) - 1)]
    if not near.size:
        return len(centers)
    order = np.argsort(-(x[picks] @ centers.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    own = np.argmax(x @ centers.T, axis=1)
    return int(np.quantile(np.take_along_axis(place, own[near], axis=1), recall, method="higher")) + 1


class CellIndex:
    """A table of vectors, written by cell, so a search reads the folders of a few cells only.

    How many cells is measured when the index is built: few where vectors cluster, most where they don't.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def build(self, vectors: DataFrame, cells: int | None = None, key: str = "point_id", vector: str = "embedding", sample: int = SAMPLE, recall: float = 0.97) -> CellIndex:
        """Indexes all vectors longer than 0 (key, vector, norm): centroids from a sample of at most ``sample``, by default sqrt(n) cells, 4,096 at most.

        ``recall`` is the share of the 10 nearest that a search should find, measured on the sample.
        """
        rows = search.indexable(vectors.select(F.col(key).alias("key"), F.col(vector).alias("vector")), 0.0, vector="vector")
        n = rows.count()
        if not n:
            raise ValueError("no vector to index")
        drawn = rows.select("vector") if n <= sample else rows.orderBy(F.xxhash64("key")).limit(sample).select("vector")
        fitted = np.array([r["vector"] for r in drawn.collect()], np.float64)
        centers = centroids_of(fitted, cells or int(min(4096, max(1, round(n**0.5)))))
        probes = probes_for(fitted, centers, recall)
        self.spark.createDataFrame([(i, c.tolist(), probes) for i, c in enumerate(centers)], "cell int, center array<double>, probes int").coalesce(1).write.mode("overwrite").parquet(f"{self.path}/centers")
        small_batches(self.spark, 2_000)
        sent = self.spark.sparkContext.broadcast(centers)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = np.array(batch.column(1).to_pylist(), np.float64).reshape(len(batch), -1)
                cell = np.argmax(x @ sent.value.T, axis=1) if len(batch) else np.zeros(0, int)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell.astype(np.int32))], names=["key", "vector", "norm", "cell"])

        kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
        # a large cell is dealt to several tasks and files; cells share none of them
        placed = rows.mapInArrow(run, f"{kinds}, cell int").withColumn("deal", F.pmod(F.xxhash64("key"), F.lit(max(1, n // 1_000_000 + 1))))
        placed.repartition("cell", "deal").drop("deal").write.mode("overwrite").partitionBy("cell").parquet(f"{self.path}/cells")
        return self

    def search(self, query: Sequence[float], k: int, probes: int | None = None) -> DataFrame:
        """(key, sim) of the k most similar vectors in the ``probes`` cells nearest to the query, by default as many as the build measured."""
        rows = self.spark.read.parquet(f"{self.path}/centers").orderBy("cell").collect()
        centers = np.array([r["center"] for r in rows])
        probes = rows[0]["probes"] if probes is None else probes
        near = np.argsort(-(centers @ np.asarray(query, np.float64)), kind="stable")[:probes]
        own = self.spark.read.parquet(f"{self.path}/cells").where(F.col("cell").isin([int(c) for c in near]))
        return search.top_k(own, query, k, key="key", vector="vector", length="norm")

"""Vector collections and exact cosine search."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.names import point_document
from ..functions.vectors import dot, norm

#: Hits that one task may rank; beyond, only a band around the k-th similarity is ordered: this share of all rows on either side.
TASK_ROWS, BAND = 100_000, 0.002


def indexable(vectors: DataFrame, zero_norm: float = 1e-3, key: str = "point_id", vector: str = "embedding", dim: int | None = None) -> DataFrame:
    """Rows whose vector is longer than ``zero_norm``, with ``norm``; ids stay."""
    return vectors.withColumn("norm", norm(F.col(vector), dim)).where(F.col("norm") > zero_norm)


def norm_report(vectors: DataFrame, zero_norm: float = 1e-3, vector: str = "embedding") -> DataFrame:
    """n_vectors, n_kept, n_zero."""
    kept = F.coalesce(norm(F.col(vector)) > zero_norm, F.lit(False))
    return vectors.agg(F.count("*").alias("n_vectors"), F.count_if(kept).alias("n_kept"), F.count_if(~kept).alias("n_zero"))


def similarity(vector: Column, query: Sequence[float], length: Column | None = None) -> Column:
    """Cosine similarity to a constant vector, null for a vector of norm 0; ``length`` is the vector's norm if it is stored."""
    size = float(sum(float(x) * float(x) for x in query)) ** 0.5
    return F.try_divide(dot(vector, query), (norm(vector, len(query)) if length is None else length) * F.lit(size))


def top_k(vectors: DataFrame, query: Sequence[float], k: int, key: str = "point_id", vector: str = "embedding", length: str | None = None, task_rows: int = TASK_ROWS) -> DataFrame:
    """(key, sim) of the k most similar vectors, ties by key: each task keeps k rows, no full sort.

    Beyond ``task_rows`` the k rows are not ranked in one task: rows surely above the k-th similarity
    are a filter, and only those in a narrow band around it (and those equal there) are ordered. The
    result is then unordered.
    """
    sim = similarity(F.col(vector), query, F.col(length) if length else None)
    scored = vectors.select(key, sim.alias("sim"))
    rank = F.round("sim", 10)
    if k > task_rows:
        n = scored.count()
        if k >= n:
            return scored
        at = [max(0.0, 1 - k / n - BAND), min(1.0, 1 - k / n + BAND)]
        low, high = scored.agg(F.percentile_approx(rank, at, int(4 / BAND)).alias("p")).first()["p"] or (None, None)
        if low is not None:
            above, upto = scored.agg(F.count_if(rank > high), F.count_if(rank >= low)).first()
            if above <= k <= upto:
                band = scored.where((rank >= low) & (rank <= high)).orderBy(F.desc(rank), key).limit(k - above)
                return scored.where(rank > high).unionByName(band)
    return scored.orderBy(F.desc(rank), key).limit(k)


def calibrated(hits: DataFrame, mid: float = 0.75, step: float = 0.1) -> DataFrame:
    """Adds ``score``: mid + step x z-score of the similarity among the hits, clipped to 0 to 1."""
    stats = hits.agg(F.avg("sim").alias("__mu"), F.stddev_pop("sim").alias("__sd"))
    z = (F.col("sim") - F.col("__mu")) / (F.col("__sd") + 1e-8)
    score = F.least(F.greatest(F.lit(mid) + F.lit(step) * z, F.lit(0.0)), F.lit(1.0))
    return hits.crossJoin(F.broadcast(stats)).withColumn("score", score).drop("__mu", "__sd")


def default_k(n: int) -> int:
    """How many hits a user interface offers for n points."""
    return min(max(1000, n // 5), n)


class Collections:
    """Named vector collections under a folder: Parquet of (id, document, point_id, embedding, norm).

    A collection is replaced as a whole: a new version is written beside the old one, then a pointer
    table is overwritten, so readers never see half of one.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self, name: str) -> str:
        return f"{self.path}/{name}/current"

    def exists(self, name: str) -> bool:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self._versions(name))
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def replace(self, name: str, vectors: DataFrame, zero_norm: float = 1e-3) -> DataFrame:
        version = f"{self.path}/{name}/v-{uuid.uuid4().hex}"
        rows = indexable(vectors.select("point_id", "embedding"), zero_norm)
        rows.select(F.col("point_id").cast("string").alias("id"), point_document(F.col("point_id")).alias("document"), "point_id", "embedding", "norm").write.parquet(version)
        self.spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(self._versions(name))
        return self.open(name)

    def open(self, name: str) -> DataFrame:
        if not self.exists(name):
            raise ValueError(f"no collection {name!r}")
        return self.spark.read.parquet(self.spark.read.schema("version string").json(self._versions(name)).first()["version"])

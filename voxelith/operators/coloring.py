"""Colouring of point clouds: overlays, cluster palettes and principal components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from ..functions.colors import blended, quantized, ramp

RGB = ("r", "g", "b")
GREY = 0.5


def autoscaled(points: DataFrame) -> DataFrame:
    """Colours as 0 to 1: divided by 255 if any is above 1."""
    top = points.agg(F.max(F.greatest(*RGB)).alias("__top"))
    out = points.crossJoin(F.broadcast(top))
    return out.withColumns({c: F.when(F.col("__top") > 1.0, F.col(c) / 255.0).otherwise(F.col(c).cast("double")) for c in RGB}).drop("__top")


def quantized_scores(hits: DataFrame, bins: int = 200) -> DataFrame:
    """Adds ``level``: the score scaled over all hits and rounded to one of ``bins``."""
    span = hits.agg(F.min("score").alias("__lo"), F.max("score").alias("__hi"))
    return hits.crossJoin(F.broadcast(span)).withColumn("level", quantized(F.col("score"), F.col("__lo"), F.col("__hi"), bins)).drop("__lo", "__hi")


def overlay(points: DataFrame, hits: DataFrame, alpha: float = 0.8, bins: int = 200, key: str = "point_id") -> DataFrame:
    """All points; those among the hits (key, score) blend with the colour map at their level."""
    levels = quantized_scores(hits, bins).select(F.col(key).alias("__hit"), "level")
    out = points.join(levels, F.col(key) == F.col("__hit"), "left")
    for c, over in zip(RGB, ramp(F.col("level")), strict=True):
        out = out.withColumn(c, F.when(F.col("level").isNull(), F.col(c)).otherwise(blended(over, F.col(c), alpha)))
    return out.drop("__hit", "level")


def palette(labels: list[int], seed: int = 42) -> dict[int, tuple[float, float, float]]:
    """A random colour for each label in order; noise (-1) is grey."""
    colors = np.random.default_rng(seed).random((len(labels), 3)).astype(np.float32)
    return {x: (GREY,) * 3 if x == -1 else tuple(float(v) for v in c) for x, c in zip(sorted(labels), colors, strict=True)}


def cluster_colored(points: DataFrame, colors: DataFrame, alpha: float = 0.5, label: str = "cluster_label") -> DataFrame:
    """Points blended with their label's colour, from a table (label, pr, pg, pb)."""
    out = points.join(colors, label)
    return out.withColumns({c: blended(F.col(f"p{c}"), F.col(c), alpha) for c in RGB}).drop("pr", "pg", "pb")


def cluster_counts(points: DataFrame, label: str = "cluster_label") -> DataFrame:
    """Points per label, noise left out."""
    return points.where(F.col(label) >= 0).groupBy(label).agg(F.count("*").alias("n"))


def top_clusters(points: DataFrame, k: int = 5, label: str = "cluster_label") -> DataFrame:
    return cluster_counts(points, label).orderBy(F.desc("n"), F.desc(label)).limit(k)


def above_quantile(rows: DataFrame, value: str, q: float) -> DataFrame:
    """Rows above the exact, linearly interpolated quantile."""
    cut = rows.agg(F.percentile(value, q).alias("__cut"))
    return rows.crossJoin(F.broadcast(cut)).where(F.col(value) > F.col("__cut")).drop("__cut")


def pca_colored(points: DataFrame, vector: str = "embedding", eps: float = 1e-10) -> DataFrame:
    """Colours from the first three principal components, each scaled to 0 to 1; signs are turned so
    that the largest loading is positive."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = points.withColumn("__v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    model = PCA(k=3, inputCol="__v", outputCol="__p").fit(rows)
    loads = model.pc.toArray()
    signs = [1.0 if loads[np.abs(loads[:, i]).argmax(), i] >= 0 else -1.0 for i in range(3)]
    rows = model.transform(rows).withColumn("__a", vector_to_array("__p"))
    rows = rows.withColumns({f"__{c}": F.get("__a", F.lit(i)) * signs[i] for i, c in enumerate(RGB)})
    span = rows.agg(*[f(f"__{c}").alias(f"__{n}{c}") for c in RGB for n, f in (("lo", F.min), ("hi", F.max))])
    rows = rows.crossJoin(F.broadcast(span))
    rows = rows.withColumns({c: (F.col(f"__{c}") - F.col(f"__lo{c}")) / (F.col(f"__hi{c}") - F.col(f"__lo{c}") + eps) for c in RGB})
    return rows.drop("__v", "__p", "__a", *[f"__{x}{c}" for c in RGB for x in ("", "lo", "hi")])

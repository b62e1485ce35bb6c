"""Voxel averages and merges of point clouds."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.geometry import voxel_index
from ..functions.vectors import normalized, vector_sum

XYZ = ("x", "y", "z")


def voxel_keys(size: float) -> list[Column]:
    return [voxel_index(F.col(c), size).alias(f"v{c}") for c in XYZ]


def voxel_average(points: DataFrame, size: float, means: Sequence[str] = ("x", "y", "z", "r", "g", "b"), vector: str | None = None, dim: int = 0, by: Sequence[Column] = (), count: str | None = None) -> DataFrame:
    """One point per voxel: the mean of ``means``, and the unit vector of the summed ``vector``.

    One hash aggregation with fixed-width sums: a map task sends one row per voxel it has seen.
    """
    named = [c.alias(f"__k{i}") for i, c in enumerate(by)]
    out = points.groupBy(*named, *voxel_keys(size)).agg(
        *[F.avg(F.col(c).cast("double")).alias(c) for c in means],
        *([vector_sum(F.col(vector), dim).alias(vector)] if vector else []),
        *([F.count("*").alias(count)] if count else []),
    )
    return out.withColumn(vector, normalized(F.col(vector))) if vector else out


def merge_pairwise(points: DataFrame, size: float, ordinal: str = "ford", frames: int | None = None, means: Sequence[str] = ("x", "y", "z", "r", "g", "b"), vector: str | None = None, dim: int = 0) -> DataFrame:
    """The unweighted tree merge of frame clouds: frames 0 and 1, 2 and 3, ... are averaged per voxel, then their
    results, until one is left. ``ordinal`` numbers the non-empty frames from 0 without a gap.

    Each pass is one aggregation; a cloud without a partner is carried as it is.
    """
    if frames is None:
        frames = (points.agg(F.max(ordinal)).first()[0] or 0) + 1
    out = points.select(F.col(ordinal).cast("long").alias(ordinal), *[F.col(c).cast("double").alias(c) for c in means], *([vector] if vector else []))
    for _ in range(math.ceil(math.log2(frames)) if frames > 1 else 0):
        last = frames - 1
        alone = (F.col(ordinal) == last) if frames % 2 else F.lit(False)
        pair = F.floor(F.col(ordinal) / 2)
        merged = voxel_average(out.where(~alone), size, means, vector, dim, by=[pair]).withColumnRenamed("__k0", ordinal)
        keep = [ordinal, *means, *([vector] if vector else [])]
        if frames % 2:
            tail = out.where(alone).withColumn(ordinal, pair).select(*keep)
            if vector:
                tail = tail.withColumn(vector, F.transform(vector, lambda x: x.cast("double")))
            merged = merged.select(*keep).unionByName(tail)
        out = merged.select(*keep)
        frames = (frames + 1) // 2
    return out.drop(ordinal)


def merge_weighted(points: DataFrame, size: float, means: Sequence[str] = ("x", "y", "z", "r", "g", "b"), vector: str | None = None, dim: int = 0) -> DataFrame:
    """All frames at once, each point weighing the same: one aggregation, in any order of frames."""
    return voxel_average(points, size, means, vector, dim, count="n")

"""Scene tables as streams: frames arrive as files, voxel means are kept up to date."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..config import SceneConfig
from ..operators import voxels
from ..plans.scene import world_points


def pixel_stream(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """Pixels of new frames, from Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def point_stream(pixels: DataFrame, cfg: SceneConfig) -> DataFrame:
    """World points of a pixel stream; the same expressions as in a batch."""
    return world_points(pixels, cfg, high_included=False)


def voxel_means(points: DataFrame, size: float) -> DataFrame:
    """Running weighted means per voxel, for an update or complete sink; the state is one row of sums a voxel."""
    keys = voxels.voxel_keys(size)
    return points.groupBy(*keys).agg(F.count("*").alias("n"), *[F.avg(F.col(c)).alias(c) for c in ("x", "y", "z", "r", "g", "b")])

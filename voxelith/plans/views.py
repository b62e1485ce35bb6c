"""Stand-in views: the logical tables of a scene on the driver's tables, for Spark and as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

FX, FY, CX, CY = 577.870605, 577.870605, 319.5, 239.5

POINTS = {
    "point_id": "vec_id",
    "x": "CAST(embedding[{0}] AS DOUBLE)",
    "y": "CAST(embedding[{1}] AS DOUBLE)",
    "z": "CAST(embedding[{2}] AS DOUBLE)",
    "r": "(CAST(embedding[{3}] AS DOUBLE) + 1) / 2",
    "g": "(CAST(embedding[{4}] AS DOUBLE) + 1) / 2",
    "b": "(CAST(embedding[{5}] AS DOUBLE) + 1) / 2",
    "embedding": "embedding",
    "cluster_label": "label",
    "ford": "CAST(vec_id % 7 AS INT)",
}
PIXELS = {
    "frame": "CAST(l_orderkey % 16 AS INT)",
    "mask_id": "CAST(l_linenumber AS INT)",
    "v": "CAST((l_suppkey * 7 + l_linenumber) % 480 AS INT)",
    "u": "CAST(l_partkey % 640 AS INT)",
    "depth_mm": "CAST(FLOOR(l_extendedprice / 15) AS INT)",
    "red": "CAST(l_quantity * 5 AS INT)",
    "l_orderkey": "l_orderkey",
    "l_linenumber": "l_linenumber",
    "l_partkey": "l_partkey",
    "l_suppkey": "l_suppkey",
}
POSES = {
    "frame": "CAST(n_nationkey AS INT)",
    "r00": "CAST(CASE WHEN n_nationkey % 5 = 4 THEN 2.0 ELSE 1.0 END AS DOUBLE) * COS(CAST(n_nationkey AS DOUBLE) / 10)",
    "r01": "-SIN(CAST(n_nationkey AS DOUBLE) / 10)",
    "r10": "SIN(CAST(n_nationkey AS DOUBLE) / 10)",
    "r11": "COS(CAST(n_nationkey AS DOUBLE) / 10)",
    "tx": "CAST(n_nationkey AS DOUBLE) / 4",
    "ty": "CAST(n_regionkey AS DOUBLE) / 2",
    "tz": "CAST(0.5 AS DOUBLE)",
}
#: The unique order of pixels.
PIXEL_ORDER = ("v", "u", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "depth_mm")


def _view(spark: SparkSession, sf_dir: str, table: str, columns: dict[str, str]) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(*[f"{e.format(*range(6))} AS {c}" for c, e in columns.items()])


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "embeddings", POINTS)


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "lineitem", PIXELS)


def poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _view(spark, sf_dir, "nation", POSES)


def _sql(name: str, table: str, columns: dict[str, str]) -> str:
    return f"{name} AS (SELECT {', '.join(f'{e.format(*range(1, 7))} AS {c}' for c, e in columns.items())} FROM {table})"


V_POINTS = _sql("v_points", "embeddings", POINTS)
V_PIXELS = _sql("v_pixels", "lineitem", PIXELS)
V_POSES = _sql("v_poses", "nation", POSES)

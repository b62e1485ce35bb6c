"""The scene build: frames to masks, sparse and dense clouds, vectors and a searchable collection."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from ..config import SceneConfig
from ..functions import geometry, images
from ..models import Embedder, Segmenter, query_vector
from ..operators import coloring, frames, knn, search, voxels
from ..operators.registry import Registry
from ..session import kept, ship
from ..sources import folders

log = logging.getLogger(__name__)
XYZ, RGB = ("x", "y", "z"), ("r", "g", "b")


def posed_frames(spark: SparkSession, root: str, stride: int = 1) -> DataFrame:
    """Frames that have colour, depth and a valid pose, every ``stride``-th of a scene's frames, with intrinsics; ``root`` holds scenes or is one."""
    all_frames = folders.images(spark, root)
    kept = frames.every_kth_frame(all_frames.select("scene", "frame"), stride).select("scene", "frame")
    out = all_frames.join(kept, ["scene", "frame"]).join(folders.poses(spark, root), ["scene", "frame"])
    return folders.with_intrinsics(out, folders.intrinsics(spark, root))


def world_points(pixels: DataFrame, cfg: SceneConfig, high_included: bool) -> DataFrame:
    """Pixels (v, u, depth_mm, pose, fx, fy, cx, cy) as finite world points in the depth range."""
    z = F.col("depth_mm") / F.lit(cfg.depth_scale)
    rows = pixels.withColumn("d", z).where(frames.in_depth(F.col("d"), cfg.min_depth, cfg.max_depth, high_included))
    point = geometry.unprojected(F.col("u"), F.col("v"), F.col("d"), *[F.col(c) for c in ("fx", "fy", "cx", "cy")])
    world = geometry.moved(geometry.pose_rows(F.col("pose")), point)
    rows = rows.withColumns(dict(zip(XYZ, world, strict=True)))
    return rows.where(geometry.finite(F.col("x")) & geometry.finite(F.col("y")) & geometry.finite(F.col("z")))


def segment(spark: SparkSession, root: str, cfg: SceneConfig, segmenter: Segmenter, embedder: Embedder, path: str) -> tuple[DataFrame, DataFrame]:
    """masks (scene, frame, mask_id, embedding, height, width, runs) and their object points (scene, frame, mask_id, v, u, x, y, z, r, g, b).

    One pass over the frames: masks, crops and vectors of a frame are made together, and their pixels
    are written as rows under ``path``; masks and points are both read from there, so they belong
    together whatever the models do, and the models run once a frame. A mask with fewer than
    ``min_points`` points in the depth range goes before the embedder sees it; ids keep its gap.
    ``runs`` are the mask's pixels as ``images.mask_of`` reads them.
    """
    ship(spark)
    source = posed_frames(spark, root, cfg.frame_stride)
    keep = ["scene", "frame", "fx", "fy", "cx", "cy"]
    columns = ["scene", "frame", "mask_id", "v", "u", "depth_mm", "r", "g", "b", "fx", "fy", "cx", "cy", "pose", "embedding", "height", "width", "runs"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                color, depth = folders.readable(r.color), folders.readable(r.depth)
                if color is None or depth is None:
                    continue
                color = color[:, :, :3]
                depth = depth if depth.shape == color.shape[:2] else images.resized_nearest(depth, *color.shape[:2])
                kept_masks = []
                for i, mask in enumerate(segmenter.masks(color)):
                    v, u = (x[:: cfg.point_stride] for x in np.nonzero(mask))
                    d = depth[v, u] / cfg.depth_scale
                    if len(v) and ((d > cfg.min_depth) & (d <= cfg.max_depth)).sum() >= cfg.min_points:
                        kept_masks.append((i, mask, v, u))
                crops = [images.masked_crop(m, color, cfg.crop_mode, cfg.crop_expand, cfg.dilate_size, cfg.dilate_rounds) for _, m, _, _ in kept_masks]
                vectors = embedder.images(crops) if crops else []
                for (i, mask, v, u), vector in zip(kept_masks, vectors, strict=True):
                    rgb = color[v, u] / 255.0
                    out = pd.DataFrame({"mask_id": i, "v": v, "u": u, "depth_mm": depth[v, u].astype(np.int32), "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2], "height": mask.shape[0], "width": mask.shape[1]})
                    for c in keep:
                        out[c] = getattr(r, c)
                    out["pose"] = [list(r.pose)] * len(out)
                    # the mask's own values stand on its first row only
                    out["embedding"] = [vector.astype(np.float32).tolist()] + [None] * (len(out) - 1)
                    out["runs"] = [images.mask_runs(mask).tolist()] + [None] * (len(out) - 1)
                    yield out[columns]

    schema = "scene string, frame string, mask_id int, v int, u int, depth_mm int, r double, g double, b double, fx double, fy double, cx double, cy double, pose array<double>, embedding array<float>, height int, width int, runs array<int>"
    pixels = _stage(spark, "pixels", path, source.mapInPandas(run, schema))
    masks = pixels.where("embedding IS NOT NULL").select("scene", "frame", "mask_id", "embedding", "height", "width", "runs")
    points = world_points(pixels.drop("embedding", "height", "width", "runs"), cfg, high_included=True)
    return masks, points.select("scene", "frame", "mask_id", "v", "u", *XYZ, *RGB)


def sparse_cloud(masks: DataFrame, points: DataFrame, cfg: SceneConfig, dim: int) -> DataFrame:
    """(point_id, x, y, z, r, g, b, embedding): object points with their mask's vector, merged over frames, without outliers."""
    key = ["scene", "frame", "mask_id"]
    rows = frames.every_kth_row(points, cfg.object_downsample, key, ["v", "u"])
    rows = frames.spread_vectors(rows, masks.select(*key, "embedding"), key)
    if cfg.merge_mode == "weighted":
        merged = voxels.merge_weighted(rows, cfg.merge_radius, vector="embedding", dim=dim).drop("vx", "vy", "vz", "n")
    else:
        # frames that have points, numbered without a gap; a few rows a scene
        order = rows.select("scene", "frame").distinct().withColumn("ford", F.row_number().over(W.orderBy("scene", "frame")) - 1)
        per_frame = rows.join(F.broadcast(order), ["scene", "frame"])
        own = voxels.voxel_average(per_frame, cfg.merge_radius, vector="embedding", dim=dim, by=[F.col("ford")]).withColumnRenamed("__k0", "ford")
        merged = voxels.merge_pairwise(own, cfg.merge_radius, vector="embedding", dim=dim)
    return frames.numbered_along(kept(merged.select(*XYZ, *RGB, "embedding")), [*XYZ], "point_id")


def without_outliers(cloud: DataFrame, cfg: SceneConfig) -> DataFrame:
    return cloud.join(knn.inliers(cloud, cfg.outlier_k, cfg.outlier_ratio).select("point_id"), "point_id", "left_semi")


def dense_cloud(spark: SparkSession, root: str, cfg: SceneConfig) -> DataFrame:
    """(point_id, x, y, z, r, g, b) of all frames on a grid, every ``dense_downsample``-th point."""
    posed = posed_frames(spark, root)
    facts = posed.select("scene", "frame", "pose", "fx", "fy", "cx", "cy")
    pixels = folders.pixels(posed, cfg.grid_stride).join(facts, ["scene", "frame"])
    points = world_points(pixels, cfg, high_included=False)
    return frames.every_kth_of_all(points, cfg.dense_downsample, ["scene", "frame"], ["v", "u"]).select("point_id", *XYZ, *RGB)


def embedded_cloud(dense: DataFrame, sparse: DataFrame, cfg: SceneConfig, dim: int) -> DataFrame:
    """The dense cloud with interpolated vectors."""
    return dense.join(knn.interpolated(dense, sparse, cfg.interpolation_k, cfg.sigma, dim), "point_id", "left")


def _stage(spark: SparkSession, name: str, path: str, df: DataFrame) -> DataFrame:
    began = time.time()
    df.write.mode("overwrite").parquet(f"{path}/{name}")
    log.info("%s: %.1f s", name, time.time() - began)
    return spark.read.parquet(f"{path}/{name}")


def scene_folder(spark: SparkSession, root: str, scene: str) -> str:
    """The folder of ``scene`` below ``root``, or ``root`` itself if it holds just one scene; of frame names only a few come back."""
    places = folders.files(spark, root, folders.COLOR_FILE).select("scene").distinct().limit(10_000).collect()
    names = {r.scene for r in places}
    if scene in names:
        return root if names == {scene} else f"{root.rstrip('/')}/{scene}"
    if len(names) > 1:
        raise ValueError(f"{root} holds {len(names)} scenes and none is {scene!r}")
    return root


def _some(df: DataFrame, what: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no frame gave a {what}")
    return df


#: Stages of a build, in order; each reads the tables of those before it.
STAGES = ("segment", "merge", "outliers", "dense", "interpolate", "index")


def run_stage(spark: SparkSession, stage: str, root: str, out: str, scene: str, segmenter: Segmenter, embedder: Embedder, cfg: SceneConfig = SceneConfig()) -> DataFrame:
    """One stage of a build from the tables that the earlier ones left under ``out``; returns its table."""
    path = f"{out}/scenes/{scene}"

    def read(name: str) -> DataFrame:
        return spark.read.parquet(f"{path}/{name}")

    if stage == "segment":
        masks, points = segment(spark, scene_folder(spark, root, scene), cfg, segmenter, embedder, path)
        _some(_stage(spark, "masks", path, masks), "mask")
        return _stage(spark, "object_points", path, points)
    if stage == "merge":
        return _stage(spark, "merged", path, sparse_cloud(read("masks"), read("object_points"), cfg, embedder.dim))
    if stage == "outliers":
        return _stage(spark, "sparse", path, without_outliers(read("merged"), cfg))
    if stage == "dense":
        return _some(_stage(spark, "dense", path, dense_cloud(spark, scene_folder(spark, root, scene), cfg)), "point")
    if stage == "interpolate":
        return _stage(spark, "dense_embedded", path, embedded_cloud(read("dense"), read("sparse"), cfg, embedder.dim))
    if stage == "index":
        name = collection_name(spark, scene)
        vectors = search.Collections(spark, f"{out}/vector_store").replace(name, read("dense_embedded").where("embedding IS NOT NULL"), cfg.zero_norm)
        Registry(spark, f"{out}/registry").register([(scene, f"{path}/dense_embedded", f"{out}/vector_store", name)])
        return vectors
    raise ValueError(f"unknown stage {stage!r}, not one of {', '.join(STAGES)}")


def build_scene(spark: SparkSession, root: str, out: str, scene: str, segmenter: Segmenter, embedder: Embedder, cfg: SceneConfig = SceneConfig(), force: bool = False) -> DataFrame:
    """All stages, each a Parquet table under ``out`` (not below ``root``), then the collection and the registry entry.

    Where ``root`` holds the folder of ``scene``, that one is built; else ``root`` must hold one scene alone. Raises at the first stage that fails or has no rows; a scene that is registered is only built again with ``force``.
    """
    if not force and not Registry(spark, f"{out}/registry").read().where(F.col("scene") == scene).isEmpty():
        raise ValueError(f"scene {scene!r} exists; force builds it again")
    for stage in STAGES:
        done = run_stage(spark, stage, root, out, scene, segmenter, embedder, cfg)
    return done


def collection_name(spark: SparkSession, scene: str) -> str:
    from ..functions.names import safe_name

    return spark.range(1).select(safe_name(F.lit(f"{scene}_points"))).first()[0]


def search_scene(spark: SparkSession, out: str, scene: str, embedder: Embedder, text: str | None = None, image: np.ndarray | None = None, k: int | None = None, cfg: SceneConfig = SceneConfig()) -> DataFrame:
    """(point_id, sim, score) of the k nearest points of a registered scene."""
    entry = Registry(spark, f"{out}/registry").lookup(scene)
    vectors = search.Collections(spark, entry["store_path"]).open(entry["collection"])
    k = search.default_k(vectors.count()) if k is None else k
    hits = search.top_k(vectors, query_vector(embedder, text, image), k, length="norm")
    return search.calibrated(hits, cfg.score_mid, cfg.score_step)


def colored_scene(spark: SparkSession, out: str, scene: str, hits: DataFrame, cfg: SceneConfig = SceneConfig()) -> DataFrame:
    """The scene's points with hits recoloured."""
    entry = Registry(spark, f"{out}/registry").lookup(scene)
    points = coloring.autoscaled(spark.read.parquet(entry["npz_file"]).drop("embedding"))
    return coloring.overlay(points, hits.select("point_id", "score"), cfg.overlay_alpha, cfg.overlay_bins)


def sensor_frames(spark: SparkSession, paths: list[str], frame_skip: int = 1) -> DataFrame:
    """Every ``frame_skip``-th frame of sensor streams, renumbered; a missing file fails the whole call."""
    import json

    from ..sources import sens

    sens.register(spark)
    rows = spark.read.format("sens").option("paths", json.dumps(paths)).option("frameSkip", str(frame_skip)).load()
    return frames.exported_frames(rows, frame_skip)


def extract(spark: SparkSession, paths: list[str], frame_skip: int = 1, height: int = 480, width: int = 640) -> DataFrame:
    """Sensor streams as resized frames (scene, export_idx, color, depth, pose)."""
    return folders.resized_frames(sensor_frames(spark, paths, frame_skip), height, width)


def ingest(spark: SparkSession, paths: list[str], root: str, frame_skip: int = 1, height: int = 480, width: int = 640) -> int:
    """Sensor streams to frame folders and intrinsics below ``root``; returns the number of frames written."""
    rows = kept(extract(spark, paths, frame_skip, height, width))
    folders.write_frames(rows, root)
    folders.write_intrinsics(spark, paths, root, height, width)
    return rows.count()


def video_manifest(frame_list: DataFrame, fps: int = 30) -> DataFrame:
    """(frame, place, seconds): the frames of one scene in natural order, for an encoder outside Spark."""
    from ..functions.names import natural_key

    if frame_list.isEmpty():
        raise ValueError("no frame folders")
    # the frames of one scene, thousands of names: one ordered window
    place = F.row_number().over(W.orderBy(natural_key(F.col("frame")), "frame")) - 1
    return frame_list.select("frame", place.alias("place")).withColumn("seconds", F.col("place") / F.lit(float(fps)))

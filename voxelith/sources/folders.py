"""Frame folders: ``<scene>/<frame>/`` with colour and depth images and a pose, and intrinsics beside them."""

from __future__ import annotations

import io
import json
import os
import shutil
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..config import Intrinsics
from ..functions.geometry import adjusted_intrinsics, first_valid_pose
from ..functions.images import png_array, png_bytes, resized_nearest, resized_smooth
from ..session import kept, mounted, shared_folder, ship, small_batches

#: Where a pose may stand, in order of preference (fixed values).
POSE_FILES = ("pose.npy", "pose.txt", "extrinsic_matrix.npy")
COLOR_FILE, DEPTH_FILE = "rgb_image.png", "depth_image.png"


def files(spark: SparkSession, root: str, *names: str) -> DataFrame:
    """(scene, frame, name, content) of the named files in all frame folders."""
    pattern = "{" + ",".join(names) + "}"
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    parts = F.split("path", "/")
    return rows.select(F.element_at(parts, -3).alias("scene"), F.element_at(parts, -2).alias("frame"), F.element_at(parts, -1).alias("name"), "content")


def matrix(name: str, body: bytes) -> list[float] | None:
    """A 4 x 4 matrix of an .npy or text file, or None."""
    try:
        x = np.load(io.BytesIO(body)) if name.endswith(".npy") else np.loadtxt(io.StringIO(body.decode())).reshape(4, 4)
    except (ValueError, OSError, EOFError, UnicodeDecodeError):
        return None
    return x.astype(float).ravel().tolist() if x.shape == (4, 4) else None


def poses(spark: SparkSession, root: str) -> DataFrame:
    """(scene, frame, pose): the first valid pose of each frame; frames without one are left out."""
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["scene", "frame", "name"]].copy()
            out["pose"] = [matrix(n, b) for n, b in zip(batch["name"], batch["content"], strict=True)]
            yield out

    found = files(spark, root, *POSE_FILES).mapInPandas(run, "scene string, frame string, name string, pose array<double>")
    picks = [F.first(F.when(F.col("name") == n, F.col("pose")), ignorenulls=True).alias(f"p{i}") for i, n in enumerate(POSE_FILES)]
    best = first_valid_pose(*[F.col(f"p{i}") for i in range(len(POSE_FILES))])
    return found.groupBy("scene", "frame").agg(*picks).select("scene", "frame", best.alias("pose")).where("pose IS NOT NULL")


def intrinsics(spark: SparkSession, root: str, default: Intrinsics = Intrinsics()) -> DataFrame:
    """(scene, fx, fy, cx, cy) from the scenes' intrinsics.json; join with ``with_intrinsics`` for the default."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "intrinsics.json").load(root)
    body = F.from_json(F.col("content").cast("string"), "fx double, fy double, cx double, cy double")
    rows = rows.select(F.element_at(F.split("path", "/"), -2).alias("scene"), body.alias("i"))
    return rows.select("scene", *[F.coalesce(F.col(f"i.{c}"), F.lit(getattr(default, c))).alias(c) for c in ("fx", "fy", "cx", "cy")])


def with_intrinsics(rows: DataFrame, known: DataFrame, default: Intrinsics = Intrinsics()) -> DataFrame:
    """Rows with their scene's fx, fy, cx, cy, one row a scene, or the default."""
    out = rows.join(known, "scene", "left")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(getattr(default, c))) for c in ("fx", "fy", "cx", "cy")})


def images(spark: SparkSession, root: str) -> DataFrame:
    """(scene, frame, color, depth): the PNG bytes of frames that have both."""
    both = files(spark, root, COLOR_FILE, DEPTH_FILE).groupBy("scene", "frame").agg(
        F.first(F.when(F.col("name") == COLOR_FILE, F.col("content")), ignorenulls=True).alias("color"),
        F.first(F.when(F.col("name") == DEPTH_FILE, F.col("content")), ignorenulls=True).alias("depth"),
    )
    return both.where("color IS NOT NULL AND depth IS NOT NULL")


def rgb_of(data: bytes, height: int, width: int, channels: int) -> np.ndarray:
    """The pixels of an image row; the JVM gives blue, green and red, or grey."""
    x = np.frombuffer(bytes(data), np.uint8).reshape(height, width, channels)
    return np.repeat(x, 3, axis=2) if channels == 1 else np.ascontiguousarray(x[:, :, 2::-1])


def decoded(spark: SparkSession, root: str, pattern: str, drop_broken: bool = True) -> DataFrame:
    """(path, height, width, channels, data) of images as the JVM's reader gives them."""
    rows = spark.read.format("image").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).option("dropInvalid", str(drop_broken).lower()).load(root)
    return rows.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))


def pictures(spark: SparkSession, root: str, pattern: str = "*.{png,jpg,jpeg}") -> DataFrame:
    """(path, height, width, rgb) of 8-bit images, JPEG too, decoded by the JVM; rgb is row by row.

    For masks and colour only: the JVM's reader keeps the low byte of 16-bit depth, which ``readable`` keeps whole.
    """
    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = batch[["path", "height", "width"]].copy()
            out["rgb"] = [rgb_of(*x).tobytes() for x in zip(batch["data"], batch["height"], batch["width"], batch["channels"], strict=True)]
            yield out

    return decoded(spark, root, pattern).mapInPandas(run, "path string, height int, width int, rgb binary")


def picture(spark: SparkSession, path: str) -> np.ndarray:
    """One image file as an RGB array."""
    row = pictures(spark, path, "*").first()
    if row is None:
        raise ValueError(f"no readable image: {path}")
    return np.frombuffer(bytes(row["rgb"]), np.uint8).reshape(row["height"], row["width"], 3)


def readable(body: bytes) -> np.ndarray | None:
    try:
        return png_array(bytes(body))
    except Exception:  # a broken image only loses its frame
        return None


def pixels(frames: DataFrame, stride: int = 1) -> DataFrame:
    """(scene, frame, v, u, depth_mm, r, g, b) on every ``stride``-th row and column; the depth is resized to the colour image.

    Frames with an unreadable image are left out.
    """
    ship(frames.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for scene, frame, color, depth in zip(batch["scene"], batch["frame"], batch["color"], batch["depth"], strict=True):
                c, d = readable(color), readable(depth)
                if c is None or d is None:
                    continue
                d = d if d.shape == c.shape[:2] else resized_nearest(d, *c.shape[:2])
                v, u = np.meshgrid(np.arange(0, c.shape[0], stride), np.arange(0, c.shape[1], stride), indexing="ij")
                v, u = v.ravel(), u.ravel()
                rgb = c[v, u, :3] / 255.0
                yield pd.DataFrame({"scene": scene, "frame": frame, "v": v, "u": u, "depth_mm": d[v, u].astype(np.int32), "r": rgb[:, 0], "g": rgb[:, 1], "b": rgb[:, 2]})

    return frames.select("scene", "frame", "color", "depth").mapInPandas(run, "scene string, frame string, v int, u int, depth_mm int, r double, g double, b double")


def resized_frames(rows: DataFrame, height: int = 480, width: int = 640, folder: str | None = None) -> DataFrame:
    """Sensor frames as (scene, export_idx, color, depth, pose): colour bilinear and smoothed, depth nearest, both as PNG.

    PNG colour is decoded in the worker. JPEG colour is decoded by the JVM, whose reader takes files: one
    pass over the streams writes the blobs below ``folder``, a mounted store that all executors see (by
    default the shared folder), while it stores the rest; the resized pictures then join it. A broken
    or unknown colour image raises.
    """
    from .sens import decoded_depth

    spark = rows.sparkSession
    ship(spark)
    blobs = f"{(folder or shared_folder(spark)).rstrip('/')}/colour"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            color, depth = [], []
            for r in batch.itertuples(index=False):
                if r.color_codec == "png":
                    color.append(png_bytes(resized_smooth(png_array(bytes(r.color)), height, width)))
                elif r.color_codec == "jpeg":
                    color.append(None)
                    os.makedirs(mounted(blobs), exist_ok=True)
                    put(mounted(blobs), f"{r.scene.encode().hex()}-{r.export_idx}.jpg", bytes(r.color))
                else:
                    raise ValueError(f"unsupported colour codec {r.color_codec!r}")
                depth.append(png_bytes(resized_nearest(decoded_depth(bytes(r.depth), r.depth_codec, r.depth_height, r.depth_width), height, width)))
            yield pd.DataFrame({"scene": batch["scene"], "export_idx": batch["export_idx"], "color": color, "depth": depth, "pose": batch["pose"]})

    def shrink(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for r in batch.itertuples(index=False):
                scene, _, index = r.path.rpartition("/")[2].removesuffix(".jpg").rpartition("-")
                scene = bytes.fromhex(scene).decode()
                if r.height <= 0:
                    raise ValueError(f"unreadable colour image of frame {index} of {scene!r}")
                picture = resized_smooth(rgb_of(r.data, r.height, r.width, r.channels), height, width)
                yield pd.DataFrame({"scene": [scene], "export_idx": [int(index)], "jpeg": [png_bytes(picture)]})

    small_batches(spark, 64)
    done = kept(rows.mapInPandas(run, "scene string, export_idx long, color binary, depth binary, pose array<double>"))
    if done.where("color IS NULL").isEmpty():
        return done
    pictures_of = kept(decoded(spark, blobs, "*.jpg", False).mapInPandas(shrink, "scene string, export_idx long, jpeg binary"))
    shutil.rmtree(mounted(blobs))
    out = done.join(pictures_of, ["scene", "export_idx"], "left")
    return out.select("scene", "export_idx", F.coalesce("color", "jpeg").alias("color"), "depth", "pose")


def put(where: str, name: str, body: bytes) -> None:
    """Writes a file beside its place and renames it, so a lost task leaves no half file."""
    part = f"{where}/.{name}.{os.getpid()}.tmp"
    with open(part, "wb") as f:
        f.write(body)
    os.replace(part, f"{where}/{name}")


def write_frames(rows: DataFrame, root: str) -> None:
    """Writes (scene, export_idx, color, depth, pose) as frame folders below ``root``, a store that all executors see."""
    ship(rows.sparkSession)

    def write(part: Iterator) -> None:
        for r in part:
            where = os.path.join(root, r["scene"], f"{r['export_idx']:06d}")
            os.makedirs(where, exist_ok=True)
            pose = io.BytesIO()
            np.save(pose, np.array(r["pose"], np.float32).reshape(4, 4))
            for name, body in ((COLOR_FILE, bytes(r["color"])), (DEPTH_FILE, bytes(r["depth"])), (POSE_FILES[0], pose.getvalue())):
                put(where, name, body)

    rows.select("scene", "export_idx", "color", "depth", "pose").foreachPartition(write)


def write_intrinsics(spark: SparkSession, paths: list[str], root: str, height: int, width: int) -> None:
    """Writes each scene's intrinsics.json: the depth camera in its stream's header, adjusted to the resized frames."""
    from .sens import cameras

    camera = cameras(spark, paths)
    new = adjusted_intrinsics(*[F.get("intrinsic_depth", F.lit(i)) for i in (0, 5, 2, 6)], (F.col("depth_width"), F.col("depth_height")), (F.lit(width), F.lit(height)))
    for r in camera.select("scene", *[x.alias(n) for n, x in zip(("fx", "fy", "cx", "cy"), new, strict=True)]).collect():
        os.makedirs(os.path.join(root, r["scene"]), exist_ok=True)
        body = {"fx": r["fx"], "fy": r["fy"], "cx": r["cx"], "cy": r["cy"], "width": width, "height": height}
        with open(os.path.join(root, r["scene"], "intrinsics.json"), "w") as f:
            json.dump(body, f)


def frame_folder(index: Column) -> Column:
    return F.lpad(index.cast("string"), 6, "0")

"""Object clouds as PCD files, and legacy text exports."""

from __future__ import annotations

import os
from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import ship


def pcd_bytes(points: np.ndarray, colors: np.ndarray) -> bytes:
    """An ASCII-headed binary PCD of x, y, z and packed rgb; colours are 0 to 1."""
    c = np.clip(np.rint(colors * 255), 0, 255).astype(np.uint32)
    rgb = (c[:, 0] << 16 | c[:, 1] << 8 | c[:, 2]).astype(np.uint32).view(np.float32)
    rows = np.column_stack([points.astype(np.float32), rgb]).astype("<f4")
    n = len(rows)
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z rgb\nSIZE 4 4 4 4\nTYPE F F F F\nCOUNT 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
    return head.encode() + rows.tobytes()


def pcd_arrays(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Points and colours of a PCD with the fields x, y, z and rgb, binary or ASCII."""
    head, at = {}, 0
    while "DATA" not in head:
        end = data.index(b"\n", at)
        word, _, rest = data[at:end].decode().partition(" ")
        head[word], at = rest, end + 1
    fields, n = head["FIELDS"].split(), int(head["POINTS"])
    if head["DATA"].strip() == "binary":
        rows = np.frombuffer(data, "<f4", n * len(fields), at).reshape(n, len(fields))
    elif head["DATA"].strip() == "ascii":
        rows = np.array(data[at:].split(), np.float64).reshape(n, len(fields)).astype("<f4")
    else:
        raise ValueError(f"unsupported PCD data: {head['DATA']}")
    points = rows[:, [fields.index(c) for c in "xyz"]].astype(np.float64)
    if "rgb" not in fields:
        return points, np.zeros((n, 3))
    rgb = np.ascontiguousarray(rows[:, fields.index("rgb")]).view(np.uint32)
    return points, np.stack([rgb >> 16 & 255, rgb >> 8 & 255, rgb & 255], axis=1) / 255.0


def read_pcd(spark: SparkSession, path: str) -> DataFrame:
    """(path, place, x, y, z, r, g, b) of all PCD files under a folder."""
    import pandas as pd

    ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, body in zip(batch["path"], batch["content"], strict=True):
                p, c = pcd_arrays(body)
                yield pd.DataFrame({"path": name, "place": np.arange(len(p)), "x": p[:, 0], "y": p[:, 1], "z": p[:, 2], "r": c[:, 0], "g": c[:, 1], "b": c[:, 2]})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.pcd").load(path)
    return files.select("path", "content").mapInPandas(run, "path string, place long, x double, y double, z double, r double, g double, b double")


def matrix_text(values: Sequence[float]) -> str:
    """A 4 x 4 matrix as four lines of six-decimal numbers."""
    return "".join(" ".join(f"{v:f}" for v in values[4 * i : 4 * i + 4]) + "\n" for i in range(4))


def ply_bytes(points: np.ndarray, colors: np.ndarray | None = None, normals: np.ndarray | None = None, faces: np.ndarray | None = None) -> bytes:
    """A binary little-endian PLY of points and, where given, normals, colours (0 to 1) and triangles of a mesh."""
    parts = [("<f4", "float", ("x", "y", "z"), points)]
    if normals is not None:
        parts.append(("<f4", "float", ("nx", "ny", "nz"), normals))
    if colors is not None:
        parts.append(("u1", "uchar", ("red", "green", "blue"), np.clip(np.rint(np.asarray(colors) * 255), 0, 255)))
    rows = np.zeros(len(points), np.dtype([(name, kind) for kind, _, names, _ in parts for name in names]))
    head = [f"element vertex {len(points)}"]
    for _, word, names, values in parts:
        for i, name in enumerate(names):
            rows[name] = np.asarray(values)[:, i] if len(points) else 0
            head.append(f"property {word} {name}")
    body = rows.tobytes()
    if faces is not None:
        triangles = np.zeros(len(faces), np.dtype([("n", "u1"), ("at", "<i4", (3,))]))
        triangles["n"], triangles["at"] = 3, np.asarray(faces).reshape(-1, 3)
        head += [f"element face {len(faces)}", "property list uchar int vertex_indices"]
        body += triangles.tobytes()
    return "\n".join(["ply", "format binary_little_endian 1.0", *head, "end_header", ""]).encode() + body


def export_ply(cloud: DataFrame, path: str, faces: np.ndarray | None = None) -> None:
    """One scene's cloud (point_id, x, y, z, r, g, b and maybe nx, ny, nz) as a PLY file on the driver's disk; a scene must fit the driver.

    ``faces`` are triangles of places in the order of point_id, from a surface solver outside Spark.
    """
    table = cloud.orderBy("point_id").toArrow()

    def stack(names: Sequence[str]) -> np.ndarray | None:
        return np.stack([table.column(c).to_numpy() for c in names], axis=1) if set(names) <= set(table.column_names) else None

    with open(path, "wb") as f:
        f.write(ply_bytes(stack("xyz"), stack("rgb"), stack(("nx", "ny", "nz")), faces))


def export_frames(frames: DataFrame, folder: str, frame_skip: int = 1, image_size: tuple[int, int] | None = None) -> None:
    """Writes pose text, colour blobs and depth PNGs of sensor frames below ``folder``, a store that all executors see.

    ``image_size`` (height, width) resizes depth and PNG colour to the nearest pixel; JPEG colour keeps its
    size, since blobs are not encoded again (``folders.resized_frames`` gives it resized, as PNG).
    """
    from ..functions.images import png_array, png_bytes, resized_nearest
    from .folders import put
    from .sens import decoded_depth

    ship(frames.sparkSession)

    def write(rows: Iterator) -> None:
        for r in rows:
            depth = decoded_depth(bytes(r["depth"]), r["depth_codec"], r["depth_height"], r["depth_width"])
            color, ext = bytes(r["color"]), "png" if r["color_codec"] == "png" else "jpg"
            if image_size is not None:
                depth = resized_nearest(depth, *image_size)
                color = png_bytes(resized_nearest(png_array(color), *image_size)) if ext == "png" else color
            for kind, end, body in (("pose", "txt", matrix_text(r["pose"]).encode()), ("color", ext, color), ("depth", "png", png_bytes(depth))):
                where = os.path.join(folder, r["scene"], kind)
                os.makedirs(where, exist_ok=True)
                put(where, f"{r['frame_idx']}.{end}", body)

    frames.where(F.col("frame_idx") % frame_skip == 0).foreachPartition(write)


def export_intrinsics(spark: SparkSession, paths: Sequence[str], folder: str) -> None:
    """Writes the two cameras' intrinsic and extrinsic matrices of each sensor stream as text below ``folder``/<scene>/intrinsic."""
    from .folders import put
    from .sens import MATRICES, cameras

    for r in cameras(spark, list(paths)).collect():
        where = os.path.join(folder, r["scene"], "intrinsic")
        os.makedirs(where, exist_ok=True)
        for name in MATRICES:
            put(where, f"{name}.txt", matrix_text(r[name]).encode())

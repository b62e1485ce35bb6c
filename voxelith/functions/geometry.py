"""Camera and voxel arithmetic as columns."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def unprojected(u: Column, v: Column, z: Column, fx, fy, cx, cy) -> tuple[Column, Column, Column]:
    """The camera point of a pixel at depth z, by the pinhole model."""
    return (u - cx) / fx * z, (v - cy) / fy * z, z


def moved(pose: list[list[Column]], point: tuple[Column, Column, Column]) -> tuple[Column, ...]:
    """A point under the first three rows of a 4 x 4 pose."""
    x, y, z = point
    return tuple(r[0] * x + r[1] * y + r[2] * z + r[3] for r in pose[:3])


def pose_rows(pose: Column) -> list[list[Column]]:
    """A row-major array of 16 as rows of columns."""
    return [[F.get(pose, F.lit(4 * i + j)) for j in range(4)] for i in range(4)]


def determinant(r: list[list[Column]]) -> Column:
    """Of the upper left 3 x 3."""
    return r[0][0] * (r[1][1] * r[2][2] - r[1][2] * r[2][1]) - r[0][1] * (r[1][0] * r[2][2] - r[1][2] * r[2][0]) + r[0][2] * (r[1][0] * r[2][1] - r[1][1] * r[2][0])


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))


def valid_pose(pose: Column, tolerance: float = 0.1) -> Column:
    """16 finite numbers whose rotation part has a determinant near 1."""
    whole = F.size(pose) == 16
    good = F.forall(pose, finite)
    return F.coalesce(whole & good & (F.abs(determinant(pose_rows(pose)) - 1) <= tolerance), F.lit(False))


def first_valid_pose(*candidates: Column) -> Column:
    """The first candidate that is a valid pose, or null."""
    return F.coalesce(*[F.when(valid_pose(c), c) for c in candidates])


def voxel_index(x: Column, size: float) -> Column:
    """floor(x / size) with the division in float32, so cell edges fall as in single precision."""
    quotient = x.cast("double") / F.lit(size).cast("float").cast("double")
    return F.floor(quotient.cast("float")).cast("long")


def gaussian_weight(d: Column, sigma: float) -> Column:
    return F.exp(-(d * d) / F.lit(2 * sigma * sigma))


def intrinsic_matrix(fx: Column, fy: Column, mx: Column, my: Column) -> Column:
    """The 4 x 4 camera matrix of focal lengths and principal point, row-major."""
    cells = [F.lit(float(i % 5 == 0)) for i in range(16)]
    cells[0], cells[5], cells[2], cells[6] = (c.cast("double") for c in (fx, fy, mx, my))
    return F.array(*cells)


def adjusted_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, old: tuple[Column, Column], new: tuple[Column, Column]) -> tuple[Column, ...]:
    """Intrinsics for an image resized from ``old`` to ``new`` (width, height), cropped in width."""
    (w0, h0), (w1, h1) = old, new
    same = (w0 == w1) & (h0 == h1)
    width = F.floor(h1 * w0.cast("double") / h0)
    scaled = (fx * (width / w0), fy * (h1 / h0), cx * ((w1 - 1) / (w0 - 1)), cy * ((h1 - 1) / (h0 - 1)))
    return tuple(F.when(same, a).otherwise(b) for a, b in zip((fx, fy, cx, cy), scaled, strict=True))


def nearest_source(target: Column, old: Column, new: Column) -> Column:
    """The source row or column that nearest-neighbour resizing reads."""
    return F.least(F.floor(target * (old.cast("double") / new)), old - 1).cast("int")

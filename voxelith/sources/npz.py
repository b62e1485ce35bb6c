"""The ``npz`` data source: point clouds as zipped arrays (points, colors, optionally embeddings and labels)."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .. import session

LABELS = ("cluster_labels", "cluster_label")


def names_of(path: str) -> list[str]:
    with zipfile.ZipFile(path) as z:
        return [n.removesuffix(".npy") for n in z.namelist()]


def shape_of(f) -> tuple[tuple[int, ...], bool, np.dtype]:
    """Shape, whether stored by column, and type of an array whose file is at its start; the file is left at the first value."""
    read = {(1, 0): np.lib.format.read_array_header_1_0, (2, 0): np.lib.format.read_array_header_2_0}
    return read[np.lib.format.read_magic(f)](f)


def rows_of(z: zipfile.ZipFile, name: str, lo: int, hi: int) -> np.ndarray:
    """Rows lo to hi of an array of a zip; only those are held, and read if the zip is not compressed. An array stored by column is read whole."""
    with z.open(f"{name}.npy") as f:
        shape, by_column, kind = shape_of(f)
        if by_column and len(shape) > 1:
            return np.frombuffer(f.read(), kind).reshape(shape, order="F")[lo:hi]
        width = int(np.prod(shape[1:], dtype=np.int64))
        f.seek(lo * width * kind.itemsize, 1)
        return np.frombuffer(f.read((hi - lo) * width * kind.itemsize), kind).reshape(-1, *shape[1:])


@dataclass
class Slice(InputPartition):
    lo: int
    hi: int


class NpzReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.per_task = max(1, int(options.get("pointsPerTask", "1000000")))
        self.names = names_of(self.path)
        if "points" not in self.names:
            raise ValueError(f"{self.path} has no array 'points', only {self.names}")

    def partitions(self) -> list[InputPartition]:
        with zipfile.ZipFile(self.path) as z, z.open("points.npy") as f:
            n = shape_of(f)[0][0]
        return [Slice(lo, min(lo + self.per_task, n)) for lo in range(0, n, self.per_task)] or [Slice(0, 0)]

    def read(self, partition: Slice) -> Iterator[tuple]:
        own = partition.lo, partition.hi
        with zipfile.ZipFile(self.path) as z:
            points = rows_of(z, "points", *own).astype(np.float64)
            colors = rows_of(z, "colors", *own).astype(np.float64) if "colors" in self.names else np.full_like(points, np.nan)
            vectors = rows_of(z, "embeddings", *own) if "embeddings" in self.names else None
            label = next((n for n in LABELS if n in self.names), None)
            labels = rows_of(z, label, *own).reshape(-1) if label else None
        for i in range(len(points)):
            color = [float(c) if c == c else None for c in colors[i]]
            yield (partition.lo + i, *map(float, points[i]), *color, None if vectors is None else vectors[i].astype(float).tolist(), None if labels is None else int(labels[i]))


class NpzDataSource(DataSource):
    """``spark.read.format("npz").load(path)``; point_id is the place in the arrays."""

    @classmethod
    def name(cls) -> str:
        return "npz"

    def schema(self) -> str:
        return "point_id bigint, x double, y double, z double, r double, g double, b double, embedding array<float>, cluster_label int"

    def reader(self, schema) -> NpzReader:
        return NpzReader(self.options)


def register(spark: SparkSession) -> None:
    session.ship(spark)
    spark.dataSource.register(NpzDataSource)


def export_npz(cloud: DataFrame, path: str) -> None:
    """One scene's cloud as a zip of float32 arrays on the driver's disk, for viewers; a scene must fit the driver."""
    table = cloud.orderBy("point_id").toArrow()
    arrays = {"points": ("x", "y", "z"), "colors": ("r", "g", "b")}
    out = {k: np.stack([table.column(c).to_numpy() for c in cs], axis=1).astype(np.float32) for k, cs in arrays.items()}
    if "embedding" in table.column_names and table.column("embedding").null_count == 0 and len(table):
        out["embeddings"] = np.stack([np.asarray(v, np.float32) for v in table.column("embedding").to_pylist()])
    np.savez(path, **out)

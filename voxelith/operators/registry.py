"""The scene registry: a small table (scene, npz_file, store_path, collection)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "scene string, npz_file string, store_path string, collection string"


def upserted(old: DataFrame, new: DataFrame, key: str = "scene") -> DataFrame:
    """The rows of ``new``, and those of ``old`` whose key it doesn't have."""
    return old.join(new.select(key), key, "left_anti").select(*old.columns).unionByName(new)


def members(rows: DataFrame, known: DataFrame, on: str, inside: bool = True) -> DataFrame:
    """Rows whose key is (or isn't) among the known ones."""
    return rows.join(known.select(on), on, "left_semi" if inside else "left_anti")


class Registry:
    """Scenes in a JSON-lines file on the driver's side, in order of registration; a missing file is an empty registry."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        where = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        if not where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where):
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).json(self.path)

    def register(self, rows: Sequence[tuple]) -> None:
        """Adds or replaces scenes; the registry is one small file and passes the driver."""
        scenes = {r["scene"]: tuple(r) for r in self.read().collect()} | {r[0]: tuple(r) for r in rows}
        self.spark.createDataFrame(list(scenes.values()), SCHEMA).coalesce(1).write.mode("overwrite").json(self.path)

    def lookup(self, scene: str):
        row = self.read().where(F.col("scene") == scene).first()
        if row is None:
            raise ValueError(f"no scene {scene!r}")
        return row

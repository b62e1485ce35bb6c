"""Session helpers."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
import weakref

from pyspark.sql import DataFrame, SparkSession

_shipped: weakref.WeakSet = weakref.WeakSet()
_roots: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers of all executors, once a Spark application."""
    context = spark.sparkContext
    if context not in _shipped:
        here = os.path.dirname(os.path.abspath(__file__))
        if os.path.isdir(here):
            archive = shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="voxelith-"), "voxelith_package"), "zip", os.path.dirname(here), os.path.basename(here))
            context.addPyFile(archive)
        _shipped.add(context)


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Ships the package and sends rows to Python in batches of at most ``rows``, so a worker's memory stays small."""
    ship(spark)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(name)) > rows or int(spark.conf.get(name)) <= 0:
        spark.conf.set(name, str(rows))


def shared_folder(spark: SparkSession) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which the driver and all executors share.

    Only where the session names none and runs on one machine a temporary folder is taken.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or _roots.get(context.applicationId)
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = _roots[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="voxelith-")
    return f"{root.rstrip('/')}/steps/{uuid.uuid4().hex}"


def kept(df: DataFrame) -> DataFrame:
    """``df`` written as Parquet to a shared folder and read again: computed once, and safe from lost executors.

    The folder is deleted when the application ends, on any store.
    """
    spark, path = df.sparkSession, shared_folder(df.sparkSession)
    df.write.parquet(path)
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    return spark.read.schema(df.schema).parquet(path)


def mounted(path: str) -> str:
    """A folder as a path for Python's file functions; it must be on a store that driver and executors mount."""
    plain = path.removeprefix("file://") if path.startswith("file:///") else path.removeprefix("file:")
    if "://" in plain:
        raise ValueError(f"{path} is not on a mounted store")
    return plain

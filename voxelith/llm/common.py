"""Shared folders, materialised tables and distributed ranks for the corpus operators."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..session import small_batches  # noqa: F401

_own: dict[str, str] = {}

#: Words of a text: maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Only where the session names none and runs on one machine (tests) a temporary folder is made.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if not root:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if context.applicationId not in _own:
            _own[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="voxelith-")
        root = _own[context.applicationId]
    return root.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name under the shared folder; folders on this machine are deleted when Python ends."""
    path = f"{shared_root(spark)}/voxelith/{name}-{uuid.uuid4().hex}"
    if path.startswith(("/", "file:")):
        atexit.register(shutil.rmtree, path.removeprefix("file:").replace("//", "/"), ignore_errors=True)
    return path


def stored(df: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """``df`` written as Parquet and read again: cuts the lineage, survives lost executors."""
    df.write.mode(mode).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, *paths: str) -> None:
    """Deletes folders of the shared store through Hadoop's file system layer."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def release(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop shuffle files of finished steps, which it does on a collection of the driver's heap."""
    gc.collect()
    spark._jvm.System.gc()


def fresh(taken: Iterable[str], *names: str) -> list[str]:
    """Column names that differ from all in ``taken``, whatever their case."""
    known, out = {c.lower() for c in taken}, []
    for name in names:
        while f"__{name}" in known:
            name += "_"
        out.append(f"__{name}")
    return out


def unit(h: Column) -> Column:
    """A 64-bit hash as a double in (0, 1)."""
    return (F.shiftrightunsigned(h, 11).cast("double") + 0.5) * F.lit(2.0**-53)


def cell(h: Column, n: int) -> Column:
    """The n equal ranges of a hash's signed order, 0 to n - 1."""
    return F.least(F.floor((h.cast("double") / F.lit(2.0**64) + 0.5) * n), F.lit(n - 1)).cast("long")


def ranked(df: DataFrame, group: list[str], part: str, order: list[Column], name: str, amount: Column | None = None) -> DataFrame:
    """Adds ``name``: the sum of ``amount`` (1 a row by default) over the earlier rows of the group.

    ``part`` numbers ranges of the order, so no task sorts a whole group: a group is summed by
    range, the few sums are accumulated, and each range is ranked by itself.
    """
    amount = F.lit(1).cast("long") if amount is None else amount
    sums = df.groupBy(*group, part).agg(F.sum(amount).alias("__sum"))
    before = W.partitionBy(*group).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    # one struct as the key of the window and the join, so the rows are shuffled once; its fields may be null
    key, own, earlier = fresh(df.columns, "key", "own", "before")
    both = F.struct(*group, part).alias(key)
    sums = sums.select(both, F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias(earlier))
    within = W.partitionBy(key).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumn(key, F.struct(*group, part)).withColumn(own, F.coalesce(F.sum(amount).over(within), F.lit(0)))
    return rows.join(sums, key).withColumn(name, (F.col(own) + F.col(earlier)).cast("long")).drop(key, own, earlier)

"""Download plans: what files a release has, as tables. Fetching is not done here."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Shards of the record files by split (fixed values).
SHARDS = {"train": 100, "val": 25, "test": 10}
FOLDERS = ("hires_tfrecords", "lores_tfrecords")


def scan_plan(scans: DataFrame, types: DataFrame, base: str, release: str, old_release: str, use_old_sens: bool = False, existing: DataFrame | None = None) -> DataFrame:
    """(scan_id, file_type, url, out_file) of every file of every scan; sensor files may come from the old release.

    ``scans`` (scan_id) times ``types`` (file_type), a short fixed list; files in ``existing`` (out_file) are skipped.
    """
    folder = F.when((F.col("file_type") == ".sens") & F.lit(use_old_sens), F.lit(old_release)).otherwise(F.lit(release))
    name = F.concat("scan_id", "file_type")
    out = scans.select("scan_id").crossJoin(F.broadcast(types.select("file_type")))
    out = out.select("scan_id", "file_type", F.concat_ws("/", F.lit(base), folder, F.col("scan_id"), name).alias("url"), F.concat_ws("/", F.col("scan_id"), name).alias("out_file"))
    return out if existing is None else out.join(existing.select("out_file"), "out_file", "left_anti").select(*out.columns)


def release_plan(scans: DataFrame, test_scans: DataFrame, types: DataFrame, test_types: DataFrame, base: str, release: str, old_release: str, existing: DataFrame | None = None) -> DataFrame:
    """The files of a whole release: (scan_id, file_type, url, out_file), test scans with their own types, release folder and output folder.

    Sensor files of the training scans come from the old release. A scan in both lists is a training scan.
    """
    train = scan_plan(scans, types, base, release, old_release, use_old_sens=True)
    test = scan_plan(test_scans.join(scans, "scan_id", "left_anti"), test_types, base, release, old_release)
    out = train.withColumn("out_file", F.concat(F.lit("scans/"), "out_file")).unionByName(test.withColumn("out_file", F.concat(F.lit("scans_test/"), "out_file")))
    return out if existing is None else out.join(existing.select("out_file"), "out_file", "left_anti").select(*out.columns)


def one_scan(plan: DataFrame, scan_id: str) -> DataFrame:
    """The files of one scan of a release plan; an unknown id raises."""
    out = plan.where(F.col("scan_id") == scan_id)
    if out.isEmpty():
        raise ValueError(f"unknown scan: {scan_id!r}")
    return out


def checked_type(types: Sequence[str], wanted: str | None) -> list[str]:
    """The one file type that is wanted, or all; an unknown one raises."""
    if wanted is not None and wanted not in types:
        raise ValueError(f"unknown file type: {wanted!r}")
    return list(types) if wanted is None else [wanted]


def task_plan(spark: SparkSession, base: str, release: str, names: Sequence[str], folder: str = "tasks") -> DataFrame:
    """(file_name, url, out_file) of a release's task files: task data, the label map, frame archives and the like, by name."""
    rows = spark.createDataFrame([(n,) for n in names], "file_name string")
    return rows.select("file_name", F.concat_ws("/", F.lit(base), F.lit(release), "file_name").alias("url"), F.concat_ws("/", F.lit(folder), "file_name").alias("out_file"))


def shard_plan(spark: SparkSession, shards: Mapping[str, int] = SHARDS, folders: Sequence[str] = FOLDERS, base: str | None = None) -> DataFrame:
    """(folder, split, shard, file_name) of all record files, with (url, out_file) where their ``base`` address is given."""
    rows = spark.createDataFrame([(f, s, n) for f in folders for s, n in shards.items()], "folder string, split string, n int")
    rows = rows.select("folder", "split", "n", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("shard"))
    rows = rows.select("folder", "split", "shard", F.format_string("%s-%05d-of-%05d.tfrecords", "split", "shard", "n").alias("file_name"))
    if base is None:
        return rows
    place = F.concat_ws("/", "folder", "file_name")
    return rows.withColumns({"url": F.concat(F.lit(f"{base}/"), place), "out_file": place})


def without_types(types: Sequence[str], gone: Sequence[str]) -> list[str]:
    return [t for t in types if t not in set(gone)]


def scans_of(spark: SparkSession, path: str) -> DataFrame:
    """(scan_id) of a release list, one a line."""
    return spark.read.text(path).select(F.col("value").alias("scan_id")).where("scan_id <> ''")

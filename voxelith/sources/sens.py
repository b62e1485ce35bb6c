"""The ``sens`` data source: RGB-D sensor streams, version 4, as one row per frame.

The driver reads headers only. Frames vary in length, so a partition, a range of frames, steps over the
size fields of the frames before it (a few bytes a frame, the blobs are skipped).
Paths are read with Python's file functions: files must be on a mounted store that all executors see.
"""

from __future__ import annotations

import glob
import json
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import pandas_udf

from .. import session

VERSION = 4
#: Codec numbers of the header (fixed values).
COLOR_CODECS = {-1: "unknown", 0: "raw", 1: "png", 2: "jpeg"}
DEPTH_CODECS = {-1: "unknown", 0: "raw_ushort", 1: "zlib_ushort", 2: "occi_ushort"}
FRAME_HEAD = struct.Struct("<16f4Q")
FIELDS = struct.Struct("<64f2i4IfQ")
SCHEMA = (
    "scene string, path string, frame_idx bigint, num_frames bigint, pose array<double>, timestamp_color decimal(20,0), timestamp_depth decimal(20,0), "
    "color binary, depth binary, color_codec string, depth_codec string, color_width int, color_height int, depth_width int, depth_height int, "
    "depth_shift float, intrinsic_color array<double>, intrinsic_depth array<double>"
)


#: Matrices of the header, in the order of their export files, and image sizes.
MATRICES = ("intrinsic_color", "extrinsic_color", "intrinsic_depth", "extrinsic_depth")
CAMERA = (*MATRICES, "color_width", "color_height", "depth_width", "depth_height")


@dataclass
class Header:
    sensor: str
    intrinsic_color: list[float]
    extrinsic_color: list[float]
    intrinsic_depth: list[float]
    extrinsic_depth: list[float]
    color_codec: str
    depth_codec: str
    color_width: int
    color_height: int
    depth_width: int
    depth_height: int
    depth_shift: float
    num_frames: int
    size: int = 0


def read_header(f) -> Header:
    (version,) = struct.unpack("<I", f.read(4))
    if version != VERSION:
        raise ValueError(f"unsupported version {version}, not {VERSION}")
    (n,) = struct.unpack("<Q", f.read(8))
    sensor = f.read(n).decode("utf-8", "replace")
    x = FIELDS.unpack(f.read(FIELDS.size))
    mats = [list(x[16 * i : 16 * i + 16]) for i in range(4)]
    return Header(sensor, *mats, COLOR_CODECS.get(x[64], "unknown"), DEPTH_CODECS.get(x[65], "unknown"), *x[66:70], x[70], x[71], f.tell())


def write_sens(path: str, header: Header, frames: list[dict]) -> None:
    """A stream file; frames have pose (16 numbers), timestamp_color, timestamp_depth, color and depth (bytes)."""
    name = header.sensor.encode()
    numbers = {v: k for k, v in COLOR_CODECS.items()}, {v: k for k, v in DEPTH_CODECS.items()}
    with open(path, "wb") as f:
        f.write(struct.pack("<IQ", VERSION, len(name)) + name)
        mats = [*header.intrinsic_color, *header.extrinsic_color, *header.intrinsic_depth, *header.extrinsic_depth]
        f.write(FIELDS.pack(*mats, numbers[0][header.color_codec], numbers[1][header.depth_codec], header.color_width, header.color_height, header.depth_width, header.depth_height, header.depth_shift, len(frames)))
        for x in frames:
            f.write(FRAME_HEAD.pack(*x["pose"], x["timestamp_color"], x["timestamp_depth"], len(x["color"]), len(x["depth"])) + x["color"] + x["depth"])


def decoded_depth(blob: bytes, codec: str, height: int, width: int) -> np.ndarray:
    """The depth image in its units (millimetres as a rule)."""
    if codec != "zlib_ushort":
        raise ValueError(f"unsupported depth codec {codec!r}")
    return np.frombuffer(zlib.decompress(blob), "<u2").reshape(height, width)


def depth_column(codec: str = "zlib_ushort"):
    """A pandas UDF (depth, height, width) to the pixels as an array, row by row."""
    @pandas_udf("array<int>")
    def decode(depth: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        return pd.Series([decoded_depth(d, codec, h, w).ravel().astype(np.int32) for d, h, w in zip(depth, height, width, strict=True)])

    return decode


@dataclass
class FrameRange(InputPartition):
    path: str
    header: str
    first: int
    stop: int


class SensReader(DataSourceReader):
    def __init__(self, options: dict):
        self.skip = max(1, int(options.get("frameSkip", "1")))
        self.per_task = max(1, int(options.get("framesPerTask", "128")))
        if options.get("paths"):
            self.paths = json.loads(options["paths"])
        else:
            where = options.get("path", "")
            self.paths = sorted(glob.glob(os.path.join(where, "**", "*.sens"), recursive=True)) if os.path.isdir(where) else [where]
        missing = [p for p in self.paths if not os.path.isfile(p)]
        if missing or not self.paths:
            raise FileNotFoundError(f"no stream file: {missing or options.get('path')}")

    def partitions(self) -> list[InputPartition]:
        out = []
        for path in self.paths:
            with open(path, "rb") as f:
                header = read_header(f)
            step = self.per_task * self.skip
            out += [FrameRange(path, json.dumps(asdict(header)), lo, min(lo + step, header.num_frames)) for lo in range(0, header.num_frames, step)]
        return out

    def read(self, partition: FrameRange) -> Iterator[tuple]:
        h = Header(**json.loads(partition.header))
        scene = scene_of(partition.path)
        with open(partition.path, "rb") as f:
            f.seek(h.size)
            for i in range(partition.stop):
                x = FRAME_HEAD.unpack(f.read(FRAME_HEAD.size))
                if i < partition.first or i % self.skip:
                    f.seek(x[18] + x[19], os.SEEK_CUR)
                    continue
                color, depth = f.read(x[18]), f.read(x[19])
                yield (scene, partition.path, i, h.num_frames, [float(v) for v in x[:16]], Decimal(x[16]), Decimal(x[17]), color, depth, h.color_codec, h.depth_codec, h.color_width, h.color_height, h.depth_width, h.depth_height, float(h.depth_shift), h.intrinsic_color, h.intrinsic_depth)


def scene_of(path: str) -> str:
    return os.path.basename(path).rpartition(".")[0]


def cameras(spark, paths: list[str]):
    """(scene, the four matrices, image sizes): one row a stream, from the headers alone, read by the executors."""
    session.ship(spark)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path in batch["path"]:
                with open(path, "rb") as f:
                    h = asdict(read_header(f))
                yield pd.DataFrame([{"scene": scene_of(path)} | {c: h[c] for c in CAMERA}])

    schema = ", ".join(["scene string", *[f"{c} {'int' if c.startswith(('color', 'depth')) else 'array<double>'}" for c in CAMERA]])
    return spark.createDataFrame([(p,) for p in paths], "path string").mapInPandas(run, schema)


class SensDataSource(DataSource):
    """``spark.read.format("sens").option("frameSkip", k).load(path)``; path is a file or a folder, or set paths to a JSON list."""

    @classmethod
    def name(cls) -> str:
        return "sens"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> SensReader:
        return SensReader(self.options)


def register(spark) -> None:
    session.ship(spark)
    spark.dataSource.register(SensDataSource)

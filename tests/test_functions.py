import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.functions import colors, geometry, images, names, vectors


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_safe_name(spark):
    got = [one(spark, names.safe_name(F.lit(x)))[0] for x in ("###", "--x--", "Living Room_points", "", "a.b-c_1", "é")]
    assert got == ["collection", "x", "Living_Room_points", "collection", "a.b-c_1", "collection"]


def test_natural_order(spark):
    rows = spark.createDataFrame([(x,) for x in ("frame_1", "frame_10", "frame_2", "000010", "9", "")], "n string")
    got = [r.n for r in rows.orderBy(names.natural_key(F.col("n"))).collect()]
    assert got == ["", "9", "000010", "frame_1", "frame_2", "frame_10"]


def test_parsed_id_never_evaluates(spark):
    assert one(spark, names.parsed_id(F.lit("12")), names.parsed_id(F.lit("1+1")))[:] == (12, None)


def test_has_text(spark):
    assert one(spark, *[names.has_text(F.lit(x)) for x in ("a", "  ", None)])[:] == (True, False, False)


def test_voxel_index_divides_in_single_precision(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([np.arange(-50, 50) * np.float32(0.01), rng.uniform(-2, 2, 2000).astype(np.float32)]).astype(np.float32)
    want = np.floor(x / np.float32(0.01)).astype(np.int64)
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    got = [r[0] for r in df.select(geometry.voxel_index(F.col("x").cast("float"), 0.01)).collect()]
    assert got == want.tolist()


def pose(rotation, move=(0, 0, 0)):
    m = np.eye(4)
    m[:3, :3], m[:3, 3] = rotation, move
    return m


def test_pose_rules(spark):
    good = np.eye(4)
    scaled = lambda d: np.diag([d, 1, 1])
    cases = [(good, True), (pose(scaled(0.85)), False), (pose(scaled(1.05)), True), (np.full((4, 4), np.nan), False), (np.full((4, 4), -np.inf), False)]
    for m, want in cases:
        assert one(spark, geometry.valid_pose(F.array(*[F.lit(float(v)) for v in m.ravel()])))[0] is want
    assert one(spark, geometry.valid_pose(F.array(*[F.lit(1.0)] * 12)))[0] is False
    assert one(spark, geometry.valid_pose(F.lit(None).cast("array<double>")))[0] is False


def test_unprojection_by_hand(spark):
    turn = [[0, -1, 0], [1, 0, 0], [0, 0, 1]]
    rows = [[F.lit(float(v)) for v in r] for r in pose(turn, (1, 2, 3))]
    point = geometry.unprojected(F.lit(7), F.lit(0), F.lit(2.0), 4.0, 4.0, 3.5, 3.5)
    assert one(spark, *geometry.moved(rows, point))[:] == pytest.approx((1 + 1.75, 2 + 1.75, 5.0))


def test_vectors(spark):
    e = F.array(F.lit(3.0), F.lit(4.0))
    assert one(spark, vectors.norm(e), vectors.norm(e, 2), vectors.dot(e, [1.0, 2.0]))[:] == pytest.approx((5, 5, 11))
    assert one(spark, vectors.normalized(F.array(F.lit(0.0), F.lit(0.0))))[0] == [0.0, 0.0]


def test_quantized_rounds_half_to_even(spark):
    got = one(spark, *[colors.quantized(F.lit(x), F.lit(0.0), F.lit(1.0), 3, 0.0) for x in (0.25, 0.75, 1.5)])[:]
    assert got == (0.0, 1.0, 1.0)


def test_ramp_ends(spark):
    assert [round(v * 255) for v in one(spark, *colors.ramp(F.lit(0.0)), *colors.ramp(F.lit(1.0)))] == [0x0D, 0x08, 0x87, 0xF0, 0xF9, 0x21]


@pytest.mark.parametrize("shape,kind", [((5, 7), np.uint16), ((5, 7), np.uint8), ((6, 4, 3), np.uint8)])
def test_png_round_trip(shape, kind):
    x = np.random.default_rng(1).integers(0, np.iinfo(kind).max, shape).astype(kind)
    assert (images.png_array(images.png_bytes(x)) == x).all()
    assert images.png_array(images.png_bytes(x)).dtype == kind


def test_png_depth_is_whole():
    x = np.array([[1000, 2000], [3000, 65535]], np.uint16)
    assert images.png_array(images.png_bytes(x)).tolist() == x.tolist()


def test_png_filters():
    import struct
    import zlib

    x = np.random.default_rng(2).integers(0, 256, (5, 6)).astype(np.uint8)
    lines, up = [], np.zeros(6, int)
    for rule, row in zip(range(5), x.astype(int), strict=True):
        left, corner = np.append(0, row[:-1]), np.append(0, up[:-1])
        if rule == 4:
            guess = []
            for a, b, c in zip(left, up, corner, strict=True):
                p = a + b - c
                guess.append(min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2])
            guess = np.array(guess)
        else:
            guess = [np.zeros(6, int), left, up, (left + up) // 2][rule]
        lines.append(bytes([rule]) + ((row - guess) & 255).astype(np.uint8).tobytes())
        up = row
    body = images.png_bytes(x)
    raw = zlib.compress(b"".join(lines))
    at = body.index(b"IDAT")
    head = body[: at - 4]
    data = head + struct.pack(">I", len(raw)) + b"IDAT" + raw + struct.pack(">I", zlib.crc32(b"IDAT" + raw)) + body[-12:]
    assert (images.png_array(data) == x).all()


def test_crops():
    image = np.arange(20 * 30 * 3, dtype=np.uint8).reshape(20, 30, 3)
    mask = np.zeros((20, 30), np.uint8)
    assert images.patch_crop(mask, image).shape == image.shape
    mask[5:10, 25:30] = 255
    assert images.patch_crop(mask, image).shape == (7, 6, 3)
    shown = images.masked_crop(mask, image, "bin")
    assert (shown[6, 26] == image[6, 26]).all() and shown[0, 0].sum() == 0
    grown = images.dilated(mask, 3, 1)
    assert grown.sum() > (mask > 0).sum() and grown[4, 27] == 1
    with pytest.raises(ValueError):
        images.masked_crop(mask, image, "none")


def test_resizing():
    x = np.arange(16, dtype=np.uint8).reshape(4, 4)
    assert images.resized_nearest(x, 2, 2).tolist() == [[0, 2], [8, 10]]
    assert (images.resized_bilinear(x, 4, 4) == x).all()
    assert images.encoder_input(np.zeros((300, 400, 3), np.uint8)).shape == (3, 224, 224)
    assert math.isclose(images.encoder_input(np.zeros((300, 400, 3), np.uint8))[0, 0, 0], -0.48145466 / 0.26862954)


def test_smooth_resize_by_hand():
    flat = np.full((6, 9, 3), 200, np.uint8)
    assert (images.resized_smooth(flat, 4, 5) == 200).all()
    # halving: a Gaussian of half a pixel, then the mean of two neighbours, cut to a whole number
    x = np.array([[0, 0, 100, 100]], np.uint8)
    near = np.exp(-2.0 * np.arange(3) ** 2)
    w = near / (near[0] + 2 * near[1:].sum())
    line = [0.0, 0.0, 100.0, 100.0]
    mirrored = [line[abs(i) if i < 4 else 6 - i] for i in range(-2, 6)]
    smooth = [sum(w[abs(j)] * mirrored[i + 2 + j] for j in (-2, -1, 0, 1, 2)) for i in range(4)]
    want = [int((smooth[0] + smooth[1]) / 2), int((smooth[2] + smooth[3]) / 2)]
    assert images.resized_smooth(x, 1, 2)[0].tolist() == want
    # growing needs no smoothing; half a step beyond the edge is mirrored
    assert images.resized_smooth(np.array([[0.0, 8.0]]), 1, 4)[0].tolist() == [2.0, 2.0, 6.0, 6.0]


def test_mask_runs_round_trip():
    rng = np.random.default_rng(2)
    for mask in (rng.random((7, 5)) < 0.5, np.zeros((2, 3), bool), np.ones((2, 3), bool)):
        assert (images.mask_of(images.mask_runs(mask), *mask.shape) == mask).all()

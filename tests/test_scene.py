import json
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.config import Intrinsics, SceneConfig
from voxelith.functions.images import mask_of, png_bytes
from voxelith.models import GridSegmenter, HashEmbedder, query_vector
from voxelith.plans import scene
from voxelith.sources import clouds, folders, npz, sens
from voxelith.streaming import frames as streams

TURN = np.array([[0, -1, 0, 0], [1, 0, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1.0]])
SMALL = Intrinsics(4.0, 4.0, 3.5, 3.5)


@pytest.fixture
def root(tmp_path):
    where = tmp_path / "data" / "room"
    rng = np.random.default_rng(0)
    for i, m in enumerate((np.eye(4), TURN, np.full((4, 4), np.nan))):
        d = where / f"{i:06d}"
        d.mkdir(parents=True)
        (d / "rgb_image.png").write_bytes(png_bytes(rng.integers(0, 256, (8, 8, 3)).astype(np.uint8)))
        (d / "depth_image.png").write_bytes(png_bytes(np.full((8, 8), 2000, np.uint16)))
        np.save(d / "pose.npy", m.astype(np.float32))
        if i == 2:
            np.savetxt(d / "pose.txt", np.ones((3, 4)))
    (where / "intrinsics.json").write_text(json.dumps({"fx": 4, "fy": 4, "cx": 3.5, "cy": 3.5}))
    return str(tmp_path / "data")


def test_frames_without_a_valid_pose_go(spark, root):
    got = scene.posed_frames(spark, root).select("frame", "fx").orderBy("frame").collect()
    assert [tuple(r) for r in got] == [("000000", 4.0), ("000001", 4.0)]


def test_default_intrinsics(spark):
    rows = spark.createDataFrame([("x",)], "scene string")
    none = spark.createDataFrame([], "scene string, fx double, fy double, cx double, cy double")
    assert folders.with_intrinsics(rows, none).first()["fx"] == 577.870605


def test_dense_cloud_by_hand(spark, root):
    cfg = SceneConfig(grid_stride=1, dense_downsample=1)
    got = {tuple(round(v, 6) for v in r[1:4]) for r in scene.dense_cloud(spark, root, cfg).collect()}
    want = set()
    for m in (np.eye(4), TURN):
        for v in range(8):
            for u in range(8):
                p = m @ [(u - 3.5) / 4 * 2, (v - 3.5) / 4 * 2, 2, 1]
                want.add(tuple(round(float(x), 6) for x in p[:3]))
    assert got == want


def test_build_and_search(spark, root, tmp_path):
    cfg = SceneConfig(frame_stride=1, point_stride=1, grid_stride=1, dense_downsample=2, object_downsample=1, min_points=5, outlier_k=5, interpolation_k=3, sigma=0.5, outlier_ratio=3.0)
    out, embedder = str(tmp_path / "out"), HashEmbedder(16)
    vectors = scene.build_scene(spark, root, out, "room #1", GridSegmenter(), embedder, cfg)
    assert vectors.count() > 0
    with pytest.raises(ValueError):
        scene.build_scene(spark, root, out, "room #1", GridSegmenter(), embedder, cfg)
    hits = scene.search_scene(spark, out, "room #1", embedder, text="chair", k=5)
    assert hits.count() == 5 and all(0 <= r.score <= 1 for r in hits.collect())
    assert scene.colored_scene(spark, out, "room #1", hits, cfg).count() >= vectors.count()
    with pytest.raises(ValueError):
        query_vector(embedder, text="  ")


def test_build_takes_one_scene_and_segments_once(spark, root, tmp_path):
    import os
    import shutil

    shutil.copytree(f"{root}/room", f"{root}/hall")
    seen = tmp_path / "seen"
    seen.mkdir()

    class Counting(GridSegmenter):
        def masks(self, image):
            (seen / os.urandom(8).hex()).touch()
            return super().masks(image)

    cfg = SceneConfig(frame_stride=1, point_stride=1, grid_stride=1, dense_downsample=2, object_downsample=1, min_points=5, outlier_k=5, interpolation_k=3, sigma=0.5, outlier_ratio=3.0)
    out = str(tmp_path / "out")
    scene.build_scene(spark, root, out, "hall", Counting(), HashEmbedder(16), cfg)
    assert len(list(seen.iterdir())) == 2
    points = spark.read.parquet(f"{out}/scenes/hall/object_points")
    assert [r.scene for r in points.select("scene").distinct().collect()] == ["hall"]
    assert spark.read.parquet(f"{out}/scenes/hall/dense").count() == 64
    with pytest.raises(ValueError, match="2 scenes"):
        scene.build_scene(spark, root, out, "attic", GridSegmenter(), HashEmbedder(16), cfg)


def stream(path, n=3, frames_size=(4, 6)):
    eye = [float(x) for x in np.eye(4).ravel()]
    header = sens.Header("cam", eye, eye, eye, eye, "png", "zlib_ushort", 6, 4, 6, 4, 1000.0, n)
    rng = np.random.default_rng(1)
    rows = [{"pose": [float(i)] * 16, "timestamp_color": 2**63 + i, "timestamp_depth": i, "color": png_bytes(rng.integers(0, 255, (4, 6, 3)).astype(np.uint8)), "depth": zlib.compress(rng.integers(0, 9000, frames_size).astype("<u2").tobytes(), i)} for i in range(n)]
    sens.write_sens(path, header, rows)
    return rows


def test_sens_round_trip(spark, tmp_path):
    path = str(tmp_path / "a.sens")
    want = stream(path, 7)
    sens.register(spark)
    got = spark.read.format("sens").option("framesPerTask", "2").load(path).orderBy("frame_idx").collect()
    assert [bytes(r.color) for r in got] == [x["color"] for x in want]
    assert int(got[1].timestamp_color) == 2**63 + 1 and got[2].pose == [2.0] * 16
    depth = sens.decoded_depth(bytes(got[3].depth), got[3].depth_codec, 4, 6)
    assert depth.tobytes() == zlib.decompress(want[3]["depth"])
    pixels = spark.read.format("sens").load(path).select(sens.depth_column()("depth", "depth_height", "depth_width").alias("p"))
    assert len(pixels.first().p) == 24
    with pytest.raises(ValueError):
        sens.decoded_depth(b"", "raw_ushort", 1, 1)


def test_sens_version_is_checked(spark, tmp_path):
    path = tmp_path / "b.sens"
    stream(str(path))
    path.write_bytes(b"\x05" + path.read_bytes()[1:])
    sens.register(spark)
    with pytest.raises(Exception, match="unsupported version 5"):
        spark.read.format("sens").load(str(path)).count()


def test_extract_renumbers_and_resizes(spark, tmp_path):
    path = str(tmp_path / "c.sens")
    stream(path, 5)
    got = scene.extract(spark, [path], 2, 8, 12).orderBy("export_idx").collect()
    assert [r.export_idx for r in got] == [0, 1, 2]
    assert folders.readable(got[0].color).shape == (8, 12, 3) and folders.readable(got[0].depth).dtype == np.uint16
    with pytest.raises(Exception, match="no stream file"):
        scene.extract(spark, [path, str(tmp_path / "none.sens")]).count()
    rows = spark.read.format("sens").load(path)
    clouds.export_frames(rows, str(tmp_path / "x"), 2)
    assert sorted(p.name for p in (tmp_path / "x" / "c" / "pose").iterdir()) == ["0.txt", "2.txt", "4.txt"]


def test_ingest_writes_frame_folders(spark, tmp_path):
    path = str(tmp_path / "d.sens")
    stream(path, 3)
    assert scene.ingest(spark, [path], str(tmp_path / "frames"), 2, 8, 12) == 2
    rows = folders.images(spark, str(tmp_path / "frames"))
    assert sorted((r.scene, r.frame) for r in rows.collect()) == [("d", "000000"), ("d", "000001")]
    assert json.loads((tmp_path / "frames" / "d" / "intrinsics.json").read_text()) == {"fx": 2.0, "fy": 2.0, "cx": 0.0, "cy": 0.0, "width": 12, "height": 8}


def jpeg(spark, color):
    """A JPEG of one colour, by the JVM."""
    jvm = spark._jvm
    image = jvm.java.awt.image.BufferedImage(12, 8, jvm.java.awt.image.BufferedImage.TYPE_INT_RGB)
    red, green, blue = color
    for y in range(8):
        for x in range(12):
            image.setRGB(x, y, red << 16 | green << 8 | blue)
    out = jvm.java.io.ByteArrayOutputStream()
    jvm.javax.imageio.ImageIO.write(image, "jpg", out)
    return bytes(out.toByteArray())


def jpeg_stream(spark, path, colors, broken=False):
    camera = [4.0, 0, 2.5, 0, 0, 4.0, 1.5, 0, 0, 0, 1, 0, 0, 0, 0, 1]
    header = sens.Header("cam", camera, list(np.eye(4).ravel()), camera, list(np.eye(4).ravel()), "jpeg", "zlib_ushort", 12, 8, 6, 4, 1000.0, len(colors))
    pose = [float(x) for x in np.eye(4).ravel()]
    depth = zlib.compress(np.full((4, 6), 2000, "<u2").tobytes())
    sens.write_sens(path, header, [{"pose": pose, "timestamp_color": i, "timestamp_depth": i, "color": b"no image" if broken else jpeg(spark, c), "depth": depth} for i, c in enumerate(colors)])


def test_jpeg_streams_are_ingested_and_built(spark, tmp_path):
    colors = [(200, 30, 60), (10, 220, 90), (128, 128, 128)]
    jpeg_stream(spark, str(tmp_path / "my room.sens"), colors)
    root, out = str(tmp_path / "frames"), str(tmp_path / "out")
    assert scene.ingest(spark, [str(tmp_path / "my room.sens")], root, 2, 4, 6) == 2
    for r in folders.images(spark, root).collect():
        got = folders.readable(r.color)
        assert r.scene.replace("%20", " ") == "my room" and got.shape == (4, 6, 3)
        assert np.abs(got.astype(int) - colors[2 * int(r.frame)]).max() <= 4
    jpeg_stream(spark, str(tmp_path / "broken.sens"), colors, broken=True)
    with pytest.raises(Exception, match="unreadable colour image of frame 0 of 'broken'"):
        scene.extract(spark, [str(tmp_path / "broken.sens")], 3).count()
    jpeg_stream(spark, str(tmp_path / "hall.sens"), colors)
    main = __import__("voxelith.__main__", fromlist=["main"]).main
    small = ["frame_stride=1", "point_stride=1", "grid_stride=1", "dense_downsample=1", "min_points=2", "outlier_k=4", "interpolation_k=3", "sigma=0.5", "outlier_ratio=3.0", "merge_mode=weighted"]
    main(["ingest", "--sens", str(tmp_path / "hall.sens"), "--root", root, "--height", "4", "--width", "6", "--build", "hall", "--out", out, "--set", *small])
    assert spark.read.parquet(f"{out}/scenes/hall/dense").count() == 3 * 24
    (tmp_path / "q.jpg").write_bytes(jpeg(spark, (200, 30, 60)))
    main(["search", "--out", out, "--scene", "hall", "--image", str(tmp_path / "q.jpg"), "--k", "3"])
    main(["stage", "interpolate", "--root", root, "--out", out, "--scene", "hall", "--set", *small])
    with pytest.raises(ValueError, match="unknown parameter"):
        main(["stage", "merge", "--root", root, "--out", out, "--scene", "hall", "--set", "nothing=1"])


def test_small_masks_go_before_the_embedder(spark, root, tmp_path):
    class Uneven(GridSegmenter):
        def masks(self, image):
            one = np.zeros(image.shape[:2], bool)
            one[0, :3] = True
            return [one, *super().masks(image)]

    class Seen(HashEmbedder):
        def images(self, crops):
            assert len(crops) == 4
            return super().images(crops)

    cfg = SceneConfig(frame_stride=1, point_stride=1, min_points=5)
    masks, points = scene.segment(spark, root, cfg, Uneven(), Seen(16), str(tmp_path / "out"))
    rows = masks.orderBy("frame", "mask_id").collect()
    assert [r.mask_id for r in rows] == [1, 2, 3, 4] * 2
    want = GridSegmenter().masks(np.zeros((8, 8, 3)))
    for r in rows:
        assert (mask_of(r.runs, r.height, r.width) == want[r.mask_id - 1]).all()
    assert points.count() == 2 * 64


def test_ply_and_camera_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1.0, 2.0, 3.0, 1.0, 0.0, 0.5), (0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)], "point_id long, x double, y double, z double, r double, g double, b double")
    clouds.export_ply(rows, str(tmp_path / "a.ply"), np.array([[0, 1, 0]]))
    head, body = (tmp_path / "a.ply").read_bytes().split(b"end_header\n")
    assert b"element vertex 2" in head and b"element face 1" in head and len(body) == 2 * 15 + 13
    assert np.frombuffer(body[15:27], "<f4").tolist() == [1, 2, 3] and list(body[27:30]) == [255, 0, 128]
    assert body[30] == 3 and np.frombuffer(body[31:], "<i4").tolist() == [0, 1, 0]
    stream(str(tmp_path / "e.sens"), 2)
    clouds.export_intrinsics(spark, [str(tmp_path / "e.sens")], str(tmp_path / "x"))
    assert sorted(p.name for p in (tmp_path / "x" / "e" / "intrinsic").iterdir()) == ["extrinsic_color.txt", "extrinsic_depth.txt", "intrinsic_color.txt", "intrinsic_depth.txt"]
    assert (tmp_path / "x" / "e" / "intrinsic" / "intrinsic_depth.txt").read_text().splitlines()[1] == "0.000000 1.000000 0.000000 0.000000"
    sens.register(spark)
    clouds.export_frames(spark.read.format("sens").load(str(tmp_path / "e.sens")), str(tmp_path / "y"), image_size=(2, 3))
    assert folders.readable((tmp_path / "y" / "e" / "depth" / "1.png").read_bytes()).shape == (2, 3)
    assert folders.readable((tmp_path / "y" / "e" / "color" / "1.png").read_bytes()).shape == (2, 3, 3)


def test_pictures_are_rgb(spark, tmp_path):
    x = np.random.default_rng(4).integers(0, 256, (3, 5, 3)).astype(np.uint8)
    (tmp_path / "a.png").write_bytes(png_bytes(x))
    (tmp_path / "b.png").write_bytes(png_bytes(x[:, :, 0].copy()))
    got = {r.path[-5:]: np.frombuffer(bytes(r.rgb), np.uint8).reshape(r.height, r.width, 3) for r in folders.pictures(spark, str(tmp_path)).collect()}
    assert (got["a.png"] == x).all() and (got["b.png"] == x[:, :, :1]).all()


def test_npz(spark, tmp_path):
    path = str(tmp_path / "a.npz")
    p = np.random.default_rng(0).random((5, 3)).astype(np.float32)
    np.savez(path, points=p, colors=p, embeddings=np.ones((5, 4), np.float32), cluster_label=np.arange(5))
    npz.register(spark)
    df = spark.read.format("npz").option("pointsPerTask", "2").load(path)
    got = df.orderBy("point_id").collect()
    assert [r.cluster_label for r in got] == [0, 1, 2, 3, 4] and got[2].x == float(p[2, 0]) and got[0].embedding == [1.0] * 4
    npz.export_npz(df, str(tmp_path / "b.npz"))
    assert np.array_equal(np.load(tmp_path / "b.npz")["points"], p)
    np.savez_compressed(tmp_path / "d.npz", points=np.asfortranarray(p), embeddings=np.ones((5, 4)))
    got = spark.read.format("npz").option("pointsPerTask", "2").load(str(tmp_path / "d.npz")).orderBy("point_id").collect()
    assert [r.y for r in got] == [float(v) for v in p[:, 1]] and got[4].embedding == [1.0] * 4 and got[0].r is None
    np.savez(tmp_path / "c.npz", colors=p)
    with pytest.raises(Exception, match="no array 'points'"):
        spark.read.format("npz").load(str(tmp_path / "c.npz")).count()


def test_pcd(spark, tmp_path):
    p, c = np.random.default_rng(0).random((4, 3)), np.array([[0, 0.2, 1]] * 4)
    (tmp_path / "object_0.pcd").write_bytes(clouds.pcd_bytes(p, c))
    got = clouds.read_pcd(spark, str(tmp_path)).orderBy("place").collect()
    assert [r.x for r in got] == pytest.approx(p[:, 0].tolist(), abs=1e-6) and got[0].g == pytest.approx(0.2)
    text = b"FIELDS x y z\nPOINTS 1\nDATA ascii\n1 2 3\n"
    assert clouds.pcd_arrays(text)[0].tolist() == [[1, 2, 3]]


def test_stream_matches_batch(spark, tmp_path):
    rows = [(0, u, v, 2000, [float(x) for x in np.eye(4).ravel()], 4.0, 4.0, 3.5, 3.5, 0.1, 0.2, 0.3) for u in range(8) for v in range(8)]
    schema = "frame int, u int, v int, depth_mm int, pose array<double>, fx double, fy double, cx double, cy double, r double, g double, b double"
    batch = spark.createDataFrame(rows, schema)
    batch.write.parquet(str(tmp_path / "in"))
    cfg = SceneConfig()
    live = streams.voxel_means(streams.point_stream(streams.pixel_stream(spark, str(tmp_path / "in"), schema), cfg), 0.5)
    query = live.writeStream.outputMode("complete").format("memory").queryName("live_voxels").start()
    query.processAllAvailable()
    query.stop()
    want = streams.voxel_means(scene.world_points(batch, cfg, False), 0.5)
    order = ["vx", "vy", "vz", "n"]
    assert spark.table("live_voxels").select(*order).orderBy(*order).collect() == want.select(*order).orderBy(*order).collect()


def test_video_manifest(spark):
    rows = spark.createDataFrame([("frame_10",), ("frame_2",)], "frame string")
    assert [r.frame for r in scene.video_manifest(rows).orderBy("place").collect()] == ["frame_2", "frame_10"]
    with pytest.raises(ValueError):
        scene.video_manifest(rows.where(F.lit(False)))

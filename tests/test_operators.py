import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelith.operators import coloring, frames, knn, manifest, registry, search, voxels
from voxelith.plans import queries

from .oracle import rows


def cloud(spark, n, seed=0, dim=0):
    rng = np.random.default_rng(seed)
    p = rng.uniform(-1, 1, (n, 3))
    rows = [(i, *map(float, p[i]), 0.1, 0.2, 0.3, int(i % 5), [float(x) for x in rng.standard_normal(dim)]) for i in range(n)]
    return p, spark.createDataFrame(rows, "point_id long, x double, y double, z double, r double, g double, b double, ford int, embedding array<double>")


def brute(q, b, k):
    d = np.sqrt(((q[:, None] - b[None]) ** 2).sum(axis=2))
    return [(i, int(j), round(float(d[i, j]), 9)) for i in range(len(q)) for j in np.lexsort([np.arange(len(b)), d[i]])[:k]]


@pytest.mark.parametrize("limit, few, queries, points", [(0, 0, 60, 90), (0, 0, 90, 60), (0, 10, 60, 90), (0, 100, 60, 90), (10_000, 0, 60, 90)])
def test_knn_is_exact(spark, limit, few, queries, points):
    q, queries = cloud(spark, queries, 1)
    b, base = cloud(spark, points, 2)
    got = knn.knn(queries.withColumnRenamed("point_id", "qid"), base.withColumnRenamed("point_id", "nid"), 7, broadcast_points=limit, few_queries=few)
    assert sorted((r.qid, r.nid, round(r.dist, 9)) for r in got.collect()) == sorted(brute(q, b, 7))


@pytest.mark.parametrize("few", [0, 5])
def test_knn_of_uneven_points(spark, few):
    rng = np.random.default_rng(9)
    b = np.concatenate([rng.normal(0, 0.01, (200, 3)), rng.uniform(-50, 50, (30, 3)), np.zeros((40, 3))])
    q = np.concatenate([b[::9], [[500.0, 0, 0], [0, 0, 0]]])
    base = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(b)], "nid long, x double, y double, z double")
    queries = spark.createDataFrame([(i, *map(float, p)) for i, p in enumerate(q)], "qid long, x double, y double, z double")
    got = knn.knn(queries, base, 5, broadcast_points=0, few_queries=few)
    assert sorted((r.qid, r.nid, round(r.dist, 9)) for r in got.collect()) == sorted(brute(q, b, 5))


def test_knn_of_one_place(spark):
    rows = spark.createDataFrame([(i, 1.0, 1.0, 1.0) for i in range(9)], "nid long, x double, y double, z double")
    got = knn.knn(rows.withColumnRenamed("nid", "qid"), rows, 2, broadcast_points=0, few_queries=0)
    assert sorted((r.qid, r.nid) for r in got.collect()) == [(q, n) for q in range(9) for n in (0, 1)]


@pytest.mark.parametrize("k", [1, 50, 199, 200, 500])
def test_many_hits_by_a_band(spark, k):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.integers(-2, 3, 3)]) for i in range(200)] + [(200, None), (201, [0.5, 0.0, 0.0])]
    df = search.indexable(spark.createDataFrame(rows, "point_id long, embedding array<double>"))
    want = search.top_k(df, [1.0, 0.5, 0.0], k, length="norm").collect()
    got = search.top_k(df, [1.0, 0.5, 0.0], k, length="norm", task_rows=0).collect()
    assert sorted(got) == sorted(want)


@pytest.mark.parametrize("per", [1, 7, 1000])
def test_numbers_along_a_column(spark, per):
    p, df = cloud(spark, 60, 6)
    got = frames.numbered_along(df.drop("ford"), ["x", "y"], "place", per).orderBy("place").collect()
    assert [r.place for r in got] == list(range(60)) and [r.point_id for r in got] == np.argsort(p[:, 0]).tolist()
    assert frames.numbered_along(df.limit(0), ["x"], "place", per).count() == 0


@pytest.mark.parametrize("limit", [0, 100])
def test_knn_ties_and_few_points(spark, limit):
    q = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, float("nan"), 0.0, 0.0), (2, None, 0.0, 0.0)], "qid long, x double, y double, z double")
    b = spark.createDataFrame([(3, 1.0, 0.0, 0.0), (2, -1.0, 0.0, 0.0), (1, 0.0, 1.0, 0.0)], "nid long, x double, y double, z double")
    assert [(r.qid, r.nid) for r in knn.knn(q, b, 2, broadcast_points=limit).orderBy("nid").collect()] == [(0, 1), (0, 2)]
    assert knn.knn(q, b, 9, broadcast_points=limit).count() == 3
    assert knn.knn(q, b.limit(0), 3, broadcast_points=100).count() == 0


def test_far_points_get_short_vectors(spark):
    dense = spark.createDataFrame([(0, 0.0, 0.0, 0.0), (1, 5.0, 0.0, 0.0)], "point_id long, x double, y double, z double")
    sparse = spark.createDataFrame([(0, 0.0, 0.0, 0.0, [3.0, 4.0])], "point_id long, x double, y double, z double, embedding array<double>")
    out = knn.interpolated(dense, sparse, 21, 0.01, 2)
    got = {r.point_id: r.embedding for r in out.collect()}
    assert got[0] == pytest.approx([0.6, 0.8], abs=1e-6) and np.linalg.norm(got[1]) <= 1e-3
    assert search.indexable(out).count() == 1


def numpy_voxels(p, size):
    keys = np.floor(p[:, :3].astype(np.float64) / np.float64(np.float32(size))).astype(np.float32).astype(int)
    return np.array([p[(keys == k).all(axis=1)].mean(axis=0) for k in np.unique(keys, axis=0)])


def test_voxel_average_again_keeps_positions(spark):
    _, df = cloud(spark, 300, 3)
    once = voxels.voxel_average(df, 0.5)
    twice = voxels.voxel_average(once, 0.5)
    a, b = (sorted(tuple(round(v, 9) for v in r) for r in x.select("x", "y", "z").collect()) for x in (once, twice))
    assert a == b


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_pairwise_merge(spark, n):
    p, df = cloud(spark, 40 * n, 4)
    df = df.withColumn("ford", (F.col("point_id") % n).cast("int"))
    left = [p[np.arange(len(p)) % n == i] for i in range(n)]
    while len(left) > 1:
        left = [numpy_voxels(np.concatenate(left[i : i + 2]), 0.5) if i + 1 < len(left) else left[i] for i in range(0, len(left), 2)]
    got = voxels.merge_pairwise(df, 0.5, means=("x", "y", "z"))
    assert sorted(tuple(round(v, 6) for v in r) for r in got.collect()) == sorted(tuple(round(float(v), 6) for v in r) for r in left[0])


def test_merge_makes_unit_vectors(spark):
    _, df = cloud(spark, 50, 5, dim=4)
    for out in (voxels.merge_weighted(df, 0.5, vector="embedding", dim=4), voxels.merge_pairwise(df, 0.5, vector="embedding", dim=4)):
        assert all(np.linalg.norm(r.embedding) == pytest.approx(1, abs=1e-6) for r in out.collect())


def test_search_edges(spark):
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0]), (2, [2.0, 0.0])], "point_id long, embedding array<double>")
    kept = search.indexable(rows)
    hits = search.top_k(kept, [1.0, 0.0], 10, length="norm")
    assert [r.point_id for r in hits.collect()] == [0, 2]
    assert [r.score for r in search.calibrated(hits).collect()] == [0.75, 0.75]
    assert [search.default_k(n) for n in (10, 2000, 100_000)] == [10, 1000, 20_000]


def test_collections_are_replaced(spark, tmp_path):
    store = search.Collections(spark, str(tmp_path))
    rows = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 0.0])], "point_id long, embedding array<double>")
    assert not store.exists("a")
    with pytest.raises(ValueError):
        store.open("a")
    assert store.replace("a", rows).select("id", "document").first()[:] == ("0", "point_0")
    assert store.replace("a", rows.withColumn("point_id", F.col("point_id") + 5)).first()["point_id"] == 5


def test_overlay_edges(spark):
    points = spark.createDataFrame([(0, 255.0, 0.0, 51.0), (1, 0.0, 0.0, 0.0)], "point_id long, r double, g double, b double")
    scaled = coloring.autoscaled(points)
    assert scaled.orderBy("point_id").first()[1:] == (1.0, 0.0, 0.2)
    none = spark.createDataFrame([], "point_id long, score double")
    assert coloring.overlay(scaled, none).orderBy("point_id").first()[1:] == (1.0, 0.0, 0.2)
    single = spark.createDataFrame([(1, 0.4)], "point_id long, score double")
    assert coloring.quantized_scores(single).first()["level"] == 0.0


def test_global_stride_numbers_all_rows(spark):
    rows = spark.createDataFrame([(f, v) for f in (2, 0, 5) for v in range(7)], "frame int, v int")
    got = frames.every_kth_of_all(rows, 4, ["frame"], ["v"]).orderBy("point_id").collect()
    everything = sorted((f, v) for f in (2, 0, 5) for v in range(7))
    assert [(r.point_id, r.frame, r.v) for r in got] == [(i, *everything[4 * i]) for i in range(6)]


def test_rows_of_one_vector_follow_each_other(spark, tmp_path):
    n, folder = 4000, str(tmp_path)
    line = spark.range(25 * n).selectExpr("id AS l_orderkey", "3 AS l_linenumber", "1L AS l_suppkey", f"IF(id < {n}, id % 64 * 10, 1) AS l_partkey", "10.0D AS l_extendedprice", "1.0D AS l_quantity")
    line.union(line.where("l_orderkey < 10")).repartition(1).write.parquet(f"{folder}/lineitem.parquet")
    # the first n are on the grid, the others make points the larger table; masks 2 and 3 of each frame: no point is of mask 2, and one vector of mask 3 is null
    spark.range(16, 48).selectExpr("id AS vec_id", "IF(id = 40, NULL, transform(sequence(1, 64), k -> CAST(sin(id * k) AS FLOAT))) AS embedding").write.parquet(f"{folder}/embeddings.parquet")
    spread = queries.QUERIES["embed_broadcast"](spark, folder)
    con = duckdb.connect()
    for t in ("lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    assert rows(spread.toPandas()) == rows(con.execute(queries.ORACLE_SQL["embed_broadcast"]).df())
    ids = spread.where("i = 0").toPandas().vec_id.to_numpy()
    assert len(ids) == 4010 - 251  # frame 8 has no vector
    assert (ids[1:] != ids[:-1]).sum() < 16 * 16


def test_vectors_spread_to_all_points(spark, tmp_path):
    folder = str(tmp_path)
    # of u = 0 to 19 and v = 3 to 33 two points stand on every tenth row and column
    spark.range(80).selectExpr("id AS l_orderkey", "3 AS l_linenumber", "id DIV 20 + 1 AS l_suppkey", "id % 20 AS l_partkey", "10.0D AS l_extendedprice", "1.0D AS l_quantity").write.parquet(f"{folder}/lineitem.parquet")
    spark.range(32, 48).selectExpr("id AS vec_id", "transform(sequence(1, 64), k -> CAST(sin(id * k) AS FLOAT)) AS embedding").write.parquet(f"{folder}/embeddings.parquet")
    spread = queries.QUERIES["embed_broadcast"](spark, folder)
    con = duckdb.connect()
    for t in ("lineitem", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    assert rows(spread.toPandas()) == rows(con.execute(queries.ORACLE_SQL["embed_broadcast"]).df())
    assert spread.count() == 80 * 64
    assert {(r.u, r.l_orderkey) for r in spread.collect()} == {(k % 20, k) for k in range(80)}


def test_a_vector_meets_few_points_at_once(spark, tmp_path):
    folder = str(tmp_path)
    # one mask, of whose points 4000 are equal
    spark.range(6000).selectExpr("IF(id < 4000, 0, id * 16) AS l_orderkey", "3 AS l_linenumber", "1L AS l_suppkey", "7L AS l_partkey", "10.0D AS l_extendedprice", "1.0D AS l_quantity").write.parquet(f"{folder}/lineitem.parquet")
    spark.createDataFrame([(32, [0.5, 1.5]), (144, [2.5]), (33, [3.5])], "vec_id long, embedding array<float>").write.parquet(f"{folder}/embeddings.parquet")
    out = queries.QUERIES["embed_broadcast"](spark, folder).toPandas()
    want = [(v, i, e, k) for k in [0] * 4000 + [16 * n for n in range(4000, 6000)] for v, i, e in ((32, 0, 0.5), (32, 1, 1.5), (144, 0, 2.5))]
    assert sorted(out[["vec_id", "i", "e", "l_orderkey"]].itertuples(index=False, name=None)) == sorted(want)
    ids = out[out.i == 0].vec_id.to_numpy()
    ends = np.flatnonzero(np.diff(ids, prepend=-1, append=-1))
    assert np.diff(ends).max() < 2700  # two blocks of about 1000 can follow each other


def test_registry(spark, tmp_path):
    reg = registry.Registry(spark, str(tmp_path / "registry"))
    assert reg.read().count() == 0
    reg.register([("b", "1", "s", "c"), ("a", "2", "s", "c")])
    reg.register([("b", "3", "s", "c")])
    assert [(r.scene, r.npz_file) for r in reg.read().collect()] == [("b", "3"), ("a", "2")]
    with pytest.raises(ValueError):
        reg.lookup("z")


def test_palette_noise_is_grey():
    assert coloring.palette([-1, 0, 1])[-1] == (0.5, 0.5, 0.5)


def test_manifest(spark):
    assert manifest.shard_plan(spark).count() == 270
    assert manifest.without_types(["a", "b"], ["a"]) == ["b"]

"""Registered queries over the stand-in views, and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import colors, geometry, names, vectors
from ..functions.images import CHANNEL_MEAN, CHANNEL_STD
from ..operators import coloring, frames, knn, manifest, registry, search, voxels
from . import views
from .views import CX, CY, FX, FY, PIXEL_ORDER, V_PIXELS, V_POINTS, V_POSES

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
DIM = 64
ORDER_SQL = ", ".join(PIXEL_ORDER)


def query(sql: str | None = None):
    """Registers a query under its function's name, with its SQL if there is one."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c).cast("double"), digits) + 0.0 for c in columns})


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


# -- search ----------------------------------------------------------------------------------

HITS = """q AS (SELECT CAST(embedding AS DOUBLE[]) AS qv FROM embeddings WHERE vec_id = 0),
sims AS (SELECT vec_id AS point_id, list_dot_product(CAST(embedding AS DOUBLE[]), qv) /
  (sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_dot_product(qv, qv))) AS sim FROM embeddings, q),
hits AS (SELECT * FROM sims ORDER BY round(sim, 10) DESC, point_id LIMIT 50),
stats AS (SELECT avg(sim) AS mu, stddev_pop(sim) AS sd FROM hits),
scored AS (SELECT point_id, sim, least(greatest(0.75 + 0.1 * (sim - mu) / (sd + 1e-8), 0), 1) AS score FROM hits, stats)"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.top_k(views.points(spark, sf_dir), query_vector(spark, sf_dir), 50)


@query(f"WITH {HITS} SELECT point_id, round(sim, 6) AS sim FROM hits")
def cosine_topk(spark, sf_dir):
    return rounded(hits(spark, sf_dir), 6, "sim")


@query(f"WITH {HITS} SELECT point_id, round(sim, 6) AS sim, round(score, 6) AS score FROM scored")
def search_calibrated(spark, sf_dir):
    return rounded(search.calibrated(hits(spark, sf_dir)), 6, "sim", "score")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(least(greatest(1000, count(*) // 5), count(*)) AS BIGINT) AS k FROM embeddings")
def search_default_k(spark, sf_dir):
    n = table(spark, sf_dir, "embeddings").count()
    return spark.createDataFrame([(n, search.default_k(n))], "n long, k long")


SCALED = "scaled AS (SELECT vec_id AS point_id, [CAST(x AS DOUBLE) * CASE WHEN vec_id % 10 = 0 THEN 0.0005 ELSE 1.0 END FOR x IN embedding] AS e FROM embeddings)"


def scaled(spark: SparkSession, sf_dir: str) -> DataFrame:
    factor = F.when(F.col("vec_id") % 10 == 0, 0.0005).otherwise(1.0)
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("point_id"), F.transform("embedding", lambda x: x.cast("double") * factor).alias("embedding"))


@query(f"WITH {SCALED} SELECT point_id, round(sqrt(list_dot_product(e, e)), 6) AS norm FROM scaled WHERE sqrt(list_dot_product(e, e)) > 0.001")
def nonzero_vectors(spark, sf_dir):
    return rounded(search.indexable(scaled(spark, sf_dir)).select("point_id", "norm"), 6, "norm")


@query(f"WITH {SCALED} SELECT CAST(count(*) AS BIGINT) AS n_vectors, CAST(count(*) FILTER (WHERE sqrt(list_dot_product(e, e)) > 0.001) AS BIGINT) AS n_kept, CAST(count(*) FILTER (WHERE NOT sqrt(list_dot_product(e, e)) > 0.001) AS BIGINT) AS n_zero FROM scaled")
def zero_norm_report(spark, sf_dir):
    return search.norm_report(scaled(spark, sf_dir))


@query("""WITH t AS (SELECT vec_id, [CAST(x AS DOUBLE) * 3 FOR x IN embedding] AS e FROM embeddings),
n AS (SELECT vec_id, e, sqrt(list_dot_product(e, e)) + 1e-8 AS n FROM t)
SELECT vec_id, CAST(i AS INT) AS i, round(x / n, 6) + 0.0 AS e FROM (SELECT vec_id, n, unnest(e) AS x, generate_subscripts(e, 1) - 1 AS i FROM n)""")
def l2_normalize(spark, sf_dir):
    e = vectors.normalized(F.transform("embedding", lambda x: x.cast("double") * 3))
    out = table(spark, sf_dir, "embeddings").select("vec_id", e.alias("e"))
    return rounded(out.select("vec_id", F.posexplode("e").alias("i", "e")), 6, "e")


# -- names -----------------------------------------------------------------------------------


@query(r"""WITH n AS (SELECT c_custkey, CASE c_custkey % 5 WHEN 0 THEN '###' WHEN 1 THEN '--' || c_name || '--' WHEN 2 THEN c_name || ' points' WHEN 3 THEN '' ELSE c_name END AS name FROM customer)
SELECT c_custkey, coalesce(nullif(regexp_replace(regexp_replace(regexp_replace(name, '[^a-zA-Z0-9._-]', '_', 'g'), '^[^a-zA-Z0-9]+', ''), '[^a-zA-Z0-9]+$', ''), ''), 'collection') AS name FROM n""")
def sanitize_name(spark, sf_dir):
    raw = F.expr("CASE c_custkey % 5 WHEN 0 THEN '###' WHEN 1 THEN '--' || c_name || '--' WHEN 2 THEN c_name || ' points' WHEN 3 THEN '' ELSE c_name END")
    return table(spark, sf_dir, "customer").select("c_custkey", names.safe_name(raw).alias("name"))


FRAME_NAMES = "CASE p_partkey % 4 WHEN 0 THEN 'frame_' || p_partkey WHEN 1 THEN 'frame' || (p_partkey % 7) || '_' || p_partkey WHEN 2 THEN CAST(p_partkey AS VARCHAR(20)) ELSE p_name END"


@query(f"""WITH n AS (SELECT p_partkey, {FRAME_NAMES} AS name FROM part),
k AS (SELECT *, string_split_regex(name, '\\d+') AS t, [CAST(x AS HUGEINT) FOR x IN regexp_extract_all(name, '(\\d+)', 1)] AS d FROM n),
z AS (SELECT *, [{{'t': t[i], 'd': CASE WHEN d[i] IS NULL THEN CAST(-1 AS HUGEINT) ELSE d[i] END}} FOR i IN range(1, len(t) + 1)] AS key FROM k)
SELECT p_partkey, name, CAST(row_number() OVER (ORDER BY key, p_partkey) AS INT) AS place FROM z""")
def natural_sort(spark, sf_dir):
    from pyspark.sql import Window as W

    rows = table(spark, sf_dir, "part").selectExpr("p_partkey", f"{FRAME_NAMES} AS name")
    # a frame list of one scene: small enough for one ordered window
    return rows.withColumn("place", F.row_number().over(W.orderBy(names.natural_key(F.col("name")), "p_partkey")))


@query("""WITH n AS (SELECT s_suppkey, 'run7/mask_' || (s_suppkey * 37 % 101) || '_' || s_suppkey || '.png' AS path FROM supplier)
SELECT s_suppkey, CAST(regexp_extract(string_split(path, '/')[2], '(\\d+)', 1) AS BIGINT) AS idx,
       CAST(row_number() OVER (ORDER BY CAST(regexp_extract(string_split(path, '/')[2], '(\\d+)', 1) AS BIGINT), s_suppkey) AS INT) AS place FROM n""")
def sort_by_index(spark, sf_dir):
    from pyspark.sql import Window as W

    path = F.concat(F.lit("run7/mask_"), (F.col("s_suppkey") * 37 % 101).cast("string"), F.lit("_"), F.col("s_suppkey").cast("string"), F.lit(".png"))
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", names.index_key(path).alias("idx"))
    return rows.withColumn("place", F.row_number().over(W.orderBy("idx", "s_suppkey")))


@query("""SELECT vec_id, printf('%06d', vec_id) AS frame_name, 'frame_' || printf('%05d', vec_id) AS part_name, 'point_' || vec_id AS document,
       TRY_CAST(CASE WHEN vec_id % 3 = 0 THEN 'x' || vec_id ELSE CAST(vec_id AS VARCHAR) END AS BIGINT) AS parsed FROM embeddings""")
def format_ids(spark, sf_dir):
    v = F.col("vec_id")
    text = F.when(v % 3 == 0, F.concat(F.lit("x"), v.cast("string"))).otherwise(v.cast("string"))
    return table(spark, sf_dir, "embeddings").select("vec_id", names.frame_name(v).alias("frame_name"), F.format_string("frame_%05d", v).alias("part_name"), names.point_document(v).alias("document"), names.parsed_id(text).alias("parsed"))


# -- frames ----------------------------------------------------------------------------------

FRAMES = "f AS (SELECT n_regionkey AS scene, n_name AS frame, n_nationkey FROM nation)"


def frame_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("n_regionkey AS scene", "n_name AS frame", "n_nationkey")


@query(f"WITH {FRAMES}, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY scene ORDER BY frame) - 1 AS INT) AS ordinal FROM f) SELECT * FROM o WHERE ordinal % 3 = 0")
def frame_stride(spark, sf_dir):
    return frames.every_kth_frame(frame_table(spark, sf_dir), 3)


@query("SELECT event_id AS frame_idx, event_id // 7 AS export_idx, printf('%06d', event_id // 7) AS folder FROM events WHERE event_id % 7 = 0")
def frame_skip_export(spark, sf_dir):
    out = frames.exported_frames(table(spark, sf_dir, "events").select(F.col("event_id").alias("frame_idx")), 7)
    return out.withColumn("folder", names.frame_name(F.col("export_idx")))


@query(f"WITH {FRAMES} SELECT scene, frame FROM f WHERE n_nationkey % 2 = 0 AND n_nationkey % 3 <> 1 AND n_nationkey < 20")
def frame_asset_join(spark, sf_dir):
    f = frame_table(spark, sf_dir)
    assets = [f.where("n_nationkey % 2 = 0"), f.where("n_nationkey % 3 <> 1"), f.where("n_nationkey < 20")]
    return frames.complete_frames(f, assets).select("scene", "frame")


def pose_column(tz: str = "tz") -> Column:
    row = ["r00", "r01", "0", "tx", "r10", "r11", "0", "ty", "0", "0", "1", tz, "0", "0", "0", "1"]
    return F.array(*[F.expr(x).cast("double") for x in row])


@query(f"""WITH {V_POSES}, c AS (SELECT *, r00 * r11 - r01 * r10 AS det FROM v_poses),
j AS (SELECT frame, CASE WHEN frame % 3 = 0 THEN NULL WHEN abs(det - 1) <= 0.1 THEN tx END AS a, CASE WHEN frame % 2 = 0 THEN tx + 100 END AS b FROM c)
SELECT frame, round(coalesce(a, b), 6) AS tx, coalesce(a, b) IS NOT NULL AS valid FROM j""")
def pose_validate(spark, sf_dir):
    p = views.poses(spark, sf_dir)
    first = F.when(F.col("frame") % 3 == 0, F.transform(pose_column(), lambda x: F.lit(float("nan")))).otherwise(pose_column())
    identity = [F.lit(float(i % 5 == 0)) for i in range(16)]
    identity[3] = F.col("tx") + 100
    second = F.when(F.col("frame") % 2 == 0, F.array(*identity))
    pose = geometry.first_valid_pose(first, second)
    return rounded(p.select("frame", F.get(pose, F.lit(3)).alias("tx"), pose.isNotNull().alias("valid")), 6, "tx")


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(CASE WHEN event_id % 2 = 0 THEN '{"fx": ' || event_id || ', "fy": 2.5, "cx": 1.5, "cy": 0.5}' END, '$.fx') AS DOUBLE), 577.870605) AS fx,
       CAST(CASE WHEN event_id % 2 = 0 THEN 0.5 ELSE 239.5 END AS DOUBLE) AS cy FROM events""")
def intrinsics_json(spark, sf_dir):
    from ..config import Intrinsics

    d = Intrinsics()
    body = F.when(F.col("event_id") % 2 == 0, F.concat(F.lit('{"fx": '), F.col("event_id").cast("string"), F.lit(', "fy": 2.5, "cx": 1.5, "cy": 0.5}')))
    found = F.from_json(body, "fx double, fy double, cx double, cy double")
    return table(spark, sf_dir, "events").select("event_id", F.coalesce(found["fx"], F.lit(d.fx)).alias("fx"), F.coalesce(found["cy"], F.lit(d.cy)).alias("cy"))


@query("SELECT n_nationkey, CAST(i AS INT) AS i, CASE WHEN i = 0 THEN 500.0 + n_nationkey WHEN i = 5 THEN 501.0 + n_nationkey WHEN i = 2 THEN 319.5 WHEN i = 6 THEN 239.5 WHEN i % 5 = 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS value FROM nation, range(16) t(i)")
def make_intrinsics(spark, sf_dir):
    f = F.col("n_nationkey").cast("double")
    m = geometry.intrinsic_matrix(f + 500.0, f + 501.0, F.lit(319.5), F.lit(239.5))
    return table(spark, sf_dir, "nation").select("n_nationkey", F.posexplode(m).alias("i", "value"))


@query("""WITH t AS (SELECT n_nationkey, 640.0 + n_nationkey AS w0, 480.0 AS h0, 320.0 AS w1, 240.0 AS h1 FROM nation)
SELECT n_nationkey, round(577.0 * (floor(h1 * w0 / h0) / w0), 6) AS fx, round(578.0 * (h1 / h0), 6) AS fy,
       round(319.5 * ((w1 - 1) / (w0 - 1)), 6) AS cx, round(239.5 * ((h1 - 1) / (h0 - 1)), 6) AS cy FROM t""")
def adjust_intrinsics(spark, sf_dir):
    w0 = F.col("n_nationkey").cast("double") + 640.0
    fx, fy, cx, cy = geometry.adjusted_intrinsics(F.lit(577.0), F.lit(578.0), F.lit(319.5), F.lit(239.5), (w0, F.lit(480.0)), (F.lit(320.0), F.lit(240.0)))
    return rounded(table(spark, sf_dir, "nation").select("n_nationkey", fx.alias("fx"), fy.alias("fy"), cx.alias("cx"), cy.alias("cy")), 6, "fx", "fy", "cx", "cy")


@query("SELECT p_partkey, CAST(least(floor((p_partkey % 480) * (CAST(968 AS DOUBLE) / 480)), 967) AS INT) AS src_v, CAST(least(floor((p_partkey % 640) * (CAST(1296 AS DOUBLE) / 640)), 1295) AS INT) AS src_u FROM part")
def nearest_resize_index(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select("p_partkey", geometry.nearest_source(k % 480, F.lit(968), F.lit(480)).alias("src_v"), geometry.nearest_source(k % 640, F.lit(1296), F.lit(640)).alias("src_u"))


@query("SELECT p_partkey, " + ", ".join(f"round((p_size / 50.0 - {m}) / {s}, 6) + 0.0 AS c{i}" for i, (m, s) in enumerate(zip(CHANNEL_MEAN, CHANNEL_STD, strict=True))) + " FROM (SELECT p_partkey, CAST(p_size AS DOUBLE) AS p_size FROM part)")
def channel_normalize(spark, sf_dir):
    x = F.col("p_size").cast("double") / 50.0
    return rounded(table(spark, sf_dir, "part").select("p_partkey", *[((x - m) / s).alias(f"c{i}") for i, (m, s) in enumerate(zip(CHANNEL_MEAN, CHANNEL_STD, strict=True))]), 6, "c0", "c1", "c2")


# -- pixels and points -----------------------------------------------------------------------


@query(f"WITH {V_PIXELS} SELECT frame, v, u, depth_mm, l_orderkey FROM v_pixels WHERE v % 10 = 0 AND u % 10 = 0")
def grid_stride(spark, sf_dir):
    return frames.on_grid(views.pixels(spark, sf_dir), 10).select("frame", "v", "u", "depth_mm", "l_orderkey")


@query(f"WITH {V_PIXELS}, o AS (SELECT *, row_number() OVER (PARTITION BY frame, mask_id ORDER BY {ORDER_SQL}) - 1 AS i FROM v_pixels) SELECT frame, mask_id, v, u, depth_mm FROM o WHERE i % 8 = 0")
def mask_pixel_stride(spark, sf_dir):
    return frames.every_kth_row(views.pixels(spark, sf_dir), 8, ["frame", "mask_id"], PIXEL_ORDER).select("frame", "mask_id", "v", "u", "depth_mm")


def depth_counts(spark: SparkSession, sf_dir: str, included: bool) -> DataFrame:
    z = F.col("depth_mm") / 1000.0
    return views.pixels(spark, sf_dir).where(frames.in_depth(z, 0.5, 6.0, included)).groupBy("frame", "mask_id").agg(F.count("*").alias("n"), F.max("depth_mm").alias("deepest"))


DEPTH_SQL = "WITH {} SELECT frame, mask_id, CAST(count(*) AS BIGINT) AS n, max(depth_mm) AS deepest FROM v_pixels WHERE depth_mm / 1000.0 > 0.5 AND depth_mm / 1000.0 {} 6.0 GROUP BY frame, mask_id"


@query(DEPTH_SQL.format(V_PIXELS, "<"))
def depth_filter_open(spark, sf_dir):
    return depth_counts(spark, sf_dir, False)


@query(DEPTH_SQL.format(V_PIXELS, "<="))
def depth_filter_halfopen(spark, sf_dir):
    return depth_counts(spark, sf_dir, True)


WORLD = """z AS (SELECT *, CAST(depth_mm AS DOUBLE) / 1000.0 AS d FROM v_pixels),
cam AS (SELECT *, (u - 319.5) / 577.870605 * d AS xc, (v - 239.5) / 577.870605 * d AS yc FROM z WHERE d > 0.5 AND d < 6.0),
world AS (SELECT cam.*, r00 * xc + r01 * yc + 0 * d + tx AS wx, r10 * xc + r11 * yc + 0 * d + ty AS wy, 0 * xc + 0 * yc + 1 * d + tz AS wz, red / 255.0 AS r FROM cam JOIN v_poses ON cam.frame = v_poses.frame)"""


def world(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels in range as world points; the few poses are broadcast by their size."""
    z = F.col("depth_mm").cast("double") / 1000.0
    px = views.pixels(spark, sf_dir).withColumn("d", z).where(frames.in_depth(F.col("d"), 0.5, 6.0, False))
    out = px.join(views.poses(spark, sf_dir).select("frame", pose_column().alias("pose")), "frame")
    point = geometry.unprojected(F.col("u"), F.col("v"), F.col("d"), *[F.lit(x) for x in (FX, FY, CX, CY)])
    x, y, z = geometry.moved(geometry.pose_rows(F.col("pose")), point)
    return out.withColumns({"wx": x, "wy": y, "wz": z, "r": F.col("red") / 255.0}).drop("pose")


@query(f"WITH {V_PIXELS}, {V_POSES}, {WORLD} SELECT frame, CAST(count(*) AS BIGINT) AS n, round(avg(wx), 5) AS mx, round(avg(wy), 5) AS my, round(avg(wz), 5) AS mz, round(min(wx), 5) AS lx, round(max(wy), 5) AS hy, round(avg(r), 5) AS r FROM world GROUP BY frame")
def unproject(spark, sf_dir):
    out = world(spark, sf_dir).groupBy("frame").agg(F.count("*").alias("n"), F.avg("wx").alias("mx"), F.avg("wy").alias("my"), F.avg("wz").alias("mz"), F.min("wx").alias("lx"), F.max("wy").alias("hy"), F.avg("r").alias("r"))
    return rounded(out, 5, "mx", "my", "mz", "lx", "hy", "r")


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice AS x FROM lineitem WHERE l_linenumber <> 3 AND l_linenumber <> 4")
def finite_filter(spark, sf_dir):
    x = F.when(F.col("l_linenumber") == 3, F.lit(float("nan"))).when(F.col("l_linenumber") == 4, F.lit(float("-inf"))).otherwise(F.col("l_extendedprice"))
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", x.alias("x")).where(geometry.finite(F.col("x")))


@query(f"""WITH {V_PIXELS}, o AS (SELECT *, row_number() OVER (PARTITION BY frame, mask_id ORDER BY {ORDER_SQL}) - 1 AS i FROM v_pixels),
k AS (SELECT * FROM o WHERE i % 8 = 0 AND depth_mm / 1000.0 > 0.5 AND depth_mm / 1000.0 <= 6.0)
SELECT frame, mask_id, CAST(count(*) AS BIGINT) AS n FROM k GROUP BY frame, mask_id HAVING count(*) >= 50""")
def min_points_having(spark, sf_dir):
    px = frames.every_kth_row(views.pixels(spark, sf_dir), 8, ["frame", "mask_id"], PIXEL_ORDER)
    px = px.where(frames.in_depth(F.col("depth_mm") / 1000.0, 0.5, 6.0, True))
    return frames.with_min_points(px, ["frame", "mask_id"], 50).groupBy("frame", "mask_id").agg(F.count("*").alias("n"))


@query(f"WITH {V_PIXELS}, o AS (SELECT *, row_number() OVER (PARTITION BY frame, mask_id ORDER BY {ORDER_SQL}) - 1 AS i FROM v_pixels WHERE depth_mm > 500) SELECT frame, mask_id, v, u, depth_mm FROM o WHERE i % 3 = 0")
def uniform_downsample_group(spark, sf_dir):
    return frames.every_kth_row(views.pixels(spark, sf_dir).where("depth_mm > 500"), 3, ["frame", "mask_id"], PIXEL_ORDER).select("frame", "mask_id", "v", "u", "depth_mm")


@query(f"WITH {V_PIXELS}, o AS (SELECT *, row_number() OVER (ORDER BY frame, {ORDER_SQL}) - 1 AS i FROM v_pixels WHERE depth_mm > 500 AND depth_mm < 6000) SELECT i // 10 AS point_id, frame, v, u, depth_mm FROM o WHERE i % 10 = 0")
def uniform_downsample_global(spark, sf_dir):
    px = views.pixels(spark, sf_dir).where("depth_mm > 500 AND depth_mm < 6000")
    return frames.every_kth_of_all(px, 10, ["frame"], PIXEL_ORDER).select("point_id", "frame", "v", "u", "depth_mm")


PAIR_KEYS = "l_orderkey, l_linenumber, l_partkey, l_suppkey"


@query(f"""WITH {V_PIXELS}, m AS (SELECT DISTINCT frame, v, u, mask_id FROM v_pixels), d AS (SELECT frame, v, u, min(depth_mm) AS depth_mm FROM v_pixels GROUP BY frame, v, u), c AS (SELECT frame, v, u, max(red) AS red FROM v_pixels WHERE red % 2 = 0 GROUP BY frame, v, u)
SELECT m.frame AS frame, m.mask_id AS mask_id, CAST(count(*) AS BIGINT) AS n, CAST(sum(d.depth_mm) AS BIGINT) AS depth, CAST(sum(c.red) AS BIGINT) AS red
FROM m JOIN d ON m.frame = d.frame AND m.v = d.v AND m.u = d.u JOIN c ON m.frame = c.frame AND m.v = c.v AND m.u = c.u GROUP BY m.frame, m.mask_id""")
def pixel_gather(spark, sf_dir):
    px = views.pixels(spark, sf_dir)
    m = px.select("frame", "v", "u", "mask_id").distinct()
    d = px.groupBy("frame", "v", "u").agg(F.min("depth_mm").alias("depth_mm"))
    c = px.where("red % 2 = 0").groupBy("frame", "v", "u").agg(F.max("red").alias("red"))
    return frames.gathered_pixels(m, d, c).groupBy("frame", "mask_id").agg(F.count("*").alias("n"), F.sum("depth_mm").alias("depth"), F.sum("red").alias("red"))


@query(f"WITH {V_PIXELS}, b AS (SELECT frame, mask_id, min(u) AS u0, max(u) AS u1, min(v) AS v0, max(v) AS v1 FROM v_pixels GROUP BY frame, mask_id) SELECT frame, mask_id, greatest(u0 - CAST(trunc((u1 - u0) * 0.3) AS INT), 0) AS x0, greatest(v0 - CAST(trunc((v1 - v0) * 0.3) AS INT), 0) AS y0, least(u1 + CAST(trunc((u1 - u0) * 0.3) AS INT), 639) AS x1, least(v1 + CAST(trunc((v1 - v0) * 0.3) AS INT), 479) AS y1 FROM b")
def mask_bbox(spark, sf_dir):
    return frames.mask_boxes(views.pixels(spark, sf_dir), ["frame", "mask_id"], 480, 640, 0.3)


@query(f"""WITH {V_PIXELS}, m AS (SELECT DISTINCT 0 AS scene, frame, mask_id, mask_id * 2 AS area FROM v_pixels WHERE mask_id <> 2), o AS (SELECT 0 AS scene, frame, mask_id, CAST(count(*) AS BIGINT) AS n FROM v_pixels WHERE frame <> 3 GROUP BY frame, mask_id)
SELECT m.scene AS scene, m.frame AS frame, m.mask_id AS mask_id, area, n FROM m JOIN o ON m.frame = o.frame AND m.mask_id = o.mask_id""")
def mask_pair_join(spark, sf_dir):
    px = views.pixels(spark, sf_dir).withColumn("scene", F.lit(0))
    m = px.where("mask_id <> 2").select("scene", "frame", "mask_id", (F.col("mask_id") * 2).alias("area")).distinct()
    o = px.where("frame <> 3").groupBy("scene", "frame", "mask_id").agg(F.count("*").alias("n"))
    return frames.paired_masks(m, o)


@query(f"""WITH {V_PIXELS}, p AS (SELECT frame, mask_id, v, u, l_orderkey FROM v_pixels), e AS (SELECT vec_id, CAST(vec_id % 16 AS INT) AS frame, CAST(vec_id // 16 % 7 + 1 AS INT) AS mask_id, embedding FROM embeddings)
SELECT frame, mask_id, v, u, l_orderkey, vec_id, CAST(i AS INT) AS i, round(CAST(x AS DOUBLE), 6) AS e
FROM (SELECT p.frame AS frame, p.mask_id AS mask_id, v, u, l_orderkey, vec_id, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS i FROM p JOIN e ON p.frame = e.frame AND p.mask_id = e.mask_id)""")
def embed_broadcast(spark, sf_dir):
    p = views.pixels(spark, sf_dir).select("frame", "mask_id", "v", "u", "l_orderkey")
    e = table(spark, sf_dir, "embeddings").selectExpr("vec_id", "CAST(vec_id % 16 AS INT) AS frame", "CAST(vec_id DIV 16 % 7 + 1 AS INT) AS mask_id", "embedding")
    # rounded once a vector, not once a row
    e = e.withColumn("embedding", F.transform("embedding", lambda x: F.round(x.cast("double"), 6) + 0.0))
    out = frames.spread_vectors(p, e, block=1024)
    return out.select("frame", "mask_id", "v", "u", "l_orderkey", "vec_id", F.posexplode("embedding").alias("i", "e"))


# -- voxels ----------------------------------------------------------------------------------


def voxel_sql(c: str, size: float) -> str:
    return f"CAST(floor(CAST(CAST({c} AS DOUBLE) / CAST(CAST({size} AS FLOAT) AS DOUBLE) AS FLOAT)) AS BIGINT)"


VOXEL = ", ".join(f"{voxel_sql(c, 0.1)} AS v{c}" for c in "xyz")


@query(f"WITH {V_POINTS} SELECT point_id, {VOXEL} FROM v_points")
def voxel_index(spark, sf_dir):
    return views.points(spark, sf_dir).select("point_id", *voxels.voxel_keys(0.1))


MEANS = ("x", "y", "z", "r", "g", "b")


@query(f"WITH {V_POINTS}, k AS (SELECT *, {VOXEL} FROM v_points) SELECT vx, vy, vz, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"round(avg({c}), 5) + 0.0 AS {c}" for c in MEANS) + " FROM k GROUP BY vx, vy, vz")
def voxel_average(spark, sf_dir):
    return rounded(voxels.voxel_average(views.points(spark, sf_dir), 0.1, count="n"), 5, *MEANS)


@query(f"""WITH {V_POINTS}, k AS (SELECT {VOXEL}, unnest(embedding) AS e, generate_subscripts(embedding, 1) - 1 AS i FROM v_points),
s AS (SELECT vx, vy, vz, i, sum(CAST(e AS DOUBLE)) AS s FROM k GROUP BY vx, vy, vz, i), n AS (SELECT *, sqrt(sum(s * s) OVER (PARTITION BY vx, vy, vz)) AS n FROM s)
SELECT vx, vy, vz, CAST(i AS INT) AS i, round(s / (n + 1e-8), 5) + 0.0 AS e FROM n""")
def voxel_vector_mean(spark, sf_dir):
    out = voxels.voxel_average(views.points(spark, sf_dir), 0.1, means=(), vector="embedding", dim=DIM)
    return rounded(out.select("vx", "vy", "vz", F.posexplode("embedding").alias("i", "e")), 5, "e")


def pairwise_sql() -> str:
    """Passes 0 to 2 merge seven frames: 7 -> 4 -> 2 -> 1, a frame without a partner going on as it is."""
    ctes, left, cols = [V_POINTS, f"p0 AS (SELECT CAST(ford AS BIGINT) AS ford, {', '.join(MEANS)} FROM v_points)"], 7, ", ".join(MEANS)
    for i in range(1, 4):
        means = ", ".join(f"avg({c}) AS {c}" for c in MEANS)
        keys = ", ".join(f"{voxel_sql(c, 0.1)}" for c in "xyz")
        alone = left - 1 if left % 2 else -1
        ctes.append(f"p{i} AS (SELECT ford // 2 AS ford, {means} FROM p{i - 1} WHERE ford <> {alone} GROUP BY ford // 2, {keys} UNION ALL SELECT ford // 2, {cols} FROM p{i - 1} WHERE ford = {alone})")
        left = (left + 1) // 2
    return "WITH " + ", ".join(ctes) + " SELECT " + ", ".join(f"round({c}, 4) + 0.0 AS {c}" for c in MEANS) + " FROM p3"


@query(pairwise_sql())
def voxel_merge_pairwise(spark, sf_dir):
    return rounded(voxels.merge_pairwise(views.points(spark, sf_dir), 0.1, frames=7), 4, *MEANS)


@query(f"WITH {V_POINTS}, k AS (SELECT *, {VOXEL} FROM v_points) SELECT CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"round(avg({c}), 4) + 0.0 AS {c}" for c in MEANS) + " FROM k GROUP BY vx, vy, vz")
def voxel_merge_weighted(spark, sf_dir):
    return rounded(voxels.merge_weighted(views.points(spark, sf_dir), 0.1).drop("vx", "vy", "vz"), 4, *MEANS)


@query(f"WITH {V_POINTS} SELECT point_id, round(x, 6) + 0.0 AS x, cluster_label FROM v_points WHERE ford = 1 UNION ALL SELECT point_id, round(x, 6) + 0.0 AS x, cluster_label FROM v_points WHERE ford IN (1, 2)")
def union_clouds(spark, sf_dir):
    p = views.points(spark, sf_dir).select("point_id", "x", "cluster_label", "ford")
    return rounded(p.where("ford = 1").unionByName(p.where("ford IN (1, 2)")).drop("ford"), 6, "x")


# -- neighbours ------------------------------------------------------------------------------

DIST = "sqrt((d.x - s.x) * (d.x - s.x) + (d.y - s.y) * (d.y - s.y) + (d.z - s.z) * (d.z - s.z))"
NEAR = f"""d AS (SELECT * FROM v_points WHERE point_id % 3 <> 0), s AS (SELECT * FROM v_points WHERE point_id % 3 = 0),
near AS (SELECT d.point_id AS qid, s.point_id AS nid, {DIST} AS dist, s.embedding AS e FROM d, s QUALIFY row_number() OVER (PARTITION BY d.point_id ORDER BY {DIST}, s.point_id) <= 21)"""


def halves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    p = views.points(spark, sf_dir)
    return p.where("point_id % 3 <> 0"), p.where("point_id % 3 = 0")


@query(f"WITH {V_POINTS}, {NEAR} SELECT qid, nid, round(dist, 6) AS dist FROM near")
def knn_join(spark, sf_dir):
    dense, sparse = halves(spark, sf_dir)
    return rounded(knn.knn(dense.withColumnRenamed("point_id", "qid"), sparse.withColumnRenamed("point_id", "nid"), 21), 6, "dist")


@query(f"WITH {V_POINTS}, {NEAR} SELECT qid, nid, round(dist, 6) AS dist FROM near WHERE dist <= 0.2")
def knn_within(spark, sf_dir):
    """The same by the grid join, limited to a radius."""
    dense, sparse = halves(spark, sf_dir)
    return rounded(knn.knn(dense.withColumnRenamed("point_id", "qid"), sparse.withColumnRenamed("point_id", "nid"), 21, within=0.2, broadcast_points=0), 6, "dist")


@query(f"WITH {V_POINTS}, {NEAR} SELECT qid, nid, round(dist, 6) AS dist FROM near")
def knn_join_grid(spark, sf_dir):
    """``knn_join`` by rounds of the grid join, as for a base too large to broadcast."""
    dense, sparse = halves(spark, sf_dir)
    return rounded(knn.knn(dense.withColumnRenamed("point_id", "qid"), sparse.withColumnRenamed("point_id", "nid"), 21, broadcast_points=0), 6, "dist")


@query("SELECT p_partkey, round(exp(-(p_retailprice / 1000.0) * (p_retailprice / 1000.0) / (2 * 0.7 * 0.7)), 8) AS w FROM part")
def gaussian_weight(spark, sf_dir):
    return rounded(table(spark, sf_dir, "part").select("p_partkey", geometry.gaussian_weight(F.col("p_retailprice") / 1000.0, 0.7).alias("w")), 8, "w")


@query(f"""WITH {V_POINTS}, {NEAR}, w AS (SELECT qid, e, exp(-dist * dist / (2 * 0.05 * 0.05)) AS w FROM near),
t AS (SELECT qid, sum(w) AS t FROM w GROUP BY qid), x AS (SELECT qid, w, unnest(e) AS e, generate_subscripts(e, 1) - 1 AS i FROM w),
m AS (SELECT x.qid AS qid, i, sum(w * CAST(e AS DOUBLE)) / (max(t) + 1e-8) AS m FROM x JOIN t ON x.qid = t.qid GROUP BY x.qid, i),
n AS (SELECT *, sqrt(sum(m * m) OVER (PARTITION BY qid)) AS n FROM m)
SELECT qid AS point_id, CAST(i AS INT) AS i, round(m / (n + 1e-8), 5) + 0.0 AS e FROM n""")
def interpolate(spark, sf_dir):
    dense, sparse = halves(spark, sf_dir)
    out = knn.interpolated(dense, sparse, 21, 0.05, DIM)
    return rounded(out.select("point_id", F.posexplode("embedding").alias("i", "e")), 5, "e")


@query(f"""WITH {V_POINTS}, near AS (SELECT d.point_id AS point_id, {DIST} AS dist FROM v_points d, v_points s QUALIFY row_number() OVER (PARTITION BY d.point_id ORDER BY {DIST}, s.point_id) <= 100),
m AS (SELECT point_id, avg(dist) AS md FROM near GROUP BY point_id), t AS (SELECT avg(md) + stddev_samp(md) AS most FROM m)
SELECT point_id, round(md, 6) AS mean_distance FROM m, t WHERE md > 0 AND md < most""")
def stat_outlier(spark, sf_dir):
    return rounded(knn.inliers(views.points(spark, sf_dir), 100, 1.0), 6, "mean_distance")


@query()
def point_normals(spark, sf_dir):
    return rounded(knn.normals(views.points(spark, sf_dir), 15), 6, "nx", "ny", "nz")


# -- colours ---------------------------------------------------------------------------------


@query("SELECT c_custkey, round(CASE WHEN (SELECT max(c_acctbal) FROM customer) > 1.0 THEN c_acctbal / 255.0 ELSE c_acctbal END, 6) AS r, round(CAST(0 AS DOUBLE), 6) AS g, round(1 / 255.0, 6) AS b FROM customer")
def color_autoscale(spark, sf_dir):
    return rounded(coloring.autoscaled(table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("r"), F.lit(0.0).alias("g"), F.lit(1.0).alias("b"))), 6, "r", "g", "b")


LEVELS = "levels AS (SELECT point_id, score, round_even(least(greatest((score - (SELECT min(score) FROM scored)) / ((SELECT max(score) FROM scored) - (SELECT min(score) FROM scored) + 1e-8), 0), 1) * 199, 0) / 199 AS level FROM scored)"


@query(f"WITH {HITS}, {LEVELS} SELECT point_id, round(level, 6) AS level FROM levels")
def minmax_quantize(spark, sf_dir):
    return rounded(coloring.quantized_scores(search.calibrated(hits(spark, sf_dir))).select("point_id", "level"), 6, "level")


def ramp_sql(shift: int) -> str:
    points = "[" + ", ".join(f"{p >> shift & 255}" for p in colors.RAMP) + "]"
    cell = "CAST(least(floor(level * 9), 8) AS INT)"
    return f"({points}[{cell} + 1] * (1 - (level * 9 - {cell})) + {points}[{cell} + 2] * (level * 9 - {cell})) / 255.0"


@query(f"WITH {V_POINTS}, {HITS}, {LEVELS} SELECT p.point_id AS point_id, " + ", ".join(f"round(CASE WHEN level IS NULL THEN {c} ELSE 0.8 * {ramp_sql(s)} + (1 - 0.8) * {c} END, 5) AS {c}" for c, s in zip("rgb", (16, 8, 0), strict=True)) + " FROM v_points p LEFT JOIN levels l ON p.point_id = l.point_id")
def overlay_blend(spark, sf_dir):
    points = views.points(spark, sf_dir).select("point_id", "r", "g", "b")
    return rounded(coloring.overlay(points, search.calibrated(hits(spark, sf_dir)).select("point_id", "score")), 5, "r", "g", "b")


PALETTE = "ps AS (SELECT label, CASE WHEN label = -1 THEN 0.5 ELSE (place % 4) / 4.0 END AS pr, CASE WHEN label = -1 THEN 0.5 ELSE (place % 3) / 3.0 END AS pg, CASE WHEN label = -1 THEN 0.5 ELSE (place % 7) / 7.0 END AS pb FROM (SELECT label, dense_rank() OVER (ORDER BY label) AS place FROM (SELECT DISTINCT cluster_label - 1 AS label FROM v_points)))"


@query(f"WITH {V_POINTS}, {PALETTE} SELECT point_id, cluster_label - 1 AS cluster_label, " + ", ".join(f"round(0.5 * p{c} + (1 - 0.5) * {c}, 5) AS {c}" for c in "rgb") + " FROM v_points JOIN ps ON label = cluster_label - 1")
def cluster_palette(spark, sf_dir):
    from pyspark.sql import Window as W

    points = views.points(spark, sf_dir).select("point_id", "r", "g", "b", (F.col("cluster_label") - 1).alias("cluster_label"))
    place = F.dense_rank().over(W.orderBy("cluster_label"))
    noise = F.col("cluster_label") == -1
    palette = points.select("cluster_label").distinct().withColumn("place", place)
    palette = palette.select("cluster_label", *[F.when(noise, coloring.GREY).otherwise(F.col("place") % n / float(n)).alias(c) for c, n in (("pr", 4), ("pg", 3), ("pb", 7))])
    return rounded(coloring.cluster_colored(points, palette, 0.5), 5, "r", "g", "b")


@query("SELECT DISTINCT label AS cluster_label FROM embeddings")
def cluster_distinct(spark, sf_dir):
    return views.points(spark, sf_dir).select("cluster_label").distinct()


@query("SELECT label - 1 AS cluster_label, CAST(count(*) AS BIGINT) AS n FROM embeddings WHERE label - 1 >= 0 GROUP BY label - 1")
def cluster_counts(spark, sf_dir):
    return coloring.cluster_counts(views.points(spark, sf_dir).withColumn("cluster_label", F.col("cluster_label") - 1))


@query("SELECT label - 1 AS cluster_label, CAST(count(*) AS BIGINT) AS n FROM embeddings WHERE label - 1 >= 0 GROUP BY label - 1 ORDER BY n DESC, cluster_label DESC LIMIT 5")
def top_clusters(spark, sf_dir):
    return coloring.top_clusters(views.points(spark, sf_dir).withColumn("cluster_label", F.col("cluster_label") - 1))


@query("SELECT p_partkey, p_retailprice FROM part WHERE p_retailprice > (SELECT quantile_cont(p_retailprice, 0.02) FROM part)")
def quantile_filter(spark, sf_dir):
    return coloring.above_quantile(table(spark, sf_dir, "part").select("p_partkey", "p_retailprice"), "p_retailprice", 0.02)


@query()
def pca_color(spark, sf_dir):
    return rounded(coloring.pca_colored(views.points(spark, sf_dir)).select("point_id", "r", "g", "b"), 6, "r", "g", "b")


# -- registry and manifests ------------------------------------------------------------------

REG = "SELECT n_name AS scene, n_name || '.npz' AS npz_file, 'store/' || n_regionkey AS store_path, 'c' || n_nationkey AS collection FROM nation"


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr("n_name AS scene", "n_name || '.npz' AS npz_file", "'store/' || n_regionkey AS store_path", "'c' || n_nationkey AS collection", "n_nationkey")


@query(f"SELECT * FROM ({REG}) WHERE scene = (SELECT n_name FROM nation WHERE n_nationkey = 7)")
def registry_lookup(spark, sf_dir):
    rows = registered(spark, sf_dir)
    return registry.members(rows, rows.where("n_nationkey = 7"), "scene").drop("n_nationkey")


@query(f"SELECT scene, CASE WHEN substr(collection, 2)::INT % 4 = 0 THEN 'new.npz' ELSE npz_file END AS npz_file, store_path, collection FROM ({REG}) UNION ALL SELECT 'added', 'a.npz', 's', 'c'")
def registry_upsert(spark, sf_dir):
    old = registered(spark, sf_dir)
    new = old.where("n_nationkey % 4 = 0").withColumn("npz_file", F.lit("new.npz")).drop("n_nationkey")
    new = new.unionByName(spark.createDataFrame([("added", "a.npz", "s", "c")], registry.SCHEMA))
    return registry.upserted(old.drop("n_nationkey"), new)


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def scan_id_semi(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return registry.members(table(spark, sf_dir, "supplier"), known, "s_nationkey").select("s_suppkey", "s_name")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 1)")
def scan_id_anti(spark, sf_dir):
    known = table(spark, sf_dir, "nation").where("n_regionkey = 1").select(F.col("n_nationkey").alias("s_nationkey"))
    return registry.members(table(spark, sf_dir, "supplier"), known, "s_nationkey", inside=False).select("s_suppkey", "s_name")


TYPES = (".aggregation.json", ".sens", ".txt")


@query("SELECT n_name AS scan_id, t AS file_type, 'https://data.example/' || CASE WHEN t = '.sens' THEN 'v1/scans' ELSE 'v2/scans' END || '/' || n_name || '/' || n_name || t AS url, n_name || '/' || n_name || t AS out_file FROM nation, (SELECT unnest(['.aggregation.json', '.sens', '.txt']) AS t) WHERE NOT (n_nationkey % 5 = 0 AND t = '.txt')")
def download_plan(spark, sf_dir):
    scans = table(spark, sf_dir, "nation").select(F.col("n_name").alias("scan_id"), "n_nationkey")
    types = spark.createDataFrame([(t,) for t in TYPES], "file_type string")
    have = scans.where("n_nationkey % 5 = 0").select(F.concat("scan_id", F.lit("/"), "scan_id", F.lit(".txt")).alias("out_file"))
    return manifest.scan_plan(scans, types, "https://data.example", "v2/scans", "v1/scans", use_old_sens=True, existing=have)


@query("""WITH t AS (SELECT n_name AS scan_id, n_nationkey % 4 = 0 AS test FROM nation)
SELECT scan_id, t AS file_type, 'https://data.example/' || CASE WHEN t = '.sens' AND NOT test THEN 'v1/scans' ELSE 'v2/scans' END || '/' || scan_id || '/' || scan_id || t AS url,
       CASE WHEN test THEN 'scans_test/' ELSE 'scans/' END || scan_id || '/' || scan_id || t AS out_file
FROM t, (SELECT unnest(['.aggregation.json', '.sens', '.txt']) AS t) WHERE NOT (test AND t = '.aggregation.json')""")
def release_plan(spark, sf_dir):
    scans = table(spark, sf_dir, "nation").select(F.col("n_name").alias("scan_id"), (F.col("n_nationkey") % 4 == 0).alias("test"))
    types, test_types = (spark.createDataFrame([(t,) for t in kinds], "file_type string") for kinds in (TYPES, TYPES[1:]))
    return manifest.release_plan(scans.where("NOT test").select("scan_id"), scans.where("test").select("scan_id"), types, test_types, "https://data.example", "v2/scans", "v1/scans")


@query("SELECT t AS file_name, 'https://data.example/v2/tasks/' || t AS url, 'tasks/' || t AS out_file FROM (SELECT unnest(['labels.tsv', 'frames.zip', 'sets/limited.zip']) AS t)")
def task_plan(spark, sf_dir):
    return manifest.task_plan(spark, "https://data.example", "v2/tasks", ["labels.tsv", "frames.zip", "sets/limited.zip"])


@query("SELECT f AS folder, s AS split, CAST(i AS INT) AS shard, printf('%s-%05d-of-%05d.tfrecords', s, i, n) AS file_name FROM (SELECT f, s, n, unnest(range(0, n)) AS i FROM (SELECT unnest(['hires_tfrecords', 'lores_tfrecords']) AS f), (VALUES ('train', 100), ('val', 25), ('test', 10)) t(s, n))")
def shard_manifest(spark, sf_dir):
    return manifest.shard_plan(spark)


@query("SELECT t AS file_type FROM (SELECT unnest(['.aggregation.json', '.sens', '.txt']) AS t) WHERE t <> '.sens'")
def filetype_except(spark, sf_dir):
    return spark.createDataFrame([(t,) for t in manifest.without_types(TYPES, [".sens"])], "file_type string")

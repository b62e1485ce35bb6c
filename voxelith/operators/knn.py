"""Exact nearest neighbours in three dimensions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from ..functions.geometry import gaussian_weight
from ..functions.vectors import normalized, vector_sum
from ..session import kept, small_batches

#: Base points (32 bytes each) that are broadcast and searched directly; beyond, a grid join.
BROADCAST_POINTS = 20_000
#: Queries (32 bytes each) that are broadcast against a large base instead of joined by cells.
FEW_QUERIES = 1_000
#: Base points from which the first radius is chosen, and how often the extent is halved for that.
RADIUS_SAMPLE, LEVELS = 200_000, 12
#: Distances that are held at a time.
STEP = 2_000_000


def nearest(q: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int, within: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query row, base row and distance of the k nearest, ties by id."""
    rows, found, far = [], [], []
    step = max(1, STEP // max(1, len(base)))
    for lo in range(0, len(q), step):
        own = q[lo : lo + step]
        d2 = np.zeros((len(own), len(base)))
        for axis in range(3):
            diff = own[:, axis, None] - base[None, :, axis]
            d2 += diff * diff
        d = np.sqrt(d2)
        if k < len(base):
            most = np.partition(d, k - 1, axis=1)[:, k - 1 : k]
            r, c = np.nonzero(d <= most)
        else:
            r, c = np.nonzero(np.ones_like(d, bool))
        dist = d[r, c]
        order = np.lexsort([ids[c], dist, r])
        r, c, dist = r[order], c[order], dist[order]
        place = np.arange(len(r)) - np.searchsorted(r, r, "left")
        on = place < k
        if within is not None:
            on &= dist <= within
        rows.append(r[on] + lo)
        found.append(c[on])
        far.append(dist[on])
    return (np.concatenate(rows), np.concatenate(found), np.concatenate(far)) if rows else (np.zeros(0, int),) * 2 + (np.zeros(0),)


def direct(queries: DataFrame, base: DataFrame, k: int, within: float | None) -> DataFrame:
    spark = queries.sparkSession
    small_batches(spark, 10_000)
    table = base.toArrow()
    ids = table.column("nid").to_numpy().astype(np.int64)
    points = np.stack([table.column(c).to_numpy().astype(np.float64) for c in ("x", "y", "z")], axis=1)
    sent = spark.sparkContext.broadcast((ids, points))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, points = sent.value
        for batch in batches:
            if len(points) and len(batch):
                q = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], axis=1)
                r, c, d = nearest(q, points, ids, k, within)
                yield pa.record_batch({"qid": batch.column(0).take(pa.array(r)), "nid": pa.array(ids[c]), "dist": pa.array(d)})

    return queries.select("qid", "x", "y", "z").mapInArrow(run, "qid long, nid long, dist double")


def against_all(queries: DataFrame, base: DataFrame, k: int) -> DataFrame:
    """The k nearest of few queries: they are broadcast, each task keeps the k best of its base points, and those are ranked."""
    spark = queries.sparkSession
    small_batches(spark, 10_000)
    table = queries.select("qid", "x", "y", "z").toArrow()
    names = table.column("qid").combine_chunks()
    places = np.stack([table.column(c).to_numpy().astype(np.float64) for c in ("x", "y", "z")], axis=1)
    sent = spark.sparkContext.broadcast((names, places))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = sent.value
        r, ids, d = np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            if len(batch):
                own = batch.column(0).to_numpy().astype(np.int64)
                points = np.stack([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2, 3)], axis=1)
                rows, c, far = nearest(q, points, own, k, None)
                r, ids, d = np.concatenate([r, rows]), np.concatenate([ids, own[c]]), np.concatenate([d, far])
                order = np.lexsort([ids, d, r])
                r, ids, d = r[order], ids[order], d[order]
                best = np.arange(len(r)) - np.searchsorted(r, r, "left") < k
                r, ids, d = r[best], ids[best], d[best]
        if len(r):
            yield pa.record_batch({"qid": names.take(pa.array(r)), "nid": pa.array(ids), "dist": pa.array(d)})

    kind = queries.schema["qid"].dataType.simpleString()
    return best_k(base.select("nid", "x", "y", "z").mapInArrow(run, f"qid {kind}, nid long, dist double"), k)


def best_k(pairs: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(W.partitionBy("qid").orderBy("dist", "nid"))
    return pairs.withColumn("place", place).where(F.col("place") <= k).drop("place")


def cells(size: float) -> list:
    return [F.floor(F.col(c) / F.lit(size)).alias(f"c{c}") for c in "xyz"]


def grid(queries: DataFrame, base: DataFrame, k: int, radius: float, spread_queries: bool = False) -> DataFrame:
    """The k nearest within ``radius``: one side goes to its own cell and the 26 around, the other to one, and the cells are joined."""
    steps = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(h).alias("h")) for i in (-1, 0, 1) for j in (-1, 0, 1) for h in (-1, 0, 1)])
    around = [(F.col(f"c{c}") + F.col(f"s.{s}")).alias(f"c{c}") for c, s in zip("xyz", "ijh", strict=True)]
    # a little wider than the radius, so rounding puts no point at that distance two cells off
    size = radius * (1 + 1e-9)
    moved = [F.col(c).alias(f"q{c}") for c in "xyz"]
    q, b = queries.select("qid", *moved, *cells(size)), base.select("nid", "x", "y", "z", *cells(size))
    if spread_queries:
        q = q.withColumn("s", F.explode(steps)).select("qid", "qx", "qy", "qz", *around)
    else:
        b = b.withColumn("s", F.explode(steps)).select("nid", "x", "y", "z", *around)
    dx, dy, dz = (F.col(f"q{c}") - F.col(c) for c in "xyz")
    pairs = q.join(b, ["cx", "cy", "cz"]).withColumn("dist", F.sqrt(dx * dx + dy * dy + dz * dz)).where(F.col("dist") <= radius).select("qid", "nid", "dist")
    return best_k(pairs, k)


def first_radius(base: DataFrame, n: int, low: list[float], whole: float, k: int) -> float:
    """The smallest of the extent's halvings whose cells hold about k / 2 other points around a point, so a ball holds more than k.

    Read from a sample of about RADIUS_SAMPLE points; it decides how the search runs, not what it finds.
    """
    share = min(1.0, RADIUS_SAMPLE / n)
    rows = base if share == 1.0 else base.sample(share, 1)
    fine = whole * 2.0**-LEVELS
    at = [F.floor((F.col(c) - F.lit(lo)) / F.lit(fine)).alias(f"c{c}") for c, lo in zip("xyz", low, strict=True)]
    counts = rows.select(*at).groupBy("cx", "cy", "cz").agg(F.count("*").alias("n"))
    counts = counts.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    up = [F.floor(F.col(f"c{c}") / F.pow(F.lit(2.0), F.col("level"))).alias(f"c{c}") for c in "xyz"]
    counts = counts.select("level", "n", *up).groupBy("level", "cx", "cy", "cz").agg(F.sum("n").alias("n"))
    near = counts.groupBy("level").agg((F.sum(F.col("n") * (F.col("n") - 1)) / F.sum("n")).alias("others"))
    fit = [r["level"] for r in near.collect() if r["others"] / share >= k / 2]
    return fine * 2.0 ** min(fit) if fit else whole


def knn(queries: DataFrame, base: DataFrame, k: int, within: float | None = None, broadcast_points: int = BROADCAST_POINTS, few_queries: int = FEW_QUERIES) -> DataFrame:
    """(qid, nid, dist): the k nearest points of ``base`` (nid, x, y, z) to each of ``queries`` (qid, x, y, z), ties by nid.

    A base of at most ``broadcast_points`` is broadcast. A larger one is joined by grid cells of one
    radius; queries with k neighbours inside it are done, the others go on with twice the radius.
    Rounds run at once and are stored, so there are no more than needed; when at most ``few_queries``
    are left, those are broadcast and every task ranks its own base points. ``within`` limits
    distances, so one pass is enough. Fewer than k base points give fewer rows. Points with a null or
    infinite coordinate have no neighbours and are none.
    """
    good = " AND ".join(f"{c} IS NOT NULL AND NOT isnan({c}) AND abs({c}) < double('Infinity')" for c in "xyz")
    queries = queries.select("qid", *[F.col(c).cast("double").alias(c) for c in "xyz"]).where(good)
    base = base.select(F.col("nid").cast("long").alias("nid"), *[F.col(c).cast("double").alias(c) for c in "xyz"]).where(good)
    ends = [f(c).alias(f"{f.__name__}_{c}") for c in "xyz" for f in (F.min, F.max)]
    extent = base.agg(F.count("*").alias("n"), *ends).first()
    n = extent["n"]
    if n <= broadcast_points:
        return direct(queries, base, k, within)
    if within is not None:
        return grid(queries, base, k, within)
    span = queries.agg(F.count("*").alias("n"), *ends).first()
    left = span["n"]
    if not n or left <= few_queries:
        return against_all(queries, base, k)
    low = [extent[f"min_{c}"] for c in "xyz"]
    size = float(np.sqrt(sum((extent[f"max_{c}"] - extent[f"min_{c}"]) ** 2 for c in "xyz"))) or 1.0
    whole = float(np.sqrt(sum((max(extent[f"max_{c}"], span[f"max_{c}"]) - min(extent[f"min_{c}"], span[f"min_{c}"])) ** 2 for c in "xyz"))) * (1 + 1e-9) or 1.0
    radius = min(first_radius(base, n, low, size, k), whole)
    base, done = kept(base), []
    while left > few_queries:
        found = kept(grid(queries, base, k, radius, spread_queries=left < n))
        full = found.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= (min(k, n) if radius < whole else 0)).select("qid")
        done.append(found.join(full, "qid", "left_semi"))
        if radius >= whole:
            break
        queries = kept(queries.join(full, "qid", "left_anti"))
        left, radius = queries.count(), min(radius * 2, whole)
    else:
        if left:
            done.append(against_all(queries, base, k))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def interpolated(dense: DataFrame, sparse: DataFrame, k: int, sigma: float, dim: int, within: float | None = None) -> DataFrame:
    """(point_id, embedding): a Gaussian-weighted mean of the k nearest sparse vectors, as a unit vector.

    The search moves ids and coordinates only; the wide vectors join the k hits at the end.
    """
    hits = knn(dense.select(F.col("point_id").alias("qid"), "x", "y", "z"), sparse.select(F.col("point_id").alias("nid"), "x", "y", "z"), k, within)
    hits = hits.withColumn("w", gaussian_weight(F.col("dist"), sigma))
    wide = hits.join(sparse.select(F.col("point_id").alias("nid"), "embedding"), "nid")
    sums = wide.groupBy("qid").agg(F.sum("w").alias("all"), vector_sum(F.col("embedding"), dim, F.col("w")).alias("embedding"))
    mean = F.transform("embedding", lambda x: x / (F.col("all") + 1e-8))
    return sums.select(F.col("qid").alias("point_id"), mean.alias("embedding")).withColumn("embedding", normalized(F.col("embedding")))


def mean_distances(points: DataFrame, k: int) -> DataFrame:
    """(point_id, mean_distance) to the k nearest points, the point itself among them."""
    hits = knn(points.select(F.col("point_id").alias("qid"), "x", "y", "z"), points.select(F.col("point_id").alias("nid"), "x", "y", "z"), k)
    return hits.groupBy(F.col("qid").alias("point_id")).agg(F.avg("dist").alias("mean_distance"))


def inliers(points: DataFrame, k: int = 100, ratio: float = 1.0) -> DataFrame:
    """(point_id, mean_distance) of points whose mean distance is above 0 and below mean + ratio x deviation over all points."""
    means = mean_distances(points, k)
    limit = means.agg((F.avg("mean_distance") + F.lit(ratio) * F.stddev_samp("mean_distance")).alias("most"))
    return means.crossJoin(F.broadcast(limit)).where((F.col("mean_distance") > 0) & (F.col("mean_distance") < F.col("most"))).drop("most")


def normals(points: DataFrame, k: int = 15) -> DataFrame:
    """(point_id, nx, ny, nz): the direction of least spread of each point's k nearest, with z (else y, else x) above 0."""
    hits = knn(points.select(F.col("point_id").alias("qid"), "x", "y", "z"), points.select(F.col("point_id").alias("nid"), "x", "y", "z"), k)
    near = hits.join(points.select(F.col("point_id").alias("nid"), "x", "y", "z"), "nid")
    sums = near.groupBy("qid").agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m{c}") for c in "xyz"], *[F.avg(F.col(a) * F.col(b)).alias(f"m{a}{b}") for a, b in ("xx", "xy", "xz", "yy", "yz", "zz")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = {c: batch.column(i).to_numpy(zero_copy_only=False) for i, c in enumerate(batch.schema.names)}
            cov = np.empty((len(batch), 3, 3))
            for i, a in enumerate("xyz"):
                for j, b in enumerate("xyz"):
                    cov[:, i, j] = x["m" + min(a, b) + max(a, b)] - x[f"m{a}"] * x[f"m{b}"]
            n = np.linalg.eigh(cov)[1][:, :, 0] if len(batch) else np.zeros((0, 3))
            lead = np.where(np.abs(n[:, 2]) > 1e-12, n[:, 2], np.where(np.abs(n[:, 1]) > 1e-12, n[:, 1], n[:, 0]))
            n = n * np.where(lead < 0, -1, 1)[:, None]
            yield pa.record_batch({"point_id": batch.column(0), "nx": pa.array(n[:, 0]), "ny": pa.array(n[:, 1]), "nz": pa.array(n[:, 2])})

    return sums.drop("n").mapInArrow(run, "point_id long, nx double, ny double, nz double")

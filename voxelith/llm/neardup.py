"""Near-duplicate classes by ProbMinHash signatures, banding and exact verification.

A document is the weighted set of its word shingles (weight: 1 + ln(how often each stands)). Each shingle
is a Poisson process with that rate; an arrival falls on a random register, and a register keeps
the shingle of its first arrival. Two documents agree on a register with a probability of
J_P(a, b) = sum over d of 1 / sum over e of max(a_e / a_d, b_e / b_d), which is the Jaccard
similarity where all weights are equal. 1 - J_P is a metric.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from .common import fresh, release, remove, scratch, small_batches, stored
from .graph import components
from .textnum import SPACE, U, Words, counted, mix, packed, pieces, shingles, unit, unpacked

#: Registers are BANDS x ROWS: a pair of similarity 0.8 shares no band with a probability of 4e-7.
BANDS, ROWS = 28, 4
#: Rounds of leaders at most, and pairs a member whose sizes are compared before another round is made; both bound the work, not the result.
ROUNDS, PAIRS_A_MEMBER = 4, 64
#: Shingles that more texts hold are not joined on; pairs whose common shingles are all such are bounded by how many they hold.
HOLDERS = 128
#: Cells a doubling, for the sizes by which pairs are bounded before they are joined.
CELLS = 32
#: Texts whose digests (16 bytes each) may be broadcast; beyond, texts are merge-joined.
BROADCAST_KEYS = 200_000


def prob_minhash(doc: np.ndarray, element: np.ndarray, weight: np.ndarray, n_docs: int, m: int) -> np.ndarray:
    """ProbMinHash registers, n_docs x m; a document without elements has 0 in all.

    An element stops once its next arrival is later than the document's bound. The bound is where
    nearly all registers are filled; for a document with one still empty it is doubled.
    """
    total = np.bincount(doc, weight, n_docs)
    bound = m * (np.log(m) + 3) / np.maximum(total, 1e-300)
    sig = np.zeros(n_docs * m, U)
    first = np.full(n_docs * m, np.inf)
    open_docs = total > 0
    while open_docs.any():
        use = open_docs[doc]
        d, e, w = doc[use], element[use], weight[use].astype(np.float64)
        first.reshape(n_docs, m)[open_docs] = np.inf
        t, i = np.zeros(len(d)), 0
        keys, times, own = [], [], []
        while len(d):
            i += 1
            h = mix(e ^ mix(np.full(1, i, U) * U(0x9E3779B97F4A7C15)))
            t = t - np.log(unit(h)) / w
            on = t <= bound[d]
            d, e, w, t, h = d[on], e[on], w[on], t[on], h[on]
            register = ((mix(h + U(0x632BE59BD9B4E019)) >> U(32)) * U(m) >> U(32)).astype(np.int64)
            keys.append(d * m + register)
            times.append(t)
            own.append(e)
        key, time, shingle = np.concatenate(keys), np.concatenate(times), np.concatenate(own)
        np.minimum.at(first, key, time)
        won = time == first[key]
        sig[key[won]] = shingle[won]
        open_docs &= np.isinf(first.reshape(n_docs, m)).any(axis=1)
        bound = np.where(open_docs, bound * 2, bound)
    return sig.reshape(n_docs, m)


def sketch_rows(k: int, bands: int, rows: int):
    """(node, text) to (node, bands); texts without words have no bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches, "text"):
            words = Words(data, offsets, ~SPACE)
            doc, h, n = counted(*shingles(words, k))
            sig = prob_minhash(doc, h, 1 + np.log(n), words.n_docs, bands * rows)
            band = mix(runs_of(sig.reshape(-1, rows)) + np.tile(np.arange(bands, dtype=U), words.n_docs) * U(0x9E3779B97F4A7C15)).view(np.int64)
            some = words.count > 0
            ends = np.append(0, np.cumsum(np.where(some, bands, 0))).astype(np.int32)
            yield pa.record_batch({"node": part.column(0), "bands": pa.ListArray.from_arrays(pa.array(ends), pa.array(band.reshape(-1, bands)[some].ravel()))})

    def runs_of(x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), U)
        for j in range(x.shape[1]):
            out = mix(out + x[:, j] * U(2 * j + 1))
        return out

    return run


def probability_jaccard(ha: np.ndarray, wa: np.ndarray, hb: np.ndarray, wb: np.ndarray) -> float:
    """J_P of two weighted sets with sorted, distinct hashes."""
    if not len(ha) or not len(hb):
        return 0.0
    both, ia, ib = np.intersect1d(ha, hb, assume_unique=True, return_indices=True)
    if not len(both):
        return 0.0
    a, b = wa[ia].astype(np.float64), wb[ib].astype(np.float64)
    if (a == b).all() and a.min() == a.max() == max(wa.max(), wb.max()):
        return len(both) / (len(ha) + len(hb) - len(both))
    ratio = a / b
    order = np.argsort(ratio, kind="stable")
    a, b, ratio = a[order], b[order], ratio[order]
    only_a, only_b = wa.sum() - a.sum(), wb.sum() - b.sum()
    low = np.searchsorted(ratio, ratio, "left")
    up_a = np.append(np.cumsum(a[::-1])[::-1], 0)[low] + only_a
    below_b = np.append(0, np.cumsum(b))[low] + only_b
    return float((1 / (up_a / a + below_b / b)).sum())


def verified_rows(k: int):
    """(a, b, za, zb) to (a, b, similarity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in unpacked(unpacked(batches, z="za", text="ta"), z="zb", text="tb"):
            sets = []
            for name in ("ta", "tb"):
                own: list[tuple[np.ndarray, np.ndarray]] = []
                for _, data, offsets in pieces(iter([part]), name):
                    words = Words(data, offsets, ~SPACE)
                    doc, h, n = counted(*shingles(words, k))
                    edge = np.searchsorted(doc, np.arange(words.n_docs + 1))
                    n = 1 + np.log(n)
                    own += [(h[i:j], n[i:j]) for i, j in zip(edge[:-1], edge[1:], strict=True)]
                sets.append(own)
            found = [probability_jaccard(*x, *y) for x, y in zip(*sets, strict=True)]
            yield pa.record_batch([*part.columns[:2], pa.array(found, pa.float64())], names=["a", "b", "similarity"])

    return run


def shingle_rows(k: int):
    """(node, z) to (node, shingle, weight, total): total is the node's weight."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(unpacked(batches), "text"):
            words = Words(data, offsets, ~SPACE)
            doc, h, n = counted(*shingles(words, k))
            weight = 1 + np.log(n)
            total = np.bincount(doc, weight, words.n_docs)[doc]
            yield pa.record_batch({"node": part.column(0).take(pa.array(doc)), "shingle": pa.array(h.view(np.int64)), "weight": pa.array(weight), "total": pa.array(total)})

    return run


def near_enough(s: Column, r: Column, threshold: float) -> Column:
    """Whether texts that have shares s and r of their weights in common may be that similar: J_P is 1 / (1/s + 1/r - 1) at most."""
    low = threshold - 1e-9
    return (s >= low) & (r >= low) & (1 / F.greatest(s, F.lit(low)) + 1 / F.greatest(r, F.lit(low)) - 1 <= 1 / low)


def divided(rest: DataFrame) -> DataFrame:
    """The rows of ``rest`` (bucket, root, ...) whose bucket holds members of several classes."""
    several = rest.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("bucket")
    return rest.join(several, "bucket")


class Apart:
    """Pairs of different classes that may still be linked, among the members (bucket, node, root, degree) of ``rest``.

    Only shingles that nodes of other classes in ``rest`` hold too count; a node's support is the
    share of its weight in them. In the order (holders, shingle) a pair that is linked has a first
    common shingle, and neither node has more than 1 - threshold of its weight before it.

    - That shingle has at most HOLDERS holders: the pair is found by a join on it, which makes at
      most HOLDERS rows for each row (``by_shingle``).
    - It has more: so has all that the two have in common. Of two nodes with n and m such shingles,
      the one with more lacks n - m of them in common, each of weight 1 or more, which bounds both
      shares (``by_size``). Nodes that are a leader's text with words replaced fail this bound unless the leader binds them.

    Nothing is lost: the bounds are exact.
    """

    def __init__(self, rest: DataFrame, texts: DataFrame, k: int, threshold: float):
        self.threshold, self.path = threshold, scratch(texts.sparkSession, "near-shingles")
        nodes = stored(rest.select("node", "root").distinct(), f"{self.path}/nodes")
        own = texts.join(nodes, "node", "left_semi").mapInArrow(shingle_rows(k), "node long, shingle long, weight double, total double")
        own = stored(own.join(nodes, "node"), f"{self.path}/own")
        both = own.groupBy("shingle").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("holders")).where("lo < hi")
        self.cross = stored(own.join(both.select("shingle", "holders"), "shingle"), f"{self.path}/cross")
        often = F.col("holders") > HOLDERS
        facts = self.cross.groupBy("node", "total").agg(
            (F.sum("weight") / F.col("total") + 1e-9).alias("support"),
            (F.sum(F.when(often, F.col("weight")).otherwise(0.0)) + 1e-9).alias("often"),
            F.count(F.when(often, 1)).alias("n_often"),
        )
        low = threshold - 1e-9
        rest = rest.join(facts.where(F.col("support") >= low), "node")
        best = rest.groupBy("bucket").agg(F.max("support").alias("best"))
        rest = rest.join(best, "bucket").where(near_enough(F.col("support"), F.col("best"), threshold)).drop("best")
        # a bucket's largest class has cells of its own, so that its many pairs with itself don't count
        mains = rest.groupBy("bucket", "root").agg(F.count("*").alias("n")).groupBy("bucket").agg(F.max_by("root", F.struct("n", "root")).alias("main"), F.count("*").alias("classes")).where("classes > 1")
        sizes = [F.floor(F.log2(F.col(c) + 1) * CELLS).cast("int") for c in ("total", "n_often")]
        rest = rest.join(mains, "bucket").withColumn("cell", F.struct(*sizes, F.col("root") == F.col("main"))).drop("main", "classes")
        self.members = stored(rest, f"{self.path}/members")
        cells = self.members.where(F.col("often") >= low * F.col("total"))
        limits = [F.min("total").alias("total"), F.max("often").alias("often"), F.min("n_often").alias("n_least"), F.max("n_often").alias("n_most")]
        cells = cells.groupBy("bucket", "cell").agg(*limits, F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n"))
        x, y = (cells.select("bucket", *[F.col(c).alias(f"{side}_{c}") for c in cells.columns[1:]]) for side in "xy")
        classes = (F.col("x_lo") < F.col("x_hi")) | (F.col("y_lo") < F.col("y_hi")) | (F.col("x_lo") != F.col("y_lo"))
        pairs = x.join(y, "bucket").where((F.col("x_cell") <= F.col("y_cell")) & classes & self.sized("x_", "y_", "n_least", "n_most"))
        self.cells = stored(pairs.select("bucket", "x_cell", "y_cell", (F.col("x_n") * F.col("y_n")).alias("n")), f"{self.path}/cells")

    def sized(self, x: str, y: str, least: str, most: str) -> Column:
        def share(a: str, b: str) -> Column:
            return (F.col(f"{a}often") - F.greatest(F.lit(0), F.col(f"{a}{least}") - F.col(f"{b}{most}"))) / F.col(f"{a}total")

        return near_enough(share(x, y), share(y, x), self.threshold)

    def work(self) -> tuple[int, int]:
        """Members, and the pairs that ``by_size`` compares at most."""
        return self.members.count(), self.cells.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]

    def by_shingle(self) -> DataFrame:
        nodes = self.members.select("node", "support").distinct()
        before = W.partitionBy("node").orderBy("holders", "shingle").rowsBetween(W.unboundedPreceding, -1)
        gone = 1 - F.col("support") + F.coalesce(F.sum(F.col("weight") / F.col("total")).over(before), F.lit(0.0))
        rows = self.cross.where(F.col("holders") <= HOLDERS).join(nodes, "node").withColumn("left", 1 - gone + 1e-9).where(F.col("left") >= self.threshold)
        rows = stored(rows.select("shingle", "node", "root", "left"), f"{self.path}/first")
        other = rows.select("shingle", F.col("node").alias("y"), F.col("root").alias("other"), F.col("left").alias("right"))
        pairs = rows.join(other, "shingle").where((F.col("root") < F.col("other")) & near_enough(F.col("left"), F.col("right"), self.threshold))
        return pairs.select(F.col("node").alias("x"), "y")

    def by_size(self) -> DataFrame:
        open_cells = self.cells.select("bucket", F.explode(F.array("x_cell", "y_cell")).alias("cell")).distinct()
        rows = self.members.join(open_cells, ["bucket", "cell"], "left_semi")
        rows = stored(rows.select("bucket", "node", "root", "total", "often", "n_often"), f"{self.path}/often")
        x, y = (rows.select("bucket", *[F.col(c).alias(f"{side}_{c}") for c in rows.columns[1:]]) for side in "xy")
        pairs = x.join(y, "bucket").where((F.col("x_root") < F.col("y_root")) & self.sized("x_", "y_", "n_often", "n_often"))
        return pairs.select(F.col("x_node").alias("x"), F.col("y_node").alias("y"))

    def clear(self) -> None:
        remove(self.members.sparkSession, self.path)


def near_links(docs: DataFrame, threshold: float = 0.8, k: int = 5, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(a, b, similarity): links between different texts; ``docs`` has (node, text), node the text's digest.

    The links' components are those of all pairs that share a bucket. In a round each bucket's leader
    (at first the member that meets the most others in all its buckets, so the middle of a group of
    copies, later one of each of up to four classes) is verified against the members of other classes.
    Classes are then the components of all links found, and only pairs of different classes matter,
    be their members bound to others or not: ``Apart`` finds those that may still be linked, and
    they are verified. Before that, more rounds are made while it would compare too many.
    """
    spark = docs.sparkSession
    small_batches(spark)
    path = scratch(spark, "near")
    sketches = docs.mapInArrow(sketch_rows(k, bands, rows), "node long, bands array<long>")
    sketches = stored(sketches.groupBy("node").agg(F.first("bands").alias("bands")), f"{path}/sketches")
    # counts are written before they are joined: then both sides are plain shuffles, whose hot buckets Spark splits
    members = sketches.select("node", F.explode("bands").alias("bucket"))
    several = stored(members.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), f"{path}/several")
    members = stored(members.join(several, "bucket").select("bucket", "node", "n"), f"{path}/members-0")
    degrees = stored(members.groupBy("node").agg(F.sum(F.col("n") - 1).alias("degree")), f"{path}/need")
    need = F.broadcast(degrees.select("node")) if degrees.count() <= BROADCAST_KEYS else degrees.select("node")
    texts = docs.join(need, "node", "left_semi").mapInArrow(packed, "node long, z binary").groupBy("node").agg(F.first("z").alias("z"))
    texts = stored(texts, f"{path}/texts")
    members = members.join(degrees, "node").select("bucket", "node", F.col("node").alias("root"), "degree")
    known = spark.read.schema("a long, b long, similarity double")

    def verify(ask: DataFrame, i: int) -> DataFrame:
        ask = ask.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        ask = ask.join(texts.select(F.col("node").alias("a"), F.col("z").alias("za")), "a").join(texts.select(F.col("node").alias("b"), F.col("z").alias("zb")), "b")
        found = ask.select("a", "b", "za", "zb").mapInArrow(verified_rows(k), "a long, b long, similarity double")
        return stored(found.where(F.col("similarity") >= threshold), f"{path}/links/round={i}")

    apart = None
    for i in range(1, ROUNDS + 1):
        drawn = [F.struct(F.xxhash64("root", F.lit(2 * i + j)).alias("h"), "degree", "node", "root") for j in (0, 1)]
        tops = [F.max(F.struct("degree", "node", "root"))] if i == 1 else [f(x) for x in drawn for f in (F.max, F.min)]
        leaders = members.groupBy("bucket").agg(F.array_distinct(F.array(*[F.struct(t["node"].alias("node"), t["root"].alias("root")) for t in tops])).alias("leaders"))
        leaders = stored(leaders, f"{path}/leaders-{i}")
        pairs = members.join(leaders, "bucket").select("node", "root", F.explode("leaders").alias("leader")).where("root <> leader.root")
        bound = verify(pairs.select(F.col("node").alias("x"), F.col("leader.node").alias("y")), i).limit(1).count()
        edges = known.parquet(f"{path}/links").select("a", "b")
        roots = stored(components(edges), f"{path}/roots-{i}").select("node", F.col("root").alias("class"))
        rest = members.drop("root").join(roots, "node", "left").select("bucket", "node", F.coalesce("class", "node").alias("root"), "degree")
        rest = stored(divided(rest), f"{path}/members-{i}")
        if apart:
            apart.clear()
        apart = Apart(rest, texts, k, threshold)
        members = apart.members.select("bucket", "node", "root", "degree")
        remove(spark, f"{path}/members-{i - 1}", f"{path}/members-{i}", f"{path}/leaders-{i}", f"{path}/roots-{i}")
        release(spark)
        n, pairs_left = apart.work()
        if not bound or pairs_left <= PAIRS_A_MEMBER * n:
            break
    if n:
        verify(apart.by_shingle().unionByName(apart.by_size()), i + 1)
    apart.clear()
    remove(spark, *[f"{path}/{x}" for x in ("sketches", "several", "need", "texts")])
    return known.parquet(f"{path}/links").select("a", "b", "similarity").distinct()


def near_classes(docs: DataFrame, threshold: float = 0.8, k: int = 5, bands: int = BANDS, rows: int = ROWS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, class_id, class_size, n_links, keep, node.

    A class is a component of the links between texts (J_P of word shingles of at least
    ``threshold``); equal texts are one node. class_id is the class's least doc_id (null only where
    all are), class_size its rows, n_links the links of the row's text that were verified, keep
    whether the row stays where one of a class does (the least doc_id, ties by the text's digest;
    equal rows all say so). The digest has 64 bits: among 10**10 texts about three pairs share one.
    Texts without words are alone in their class, unless equal. Null texts
    count as empty. An empty table gives an empty result; other columns are not read.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    rows_ = docs.select(F.col(key).alias("doc_id"), F.xxhash64(body).alias("node"), body.alias("text"))
    links = near_links(rows_.select("node", "text"), threshold, k, bands, rows)
    spark = docs.sparkSession
    path = scratch(spark, "classes")
    edges = stored(links.select("a", "b"), f"{path}/edges")
    roots = components(edges)
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    nodes = rows_.groupBy("node").agg(F.min("doc_id").alias("least"), F.count("*").alias("n"))
    nodes = nodes.join(roots, "node", "left").join(degree, "node", "left").withColumn("root", F.coalesce("root", "node"))
    nodes = stored(nodes.withColumn("n_links", F.coalesce("n_links", F.lit(0)).cast("long")), f"{path}/nodes")
    # (null, value) structs would put null first: the flag puts it last
    best = F.min(F.struct(F.col("least").isNull(), F.col("least"), F.col("node"))).alias("best")
    classes = nodes.groupBy("root").agg(best, F.sum("n").cast("long").alias("class_size"))
    classes = classes.select("root", "class_size", F.col("best.least").alias("class_id"), F.col("best.node").alias("kept"))
    facts = nodes.join(classes, "root").select("node", "class_id", "class_size", "n_links", (F.col("node") == F.col("kept")).alias("own"))
    out = rows_.select("doc_id", "node").join(facts, "node")
    keep = F.col("own") & F.col("doc_id").eqNullSafe(F.col("class_id"))
    return out.select("doc_id", "class_id", "class_size", "n_links", keep.alias("keep"), "node")


def dedup(docs: DataFrame, threshold: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each class of ``near_classes``, all columns as they are.

    Of rows that share key and text, but no other column, the one of the least hash of all columns stays.
    """
    classes = stored(near_classes(docs, threshold, key=key, text=text).select("doc_id", "node", "keep"), scratch(docs.sparkSession, "near-keep"))
    i, n, node = fresh(docs.columns, "i", "n", "node")
    gone = classes.where("NOT keep").select(F.col("doc_id").alias(i), F.col("node").alias(n)).distinct()
    if gone.count() <= BROADCAST_KEYS:
        gone = F.broadcast(gone)
    rows = docs.withColumn(node, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.join(gone, F.col(key).eqNullSafe(F.col(i)) & (F.col(node) == F.col(n)), "left_anti")
    if classes.where("keep").groupBy("doc_id", "node").count().where("count > 1").limit(1).count():
        rows = rows.groupBy(key, node).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(*docs.columns)).alias(n)).select(f"{n}.*")
    return rows.select(*docs.columns)

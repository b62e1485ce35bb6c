"""Substring dedup with a log-structured index of window fingerprints.

A window is ``window`` consecutive words. Storing a fingerprint for each would take more room than
the corpus, so neighbouring windows share one: the least-hashed ``gram``-word run inside a window
(its minimiser) is its anchor, equal windows have equal anchors at equal offsets, and the windows
that share an anchor occurrence are consecutive. An index row is such an occurrence: ``fp`` (the
anchor's hash), ``ctx`` (a hash of the whole span of words that its windows cover) and the first
place where it was seen. Runs are sorted by (fp, ctx) and never changed.

A batch is merged with the runs in the order of (fp, ctx), which puts what they share side by side.
Equal (fp, ctx): every window of the occurrence is a repeat.
Equal fp, other ctx: some windows may repeat; those spans, old and new, are verified window by window on
128-bit digests of their words, made from the texts. An fp seen only once has no repeated window.
So no window is lost, and what is stored or shuffled is about 2 / (window - gram + 2) rows a word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import IntegralType

from .common import release, remove, scratch, small_batches, stored
from .textnum import SPACE, U, Words, mix, packed, pieces, runs, signed, unpacked

ANCHORS = "k long, occ long, fp long, ctx long, lo int, hi int"
#: Documents whose keys (16 bytes each) may be broadcast; beyond, texts are merge-joined.
BROADCAST_KEYS = 200_000
LAST = 2**63 - 1
#: An anchor that stands HOT times in this share of a batch's rows, and is among MOST_HOT that can make up so much, is dealt out to SALTS tasks.
SAMPLE, HOT, MOST_HOT, SALTS = 0.01, 50, 10_000, 64


def sliding_argmin(x: np.ndarray, k: int) -> np.ndarray:
    """The place of the first least value among the k from each place on (to the end of the array)."""
    pad = np.arange(len(x))
    best, size = pad, 1

    def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(x[b] < x[a], b, a)

    while size * 2 <= k:
        best, size = least(best, best[np.minimum(pad + size, len(x) - 1)]), size * 2
    return least(best, best[np.minimum(pad + k - size, len(x) - 1)]) if k > size else best


def firsts(keys: list[np.ndarray], place: list[np.ndarray]) -> np.ndarray:
    """Whether each row is the one with the least place among those with its keys."""
    order = np.lexsort([*place[::-1], *keys[::-1]])
    new = np.ones(len(order), bool)
    if len(order) > 1:
        new[1:] = np.any([k[order][1:] != k[order][:-1] for k in keys], axis=0)
    out = np.empty(len(order), bool)
    out[order] = new
    return out


def merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, touch: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of window starts, those whose words meet joined."""
    order = np.lexsort([lo, doc])
    doc, lo, hi = doc[order], lo[order], hi[order]
    if not len(doc):
        return doc, lo, hi
    wide = int(hi.max()) + touch + 1
    upto = np.maximum.accumulate(hi + doc * wide) - doc * wide  # documents don't reach into each other
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > upto[:-1] + touch)
    at = np.flatnonzero(new)
    return doc[at], lo[at], np.maximum.reduceat(hi, at)


def keys_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """k and occ of the rows, and the rows' rank in that order."""
    k, occ = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
    rank = np.empty(len(k), np.int64)
    rank[np.lexsort([occ, k])] = np.arange(len(k))
    return k, occ, rank


def anchor_rows(window: int, gram: int):
    """(k, occ, text) to ANCHORS; a row without fp is a span that repeats one of the same step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(batches, "text"):
            words = Words(data, offsets, ~SPACE)
            start = np.flatnonzero(words.valid(window))
            if not len(start):
                continue
            h = words.hashes()
            grams, spans = runs(h, gram), runs(h, window)
            at = sliding_argmin(grams, window - gram + 1)[start]
            new = np.ones(len(start), bool)
            new[1:] = (at[1:] != at[:-1]) | (start[1:] != start[:-1] + 1)
            i = np.flatnonzero(new)
            lo, hi, at = start[i], start[np.append(i[1:], len(start)) - 1], at[i]
            fp = mix(grams[at])
            ctx = mix(spans[lo] + spans[hi] * U(3) + (hi - lo).astype(U) * U(0x9E3779B97F4A7C15) + (at - lo).astype(U) * U(0xC2B2AE3D27D4EB4F))
            doc = words.doc[lo]
            lo, hi = lo - words.first[doc], hi - words.first[doc]
            k, occ, rank = keys_of(rows)
            first = firsts([fp, ctx], [rank[doc], lo])
            d, a, b = merged(doc[~first], lo[~first], hi[~first], window)
            doc, lo, hi, none = np.append(doc[first], d), np.append(lo[first], a), np.append(hi[first], b), np.zeros(len(d), U)
            null = np.arange(len(doc)) >= first.sum()
            yield pa.record_batch({
                "k": pa.array(k[doc]), "occ": pa.array(occ[doc]),
                "fp": pa.array(np.append(fp[first], none).view(np.int64), mask=null), "ctx": signed(np.append(ctx[first], none)),
                "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32)),
            })

    return run


def lists(batch: pa.RecordBatch, name: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Row numbers and fields of a column of lists of structs of ints."""
    column = batch.column(batch.schema.get_field_index(name))
    row = pa.compute.list_parent_indices(column).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pa.compute.list_flatten(column)
    return row, [f.to_numpy(zero_copy_only=False).astype(np.int64) for f in flat.flatten()]


def window_rows(window: int):
    """(k, occ, fresh, spans, z) to the windows of the spans: (k, occ, fresh, h1, h2, lo, hi); without h1: repeats one of the same step."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(unpacked(batches), "text"):
            words = Words(data, offsets, ~SPACE)
            one, two = runs(words.hashes(), window), runs(words.hashes(1), window, 1)
            row, (lo, hi) = lists(rows, "spans")
            size = hi - lo + 1
            doc = np.repeat(row, size)
            s = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lo, size)
            at = words.first[doc] + s
            k, occ, rank = keys_of(rows)
            fresh = rows.column(2).to_numpy(zero_copy_only=False).astype(bool)
            first = firsts([one[at], two[at]], [rank[doc], s])
            again = ~first & fresh[doc]
            d, a, b = merged(doc[again], s[again], s[again], window)
            doc, lo, hi, none = np.append(doc[first], d), np.append(s[first], a), np.append(s[first], b), np.zeros(len(d), U)
            null = np.arange(len(doc)) >= first.sum()
            yield pa.record_batch({
                "k": pa.array(k[doc]), "occ": pa.array(occ[doc]), "fresh": pa.array(fresh[doc]),
                "h1": pa.array(np.append(one[at][first], none).view(np.int64), mask=null), "h2": signed(np.append(two[at][first], none)),
                "lo": pa.array(lo.astype(np.int32)), "hi": pa.array(hi.astype(np.int32)),
            })

    return run


def kept_rows(window: int):
    """(k, occ, spans, z, n rows) to (k, occ, n_words, n_removed, kept_sha256)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offsets in pieces(unpacked(batches), "text"):
            words = Words(data, offsets, ~SPACE)
            row, (lo, hi) = lists(rows, "spans")
            cover = np.zeros(len(words) + 1, np.int64)
            np.add.at(cover, words.first[row] + lo, 1)
            np.add.at(cover, words.first[row] + hi + window, -1)
            gone = np.cumsum(cover[:-1]) > 0
            kept = np.flatnonzero(~gone)
            size = words.end[kept] - words.start[kept]
            upto = np.cumsum(size + 1)
            out = np.full(int(upto[-1]) if len(kept) else 0, 0x20, np.uint8)
            begin = upto - size - 1
            rel = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
            out[rel + np.repeat(begin, size)] = data[rel + np.repeat(words.start[kept], size)]
            edge = np.append(0, upto)[np.searchsorted(kept, words.first)]
            sums = [hashlib.sha256(out[a : max(a, b - 1)].tobytes()).hexdigest() for a, b in zip(edge[:-1], edge[1:], strict=True)]
            removed = np.append(0, np.cumsum(gone))
            yield pa.record_batch({
                "k": rows.column(0), "occ": rows.column(1), "n_words": pa.array(words.count.astype(np.int64)),
                "n_removed": pa.array(removed[words.first[1:]] - removed[words.first[:-1]]), "kept_sha256": pa.array(sums, pa.string()),
            })

    return run


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """k, occ, text: k orders the documents; a null key comes last, as LAST, with an occ of 0 or more.

    occ tells rows of one key apart; where keys are unique it is -1, or 0 for a null key.
    """
    if not isinstance(docs.schema[key].dataType, IntegralType):
        raise TypeError(f"{key} must be an integer column, which says which document comes earlier")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(LAST)).alias("k"), F.col(key).isNull().alias("none"), F.col(text).alias("text"))
    several = repeated_keys(rows)
    h = F.xxhash64("text") if several else F.lit(-1)
    occ = F.when(F.col("none"), h.bitwiseAND(F.lit(LAST)) if several else F.lit(0)).otherwise(h.bitwiseOR(F.lit(-LAST - 1)))
    return rows.select("k", occ.cast("long").alias("occ"), "text")


def repeated_keys(rows: DataFrame) -> bool:
    return bool(rows.groupBy("k").count().where("count > 1").limit(1).count())


class WindowIndex:
    """Runs of anchor occurrences under ``path``, in the shared folder.

    ``add`` takes the next batch; its documents must come after those of earlier batches in (k, occ)
    order. ``max_runs`` runs at most are merge-joined: before a batch that would find more, all are
    compacted into one.
    """

    def __init__(self, spark: SparkSession, path: str, window: int = 20, gram: int = 8, max_runs: int = 2):
        if not 0 < gram <= window:
            raise ValueError("gram must be from 1 to window")
        self.spark, self.path, self.window, self.gram, self.max_runs = spark, path, window, gram, max_runs
        self.runs: list[str] = []
        self.batches = 0

    def entries(self) -> DataFrame | None:
        """All rows of all runs; (fp, ctx) is unique."""
        out = None
        for run in self.runs:
            rows = self.spark.read.schema(f"{ANCHORS}, kind string").parquet(run).where("kind IN ('sure', 'unsure')").drop("kind")
            out = rows if out is None else out.unionByName(rows)
        return out

    def compact(self) -> None:
        """Merges the runs into one sorted run and deletes them."""
        if len(self.runs) > 1:
            path, old = f"{self.path}/run-{self.batches}-compacted", self.runs
            self.entries().repartition("fp", "ctx").sortWithinPartitions("fp", "ctx").withColumn("kind", F.lit("sure")).write.partitionBy("kind").parquet(path)
            self.runs = [path]
            remove(self.spark, *old)

    def add(self, batch: DataFrame, so_far: DataFrame) -> DataFrame:
        """(k, occ, lo, hi): windows of ``batch`` (k, occ, text) that start at words lo to hi and start earlier too.

        ``so_far``: all documents up to and including this batch, for the verification.
        """
        spark, window = self.spark, self.window
        if len(self.runs) >= self.max_runs:
            self.compact()
        self.batches += 1
        staged = stored(batch.mapInArrow(anchor_rows(window, self.gram), ANCHORS), f"{self.path}/staged-{self.batches}")
        fresh = staged.where("fp IS NOT NULL").withColumn("fresh", F.lit(True))
        both, old = fresh, self.entries()
        if old is not None:
            both = both.unionByName(old.withColumn("fresh", F.lit(False)))
        # an anchor of many contexts is dealt out by context too, and always verified
        hot = fresh.sample(SAMPLE, 1).groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") >= max(HOT, int(staged.count() * SAMPLE / MOST_HOT))).select("fp", F.lit(True).alias("hot"))
        hot = stored(hot, f"{self.path}/hot-{self.batches}")
        both = both.join(F.broadcast(hot), "fp", "left").withColumn("salt", F.when(F.col("hot"), F.pmod("ctx", F.lit(SALTS))).otherwise(0))
        group = W.partitionBy("fp", "salt")
        in_order = group.orderBy("ctx", "k", "occ", "lo")
        first = ~F.lag("ctx").over(in_order).eqNullSafe(F.col("ctx"))
        mixed = (F.min("ctx").over(group) != F.max("ctx").over(group)) & F.max("fresh").over(group)
        both = both.withColumn("first", first).withColumn("unsure", F.coalesce("hot", F.lit(False)) | mixed)
        kind = F.when(F.col("fresh"), F.when(~F.col("first"), "repeat").when(F.col("unsure"), "unsure").otherwise("sure")).when(F.col("first") & F.col("unsure"), "old")
        run = f"{self.path}/run-{self.batches}"
        both.withColumn("kind", kind).where("kind IS NOT NULL").select("fp", "ctx", "k", "occ", "lo", "hi", "kind").sortWithinPartitions("kind", "fp", "ctx").write.partitionBy("kind").parquet(run)
        judged = spark.read.schema(ANCHORS + ", kind string").parquet(run)
        repeats = judged.where("kind = 'repeat'").select("k", "occ", "lo", "hi")
        spans = judged.where("kind IN ('unsure', 'old')").groupBy("k", "occ", (F.col("kind") == "unsure").alias("fresh")).agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
        spans = stored(spans, f"{self.path}/spans-{self.batches}")
        texts = so_far
        if spans.count() <= BROADCAST_KEYS:
            texts = texts.join(F.broadcast(spans.select("k", "occ")), ["k", "occ"], "left_semi")
        texts = texts.mapInArrow(packed, "k long, occ long, z binary")
        wins = spans.join(texts, ["k", "occ"]).select("k", "occ", "fresh", "spans", "z")
        wins = stored(wins.mapInArrow(window_rows(window), "k long, occ long, fresh boolean, h1 long, h2 long, lo int, hi int"), f"{self.path}/windows-{self.batches}")
        place = W.partitionBy("h1", "h2").orderBy("k", "occ", "lo")
        earlier = wins.where("h1 IS NOT NULL").withColumn("again", F.lag("h1").over(place).isNotNull())
        earlier = earlier.where("fresh AND again").select("k", "occ", "lo", "hi")
        parts = [repeats, staged.where("fp IS NULL").select("k", "occ", "lo", "hi"), wins.where("h1 IS NULL").select("k", "occ", "lo", "hi"), earlier]
        found = parts[0]
        for part in parts[1:]:
            found = found.unionByName(part)
        found = found.groupBy("k", "occ").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))
        found = stored(found, f"{self.path}/found-{self.batches}")
        remove(spark, *[f"{self.path}/{x}-{self.batches}" for x in ("staged", "hot", "spans", "windows")])
        remove(spark, f"{run}/kind=repeat", f"{run}/kind=old")
        self.runs.append(run)
        release(spark)
        return found


def remove_repeats(docs: DataFrame, window: int = 20, gram: int = 8, batches: int = 3, max_runs: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256.

    The documents go into a fresh index in ``batches`` ranges of the key, as a corpus that grows
    would. Words are runs without white space; a word goes if a window over it also starts earlier
    (smaller key, or same document and earlier start), judged on the input. Keys are integers (TypeError otherwise). Null text: no words. Rows that share a key come in
    the order of a hash of their text; equal rows count as one document and each gets its result. A null key comes after all
    others. An empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = keyed(docs, key, text)
    path = scratch(spark, "windows")
    index = WindowIndex(spark, path, window, gram, max_runs)
    cuts = rows.agg(F.percentile_approx("k", [i / batches for i in range(1, batches)], 10_000)).first()[0] if batches > 1 else []
    bounds = sorted({*(cuts or []), LAST})
    once = rows.dropDuplicates(["k", "occ"]) if repeated_keys(rows) else rows
    found, low = [], None
    for high in bounds:
        so_far = once.where(F.col("k") <= high)
        found.append(index.add(so_far if low is None else so_far.where(F.col("k") > low), so_far))
        low = high
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    texts = rows.mapInArrow(packed, "k long, occ long, z binary")
    spans = spans.select(F.col("k").alias("sk"), F.col("occ").alias("so"), "spans")
    none = F.array().cast("array<struct<lo:int,hi:int>>")
    cut = texts.join(spans, (F.col("k") == F.col("sk")) & (F.col("occ") == F.col("so")), "left").select("k", "occ", F.coalesce("spans", none).alias("spans"), "z")
    out = cut.mapInArrow(kept_rows(window), "k long, occ long, n_words long, n_removed long, kept_sha256 string")
    return out.select(F.when((F.col("k") != LAST) | (F.col("occ") < 0), F.col("k")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")

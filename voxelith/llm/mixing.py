"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window as W, functions as F

from .common import WORD, cell, fresh, ranked, scratch, stored

#: 1 / golden ratio: the points frac(n * GOLDEN) fill [0, 1) evenly at every length.
GOLDEN = 0.6180339887498949
#: Words of a block at most, and slots that a schedule has at least (where there are as many words).
BLOCK_WORDS, LEAST_SLOTS = 2048, 100_000
#: Rows that one task sorts at a time, on average.
ROWS_A_RANGE, SLOTS_A_RANGE = 5_000, 65_536
#: Cells of [0, 1) in which a point is looked up.
CELLS = 4096


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, cap: float) -> DataFrame:
    """sid, source, source_size and target of each source, from (source, source_size).

    Sources by code point, null last, get the weights in turn; they share ``share`` times all sizes,
    no source more than ``cap`` times its own. With sources by rising cap / weight, the capped ones
    are a prefix, and the level of the others is the largest (rest of the total) / (rest of the
    weights) over all prefixes. The table has one row a source.
    """
    in_order = W.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("sid", F.row_number().over(in_order) - 1)
    rows = rows.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("sid") % len(weights) + 1).cast("int")))
    rows = rows.withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_cap = W.orderBy(F.col("most") / F.col("weight"), "sid")
    before = F.coalesce(F.sum("most").over(by_cap.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))
    rest = F.sum("weight").over(by_cap.rowsBetween(0, W.unboundedFollowing))
    total = F.sum("source_size").over(W.partitionBy()) * F.lit(float(share))
    rows = rows.withColumn("level", (total - before) / rest)
    level = F.greatest(F.max("level").over(W.partitionBy()), F.lit(0.0))
    return rows.select("sid", "source", "source_size", F.least(F.col("most"), level * F.col("weight")).alias("target"))


def schedule(targets: DataFrame, slots: int) -> DataFrame:
    """sid, rank and slot: slot n belongs to the source whose part of [0, 1) holds frac((n + 1) * GOLDEN)."""
    spark = targets.sparkSession
    upto = F.sum("target").over(W.orderBy("sid").rowsBetween(W.unboundedPreceding, 0))
    bounds = targets.where("target > 0").withColumn("hi", upto).withColumn("lo", F.col("hi") - F.col("target"))
    everything = F.max("hi").over(W.partitionBy())
    bounds = bounds.select("sid", (F.col("lo") / everything).alias("lo"), F.when(F.col("hi") == everything, 1.0).otherwise(F.col("hi") / everything).alias("hi"))
    cells = bounds.select("sid", "lo", "hi", F.explode(F.sequence(F.floor(F.col("lo") * CELLS), F.least(F.floor(F.col("hi") * CELLS), F.lit(CELLS - 1)))).alias("cell"))
    point = (F.col("id") + 1) * F.lit(GOLDEN)
    points = spark.range(slots).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("u"), F.floor(F.col("id") / SLOTS_A_RANGE).alias("part"))
    found = points.withColumn("cell", F.floor(F.col("u") * CELLS)).join(cells, "cell").where("u >= lo AND u < hi").select("sid", "slot", "part")
    return ranked(found, ["sid"], "part", [F.col("slot")], "rank")


def mix_sources(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, taken, and text_hash and first_slot.

    size: words of the text (null: 0). Each source's documents, shuffled by a hash, form a stream
    that is read from its start, and after its end again, until floor(target) words are taken.
    taken: the words taken of a document, repeats counted, so at most ``cap`` times its size up to
    the document where the reading ends. The stream is cut into blocks of equal words, and the k-th slot of a source holds block k;
    first_slot: the slot of a document's first block (null: not taken). A source that has fewer
    slots than blocks has the rest at even places. A null source is a source; empty texts are never
    taken; equal rows stay separate rows; an empty table gives an empty result; other columns are
    not read.
    """
    spark = docs.sparkSession
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.regexp_count(body, F.lit(WORD)).cast("long").alias("size"), F.xxhash64(body).alias("text_hash"))
    rows = stored(rows.withColumn("h", F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_hash")), scratch(spark, "mix-rows"))
    n, total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    block = min(BLOCK_WORDS, max(1, int(total * share) // LEAST_SLOTS))
    targets = stored(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap), scratch(spark, "mix-targets"))
    slots = -(-int(total * share) // block)
    points = schedule(targets, slots).join(targets.select("sid", F.ceil(F.col("source_size") / block).alias("blocks")), "sid").where("rank < blocks").select("sid", F.col("rank").alias("block"), "slot")

    known = targets.select(F.col("source").alias("__source"), "sid", "source_size", "target")
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("__source"))).drop("__source", "source").withColumn("part", cell(F.col("h"), n // ROWS_A_RANGE + 1))
    order = [F.col(c).asc_nulls_first() for c in ("h", "doc_id", "size")]
    rows = ranked(rows, ["sid"], "part", order, "start", F.col("size")).drop("h", "part")
    words, all_words = F.floor(F.col("target") + 1e-6), F.greatest(F.col("source_size"), F.lit(1))
    passes, rest = F.floor(words / all_words), words % all_words
    last = F.greatest(F.least(F.col("start") + F.col("size"), rest) - F.col("start"), F.lit(0))
    rows = rows.withColumn("taken", (passes * F.col("size") + last).cast("long")).withColumn("block", F.floor(F.col("start") / block))
    needed = passes * F.ceil(all_words / block) + F.ceil(rest / block)
    even = F.floor((F.col("block") + 0.5) * slots / needed)
    slot = F.when(F.col("taken") > 0, F.coalesce("slot", even)).cast("long")
    return rows.join(points, ["sid", "block"], "left").select("doc_id", "size", "source_size", "target", "taken", "text_hash", slot.alias("first_slot"))


def mixed(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, cap: float = 2.0, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix as rows of ``docs``, all columns as they are: a document stands as often as its words taken make whole copies, rounded.

    Only the document at which the reading of a source ends is taken in part.
    """
    plan = mix_sources(docs, weights, share, cap, key, text, source).where("taken > 0")
    i, h, n, own, copy = fresh(docs.columns, "i", "h", "copies", "hash", "copy")
    copies = F.round(F.sum("taken") / F.sum("size")).cast("int")
    plan = plan.groupBy(F.col("doc_id").alias(i), F.col("text_hash").alias(h)).agg(copies.alias(n)).where(F.col(n) > 0)
    plan = stored(plan, scratch(docs.sparkSession, "mix-copies"))
    rows = docs.withColumn(own, F.xxhash64(F.coalesce(F.col(text), F.lit(""))))
    rows = rows.join(plan, F.col(key).eqNullSafe(F.col(i)) & (F.col(own) == F.col(h)))
    return rows.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)

"""Sharding by weighted rendezvous hashing. DataFrame functions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from .common import fresh, ranked

#: Rows of a shard that one task ranks, on average.
ROWS_A_RANGE = 5_000


def digits(digest: Column, n: int, first: int = 1) -> Column:
    """n hexadecimal digits of a digest as a number."""
    return F.conv(F.substring(digest, first, n), 16, 10).cast("long")


def even(*weights: Sequence[float]) -> bool:
    """Whether all shards that have a weight have the same."""
    return len({float(w) for own in weights for w in own if w > 0}) < 2


def scores(key: Column, weights: Sequence[float], plain: bool, first: int = 0, salt: str = "shard") -> list[Column]:
    """(score, shard) of each shard from ``first`` on that has a weight: ln(u) / weight, u from a half of an MD5 of key and pair of shards.

    ``plain``: weights are equal, so u's digits are compared as they are, which gives the same shard.
    """
    out = []
    for s, w in enumerate(weights):
        if s >= first and w > 0:
            digest, at = F.md5(F.concat(key, F.lit(f"|{salt}:{s // 2}"))), 1 + 16 * (s % 2)
            u = (digits(digest, 13, at) + F.lit(0.5)) / F.lit(2.0**52)
            score = F.substring(digest, at, 13) if plain else F.log(u) / F.lit(float(w))
            out.append(F.struct(score.alias("score"), F.lit(s).alias("shard")))
    return out


def best_of(candidates: list[Column]) -> Column:
    """The shard of the highest score, with that score.

    A score depends on nothing but the key and the shard, so one more shard takes rows only into
    itself, and a shard of twice the weight gets twice the rows (highest random weight).
    """
    if not candidates:
        raise ValueError("no shard has a weight above 0")
    return F.array_max(F.array(*candidates)) if len(candidates) > 1 else candidates[0]


def shard_of(key: Column, weights: Sequence[float]) -> Column:
    return best_of(scores(key, weights, even(weights)))["shard"]


def assign_shards(docs: DataFrame, weights: Sequence[float], grown: Sequence[float] | None = None, key: str = "doc_id", text: str = "text", carry: Sequence[str] = ()) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot and grown_shard, and the columns of ``carry``.

    size: UTF-8 bytes of the text (null: none) plus 8. shard: by the key and the weights alone (a
    null key is a key of its own; equal keys share a shard). slot: 0, 1, ... without a gap in each
    shard, in an order of a hash of key and text, so rows of one key are ranked by several tasks;
    rows equal in both are interchangeable unless ``carry`` tells them apart. grown_shard: the shard under ``grown`` (one weight more
    by default). An empty table gives an empty result; other columns are not read.
    """
    grown = [*weights, weights[-1]] if grown is None else grown
    plain = even(weights, grown)
    name = F.coalesce(F.concat(F.lit("k"), F.col(key).cast("string")), F.lit("null"))
    ranges = max(1, docs.count() // len(weights) // ROWS_A_RANGE + 1)
    h, part, best, named = fresh(carry, "h", "part", "best", "named")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary")).cast("long").alias("text_crc32"),
        F.lit("key").alias("law"),
        name.alias(named),
        best_of(scores(name, weights, plain)).alias(best),
        digits(F.md5(F.concat(name, F.lit("\n"), F.coalesce(F.col(text), F.lit("")))), 15).alias(h),
        *carry,
    )
    # a grown list of shards that keeps the old ones only has the new ones' scores to make
    more = [F.col(best), *scores(F.col(named), grown, plain, len(weights))] if list(grown[: len(weights)]) == list(weights) else scores(F.col(named), grown, plain)
    rows = rows.withColumns({"shard": F.col(best)["shard"], "grown_shard": best_of(more)["shard"]}).drop(best, named)
    rows = rows.withColumn(part, F.floor(F.col(h) / F.lit(2.0**60) * ranges).cast("long"))
    order = [F.col(c).asc_nulls_first() for c in (h, "doc_id", "text_crc32", "size")]
    return ranked(rows, ["shard"], part, order, "slot").select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", *carry)

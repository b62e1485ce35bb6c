"""Token counts behind a digest cache.

The cache is a Parquet table of (digest, tokenizer, n_tokens): the SHA-256 of a text's UTF-8 bytes
(a null text is empty; nothing else is normalised, since every byte may count), the digest of the
tokenizer's file, and the count. A run joins its digests to the cache, encodes one text for each
digest that is missing, appends those counts and joins again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import remove, scratch, small_batches, stored
from .textnum import packed, unpacked

#: Row keys (digest and document, about 64 bytes each) that may be broadcast to pick the texts to encode.
BROADCAST_KEYS = 200_000
#: Characters that are encoded at a time.
STEP_CHARS = 200_000
CACHE = "digest binary, tokenizer string, n_tokens long"


def encoder(name: str, content: bytes):
    """A function from texts to counts, from the file's content: workers need no file."""
    import os

    if name.endswith(".json"):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        own = Tokenizer.from_buffer(content)
        own.no_truncation()
        own.no_padding()
        return lambda texts: [len(e) for e in own.encode_batch_fast(texts, add_special_tokens=False)]
    if name.endswith(".model"):
        import sentencepiece

        pieces = sentencepiece.SentencePieceProcessor(model_proto=content)
        return lambda texts: [len(e) for e in pieces.encode(texts, num_threads=1)]
    raise ValueError(f"no library for {name}: .json or .model")


def encoded(name: str, content):
    """(digest, text) to (digest, n_tokens); ``content`` is a broadcast."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder(name, content.value)
        for batch in batches:
            texts, out, at = batch.column(batch.schema.get_field_index("text")).to_pylist(), [], 0
            while at < len(texts):
                upto, size = at, 0
                while upto < len(texts) and (upto == at or size + len(texts[upto]) <= STEP_CHARS):
                    size += len(texts[upto])
                    upto += 1
                out += count(texts[at:upto])
                at = upto
            yield pa.record_batch({"digest": batch.column(0), "n_tokens": pa.array(out, pa.int64())})

    return run


def cached(spark, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) of one tokenizer version; a count that two runs stored comes once."""
    rows = spark.read.schema(CACHE).parquet(cache).where(F.col("tokenizer") == version)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(docs: DataFrame, tokenizer: str, cache: str | None = None, limit: int = 1024, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit.

    ``tokenizer``: a file of the tokenizers library (.json) or of sentencepiece (.model), read on
    the driver. Counts are without begin, end or added special tokens; special strings in a text are
    handled as the library does by default. ``cache``: a folder that all executors share; a new one
    by default. Equal texts are encoded and stored once; empty texts have the
    library's count (0); an empty table gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark, 500)
    with open(tokenizer, "rb") as f:
        content = f.read()
    version = hashlib.sha256(content).hexdigest()
    cache = cache or scratch(spark, "token-cache")
    spark.createDataFrame([], CACHE).write.mode("append").parquet(cache)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("doc_id"), F.unhex(F.sha2(body.cast("binary"), 256)).alias("digest"), body.alias("text"))
    keys = stored(rows.select("doc_id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), scratch(spark, "token-keys"))

    # one document of each missing digest is encoded: the one of the least key
    misses = keys.groupBy("digest").agg(F.min(F.struct(F.col("doc_id").isNull(), F.col("doc_id"))).alias("least")).join(cached(spark, cache, version), "digest", "left_anti")
    path = scratch(spark, "token-misses")
    misses = stored(misses.select("digest", F.col("least.doc_id").alias("doc_id")), path)
    n, total = misses.count(), keys.count()

    def same(left: DataFrame, right: DataFrame):
        return (left["digest"] == right["digest"]) & left["doc_id"].eqNullSafe(right["doc_id"])

    if n <= BROADCAST_KEYS:
        todo = rows.join(F.broadcast(misses), same(rows, misses), "left_semi").select("digest", "text")
    elif total - n <= BROADCAST_KEYS:
        rest = stored(keys.join(misses, same(keys, misses), "left_anti").select("digest", "doc_id").distinct(), scratch(spark, "token-rest"))
        todo = rows.join(F.broadcast(rest), same(rows, rest), "left_anti").select("digest", "text")
    else:
        z = rows.select("digest", "doc_id", "text").mapInArrow(packed, f"digest binary, doc_id {rows.schema[0].dataType.simpleString()}, z binary")
        todo = z.join(misses, same(z, misses), "left_semi").select("digest", "z")
        todo = todo.mapInArrow(unpacked, "digest binary, z binary, text string").select("digest", "text")
    if keys.groupBy("digest", "doc_id").count().where("count > 1").limit(1).count():
        todo = todo.dropDuplicates(["digest"])
    fresh = todo.mapInArrow(encoded(tokenizer, spark.sparkContext.broadcast(content)), "digest binary, n_tokens long")
    fresh.dropDuplicates(["digest"]).select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    remove(spark, path)
    # written first, so that both sides are plain shuffles and Spark can split a digest that many rows share
    counts = stored(cached(spark, cache, version), scratch(spark, "token-counts"))
    out = keys.join(counts, "digest")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))

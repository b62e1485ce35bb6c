"""Language ID by nearest centroids of TF-IDF n-gram vectors.

A text's vector holds its byte trigrams, A-Z in lower case and everything but letters, digits and
longer characters as a space, hashed to DIMENSIONS, weighted by log term frequency and inverse
document frequency, with unit length. Each language has several centroids, found by spherical
k-means on a bounded sample; a text gets the language of the nearest, by cosine, and is rejected
where even that is far for a text of its size.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import small_batches
from .textnum import ALNUM, LOWER, pieces

DIMENSIONS = 4096
#: Texts a language in the sample, about, and all texts of the sample at most, about.
SAMPLE_A_LANGUAGE, SAMPLE = 200, 4000
#: A text of n trigrams is rejected if its cosine is under REJECT_SHARE * n / (n + EVIDENCE) of the median in the sample
#: for texts of its size: the shorter the text, the less a low cosine says.
REJECT_SHARE, EVIDENCE = 0.5, 24
#: By byte: what a trigram sees. Digits, too, are no part of a language.
SEEN = np.where(ALNUM & ~np.isin(np.arange(256), np.arange(0x30, 0x3A)), LOWER, 0x20).astype(np.uint32)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    centroids: np.ndarray
    owner: np.ndarray
    floors: np.ndarray


def trigram_counts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Texts x DIMENSIONS counts. A text counts with a space before and after."""
    n = len(offsets) - 1
    seen = SEEN[data]
    padded = np.full(len(data) + 2 * n, 0x20, np.uint32)
    doc = np.repeat(np.arange(n), np.diff(offsets))
    padded[np.arange(len(data)) + 2 * doc + 1] = seen
    owner = np.repeat(np.arange(n), np.diff(offsets) + 2)
    if len(padded) < 3:
        return np.zeros((n, DIMENSIONS), np.float32)
    a, b, c = padded[:-2], padded[1:-1], padded[2:]
    good = (owner[:-2] == owner[2:]) & ((b != 0x20) | (a != 0x20) & (c != 0x20))
    gram = (a << np.uint32(16) | b << np.uint32(8) | c) * np.uint32(0x9E3779B1) >> np.uint32(20)
    key = owner[:-2][good] * DIMENSIONS + gram[good].astype(np.int64)
    return np.bincount(key, minlength=n * DIMENSIONS).reshape(n, DIMENSIONS).astype(np.float32)


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def size_class(counts: np.ndarray) -> np.ndarray:
    """0 to 15 by the number of trigrams, doubling."""
    return np.minimum(np.log2(np.maximum(counts.sum(axis=1), 1)).astype(int), 15)


def spherical_kmeans(x: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """Unit centroids; each start is the vector farthest from the centroids so far."""
    mean = x.mean(axis=0)
    starts = [int(np.argmax(x @ mean))]
    while len(starts) < min(k, len(x)):
        starts.append(int(np.argmin((x @ x[starts].T).max(axis=1))))
    c = x[starts]
    for _ in range(rounds):
        nearest = np.argmax(x @ c.T, axis=1)
        sums = np.stack([x[nearest == i].sum(axis=0) if (nearest == i).any() else c[i] for i in range(len(c))])
        new = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
        if np.allclose(new, c):
            break
        c = new
    return c


def fit(rows: DataFrame, clusters: int = 4) -> Model | None:
    """A model from (text, lang, tie), on a bounded sample: about SAMPLE_A_LANGUAGE texts of each language by a hash of
    ``tie``, and about SAMPLE in all. None if there is no text with a language."""
    rows = rows.where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return None
    each = min(SAMPLE_A_LANGUAGE, SAMPLE / len(sizes))
    share = F.create_map(*[x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(each / n))])
    drawn = rows.where((F.pmod(F.xxhash64("tie"), F.lit(1_000_003)) / 1_000_003) < share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches, "text", rows=200):
            found = trigram_counts(data, offsets)
            yield pa.record_batch({"lang": part.column(0), "counts": pa.array([x.tobytes() for x in found], pa.binary())})

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted((lang, x) for b in batches for lang, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        model = modelled(sample, clusters) if sample else None
        if model:
            yield pa.record_batch({"model": pa.array([pickle.dumps(model)], pa.binary())})

    # the bounded sample meets in one task, which sends back the model
    found = drawn.mapInArrow(count, "lang string, counts binary").repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0]["model"]) if found else None


def modelled(sample: list[tuple[str, bytes]], clusters: int) -> Model | None:
    """The model of (language, trigram counts)."""
    langs = np.array([lang for lang, _ in sample])
    counts = np.stack([np.frombuffer(x, np.float32) for _, x in sample])
    idf = np.log((1 + len(counts)) / (1 + (counts > 0).sum(axis=0))).astype(np.float32) + 1
    x = vectors(counts, idf)
    known = counts.sum(axis=1) > 0
    languages, found, owner = sorted(set(langs[known])), [], []
    for i, lang in enumerate(languages):
        own = spherical_kmeans(x[known & (langs == lang)], clusters)
        found.append(own)
        owner += [i] * len(own)
    if not languages:
        return None
    centroids = np.concatenate(found).astype(np.float32)
    best = (x[known] @ centroids.T).max(axis=1)
    floors, sizes = np.zeros(16), size_class(counts[known])
    for s in range(16):
        apart = np.abs(sizes - s)
        floors[s] = REJECT_SHARE * np.median(best[apart <= max(1, apart.min())])
    return Model([str(x) for x in languages], idf, centroids, np.array(owner), floors)


def judged(model: Model | None, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Language, score and whether the text is rejected."""
    ascii_letters = np.append(0, np.cumsum(((data | 32) >= 0x61) & ((data | 32) <= 0x7A)))
    letters = ascii_letters[offsets[1:]] > ascii_letters[offsets[:-1]]
    for i in np.flatnonzero(~letters & (np.diff(offsets) > 0)):
        letters[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "ignore"))
    if model is None:
        return np.full(len(letters), "und", object), np.zeros(len(letters)), ~letters
    counts = trigram_counts(data, offsets)
    near = vectors(counts, model.idf) @ model.centroids.T
    score = np.where(letters, np.clip(near.max(axis=1), 0, 1), 0).astype(np.float64)
    lang = np.where(letters, np.array(model.languages, object)[model.owner[near.argmax(axis=1)]], "und")
    n = counts.sum(axis=1)
    far = score < model.floors[size_class(counts)] * n / (n + EVIDENCE)
    return lang, score, ~letters | far


def predicted(model: Model | None):
    """(..., text) to (..., lang_pred, score, rejected)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches, "text", rows=200):
            lang, score, rejected = judged(model, data, offsets)
            yield pa.record_batch([*part.columns[:-1], pa.array(list(lang), pa.string()), pa.array(score), pa.array(rejected)], names=[*part.schema.names[:-1], "lang_pred", "score", "rejected"])

    return run


def learned(docs: DataFrame, clusters: int, key: str, text: str, lang: str) -> Model | None:
    rows = docs.where(fold(key) != 2)
    return fit(rows.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.struct(F.col(key), F.length(text)).alias("tie")), clusters)


def fold(key: str) -> Column:
    """crc32 of the key as text, modulo 4; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 4


def accepted(docs: DataFrame, clusters: int = 4, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` that ``identify`` doesn't reject, all columns as they are."""
    small_batches(docs.sparkSession)
    model = learned(docs, clusters, key, text, lang)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches, text, rows=200):
            yield part.filter(pa.array(~judged(model, data, offsets)[2]))

    return docs.mapInArrow(run, docs.schema)


def identify(docs: DataFrame, clusters: int = 4, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score, rejected.

    Learns from texts whose crc32(doc_id as text) mod 4 is not 2 and whose language is known (a null
    key counts as the empty text). lang_pred is ``und``, score 0 and rejected true for a text that
    is null or has no letter; other rejected texts keep their nearest language. Without any known
    language all are ``und`` and only texts without a letter are rejected. Ties go to the first language by code point. Repeated rows get equal
    results; an empty table gives an empty result; other columns are not read.
    """
    small_batches(docs.sparkSession)
    model = learned(docs, clusters, key, text, lang)
    rows = docs.select(F.col(key).alias("doc_id"), (fold(key) == 2).alias("held_out"), F.col(text).alias("text"))
    kind = rows.select("doc_id").schema[0].dataType.simpleString()
    return rows.mapInArrow(predicted(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double, rejected boolean")

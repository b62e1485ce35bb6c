"""Benchmark decontamination: size-partitioned MinHash containment search.

Containment is the share of a test item's distinct word shingles that a document holds. Items are
partitioned by their number of shingles, doubling, and an item's sketch is its s least-hashed
shingles, a bottom-s MinHash. A document that holds at least a share t of n shingles lacks at most
(1 - t) n of them, so with s over (1 - t) n for the partition's largest n it holds one of the
sketch: the search loses nothing, however long the document is. Candidates are verified on the
words themselves.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import small_batches
from .textnum import ALNUM, LOWER, U, Words, mix, pieces, runs

#: Items, and bytes of their texts, that are searched in one pass over the documents, about; more take more passes.
ITEMS_A_PASS, BYTES_A_PASS = 20_000, 20_000_000
FILTER_BITS = 20


def tokens(data: np.ndarray, words: Words, lo: int, hi: int) -> list[bytes]:
    return [data[a:b].tobytes() for a, b in zip(words.start[lo:hi], words.end[lo:hi], strict=True)]


def grams(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    return set(zip(*[words[i:] for i in range(k)], strict=False))


@dataclass
class Index:
    """Sketches of one block of items, sorted by hash, by shingle length (k; less for items of fewer words)."""

    threshold: float
    items: list[tuple[list, set, int]] = field(default_factory=list)
    sketches: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=dict)


def sketch_size(n: int, threshold: float) -> int:
    """For items of n shingles: enough for the largest n of the size partition."""
    largest = 2 ** n.bit_length() - 1
    return min(n, int(np.floor((1 - threshold) * largest + 1e-9)) + 1)


def build(rows: list, k: int, threshold: float) -> Index:
    """From (item id, text); items of equal words are searched once; items without words never match."""
    index = Index(threshold)
    by_words: dict[tuple, list] = defaultdict(list)
    hashes: dict[tuple, np.ndarray] = {}
    batch = pa.record_batch({"id": pa.array(range(len(rows))), "text": pa.array([r[1] for r in rows], pa.string())})
    for part, raw, offsets in pieces(iter([batch]), "text"):
        data = LOWER[raw]
        words = Words(data, offsets, ALNUM)
        h = words.hashes()
        for i, own in enumerate(part.column(0).to_pylist()):
            lo, hi = words.first[i], words.first[i + 1]
            if hi > lo:
                seq = tuple(tokens(data, words, lo, hi))
                by_words[seq].append(rows[own][0])
                hashes[seq] = h[lo:hi]
    postings: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for seq in sorted(by_words):
        size = min(k, len(seq))
        own = np.unique(runs(hashes[seq], size)[: len(seq) - size + 1])
        for x in own[np.argsort(mix(own + U(1)))][: sketch_size(len(own), threshold)]:
            postings[size].append((int(x), len(index.items)))
        index.items.append((by_words[seq], grams(list(seq), size), size))
    for size, found in postings.items():
        found.sort()
        all_hashes = np.array([x for x, _ in found], U)
        keys, first = np.unique(all_hashes, return_index=True)
        bits = np.zeros(1 << FILTER_BITS, bool)
        bits[(keys >> U(64 - FILTER_BITS)).astype(np.int64)] = True
        index.sketches[size] = (keys, np.append(first, len(found)), np.array([i for _, i in found]), bits)
    return index


def held_items(index: Index, data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """Text, item of the index, and how many of its shingles the text holds, where they are enough; ``data`` is lower-cased."""
    words = Words(data, offsets, ALNUM)
    h = words.hashes()
    pairs = set()
    for size, (keys, first, owner, bits) in index.sketches.items():
        at = np.flatnonzero(words.valid(size))
        r = runs(h, size)[at]
        maybe = np.flatnonzero(bits[(r >> U(64 - FILTER_BITS)).astype(np.int64)])
        spot = np.minimum(np.searchsorted(keys, r[maybe]), len(keys) - 1)
        hit = keys[spot] == r[maybe]
        for doc, s in np.unique(np.stack([words.doc[at[maybe[hit]]], spot[hit]]), axis=1).T.tolist():
            pairs.update((doc, int(i)) for i in owner[first[s] : first[s + 1]])
    held: dict[int, set] = {}
    own: list[bytes] = []
    last = -1
    for doc, i in sorted(pairs):
        if doc != last:
            own, held, last = tokens(data, words, words.first[doc], words.first[doc + 1]), {}, doc
        _, wanted, size = index.items[i]
        if size not in held:
            held[size] = grams(own, size)
        common = len(wanted & held[size])
        if common >= index.threshold * len(wanted) - 1e-9:
            yield doc, i, common


def search(index: Index, key_type: pa.DataType, item_type: pa.DataType):
    """(doc_id, text) to (doc_id, item_id, n_shingles, n_common, containment)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, data, offsets in pieces(batches, "text"):
            out = [(doc, item, len(index.items[i][1]), common) for doc, i, common in held_items(index, LOWER[data], offsets) for item in index.items[i][0]]
            doc, item, n, common = zip(*out, strict=True) if out else ((), (), (), ())
            yield pa.record_batch({
                "doc_id": part.column(0).take(pa.array(doc, pa.int64())).cast(key_type), "item_id": pa.array(item, item_type), "n_shingles": pa.array(n, pa.int64()),
                "n_common": pa.array(common, pa.int64()), "containment": pa.array([c / m for c, m in zip(common, n, strict=True)], pa.float64()),
            })

    return run


def indexes(items: DataFrame, threshold: float, k: int) -> Iterator[Index]:
    """An index for each block of (item_id, text); items of equal text are dealt out by their id."""
    items = items.where("text IS NOT NULL")
    n, size = items.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    blocks = max(-(-n // ITEMS_A_PASS), -(-size // BYTES_A_PASS)) if n else 0
    for block in range(blocks):
        own = items.where(F.pmod(F.xxhash64("text", F.col("item_id").cast("string")), F.lit(blocks)) == block) if blocks > 1 else items
        yield build([tuple(r) for r in own.collect()], k, threshold)


def leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = 5, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_shingles, n_common, containment) of every document that holds at least ``threshold`` of an item's shingles.

    Words are runs of letters, digits and characters beyond ASCII, A-Z in lower case. A shingle is
    k words, for an item of fewer words all of them. Null texts and items without words never
    match. Items go out in blocks of about ITEMS_A_PASS or BYTES_A_PASS, a pass over the documents each, so
    an index stays small at any number of items. Keys may have any type that Arrow has. Equal rows match equally, one result row each; an
    empty table on either side gives an empty result; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    items = items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text"))
    key_type, item_type = (d.schema[0].dataType.simpleString() for d in (rows, items))
    schema = f"doc_id {key_type}, item_id {item_type}, n_shingles long, n_common long, containment double"
    arrow = [to_arrow_type(d.schema[0].dataType) for d in (rows, items)]
    out = None
    for index in indexes(items, threshold, k):
        found = rows.mapInArrow(search(index, *arrow), schema)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], schema) if out is None else out


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = 0.8, k: int = 5, text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item as ``leaks`` finds them, all columns as they are."""
    small_batches(docs.sparkSession)

    def clean(index: Index):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, data, offsets in pieces(batches, text):
                keep = np.ones(part.num_rows, bool)
                keep[[doc for doc, _, _ in held_items(index, LOWER[data], offsets)]] = False
                yield part.filter(pa.array(keep))

        return run

    for index in indexes(items.select(F.col(item_key).alias("item_id"), F.col(item_text).alias("text")), threshold, k):
        docs = docs.mapInArrow(clean(index), docs.schema)
    return docs

"""Vectorised text kernels: words, hashes and shingles of many texts at once, on UTF-8 bytes.

Texts come as Arrow arrays. Everything is 64-bit arithmetic modulo 2**64 on whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

np.seterr(over="ignore")

#: UTF-8 bytes and texts that one step handles at a time, unless one text alone is longer.
STEP_BYTES, STEP_ROWS = 1_000_000, 1_000
U = np.uint64
BASE, CHAIN, LENGTH = U(0x9E3779B97F4A7C55), U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)

#: By byte: white space of the corpus contracts (space, tab to carriage return).
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: By byte: letters, digits and all of UTF-8's longer characters.
ALNUM = np.array([b >= 0x80 or chr(b).isalnum() for b in range(256)])
#: By byte: A-Z in lower case.
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64 bits (splitmix64's finaliser)."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def pieces(batches: Iterator[pa.RecordBatch], text: str, step: int = STEP_BYTES, rows: int = STEP_ROWS) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Slices of the batches with their texts' bytes and offsets; a null text is empty."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if column.null_count:
            column = column.fill_null("")
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        _, where, data = column.buffers()
        offsets = np.frombuffer(where, np.int64 if wide else np.int32, len(column) + 1, column.offset * (8 if wide else 4)).astype(np.int64) if len(column) else np.zeros(1, np.int64)
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(column):
            hi = min(lo + rows, max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + step, "right")) - 1))
            yield batch.slice(lo, hi - lo), data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
            lo = hi


class Words:
    """The words of a run of texts.

    start, end: byte positions of each word; doc: its text; first: the first word of each text, and
    one more entry for the end.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        inside = is_word[data]
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        before = np.empty_like(inside)
        before[:1] = False
        before[1:] = inside[:-1]
        after = np.empty_like(inside)
        after[-1:] = False
        after[:-1] = inside[1:]
        self.data, self.n_docs = data, len(offsets) - 1
        self.start = np.flatnonzero(inside & (~before | edge[:-1]))
        self.end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        self.first = np.searchsorted(self.start, offsets)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(self.n_docs), self.count)

    def __len__(self) -> int:
        return len(self.start)

    def hashes(self, seed: int = 0) -> np.ndarray:
        """A mixed polynomial hash of each word's bytes."""
        size = self.end - self.start
        if not len(size):
            return np.zeros(0, U)
        begin = np.cumsum(size) - size
        rel = np.arange(int(size.sum())) - np.repeat(begin, size)
        powers = np.ones(int(size.max()), U)
        powers[1:] = BASE + U(2 * seed)
        powers = np.cumprod(powers)
        values = (self.data[rel + np.repeat(self.start, size)].astype(U) + U(1)) * powers[rel]
        return mix(np.add.reduceat(values, begin) + size.astype(U) * LENGTH + U(seed))

    def valid(self, k: int) -> np.ndarray:
        """Whether a run of k words of one text starts at each word."""
        return np.arange(len(self)) + k <= self.first[1:][self.doc]


def runs(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hashes of the k words from each word on; those that leave the array are 0."""
    out, size, done, power = np.zeros(len(h), U), 1, 0, U(1)
    block, step = h.copy(), CHAIN + U(2 * seed)
    rest = k
    while rest:
        if rest & 1:
            if len(h) > done:
                out[: len(h) - done] += power * block[done:]
            done += size
            power = power * step
        rest >>= 1
        if rest:
            longer = block.copy()
            if len(h) > size:
                longer[:-size] += step * block[size:]
            block, step, size = longer, step * step, size * 2
    out[max(0, len(h) - k + 1) :] = 0
    return mix(out)


def unit(h: np.ndarray) -> np.ndarray:
    """Hashes as doubles in (0, 1)."""
    return ((h >> U(11)).astype(np.float64) + 0.5) * 2.0**-53


def signed(h: np.ndarray) -> pa.Array:
    return pa.array(h.view(np.int64))


def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last column, texts, as z: zstd, which makes the shuffle of texts a third as large."""
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        *rest, texts = batch.columns
        z = pa.array([pack((x or "").encode()) for x in texts.to_pylist()], pa.binary())
        yield pa.record_batch([*rest, z], names=[*batch.schema.names[:-1], "z"])


def unpacked(batches: Iterator[pa.RecordBatch], rows: int = 256, z: str = "z", text: str = "text") -> Iterator[pa.RecordBatch]:
    """A zstd column as one more column of texts; a few rows at a time, so memory stays small."""
    import zstandard

    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches:
        for lo in range(0, len(batch), rows):
            part = batch.slice(lo, rows)
            texts = pa.array([unpack(x).decode() for x in part.column(part.schema.get_field_index(z)).to_pylist()], pa.large_string())
            yield pa.record_batch([*part.columns, texts], names=[*part.schema.names, text])


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Text and hash of every run of k words; a text of fewer words but one or more has its whole as one run."""
    h = words.hashes()
    at = np.flatnonzero(words.valid(k))
    doc, out = [words.doc[at]], [runs(h, k)[at]]
    for n in range(1, k):
        few = np.flatnonzero(words.count == n)
        doc.append(few)
        out.append(runs(h, n)[words.first[few]])
    return np.concatenate(doc), np.concatenate(out)


def counted(doc: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of text and hash, and how often each stands."""
    order = np.lexsort([h, doc])
    doc, h = doc[order], h[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    at = np.flatnonzero(new)
    return doc[at], h[at], np.diff(np.append(at, len(doc)))

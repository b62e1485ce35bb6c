"""Model interfaces: segmenters and embedders are plugged in; deterministic stand-ins need no weights."""

from __future__ import annotations

import hashlib
from typing import Protocol

import numpy as np


class Segmenter(Protocol):
    def masks(self, image: np.ndarray) -> list[np.ndarray]:
        """Boolean masks of one RGB image."""


class Embedder(Protocol):
    dim: int

    def images(self, crops: list[np.ndarray]) -> np.ndarray:
        """Unit vectors of RGB crops."""

    def text(self, words: str) -> np.ndarray:
        """A unit vector of a text."""


class GridSegmenter:
    """Tiles of a fixed size as masks."""

    def __init__(self, rows: int = 2, columns: int = 2):
        self.rows, self.columns = rows, columns

    def masks(self, image: np.ndarray) -> list[np.ndarray]:
        out = []
        for part in np.array_split(np.arange(image.shape[0]), self.rows):
            for own in np.array_split(np.arange(image.shape[1]), self.columns):
                mask = np.zeros(image.shape[:2], bool)
                mask[np.ix_(part, own)] = True
                out.append(mask)
        return out


class HashEmbedder:
    """Mean colours spread by a fixed random projection; texts by their hash."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def _unit(self, x: np.ndarray) -> np.ndarray:
        return x / max(float(np.linalg.norm(x)), 1e-12)

    def images(self, crops: list[np.ndarray]) -> np.ndarray:
        turn = np.random.default_rng(7).standard_normal((4, self.dim))
        stats = [np.append(c.reshape(-1, c.shape[-1])[:, :3].mean(axis=0) / 255.0, 1.0) if c.size else np.array([0, 0, 0, 1.0]) for c in crops]
        return np.stack([self._unit(s @ turn) for s in stats]) if crops else np.zeros((0, self.dim))

    def text(self, words: str) -> np.ndarray:
        seed = int.from_bytes(hashlib.sha256(words.encode()).digest()[:8], "little")
        return self._unit(np.random.default_rng(seed).standard_normal(self.dim))


def query_vector(embedder: Embedder, text: str | None = None, image: np.ndarray | None = None) -> list[float]:
    """The vector of a text (blank counts as none) or an image."""
    if text is not None and text.strip():
        return [float(x) for x in embedder.text(text.strip())]
    if image is not None:
        return [float(x) for x in embedder.images([image])[0]]
    raise ValueError("give a text or an image")

"""Colour arithmetic as columns; channels are doubles from 0 to 1."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

#: Ten evenly spaced points of a dark blue to yellow colour map, as 0xRRGGBB; colours between are linear.
RAMP = (0x0D0887, 0x46039F, 0x7201A8, 0x9C179E, 0xBD3786, 0xD8576B, 0xED7953, 0xFB9F3A, 0xFDCA26, 0xF0F921)


def ramp(x: Column, points: Sequence[int] = RAMP) -> list[Column]:
    """The map's red, green and blue at x, 0 to 1."""
    last = len(points) - 1
    cell = F.least(F.floor(x * last), F.lit(last - 1)).cast("int")
    part = x * last - cell
    out = []
    for shift in (16, 8, 0):
        own = F.array(*[F.lit((p >> shift & 255) / 255.0) for p in points])
        out.append(F.get(own, cell) * (1 - part) + F.get(own, cell + 1) * part)
    return out


def quantized(x: Column, low: Column, high: Column, bins: int, eps: float = 1e-8) -> Column:
    """Min-max scaled, clipped to 0 to 1 and rounded, half to even, to one of ``bins`` levels."""
    scaled = F.least(F.greatest((x - low) / (high - low + eps), F.lit(0.0)), F.lit(1.0))
    return F.rint(scaled * (bins - 1)) / (bins - 1)


def blended(over: Column, under: Column, alpha: float) -> Column:
    return F.lit(alpha) * over + F.lit(1 - alpha) * under

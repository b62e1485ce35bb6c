"""Image kernels on NumPy arrays: crops, masks, resizing and a PNG codec."""

from __future__ import annotations

import struct
import zlib

import numpy as np

#: Channel means and deviations of the image encoder's input (fixed values).
CHANNEL_MEAN = (0.48145466, 0.4578275, 0.40821073)
CHANNEL_STD = (0.26862954, 0.26130258, 0.27577711)
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def patch_crop(mask: np.ndarray, image: np.ndarray, expand: float = 0.3) -> np.ndarray:
    """The mask's box, wider by a share of its size, within the image; the whole image for an empty mask."""
    rows, columns = np.nonzero(mask)
    if not len(rows):
        return image
    spans = []
    for at, most in ((rows, mask.shape[0]), (columns, mask.shape[1])):
        pad = int((at.max() - at.min()) * expand)
        spans.append(slice(max(at.min() - pad, 0), min(at.max() + pad, most - 1) + 1))
    return image[spans[0], spans[1]]


def ellipse(size: int) -> np.ndarray:
    """A filled ellipse in a square of ``size``, by rows."""
    r = size // 2
    out = np.zeros((size, size), bool)
    for i in range(size):
        dy = i - r
        dx = int(round(r * np.sqrt(max(0.0, (r * r - dy * dy) / (r * r))))) if r else 0
        out[i, max(r - dx, 0) : r + dx + 1] = True
    return out


def dilated(mask: np.ndarray, size: int = 25, rounds: int = 5) -> np.ndarray:
    """The mask grown by an ellipse, several times; 0 and 1."""
    out, kernel = np.asarray(mask) > 0, ellipse(size)
    r = size // 2
    for _ in range(rounds):
        padded = np.pad(out, r)
        grown = np.zeros_like(out)
        for i in range(size):
            span = np.flatnonzero(kernel[i])
            rows = padded[i : i + out.shape[0]]
            upto = np.pad(np.cumsum(rows, axis=1), ((0, 0), (1, 0)))
            a = np.arange(out.shape[1]) + span[0]
            grown |= upto[:, a + len(span)] > upto[:, a]
        out = grown
    return out.astype(np.uint8)


def masked_crop(mask: np.ndarray, image: np.ndarray, mode: str, expand: float = 0.3, size: int = 25, rounds: int = 5) -> np.ndarray:
    """What the image encoder sees of a mask: its box (patch), its pixels (bin) or those of the grown mask (dilated)."""
    if mode == "patch":
        return patch_crop(mask, image, expand)
    if mode == "bin":
        return image * (np.asarray(mask) > 0).astype(image.dtype)[:, :, None]
    if mode == "dilated":
        return image * dilated(mask, size, rounds)[:, :, None]
    raise ValueError(f"unknown crop mode: {mode!r}")


def resized_nearest(image: np.ndarray, height: int, width: int) -> np.ndarray:
    rows = np.minimum((np.arange(height) * (image.shape[0] / height)).astype(int), image.shape[0] - 1)
    columns = np.minimum((np.arange(width) * (image.shape[1] / width)).astype(int), image.shape[1] - 1)
    return image[rows][:, columns]


def resized_bilinear(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear, with pixel centres kept; uint8 stays uint8."""

    def line(n: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.clip((np.arange(m) + 0.5) * n / m - 0.5, 0, n - 1)
        low = np.floor(at).astype(int)
        return low, np.minimum(low + 1, n - 1), at - low

    y0, y1, fy = line(image.shape[0], height)
    x0, x1, fx = line(image.shape[1], width)
    x = image.astype(np.float64)
    fy, fx = fy[:, None, None], fx[None, :, None]
    flat = x.ndim == 2
    x = x[:, :, None] if flat else x
    out = (x[y0][:, x0] * (1 - fx) + x[y0][:, x1] * fx) * (1 - fy) + (x[y1][:, x0] * (1 - fx) + x[y1][:, x1] * fx) * fy
    out = out[:, :, 0] if flat else out
    return np.rint(out).astype(image.dtype) if np.issubdtype(image.dtype, np.integer) else out


def smoothed(x: np.ndarray, sigma: float, axis: int) -> np.ndarray:
    """A Gaussian along one axis, cut at four deviations; the image is mirrored at its edge pixels."""
    if sigma <= 0:
        return x
    r = int(4 * sigma + 0.5)
    kernel = np.exp(-0.5 * (np.arange(-r, r + 1) / sigma) ** 2)
    kernel /= kernel.sum()
    wide = np.pad(x, [(r, r) if i == axis else (0, 0) for i in range(x.ndim)], mode="reflect")
    views = np.lib.stride_tricks.sliding_window_view(wide, len(kernel), axis=axis)
    return views @ kernel


def resized_smooth(image: np.ndarray, height: int, width: int) -> np.ndarray:
    """Bilinear after a Gaussian of (factor - 1) / 2 pixels on axes that shrink, mirrored at the edges; integers are cut, not rounded."""
    x = image.astype(np.float64)
    for axis, m in enumerate((height, width)):
        n = x.shape[axis]
        x = smoothed(x, max(0.0, (n / m - 1) / 2), axis)
        at = np.abs((np.arange(m) + 0.5) * n / m - 0.5)
        at = np.where(at > n - 1, 2 * (n - 1) - at, at).clip(0)
        low = np.floor(at).astype(int)
        share = (at - low).reshape([-1 if i == axis else 1 for i in range(x.ndim)])
        x = np.take(x, low, axis) * (1 - share) + np.take(x, np.minimum(low + 1, n - 1), axis) * share
    # a sum of weights may end a hair below a whole number
    return np.floor(x + 1e-9).astype(image.dtype) if np.issubdtype(image.dtype, np.integer) else x


def mask_runs(mask: np.ndarray) -> np.ndarray:
    """A mask as start and length of each run of set pixels, counted row by row."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (np.asarray(mask) > 0).ravel().astype(np.int8), [0]])))
    return np.column_stack([edges[::2], edges[1::2] - edges[::2]]).astype(np.int32).ravel()


def mask_of(runs: np.ndarray, height: int, width: int) -> np.ndarray:
    """The mask of ``mask_runs``."""
    flat = np.zeros(height * width + 1, np.int8)
    runs = np.asarray(runs, np.int64).reshape(-1, 2)
    flat[runs[:, 0]] += 1
    flat[runs.sum(axis=1)] -= 1
    return np.cumsum(flat[:-1]).astype(bool).reshape(height, width)


def encoder_input(image: np.ndarray, size: int = 224) -> np.ndarray:
    """Shorter side to ``size``, centre crop, channels first, normalised."""
    h, w = image.shape[:2]
    scale = size / min(h, w)
    image = resized_bilinear(image, max(size, int(h * scale)), max(size, int(w * scale)))
    top, left = (image.shape[0] - size) // 2, (image.shape[1] - size) // 2
    x = image[top : top + size, left : left + size].astype(np.float64) / 255
    return ((x - np.array(CHANNEL_MEAN)) / np.array(CHANNEL_STD)).transpose(2, 0, 1)


def png_bytes(image: np.ndarray) -> bytes:
    """A PNG of a grey (H, W) or RGB (H, W, 3) array of uint8 or uint16."""
    kind = 0 if image.ndim == 2 else 2
    depth = image.dtype.itemsize * 8
    lines = np.ascontiguousarray(image, f">u{image.dtype.itemsize}").reshape(image.shape[0], -1).view(np.uint8)
    raw = np.pad(lines, ((0, 0), (1, 0))).tobytes()

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    head = struct.pack(">IIBBBBB", image.shape[1], image.shape[0], depth, kind, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def png_array(data: bytes) -> np.ndarray:
    """The pixels of a PNG: grey, RGB or with alpha, 8 or 16 bits, not interlaced; 16-bit values stay whole."""
    if not data.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, body, head = 8, [], b""
    while at < len(data):
        size, name = struct.unpack(">I4s", data[at : at + 8])
        part = data[at + 8 : at + 8 + size]
        if name == b"IHDR":
            head = part
        elif name == b"IDAT":
            body.append(part)
        at += 12 + size
    width, height, depth, kind, _, _, interlace = struct.unpack(">IIBBBBB", head)
    channels = {0: 1, 2: 3, 4: 2, 6: 4}.get(kind)
    if channels is None or depth not in (8, 16) or interlace:
        raise ValueError(f"unsupported PNG: colour type {kind}, depth {depth}, interlace {interlace}")
    step = channels * depth // 8
    raw = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, 1 + width * step)
    out = np.zeros((height, width * step), np.uint8)
    above = np.zeros(width * step, np.uint8)
    for y in range(height):
        rule, line = raw[y, 0], raw[y, 1:]
        out[y] = above = unfiltered(rule, line, above, step)
    pixels = out.view(">u2").astype(np.uint16) if depth == 16 else out
    return pixels.reshape(height, width) if channels == 1 else pixels.reshape(height, width, channels)


def unfiltered(rule: int, line: np.ndarray, above: np.ndarray, step: int) -> np.ndarray:
    """A PNG scan line without its filter."""
    if rule == 0:
        return line
    if rule == 2:
        return line + above
    if rule == 1:
        return np.cumsum(line.reshape(-1, step), axis=0, dtype=np.uint8).reshape(-1)
    out = np.zeros(len(line) + step, np.int64)
    up = np.concatenate([np.zeros(step, np.int64), above.astype(np.int64)])
    for i in range(step, len(out)):
        a, b, c = out[i - step], up[i], up[i - step]
        if rule == 3:
            guess = (a + b) // 2
        else:
            pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
            guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
        out[i] = (int(line[i - step]) + guess) & 255
    return out[step:].astype(np.uint8)

"""Seven appearance statistics of images, decoded and computed on the executors."""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

try:  # optional
    from PIL import Image
except ImportError:
    Image = None

FEATURES = ["edge", "ink", "colf", "sat", "ent", "white", "ar"]
SIDE = 256


# First column and row, and steps, of the seven passes of interlaced images.
_PASSES = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)]


def _unfiltered(raw: bytes, at: int, h: int, size: int, n: int) -> tuple[np.ndarray, int]:
    """(h x size bytes, where they end) of filtered lines; n: bytes of a pixel."""
    lines = np.frombuffer(raw, np.uint8, h * (size + 1), at).reshape(h, size + 1)
    out, above = np.zeros((h, size), np.uint8), np.zeros(size, np.int64)
    wide = -(-size // n) * n
    for y in range(h):
        kind, line = lines[y, 0], lines[y, 1:].astype(np.int64)
        if kind == 2:
            line = line + above & 255
        elif kind == 1:
            padded = np.zeros(wide, np.int64)
            padded[:size] = line
            line = (np.cumsum(padded.reshape(-1, n), axis=0).reshape(-1) & 255)[:size]
        elif kind in (3, 4):
            got, up = line.tolist(), above.tolist()
            for i in range(size):
                left, corner = (got[i - n], up[i - n]) if i >= n else (0, 0)
                if kind == 3:
                    guess = left + up[i] >> 1
                else:
                    a, b, c = abs(up[i] - corner), abs(left - corner), abs(left + up[i] - 2 * corner)
                    guess = left if a <= b and a <= c else up[i] if b <= c else corner
                got[i] = got[i] + guess & 255
            line = np.array(got)
        elif kind:
            raise ValueError("unknown filter")
        out[y], above = line, line
    return out, at + h * (size + 1)


def _samples(lines: np.ndarray, w: int, n: int, depth: int) -> np.ndarray:
    """h x w x n samples of 8 bits, or of fewer as they are."""
    if depth == 16:
        lines = lines[:, ::2]
    elif depth < 8:
        bits = np.unpackbits(lines, axis=1)
        bits = bits[:, : bits.shape[1] // depth * depth].reshape(len(lines), -1, depth)
        lines = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(axis=2).astype(np.uint8)
    return lines[:, : w * n].reshape(len(lines), w, n)


def decode_png(data: bytes) -> np.ndarray:
    """H x W x 3 bytes of a PNG of any depth, interlaced or not: grey, palette or colour, alpha dropped."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG")
    at, packed, palette, head = 8, b"", None, None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif kind == b"IDAT":
            packed += body
        elif kind == b"IEND":
            break
    if head is None:
        raise ValueError("no header")
    w, h, depth, colour, _, _, interlaced = head
    n = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}[colour]
    raw, size = zlib.decompress(packed), max(1, n * depth // 8)
    px = np.zeros((h, w, n), np.uint8)
    at = 0
    for x0, y0, dx, dy in _PASSES if interlaced else [(0, 0, 1, 1)]:
        pw, ph = -(-(w - x0) // dx), -(-(h - y0) // dy)
        if pw > 0 and ph > 0:
            lines, at = _unfiltered(raw, at, ph, -(-pw * n * depth // 8), size)
            px[y0::dy, x0::dx] = _samples(lines, pw, n, depth)
    if colour == 3:
        return palette[px[..., 0]]
    if depth < 8:
        px = (px.astype(np.uint16) * 255 // ((1 << depth) - 1)).astype(np.uint8)
    return np.repeat(px[..., :1], 3, axis=2) if n < 3 else px[..., :3]


def encode_png(px: np.ndarray) -> bytes:
    """A PNG of H x W x 3 bytes."""
    h, w = px.shape[:2]
    lines = np.concatenate([np.zeros((h, 1), np.uint8), px.reshape(h, w * 3)], axis=1)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(lines.tobytes())) + chunk(b"IEND", b"")


def decode(data: bytes) -> np.ndarray:
    """H x W x 3 bytes of an image: by the imaging library if it is installed, which reads any format, else of a PNG."""
    if Image is None:
        return decode_png(data)
    try:
        return np.asarray(Image.open(io.BytesIO(data)).convert("RGB"))
    except OSError as e:
        raise ValueError(str(e)) from e


def _lanczos(n: int, m: int) -> np.ndarray:
    """m x n weights that shrink n samples to m, three lobes."""
    scale = n / m
    centre = (np.arange(m) + 0.5) * scale - 0.5
    x = (np.arange(n)[None, :] - centre[:, None]) / max(scale, 1.0)
    k = np.where(np.abs(x) < 3, np.sinc(x) * np.sinc(x / 3), 0.0)
    return k / k.sum(axis=1, keepdims=True)


def thumbnail(px: np.ndarray, side: int = SIDE) -> np.ndarray:
    """px no larger than side x side, its shape kept; small images are left alone."""
    h, w = px.shape[:2]
    if max(h, w) <= side:
        return px
    nh, nw = max(1, round(h * side / max(h, w))), max(1, round(w * side / max(h, w)))
    a = np.einsum("ij,jkc->ikc", _lanczos(h, nh), px.astype(float))
    a = np.einsum("ij,kjc->kic", _lanczos(w, nw), a)
    return np.clip(np.rint(a), 0, 255).astype(np.uint8)


def pixel_features(px: np.ndarray) -> list[float]:
    """Edge density, ink, colourfulness, saturation, tone entropy in bits, white space, aspect ratio."""
    px = thumbnail(px)
    a = px.astype(np.float32) / np.float32(255)
    r, g, b = a[..., 0], a[..., 1], a[..., 2]
    grey = np.float32(0.299) * r + np.float32(0.587) * g + np.float32(0.114) * b
    across, down = grey[:-1, 1:] - grey[:-1, :-1], grey[1:, :-1] - grey[:-1, :-1]
    edge = float(np.hypot(across, down).mean()) if across.size else 0.0
    red_green, yellow_blue = r - g, (r + g) / 2 - b
    colour = float(np.hypot(red_green.std(), yellow_blue.std()) + 0.3 * np.hypot(red_green.mean(), yellow_blue.mean()))
    top, low = a.max(-1), a.min(-1)
    sat = float(np.divide(top - low, top, out=np.zeros_like(top), where=top > 0).mean())
    bins = np.bincount(np.minimum((np.clip(grey, 0, 1) * 64).astype(int), 63).ravel(), minlength=64)
    share = bins[bins > 0] / grey.size
    return [edge, float((grey < 0.85).mean()), colour, sat, float(-(share * np.log2(share)).sum()), float((grey > 0.95).mean()), px.shape[1] / px.shape[0]]


def image_features(files: DataFrame) -> DataFrame:
    """(name, the seven statistics) of files (name, content); null statistics where an image can't be decoded."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, data in zip(pdf["name"], pdf["content"]):
                try:
                    rows.append((name, *pixel_features(decode(bytes(data)))))
                except (ValueError, TypeError, KeyError, IndexError, struct.error, zlib.error):
                    rows.append((name, *[None] * 7))
            yield pd.DataFrame(rows, columns=["name", *FEATURES])

    return files.select("name", "content").mapInPandas(run, "name string, " + ", ".join(f"{f} double" for f in FEATURES))

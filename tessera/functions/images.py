"""Pictures as binary columns: decoding, colour shares, and scores of an ontology's words."""

from __future__ import annotations

import struct
import zlib

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, MapType, StringType

MOST_BYTES, MOST_PIXELS = 8 << 20, 12_000_000
SAMPLED = 4096
COLOURS = ("green", "yellow", "brown", "black", "white", "red", "dark")
# More than this share of a colour, and the words that it stands for.
COLOUR_WORDS = (
    ("yellow", 0.25, ("yellow", "yellowing", "chlorosis")), ("brown", 0.12, ("brown", "spots", "necrosis", "rust")), ("black", 0.10, ("black", "sooty", "spots")),
    ("white", 0.18, ("white", "powdery", "mildew")), ("red", 0.12, ("red", "spots")),
)
_CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode_png(data: bytes) -> np.ndarray:
    """height x width x 3 of an 8-bit PNG without interlacing; alpha is dropped, grey repeated."""
    if data[:8] != b"\x89PNG\r\n\x1a\n" or len(data) > MOST_BYTES:
        raise ValueError("not a PNG file of a size that is taken")
    at, packed, head = 8, [], None
    while at + 8 <= len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + size]
        at += 12 + size
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed.append(body)
    if head is None or head[2] != 8 or head[3] not in _CHANNELS or head[6] or head[0] * head[1] > MOST_PIXELS:
        raise ValueError("a kind of PNG that isn't read")
    width, height, n = head[0], head[1], _CHANNELS[head[3]]
    lines = np.frombuffer(zlib.decompress(b"".join(packed)), np.uint8).reshape(height, width * n + 1)
    out = np.zeros((height, width, n), np.int32)
    above = np.zeros((width, n), np.int32)
    for y in range(height):
        line, kind = lines[y, 1:].reshape(width, n).astype(np.int32), lines[y, 0]
        if kind == 1:  # each sample adds up what came before it
            line = np.cumsum(line, axis=0) % 256
        elif kind == 2:
            line = (line + above) % 256
        elif kind in (3, 4):
            line = _unfiltered(line.tolist(), above.tolist(), kind == 4)
        out[y] = above = np.asarray(line, np.int32)
    out = out.astype(np.uint8)
    pixels = out.reshape(height, width, n)
    return pixels[:, :, :3] if n >= 3 else np.repeat(pixels[:, :, :1], 3, axis=2)


def _unfiltered(line: list, above: list, paeth: bool) -> list:
    """A row whose samples depend on the one to their left: by the mean, or by the nearest of three neighbours."""
    left, corner = [0] * len(line[0]), [0] * len(line[0])
    out = []
    for now, up in zip(line, above, strict=True):
        made = []
        for x, a, b, c in zip(now, left, up, corner, strict=True):
            if paeth:
                pa, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                guess = a if pa <= pb and pa <= pc else b if pb <= pc else c
            else:
                guess = (a + b) >> 1
            made.append((x + guess) & 255)
        out.append(made)
        left, corner = made, up
    return out


def hsv(rgb: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hue in degrees, saturation and value between 0 and 1."""
    x = rgb.reshape(-1, 3) / 255.0
    top, low = x.max(1), x.min(1)
    span = top - low
    safe = np.where(span == 0, 1, span)
    r, g, b = x.T
    hue = np.where(top == r, (g - b) / safe % 6, np.where(top == g, (b - r) / safe + 2, (r - g) / safe + 4)) * 60
    return np.where(span == 0, 0, hue), np.where(top == 0, 0, span / np.where(top == 0, 1, top)), top


def sampled(rgb: np.ndarray, most: int = SAMPLED) -> np.ndarray:
    """Every n-th pixel of every n-th row, so that about `most` are left."""
    height, width = rgb.shape[:2]
    stride = max(1, int((width * height / most) ** 0.5))
    return rgb[::stride, ::stride]


def colour_shares(rgb: np.ndarray) -> dict[str, float]:
    """Shares of the sampled pixels; the first colour that fits counts, and dark beside it."""
    h, s, v = hsv(sampled(rgb))
    # Hue, saturation and value of each colour, in the order they are tried.
    kinds = {
        "black": v < 0.15,
        "white": (v > 0.75) & (s < 0.25),
        "yellow": (h >= 45) & (h < 70) & (s > 0.30) & (v > 0.40),
        "brown": (h >= 20) & (h < 45) & (s > 0.25) & (v >= 0.20) & (v <= 0.65),
        "red": ((h < 20) | (h >= 340)) & (s > 0.30),
        "green": (h >= 70) & (h < 160) & (s > 0.12),
    }
    which = np.select(list(kinds.values()), range(len(kinds)), -1)
    out = {c: float((which == k).mean()) for k, c in enumerate(kinds)} | {"dark": float((v < 0.30).mean())}
    return {c: out[c] for c in COLOURS}


@pandas_udf(MapType(StringType(), DoubleType()))
def colours(x):
    """Shares of seven colours in each picture; null where it can't be read."""

    def one(data):
        try:
            return colour_shares(decode_png(bytes(data)))
        except (ValueError, TypeError, zlib.error, struct.error):
            return None

    return x.map(one)


def described(shares: Column) -> Column:
    """What the colours of a picture speak for: words of symptoms, or healthy."""
    share = lambda c: F.coalesce(shares[c], F.lit(0.0))
    healthy = (share("green") > 0.5) & (share("yellow") < 0.15) & (share("brown") < 0.1) & (share("black") < 0.08)
    words = [F.when(healthy, F.array(F.lit("healthy")))]
    words += [F.when(share(c) > least, F.array(*map(F.lit, found))) for c, least, found in COLOUR_WORDS]
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(w, none) for w in words]))


def word_matches(words: Column, text: Column) -> Column:
    """The words that a text has as whole words."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    return F.filter(words, lambda w: F.regexp_like(lower, F.concat(F.lit("\\b\\Q"), w, F.lit("\\E\\b"))))


def word_score(words: Column, text: Column) -> Column:
    """Two for each word that a text has as a word, one where it is only a part of one."""
    lower = F.lower(F.coalesce(text, F.lit("")))
    parts = F.size(F.filter(words, lambda w: F.contains(lower, w)))
    return F.size(word_matches(words, text)) + parts

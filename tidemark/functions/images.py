"""What a thumbnail looks like, from its bytes: Arrow functions over small images."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Weights of red, green and blue in perceived lightness.
LUMA = np.array([0.299, 0.587, 0.114])
#: Markers of a JPEG that have no length, and those of its frame headers.
_ALONE = {0x01, *range(0xD0, 0xD9)}
_FRAMES = set(range(0xC0, 0xD0)) - {0xC4, 0xC8, 0xCC}
FEATURES = ("brightness", "contrast", "saturation", "warmth", "skin")


def features_of(rgb: bytes | None) -> tuple[float, ...] | None:
    """The five features of raw 8-bit RGB, over its whole pixels; null without one.

    Lightness and its spread, mean saturation, red against red and blue, and the share of
    pixels in a range of skin colours.
    """
    n = len(rgb or b"") // 3
    if n == 0:
        return None
    pixels = np.frombuffer(rgb, np.uint8, 3 * n).reshape(n, 3).astype(np.float64)
    light = pixels @ LUMA
    top, low = pixels.max(axis=1), pixels.min(axis=1)
    red, green, blue = pixels.T
    skin = (red > 95) & (green > 40) & (blue > 20) & (top - low > 15) & (np.abs(red - green) > 15) & (red > green) & (red > blue)
    both = red.mean() + blue.mean()
    return (
        float(light.mean() / 255),
        float(min(1.0, light.std() / 128)),
        float(np.divide(top - low, top, out=np.zeros(n), where=top > 0).mean()),
        float(red.mean() / both) if both else 0.5,
        float(skin.mean()),
    )


def jpeg_size(data: bytes | None) -> tuple[int, int] | None:
    """(width, height) of a JPEG's first frame header; null for other or cut-off bytes."""
    if not data or data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 9 <= len(data):
        mark, kind, size = struct.unpack_from(">BBH", data, at)
        if mark != 0xFF or kind == 0xFF:
            at += 1
        elif kind in _ALONE:
            at += 2
        elif size < 2:
            return None
        elif kind in _FRAMES:
            height, width = struct.unpack_from(">HH", data, at + 5)
            return (width, height) if width and height else None
        else:
            at += 2 + size
    return None


@F.pandas_udf(T.StructType([T.StructField(name, T.DoubleType()) for name in FEATURES]))
def image_features(rgb: pd.Series) -> pd.DataFrame:
    found = [features_of(x) or (None,) * len(FEATURES) for x in rgb]
    return pd.DataFrame(found, columns=list(FEATURES), dtype="float64")


@F.pandas_udf(T.StructType([T.StructField("width", T.IntegerType()), T.StructField("height", T.IntegerType()), T.StructField("density", T.DoubleType())]))
def jpeg_info(data: pd.Series) -> pd.DataFrame:
    """Size, and compressed bytes per pixel: the busier an image, the more it needs."""
    rows = [(x, jpeg_size(x)) for x in data]
    sizes = [(None, None, None) if s is None else (*s, len(x) / (s[0] * s[1])) for x, s in rows]
    out = pd.DataFrame(sizes, columns=["width", "height", "density"])
    return out.astype({"width": "Int32", "height": "Int32", "density": "float64"})

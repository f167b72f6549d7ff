"""Measures and corrections of pictures given as raw RGB bytes with height and width.

Decoding is left to an injected function; these work on the decoded pixels, a batch at a time.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

_LUMA = np.array([0.299, 0.587, 0.114])


def as_pixels(raw: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(raw, np.uint8).reshape(height, width, 3).astype(np.float64)


def measured(px: np.ndarray) -> dict[str, float]:
    """Channel means, median and outer percentiles of brightness, mean colourfulness."""
    luma = px @ _LUMA
    low, mid, high = np.percentile(luma, [0.5, 50, 99.5])
    chroma = float((px.max(2) - px.min(2)).mean())
    r, g, b = px.reshape(-1, 3).mean(0)
    return {"red": float(r), "green": float(g), "blue": float(b), "low": float(low), "mid": float(mid), "high": float(high), "chroma": chroma}


def cosine_transform(n: int) -> np.ndarray:
    """Matrix of the type-II cosine transform of length ``n``."""
    k, x = np.arange(n)[:, None], np.arange(n)[None, :]
    return np.cos(np.pi * k * (2 * x + 1) / (2 * n))


def shrunk(px: np.ndarray, size: int) -> np.ndarray:
    """Brightness as the means of a ``size`` x ``size`` grid of areas."""
    luma = px @ _LUMA
    for axis in (0, 1):
        at = np.linspace(0, luma.shape[axis], size + 1)
        sums = np.concatenate([np.zeros_like(luma.take([0], axis)), np.cumsum(luma, axis)], axis)
        low = np.minimum(np.floor(at).astype(int), luma.shape[axis])
        whole = sums.take(low, axis)
        part = luma.take(np.minimum(low, luma.shape[axis] - 1), axis)
        shape = [-1 if a == axis else 1 for a in (0, 1)]
        luma = np.diff(whole + part * (at - low).reshape(shape), axis=axis) / (luma.shape[axis] / size)
    return luma


def fingerprint(px: np.ndarray) -> int:
    """64 signs of the lowest frequencies of the picture against their median, as a signed 64-bit number."""
    t = cosine_transform(32)
    low = (t @ shrunk(px, 32) @ t.T)[:8, :8].ravel()
    bits = low > np.median(low)
    code = int("".join("1" if x else "0" for x in bits), 2)
    return code - (1 << 64) if code >> 63 else code


def balanced(px: np.ndarray, strength: float = 1.0) -> np.ndarray:
    """Channels scaled towards one common mean."""
    means = px.reshape(-1, 3).mean(0)
    gain = np.where(means > 0, means.mean() / np.maximum(means, 1e-9), 1.0)
    return np.clip(px * (1 + strength * (gain - 1)), 0, 255)


def levelled(px: np.ndarray) -> np.ndarray:
    """Brightness stretched so that its outer percentiles reach black and white; a flat picture stays."""
    m = measured(px)
    if m["high"] - m["low"] < 1:
        return px
    return np.clip((px - m["low"]) * 255 / (m["high"] - m["low"]), 0, 255)


def fit_scale(height: Column, width: Column, long_side: int, short_side: int) -> Column:
    """Factor, at most 1, that brings a picture inside both limits."""
    long_, short = F.greatest(height, width), F.least(height, width)
    return F.least(F.lit(1.0), F.lit(float(long_side)) / long_, F.lit(float(short_side)) / short)


_MEASURES = ("red", "green", "blue", "low", "mid", "high", "chroma")


def _each(raw: pd.Series, height: pd.Series, width: pd.Series, f) -> list:
    return [None if r is None else f(as_pixels(r, int(h), int(w))) for r, h, w in zip(raw, height, width, strict=True)]


@F.pandas_udf(StructType([StructField(m, DoubleType()) for m in _MEASURES]))
def picture_measures(raw: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
    """:func:`measured` as a struct column."""
    return pd.DataFrame([m or {} for m in _each(raw, height, width, measured)], columns=list(_MEASURES))


@F.pandas_udf(LongType())
def picture_fingerprint(raw: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
    """:func:`fingerprint` as a bigint column; null pictures have none."""
    return pd.Series(_each(raw, height, width, fingerprint), dtype="Int64")

"""Hashes of pictures and texts in which likeness shows as few differing bits: 64 bits as 16 hexadecimal digits."""

from __future__ import annotations

import hashlib
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

#: Fixed values of the common hashes: a picture of SIDE x SIDE for the cosine transform, LOW x LOW of whose coefficients
#: are kept; LOW rows of LOW + 1 pixels for differences; the width of Lanczos's window in source pixels.
SIDE, LOW, LOBES = 32, 8, 3
#: Coefficients within this of the median are taken to equal it: far above rounding errors, far below a step of light.
EQUAL = 1e-6
#: Words of a text that are hashed together.
SHINGLE = 3
#: Runs whose bits are counted at once.
COUNTED = 16_384


def _window(x: np.ndarray) -> np.ndarray:
    """Lanczos's window: sinc(x) sinc(x / LOBES) within LOBES."""
    return np.where(np.abs(x) < LOBES, np.sinc(x) * np.sinc(x / LOBES), 0.0)


@cache
def resampling(size: int, wanted: int) -> np.ndarray:
    """The wanted x size matrix that resamples a line of pixels: each row the window around its place, of sum 1."""
    scale = size / wanted
    middle = (np.arange(wanted) + 0.5) * scale
    weights = _window((np.arange(size) + 0.5 - middle[:, None]) / max(1.0, scale))
    return weights / weights.sum(axis=1, keepdims=True)


def _whole(light: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(light + 0.5), 0, 255)


def resized(gray: np.ndarray, height: int, width: int) -> np.ndarray:
    """A gray picture in another size, lines first, then columns; light is a whole number after each."""
    return _whole(resampling(gray.shape[0], height) @ _whole(gray @ resampling(gray.shape[1], width).T))


@cache
def cosines() -> np.ndarray:
    """The first LOW lines of the cosine transform of SIDE values."""
    return np.cos(np.pi * np.arange(LOW)[:, None] * (2 * np.arange(SIDE) + 1) / (2 * SIDE))


def hexadecimal(bits: np.ndarray) -> str:
    """Bits, the first the highest, as hexadecimal digits."""
    return np.packbits(bits.astype(bool).ravel()).tobytes().hex()


def dct_hash(gray: np.ndarray) -> str:
    """Which low coefficients of the two-dimensional cosine transform are above their median.

    One that equals it is not: rounding errors, which differ from machine to machine, decide no bit.
    """
    low = cosines() @ resized(gray, SIDE, SIDE) @ cosines().T
    return hexadecimal(low - np.median(low) > EQUAL)


def difference_hash(gray: np.ndarray) -> str:
    """Where the picture gets lighter from left to right."""
    small = resized(gray, LOW, LOW + 1)
    return hexadecimal(small[:, 1:] > small[:, :-1])


HASHES = T.StructType([T.StructField("phash", T.StringType()), T.StructField("dhash", T.StringType())])


@F.pandas_udf(HASHES)
def _picture_hashes(pixels: pd.Series, width: pd.Series) -> pd.DataFrame:
    out = []
    for p, w in zip(pixels, width):
        if p is None or pd.isna(w) or w <= 0 or len(p) == 0 or len(p) % int(w) or not np.isfinite(np.asarray(p, float)).all():
            out.append((None, None))
        else:
            gray = np.asarray(p, float).reshape(-1, int(w))
            out.append((dct_hash(gray), difference_hash(gray)))
    return pd.DataFrame(out, columns=HASHES.names, dtype=object)


def picture_hashes(pixels: Column, width: Column) -> Column:
    """(phash, dhash) of a gray picture given as its pixels, row by row, and its width; nulls where it is no picture."""
    return _picture_hashes(pixels, width)


def simhash_of(text: str | None) -> str | None:
    words = (text or "").split()
    if not words:
        return None
    runs = max(1, len(words) - SHINGLE + 1)
    up = np.zeros(64, np.int64)
    for at in range(0, runs, COUNTED):
        digests = b"".join(hashlib.md5(" ".join(words[i : i + SHINGLE]).encode()).digest()[:8] for i in range(at, min(at + COUNTED, runs)))
        up += np.unpackbits(np.frombuffer(digests, np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return hexadecimal(2 * up > runs)


@F.pandas_udf(T.StringType())
def _simhash(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash_of(t) for t in texts], dtype=object)


def simhash(text: Column) -> Column:
    """The majority of each bit among the hashes of a text's runs of SHINGLE words; null for texts without words.

    A text of fewer words is one run. Likeness of texts shows in few differing bits, as that of pictures in theirs.
    """
    return _simhash(text)

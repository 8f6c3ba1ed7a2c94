"""Augmentation of sequences: hash-driven, so the same row and copy always give the same result."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..hashing import hash_normal, hash_unit


def jitter(seq: Column, sigma: float, seed: int, *keys: str) -> Column:
    return F.transform(seq, lambda x, i: x + sigma * hash_normal(seed, *keys, i))


def noise_scale(seq: Column, sigma: float, spread: float, seed: int, *keys: str) -> Column:
    """Each sample times one factor 1 + spread * z for the sequence, plus noise."""
    return F.transform(seq, lambda x, i: x * (1 + spread * hash_normal(seed, *keys, F.lit("scale"))) + sigma * hash_normal(seed, *keys, i))


def flip(seq: Column) -> Column:
    return F.reverse(seq)


def slice_pad(seq: Column, pad_edge: bool, seed: int, *keys: str, least: int = 24, size: int = 30) -> Column:
    """A slice of least..size samples at a hashed place, padded back to size with its last sample, or with zeros."""
    n = (least + F.floor(hash_unit(seed, *keys, F.lit("n")) * (size - least + 1))).cast("int")
    start = (1 + F.floor(hash_unit(seed, *keys, F.lit("s")) * (size - n + 1))).cast("int")
    cut = F.slice(seq, start, n)
    return F.concat(cut, F.array_repeat(F.element_at(cut, -1) if pad_edge else F.lit(0.0), size - n))


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def stretch_crop(seq: pd.Series, factor: pd.Series) -> pd.Series:
    """Linear resampling by a factor, cropped or padded with the last sample to the old length."""

    def one(x, f):
        x = np.asarray(x, dtype=float)
        n = max(1, round(len(x) * f))
        y = np.interp(np.linspace(0, len(x) - 1, n), np.arange(len(x)), x)
        return np.concatenate((y[: len(x)], np.full(max(0, len(x) - n), y[-1]))).tolist()

    return pd.Series([None if x is None else one(x, f) for x, f in zip(seq, factor, strict=True)])

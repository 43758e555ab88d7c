"""Transforms of vectors and matrices that need arrays: Arrow batches in, Arrow batches out."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType


def clipped_gain(e: Column, direction: Column, strength: Column) -> Column:
    """Elements times 1 + strength * direction, held within 0 and 1."""
    return F.zip_with(e, direction, lambda x, d: F.least(F.greatest(x * (1 + strength * d), F.lit(0.0)), F.lit(1.0)))


@F.pandas_udf(ArrayType(DoubleType()))
def fourier_mix(source: pd.Series, donor: pd.Series, share: pd.Series) -> pd.Series:
    """The source's phases with its amplitudes mixed with the donor's by share, held within 0 and 1."""

    def mixed(x: np.ndarray, y: np.ndarray, a: float) -> np.ndarray:
        fx, fy = np.fft.fft(x), np.fft.fft(y)
        amplitude = (1 - a) * np.abs(fx) + a * np.abs(fy)
        return np.clip(np.fft.ifft(amplitude * np.exp(1j * np.angle(fx))).real, 0.0, 1.0)

    return pd.Series([None if x is None or y is None else mixed(np.asarray(x, float), np.asarray(y, float), a).tolist() for x, y, a in zip(source, donor, share)])


def resized(e: Column, size: int) -> Column:
    """A vector at `size` places by linear interpolation between the centres of its elements."""
    n = F.size(e)
    at = lambda i: F.greatest((i + 0.5) * n / size - 0.5, F.lit(0.0))
    low = lambda i: F.least(F.floor(at(i)).cast("int"), n - 1)
    high = lambda i: F.least(low(i) + 1, n - 1)
    part = lambda i: at(i) - low(i)
    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.get(e, low(i)) * (1 - part(i)) + F.get(e, high(i)) * part(i))


def normalised(e: Column, mean: list[float], sd: list[float]) -> Column:
    """Elements of interleaved channels less the channel's mean, by its deviation."""
    means, sds = F.array(*map(F.lit, mean)), F.array(*map(F.lit, sd))
    return F.transform(e, lambda x, i: (x - F.get(means, i % len(mean))) / F.get(sds, i % len(sd)))


def applied(rows: DataFrame, vector: str, key: str, f: Callable[[np.ndarray], np.ndarray], rows_at_once: int = 256) -> DataFrame:
    """key, out (array of doubles): f of blocks of at most so many vectors, so that no more are held at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for k in range(0, len(batch), rows_at_once):
                part = batch.iloc[k : k + rows_at_once]
                found = f(np.stack([np.asarray(v, float) for v in part[vector]]))
                yield pd.DataFrame({key: part[key].to_numpy(), "out": [row.tolist() for row in found]})

    return rows.select(key, vector).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, out array<double>")

"""Embedding columns: validity, and binary form for numpy."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(col: str = "embedding") -> Column:
    """Not null, without null or non-finite components."""
    return F.coalesce(F.forall(col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf"))), F.lit(False))


def dimensions(df: DataFrame, col: str = "embedding") -> list[int]:
    """The numbers of components that occur; vectors are compared only with those of their own."""
    return sorted(r[0] for r in df.select(F.size(col)).distinct().collect())


def pack(batch_column, dtype: str) -> list[bytes]:
    """List column of one Arrow batch, all of one length, as bytes per row."""
    values = batch_column.flatten().to_numpy(zero_copy_only=False).astype(dtype)
    return [x.tobytes() for x in values.reshape(len(batch_column), -1)] if len(batch_column) else []


def unpack(column, dtype: str, dim: int) -> np.ndarray:
    """Binary column -> (rows, dim)."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype).reshape(-1, dim)


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows multiplied by the power of two that brings their largest component to between 1/2 and 1.

    Directions stay to the last bit, and squares neither vanish nor overflow, however small or large a row is.
    """
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    """Rows other than zero at length 1."""
    x = scaled(x)
    return x / np.sqrt((x**2).sum(1))[:, None]

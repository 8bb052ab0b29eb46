"""Bitmaps over integer positions.

A bitmap of a range of 32768 positions is built by Spark's bitmap_construct_agg: bit p % 8 of byte
p // 8 stands for position p. `pack` turns such a bitmap into a container that takes two bytes a
member while fewer than 2048 of the range are set, as roaring bitmaps do, and `minus` and `members`
work on these containers, a whole Arrow batch at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

RANGE_BITS = 32768
_SPARSE, _DENSE = b"\x01", b"\x00"
_SPARSE_BELOW = RANGE_BITS // 16


def _bits(container: bytes) -> np.ndarray:
    """0/1 by position."""
    if container[:1] == _DENSE:
        return np.unpackbits(np.frombuffer(container, np.uint8, offset=1), bitorder="little")
    bits = np.zeros(RANGE_BITS, np.uint8)
    bits[np.frombuffer(container, "<u2", offset=1)] = 1
    return bits


def _container(bits: np.ndarray) -> bytes:
    at = np.flatnonzero(bits)
    if len(at) < _SPARSE_BELOW:
        return _SPARSE + at.astype("<u2").tobytes()
    return _DENSE + np.packbits(bits, bitorder="little").tobytes()


@F.pandas_udf(T.BinaryType())
def pack(raw: pd.Series) -> pd.Series:
    """The container of a bitmap from bitmap_construct_agg; null for null."""
    return raw.map(lambda b: None if b is None else _container(np.unpackbits(np.frombuffer(b, np.uint8), bitorder="little")))


@F.pandas_udf(T.BinaryType())
def minus(a: pd.Series, b: pd.Series) -> pd.Series:
    """a AND NOT b of two containers; a missing b takes nothing away."""

    def one(x, y):
        if x is None or y is None:
            return x
        if x[:1] == _SPARSE:
            at = np.frombuffer(x, "<u2", offset=1)
            return _SPARSE + at[_bits(y)[at] == 0].tobytes()
        return _container(_bits(x) & ~_bits(y) & 1)

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype=object)


@F.pandas_udf(T.BinaryType())
def raw_minus(a: pd.Series, b: pd.Series) -> pd.Series:
    """a AND NOT b of two bitmaps from bitmap_construct_agg; a missing b takes nothing away."""
    return pd.Series(
        [x if x is None or y is None else (np.frombuffer(x, np.uint8) & ~np.frombuffer(y, np.uint8)).tobytes() for x, y in zip(a, b)], dtype=object
    )


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def members(container: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Positions set in a container, in order."""
    for batch in container:
        yield batch.map(lambda x: [] if x is None else np.flatnonzero(_bits(x)).astype(np.int32))


def bit_is_set(raw: Column, position: Column) -> Column:
    """Whether a bitmap from bitmap_construct_agg holds the position; false for a null bitmap."""
    byte = F.conv(F.hex(F.substring(raw, (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), position % 8).cast("int")) != 0, F.lit(False))

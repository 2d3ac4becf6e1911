"""Posting list codecs. Parquet's own encodings do the work in the index; these give the byte-exact formats.

The arrays of a batch are worked on end to end, never number by number.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T


def gaps(ids: Column, before: Column | int = 0) -> Column:
    """Differences of an ascending array, its first number to ``before``. Two arrays side by side: an array looked up
    inside a function would be made again for each of its numbers, if it is an expression."""
    earlier = F.slice(F.concat(F.array(F.lit(before)), ids), F.lit(1), F.size(ids))
    return F.zip_with(ids, earlier, lambda x, y: x - y)


def encoded_bytes(x: Column) -> Column:
    """Bytes a number takes in variable-byte form: one per 7 bits, at least one."""
    return F.greatest(F.lit(1), F.ceil(F.length(F.bin(x)) / 7)).cast("int")


def _flat(xs: pd.Series, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The arrays of a column end to end, and their lengths (0 for nulls)."""
    lengths = np.array([0 if a is None else len(a) for a in xs], np.int64)
    parts = [np.asarray(a, kind) for a in xs if a is not None and len(a)]
    return (np.concatenate(parts) if parts else np.zeros(0, kind)), lengths


def _cut(xs: pd.Series, flat, lengths: np.ndarray) -> pd.Series:
    """``flat`` cut into pieces of the lengths, null where ``xs`` is."""
    ends = np.cumsum(lengths)
    return pd.Series([None if a is None else flat[e - n : e] for a, e, n in zip(xs, ends.tolist(), lengths.tolist(), strict=True)], dtype=object)


def _sums(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of stretches of ``x`` that follow each other."""
    total = np.concatenate([[0], np.cumsum(x)])
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


@F.pandas_udf(T.ArrayType(T.LongType()))
def ungaps(xs: pd.Series) -> pd.Series:
    """Running sums of an array: the inverse of gaps()."""
    flat, lengths = _flat(xs, "int64")
    total = np.cumsum(flat)
    before = np.concatenate([[0], total])[np.cumsum(lengths) - lengths]
    return _cut(xs, total - np.repeat(before, lengths), lengths)


def vbyte(flat: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Big-endian base-128 bytes of numbers, the stop bit on the last byte of each, and how many each has."""
    size = np.ones(len(flat), np.int64)
    for k in range(1, 10):
        size += flat >= np.uint64(1 << 7 * k)
    out, last = np.zeros(int(size.sum()), np.uint8), np.cumsum(size) - 1
    for k in range(int(size.max(initial=0))):
        has = size > k
        out[last[has] - k] = (flat[has] >> np.uint64(7 * k)).astype(np.uint8) & 0x7F | (0 if k else 0x80)
    return out.tobytes(), size


@F.pandas_udf(T.BinaryType())
def vbyte_encode(xs: pd.Series) -> pd.Series:
    """array of non-negative integers -> big-endian base-128 bytes."""
    flat, lengths = _flat(xs, "uint64")
    coded, size = vbyte(flat)
    return _cut(xs, coded, _sums(size, lengths))


@F.pandas_udf(T.ArrayType(T.LongType()))
def vbyte_decode(bs: pd.Series) -> pd.Series:
    """The inverse of vbyte_encode()."""
    lengths = np.array([0 if b is None else len(b) for b in bs], np.int64)
    x = np.frombuffer(b"".join(b for b in bs if b is not None), np.uint8)
    stop = x >= 0x80
    if not len(x):
        return _cut(bs, np.zeros(0, np.int64), lengths)
    number = np.cumsum(stop) - stop  # which number a byte belongs to
    last = np.flatnonzero(stop)
    place = last[number] - np.arange(len(x))
    values = (x & 0x7F).astype(np.int64) << 7 * place
    return _cut(bs, np.add.reduceat(values, np.concatenate([[0], last[:-1] + 1])), _sums(stop.astype(np.int64), lengths))


@F.pandas_udf(T.BinaryType())
def fixed_encode(xs: pd.Series) -> pd.Series:
    """array of integers -> 4 little-endian bytes each."""
    flat, lengths = _flat(xs, "<u4")
    return _cut(xs, flat.tobytes(), 4 * lengths)


@F.pandas_udf(T.ArrayType(T.LongType()))
def fixed_decode(bs: pd.Series) -> pd.Series:
    """The inverse of fixed_encode()."""
    lengths = np.array([0 if b is None else len(b) for b in bs], np.int64)
    return _cut(bs, np.frombuffer(b"".join(b for b in bs if b is not None), "<u4").astype(np.int64), lengths // 4)

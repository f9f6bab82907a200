"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE_CHARS = " \t\n\x0b\x0c\r"


def ascii_lower(col: Column) -> Column:
    """Lower-case A-Z only (the locale and other letters stay untouched)."""
    return F.translate(col, _UPPER, _UPPER.lower())


def text_or_empty(name: str = "text") -> Column:
    """The text column with null read as the empty text."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def unit_hash(seed: int, *cols: Column) -> Column:
    """A reproducible uniform number in (0, 1): 52 bits of an md5 digest."""
    key = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(c.cast("string"), F.lit("null")) for c in cols])
    high = F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double")
    return (high + F.lit(0.5)) / F.lit(float(1 << 52))


def row_key(*cols: Column) -> Column:
    """64-bit key of a row's columns; used together with doc_id in joins."""
    return F.xxhash64(*cols)


def narrow(df: DataFrame, **cols: str) -> DataFrame:
    """Only the named columns, so that further columns can't clash: out_name=in_name."""
    return df.select(*[F.col(src).alias(dst) for dst, src in cols.items()])


def repeat_ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of the concatenated ranges [start, start + length)."""
    total = int(lengths.sum())
    if total == 0:
        return np.zeros(0, dtype=np.int64)
    ends = np.cumsum(lengths)
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)

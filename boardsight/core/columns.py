"""Columns computed once, and key columns as numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def once(df: DataFrame, cols: dict[str, Column]) -> DataFrame:
    """``df`` with ``cols``, computed where they stand.

    A filter on a computed column is pushed below it with the whole expression
    copied in; over parsed bytes that doubles the work at each step until the
    generated code no longer compiles. A one-row generator is where filters
    stop.
    """
    kept = [c for c in df.columns if c not in cols]
    return df.select(*kept, F.inline(F.array(F.struct(*[c.alias(n) for n, c in cols.items()]))))


def group_codes(table: pa.Table, keys: list[str]) -> np.ndarray:
    """A number per row, from 0 on, equal where ``keys`` are; null equals null."""
    codes = np.zeros(table.num_rows, np.int64)
    for k in keys:
        own = table[k].combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy().astype(np.int64)
        codes = np.unique(codes * (own.max(initial=0) + 1) + own, return_inverse=True)[1]
    return codes

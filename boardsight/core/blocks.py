"""Sliding windows over long series: rows are dealt into blocks of an integer
index, each block also getting the rows its edges look at, so a window never
needs a whole series in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, WindowSpec, functions as F

ROWS_PER_BLOCK = 1_000_000


def in_blocks(df: DataFrame, keys: list[str], index: str, halo: int,
              per_block: int = ROWS_PER_BLOCK) -> tuple[DataFrame, WindowSpec]:
    """(rows with their block, the window within it). Rows lent to another
    block have ``_own`` false; filter on it once the windows are computed."""
    i = F.col(index)
    at = lambda shift: F.floor((i + shift) / per_block).cast("long")
    dealt = df.withColumn("_block", F.explode(F.sequence(at(-halo), at(halo))))
    dealt = dealt.withColumn("_own", F.col("_block") == at(0))
    return dealt, W.partitionBy(*keys, "_block").orderBy(index)


def own_rows(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_own", "_block")

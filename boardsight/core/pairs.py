"""Rows tried against rows, where no key narrows which may meet.

Rows are dealt into blocks of bounded size, and a task holds two blocks at a time, whatever the table's size.
Tries grow with the square of the rows that may meet, so a try should be a few instructions in numpy.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from boardsight.core.runtime import cut

ROWS_IN_A_BLOCK = 4_096


def deal(rows: DataFrame, by: list[str | Column], rows_in_a_block: int = ROWS_IN_A_BLOCK) -> DataFrame:
    """``rows``, written, with their ``_block``: of about so many rows each, and rows alike in ``by`` in one or neighbouring blocks."""
    n = max(1, -(-rows.count() // rows_in_a_block))
    # the hash last, so that rows equal in ``by`` are still dealt evenly
    return cut(rows.repartitionByRange(n, *by, F.xxhash64(*rows.columns)).withColumn("_block", F.spark_partition_id()))


def try_pairs(blocks: DataFrame, pairs: DataFrame, tries: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: T.StructType) -> DataFrame:
    """``tries(left, right)`` over the blocks of each row (_i, _j) of ``pairs``."""
    # by number, for few bytes are much work and must not meet in few tasks
    tasks = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def side(end: str) -> DataFrame:
        met = blocks.join(pairs, F.col("_block") == F.col(end)).drop("_block")
        return met.select(*[F.col(c).alias(c) for c in met.columns]).repartition(tasks, "_i", "_j")  # new columns, for both sides come of one table
    return side("_i").groupBy("_i", "_j").cogroup(side("_j").groupBy("_i", "_j")).applyInPandas(tries, schema)

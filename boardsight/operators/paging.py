"""Order, pages and top-k."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from boardsight.core.ordered import ROWS_PER_SLICE, Ordered
from boardsight.sources.signals import time_range

DEFAULT_SIZE = 1000


def normalise(page: int, size: int) -> tuple[int, int]:
    """Page at least 1, size within 1..1000."""
    return max(1, page), min(max(1, size), DEFAULT_SIZE)


def _sorted(df: DataFrame, order: list[str], direction: str) -> DataFrame:
    return df.orderBy(*[F.col(c).asc() if direction == "asc" else F.col(c).desc() for c in order])


def newest_first(df: DataFrame, ts: str, tie: str | None = None) -> DataFrame:
    """L1."""
    return _sorted(df, [ts, tie] if tie else [ts], "desc")


def skip_take(df: DataFrame, order: list[Column | str], skip: int, take: int) -> DataFrame:
    """Rows ``skip .. skip + take`` of a stated order."""
    if not order:
        raise ValueError("paging needs an order")
    return df.orderBy(*order).offset(skip).limit(take)


def time_page(df: DataFrame, ts: str, id: str, start, end, order: str = "asc",
              page: int = 1, size: int = DEFAULT_SIZE) -> DataFrame:
    """L2: one page of a closed time range, ties broken by id."""
    rows = _sorted(time_range(df, ts, start, end), [ts, id], order)
    return rows.offset(max(0, (page - 1) * size)).limit(size)


def gap_filter(df: DataFrame, ts: str, id: str, interval_ms: int, keys: list[str] = (),
               order: str = "asc", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Keep a row with no row before it, or at least ``interval_ms`` after
    the row before it (kept or not), in the given direction."""
    if interval_ms < 0:
        raise ValueError("interval must be >= 0")
    seen = Ordered(df, list(keys), [ts, id], rows_per_slice)
    seen = seen.lag(_near=ts) if order == "asc" else seen.lead(_near=ts)
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    gap = F.abs(us(ts) - us("_near"))
    return seen.done().filter(F.col("_near").isNull() | (gap >= interval_ms * 1000)).drop("_near")


def interval_page(df: DataFrame, ts: str, id: str, start, end, interval_ms: int, keys: list[str] = (),
                  order: str = "asc", page: int = 1, size: int = DEFAULT_SIZE) -> DataFrame:
    """L3: W1 over a half-open range, then one page of it."""
    page, size = max(1, page), size if size > 0 else DEFAULT_SIZE
    kept = gap_filter(time_range(df, ts, start, end, closed="left"), ts, id, interval_ms, keys, order)
    return _sorted(kept, [ts, id], order).offset((page - 1) * size).limit(size)


def paginate(df: DataFrame, page: int, size: int, ts: str = "timestamp", id: str = "id") -> tuple[DataFrame, dict]:
    """L4: newest-first page of entities, and the totals around it."""
    page, size = normalise(page, size)
    total = df.count()
    pages = math.ceil(total / size)
    items = df.orderBy(F.col(ts).desc(), F.col(id)).offset((page - 1) * size).limit(size)
    return items, {"page": page, "size": size, "total": total, "pages": pages,
                   "has_previous": page > 1, "has_next": page < pages}


def page_counts(df: DataFrame, size: int, keys: list[str] = ()) -> DataFrame:
    """L4: totals and page counts per key, for many listings at once."""
    _, size = normalise(1, size)
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("total")).withColumn(
        "pages", F.ceil(F.col("total") / size))


def board_rank_order(df: DataFrame) -> DataFrame:
    """By board, no board last, then rank."""
    return df.orderBy(F.col("camera_alias").asc_nulls_last(), "rank")


def last_n(df: DataFrame, keys: list[str], ts: str, n: int = 20, tie: list[str] = (),
           rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The newest n rows per key."""
    marked = df.withColumn("_neg", -_micros(df, ts))
    ranked = Ordered(marked, keys, ["_neg", *tie], rows_per_slice).row_number("_rn").done()
    return ranked.filter(F.col("_rn") <= n).drop("_rn", "_neg")


def _micros(df: DataFrame, ts: str) -> Column:
    name = df.schema[ts].dataType.typeName()
    return F.unix_micros(F.col(ts).cast("timestamp")) if name.startswith("timestamp") else F.col(ts).cast("double")

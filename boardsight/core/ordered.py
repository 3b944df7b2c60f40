"""Ordered work per key that survives one key holding most of the rows.

A plain ``Window.partitionBy(key)`` puts a whole key in one task. Here a count
per key (partial aggregation, so cheap) decides: with no key above
``rows_per_slice`` the plain window is used; otherwise the hot keys are cut
into time slices at quantiles of the order column. Windows then run per
(key, slice), and what a slice needs from the ones before it, its carry, comes
from one summary row per (key, slice). Numbers and times are cut at quantiles;
texts, structs and very many slices by a range sort, which cuts any order.
"""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from boardsight.core.runtime import cut

ROWS_PER_SLICE = 2_000_000
QUANTILES = 8192  # cuts asked for at once; beyond them a range sort makes the slices
SMALL_TABLE = 50_000  # rows a broadcast may hold, checked by a count

SLICE = "_slice"


def same_keys(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    """Null-safe equality over ``keys``; true when there are none."""
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join on ``keys`` where null equals null; the right keys are dropped."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    out = left.join(renamed, cond, how)
    return out.drop(*[f"_r_{k}" for k in keys])


def as_number(df: DataFrame, name: str) -> Column | None:
    """The order column as a double: microseconds for timestamps. None for what is no number."""
    kind = df.schema[name].dataType
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(F.col(name).cast("timestamp")).cast("double")
    if isinstance(kind, T.DateType):
        return F.unix_date(F.col(name)).cast("double")
    return F.col(name).cast("double") if isinstance(kind, T.NumericType) else None


def broadcast_if_small(df: DataFrame, limit: int = SMALL_TABLE) -> DataFrame:
    """Hint a broadcast only when a count proves the side small; a bigger side
    is left to the optimizer's shuffle join."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def hot_keys(df: DataFrame, keys: list[str], limit: int) -> tuple[DataFrame, int, int]:
    """Keys with more than ``limit`` rows, how many, and their rows in all."""
    hot = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > limit)
    found = hot.agg(F.count(F.lit(1)).alias("k"), F.sum("_n").alias("n")).first()
    return hot, found["k"], found["n"] or 0


def slice_hot(df: DataFrame, keys: list[str], order: str,
              rows_per_slice: int = ROWS_PER_SLICE) -> tuple[DataFrame, bool]:
    """``df`` with a ``_slice`` column, and whether any key had to be cut.

    Slices grow with the order column and rows with equal order values share
    one, so (slice, order, tie-break) sorts as (order, tie-break) does.
    """
    hot, n_hot, rows = hot_keys(df, keys, rows_per_slice)
    if not n_hot:
        return df.withColumn(SLICE, F.lit(0)), False
    marks = hot.select(*keys, F.lit(True).alias("_hot"))
    if n_hot <= SMALL_TABLE:
        marks = F.broadcast(marks)
    flagged = (null_safe_join(df, marks, keys, "left") if keys
               else df.withColumn("_hot", F.lit(True)))
    at, n = as_number(df, order), max(2, -(-2 * rows // rows_per_slice))
    if at is None or n > QUANTILES:
        # rows of equal order value meet in one partition, and later partitions hold greater values;
        # written, so that the numbers hold
        sorted_ = cut(flagged.filter("_hot").repartitionByRange(n, F.col(order).asc_nulls_first()).withColumn(SLICE, F.spark_partition_id()))
        return sorted_.unionByName(flagged.filter("_hot IS NULL").withColumn(SLICE, F.lit(0))).drop("_hot"), True
    flagged = flagged.withColumn("_at", at)
    cuts = flagged.filter("_hot").approxQuantile("_at", [i / n for i in range(1, n)], 1 / (4 * n))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    placed = Bucketizer(splits=splits, inputCol="_at", outputCol="_bin", handleInvalid="keep").transform(flagged)
    placed = placed.withColumn(SLICE, F.when(F.col("_hot"), F.col("_bin").cast("int")).otherwise(F.lit(0)))
    return placed.drop("_hot", "_at", "_bin"), True


class Ordered:
    """Window columns over rows ordered within keys, hot keys included.

    ``order`` is a list of column names, the first one being what hot keys are
    sliced on; the rest break ties.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str],
                 rows_per_slice: int = ROWS_PER_SLICE):
        self.keys, self.order = list(keys), list(order)
        self.df, self.sliced = slice_hot(df, self.keys, order[0], rows_per_slice)
        by = [*self.keys, SLICE] if self.sliced else (self.keys or [F.lit(0)])
        self.window = W.partitionBy(*by).orderBy(*self.order)

    def _carry(self, aggs: list[Column], carried: list[Column]) -> DataFrame:
        """One row per (keys, slice): ``aggs`` of the slice, then ``carried``
        window expressions over the slices of the key."""
        per_slice = self.df.groupBy(*self.keys, SLICE).agg(*aggs)
        return per_slice.select(*self.keys, SLICE, *carried)

    def _across(self, forward: bool = True):
        order = F.col(SLICE).asc() if forward else F.col(SLICE).desc()
        return W.partitionBy(*(self.keys or [F.lit(0)])).orderBy(order)

    def _join(self, carry: DataFrame) -> None:
        self.df = null_safe_join(self.df, carry, [*self.keys, SLICE], "left")

    def _neighbour(self, cols: dict[str, str | Column], back: bool) -> "Ordered":
        step = F.lag if back else F.lead
        cols = {o: F.col(c) if isinstance(c, str) else c for o, c in cols.items()}
        plain = {o: step(c).over(self.window) for o, c in cols.items()}
        if not self.sliced:
            self.df = self.df.withColumns(plain)
            return self
        pick = F.max_by if back else F.min_by
        packed = F.struct(*[c.alias(o) for o, c in cols.items()])
        carry = self._carry(
            [pick(packed, F.struct(*self.order)).alias("_edge")],
            [F.lag("_edge").over(self._across(back)).alias("_edge")])
        inner = self.df.withColumns({
            **plain, "_end": step(F.lit(1)).over(self.window).isNull()})
        self.df = inner
        self._join(carry)
        self.df = self.df.withColumns({
            o: F.when(F.col("_end"), F.col("_edge")[o]).otherwise(F.col(o)) for o in cols
        }).drop("_end", "_edge")
        return self

    def lag(self, **cols: str | Column) -> "Ordered":
        return self._neighbour(cols, True)

    def lead(self, **cols: str | Column) -> "Ordered":
        return self._neighbour(cols, False)

    def _running(self, name: str, value: Column, agg, merge, start: Column | None) -> "Ordered":
        frame = self.window.rowsBetween(W.unboundedPreceding, W.currentRow)
        if not self.sliced:
            self.df = self.df.withColumn(name, agg(value).over(frame))
            return self
        before = self._across().rowsBetween(W.unboundedPreceding, -1)
        carry = self._carry([agg(value).alias("_part")], [agg(F.col("_part")).over(before).alias("_before")])
        self.df = self.df.withColumn(name, agg(value).over(frame))
        self._join(carry)
        prior = F.col("_before") if start is None else F.coalesce(F.col("_before"), start)
        self.df = self.df.withColumn(name, merge(F.col(name), prior)).drop("_before")
        return self

    def running_sum(self, name: str, value: Column) -> "Ordered":
        return self._running(name, value, F.sum, lambda a, b: a + b, F.lit(0))

    def running_max(self, name: str, value: Column) -> "Ordered":
        return self._running(name, value, F.max, F.greatest, None)

    def running_min(self, name: str, value: Column) -> "Ordered":
        return self._running(name, value, F.min, F.least, None)

    def row_number(self, name: str) -> "Ordered":
        if not self.sliced:
            self.df = self.df.withColumn(name, F.row_number().over(self.window).cast("long"))
            return self
        before = self._across().rowsBetween(W.unboundedPreceding, -1)
        carry = self._carry([F.count(F.lit(1)).alias("_n")],
                            [F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")])
        self.df = self.df.withColumn(name, F.row_number().over(self.window).cast("long"))
        self._join(carry)
        self.df = self.df.withColumn(name, F.col(name) + F.col("_before")).drop("_before")
        return self

    def last_known(self, name: str, value: Column) -> "Ordered":
        """The latest non-null ``value`` up to and including the row."""
        frame = self.window.rowsBetween(W.unboundedPreceding, W.currentRow)
        if not self.sliced:
            self.df = self.df.withColumn(name, F.last(value, ignorenulls=True).over(frame))
            return self
        before = self._across().rowsBetween(W.unboundedPreceding, -1)
        carry = self._carry(
            [F.max_by(value, F.when(value.isNotNull(), F.struct(*self.order))).alias("_tail")],
            [F.last("_tail", ignorenulls=True).over(before).alias("_tail")])
        self.df = self.df.withColumn(name, F.last(value, ignorenulls=True).over(frame))
        self._join(carry)
        self.df = self.df.withColumn(name, F.coalesce(F.col(name), F.col("_tail"))).drop("_tail")
        return self

    def done(self) -> DataFrame:
        return self.df.drop(SLICE)


Fold = Callable[[object, pd.DataFrame], tuple[pd.DataFrame, object]]


def fold_in_order(df: DataFrame, keys: list[str], order: list[str], fold: Fold,
                  schema: T.StructType, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Run a sequential rule over each key's rows, in order, in bounded tasks.

    ``fold(state, rows)`` gets the state after the rows before (None at the
    start) and returns its output rows and the state after. The state must be
    plain JSON. Hot keys are folded slice by slice in parallel from a guessed
    state; slices whose true incoming state turns out different are folded
    again until none is left. Every round settles at least one more slice of
    each key, so the result is exact; rules that soon forget where they started
    settle in two or three rounds.
    """
    placed, sliced = slice_hot(df, keys, order[0], rows_per_slice)
    if not sliced:
        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            return fold(None, pdf.sort_values(order, ignore_index=True))[0]
        return placed.drop(SLICE).groupBy(*keys).applyInPandas(whole, schema)

    parts = [*keys, SLICE]
    placed = cut(placed)
    state_schema = T.StructType([placed.schema[c] for c in parts] + [T.StructField("_out", T.StringType())])

    def first_state(pdf: pd.DataFrame) -> pd.DataFrame:
        state = fold(None, pdf.sort_values(order, ignore_index=True))[1]
        return pdf[parts].head(1).assign(_out=json.dumps(state))

    def state_of(text) -> object:
        return None if text is None or pd.isna(text) else json.loads(text)

    def next_state(pdf: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or came.empty:
            return pd.DataFrame({f.name: [] for f in state_schema})
        state = fold(state_of(came["_in"].iloc[0]), pdf.sort_values(order, ignore_index=True))[1]
        return pdf[parts].head(1).assign(_out=json.dumps(state))

    def rows_out(pdf: pd.DataFrame, came: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame({f.name: [] for f in schema})
        text = came["_in"].iloc[0] if len(came) else None
        return fold(state_of(text), pdf.sort_values(order, ignore_index=True))[0]

    across = W.partitionBy(*keys).orderBy(SLICE) if keys else W.partitionBy(F.lit(0)).orderBy(SLICE)
    states = cut(placed.groupBy(*parts).applyInPandas(first_state, state_schema)
                 .withColumn("_used", F.lit(None).cast("string")))
    while True:
        incoming = states.withColumn("_in", F.lag("_out").over(across))
        stale = cut(incoming.filter(~F.col("_in").eqNullSafe(F.col("_used"))).select(*parts, "_in"))
        if stale.isEmpty():
            break
        redo = null_safe_join(placed, broadcast_if_small(stale.select(*parts)), parts, "left_semi")
        fresh = (redo.groupBy(*parts).cogroup(stale.groupBy(*parts))
                 .applyInPandas(next_state, state_schema))
        fresh = null_safe_join(fresh, stale, parts).withColumnRenamed("_in", "_used")
        kept = null_safe_join(states, stale.select(*parts), parts, "left_anti")
        states = cut(kept.unionByName(fresh))
    came = states.select(*parts, F.lag("_out").over(across).alias("_in"))
    return placed.groupBy(*parts).cogroup(came.groupBy(*parts)).applyInPandas(rows_out, schema)

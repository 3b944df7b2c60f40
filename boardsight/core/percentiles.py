"""Exact percentiles with linear interpolation, for groups of any size."""

from __future__ import annotations

from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from boardsight.core.ordered import SMALL_TABLE, hot_keys, null_safe_join

ROWS_IN_ONE_STATE = 2_000_000
ROWS_IN_A_BIN = 500_000


def percentiles(df: DataFrame, keys: list[str], value: str, probs: dict[str, float],
                rows_in_one_state: int = ROWS_IN_ONE_STATE, extra: list[Column] | None = None) -> DataFrame:
    """Per key, the exact percentiles ``{output name: probability}`` of ``value``
    and any ``extra`` aggregates.

    The built-in ``percentile`` keeps all of a group's values in one state, so
    it serves the groups a count proves small. Larger ones are ranked: values
    are cut into bins at global quantiles, each (group, bin) is ranked on its
    own, and the wanted ranks are looked up.
    """
    extra = extra or []
    rows = df.filter(F.col(value).isNotNull())
    hot, n_hot, n_rows = hot_keys(rows, keys, rows_in_one_state)
    builtin = [F.percentile(F.col(value), F.array(*[F.lit(p) for p in probs.values()])).alias("_ps")]  # one state for all

    def apart(found: DataFrame) -> DataFrame:
        rest = [c for c in found.columns if c not in (*keys, "_ps")]
        return found.select(*keys, *[F.get("_ps", F.lit(i)).alias(o) for i, o in enumerate(probs)], *rest)

    if not n_hot:
        return apart(df.groupBy(*keys).agg(*builtin, *extra))
    marks = hot.select(*keys, F.lit(True).alias("_hot"))
    if not keys:
        return _ranked(rows, keys, value, probs, n_rows).crossJoin(df.agg(*extra)) if extra else _ranked(rows, keys, value, probs, n_rows)
    if n_hot <= SMALL_TABLE:
        marks = F.broadcast(marks)
    flagged = null_safe_join(rows, marks, keys, "left")
    cold = flagged.filter(F.col("_hot").isNull()).groupBy(*keys).agg(*builtin)
    cold = apart(cold)
    warm = _ranked(flagged.filter("_hot").drop("_hot"), keys, value, probs, n_rows)
    found = cold.unionByName(warm)
    if not extra:
        return null_safe_join(df.select(*keys).distinct(), found, keys, "left")
    return null_safe_join(df.groupBy(*keys).agg(*extra), found, keys, "left").select(*keys, *probs, *_names(df, extra, keys))


def _names(df: DataFrame, extra: list[Column], keys: list[str]) -> list[str]:
    return [c for c in df.groupBy(*keys).agg(*extra).columns if c not in keys]


def _ranked(rows: DataFrame, keys: list[str], value: str, probs: dict[str, float], n_rows: int) -> DataFrame:
    """``n_rows`` in all set the number of bins, so that a bin holds about as many rows at any size."""
    bins = max(64, 2 * n_rows // ROWS_IN_A_BIN)
    at = rows.select(*keys, F.col(value).cast("double").alias("_v"))
    cuts = at.approxQuantile("_v", [i / bins for i in range(1, bins)], 1 / (2 * bins))
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    binned = Bucketizer(splits=splits, inputCol="_v", outputCol="_bin", handleInvalid="keep").transform(at)
    # equal values collapse before the ranking, so ties never pile up in a task
    ties = binned.groupBy(*keys, "_bin", "_v").agg(F.count(F.lit(1)).alias("_c"))
    by_bin = binned.groupBy(*keys, "_bin").agg(F.count(F.lit(1)).alias("_c"))
    group = W.partitionBy(*(keys or [F.lit(0)]))
    offsets = by_bin.select(
        *keys, "_bin",
        F.coalesce(F.sum("_c").over(group.orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.sum("_c").over(group).alias("_n"))
    ranked = null_safe_join(ties, offsets, [*keys, "_bin"]).withColumn(
        "_hi", F.col("_before") + F.sum("_c").over(W.partitionBy(*keys, "_bin").orderBy("_v")))
    ranked = ranked.withColumn("_lo", F.col("_hi") - F.col("_c"))

    def holds(rank: Column) -> Column:
        return (F.col("_lo") <= rank) & (rank < F.col("_hi"))

    aggs, needed = [], []
    for i, p in enumerate(probs.values()):
        spot = F.lit(p) * (F.col("_n") - 1)
        low, high = holds(F.floor(spot)), holds(F.ceil(spot))
        needed.append(low | high)
        aggs += [F.max(F.when(low, F.col("_v"))).alias(f"_a{i}"), F.max(F.when(high, F.col("_v"))).alias(f"_b{i}")]
    wanted = ranked.filter(reduce(lambda a, b: a | b, needed))
    found = wanted.groupBy(*keys).agg(*aggs, F.max("_n").alias("_n"))
    out = []
    for i, (name, p) in enumerate(probs.items()):
        spot = F.lit(p) * (F.col("_n") - 1)
        out.append((F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * (spot - F.floor(spot))).alias(name))
    return found.select(*keys, *out)

"""Table maintenance."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from boardsight.core.ordered import null_safe_join


def append(table: DataFrame, rows: DataFrame) -> DataFrame:
    """D1."""
    return table.unionByName(rows)


def first_per_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key, the first in ``order``, by a partial aggregate."""
    rest = [c for c in rows.columns if c not in keys]
    return (rows.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_row"))
            .select(*keys, "_row.*").select(rows.columns))


def insert_absent(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The table with the rows whose key it lacks; the first of several new
    rows with one key wins."""
    fresh = first_per_key(rows, keys, order).join(table.select(*keys).distinct(), keys, "left_anti")
    return table.unionByName(fresh.select(table.columns))


def idempotent_insert(table: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """D3: as ``insert_absent`` on the last key column; a null key never matches
    anything, so those rows all go in."""
    keyed = insert_absent(table, rows.filter(F.col(keys[-1]).isNotNull()), keys, order)
    return keyed.unionByName(rows.filter(F.col(keys[-1]).isNull()).select(table.columns))


def stored_row(table: DataFrame, rows: DataFrame, keys: list[str], id: str, order: list[str]) -> DataFrame:
    """D3: for each incoming row the id it ends up as: the stored one's when its
    key repeats, else its own."""
    known = (table.select(*keys, F.lit(0).alias("_new"), F.struct(*order).alias("_o"), F.col(id).alias("_id"))
             .unionByName(rows.select(*keys, F.lit(1).alias("_new"), F.struct(*order).alias("_o"), F.col(id).alias("_id"))))
    owner = (known.filter(F.col(keys[-1]).isNotNull()).groupBy(*keys)
             .agg(F.min_by("_id", F.struct("_new", "_o")).alias("_owner")))
    return rows.join(owner, keys, "left").withColumn("stored_id", F.coalesce("_owner", F.col(id))).drop("_owner")


def patch(table: DataFrame, changes: DataFrame, key: str, version: str,
          cols: list[str] = ("start_time", "end_time", "description")) -> DataFrame:
    """Each changed column takes its last non-null change; the rest stay."""
    last = changes.groupBy(key).agg(*[
        F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(version))).alias(f"_{c}") for c in cols])
    joined = table.join(last, key, "left")
    return joined.withColumns({c: F.coalesce(f"_{c}", c) for c in cols}).select(table.columns)


def soft_delete(table: DataFrame, deletes: DataFrame, key: str = "id") -> DataFrame:
    """Rows in the delete log are marked; a mark set before stays."""
    gone = deletes.groupBy(key).agg(F.min("deleted_at").alias("_at"))
    return table.join(gone, key, "left").withColumn("deleted_at", F.coalesce("deleted_at", "_at")).drop("_at")


def unique_violations(df: DataFrame, rule: str, key: list[Column], where: Column | None = None) -> DataFrame:
    """Keys borne by more than one row, as (rule, key, rows)."""
    rows = df if where is None else df.filter(where)
    text = F.concat_ws("|", *[F.coalesce(k.cast("string"), F.lit("")) for k in key])
    return (rows.groupBy(text.alias("key")).agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
            .select(F.lit(rule).alias("rule"), "key", "rows"))


def audit_constraints(sessions: DataFrame, holes: DataFrame, runs: DataFrame, cameras: DataFrame) -> DataFrame:
    """Every broken constraint of the four tables in one table."""
    c = F.col
    active = c("status") == "active"
    checks = [
        unique_violations(sessions.filter(active), "one active session", [F.lit("active")]),
        unique_violations(holes, "hole key", [c("session_id"), c("idempotency_key")], c("idempotency_key").isNotNull()),
        unique_violations(runs, "run start", [c("session_id"), c("camera_alias"), c("taken_at")]),
        unique_violations(cameras, "camera alias", [F.lower(c("alias"))]),
        sessions.filter(~c("status").isin("active", "completed") | c("status").isNull())
        .groupBy(F.coalesce("status", F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("rows"))
        .select(F.lit("session status").alias("rule"), "key", "rows"),
    ]
    return reduce(lambda a, b: a.unionByName(b), checks)


def missing_parents(child: DataFrame, parent: DataFrame, fk: str, key: str, rule: str) -> DataFrame:
    """Children that name a parent that is not there, counted per key."""
    lost = null_safe_join(child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias(key)).agg(F.count(F.lit(1)).alias("rows")),
                          parent.select(key).distinct(), [key], "left_anti")
    return lost.select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"), "rows")

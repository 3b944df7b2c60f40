"""Group statistics, board canvases and their exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boardsight.core.ordered import null_safe_join
from boardsight.core.percentiles import ROWS_IN_ONE_STATE, percentiles
from boardsight.functions import text as tx
from boardsight.functions.geometry import ARTWORK_HEIGHT, ARTWORK_WIDTH
from boardsight.operators.spatial import spread

BOARD = ["session_id", "camera_alias"]


def group_stats(df: DataFrame, keys: list[str], x: str = "x_mm", y: str = "y_mm",
                rows_in_one_state: int = ROWS_IN_ONE_STATE) -> DataFrame:
    """A3: per key n, mean point of impact, CEP, mean radius, RMS radius and
    extreme spread; the four spread measures are null for one point.

    The means come from a partial aggregate joined back, so points are not
    sorted or windowed; CEP is an exact median that never holds a huge group in
    one state; the spread never pairs all points.
    """
    pts = df.select(*keys, F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")).filter("_x is not null and _y is not null")
    centre = pts.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg("_x").alias("mpi_x_mm"), F.avg("_y").alias("mpi_y_mm"))
    radii = null_safe_join(pts, centre.select(*keys, "mpi_x_mm", "mpi_y_mm"), keys).select(
        *keys, F.hypot(F.col("_x") - F.col("mpi_x_mm"), F.col("_y") - F.col("mpi_y_mm")).alias("_r"))
    round_ = percentiles(radii, keys, "_r", {"cep_mm": 0.5}, rows_in_one_state,
                         extra=[F.avg("_r").alias("mean_radius_mm"), F.sqrt(F.avg(F.col("_r") * F.col("_r"))).alias("rms_radius_mm")])
    far = spread(pts, keys, "_x", "_y").withColumnRenamed("extreme_spread", "extreme_spread_mm")
    out = null_safe_join(null_safe_join(centre, round_, keys), far, keys)
    several = lambda c: F.when(F.col("n") >= 2, F.col(c)).alias(c)
    return out.select(*keys, "n", "mpi_x_mm", "mpi_y_mm", several("cep_mm"), several("mean_radius_mm"),
                      several("rms_radius_mm"), several("extreme_spread_mm"))


def in_group() -> "F.Column":
    return F.col("target_index").isNotNull() & F.col("x_mm").isNotNull() & F.col("y_mm").isNotNull()


def hole_groups(holes: DataFrame, keys: list[str] = BOARD) -> DataFrame:
    """A3 over holes with a target and a position."""
    return group_stats(holes.filter(in_group()), [*keys, "target_index"])


def exclusions(df: DataFrame, keys: list[str] = BOARD) -> DataFrame:
    """A4: holes in no group per board: misses (the model's, on no target) and
    those without a position."""
    miss = ~in_group() & F.col("target_index").isNull() & (F.col("source") == "model")
    return df.groupBy(*keys).agg(F.count_if(miss).alias("misses"), F.count_if(~in_group() & ~F.coalesce(miss, F.lit(False))).alias("without_position"))


def misses(df: DataFrame, keys: list[str] = BOARD) -> DataFrame:
    """A5: holes on no target, whatever their source."""
    return df.groupBy(*keys).agg(F.count_if(F.col("target_index").isNull()).alias("misses"))


def order_boards(df: DataFrame) -> DataFrame:
    """Alias order, no board last."""
    return df.orderBy(F.col("camera_alias").asc_nulls_last())


def canvas_bounds(df: DataFrame, keys: list[str] = BOARD, x: str = "position_x", y: str = "position_y") -> DataFrame:
    """The artwork box widened to hold every shot, and where the artwork
    lies in it, percent."""
    b = df.groupBy(*keys).agg(
        F.least(F.lit(0.0), F.min(x)).alias("min_x"), F.greatest(F.lit(ARTWORK_WIDTH), F.max(x)).alias("max_x"),
        F.least(F.lit(0.0), F.min(y)).alias("min_y"), F.greatest(F.lit(ARTWORK_HEIGHT), F.max(y)).alias("max_y"))
    b = b.withColumns({"cw": F.col("max_x") - F.col("min_x"), "ch": F.col("max_y") - F.col("min_y")})
    return b.withColumns({
        "pad_pct": F.col("ch") / F.col("cw") * 100,
        "img_left": -F.col("min_x") / F.col("cw") * 100, "img_top": -F.col("min_y") / F.col("ch") * 100,
        "img_width": F.lit(ARTWORK_WIDTH) / F.col("cw") * 100, "img_height": F.lit(ARTWORK_HEIGHT) / F.col("ch") * 100,
    }).drop("max_x", "max_y")


def canvas_percent(df: DataFrame, bounds: DataFrame, keys: list[str] = BOARD, x: str = "position_x", y: str = "position_y") -> DataFrame:
    """Each hole's place on its board's canvas, percent."""
    joined = null_safe_join(df, bounds.select(*keys, "min_x", "min_y", "cw", "ch"), keys)
    return joined.withColumns({
        "left_pct": (F.col(x) - F.col("min_x")) / F.col("cw") * 100,
        "top_pct": (F.col(y) - F.col("min_y")) / F.col("ch") * 100}).drop("min_x", "min_y", "cw", "ch")


STATS = ["n", "mpi_x_mm", "mpi_y_mm", "cep_mm", "mean_radius_mm", "rms_radius_mm", "extreme_spread_mm"]


def export_groups(holes: DataFrame, keys: list[str] = BOARD) -> DataFrame:
    """Per board one row per target, then its misses and its holes without
    a position, in that order (``line``)."""
    groups = hole_groups(holes, keys).select(
        *keys, F.col("target_index").cast("long").alias("line"),
        F.concat(F.lit("Target "), (F.col("target_index") + 1).cast("string")).alias("target"), *STATS)
    left = exclusions(holes, keys)
    rest = left.select(*keys, F.explode(F.array(
        F.struct(F.lit(2 ** 40).alias("line"), F.lit("Misses").alias("target"), F.col("misses").alias("n")),
        F.struct(F.lit(2 ** 40 + 1).alias("line"), F.lit("Without a position").alias("target"), F.col("without_position").alias("n")))).alias("_r")).select(*keys, "_r.*")
    return groups.unionByName(rest, allowMissingColumns=True)


def to_payload(df: DataFrame) -> DataFrame:
    """The JSON a confirmed hole is published as, with its derived key."""
    key = tx.x_derived_key(F.col("session_id"), F.col("camera"), F.col("first_frame"), F.col("x"), F.col("y"))
    body = F.struct(
        F.lit("v2").alias("version"), "camera", tx.x_iso_ms(F.col("first_seen_at")).alias("first_seen_at"),
        F.struct("x", "y").alias("position"), "target_index", "x_mm", "y_mm", F.lit("model").alias("source"),
        key.alias("idempotency_key"))
    return df.withColumns({"idempotency_key": key, "payload": F.to_json(body, {"ignoreNullFields": "false"})})

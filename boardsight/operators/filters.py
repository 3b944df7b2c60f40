"""Predicates and classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from boardsight.core.ordered import null_safe_join
from boardsight.sources.signals import split_valid


def not_deleted(df: DataFrame) -> DataFrame:
    """F3."""
    return df.filter(F.col("deleted_at").isNull())


def same_board(a: Column, b: Column) -> Column:
    """equal aliases, or no board on both sides."""
    return a.eqNullSafe(b)


def is_due(frame: Column, stride: int, baseline: int) -> Column:
    return (frame < baseline) | (frame % stride == 0)


def due_frames(df: DataFrame, frame: str, stride: int, baseline: int = 5) -> DataFrame:
    """frames a look is due on."""
    return df.filter(is_due(F.col(frame), stride, baseline))


def sample_every(df: DataFrame, frame: str, fps: Column | float, step_s: float) -> DataFrame:
    """every ``max(1, round(fps * step))``-th frame, halves to even."""
    rate = fps if isinstance(fps, Column) else F.lit(float(fps))
    step = F.greatest(F.lit(1), F.bround(rate * step_s, 0).cast("long"))
    return df.filter(F.col(frame) % step == 0)


def finite(df: DataFrame, cols: list[str]) -> DataFrame:
    """F9."""
    ok = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in cols]
    return df.filter(reduce(lambda a, b: a & b, ok))


def admit(holes: DataFrame, sessions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, refused with a reason). The model may not add to a
    completed session, the operator not to an active one."""
    status = sessions.select(F.col("id").alias("session_id"), F.col("status").alias("_status"))
    joined = holes.join(status, "session_id", "left")
    ok, refused = split_valid(joined, {
        "no such session": F.col("_status").isNull(),
        "session is completed": (F.col("source") == "model") & (F.col("_status") == "completed"),
        "session is still active": (F.col("source") == "manual") & (F.col("_status") == "active"),
    })
    return ok.drop("_status"), refused.drop("_status")


def assign_rect(points: DataFrame, rects: DataFrame, keys: list[str], point_id: str = "id",
                cell: float = 256.0) -> DataFrame:
    """the lowest ``idx`` of the rectangles (x0, y0, x1, y1) holding each
    point, edges in; -1 if none. Rectangles are listed under the grid cells they
    cover, so a point only meets those near it."""
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    listed = (rects.withColumn("_cx", F.explode(span("x0", "x1")))
              .withColumn("_cy", F.explode(span("y0", "y1"))))
    placed = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    held = null_safe_join(placed, listed, [*keys, "_cx", "_cy"]).filter(
        (F.col("x") >= F.col("x0")) & (F.col("x") <= F.col("x1")) & (F.col("y") >= F.col("y0")) & (F.col("y") <= F.col("y1")))
    best = held.groupBy(*keys, point_id).agg(F.min("idx").alias("sheet"))
    return null_safe_join(points, best, [*keys, point_id], "left").withColumn("sheet", F.coalesce("sheet", F.lit(-1)))


def x_in_outline(x: Column, y: Column, outline: Column) -> Column:
    """is the point inside the polygon (array of (x, y)), edges counting?
    Ray parity over the edges, with an on-edge test."""
    n = F.size(outline)
    edges = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(
        outline[i].alias("a"), outline[(i + 1) % n].alias("b")))

    def crosses(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        return ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / F.nullif(by - ay, F.lit(0.0)) + ax)

    def on(e: Column) -> Column:
        ax, ay, bx, by = e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"]
        flat = (bx - ax) * (y - ay) - (by - ay) * (x - ax) == 0
        return (flat & x.between(F.least(ax, bx), F.greatest(ax, bx))
                & y.between(F.least(ay, by), F.greatest(ay, by)))

    odd = F.size(F.filter(edges, lambda e: F.coalesce(crosses(e), F.lit(False)))) % 2 == 1
    return odd | F.exists(edges, on)


def assign_polygon(points: DataFrame, polygons: DataFrame, keys: list[str], point_id: str = "id",
                   cell: float = 256.0) -> DataFrame:
    """the lowest ``idx`` of the outlines holding each point, else null, a
    Miss. Outlines meet only the points in the cells of their bounding box."""
    side = lambda pick, c: pick(F.transform("outline", lambda p: p[c]))
    boxed = polygons.withColumns({"x0": side(F.array_min, "x"), "x1": side(F.array_max, "x"),
                                  "y0": side(F.array_min, "y"), "y1": side(F.array_max, "y")})
    span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
    listed = (boxed.withColumn("_cx", F.explode(span("x0", "x1")))
              .withColumn("_cy", F.explode(span("y0", "y1"))))
    placed = points.withColumns({"_cx": F.floor(F.col("x") / cell), "_cy": F.floor(F.col("y") / cell)})
    held = null_safe_join(placed, listed, [*keys, "_cx", "_cy"]).filter(x_in_outline(F.col("x"), F.col("y"), F.col("outline")))
    best = held.groupBy(*keys, point_id).agg(F.min("idx").alias("target_index"))
    return null_safe_join(points, best, [*keys, point_id], "left")


# Patterns a camera row must match.
ALIAS = r"^[A-Za-z0-9][A-Za-z0-9_-]{1,62}$"
IPV4 = r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$"
INTERFACE = r"^[A-Za-z0-9 ._:#()*-]{1,64}$"


def validate_rows(df: DataFrame) -> DataFrame:
    """the rows with ``reasons``, the fields that are not valid."""
    c = lambda name: F.trim(F.coalesce(F.col(name).cast("string"), F.lit("")))
    first = F.split(c("mcast_ip"), r"\.")[0].try_cast("int")
    port = c("mcast_port").try_cast("double")
    rules = {
        "alias": ~c("alias").rlike(ALIAS),
        "mcast_ip": ~(c("mcast_ip").rlike(IPV4) & F.coalesce(first.between(224, 239), F.lit(False))),
        "mcast_port": ~F.coalesce((port == F.floor(port)) & port.between(1, 65535), F.lit(False)),
        "iface": (c("iface") != "") & ~c("iface").rlike(INTERFACE),
    }
    named = F.array(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    return df.withColumn("reasons", F.filter(named, lambda r: r.isNotNull()))


def camera_status(cameras: DataFrame, alive: DataFrame | None) -> DataFrame:
    """F16: disabled, unreachable (no counters at all), live or no_signal."""
    if alive is None:
        return cameras.withColumn("status", F.when(F.col("enabled"), "unreachable").otherwise("disabled"))
    live = alive.select("alias", F.col("alive").alias("_alive"))
    status = (F.when(~F.col("enabled"), "disabled").when(F.coalesce("_alive", F.lit(False)), "live")
              .otherwise("no_signal"))
    return cameras.join(live, "alias", "left").withColumn("status", status).drop("_alive")

"""Columns over points, boxes, homographies and printed targets."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Outer ring radii in template px, inner to outer, and their scores.
RING_RADII = (111.5, 220.5, 322.4, 425.1, 528.2)
RING_SCORES = (10, 9, 8, 7, 6)
RING_CENTRE = (695.4, 639.2)
# Artwork box in template px.
ARTWORK_WIDTH, ARTWORK_HEIGHT = 1405.0, 1120.0
# Radii and shares used when marks are compared.
MATCH_PX = 20.0
TRUTH_TOLERANCE = 40.0
UNKNOWN_FACTOR = 2.0
OVERLAP_SHARE = 0.5
CENTRE_FACTOR = 0.5


def _f(value) -> Column:
    return value if isinstance(value, Column) else F.lit(float(value))


def x_distance(ax, ay, bx, by) -> Column:
    return F.hypot(_f(ax) - _f(bx), _f(ay) - _f(by))


def x_project(h: Column, x: Column, y: Column) -> Column:
    """A point through a 3x3 homography, perspective divide included."""
    def row(i: int) -> Column:
        return h[i][0] * x + h[i][1] * y + h[i][2]
    return F.struct((row(0) / row(2)).alias("x"), (row(1) / row(2)).alias("y"))


def x_adjugate(h: Column) -> Column:
    """The inverse homography up to scale."""
    def minor(i: int, j: int) -> Column:
        rows, cols = [(j + 1) % 3, (j + 2) % 3], [(i + 1) % 3, (i + 2) % 3]
        return h[rows[0]][cols[0]] * h[rows[1]][cols[1]] - h[rows[0]][cols[1]] * h[rows[1]][cols[0]]
    return F.array(*[F.array(*[minor(i, j) for j in range(3)]) for i in range(3)])


def x_fit(point: Column, picture_w, picture_h, video_w, video_h, element_w, element_h,
          tolerance: float = 0.01) -> Column:
    """X11: a picture point inside the letterboxed element; null when the video
    size is unknown or its proportions are another picture's."""
    pw, ph, vw, vh, ew, eh = map(_f, (picture_w, picture_h, video_w, video_h, element_w, element_h))
    aspect = pw / ph
    scale = F.least(ew / vw, eh / vh)
    width, height = vw * scale, vh * scale
    placed = F.struct(((ew - width) / 2 + point["x"] * width / pw).alias("x"),
                      ((eh - height) / 2 + point["y"] * height / ph).alias("y"))
    fits = (vw > 0) & (vh > 0) & (F.abs(vw / vh - aspect) <= tolerance * aspect)
    return F.when(fits, placed)


def x_millimetres(x, y, centre_x, centre_y, scale: Column) -> Column:
    """Offsets from the centre in mm, Y up; null without a print scale."""
    return F.when(scale.isNotNull(), F.struct(
        ((_f(x) - _f(centre_x)) * scale).alias("x_mm"), (-(_f(y) - _f(centre_y)) * scale).alias("y_mm")))


def x_scale_reason(scale: Column) -> Column:
    """Why a position has no millimetres."""
    return F.when(scale.isNull(), F.lit("no print scale"))


def x_ring_score(distance: Column) -> Column:
    """The first ring at or beyond ``distance``; 0 outside them all."""
    out = F.lit(0)
    for radius, score in reversed(list(zip(RING_RADII, RING_SCORES))):
        out = F.when(distance <= radius, score).otherwise(out)
    return out


def x_position_error(fx, fy, tx, ty, scale) -> Column:
    """Found minus truth in mm, Y up, and the radial error."""
    dx, dy = (_f(fx) - _f(tx)) * _f(scale), -(_f(fy) - _f(ty)) * _f(scale)
    return F.struct(dx.alias("dx"), dy.alias("dy"), F.hypot(dx, dy).alias("radial"))


def x_cause(distance: Column, tolerance: float = TRUTH_TOLERANCE) -> Column:
    """Likely cause of a false positive from its nearest-mark distance;
    null distance means there was no mark."""
    d = F.coalesce(distance, F.lit(float("inf")))
    return (F.when(d <= tolerance, "displacement")
            .when(d > UNKNOWN_FACTOR * tolerance, "detector").otherwise("unknown"))


def x_overlap(a: Column, b: Column) -> Column:
    """Box intersection as a share of the smaller box; boxes are
    ``(cx, cy, w, h)`` structs."""
    def span(c: str, s: str) -> Column:
        return (F.least(a[c] + a[s] / 2, b[c] + b[s] / 2) - F.greatest(a[c] - a[s] / 2, b[c] - b[s] / 2))
    dx, dy = span("cx", "w"), span("cy", "h")
    smaller = F.least(a["w"] * a["h"], b["w"] * b["h"])
    return F.when((dx > 0) & (dy > 0) & (smaller > 0), dx * dy / smaller).otherwise(0.0)


def x_same_mark(a: Column, b: Column, floor_px) -> Column:
    """Within the floor, or overlapping boxes, or centres near for the size."""
    d = F.hypot(a["cx"] - b["cx"], a["cy"] - b["cy"])
    diagonal = (F.hypot(a["w"], a["h"]) + F.hypot(b["w"], b["h"])) / 2
    boxed = a["w"].isNotNull() & b["w"].isNotNull()
    return (d < _f(floor_px)) | F.coalesce(
        boxed & ((x_overlap(a, b) > OVERLAP_SHARE) | (d < CENTRE_FACTOR * diagonal)), F.lit(False))


def x_scaled_tolerance(tolerance, target_span, template_span) -> Column:
    """X19."""
    return _f(tolerance) * _f(target_span) / _f(template_span)

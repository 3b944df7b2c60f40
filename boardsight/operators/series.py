"""Series, counters and looks in order (W5-W9, W11-W15, A10-A14, A24, A25, R10 batch)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from boardsight.core.blocks import ROWS_PER_BLOCK, in_blocks, own_rows
from boardsight.core.ordered import ROWS_PER_SLICE, Ordered, fold_in_order, null_safe_join
from boardsight.operators.filters import is_due

FPS = 25
# Arrival rule, in frames.
STEP, HOLD = 25, 3
DRIFT_FRAMES = 25
REANCHOR_AFTER = 25


def seconds(ts: str | Column) -> Column:
    return F.unix_micros((F.col(ts) if isinstance(ts, str) else ts).cast("timestamp")) / 1e6


def longest_blind_run(looks_seen: DataFrame, keys: list[str], frame: str = "frame", seen: str = "seen",
                      rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Per key the longest stretch of looks that did not see the position,
    the first of equals: first and last frame, and how many looks. Rows are
    registered looks only."""
    marked = Ordered(looks_seen, keys, [frame], rows_per_slice).running_sum("_stretch", F.col(seen).cast("long")).done()
    runs = marked.filter(~F.col(seen)).groupBy(*keys, "_stretch").agg(
        F.min(frame).alias("first"), F.max(frame).alias("last"), F.count(F.lit(1)).alias("frames"))
    best = runs.groupBy(*keys).agg(F.max_by(F.struct("first", "last", "frames"), F.struct(F.col("frames"), -F.col("first"))).alias("_b"))
    return best.select(*keys, F.col("_b.first").alias("blind_first"), F.col("_b.last").alias("blind_last"),
                       F.col("_b.frames").alias("blind_frames"))


def step_arrival(df: DataFrame, keys: list[str], frame: str = "frame", d: str = "d", step: int = STEP, hold: int = HOLD,
                 rows_per_slice: int = ROWS_PER_SLICE, per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """The frame a mark arrived in, per series. The rise at a frame is the
    median of the next ``step`` less that of the previous ``step``; the first
    rise of at least half the largest is followed to its peak, and the arrival
    is the first frame nearby that passes the midpoint and holds it."""
    rows = Ordered(df, keys, [frame], rows_per_slice).row_number("_i").done()
    rows = rows.withColumn("_i", F.col("_i") - 1)
    dealt, w = in_blocks(rows, keys, "_i", step, per_block)
    med = lambda lo, hi: F.percentile(F.col(d), F.lit(0.5)).over(w.rowsBetween(lo, hi))
    rows = own_rows(dealt.withColumns({
        "_after": med(0, step - 1), "_before": med(-step, -1),
        "_held": F.min(d).over(w.rowsBetween(0, hold - 1))}))
    size = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    rows = null_safe_join(rows, size, keys)
    judged = rows.filter((F.col("_i") >= hold) & (F.col("_i") <= F.col("_n") - step)).withColumn(
        "_rise", F.col("_after") - F.col("_before"))
    top = judged.groupBy(*keys).agg(F.max("_rise").alias("_top"))
    big = null_safe_join(judged, top, keys)
    first = big.filter(F.col("_rise") >= F.col("_top") / 2).groupBy(*keys).agg(F.min("_i").alias("_first"))
    peak = (null_safe_join(judged, first, keys)
            .filter((F.col("_i") >= F.col("_first")) & (F.col("_i") < F.col("_first") + step))
            .groupBy(*keys).agg(F.max_by(F.struct("_i", frame, "_before", "_after"), F.struct("_rise", -F.col("_i"))).alias("_p"))
            .select(*keys, F.col("_p._i").alias("_at"), F.col(f"_p.{frame}").alias("_at_frame"),
                    ((F.col("_p._before") + F.col("_p._after")) / 2).alias("_mid")))
    held = (null_safe_join(rows, peak, keys)
            .filter((F.col("_i") >= F.col("_at") - step) & (F.col("_i") < F.col("_at") + step)
                    & (F.col("_i") < F.col("_n") - hold) & (F.col("_held") >= F.col("_mid")))
            .groupBy(*keys).agg(F.min(frame).alias("_hit")))
    return null_safe_join(peak, held, keys, "left").select(
        *keys, F.coalesce("_hit", "_at_frame").alias("arrival"))


def drift_jitter(df: DataFrame, keys: list[str], frame: str, x: str, y: str, n: int = DRIFT_FRAMES,
                 per_block: int = ROWS_PER_BLOCK) -> DataFrame:
    """``drift`` (length of the centred mean over n frames of video time,
    the ends padded with the end samples) and ``jitter`` (length of the rest)."""
    h = n // 2
    ends = df.groupBy(*keys).agg(F.min_by(F.struct(frame, x, y), frame).alias("_f"), F.max_by(F.struct(frame, x, y), frame).alias("_l"))
    dealt, w = in_blocks(df, keys, frame, h, per_block)
    w = w.rangeBetween(-h, h)
    rows = own_rows(dealt.withColumns({"_n": F.count(F.lit(1)).over(w), "_sx": F.sum(x).over(w), "_sy": F.sum(y).over(w)}))
    rows = null_safe_join(rows, ends, keys)
    ahead = F.greatest(F.lit(0), h - (F.col(frame) - F.col("_f")[frame]))
    behind = F.greatest(F.lit(0), h - (F.col("_l")[frame] - F.col(frame)))
    mean = lambda s, c: (F.col(s) + ahead * F.col("_f")[c] + behind * F.col("_l")[c]) / (F.col("_n") + ahead + behind)
    rows = rows.withColumns({"_mx": mean("_sx", x), "_my": mean("_sy", y)})
    return rows.withColumns({"drift": F.hypot("_mx", "_my"), "jitter": F.hypot(F.col(x) - F.col("_mx"), F.col(y) - F.col("_my"))}).drop(
        "_n", "_sx", "_sy", "_f", "_l", "_mx", "_my")


def counter_rate(df: DataFrame, keys: list[str], ts: str, counters: list[str], min_dt: float = 0.1, tie: list[str] = (),
                 rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Whole-number rates per second from cumulative counters: never
    negative, halves up, null where there is no earlier look or it is nearer
    than ``min_dt``."""
    seen = Ordered(df, keys, [ts, *tie], rows_per_slice).lag(_ts=ts, **{f"_{c}": c for c in counters}).done()
    dt = seconds(ts) - seconds("_ts")
    rate = lambda c: F.when(dt >= min_dt, F.floor(F.greatest(F.lit(0), F.col(c) - F.col(f"_{c}")) / dt + 0.5))
    return seen.withColumns({f"{c}_rate": rate(c) for c in counters}).drop("_ts", *[f"_{c}" for c in counters])


def ema(df: DataFrame, keys: list[str], ts: str, col: str, alpha: float = 0.3, tie: list[str] = (),
        rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Exponential smoothing from 0, rounded (half up) at each step; rows
    without a value keep the level."""
    def fold(state, rows: pd.DataFrame):
        level, out = state or 0, []
        for value in rows[col]:
            if not pd.isna(value):
                level = int((level * (1 - alpha) + value * alpha + 0.5) // 1)
            out.append(level)
        return rows.assign(smoothed=out)[names], level
    schema = T.StructType(df.schema.fields + [T.StructField("smoothed", T.LongType())])
    names = schema.names
    return fold_in_order(df, keys, [ts, *tie], fold, schema, rows_per_slice)


def alive(df: DataFrame, keys: list[str], ts: str, counter: str, stale_s: float = 3, tie: list[str] = (),
          rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """At each look, did the counter grow less than ``stale_s`` ago?"""
    seen = Ordered(df, keys, [ts, *tie], rows_per_slice).lag(_c=counter)
    seen = seen.last_known("_grew", F.when(F.col(counter) > F.col("_c"), F.col(ts))).done()
    return seen.withColumn("alive", F.coalesce(seconds(ts) - seconds("_grew") < stale_s, F.lit(False))).drop("_c", "_grew")


def silence(df: DataFrame, keys: list[str], ts: str, counter: str, tie: list[str] = (),
            rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Seconds since the counter last changed to another non-zero value,
    or since the first look."""
    c = F.col(counter)
    seen = Ordered(df, keys, [ts, *tie], rows_per_slice).row_number("_n").last_known("_k", F.nullif(c, F.lit(0))).lag(_p="_k")
    changed = (F.col("_n") == 1) | ((c != 0) & ~c.eqNullSafe(F.col("_p")))
    seen = seen.last_known("_at", F.when(changed, F.col(ts))).done()
    return seen.withColumn("silent_s", seconds(ts) - seconds("_at")).drop("_n", "_k", "_p", "_at")


def state_changes(df: DataFrame, keys: list[str], ts: str, status: str, initial=None, tie: list[str] = (),
                  rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Rows whose status is not that of the look before (``initial``
    stands before the first)."""
    seen = Ordered(df, keys, [ts, *tie], rows_per_slice).lag(previous=status).done()
    before = F.col("previous") if initial is None else F.coalesce("previous", F.lit(initial))
    return seen.withColumn("previous", before).filter(~F.col(status).eqNullSafe(F.col("previous")))


def frame_index(df: DataFrame, keys: list[str], order: str, ts_ms: str, fps: int = FPS,
                rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Frame numbers from timestamps, rows in arrival order. A timestamp
    not later than the one before is ``untimed`` and placed one past it; after
    such a stretch counting starts anew, placed from the last trusted frame.

    Within a stretch "at least one more than the frame before" is a running
    maximum; only stretch heads, few rows, are chained one after another.
    """
    at = F.col(ts_ms)
    seen = Ordered(df, keys, [order], rows_per_slice).lag(_ts=ts_ms).row_number("_n")
    seen.df = seen.df.withColumn("untimed", F.coalesce(at <= F.col("_ts"), F.lit(False)))
    seen = seen.lag(_was="untimed")
    seen.df = seen.df.withColumn("_head", F.col("_ts").isNull() | (~F.col("untimed") & F.coalesce("_was", F.lit(False))))
    seen = (seen.running_sum("_ep", F.col("_head").cast("long"))
            .last_known("_h", F.when(F.col("_head"), F.struct(at.alias("ts"), F.col("_n").alias("n")))))
    rows = seen.done().withColumn("_i", F.col("_n") - F.col("_h.n"))
    frames = lambda ms: F.bround(ms * fps / 1000, 0).cast("long")
    ahead = F.when(~F.col("untimed"), frames(at - F.col("_h.ts")) - F.col("_i"))
    rows = Ordered(rows, [*keys, "_ep"], [order], rows_per_slice).running_max("_lead", ahead).done()
    rows = rows.withColumn("_rel", F.col("_i") + F.greatest(F.col("_lead"), F.lit(0)))
    timed = F.when(~F.col("untimed") & ~F.col("_head"), F.col("_n"))
    heads = rows.groupBy(*keys, "_ep").agg(
        F.min(F.col("_h.ts")).alias("head_ts"), F.max("_rel").alias("last_rel"),
        F.max_by(at, timed).alias("timed_ts"), F.max_by("_rel", timed).alias("timed_rel"))

    def chain(state, pdf: pd.DataFrame):
        index, trusted = (state[0], state[1]) if state else (-1, None)
        placed = []
        for head, last, t_ts, t_rel in zip(pdf["head_ts"], pdf["last_rel"], pdf["timed_ts"], pdf["timed_rel"]):
            first = index + 1
            if trusted and head > trusted[0]:
                first = max(first, trusted[1] + round((head - trusted[0]) * fps / 1000))
                trusted = [int(head), first]
            placed.append(first)
            if not pd.isna(t_ts):
                trusted = [int(t_ts), first + int(t_rel)]
            index = first + int(last)
        return pdf.assign(_base=placed)[[*keys, "_ep", "_base"]], [index, trusted]

    schema = T.StructType([*[heads.schema[k] for k in keys], T.StructField("_ep", T.LongType()), T.StructField("_base", T.LongType())])
    bases = fold_in_order(heads, keys, ["_ep"], chain, schema, rows_per_slice)
    placed = null_safe_join(rows, bases, [*keys, "_ep"])
    return placed.withColumn("frame", F.col("_base") + F.col("_rel")).drop(
        "_ts", "_n", "_was", "_head", "_ep", "_h", "_i", "_lead", "_rel", "_base")


def frame_gaps(frames: DataFrame, keys: list[str], frame: str = "frame", rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Stretches of frame numbers that are missing: ``gap_first``,
    ``gap_last``, ``lost``."""
    seen = Ordered(frames.select(*keys, frame), keys, [frame], rows_per_slice).lead(_next=frame).done()
    lost = F.col("_next") - F.col(frame) - 1
    return seen.filter(lost > 0).select(*keys, (F.col(frame) + 1).alias("gap_first"), (F.col("_next") - 1).alias("gap_last"), lost.alias("lost"))


def unseen_frames(gaps: DataFrame, keys: list[str], stride: int, baseline: int = 5, chunk: int = 10_000) -> DataFrame:
    """The missing frames a look was due on. Long gaps are listed
    chunk by chunk, so that no one row holds a long list."""
    pieces = gaps.withColumn("_p", F.explode(F.sequence(F.floor(F.col("gap_first") / chunk), F.floor(F.col("gap_last") / chunk))))
    lo, hi = F.greatest("gap_first", F.col("_p") * chunk), F.least("gap_last", (F.col("_p") + 1) * chunk - 1)
    return (pieces.select(*keys, F.explode(F.sequence(lo, hi)).alias("frame"))
            .filter(is_due(F.col("frame"), stride, baseline)))


def lost_runs(looks: DataFrame, keys: list[str], frame: str = "frame", after: int = REANCHOR_AFTER,
              rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Per look how many looks in a row were lost before it
    (``lost_before``), and whether a re-anchor falls due on it."""
    tried = looks.filter(F.col("status") != "unseen")
    seen = Ordered(tried, keys, [frame], rows_per_slice).row_number("_n")
    seen = seen.last_known("_ok", F.when(F.col("status") != "lost", F.col("_n"))).lag(_prev="_ok").done()
    before = F.col("_n") - 1 - F.coalesce("_prev", F.lit(0))
    return (seen.withColumn("lost_before", before)
            .withColumn("reanchor_due", (F.col("lost_before") > 0) & (F.col("lost_before") % after == 0)).drop("_n", "_ok", "_prev"))


def stalls_batch(df: DataFrame, keys: list[str], ts: str, after_s: float = 10, down_s: float = 120, down: str | None = None,
                 tie: list[str] = (), rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """R10 over stored looks: waits for the next look that are a stall. While
    the camera is down (``down`` column) the longer bound holds."""
    seen = Ordered(df, keys, [ts, *tie], rows_per_slice).lead(_next=ts).done()
    wait = seconds("_next") - seconds(ts)
    bound = F.when(F.col(down), down_s).otherwise(after_s) if down else F.lit(after_s)
    return seen.withColumn("stuck_s", wait).filter(F.col("stuck_s") >= bound).drop("_next")


def stage_counters(events: DataFrame, stages: list[str]) -> DataFrame:
    """A10: per source, successes and failures of each stage. Events carry
    ``source``, ``stage``, ``ok`` and ``n``. The stages are named, so no pass
    is spent finding them."""
    n = F.coalesce(F.col("n"), F.lit(1))
    cols = []
    for s in stages:
        at = F.col("stage") == s
        cols += [F.sum(F.when(at & F.col("ok"), n).otherwise(0)).alias(f"{s}_ok"),
                 F.sum(F.when(at & ~F.col("ok"), n).otherwise(0)).alias(f"{s}_fail")]
    return events.groupBy("source").agg(*cols)


def mean_latency(df: DataFrame, keys: list[str], latency: str = "latency_ms") -> DataFrame:
    """Mean of what was measured, 0 when nothing was."""
    return df.groupBy(*keys).agg(F.coalesce(F.avg(latency), F.lit(0.0)).alias("mean_latency_ms"))


def batch_latency(df: DataFrame, keys: list[str], ts: str, now: Column) -> DataFrame:
    """Now less the newest timestamp of each batch, ms."""
    return df.groupBy(*keys).agg(((seconds(now) - seconds(F.max(ts))) * 1000).alias("batch_latency_ms"))


def queue_latency(df: DataFrame, keys: list[str], ts: str, now: Column) -> DataFrame:
    """Write start less the oldest timestamp of each batch, ms."""
    return df.groupBy(*keys).agg(((seconds(now) - seconds(F.min(ts))) * 1000).alias("queue_latency_ms"))


def utilisation(df: DataFrame, count: str, capacity: str) -> DataFrame:
    """Percent of capacity in use, 0 without capacity."""
    share = F.when(F.col(capacity) > 0, F.col(count) / F.col(capacity) * 100)
    return df.withColumn("utilisation", F.coalesce(share, F.lit(0.0)))


def stream_report(frames: DataFrame, keys: list[str], drops: DataFrame | None = None, gaps: DataFrame | None = None) -> DataFrame:
    """Per stream the commonest step rate, frames received, the rate over
    the stream time they span, untimed frames, due frames dropped late before
    and after watching; with drops and upstream gaps summed up when given.
    Frames carry ``step_ms``, ``span_ms``, ``untimed``, ``late_before``, ``late_after``."""
    steps = (frames.filter(F.col("step_ms") > 0).groupBy(*keys, F.round(F.lit(1000.0) / F.col("step_ms"), 2).alias("_fps"))
             .agg(F.count(F.lit(1)).alias("_n")))
    common = steps.groupBy(*keys).agg(F.max_by("_fps", F.struct("_n", -F.col("_fps"))).alias("common_fps"))
    sums = frames.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("received"), F.count_if("untimed").alias("untimed"),
        (F.sum("span_ms") / 1000).alias("spanned_s"), F.sum(F.col("late_before").cast("long")).alias("late_before"),
        F.sum(F.col("late_after").cast("long")).alias("late_after"))
    out = null_safe_join(sums, common, keys, "left").withColumn(
        "received_fps", F.try_divide(F.col("received"), F.col("spanned_s")))
    if drops is not None:
        out = null_safe_join(out, drops.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("drops"), F.sum("down_s").alias("down_s"), F.sum("missed").alias("missed")), keys, "left")
    if gaps is not None:
        out = null_safe_join(out, gaps.groupBy(*keys).agg(
            F.count(F.lit(1)).alias("gaps"), F.sum("lost").alias("lost")), keys, "left")
    return out


# Fit-check bounds.
MIN_CORRELATION, GROSS, MODERATE = 0.9, 66.0, 3.1


def fit_checks(df: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Converged fits, those checked (low correlation, with a verdict),
    and the grossly and moderately wrong among them."""
    checked = (F.col("correlation") < MIN_CORRELATION) & F.col("disagreement").isNotNull()
    gross = checked & (F.col("disagreement") >= GROSS)
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("converged"), F.count_if(checked).alias("checked"), F.count_if(gross).alias("gross"),
        F.count_if(checked & ~gross & (F.col("disagreement") > MODERATE)).alias("moderate"))

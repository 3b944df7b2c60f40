"""Looks to new marks (U1, U2, U4-U10, U15, U17, U19, U22, U16 batch)."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from boardsight.core.columns import group_codes, once
from boardsight.core.ordered import ROWS_PER_SLICE, Ordered, broadcast_if_small, fold_in_order, hot_keys, null_safe_join
from boardsight.core.pairs import deal
from boardsight.core.runtime import cut
from boardsight.functions import signals as fn
from boardsight.functions.geometry import CENTRE_FACTOR, MATCH_PX, OVERLAP_SHARE, x_same_mark
from boardsight.operators.filters import assign_polygon, is_due
from boardsight.operators.spatial import distance_join, strip_known

# Persistence rule and baseline length, in frames.
PERSIST, WINDOW, BASELINE_FRAMES = 0.5, 25, 5
MOVED_PX = 2.0
TRACKS_IN_ONE_TASK = 50_000   # of a key: above, its tracks are tried block against block
TRACKS_IN_A_BLOCK = 8_192
TRIES_AT_ONCE = 2 ** 18       # tracks against tracks, in one step
FIRST_TRIES = 64              # of a track in the order of the earlier, before a shorter list is looked for
SIGHTING_WORDS = 2 ** 22      # words that hold the sightings of a task's tracks as bits


def _ms(df: DataFrame, ts: str) -> Column:
    name = df.schema[ts].dataType.typeName()
    return F.unix_micros(F.col(ts).cast("timestamp")) / 1000 if name.startswith("timestamp") else F.col(ts).cast("double")


def throttle(df: DataFrame, keys: list[str], ts: str, interval_ms: float | None, tie: list[str] = (),
             rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Rows at least ``interval_ms`` after the last **kept** row of their
    key; no interval keeps all.

    A sequential rule, but one that soon forgets where it started, so hot keys
    are settled slice by slice in a few rounds.
    """
    if interval_ms is None:
        return df
    return _kept(df, keys, ts, interval_ms, tie, rows_per_slice).filter("_kept").drop("_kept", "_ms")


def _kept(df: DataFrame, keys: list[str], ts: str, interval_ms: float, tie: list[str], rows_per_slice: int) -> DataFrame:
    timed = df.withColumn("_ms", _ms(df, ts))
    schema = T.StructType(timed.schema.fields + [T.StructField("_kept", T.BooleanType())])
    return fold_in_order(timed, keys, ["_ms", *tie], throttle_fold(interval_ms, schema.names), schema, rows_per_slice)


def throttle_fold(interval_ms: float, columns: list[str]):
    """The rate rule over rows in ``_ms`` order; the state is the last kept time."""
    def fold(last, rows: pd.DataFrame):
        at = rows["_ms"].to_numpy()
        kept = np.zeros(len(at), bool)
        i = 0 if last is None else int(np.searchsorted(at, last + interval_ms, "left"))
        while i < len(at):  # one step per kept row, not per row
            kept[i], last = True, float(at[i])
            i = max(i + 1, int(np.searchsorted(at, last + interval_ms, "left")))
        return rows.assign(_kept=kept)[columns], last
    return fold


def collapse_repeats(df: DataFrame, keys: list[str], ts: str, interval_ms: float = 60_000, tie: list[str] = (),
                     rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The kept events, each with how many repeats were dropped since the
    kept one before it."""
    marked = cut(_kept(df, keys, ts, interval_ms, tie, rows_per_slice))  # the rule runs once
    seen = Ordered(marked, keys, ["_ms", *tie], rows_per_slice).row_number("_n")
    kept = seen.done().filter("_kept")
    return (Ordered(kept, keys, ["_ms", *tie], rows_per_slice).lag(_p="_n").done()
            .withColumn("repeats", F.coalesce(F.col("_n") - F.col("_p") - 1, F.lit(0))).drop("_n", "_p", "_kept", "_ms"))


def keep_if_moved(df: DataFrame, keys: list[str], ts: str, outline: str, moved_px: float = MOVED_PX, tie: list[str] = (),
                  rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Places some point of whose ``outline`` (array of x, y on the
    picture) lies more than ``moved_px`` from the last kept place's. The first
    place is kept; a row not newer than every row before it changes nothing."""
    fresh = Ordered(df.withColumn("_ms", _ms(df, ts)), keys, [*(tie or [ts])], rows_per_slice).running_max("_high", F.col("_ms"))
    fresh = fresh.lag(_before="_high").done().filter(F.col("_before").isNull() | (F.col("_ms") > F.col("_before")))
    packed = fresh.withColumn("_xy", F.flatten(F.transform(outline, lambda p: F.array(p["x"], p["y"])))).drop("_high", "_before")
    slim = packed.select(*keys, "_ms", "_xy")
    schema = T.StructType([slim.schema[c] for c in (*keys, "_ms")])

    marks = fold_in_order(slim, keys, ["_ms"], moved_fold(moved_px, schema.names), schema, rows_per_slice)
    return null_safe_join(packed, marks, [*keys, "_ms"], "left_semi").drop("_ms", "_xy")


def moved_fold(moved_px: float, columns: list[str]):
    """The moved rule over rows in time order; the state is the last kept outline."""
    def fold(last, rows: pd.DataFrame):
        kept = []
        for xy in rows["_xy"]:
            here = np.asarray(xy, float).reshape(-1, 2)
            moved = last is None or bool((np.hypot(*(here - np.asarray(last)).T) > moved_px).any())
            kept.append(moved)
            last = here.tolist() if moved else last
        return rows.loc[kept, columns], last
    return fold


TRACK_FIELDS = [T.StructField("frame", T.LongType()), T.StructField("cand_id", T.StringType()),
                T.StructField("first", T.LongType())] + [T.StructField(c, T.DoubleType()) for c in ("cx", "cy", "w", "h")]


def _matches(pos: np.ndarray, p: np.ndarray, floor: float) -> np.ndarray:
    """Which of the candidates' running means are the same mark as ``p``."""
    d = np.hypot(pos[:, 0] - p[0], pos[:, 1] - p[1])
    same = d < floor
    if np.isnan(p[2]):
        return same
    dx = np.minimum(pos[:, 0] + pos[:, 2] / 2, p[0] + p[2] / 2) - np.maximum(pos[:, 0] - pos[:, 2] / 2, p[0] - p[2] / 2)
    dy = np.minimum(pos[:, 1] + pos[:, 3] / 2, p[1] + p[3] / 2) - np.maximum(pos[:, 1] - pos[:, 3] / 2, p[1] - p[3] / 2)
    smaller = np.minimum(pos[:, 2] * pos[:, 3], p[2] * p[3])
    with np.errstate(divide="ignore", invalid="ignore"):
        overlap = np.where((dx > 0) & (dy > 0) & (smaller > 0), dx * dy / smaller, 0.0)
    diagonal = (np.hypot(pos[:, 2], pos[:, 3]) + np.hypot(p[2], p[3])) / 2
    return same | (overlap > OVERLAP_SHARE) | (d < CENTRE_FACTOR * diagonal)


def _first_match(pos: np.ndarray, wide: float, p: np.ndarray, size: float, floor: float) -> int:
    """The first of the candidates that is the same mark as ``p``, -1 if none. No mark farther off than the
    floor or half the diagonals (``size``, and at most ``wide``) can be, and one nearer than the floor is."""
    d = np.hypot(pos[:, 0] - p[0], pos[:, 1] - p[1])
    near = (d <= max(floor, max(CENTRE_FACTOR, 1.0) * (wide + size) / 2) * 1.001).nonzero()[0]
    if not len(near):
        return -1
    if d[near[0]] < floor:
        return int(near[0])
    hit = _matches(pos[near], p, floor).nonzero()[0]
    return int(near[hit[0]]) if len(hit) else -1


def _size(p: np.ndarray) -> float:
    return max((math.hypot(w, h) for w, h in p[..., 2:4].reshape(-1, 2).tolist() if w == w and h == h), default=0.0)


def track_candidates(looks: DataFrame, keys: list[str], match_px: float = MATCH_PX, reopen: bool = False,
                     persist: float = PERSIST, window: int = WINDOW, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """U4: one row per detection with the candidate it folds into: the first
    one, oldest first, whose running mean is the same mark.

    U7, ``reopen=True``: a candidate whose window has passed without
    persisting gathers nothing more; a later detection opens a new one.
    Looks carry ``frame``, ``status`` and ``detections`` (cx, cy, w, h).
    """
    slim = looks.select(*keys, F.col("frame").cast("long").alias("frame"), "status", F.transform(
        F.coalesce("detections", F.array().cast(T.ArrayType(T.StructType(TRACK_FIELDS[3:])))),
        lambda d: F.array(*[d[c].cast("double") for c in ("cx", "cy", "w", "h")])).alias("_d"))
    schema = T.StructType([slim.schema[k] for k in keys] + TRACK_FIELDS)
    fold = tracking_fold(keys, schema.names, match_px, reopen, persist, window)
    return fold_in_order(slim, keys, ["frame"], fold, schema, rows_per_slice)


def tracking_fold(keys: list[str], columns: list[str], match_px: float, reopen: bool, persist: float, window: int,
                  judged: list | None = None):
    """The tracking rule over looks in frame order. The state is the live
    candidates: position, sightings, first frame, name, and while their window
    runs its counts. With ``judged`` given, candidates that persist are added
    to it as their window passes."""
    def fold(state, rows: pd.DataFrame):
        live = [{**c, "pos": np.asarray(c["pos"], np.float32)} for c in state or []]
        at, wide = None, 0.0  # positions of the live, stacked anew only where candidates come or go, and the widest
        out = []
        for frame, status, found in zip(rows["frame"], rows["status"], rows["_d"]):
            frame = int(frame)
            if reopen:
                alive = []
                for c in live:
                    if c["open"] and c["first"] + window <= frame:
                        c["open"] = False
                        if not (c["span"] > 0 and c["span"] >= persist * c["tried"] and c["hits"] / c["span"] >= persist):
                            continue
                        if judged is not None:
                            judged.append((c["id"], c["first"], frame, *[float(v) for v in c["pos"][:2]], c["hits"] / c["span"]))
                    alive.append(c)
                if len(alive) < len(live):
                    live, at = alive, None
            if status == "registered":
                for n, d in enumerate(found):
                    p = np.asarray([np.nan if v is None else v for v in d], np.float32)
                    if at is None and live:
                        at = np.stack([c["pos"] for c in live])
                        wide = _size(at)
                    size = _size(p)
                    hit = _first_match(at, wide, p, size, match_px) if live else -1
                    if hit >= 0:
                        c = live[hit]
                        wide = max(wide, size)  # a mean is no wider than the widest
                        c["pos"] = at[hit] = (c["pos"] * np.float32(c["n"]) + p) / np.float32(c["n"] + 1)
                        c["n"] += 1
                    else:
                        c = {"pos": p, "n": 1, "first": frame, "id": f"{frame}-{n}", "open": True,
                             "span": 0, "tried": 0, "hits": 0, "last": -1}
                        live.append(c)
                        at = None
                    if c["last"] != frame and frame < c["first"] + window:
                        c["hits"] += 1
                        c["last"] = frame
                    out.append((frame, c["id"], c["first"], *[float(v) for v in p]))
            for c in live:
                if c["open"] and frame < c["first"] + window:
                    c["span"] += int(status == "registered")
                    c["tried"] += 1
        made = pd.DataFrame(out, columns=[f.name for f in TRACK_FIELDS])
        for k in keys:
            made[k] = rows[k].iloc[0] if len(rows) else None
        return made[columns], [{**c, "pos": [float(v) for v in c["pos"]]} for c in live]
    return fold


def retrack(looks: DataFrame, keys: list[str], match_px: float = MATCH_PX, **rule) -> DataFrame:
    """U7."""
    return track_candidates(looks, keys, match_px, reopen=True, **rule)


def candidates(tracks: DataFrame, keys: list[str]) -> DataFrame:
    """One row per candidate: mean box, first frame, sightings, last sighting."""
    return tracks.groupBy(*keys, "cand_id").agg(
        F.min("first").alias("first"), *[F.avg(c).alias(c) for c in ("cx", "cy", "w", "h")],
        F.count(F.lit(1)).alias("sightings"), F.count_distinct("frame").alias("frames_seen"), F.max("frame").alias("last_seen"))


def _window_looks(tracks: DataFrame, looks: DataFrame, keys: list[str], window: int) -> DataFrame:
    """Per candidate and frame of its window: the look's status, null where no
    frame was tried, and whether it saw the candidate. Equi-joins on (keys,
    frame), so a long recording spreads over its frames."""
    cands = tracks.groupBy(*keys, "cand_id").agg(F.min("first").alias("first"))
    frames = cands.withColumn("frame", F.explode(F.sequence(F.col("first"), F.col("first") + window - 1)))
    status = looks.select(*keys, F.col("frame").cast("long").alias("frame"), "status")
    seen = tracks.select(*keys, "cand_id", "frame").distinct().withColumn("hit", F.lit(True))
    rows = null_safe_join(frames, status, [*keys, "frame"], "left")
    return null_safe_join(rows, seen, [*keys, "cand_id", "frame"], "left").withColumn("hit", F.coalesce("hit", F.lit(False)))


def persistence(tracks: DataFrame, looks: DataFrame, keys: list[str], processed: DataFrame | int | None = None,
                persist: float = PERSIST, window: int = WINDOW) -> DataFrame:
    """Each candidate's verdict over ``[first, first + window)``: persisted,
    rejected, or undecided while its window has not passed. ``processed`` is
    how many frames there were, by default one past the last look."""
    rows = _window_looks(tracks, looks, keys, window)
    counts = rows.groupBy(*keys, "cand_id").agg(
        F.min("first").alias("first"), F.count_if(F.col("status") == "registered").alias("span"),
        F.count("status").alias("tried"), F.count_if("hit").alias("hits"))
    if processed is None:
        processed = looks.groupBy(*keys).agg((F.max("frame") + 1).alias("processed"))
    counts = (counts.withColumn("processed", F.lit(processed)) if isinstance(processed, int)
              else null_safe_join(counts, processed, keys))
    ratio = F.when(F.col("span") > 0, F.col("hits") / F.col("span"))
    holds = (F.col("span") > 0) & (F.col("span") >= persist * F.col("tried")) & (ratio >= persist)
    verdict = F.when(F.col("first") + window > F.col("processed"), "undecided").when(holds, "persisted").otherwise("rejected")
    return counts.withColumns({"persistence": ratio, "verdict": verdict}).drop("processed")


def early_verdict(tracks: DataFrame, looks: DataFrame, keys: list[str], stride: int = 1, baseline: int = 0,
                  persist: float = PERSIST, window: int = WINDOW) -> DataFrame:
    """The first look at which a candidate persists whatever its remaining
    due looks bring, null if there is none inside its window."""
    rows = _window_looks(tracks, looks, keys, window)
    w = W.partitionBy(*keys, "cand_id").orderBy("frame")  # never more than ``window`` rows
    so_far, ahead = w.rowsBetween(W.unboundedPreceding, W.currentRow), w.rowsBetween(1, W.unboundedFollowing)
    rows = rows.withColumns({
        "span": F.count_if(F.col("status") == "registered").over(so_far), "tried": F.count("status").over(so_far),
        "hits": F.count_if("hit").over(so_far),
        "left": F.coalesce(F.sum(is_due(F.col("frame"), stride, baseline).cast("int")).over(ahead), F.lit(0))})
    # as counted before the look itself folds, and after it
    prior = {c: F.coalesce(F.lag(c).over(w), F.lit(0)) for c in ("span", "tried", "hits")}
    rows = rows.withColumns({f"p_{c}": e for c, e in prior.items()})
    rows = rows.withColumn("p_left", F.col("left") + is_due(F.col("frame"), stride, baseline).cast("int"))

    def sure(p: str) -> Column:
        span, left = F.col(f"{p}span"), F.col(f"{p}left")
        return ((span > 0) & (span >= persist * (F.col(f"{p}tried") + left))
                & (F.col(f"{p}hits") / (span + left) >= persist))
    looked = F.col("status").isin("registered", "lost")
    return rows.groupBy(*keys, "cand_id").agg(
        F.min("first").alias("first"), F.min(F.when(looked & (sure("") | sure("p_")), F.col("frame"))).alias("early_frame"))


def baseline_marks(looks: DataFrame, keys: list[str], r: float = MATCH_PX, n: int = BASELINE_FRAMES) -> DataFrame:
    """U8: marks of the first n frames, each kept unless one kept before it is
    nearer than ``r``. Only n looks per key reach a task."""
    first = looks.filter((F.col("frame") < n) & (F.col("status") == "registered"))
    dets = first.select(*keys, "frame", F.posexplode("detections").alias("pos", "d")).select(*keys, "frame", "pos", "d.*")
    schema = T.StructType([*[dets.schema[k] for k in keys], T.StructField("mark_id", T.IntegerType()),
                           T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType())])

    def greedy(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["frame", "pos"])
        kept = np.zeros((0, 2), np.float32)
        for p in pdf[["cx", "cy"]].to_numpy(np.float32):
            if not (np.hypot(kept[:, 0] - p[0], kept[:, 1] - p[1]) < r).any():
                kept = np.vstack([kept, p])
        out = pd.DataFrame({"mark_id": np.arange(len(kept), dtype="int32"), "x": kept[:, 0].astype(float), "y": kept[:, 1].astype(float)})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[schema.names]
    return dets.groupBy(*keys).applyInPandas(greedy, schema)


def merge_displaced(tracks: DataFrame, keys: list[str], centre: tuple[float, float], fraction: float = 0.35,
                    tracks_in_one_task: int = TRACKS_IN_ONE_TASK, tracks_in_a_block: int = TRACKS_IN_A_BLOCK) -> DataFrame:
    """Each track (``cand_id``, first, seen, x, y) with the earlier track it
    folds into (``into``, null if it stands): never seen together, not seen
    after it, and no farther from it than ``fraction`` of its own distance from
    the centre. A track is held against the earlier ones in their order, or
    against fewer that alone can fit, so pairs are neither listed nor written.
    Bigger keys go block against block, in rounds of four times as many blocks."""
    tracks = cut(tracks)  # read several times below
    hot, n_hot, in_hot = hot_keys(tracks, keys, tracks_in_one_task)
    parts = 1 + 8 * (tracks.count() - in_hot) // tracks_in_one_task
    seen = F.filter(F.col("seen").cast("array<bigint>"), lambda f: f.isNotNull())
    known = tracks.withColumn("_seen", seen).withColumn("_last", F.array_max("_seen")).withColumns(
        {"_x": F.col("x").cast("double"), "_y": F.col("y").cast("double")})
    schema = T.StructType([*tracks.schema.fields, T.StructField("into", tracks.schema["cand_id"].dataType)])
    columns = tracks.columns

    def whole(t: pa.Table) -> pa.Table:
        judged = np.flatnonzero(_judged(t))
        own = t.take(pa.array(judged))
        fit = _earliest_fit(own, own, keys, centre, fraction)
        into = np.full(t.num_rows, -1)
        into[judged[fit >= 0]] = judged[fit[fit >= 0]]
        return t.select(columns).append_column("into", t["cand_id"].take(pa.array(into, mask=into < 0)))

    few = null_safe_join(known, hot.select(*keys), keys, "left_anti") if n_hot else known
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)) if keys else F.lit(0)
    out = few.groupBy(part.alias("_part")).applyInArrow(whole, schema)
    if n_hot:
        many = null_safe_join(known, hot.select(*keys), keys, "left_semi")
        out = out.unionByName(_merged_by_blocks(many, keys, centre, fraction, tracks_in_a_block).select(schema.names))
    return out


def _merged_by_blocks(known: DataFrame, keys: list[str], centre: tuple[float, float], fraction: float, in_a_block: int) -> DataFrame:
    """The same with two blocks of tracks a task. A round tries those still open
    against the next blocks in the order of the earlier, four times as many as
    before; what fits in a round is earlier than all that fits in a later one."""
    earlier = deal(known.withColumn("_row", F.monotonically_increasing_id()), [*keys, "first", "cand_id"], in_a_block)
    tasks = int(earlier.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    judged = " and ".join(f"{c} is not null" for c in ("first", "_last", "_x", "_y"))
    slim = [*keys, "first", "cand_id", "_seen", "_last", "_x", "_y"]
    place = W.partitionBy(*keys).orderBy("_j") if keys else W.orderBy("_j")  # as many rows as a key has blocks
    targets = cut(earlier.filter(judged).groupBy(*keys, F.col("_block").alias("_j"))
                  .agg(F.min("first").alias("_from"), F.max("_last").alias("_until")).withColumn("_nth", F.row_number().over(place)))
    blocks = targets.agg(F.max("_nth").alias("n")).first()["n"] or 0
    schema = T.StructType([T.StructField("_row", T.LongType()), T.StructField("_first", earlier.schema["first"].dataType),
                           T.StructField("into", earlier.schema["cand_id"].dataType)])

    def tries(later: pa.Table, before: pa.Table) -> pa.Table:
        fit = _earliest_fit(before, later, keys, centre, fraction)
        hit = before.take(pa.array(fit[fit >= 0]))
        return pa.table({"_row": later["_row"].filter(pa.array(fit >= 0)), "_first": hit["first"], "into": hit["cand_id"]})

    def side(rows: DataFrame, pairs: DataFrame, end: str) -> DataFrame:
        met = null_safe_join(rows.withColumnRenamed("_block", end), pairs, [*keys, end])
        # new columns, for both sides come of one table; dealt by number, for few bytes are much work
        return met.select(*[F.col(c).alias(c) for c in met.columns]).repartition(tasks, "_i", "_j")

    open_, found, start, end = earlier.filter(judged).select("_row", "_block", *slim), [], 0, 1
    while start < blocks:
        tried = open_.groupBy(*keys, F.col("_block").alias("_i")).agg(F.max("first").alias("_to"), F.min("_last").alias("_since"))
        pairs = null_safe_join(tried, targets.filter((F.col("_nth") > start) & (F.col("_nth") <= end)), keys).filter(
            (F.col("_from") < F.col("_to")) & (F.col("_until") >= F.col("_since"))).select(*keys, "_i", "_j")
        pairs = broadcast_if_small(cut(pairs))
        hits = (side(open_, pairs, "_i").groupBy("_i", "_j")
                .cogroup(side(earlier.filter(judged).select("_block", *slim), pairs, "_j").groupBy("_i", "_j")).applyInArrow(tries, schema))
        found.append(cut(hits.groupBy("_row").agg(F.min(F.struct("_first", "into")).alias("_b"))))
        start, end = end, 5 * end + 1 - start
        if start < blocks:
            left = open_.join(found[-1].select("_row"), "_row", "left_anti").drop("_block")
            open_ = deal(left, [*keys, "_last"], in_a_block)  # few may be left, and these meet whole blocks
    out = earlier
    if found:
        best = found[0]
        for more in found[1:]:
            best = best.unionByName(more)
        return out.join(best, "_row", "left").withColumn("into", F.col("_b.into"))
    return out.withColumn("into", F.lit(None).cast(earlier.schema["cand_id"].dataType))


def _judged(t: pa.Table) -> np.ndarray:
    """Which tracks have all that folding asks for."""
    return np.logical_and.reduce([t[c].is_valid().to_numpy() for c in ("first", "_last", "_x", "_y")])


def _earliest_fit(before: pa.Table, later: pa.Table, keys: list[str], centre: tuple[float, float], fraction: float) -> np.ndarray:
    """For each track of ``later`` the row of the track of ``before`` it folds
    into, -1 if none. Tracks of equal keys meet, in the order of (first, cand_id).

    Most find one among the first few. One that does not goes on with the
    shortest list that must hold what fits: the rest in order, those seen late
    enough, or those near enough across or down.
    """
    n, m = before.num_rows, later.num_rows
    into = np.full(m, -1)
    if not n or not m:
        return into
    both = pa.concat_tables([t.select([*keys, "first", "_seen", "_last", "_x", "_y"]) for t in (before, later)]).combine_chunks()
    group, first = group_codes(both, keys), pc.rank(both["first"], tiebreaker="dense").to_numpy().astype(np.int64)
    order = pc.sort_indices(pa.table({"g": group[:n], "f": first[:n], "i": before["cand_id"]}),
                            sort_keys=[(c, "ascending") for c in "gfi"], null_placement="at_start").to_numpy()
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    code = group * (first.max() + 1) + first
    at, stop = (np.searchsorted(code[:n][order], c[n:]) for c in (group * (first.max() + 1), code))  # of one's key, and before one's own first
    x, y, last = (both[c].to_numpy() for c in ("_x", "_y", "_last"))
    reach = fraction * np.sqrt((x - centre[0]) ** 2 + (y - centre[1]) ** 2)
    seen = _Sightings(both["_seen"].combine_chunks())
    tries = max(1, TRIES_AT_ONCE // seen.bits.shape[1])

    def settle(own: np.ndarray, e: np.ndarray) -> None:
        """Try pairs, which stand in order for each of ``own``."""
        fits = last[e] >= last[n + own]
        own, e = own[fits], e[fits]
        fits = np.sqrt((x[n + own] - x[e]) ** 2 + (y[n + own] - y[e]) ** 2) <= reach[n + own]
        own, e = own[fits], e[fits]
        fits = seen.apart(n + own, e)
        hit, k = np.unique(own[fits], return_index=True)
        into[hit] = e[fits][k]

    def in_order(open_: np.ndarray, some: int) -> np.ndarray:
        """Those without a fit after ``some`` tries each, in order."""
        while len(open_) and some > 0:
            wide = max(1, min(some, tries // len(open_)))
            held = at[open_, None] + np.arange(wide)
            row, col = np.nonzero(held < stop[open_, None])
            settle(open_[row], order[held[row, col]])
            at[open_] += wide
            some -= wide
            open_ = open_[(into[open_] < 0) & (at[open_] < stop[open_])]
        return open_

    open_ = in_order(np.flatnonzero(at < stop), FIRST_TRIES)
    if not len(open_):
        return into
    own, ways = n + open_, []
    for value, low, high in ((last, last[own], None), (x, x[own] - reach[own], x[own] + reach[own]), (y, y[own] - reach[own], y[own] + reach[own])):
        slack = 0 if high is None else 1e-9 * (np.abs(value[own]) + reach[own])  # the tries decide at the edge
        ranked = np.sort(value[:n])
        rank = group[:n] * (n + 1) + np.searchsorted(ranked, value[:n])
        by = np.argsort(rank, kind="stable")
        upto = n if high is None else np.searchsorted(ranked, high + slack, "right")
        ways.append((by, *(np.searchsorted(rank[by], group[own] * (n + 1) + r) for r in (np.searchsorted(ranked, low - slack), upto))))
    lengths = np.stack([stop[open_] - at[open_], *(to - start for _, start, to in ways)])
    way = lengths.argmin(0)
    in_order(open_[way == 0], n)
    for w, (by, start, to) in enumerate(ways, 1):
        mine = np.flatnonzero((way == w) & (lengths[w] > 0))
        so_far = np.cumsum(lengths[w][mine])
        while len(mine):
            some = max(1, int(np.searchsorted(so_far, tries, "right")))
            now, length = mine[:some], lengths[w][mine[:some]]
            at_row = np.repeat(now, length)
            e = by[np.arange(len(at_row)) - np.repeat(np.cumsum(length) - length, length) + start[at_row]]
            held = open_[at_row]
            keep = (place[e] >= at[held]) & (place[e] < stop[held]) & (last[e] >= last[n + held])
            held, e = held[keep], e[keep]
            sorted_ = np.lexsort((place[e], held))
            settle(held[sorted_], e[sorted_])
            mine, so_far = mine[some:], so_far[some:] - so_far[some - 1]
    return into


class _Sightings:
    """Frames of each track as bits; where there are more frames than bits, frames share
    bits, and what these leave open is looked up among the frames."""

    def __init__(self, seen: pa.ListArray):
        row, frame = pc.list_parent_indices(seen).to_numpy().astype(np.int64), pc.list_flatten(seen).to_numpy()
        low, n = frame.min(), len(seen)
        need = int((frame.max() - low) // 64 + 1)
        words = min(need, max(16, SIGHTING_WORDS // n))
        bit = (frame - low) % (64 * words)
        self.bits, self.exact = np.zeros((n, words), np.uint64), words == need
        np.bitwise_or.at(self.bits.reshape(-1), row * words + bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
        if not self.exact:
            order = np.lexsort((frame, row))
            self.frames, self.bounds = frame[order], np.searchsorted(row[order], np.arange(n + 1))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which pairs share no frame; of those of one ``a``, which stand together, all up to the first of them at least."""
        free = np.zeros(len(a), bool)
        at_once = max(1, 8 * TRIES_AT_ONCE // self.bits.shape[1])
        for p in range(0, len(a), at_once):
            free[p:p + at_once] = ~(self.bits[a[p:p + at_once]] & self.bits[b[p:p + at_once]]).any(1)
        if not self.exact:
            done = -1
            for k in range(len(a)):
                if a[k] != done:
                    free[k] = free[k] or not self._shared(a[k], b[k])
                    done = a[k] if free[k] else done
        return free

    def _shared(self, a: int, b: int) -> bool:
        one, other = (self.frames[self.bounds[i]:self.bounds[i + 1]] for i in (a, b))
        at = np.minimum(np.searchsorted(other, one), len(other) - 1)
        return bool((other[at] == one).any())


def _same_marks(cands: DataFrame, changes: DataFrame, keys: list[str], floor: float) -> DataFrame:
    """Pairs of candidates and change points that are the same mark. No pair
    farther apart than the floor or the largest diagonal can be."""
    diag = lambda df: df.agg(F.max(F.hypot("w", "h")).alias("d")).first()["d"] or 0.0
    radius = max(floor, (diag(cands) + diag(changes)) / 2)
    a = cands.select(*keys, *[c for c in cands.columns if c not in (*keys, "cx", "cy")], F.col("cx").alias("x"), F.col("cy").alias("y"))
    b = changes.select(*keys, F.col("frame").alias("change_frame"), F.col("cx").alias("x"), F.col("cy").alias("y"),
                       F.col("w").alias("bw"), F.col("h").alias("bh"))
    box = lambda x, y, w, h: F.struct(F.col(x).alias("cx"), F.col(y).alias("cy"), F.col(w).alias("w"), F.col(h).alias("h"))
    pairs = distance_join(a, b, radius * 1.000001 or 1.0, keys)
    return pairs.filter(x_same_mark(box("bx", "by", "bw", "bh"), box("x", "y", "w", "h"), floor))


def corroborated(cands: DataFrame, changes: DataFrame, keys: list[str], floor: float = MATCH_PX) -> DataFrame:
    """Candidates with a flag: some change point is the same mark. Places
    are deduplicated, for only whether there is one counts."""
    spots = changes.groupBy(*keys, "cx", "cy", "w", "h").agg(F.min("frame").alias("frame"))
    hit = _same_marks(cands, spots, keys, floor).select(*keys, "cand_id").distinct().withColumn("corroborated", F.lit(True))
    return null_safe_join(cands, hit, [*keys, "cand_id"], "left").withColumn("corroborated", F.coalesce("corroborated", F.lit(False)))


def announce(persisted: DataFrame, changes: DataFrame, keys: list[str], floor: float = MATCH_PX) -> DataFrame:
    """When each persisted candidate (``persisted_frame``) is announced:
    at once if a change point up to then is the same mark, else at the first
    later one that is; null while none is."""
    pairs = _same_marks(persisted, changes, keys, floor)
    when = pairs.groupBy(*keys, "cand_id").agg(F.min(F.greatest("change_frame", "persisted_frame")).alias("announced_frame"))
    return null_safe_join(persisted, when, [*keys, "cand_id"], "left")


def new_marks_of_run(looks: DataFrame, keys: list[str], outlines: DataFrame | None = None, changes: DataFrame | None = None,
                     match_px: float = MATCH_PX) -> DataFrame:
    """Baseline from the first frames, known marks stripped from later
    looks, the rest tracked and judged; then, when given, change evidence asked
    for and the target each new mark is on."""
    base = baseline_marks(looks, keys, match_px)
    later = looks.filter(F.col("frame") >= BASELINE_FRAMES)
    dets = (later.filter(F.col("status") == "registered")
            .select(*keys, "frame", F.posexplode("detections").alias("_pos", "_d"))
            .select(*keys, "frame", "_pos", "_d.*").withColumnsRenamed({"cx": "x", "cy": "y"}))
    kept, _ = strip_known(dets, base, match_px, keys)
    back = kept.groupBy(*keys, "frame").agg(F.sort_array(F.collect_list(F.struct(
        "_pos", F.col("x").alias("cx"), F.col("y").alias("cy"), "w", "h"))).alias("_l"))
    stripped = null_safe_join(later.select(*keys, "frame", "status"), back, [*keys, "frame"], "left").withColumn(
        "detections", F.transform("_l", lambda s: F.struct(s["cx"].alias("cx"), s["cy"].alias("cy"), s["w"].alias("w"), s["h"].alias("h")))).drop("_l")
    stripped = cut(stripped)
    tracks = cut(retrack(stripped, keys, match_px))  # the fold runs once, what follows reads it
    verdicts = persistence(tracks, stripped, keys).filter(F.col("verdict") == "persisted")
    marks = null_safe_join(candidates(tracks, keys), verdicts.select(*keys, "cand_id", "persistence"), [*keys, "cand_id"])
    if changes is not None:
        marks = corroborated(marks, changes, keys, match_px).filter("corroborated")
    if outlines is not None:
        placed = assign_polygon(marks.withColumnsRenamed({"cx": "x", "cy": "y"}), outlines, keys, "cand_id")
        marks = placed.withColumnsRenamed({"x": "cx", "y": "cy"})
    return marks


def sighting_share(holes: DataFrame, tracks: DataFrame, looks: DataFrame, keys: list[str]) -> DataFrame:
    """Share of registered looks since a mark's first that saw it. Looks
    are counted from the end once, then each mark reads the count at its first."""
    reg = looks.filter(F.col("status") == "registered").select(*keys, F.col("frame").cast("long").alias("frame"))
    back = reg.withColumn("_back", -F.col("frame"))
    since = Ordered(back, keys, ["_back"]).row_number("looks_since").done().select(*keys, F.col("frame").alias("first"), "looks_since")
    seen = tracks.groupBy(*keys, "cand_id").agg(F.count_distinct("frame").alias("frames_seen"))
    rows = null_safe_join(holes.select(*keys, "cand_id", "first"), seen, [*keys, "cand_id"])
    return null_safe_join(rows, since, [*keys, "first"], "left").withColumn(
        "share", F.try_divide(F.col("frames_seen"), F.col("looks_since")))


def replay_buckets(df: DataFrame, ts: str, id: str, start, end, interval_ms: int, cap: int = 1000, keys: list[str] = ()) -> DataFrame:
    """Rows of ``[start, end)`` by step of ``interval_ms``; within a step
    the gap filter keeps one row per interval, and ``cap`` bounds it. A step is
    one interval long, so it keeps its first row and any the filter passes."""
    from boardsight.operators.paging import gap_filter
    from boardsight.sources.signals import time_range
    rows = time_range(df, ts, start, end, closed="left")
    origin = F.unix_micros(F.lit(start).cast("timestamp"))
    step = F.floor((F.unix_micros(F.col(ts).cast("timestamp")) - origin) / (interval_ms * 1000)).cast("long")
    rows = rows.withColumn("bucket", step)
    kept = gap_filter(rows, ts, id, interval_ms, [*keys, "bucket"])
    ranked = Ordered(kept, [*keys, "bucket"], [ts, id]).row_number("_rn").done()
    return ranked.filter(F.col("_rn") <= cap).drop("_rn")


def reassemble(segments: DataFrame, keys: list[str], ts: str = "timestamp", seq: str = "seq", data: str = "payload",
               idle_s: float = 5, ends: str | None = None, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """U16: the text of each burst of segments: those of one stream no more
    than ``idle_s`` apart, a repeated sequence number counting once (the last
    sent), put together in sequence order.

    With ``ends``, a pattern closing a message, a burst is put together message
    by message, so a stream that never falls idle still makes bounded texts.
    """
    gap = (F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.col("_p").cast("timestamp"))) / 1e6
    seen = Ordered(segments, keys, [ts, seq], rows_per_slice).lag(_p=ts)
    seen.df = seen.df.withColumn("_new", (F.col("_p").isNull() | (gap >= idle_s)).cast("long"))
    rows = seen.running_sum("burst", F.col("_new")).done()
    last = rows.groupBy(*keys, "burst", seq).agg(F.max_by(F.col(data), F.col(ts)).alias("_d"), F.min(ts).alias("_t0"))
    by = [*keys, "burst"]
    if ends is not None:
        closes = F.col("_d").cast("string").rlike(ends).cast("long")
        last = Ordered(last.withColumn("_end", closes), by, [seq], rows_per_slice).running_sum("_ended", F.col("_end")).done()
        last, by = last.withColumn("message", F.col("_ended") - F.col("_end")), [*by, "message"]
    # joined as hex: a character may be split over two segments
    packed = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.hex("_d").alias("d"))))
    whole = F.unhex(F.array_join(F.transform(packed, lambda p: p["d"]), "")).cast("string")
    return last.groupBy(*by).agg(
        F.min("_t0").alias("started"), F.count(F.lit(1)).alias("segments"), whole.alias("text"))


def decode_onvif(segments: DataFrame, keys: list[str] = ("src_ip", "src_port", "dst_ip", "dst_port"), **how) -> DataFrame:
    """Picture rows from TCP segments, one per burst, its first
    envelope deciding."""
    keys = list(keys)
    texts = reassemble(segments, keys, ends="(?i)</(SOAP-ENV|s):Envelope>", **how)
    texts = texts.withColumn("envelope", fn.x_envelope(F.col("text"))).filter(F.col("envelope").isNotNull())
    rows = texts.groupBy(*keys, "burst").agg(F.min_by(F.struct("started", "envelope"), "message").alias("_m")).select(*keys, "_m.*")
    is_cmd = F.col("src_port") != fn.PICTURE_REPORT_PORT
    out = picture_rows(rows.withColumnRenamed("started", "timestamp").withColumn("isCmd", is_cmd)).drop("envelope")
    return out.withColumn("id", fn.x_signal_key(F.lit("onvif"), F.col("description"), F.col("isCmd")))


def picture_rows(rows: DataFrame, envelope: str = "envelope") -> DataFrame:
    """Rows with an envelope that says something, and what it says."""
    e = F.col(envelope)
    parts = once(rows, {"_token": fn.x_element(e, "ProfileToken"), "_zoom": fn.x_element(e, "Zoom", "x"),
                        "_power": fn.x_element(e, "Power", "name"), "_measured": fn.x_element(e, "Measurement")})
    fields = fn.x_picture_fields(*[F.col(c) for c in ("_token", "_zoom", "_power", "_measured")])
    return once(parts, fields).drop("_token", "_zoom", "_power", "_measured").filter(F.col("description").isNotNull())

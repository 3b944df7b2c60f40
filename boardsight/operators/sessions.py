"""Sessions, holes, runs and boards (J1-J7, J16, J18, J21, J22, W2-W4, A1, A2,
S12, S15, U18, U20, U21)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from boardsight.core.ordered import ROWS_PER_SLICE, Ordered, null_safe_join
from boardsight.functions import text as tx
from boardsight.operators.filters import not_deleted


def sessions_with_counts(sessions: DataFrame, holes: DataFrame) -> DataFrame:
    """Every session with its active holes counted, newest first. Holes are
    counted before the join, so one huge session is one row by then."""
    counts = not_deleted(holes).groupBy(F.col("session_id").alias("id")).agg(F.count(F.lit(1)).alias("hole_count"))
    joined = sessions.join(counts, "id", "left").withColumn("hole_count", F.coalesce("hole_count", F.lit(0)))
    return joined.orderBy(F.col("created_at").desc(), "id")


def nested(df: DataFrame, keys: list[str], order: list[str], item: list[str], name: str,
           per_row: int = 10_000, rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Rows of each key as arrays in order. A key with more than ``per_row``
    rows goes on in further rows, numbered by ``part``, so that no row grows
    without bound."""
    ranked = Ordered(df, keys, order, rows_per_slice).row_number("_rn").done()
    part = ranked.withColumn("part", F.floor((F.col("_rn") - 1) / per_row).cast("int"))
    packed = F.sort_array(F.collect_list(F.struct(F.col("_rn"), F.struct(*item).alias("v"))))
    return (part.groupBy(*keys, "part").agg(packed.alias("_l"))
            .withColumn(name, F.transform("_l", lambda s: s["v"])).drop("_l"))


def session_detail(sessions: DataFrame, holes: DataFrame, runs: DataFrame,
                   per_row: int = 10_000) -> DataFrame:
    """Sessions with their active holes (board and rank order) and runs (by
    ``taken_at``) nested, empty if there are none. Every session has a row of
    ``part`` 0; what goes on past ``per_row`` is in the rows of later parts."""
    active = not_deleted(holes).withColumnRenamed("session_id", "sid")
    hole_cols = [c for c in active.columns if c not in ("sid", "deleted_at")]
    ordered = active.withColumn("_b", F.coalesce("camera_alias", F.lit("￿")))
    held = nested(ordered, ["sid"], ["_b", "rank", "id"], hole_cols, "bullet_holes", per_row)
    run_cols = [c for c in runs.columns if c != "session_id"]
    watched = nested(runs.withColumnRenamed("session_id", "sid"), ["sid"], ["taken_at", "id"], run_cols, "runs", per_row)
    both = held.join(watched, ["sid", "part"], "full_outer").withColumnRenamed("sid", "id")
    full = sessions.join(both, "id", "left").withColumn("part", F.coalesce("part", F.lit(0)))
    kinds = {c: full.schema[c].dataType for c in ("bullet_holes", "runs")}
    return full.withColumns({c: F.coalesce(c, F.array().cast(kind)) for c, kind in kinds.items()})


def range_tree(ranges: DataFrame, events: DataFrame, hits: DataFrame, targets: DataFrame) -> DataFrame:
    """Ranges down to hits, with the target each hit is on. Small tables
    are broadcast by the optimizer's own size check."""
    r = ranges.select(F.col("id").alias("range_id"), F.col("description").alias("range_description"))
    e = events.select(F.col("id").alias("event_id"), "range_id", F.col("start_time").alias("event_start"))
    t = targets.select(F.col("id").alias("target_id"), "center_x", "center_y")
    h = hits.select(F.col("id").alias("hit_id"), "event_id", "target_id", "range_to_target", "pos_x", "pos_y")
    return (h.join(e, "event_id").join(r, "range_id").join(t, "target_id", "left"))


def cascade_delete(parents: DataFrame, child: DataFrame, fk: str, key: str = "id") -> DataFrame:
    """Children whose parent is still there (or who have none)."""
    kept = child.join(parents.select(F.col(key).alias(fk)), fk, "left_semi")
    return kept.unionByName(child.filter(F.col(fk).isNull())).select(child.columns)


def latest_at(points: DataFrame, marks: DataFrame, keys: list[str], point_ts: str, mark_ts: str,
              cols: list[str], tie: list[str] = (), rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """As-of join: for each point the columns of the last mark at or before it,
    as struct ``asof`` (null if none). One sort of both sides together, with
    hot keys sliced."""
    point_cols = [c for c in points.columns if c not in keys]
    left = points.select(*keys, F.col(point_ts).alias("_t"), F.lit(1).alias("_side"),
                         F.struct(*point_cols).alias("_p"), F.lit(None).alias("_m"))
    right = marks.select(*keys, F.col(mark_ts).alias("_t"), F.lit(0).alias("_side"),
                         F.lit(None).alias("_p"), F.struct(*cols).alias("_m"), *[F.col(c).alias(f"_tie_{c}") for c in tie])
    both = left.unionByName(right, allowMissingColumns=True)
    order = ["_t", "_side", *[f"_tie_{c}" for c in tie]]
    seen = Ordered(both, keys, order, rows_per_slice).last_known("asof", F.col("_m")).done()
    return seen.filter(F.col("_side") == 1).select(*keys, "_p.*", "asof")


def asof_or_first(holes: DataFrame, runs: DataFrame, keys: list[str] = ("session_id",),
                  ts: str = "first_seen_at", run_ts: str = "taken_at", run_id: str = "id",
                  rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The run each hole belongs to: the latest taken at or before it, else
    the first."""
    keys = list(keys)
    first = runs.groupBy(*keys).agg(F.min_by(F.struct(run_id, run_ts), F.struct(run_ts, run_id)).alias("_first"))
    found = latest_at(holes, runs, keys, ts, run_ts, [run_id, run_ts], [run_id], rows_per_slice)
    run = F.coalesce(F.col("asof"), F.col("_first"))
    return found.join(first, keys, "left").select(
        *[c for c in found.columns if c != "asof"],
        run[run_id].alias("run_id"), run[run_ts].alias("run_taken_at"))


def asof_bounded(points: DataFrame, places: DataFrame, keys: list[str], ts: str, until: str,
                 at: str = "at", cols: list[str] = ("at",), tie: list[str] = (),
                 rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """The last place at or before each point, null past ``until`` (a
    column of the points)."""
    found = latest_at(points, places, keys, ts, at, list(cols), list(tie), rows_per_slice)
    return found.withColumn("asof", F.when(F.col(ts) <= F.col(until), F.col("asof")))


def from_earlier_run(holes: DataFrame, runs: DataFrame, current: DataFrame, keys: list[str] = ("session_id",),
                     ts: str = "first_seen_at", run_ts: str = "taken_at", run_id: str = "id") -> DataFrame:
    """Flag holes that belong to another run than the current one of their
    key (``current``: keys and ``taken_at``)."""
    keys = list(keys)
    owned = asof_or_first(holes, runs, keys, ts, run_ts, run_id)
    now = current.select(*keys, F.col(run_ts).alias("_now"))
    return owned.join(now, keys, "left").withColumn(
        "from_earlier", F.coalesce(F.col("run_taken_at") != F.col("_now"), F.lit(False))).drop("_now")


def boards_of(cameras: DataFrame, detections: DataFrame, groupings: DataFrame, holes: DataFrame,
              runs: DataFrame, keys: list[str] = ("session_id",)) -> DataFrame:
    """Boards per session in order: enabled cameras in theirs, then aliases
    only seen in detections, groupings, holes or runs by first sight, and last
    the no-board entry when a hole or grouping has none. Cameras carry ``pos``,
    the others ``pos`` too, their order of appearance."""
    keys = list(keys)
    sources = [detections, groupings, holes, runs]
    seen = [s.filter(F.col("camera_alias").isNotNull()).groupBy(*keys, "camera_alias")
            .agg(F.struct(F.lit(i + 1).alias("source"), F.min("pos").alias("pos")).alias("at"))
            for i, s in enumerate(sources)]
    sessions = reduce(lambda a, b: a.unionByName(b), [s.select(*keys).distinct() for s in sources]).distinct()
    enabled = cameras.filter("enabled").select(F.col("alias").alias("camera_alias"), F.col("pos").alias("_pos"))
    # every session lists every enabled camera: that product is the result itself
    names = enabled.agg(F.sort_array(F.collect_list(F.struct("_pos", "camera_alias"))).alias("_all"))
    listed = (sessions.join(F.broadcast(names)).withColumn("_c", F.explode("_all")).select(*keys, "_c.*"))
    first = listed.select(*keys, "camera_alias", F.struct(F.lit(0).alias("source"), F.col("_pos").alias("pos")).alias("at"))
    named = reduce(lambda a, b: a.unionByName(b), [first, *seen]).groupBy(*keys, "camera_alias").agg(F.min("at").alias("at"))
    nameless = [s.filter(F.col("camera_alias").isNull()).select(*keys).distinct() for s in (groupings, holes)]
    last = nameless[0].unionByName(nameless[1]).distinct().select(
        *keys, F.lit(None).cast("string").alias("camera_alias"),
        F.struct(F.lit(9).alias("source"), F.lit(0).cast("long").alias("pos")).alias("at"))
    named = named.withColumn("at", F.struct(F.col("at.source").alias("source"), F.col("at.pos").cast("long").alias("pos")))
    every = named.unionByName(last)
    order = W.partitionBy(*keys).orderBy("at", F.col("camera_alias").asc_nulls_last())
    return every.withColumn("board_order", F.row_number().over(order)).drop("at")


def backfill_alias(holes: DataFrame, sessions: DataFrame, cameras: DataFrame, runs: DataFrame) -> DataFrame:
    """A hole's alias: its session's camera's, else the least alias of the
    session's runs."""
    own = (sessions.select(F.col("id").alias("session_id"), "camera_id")
           .join(cameras.select(F.col("id").alias("camera_id"), F.col("alias").alias("_own")), "camera_id", "left")
           .select("session_id", "_own"))
    any_run = runs.filter(F.col("camera_alias").isNotNull()).groupBy("session_id").agg(F.min("camera_alias").alias("_run"))
    return (holes.join(own, "session_id", "left").join(any_run, "session_id", "left")
            .withColumn("camera_alias", F.coalesce("_own", "_run")).drop("_own", "_run"))


def name_taken(names: DataFrame, candidates: DataFrame, name: str = "name", id: str = "id") -> DataFrame:
    """Candidates whose trimmed, case-folded name another row holds. Each
    name key is summed up first, so a name borne by a third of all rows is one
    row by the join."""
    held = (names.groupBy(tx.x_name_key(F.col(name)).alias("_k"))
            .agg(F.min(id).alias("_lo"), F.max(id).alias("_hi")))
    other = (F.col("_lo") != F.col(id)) | (F.col("_hi") != F.col(id))
    return (candidates.withColumn("_k", tx.x_name_key(F.col(name))).join(held, "_k", "left")
            .withColumn("taken", F.coalesce(other, F.lit(False))).drop("_k", "_lo", "_hi"))


def diff_wanted(wanted: DataFrame, runs: DataFrame, keys: list[str]) -> DataFrame:
    """Runs no longer wanted (``end``) and wanted boards with none (``start``)."""
    ends = null_safe_join(runs.select(*keys).distinct(), wanted.select(*keys).distinct(), keys, "left_anti")
    starts = null_safe_join(wanted.select(*keys).distinct(), runs.select(*keys).distinct(), keys, "left_anti")
    return ends.withColumn("action", F.lit("end")).unionByName(starts.withColumn("action", F.lit("start")))


def rank_per_board(df: DataFrame, keys: list[str] = ("session_id", "camera_alias"),
                   order: list[str] = ("created_at", "id"), rows_per_slice: int = ROWS_PER_SLICE) -> DataFrame:
    """Insertion rank 1..n over the holes not deleted."""
    live = not_deleted(df) if "deleted_at" in df.columns else df
    return Ordered(live, list(keys), list(order), rows_per_slice).row_number("rank").done()


def close_ranks(df: DataFrame, keys: list[str] = ("session_id", "camera_alias")) -> DataFrame:
    """Ranks after deletes; those after a deleted hole move up."""
    return rank_per_board(df.drop("rank"), keys)


def latest(df: DataFrame, keys: list[str], ts: str, tie: list[str] = ()) -> DataFrame:
    """The newest row per key, by a partial aggregate rather than a sort."""
    rest = [c for c in df.columns if c not in keys]
    return (df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(ts, *tie)).alias("_row"))
            .select(*keys, "_row.*"))


def count_rows(df: DataFrame, keys: list[str] = (), where: Column | None = None) -> DataFrame:
    """A1."""
    counted = F.count(F.lit(1)) if where is None else F.count_if(where)
    return df.groupBy(*keys).agg(counted.alias("n"))


def distinct_boards(runs: DataFrame, session: str | None = None) -> DataFrame:
    """A2."""
    df = runs if session is None else runs.filter(F.col("session_id") == session)
    return df.select("session_id", "camera_alias").distinct()


def export_holes(df: DataFrame) -> DataFrame:
    """Holes by session, board (none last) and rank."""
    return df.orderBy("session_id", F.col("camera_alias").asc_nulls_last(), "rank").select(
        "session_id", F.coalesce("camera_alias", F.lit("")).alias("board"), "rank", "first_seen_at",
        "position_x", "position_y")


def export_gate(sessions: DataFrame, session: str | None = None) -> DataFrame:
    """The sessions that may be exported, completed ones."""
    done = sessions.filter(F.col("status") == "completed")
    return done if session is None else done.filter(F.col("id") == session)


def fold_events(events: DataFrame, header_keys: list[str] = ("session_id",)) -> tuple[DataFrame, DataFrame]:
    """(holes, session headers) after an event log with ``type``, ``seq``.
    The last event of each id decides; ranks close up per board."""
    keys = list(header_keys)
    holes = events.filter(F.col("type").isin("bullet_created", "bullet_deleted"))
    rest = [c for c in holes.columns if c not in (*keys, "bullet_id", "seq")]
    last = (holes.groupBy(*keys, "bullet_id")
            .agg(F.max_by(F.struct(*rest), "seq").alias("_e")).select(*keys, "bullet_id", "_e.*"))
    alive = last.filter(F.col("type") == "bullet_created")
    ranked = (Ordered(alive.withColumnRenamed("rank", "_was"), [*keys, "camera_alias"], ["_was", "bullet_id"])
              .row_number("rank").done().drop("_was", "type"))
    headers = (events.filter(F.col("type") == "session_updated").groupBy(*keys)
               .agg(F.max_by(F.struct("name", "status", "ended_at"), "seq").alias("_h")).select(*keys, "_h.*"))
    return ranked, headers


def change_report(versions: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """One row per change between successive versions of a row: completed
    (with its duration), reopened, renamed."""
    seen = Ordered(versions, [key], [seq]).lag(_name="name", _status="status").done()
    status = F.when(F.col("status") != F.col("_status"), F.when(F.col("status") == "completed", "completed").otherwise("reopened"))
    renamed = F.when(F.col("name") != F.col("_name"), F.lit("renamed"))
    rows = seen.withColumn("change", F.explode(F.filter(F.array(status, renamed), lambda c: c.isNotNull())))
    took = (F.unix_micros("ended_at") - F.unix_micros("started_at")) / 1e6
    return rows.select(
        key, seq, "change",
        F.when(F.col("change") == "completed", took).alias("duration_s"),
        F.when(F.col("change") == "renamed", F.col("_name")).alias("previous_name"))


def end_times(changes: DataFrame, key: str, ts: str = "ts", tie: list[str] = ()) -> DataFrame:
    """Status and end time per row after its changes: the first completion
    since the last reopening sets it, reopening clears it."""
    active = F.when(F.col("status") == "active", F.struct(ts, *tie))
    reopened = changes.groupBy(key).agg(F.max(active).alias("_re"), F.max_by("status", F.struct(ts, *tie)).alias("status"))
    after = changes.withColumnRenamed("status", "_s").join(reopened, key).filter(
        (F.col("_s") == "completed") & (F.col("_re").isNull() | (F.struct(ts, *tie) > F.col("_re"))))
    ended = after.groupBy(key).agg(F.min(ts).alias("ended_at"))
    return reopened.select(key, "status").join(ended, key, "left")

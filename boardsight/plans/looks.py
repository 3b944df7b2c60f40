"""Queries over looks, tracks, series and streams' batch forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardsight.core.ordered import Ordered
from boardsight.operators import filters, scoring as sc, series, tracking as tk
from boardsight.plans import views as v
from boardsight.plans.registry import Tables, query

r6 = lambda c: F.round(c, 6).alias(c)


@query("f6_due_frames", f"SELECT user_id, frame FROM {v.LOOKS} WHERE frame < 5 OR frame % 4 = 0")
def _(t: Tables):
    return filters.due_frames(v.looks(t), "frame", 4).select("user_id", "frame")


@query("f7_sample_every", f"SELECT user_id, frame FROM {v.LOOKS} WHERE frame % greatest(1, CAST(round_even((user_id % 6 + 0.5) * 1.0, 0) AS BIGINT)) = 0")
def _(t: Tables):
    return filters.sample_every(v.looks(t), "frame", F.col("user_id") % 6 + 0.5, 1.0).select("user_id", "frame")


SEEN = f"(SELECT user_id, frame, event_type IN ('view', 'signup') AS seen FROM {v.LOOKS} WHERE status = 'registered')"


@query("w5_longest_blind_run", f"""WITH s AS (SELECT *, sum(CAST(seen AS INT)) OVER (PARTITION BY user_id ORDER BY frame) AS g FROM {SEEN}),
  r AS (SELECT user_id, g, min(frame) AS blind_first, max(frame) AS blind_last, count(*) AS blind_frames FROM s WHERE NOT seen GROUP BY ALL)
  SELECT user_id, blind_first, blind_last, blind_frames FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY blind_frames DESC, blind_first) = 1""")
def _(t: Tables):
    seen = v.looks(t).filter("status = 'registered'").select("user_id", "frame", F.col("event_type").isin("view", "signup").alias("seen"))
    return series.longest_blind_run(seen, ["user_id"])


SERIES = f"(SELECT user_id, frame AS i, value + CASE WHEN frame >= 30 + user_id % 20 THEN 400 ELSE 0 END AS d FROM {v.LOOKS})"


@query("w6_step_arrival", f"""WITH w AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, quantile_cont(d, 0.5) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 24 FOLLOWING) AS a,
   quantile_cont(d, 0.5) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN 25 PRECEDING AND 1 PRECEDING) AS b, min(d) OVER (PARTITION BY user_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS h FROM {SERIES}),
  j AS (SELECT *, a - b AS rise, max(a - b) OVER (PARTITION BY user_id) AS top FROM w WHERE i >= 3 AND i <= n - 25),
  f AS (SELECT user_id, min(i) AS f FROM j WHERE rise >= top / 2 GROUP BY 1),
  p AS (SELECT user_id, i AS at_i, (a + b) / 2 AS mid FROM j JOIN f USING (user_id) WHERE i >= f AND i < f + 25 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY rise DESC, i) = 1)
  SELECT p.user_id, coalesce(min(w.i) FILTER (w.i >= at_i - 25 AND w.i < at_i + 25 AND w.i < n - 3 AND h >= mid), any_value(at_i)) AS arrival FROM p JOIN w ON w.user_id = p.user_id GROUP BY p.user_id""")
def _(t: Tables):
    rows = v.looks(t).select("user_id", "frame", (F.col("value") + F.when(F.col("frame") >= 30 + F.col("user_id") % 20, 400).otherwise(0)).alias("d"))
    return series.step_arrival(rows, ["user_id"])


WANDER = f"""(SELECT user_id, frame, x, y, sqrt(mx * mx + my * my) AS drift, sqrt((x - mx) ** 2 + (y - my) ** 2) AS jitter FROM (SELECT user_id, frame, x, y,
  (sx + greatest(0, 12 - (frame - f0)) * x0 + greatest(0, 12 - (f1 - frame)) * x1) / (n + greatest(0, 12 - (frame - f0)) + greatest(0, 12 - (f1 - frame))) AS mx,
  (sy + greatest(0, 12 - (frame - f0)) * y0 + greatest(0, 12 - (f1 - frame)) * y1) / (n + greatest(0, 12 - (frame - f0)) + greatest(0, 12 - (f1 - frame))) AS my
  FROM (SELECT *, count(*) OVER r AS n, sum(x) OVER r AS sx, sum(y) OVER r AS sy FROM (SELECT user_id, frame, value AS x, value % 7 AS y, min(frame) OVER (PARTITION BY user_id) AS f0, max(frame) OVER (PARTITION BY user_id) AS f1,
    first_value(value) OVER p AS x0, last_value(value) OVER p AS x1, first_value(value % 7) OVER p AS y0, last_value(value % 7) OVER p AS y1 FROM {v.LOOKS} WHERE status = 'registered'
    WINDOW p AS (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) WINDOW r AS (PARTITION BY user_id ORDER BY frame RANGE BETWEEN 12 PRECEDING AND 12 FOLLOWING))))"""


def _wander(t: Tables):
    rows = v.looks(t).filter("status = 'registered'").select("user_id", "frame", F.col("value").alias("x"), (F.col("value") % 7).alias("y"))
    return series.drift_jitter(rows, ["user_id"], "frame", "x", "y")


@query("w7_drift_jitter", f"SELECT user_id, frame, round(drift, 6) AS drift, round(jitter, 6) AS jitter FROM {WANDER}")
def _(t: Tables):
    return _wander(t).select("user_id", "frame", r6("drift"), r6("jitter"))


@query("a20_wander_summary", f"""SELECT user_id, count(*) AS frames, round(quantile_cont(sqrt(x * x + y * y), 0.5), 6) AS median, round(quantile_cont(sqrt(x * x + y * y), 0.95), 6) AS p95, round(max(sqrt(x * x + y * y)), 6) AS max,
  round(quantile_cont(drift, 0.95), 6) AS drift_p95, round(quantile_cont(jitter, 0.95), 6) AS jitter_p95 FROM {WANDER} GROUP BY 1""")
def _(t: Tables):
    out = sc.wander_summary(_wander(t).withColumn("error", F.hypot("x", "y")), ["user_id"])
    return out.select("user_id", "frames", *[r6(c) for c in ("median", "p95", "max", "drift_p95", "jitter_p95")])


# timestamps of one origin: seconds of the event time read as milliseconds
ORIGIN = """(SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i, (epoch_us(ts) // 1000000 - min(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id)) // 8 AS ms FROM events)"""


def _timed(t: Tables):
    first = t.events.groupBy("user_id").agg(F.min("ts").alias("_t0"))
    s = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    return t.events.join(first, "user_id").withColumn("ms", F.floor((s("ts") - s("_t0")) / 8).cast("long")).drop("_t0")


@query("w14_frame_index", f"""WITH RECURSIVE o AS {ORIGIN},
r AS (SELECT user_id, event_id, i, ms, CAST(0 AS BIGINT) AS frame, false AS untimed, ms AS o_ms, CAST(0 AS BIGINT) AS o_at, CAST(NULL AS BIGINT) AS t_ms, CAST(NULL AS BIGINT) AS t_at FROM o WHERE i = 0
  UNION ALL SELECT user_id, event_id, i, ms, frame, kind = 'untimed', CASE kind WHEN 'head' THEN ms WHEN 'timed' THEN o_ms END, CASE kind WHEN 'head' THEN frame WHEN 'timed' THEN o_at END,
    CASE WHEN kind = 'timed' OR kind = 'head' AND t_ms < ms THEN ms ELSE t_ms END, CASE WHEN kind = 'timed' OR kind = 'head' AND t_ms < ms THEN frame ELSE t_at END
  FROM (SELECT o.*, r.o_ms, r.o_at, r.t_ms, r.t_at, CASE WHEN o.ms <= r.ms THEN 'untimed' WHEN r.o_ms IS NULL THEN 'head' ELSE 'timed' END AS kind,
    CAST(greatest(r.frame + 1, CASE WHEN o.ms <= r.ms THEN 0 WHEN r.o_ms IS NULL THEN CASE WHEN r.t_ms < o.ms THEN r.t_at + round_even((o.ms - r.t_ms) / 40.0, 0) ELSE 0 END
      ELSE r.o_at + round_even((o.ms - r.o_ms) / 40.0, 0) END) AS BIGINT) AS frame FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
SELECT event_id, frame, untimed FROM r""")
def _(t: Tables):
    return series.frame_index(_timed(t), ["user_id"], "ts", "ms").select("event_id", "frame", "untimed")


@query("w14_unseen_frames", f"""WITH l AS (SELECT user_id, frame, lead(frame) OVER (PARTITION BY user_id ORDER BY frame) AS nx FROM {v.LOOKS} WHERE event_type = 'view')
  SELECT user_id, unnest(generate_series(frame + 1, nx - 1)) AS frame FROM l WHERE nx - frame > 1 QUALIFY true""".replace("SELECT user_id, unnest", "SELECT * FROM (SELECT user_id, unnest").replace("QUALIFY true", ") WHERE frame < 5 OR frame % 3 = 0"))
def _(t: Tables):
    gaps = series.frame_gaps(v.looks(t).filter("event_type = 'view'"), ["user_id"])
    return series.unseen_frames(gaps, ["user_id"], 3, 5)


@query("w15_lost_runs", f"""SELECT user_id, frame, frame - 1 - coalesce(max(CASE WHEN status <> 'lost' THEN frame END) OVER (PARTITION BY user_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1) AS lost_before FROM {v.LOOKS}""")
def _(t: Tables):
    return series.lost_runs(v.looks(t), ["user_id"]).select("user_id", "frame", "lost_before")


@query("r10_stalls_batch", """SELECT event_id, round((epoch_us(n) - epoch_us(ts)) / 1e6, 6) AS stuck_s FROM (SELECT *, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events)
  WHERE (epoch_us(n) - epoch_us(ts)) / 1e6 >= CASE WHEN event_type = 'error' THEN 86400 ELSE 36000 END""")
def _(t: Tables):
    rows = t.events.withColumn("down", F.col("event_type") == "error")
    return series.stalls_batch(rows, ["user_id"], "ts", 36000, 86400, "down", ["event_id"]).select("event_id", r6("stuck_s"))


WINDOWED = f"""(SELECT c.user_id, c.cand_id, c.first, f.frame, l.status, h.frame IS NOT NULL AS hit FROM (SELECT DISTINCT user_id, cand_id, first FROM {v.TRACKS}) c, LATERAL (SELECT unnest(generate_series(c.first, c.first + 24)) AS frame) f
  LEFT JOIN {v.LOOKS} l ON l.user_id = c.user_id AND l.frame = f.frame LEFT JOIN (SELECT DISTINCT user_id, cand_id, frame FROM {v.TRACKS}) h ON h.user_id = c.user_id AND h.cand_id = c.cand_id AND h.frame = f.frame)"""


@query("u5_persistence", f"""WITH n AS (SELECT user_id, cand_id, first, count(*) FILTER (status = 'registered') AS span, count(status) AS tried, count(*) FILTER (hit) AS hits FROM {WINDOWED} GROUP BY ALL),
  p AS (SELECT user_id, max(frame) + 1 AS p FROM {v.LOOKS} GROUP BY 1)
  SELECT user_id, cand_id, first, span, tried, hits, round(hits / span, 6) AS persistence, CASE WHEN first + 25 > p THEN 'undecided' WHEN span > 0 AND span >= 0.5 * tried AND hits / span >= 0.5 THEN 'persisted' ELSE 'rejected' END AS verdict FROM n JOIN p USING (user_id)""")
def _(t: Tables):
    return tk.persistence(v.tracks(t), v.looks(t), ["user_id"]).withColumn("persistence", F.round("persistence", 6))


@query("u6_early_verdict", f"""WITH c AS (SELECT *, count(*) FILTER (status = 'registered') OVER a AS span, count(status) OVER a AS tried, count(*) FILTER (hit) OVER a AS hits, count(*) FILTER (frame % 2 = 0) OVER b AS rest FROM {WINDOWED}
   WINDOW a AS (PARTITION BY user_id, cand_id ORDER BY frame ROWS UNBOUNDED PRECEDING), b AS (PARTITION BY user_id, cand_id ORDER BY frame ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
  q AS (SELECT *, coalesce(lag(span) OVER w, 0) AS s0, coalesce(lag(tried) OVER w, 0) AS t0, coalesce(lag(hits) OVER w, 0) AS h0, rest + CAST(frame % 2 = 0 AS INT) AS r0 FROM c WINDOW w AS (PARTITION BY user_id, cand_id ORDER BY frame))
  SELECT user_id, cand_id, min(first) AS first, min(frame) FILTER (status IS NOT NULL AND ((span > 0 AND span >= 0.5 * (tried + rest) AND hits / (span + rest) >= 0.5) OR (s0 > 0 AND s0 >= 0.5 * (t0 + r0) AND h0 / (s0 + r0) >= 0.5))) AS early_frame FROM q GROUP BY ALL""")
def _(t: Tables):
    return tk.early_verdict(v.tracks(t), v.looks(t), ["user_id"], stride=2, baseline=0)


@query("u4_track_candidates")
def _(t: Tables):
    return tk.track_candidates(v.looks(t), ["user_id"]).select("user_id", "frame", "cand_id", "first")


@query("u7_retrack")
def _(t: Tables):
    return tk.retrack(v.looks(t), ["user_id"]).select("user_id", "frame", "cand_id", "first")


@query("u8_baseline_marks", f"""WITH RECURSIVE d AS (SELECT user_id, CAST(spot * 40.0 + value % 3 AS FLOAT) AS x, CAST(spot % 4 * 55.0 AS FLOAT) AS y, row_number() OVER (PARTITION BY user_id ORDER BY frame) AS i
    FROM {v.LOOKS} WHERE frame < 5 AND status = 'registered' AND event_type <> 'click'),
  r AS (SELECT user_id, i, [struct_pack(x := x, y := y)] AS kept FROM d WHERE i = 1 UNION ALL
    SELECT d.user_id, d.i, CASE WHEN len(list_filter(r.kept, lambda k: sqrt((k.x - d.x) ** 2 + (k.y - d.y) ** 2) < 20)) > 0 THEN r.kept ELSE list_append(r.kept, struct_pack(x := d.x, y := d.y)) END
    FROM r JOIN d ON d.user_id = r.user_id AND d.i = r.i + 1),
  m AS (SELECT user_id, kept, unnest(range(len(kept))) AS n FROM (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY i DESC) = 1))
  SELECT user_id, CAST(n AS INT) AS mark_id, round(CAST(kept[n + 1].x AS DOUBLE), 6) AS x, round(CAST(kept[n + 1].y AS DOUBLE), 6) AS y FROM m""")
def _(t: Tables):
    return tk.baseline_marks(v.looks(t), ["user_id"]).select("user_id", "mark_id", r6("x"), r6("y"))


@query("u22_new_marks_of_run")
def _(t: Tables):
    return tk.new_marks_of_run(v.looks(t), ["user_id"]).select("user_id", "cand_id", r6("cx"), r6("cy"), r6("persistence"))


@query("a18_detection_rate")
def _(t: Tables):
    spots = v.looks(t).filter("event_type = 'view'").select("user_id", "spot").distinct().select(
        "user_id", F.col("spot").alias("position_id"), (F.col("spot") * 40.0 + 1).alias("x"), (F.col("spot") % 4 * 55.0).alias("y"))
    rates, _ = sc.detection_rate(v.looks(t), spots, 15.0, ["user_id"])
    return rates.select("user_id", "position_id", "looked", "hits", "first", "last", r6("rate"))


@query("a19_sighting_share", f"""SELECT user_id, cand_id, first, count(DISTINCT frame) AS frames_seen, (SELECT count(*) FROM {v.LOOKS} l WHERE l.user_id = tr.user_id AND l.status = 'registered' AND l.frame >= tr.first) AS looks_since FROM {v.TRACKS} tr GROUP BY ALL""")
def _(t: Tables):
    tracks = v.tracks(t)
    holes = tracks.select("user_id", "cand_id", "first").distinct()
    return tk.sighting_share(holes, tracks, v.looks(t), ["user_id"]).select("user_id", "cand_id", "first", "frames_seen", "looks_since")


BOXES = f"(SELECT user_id, CAST(event_id AS VARCHAR) AS cand_id, frame, value * 3 AS cx, value % 11 * 9 AS cy, 12.0 AS w, 9.0 AS h FROM {v.LOOKS})"
SAME = """(sqrt((c.cx - k.cx) ** 2 + (c.cy - k.cy) ** 2) < 20 OR sqrt((c.cx - k.cx) ** 2 + (c.cy - k.cy) ** 2) < 0.5 * 15
  OR greatest(12 - abs(c.cx - k.cx), 0) * greatest(9 - abs(c.cy - k.cy), 0) / 108 > 0.5)"""


def _boxes(t: Tables, kind: str):
    c = F.col
    return v.looks(t).filter(c("event_type") == kind).select(
        "user_id", c("event_id").cast("string").alias("cand_id"), "frame", (c("value") * 3).alias("cx"), (c("value") % 11 * 9).alias("cy"), F.lit(12.0).alias("w"), F.lit(9.0).alias("h"))


BY = lambda kind: BOXES.replace(f"FROM {v.LOOKS})", f"FROM {v.LOOKS} WHERE event_type = '{kind}')")


@query("u10_corroborated", f"SELECT c.cand_id, count(k.cand_id) > 0 AS corroborated FROM {BY('view')} c LEFT JOIN {BY('click')} k ON k.user_id = c.user_id AND {SAME} GROUP BY 1")
def _(t: Tables):
    return tk.corroborated(_boxes(t, "view"), _boxes(t, "click").drop("cand_id"), ["user_id"]).select("cand_id", "corroborated")


@query("u19_announce", f"SELECT c.cand_id, min(CASE WHEN k.frame IS NOT NULL THEN greatest(k.frame, c.frame) END) AS announced_frame FROM {BY('view')} c LEFT JOIN {BY('click')} k ON k.user_id = c.user_id AND {SAME} GROUP BY 1")
def _(t: Tables):
    held = _boxes(t, "view").withColumnRenamed("frame", "persisted_frame")
    return tk.announce(held, _boxes(t, "click").drop("cand_id"), ["user_id"]).select("cand_id", "announced_frame")


MERGE = f"""(SELECT user_id, CAST(spot AS VARCHAR) AS cand_id, min(frame) AS first, list(frame) AS seen, avg(value) AS x, avg(value % 13) AS y FROM {v.LOOKS} WHERE status = 'registered' GROUP BY user_id, spot)"""


@query("u9_merge_displaced", f"""SELECT l.user_id, l.cand_id, arg_min(e.cand_id, (e.first, e.cand_id)) AS "into" FROM {MERGE} l LEFT JOIN {MERGE} e ON e.user_id = l.user_id AND e.first < l.first AND NOT list_has_any(e.seen, l.seen) AND list_max(l.seen) <= list_max(e.seen)
  AND sqrt((l.x - e.x) ** 2 + (l.y - e.y) ** 2) <= 0.35 * sqrt((l.x - 200) ** 2 + (l.y - 5) ** 2) GROUP BY ALL""")
def _(t: Tables):
    tracks = v.looks(t).filter("status = 'registered'").groupBy("user_id", F.col("spot").cast("string").alias("cand_id")).agg(
        F.min("frame").alias("first"), F.collect_set("frame").alias("seen"), F.avg("value").alias("x"), F.avg(F.col("value") % 13).alias("y"))
    return tk.merge_displaced(tracks, ["user_id"], (200.0, 5.0)).select("user_id", "cand_id", "into")


BOARDS = """(SELECT CASE WHEN user_id % 5 <> 0 THEN CAST(user_id % 40 AS VARCHAR) END AS board, user_id || '-' || cand_id AS cand_id, first, seen, x, y FROM """ + MERGE + ")"


@query("u9_merge_by_board", f"""SELECT l.board, l.cand_id, arg_min(e.cand_id, (e.first, e.cand_id)) AS "into" FROM {BOARDS} l LEFT JOIN {BOARDS} e ON e.board IS NOT DISTINCT FROM l.board AND e.first < l.first AND NOT list_has_any(e.seen, l.seen) AND list_max(l.seen) <= list_max(e.seen)
  AND sqrt((l.x - e.x) ** 2 + (l.y - e.y) ** 2) <= 0.35 * sqrt((l.x - 200) ** 2 + (l.y - 5) ** 2) GROUP BY ALL""")
def _(t: Tables):
    tracks = v.looks(t).filter("status = 'registered'").groupBy("user_id", F.col("spot").cast("string").alias("spot")).agg(
        F.min("frame").alias("first"), F.collect_set("frame").alias("seen"), F.avg("value").alias("x"), F.avg(F.col("value") % 13).alias("y"))
    board = F.when(F.col("user_id") % 5 != 0, (F.col("user_id") % 40).cast("string")).alias("board")
    tracks = tracks.select(board, F.concat_ws("-", "user_id", "spot").alias("cand_id"), "first", "seen", "x", "y")
    return tk.merge_displaced(tracks, ["board"], (200.0, 5.0)).select("board", "cand_id", "into")


@query("u2_keep_if_moved", """WITH RECURSIVE f AS (SELECT user_id, event_id, value % 9 AS x, value % 5 AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i
  FROM (SELECT *, max(ts) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events) WHERE high IS NULL OR ts > high),
  r AS (SELECT user_id, event_id, i, x, y, true AS moved FROM f WHERE i = 1 UNION ALL
    SELECT user_id, event_id, i, CASE WHEN moved THEN nx ELSE x END, CASE WHEN moved THEN ny ELSE y END, moved FROM (
      SELECT f.user_id, f.event_id, f.i, r.x, r.y, f.x AS nx, f.y AS ny, sqrt((f.x - r.x) ** 2 + (f.y - r.y) ** 2) > 2 AS moved FROM r JOIN f ON f.user_id = r.user_id AND f.i = r.i + 1))
  SELECT user_id, event_id FROM r WHERE moved""")
def _(t: Tables):
    c = F.col
    spot = F.array(F.struct((c("value") % 9).alias("x"), (c("value") % 5).alias("y")), F.struct((c("value") % 9 + 50).alias("x"), F.lit(50.0).alias("y")))
    places = t.events.select("user_id", "event_id", "ts", spot.alias("outline"))
    return tk.keep_if_moved(places, ["user_id"], "ts", "outline", tie=["event_id"]).select("user_id", "event_id")


@query("a24_stream_report", """WITH f AS (SELECT user_id, CAST(floor(value) AS BIGINT) % 60 - 5 AS step, event_type FROM events), s AS (SELECT user_id, round(1000.0 / step, 2) AS fps, count(*) AS n FROM f WHERE step > 0 GROUP BY ALL)
  SELECT user_id, count(*) AS received, count(*) FILTER (step <= 0) AS untimed, round(sum(CASE WHEN step > 0 THEN step END) / 1000, 6) AS spanned_s, count(*) FILTER (event_type = 'error') AS late_before, count(*) FILTER (event_type = 'signup') AS late_after,
  (SELECT fps FROM s WHERE s.user_id = f.user_id ORDER BY n DESC, fps LIMIT 1) AS common_fps FROM f GROUP BY user_id""")
def _(t: Tables):
    step = F.floor("value") % 60 - 5
    frames = t.events.select("user_id", step.alias("step_ms"), F.when(step > 0, step).alias("span_ms"), (step <= 0).alias("untimed"),
                             (F.col("event_type") == "error").alias("late_before"), (F.col("event_type") == "signup").alias("late_after"))
    out = series.stream_report(frames, ["user_id"])
    return out.select("user_id", "received", "untimed", r6("spanned_s"), "late_before", "late_after", "common_fps")


@query("a25_fit_checks", """SELECT l_linestatus, count(*) AS converged, count(*) FILTER (c < 0.9 AND d IS NOT NULL) AS checked, count(*) FILTER (c < 0.9 AND d >= 66) AS gross, count(*) FILTER (c < 0.9 AND d < 66 AND d > 3.1) AS moderate
  FROM (SELECT l_linestatus, l_discount * 10 AS c, CASE WHEN l_linenumber <> 2 THEN l_quantity * 2 END AS d FROM lineitem) GROUP BY 1""")
def _(t: Tables):
    fits = t.lineitem.select("l_linestatus", (F.col("l_discount") * 10).alias("correlation"), F.when(F.col("l_linenumber") != 2, F.col("l_quantity") * 2).alias("disagreement"))
    return series.fit_checks(fits, ["l_linestatus"])

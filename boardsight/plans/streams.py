"""Streaming queries over the stored tables, drained to what there is."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from boardsight.plans import telemetry
from boardsight.plans.registry import SQL, Tables, query
from boardsight.streaming import feeds
from boardsight.streaming.runs import drain, new_folder, read_table_stream, replay


def _events(t: Tables):
    return read_table_stream(t.spark, t.folder, "events.parquet")


def _keyed(t: Tables):
    return t.events.select("event_id", F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("timestamp"))


R3_SQL = telemetry.THROTTLE + " SELECT e.event_id FROM e JOIN k USING (user_id, n)"


def _sampled(t: Tables, files: int, newest_first: bool):
    control = t.events.select(F.col("user_id").cast("string").alias("key")).distinct().withColumns(
        {"client": F.lit("c"), "interval_ms": F.lit(6 * telemetry.HOUR).cast("long")})
    stream = replay(_keyed(t), "timestamp", files, newest_first)
    return drain(feeds.sampled_feed(stream, control, late="4000 days" if newest_first else "1 minute")).filter("NOT late").select("event_id")


@query("r3_sampled_feed", R3_SQL)
def _(t: Tables):
    return _sampled(t, 1, False)


@query("r3_sampled_feed_files", R3_SQL)
def _(t: Tables):
    return _sampled(t, 4, False)


@query("r3_sampled_feed_newest_first", R3_SQL)
def _(t: Tables):
    return _sampled(t, 4, True)


# 'error' events are the requests: who asks, for what and how often follows from the event.
@query("r4_live_feed", f"""WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) / 1000.0 AS ms, event_type = 'error' AS ask, (event_id % 2)::VARCHAR AS client,
    CASE event_id % 5 WHEN 4 THEN 'drop' WHEN 3 THEN 'interval' ELSE 'register' END AS action, (event_id % 4) * {3 * telemetry.HOUR} AS iv,
    row_number() OVER (PARTITION BY user_id ORDER BY ts, event_type <> 'error', event_id) AS n FROM events),
  s AS (SELECT DISTINCT user_id, 0::BIGINT AS n, NULL::VARCHAR AS client, NULL::DOUBLE AS iv, NULL::DOUBLE AS last, NULL::BIGINT AS sent, NULL::VARCHAR AS sent_to FROM e
    UNION ALL SELECT user_id, n, CASE WHEN NOT ask OR passed THEN held WHEN action = 'drop' THEN NULL ELSE client END,
      CASE WHEN NOT ask OR passed THEN held_iv WHEN action = 'drop' OR iv = 0 THEN NULL ELSE iv END,
      CASE WHEN ask AND NOT passed THEN CASE WHEN action = 'drop' OR iv = 0 THEN NULL ELSE last END WHEN goes AND held_iv IS NOT NULL THEN ms ELSE last END,
      CASE WHEN goes THEN event_id END, held
    FROM (SELECT e.*, s.client AS held, s.iv AS held_iv, s.last, (s.client IS NOT NULL AND e.client <> s.client) OR (s.client IS NULL AND e.action <> 'register') AS passed,
        NOT e.ask AND s.client IS NOT NULL AND (s.iv IS NULL OR s.last IS NULL OR e.ms - s.last >= s.iv) AS goes FROM s JOIN e ON e.user_id = s.user_id AND e.n = s.n + 1))
  SELECT user_id::VARCHAR AS key, sent AS event_id, sent_to AS client FROM s WHERE sent IS NOT NULL""")
def _(t: Tables):
    c = F.col
    rows = _keyed(t).join(t.events.select("event_id", "event_type"), "event_id")
    asks = rows.select("key", "timestamp", c("event_id").alias("seq"), (c("event_id") % 2).cast("string").alias("client"), "event_type",
                       F.when(c("event_id") % 5 == 4, "drop").when(c("event_id") % 5 == 3, "interval").otherwise("register").alias("action"),
                       ((c("event_id") % 4) * 3 * telemetry.HOUR).alias("interval_ms")).filter("event_type = 'error'").drop("event_type")
    data = rows.filter("event_type <> 'error'").drop("event_type").withColumn("seq", c("event_id"))
    sent = drain(feeds.live_feed(replay(data.drop("seq"), "timestamp", 3, True), replay(asks, "timestamp", 2), late="4000 days"))
    return sent.filter("NOT late").select("key", "event_id", "client")


@query("r5_metrics_changes", f"""WITH RECURSIVE e AS (SELECT user_id, epoch_us(ts) AS us, event_type = 'view' AS view, value > 40 AS ok, event_id % 3 AS n FROM events WHERE event_type IN ('view', 'click') AND event_id % 3 > 0),
  s AS (SELECT user_id, min(us) AS at_us FROM e GROUP BY user_id UNION ALL SELECT * FROM (SELECT s.user_id, (SELECT CASE WHEN min(us) < s.at_us + {6 * telemetry.HOUR * 1000} THEN s.at_us + {6 * telemetry.HOUR * 1000} ELSE min(us) END FROM e WHERE e.user_id = s.user_id AND us > s.at_us) AS at_us FROM s) WHERE at_us IS NOT NULL)
  SELECT s.user_id::VARCHAR AS source, at_us, coalesce(sum(n) FILTER (view AND ok), 0)::BIGINT AS view_ok, coalesce(sum(n) FILTER (view AND NOT ok), 0)::BIGINT AS view_fail, coalesce(sum(n) FILTER (NOT view AND ok), 0)::BIGINT AS click_ok, coalesce(sum(n) FILTER (NOT view AND NOT ok), 0)::BIGINT AS click_fail
  FROM s JOIN e ON e.user_id = s.user_id AND us <= at_us GROUP BY ALL""")
def _(t: Tables):
    rows = t.events.select(F.col("user_id").cast("string").alias("source"), F.col("event_type").alias("stage"), (F.col("value") > 40).alias("ok"),
                           (F.col("event_id") % 3).alias("n"), F.col("ts").cast("timestamp").alias("timestamp"))
    sent = drain(feeds.metrics_changes(replay(rows, "timestamp", 3), ["view", "click"], interval_ms=6 * telemetry.HOUR))
    return sent.filter("NOT late").drop("late")


@query("r6_reassemble_stream", """WITH s AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT *, CAST(epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) >= 21600000000 AS INT) AS n FROM events))
  SELECT user_id, count(*) AS segments, epoch_us(min(ts)) AS started_us, md5(string_agg(props, '' ORDER BY event_id)) AS digest FROM s GROUP BY user_id, coalesce(g, 0)""")
def _(t: Tables):
    rows = t.events.select("user_id", "event_id", "props", F.col("ts").cast("timestamp").alias("timestamp"))
    out = drain(feeds.reassemble_on_time(replay(rows, "timestamp", 3), ["user_id"], "timestamp", "event_id", "props", 6 * 3600))
    return out.filter("NOT late").select("user_id", "segments", F.unix_micros("started").alias("started_us"), F.md5("text").alias("digest"))


@query("r7_idempotent_ingest", """SELECT user_id, event_type, CAST(floor(value) AS BIGINT) AS whole, min(event_id) AS event_id FROM events WHERE event_type <> 'error' GROUP BY ALL
  UNION ALL SELECT user_id, NULL, CAST(floor(value) AS BIGINT), event_id FROM events WHERE event_type = 'error'""")
def _(t: Tables):
    rows = t.events.select("user_id", F.floor("value").alias("whole"), F.when(F.col("event_type") != "error", F.col("event_type")).alias("event_type"), "event_id")
    # files of falling age but rising ids, so that retries come whole files later
    stream = replay(rows.withColumn("timestamp", F.timestamp_seconds("event_id")), "timestamp", 4).filter(F.col("user_id").isNotNull())
    base = new_folder(t.spark, "ingest")
    feeds.idempotent_ingest(stream, ["user_id", "whole", "event_type"], ["event_id"], f"{base}/rows", f"{base}/keys", f"{base}/state", {"availableNow": True}).awaitTermination()
    return t.spark.read.schema(stream.schema).parquet(f"{base}/rows").select("user_id", "event_type", "whole", "event_id")


# One mark a look on one of two spots far apart: a candidate is a spot, and after a window in which it did not persist the next sighting opens another.
@query("r8_persistence", """WITH RECURSIVE l AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) * 2 AS frame, event_type <> 'error' AS seen,
    CASE WHEN floor(value) % 4 = 0 THEN 1 ELSE 0 END AS spot FROM events),
  d AS (SELECT user_id, spot, frame FROM l WHERE seen),
  c AS (SELECT user_id, spot, min(frame) AS first FROM d GROUP BY ALL
    UNION SELECT c.user_id, c.spot, (SELECT min(d.frame) FROM d WHERE d.user_id = c.user_id AND d.spot = c.spot AND d.frame >= c.first + 25) FROM c
    WHERE c.first IS NOT NULL AND NOT (SELECT count(*) FILTER (seen) > 0 AND count(*) FILTER (seen) >= 0.5 * 25 AND count(*) FILTER (seen AND l.spot = c.spot) / count(*) FILTER (seen) >= 0.5
      FROM l WHERE l.user_id = c.user_id AND l.frame >= c.first AND l.frame < c.first + 25)),
  j AS (SELECT c.user_id, c.spot, c.first, count(*) FILTER (seen) AS span, count(*) FILTER (seen AND l.spot = c.spot) AS hits,
    (SELECT CASE WHEN max(l.frame) >= c.first + 25 THEN c.first + 25 END FROM l WHERE l.user_id = c.user_id) AS judged_frame
    FROM c JOIN l ON l.user_id = c.user_id AND l.frame >= c.first AND l.frame < c.first + 25 WHERE c.first IS NOT NULL GROUP BY ALL)
  SELECT user_id::VARCHAR AS key, first, judged_frame, spot * 1000.0 AS x, hits / span AS persistence FROM j
  WHERE span > 0 AND span >= 0.5 * 25 AND hits / span >= 0.5 AND judged_frame IS NOT NULL""")
def _(t: Tables):
    return _persisted(t, 1, False)


@query("r8_persistence_newest_first", SQL["r8_persistence"])
def _(t: Tables):
    return _persisted(t, 4, True)


def _persisted(t: Tables, files: int, newest_first: bool):
    c = F.col
    number = F.row_number().over(W.partitionBy("user_id").orderBy("ts", "event_id"))  # a recording's looks are numbered as they were made
    mark = F.struct(*[x.cast("double").alias(n) for n, x in (("cx", F.when(F.floor("value") % 4 == 0, 1000).otherwise(0)), ("cy", F.lit(0)), ("w", F.lit(10)), ("h", F.lit(10)))])
    looks = t.events.select(c("user_id").cast("string").alias("key"), (number * 2).cast("long").alias("frame"), F.when(c("event_type") == "error", "lost").otherwise("registered").alias("status"),
                            F.when(c("event_type") == "error", F.slice(F.array(mark), 1, 0)).otherwise(F.array(mark)).alias("detections"))
    timed = looks.withColumn("shown", F.timestamp_millis("frame"))
    stream = replay(timed, "shown", files, newest_first).withColumn("frame", F.coalesce("frame", F.unix_millis("shown")))
    late = 1_000_000_000 if newest_first else 25
    # every second frame was missed by the stream and counts as tried
    judged = drain(feeds.persistence_stream(stream, ["key"], late_frames=late, fill_missing=True)).filter("NOT late")
    return judged.select("key", "first", "judged_frame", "x", "persistence")


@query("r12_session_feed", "SELECT event_id FROM events WHERE user_id = 7 AND event_type IN ('click', 'view')")
def _(t: Tables):
    kinds = F.when(F.col("event_type") == "click", "bullet_created").when(F.col("event_type") == "view", "run_moved").otherwise("ping")
    rows = _events(t).select("event_id", F.col("user_id").cast("string").alias("session_id"), kinds.alias("type"))
    return drain(feeds.session_feed(rows, "7")).select("event_id")


@query("r13_follow_runs", """WITH RECURSIVE f AS (SELECT user_id, epoch_us(ts) // 1000 AS ms, value % 9 AS x, value % 5 AS y, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i
  FROM (SELECT *, max(epoch_us(ts) // 1000) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS high FROM events) WHERE high IS NULL OR epoch_us(ts) // 1000 > high),
  r AS (SELECT user_id, ms, i, x, y, true AS moved FROM f WHERE i = 1 UNION ALL
    SELECT user_id, ms, i, CASE WHEN moved THEN nx ELSE x END, CASE WHEN moved THEN ny ELSE y END, moved FROM (
      SELECT f.user_id, f.ms, f.i, r.x, r.y, f.x AS nx, f.y AS ny, sqrt((f.x - r.x) ** 2 + (f.y - r.y) ** 2) > 2 AS moved FROM r JOIN f ON f.user_id = r.user_id AND f.i = r.i + 1))
  SELECT user_id, ms AS at_ms FROM r WHERE moved""")
def _(t: Tables):
    c = F.col
    spot = F.array(F.struct((c("value") % 9).alias("x"), (c("value") % 5).alias("y")))
    rows = _events(t).select("user_id", "event_id", c("ts").cast("timestamp").alias("looked_at"), spot.alias("outline"))
    return drain(feeds.follow_runs(rows, ["user_id"], "event_id")).select("user_id", F.unix_millis("at").alias("at_ms"))

"""Queries over signals: ranges, gaps, rates, counters, packets."""

from __future__ import annotations

from pyspark.sql import functions as F, types as T

from boardsight.core.columns import once
from boardsight.core.ordered import Ordered
from boardsight.functions import signals as fn
from boardsight.operators import paging, series, tracking
from boardsight.plans import views as v
from boardsight.plans.registry import Tables, query
from boardsight.sources import packets, signals
from boardsight.streaming.runs import new_folder, replay

A, B = "2024-01-05 00:00:00", "2024-01-20 00:00:00"
HOUR = 3_600_000


@query("s1_read_signals", "SELECT event_id AS id, ts AS at, event_type AS description, value FROM events")
def _(t: Tables):
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                           T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())])
    raw = t.spark.read.schema(schema).parquet(f"{t.folder}/events.parquet")
    return raw.select(F.col("event_id").alias("id"), F.col("ts").alias("at"), F.col("event_type").alias("description"), "value")


MOTION_KEY = """'motion|' || event_type || '|' || CASE WHEN event_type IN ('click','view') THEN 'true' ELSE 'false' END || '|' || (user_id % 4)"""


@query("s2_stamp_rows", f"""SELECT CAST(ts AS DATE) AS day, {MOTION_KEY} AS id, count(*) AS n FROM events GROUP BY ALL""")
def _(t: Tables):
    return signals.stamp(v.signals(t), "motion").groupBy("day", "id").agg(F.count(F.lit(1)).alias("n"))


@query("s3_archive_session", "SELECT 'r1' AS range_id, CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def _(t: Tables):
    kept = signals.archive_session(t.events, "r1", "ts")
    return kept.groupBy("range_id", "day").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total"))


# Rows as the store keeps them; a NaN measure comes back as null.
STORED = f"""SELECT {MOTION_KEY} AS id, epoch_us(ts) AS at_us, event_type IN ('click', 'view') AS is_cmd, event_type AS description, CAST(user_id % 4 AS INT) AS axis,
  CASE WHEN event_type <> 'purchase' THEN value END AS value FROM events"""


def _to_store(t: Tables):
    return v.signals(t).drop("event_id").withColumns({"timestamp": F.col("timestamp").cast("timestamp"), "opCode": F.lit(None).cast("string")})


def _from_store(t: Tables, path: str, **wanted):
    rows = signals.read_signals(t.spark, path, "motion", renames={"isCmd": "is_cmd"}, **wanted)
    return rows.select("id", F.unix_micros("timestamp").alias("at_us"), "is_cmd", "description", "axis", "value")


@query("s1_store_read", f"{STORED} WHERE ts BETWEEN TIMESTAMP '{A}' AND TIMESTAMP '{B}'")
def _(t: Tables):
    path = new_folder(t.spark, "signals")
    signals.write_rows(signals.stamp(_to_store(t), "motion"), path)
    return _from_store(t, path, start=A, end=B)


@query("s2_store_append", STORED)
def _(t: Tables):
    base = new_folder(t.spark, "appended")
    stream = replay(_to_store(t), "timestamp", 2).filter("description IS NOT NULL")
    signals.write_signals(stream, f"{base}/rows", f"{base}/state", "motion", trigger={"availableNow": True}).awaitTermination()
    return _from_store(t, f"{base}/rows")


@query("s3_store_archive", f"{STORED} WHERE event_type <> 'error'")
def _(t: Tables):
    path = new_folder(t.spark, "archive")
    rows = signals.stamp(_to_store(t), "motion").drop("day")
    signals.write_archive(rows.filter("description = 'click'"), path, "r1")
    signals.write_archive(rows, path, "r2")
    signals.write_archive(rows.filter("description <> 'error'"), path, "r1")  # the same session again: replaced
    return _from_store(t, path, range_id="r1")


@query("s4_drop_session", "SELECT event_type AS range_id, event_id FROM events WHERE event_type <> 'error'")
def _(t: Tables):
    return signals.drop_session(t.events.withColumnRenamed("event_type", "range_id"), "error").select("range_id", "event_id")


@query("s4_drop_time_span", f"SELECT event_id FROM events WHERE NOT (ts >= '{A}' AND ts <= '{B}')")
def _(t: Tables):
    return signals.drop_session(t.events, start=A, end=B, ts="ts").select("event_id")


@query("f1_time_range", f"SELECT event_id, value FROM events WHERE ts >= '{A}' AND ts <= '{B}'")
def _(t: Tables):
    return signals.time_range(t.events, "ts", A, B).select("event_id", "value")


@query("f1_half_open", f"SELECT event_id, value FROM events WHERE ts >= '{A}' AND ts < '{B}'")
def _(t: Tables):
    return signals.time_range(t.events, "ts", A, B, closed="left").select("event_id", "value")


@query("f13_to_sample", f"""SELECT {MOTION_KEY} AS key, epoch_us(ts) // 1000 AS ts_ms,
  CASE WHEN event_type IN ('click','view') THEN 1.0 WHEN event_type = 'purchase' THEN -1.0 ELSE value END AS value FROM events""")
def _(t: Tables):
    return signals.to_sample(v.signals(t), "motion")


@query("x1_safety_value", """SELECT event_id, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN 0.0 WHEN 'signup' THEN 2.0
  WHEN 'purchase' THEN 3.0 ELSE -1.0 END AS value FROM events""")
def _(t: Tables):
    states = fn.literal_map({"click": "ON", "view": "OFF", "signup": "PULSE", "purchase": "BURST"})
    return t.events.select("event_id", fn.x_safety_value(states[F.col("event_type")]).alias("value"))


@query("x1_picture_value", """SELECT event_id, CASE event_type WHEN 'click' THEN 1.0 WHEN 'view' THEN value WHEN 'error' THEN 1.0
  WHEN 'signup' THEN CASE WHEN user_id % 2 = 0 THEN value ELSE -1.0 END ELSE -1.0 END AS value FROM events""")
def _(t: Tables):
    kinds = fn.literal_map({"click": "FOV_REQ", "view": "FOV_STS", "error": "LRF_REQ", "signup": "LRF_STS"})
    measure = F.when(F.col("user_id") % 2 == 0, F.col("value"))
    return t.events.select("event_id", fn.x_picture_value(kinds[F.col("event_type")], F.col("value"), measure).alias("value"))


@query("x2_signal_key", f"SELECT event_id, {MOTION_KEY} AS key FROM events")
def _(t: Tables):
    return v.signals(t).select("event_id", fn.x_signal_key(F.lit("Motion"), F.col("description"), F.col("isCmd"), F.col("axis")).alias("key"))


@query("x3_opcode_text", "SELECT event_id, '0x' || lpad(upper(to_hex(event_id % 65536)), 4, '0') AS opcode FROM events")
def _(t: Tables):
    return t.events.select("event_id", fn.x_opcode_text(F.col("event_id") % 65536).alias("opcode"))


@query("x24_epoch_ms", "SELECT event_id, epoch_us(ts) // 1000 AS ms FROM events")
def _(t: Tables):
    return t.events.select("event_id", fn.x_epoch_ms(F.col("ts")).alias("ms"))


GAPS = f"""SELECT event_id FROM (SELECT *, {{f}}(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM events)
  WHERE p IS NULL OR abs(epoch_us(ts) - epoch_us(p)) > {6 * HOUR * 1000 - 1}"""


@query("w1_gap_filter", GAPS.format(f="lag"))
def _(t: Tables):
    return paging.gap_filter(t.events, "ts", "event_id", 6 * HOUR, ["user_id"]).select("event_id")


@query("w1_gap_filter_desc", GAPS.format(f="lead"))
def _(t: Tables):
    return paging.gap_filter(t.events, "ts", "event_id", 6 * HOUR, ["user_id"], order="desc").select("event_id")


@query("l1_newest_first", "SELECT event_id, user_id FROM events ORDER BY ts DESC, event_id DESC")
def _(t: Tables):
    return paging.newest_first(t.events, "ts", "event_id").select("event_id", "user_id")


@query("l2_time_page", f"SELECT event_id, value FROM events WHERE ts >= '{A}' AND ts <= '{B}' ORDER BY ts, event_id LIMIT 100 OFFSET 200")
def _(t: Tables):
    return paging.time_page(t.events, "ts", "event_id", A, B, "asc", 3, 100).select("event_id", "value")


@query("l2_time_page_desc", f"SELECT event_id, value FROM events WHERE ts >= '{A}' AND ts <= '{B}' ORDER BY ts DESC, event_id DESC LIMIT 50")
def _(t: Tables):
    return paging.time_page(t.events, "ts", "event_id", A, B, "desc", 1, 50).select("event_id", "value")


@query("l3_interval_page", f"""SELECT event_id, user_id, value FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
  FROM events WHERE ts >= '{A}' AND ts < '{B}') WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) > {HOUR * 1000 - 1}
  ORDER BY ts, event_id LIMIT 500 OFFSET 500""")
def interval_page(t: Tables):
    return paging.interval_page(t.events, "ts", "event_id", A, B, HOUR, ["user_id"], page=2, size=500).select("event_id", "user_id", "value")


@query("l3_first_page", f"""SELECT event_id, user_id, value FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p
  FROM events WHERE ts >= '{A}' AND ts < '{B}') WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) > {HOUR * 1000 - 1}
  ORDER BY ts, event_id LIMIT 500""")
def first_interval_page(t: Tables):
    return paging.interval_page(t.events, "ts", "event_id", A, B, HOUR, ["user_id"], page=1, size=500).select("event_id", "user_id", "value")


@query("l4_entity_page", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey LIMIT 25 OFFSET 50")
def _(t: Tables):
    items, _ = paging.paginate(t.orders, 3, 25, "o_orderdate", "o_orderkey")
    return items.select("o_orderkey", "o_totalprice")


@query("l4_page_counts", "SELECT o_custkey, count(*) AS total, CAST(ceil(count(*) / 4.0) AS BIGINT) AS pages FROM orders GROUP BY o_custkey")
def _(t: Tables):
    return paging.page_counts(t.orders, 4, ["o_custkey"])


@query("l6_skip_take", "SELECT p_partkey, p_name FROM part ORDER BY p_retailprice, p_partkey LIMIT 20 OFFSET 40")
def _(t: Tables):
    return paging.skip_take(t.part, ["p_retailprice", "p_partkey"], 40, 20).select("p_partkey", "p_name")


@query("w10_last_n", """SELECT event_id, user_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) <= 20""")
def _(t: Tables):
    return paging.last_n(t.events, ["user_id"], "ts", 20, ["event_id"]).select("event_id", "user_id")


def _counter(t: Tables):
    """A cumulative counter per user: value in whole units, summed in time order."""
    df = t.events.withColumn("_u", F.floor(F.col("value") / 10).cast("long"))
    return Ordered(df, ["user_id"], ["ts", "event_id"]).running_sum("counter", F.col("_u")).done().drop("_u")


COUNTER = """(SELECT *, CAST(sum(CAST(floor(value / 10) AS BIGINT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS counter FROM events)"""
RATE = f"""(SELECT *, CASE WHEN (epoch_us(ts) - epoch_us(pt)) / 1e6 >= 3600 THEN CAST(floor(greatest(0, counter * 100000 - pc * 100000) / ((epoch_us(ts) - epoch_us(pt)) / 1e6) + 0.5) AS BIGINT) END AS rate
  FROM (SELECT *, lag(ts) OVER w AS pt, lag(counter) OVER w AS pc FROM {COUNTER} WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)))"""


def _rates(t: Tables):
    scaled = _counter(t).withColumn("c", F.col("counter") * 100000)
    return series.counter_rate(scaled, ["user_id"], "ts", ["c"], 3600, ["event_id"]).withColumnRenamed("c_rate", "rate")


@query("w8_counter_rate", f"SELECT event_id, rate FROM {RATE}")
def _(t: Tables):
    return _rates(t).select("event_id", "rate")


@query("w9_ema", f"""WITH RECURSIVE r AS (SELECT event_id, user_id, rate, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM {RATE}),
  e AS (SELECT user_id, n, event_id, CASE WHEN rate IS NULL THEN 0 ELSE CAST(floor(CAST(rate AS DOUBLE) * CAST(0.3 AS DOUBLE) + 0.5) AS BIGINT) END AS smoothed FROM r WHERE n = 1
   UNION ALL SELECT r.user_id, r.n, r.event_id, CASE WHEN r.rate IS NULL THEN e.smoothed ELSE
    CAST(floor(CAST(e.smoothed AS DOUBLE) * (1 - CAST(0.3 AS DOUBLE)) + CAST(r.rate AS DOUBLE) * CAST(0.3 AS DOUBLE) + 0.5) AS BIGINT) END
   FROM e JOIN r ON r.user_id = e.user_id AND r.n = e.n + 1)
  SELECT event_id, smoothed FROM e""")
def _(t: Tables):
    slim = _rates(t).select("user_id", "ts", "event_id", "rate")
    return series.ema(slim, ["user_id"], "ts", "rate", 0.3, ["event_id"]).select("event_id", "smoothed")


def _bytes(t: Tables):
    """Byte counters that grow on clicks only and read 0 on errors."""
    step = F.when(F.col("event_type") == "click", 5).otherwise(0)
    grown = Ordered(t.events, ["user_id"], ["ts", "event_id"]).running_sum("_b", step.cast("long")).done()
    return grown.withColumn("bytes", F.when(F.col("event_type") == "error", 0).otherwise(F.col("_b")).cast("long")).drop("_b")


BYTES = """(SELECT *, CASE WHEN event_type = 'error' THEN 0 ELSE CAST(sum(CASE WHEN event_type = 'click' THEN 5 ELSE 0 END)
  OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) END AS bytes FROM events)"""


@query("w11_alive", f"""SELECT event_id, coalesce((epoch_us(ts) - epoch_us(g)) / 1e6 < 14400, false) AS alive FROM (SELECT *,
  last_value(CASE WHEN bytes > p THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS g
  FROM (SELECT *, lag(bytes) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS p FROM {BYTES}))""")
def _(t: Tables):
    return series.alive(_bytes(t), ["user_id"], "ts", "bytes", 14400, ["event_id"]).select("event_id", "alive")


@query("w12_silence", f"""SELECT event_id, round((epoch_us(ts) - epoch_us(c)) / 1e6, 6) AS silent_s FROM (SELECT *,
  last_value(CASE WHEN n = 1 OR (bytes <> 0 AND bytes IS DISTINCT FROM k) THEN ts END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS c
  FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n,
    last_value(nullif(bytes, 0) IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k FROM {BYTES}))""")
def _(t: Tables):
    return series.silence(_bytes(t), ["user_id"], "ts", "bytes", ["event_id"]).select("event_id", F.round("silent_s", 6).alias("silent_s"))


@query("w13_state_changes", """SELECT event_id, event_type, p AS previous FROM (SELECT *, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'none') AS p FROM events)
  WHERE event_type <> p""")
def _(t: Tables):
    return series.state_changes(t.events, ["user_id"], "ts", "event_type", "none", ["event_id"]).select("event_id", "event_type", "previous")


@query("a10_stage_counters", """SELECT CAST(user_id % 3 AS VARCHAR) AS source, """ + ", ".join(
    f"CAST(sum(CASE WHEN event_type = '{s}' AND value < 100 THEN 1 ELSE 0 END) AS BIGINT) AS {s}_ok, CAST(sum(CASE WHEN event_type = '{s}' AND value >= 100 THEN 1 ELSE 0 END) AS BIGINT) AS {s}_fail"
    for s in ("click", "view", "purchase")) + " FROM events GROUP BY 1")
def _(t: Tables):
    ev = t.events.select((F.col("user_id") % 3).cast("string").alias("source"), F.col("event_type").alias("stage"),
                         (F.col("value") < 100).alias("ok"), F.lit(1).cast("long").alias("n"))
    return series.stage_counters(ev, ["click", "view", "purchase"])


@query("a11_mean_latency", "SELECT event_type, round(coalesce(avg(CASE WHEN event_type <> 'error' THEN value END), 0), 6) AS mean_latency_ms FROM events GROUP BY 1")
def _(t: Tables):
    timed = t.events.withColumn("latency_ms", F.when(F.col("event_type") != "error", F.col("value")))
    return series.mean_latency(timed, ["event_type"]).select("event_type", F.round("mean_latency_ms", 6).alias("mean_latency_ms"))


NOW = "2024-02-01 00:00:00"


@query("a12_batch_latency", f"SELECT CAST(ts AS DATE) AS day, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(ts))) / 1e3, 3) AS batch_latency_ms FROM events GROUP BY 1")
def _(t: Tables):
    rows = t.events.withColumn("day", F.to_date("ts"))
    return series.batch_latency(rows, ["day"], "ts", F.lit(NOW)).select("day", F.round("batch_latency_ms", 3).alias("batch_latency_ms"))


@query("a13_queue_latency", f"SELECT CAST(ts AS DATE) AS day, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(min(ts))) / 1e3, 3) AS queue_latency_ms FROM events GROUP BY 1")
def _(t: Tables):
    rows = t.events.withColumn("day", F.to_date("ts"))
    return series.queue_latency(rows, ["day"], "ts", F.lit(NOW)).select("day", F.round("queue_latency_ms", 3).alias("queue_latency_ms"))


@query("a14_utilisation", "SELECT p_partkey, round(CASE WHEN p_size - 10 > 0 THEN p_retailprice / (p_size - 10) * 100 ELSE 0 END, 6) AS utilisation FROM part")
def _(t: Tables):
    rows = t.part.withColumn("capacity", F.col("p_size") - 10)
    return series.utilisation(rows, "p_retailprice", "capacity").select("p_partkey", F.round("utilisation", 6).alias("utilisation"))


THROTTLE = f"""WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
  k AS (SELECT user_id, n, us FROM e WHERE n = 1
   UNION ALL SELECT user_id, nn, nus FROM (SELECT k.user_id, e.n AS nn, e.us AS nus, row_number() OVER (PARTITION BY k.user_id, k.n ORDER BY e.n) AS pick
     FROM k JOIN e ON e.user_id = k.user_id AND e.n > k.n AND e.us >= k.us + {6 * HOUR * 1000}) WHERE pick = 1)"""


@query("u1_throttle", THROTTLE + " SELECT e.event_id FROM e JOIN k USING (user_id, n)")
def _(t: Tables):
    return tracking.throttle(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", 6 * HOUR, ["event_id"]).select("event_id")


@query("u17_collapse_repeats", THROTTLE + """ SELECT e.event_id, coalesce(e.n - lag(e.n) OVER (PARTITION BY user_id ORDER BY e.n) - 1, 0) AS repeats FROM e JOIN k USING (user_id, n)""")
def _(t: Tables):
    return tracking.collapse_repeats(t.events.select("event_id", "user_id", "ts"), ["user_id"], "ts", 6 * HOUR, ["event_id"]).select("event_id", "repeats")


@query("u15_replay_buckets", f"""SELECT event_id, bucket FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id, bucket ORDER BY ts, event_id) AS p FROM (SELECT *,
  CAST(floor((epoch_us(ts) - epoch_us(TIMESTAMP '{A}')) / {HOUR * 1000.0}) AS BIGINT) AS bucket FROM events WHERE ts >= '{A}' AND ts < '{B}'))
  WHERE p IS NULL OR epoch_us(ts) - epoch_us(p) > {HOUR * 1000 - 1}
  QUALIFY row_number() OVER (PARTITION BY user_id, bucket ORDER BY ts, event_id) <= 1000""")
def _(t: Tables):
    return tracking.replay_buckets(t.events, "ts", "event_id", A, B, HOUR, keys=["user_id"]).select("event_id", "bucket")


def _hex(n, digits: int):
    return F.lpad(F.hex(n.cast("long")), digits, "0")


# opcode, wire bytes of its report value, by event type; the error one is unknown
CODES = {"click": (0x0101, 2), "view": (0x0104, 2), "purchase": (0x0704, 1), "signup": (0x0709, 4), "error": (0x0FFF, 2)}


def motion_packets(t: Tables):
    """TCP packets of the events: a report of the value in whole units."""
    code = fn.literal_map({k: c for k, (c, _) in CODES.items()})[F.col("event_type")]
    whole = F.floor("value").cast("long")
    data = F.element_at(F.create_map(*[x for k, (_, n) in CODES.items() for x in (F.lit(k), _hex(whole % 256 ** n, 2 * n))]), F.col("event_type"))
    tcp = F.concat(F.lit("13551F90"), F.lit("00000000" * 2), F.lit("50000000" + "00000000"))
    body = F.concat(F.lit("AA5500"), F.lit("00"), _hex(F.col("user_id") % 4, 2), _hex(code, 4), data, F.lit("FF"))
    return t.events.select("event_id", "ts", F.unhex(F.concat(tcp, body)).alias("packet"))


NAMES = {"click": "MOT_MerRegister", "view": "MOT_SrlRegister", "purchase": "COM_IsConnected", "signup": "COM_getKeepAliveTimeout"}
NAME_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{n}'" for k, n in NAMES.items()) + " END"
CODE_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '0x{c:04X}'" for k, (c, _) in CODES.items()) + " END"
VALUE_SQL = "CAST(floor(value) AS BIGINT) % CASE event_type " + " ".join(f"WHEN '{k}' THEN {256 ** n}" for k, (_, n) in CODES.items()) + " END"


@query("s6_decode_motion", f"""SELECT event_id, 'motion|' || lower({NAME_SQL}) || '|false|' || (user_id % 4) AS id, false AS "isCmd", {CODE_SQL} AS "opCode",
  {NAME_SQL} AS description, CAST(user_id % 4 AS INT) AS axis, CAST({VALUE_SQL} AS DOUBLE) AS value FROM events WHERE event_type <> 'error'""")
def decoded_motion(t: Tables):
    return packets.decode_motion(motion_packets(t).drop("ts"))[0]


@query("f8_undecodable", "SELECT event_id, 'unknown opcode' AS reason FROM events WHERE event_type = 'error'")
def _(t: Tables):
    return packets.decode_motion(motion_packets(t))[1].select("event_id", "reason")


@query("a21_opcode_counts", f"""SELECT {CODE_SQL} AS "opCode", count(*) AS packets FROM events WHERE event_type <> 'error' GROUP BY 1""")
def _(t: Tables):
    return packets.opcode_counts(packets.decode_motion(motion_packets(t))[0], "opCode")


@query("j17_with_opcode", f"""SELECT event_id, {NAME_SQL} AS description, 'none' AS sent FROM events WHERE event_type <> 'error'""")
def _(t: Tables):
    code = fn.literal_map({k: c for k, (c, _) in CODES.items()})[F.col("event_type")]
    return packets.with_opcode(t.events.select("event_id", code.alias("opcode"))).select("event_id", "description", "sent")


def safety_packets(t: Tables):
    """Ethernet, IPv4 and UDP packets to a safety device."""
    c = F.col
    state = F.element_at(fn.literal_map({"click": "FF00", "view": "0000", "signup": "0001", "purchase": "0003", "error": "BEEF"}), c("event_type"))
    output = F.when(c("user_id") % 3 == 0, "0012").when(c("user_id") % 3 == 1, "0010").otherwise("0099")
    host = F.when(c("user_id") % 2 == 0, "84080765").otherwise("84080766")
    ip = F.concat(F.lit("4500002000000000" + "4011" + "0000" + "0A000001"), host)
    return t.events.select("event_id", F.unhex(F.concat(F.lit("00" * 12 + "0800"), ip, F.lit("10001001" + "000C" + "0000"), output, state)).alias("packet"))


OUT_SQL = """CASE user_id % 3 WHEN 0 THEN '0x0012' WHEN 1 THEN '0x0010' ELSE '0x0099' END"""
OUT_NAME = """CASE user_id % 3 WHEN 0 THEN CASE WHEN user_id % 2 = 0 THEN 'DO2_MOTION' ELSE 'DO2_PWR' END
  WHEN 1 THEN CASE WHEN user_id % 2 = 0 THEN '1' ELSE 'DO0_RLD' END ELSE '0x0099' END"""


@query("s6_decode_safety", f"""SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'PBE' ELSE 'SBE' END AS name, {OUT_SQL} AS "opCode", {OUT_NAME} AS description,
  CASE event_type WHEN 'click' THEN 'ON' WHEN 'view' THEN 'OFF' WHEN 'signup' THEN 'PULSE' WHEN 'purchase' THEN 'BURST' ELSE '0xBEEF' END AS state,
  lower('safety|' || {OUT_NAME} || '|true') AS id FROM events""")
def _(t: Tables):
    return packets.decode_safety(safety_packets(t)).select("event_id", "name", "opCode", "description", "state", "id")


@query("f2_endpoint_filter", """SELECT event_id FROM events WHERE (user_id % 2 = 0)""")
def _(t: Tables):
    headed = packets.with_headers(safety_packets(t))
    return headed.filter(packets.endpoint_filter("udp", [("132.8.7.101", None), (None, 4097)])).select("event_id")


@query("x7_picture_fields", """SELECT event_id, CASE event_type WHEN 'click' THEN 'FOV_REQ' WHEN 'view' THEN 'FOV_STS' WHEN 'signup' THEN 'LRF_REQ' ELSE 'LRF_STS' END AS description,
  CASE WHEN event_type = 'view' THEN value END AS zoom, CASE event_type WHEN 'purchase' THEN value WHEN 'error' THEN -1000.0 END AS measurement FROM events WHERE NOT (event_type = 'click' AND user_id % 2 = 1)""")
def _(t: Tables):
    c, number = F.col, F.col("value").cast("string")
    body = (F.when(c("event_type") == "click", F.when(c("user_id") % 2 == 0, "<a:ProfileToken>day</a:ProfileToken>").otherwise("<a:ProfileToken>side</a:ProfileToken>"))
            .when(c("event_type") == "view", F.concat(F.lit('<a:Zoom x="'), number, F.lit('"/>')))
            .when(c("event_type") == "signup", F.lit('<a:Power name="laser_range_finder"/>'))
            .when(c("event_type") == "purchase", F.concat(F.lit("<a:Measurement>"), number, F.lit("</a:Measurement>")))
            .otherwise(F.lit("<a:Measurement>[Error: 1001]</a:Measurement>")))
    ns = F.when(c("user_id") % 2 == 0, "s").otherwise("SOAP-ENV")
    xml = F.concat(F.lit("POST / HTTP/1.1\n\n<"), ns, F.lit(':Envelope xmlns:'), ns, F.lit('="urn:e" xmlns:a="urn:a">\n'), body, F.lit("</"), ns, F.lit(":Envelope>"))
    texts = once(t.events.select("event_id", xml.alias("text")), {"envelope": fn.x_envelope(F.col("text"))})
    return tracking.picture_rows(texts).select("event_id", "description", "zoom", "measurement")


@query("u16_reassemble", """SELECT conv_id, count(*) AS segments, md5(string_agg(text, '' ORDER BY turn)) AS digest, min(turn) AS first_turn FROM conversations GROUP BY conv_id""")
def _(t: Tables):
    base = F.timestamp_seconds(F.lit(1_700_000_000))
    segs = t.conversations.withColumn("at", F.timestamp_seconds(F.unix_seconds(base) + F.col("turn")))
    bursts = tracking.reassemble(segs, ["conv_id"], "at", "turn", "text")
    firsts = t.conversations.groupBy("conv_id").agg(F.min("turn").alias("first_turn"))
    return bursts.join(firsts, "conv_id").select("conv_id", "segments", F.md5("text").alias("digest"), "first_turn")

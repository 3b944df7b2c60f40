"""Queries over sessions, holes, runs, boards and table maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardsight.functions import geometry as geo, text as tx
from boardsight.operators import filters, groups, maintenance as m, sessions as ss
from boardsight.plans import views as v
from boardsight.plans.registry import Tables, query

r6 = lambda c: F.round(c, 6).alias(c)


@query("f3_not_deleted", f"SELECT id, session_id FROM {v.HOLES} WHERE deleted_at IS NULL")
def _(t: Tables):
    return filters.not_deleted(v.holes(t)).select("id", "session_id")


@query("f4_same_board", f"SELECT id FROM {v.HOLES} WHERE camera_alias IS NOT DISTINCT FROM CASE WHEN id % 2 = 0 THEN '1-URGENT' END")
def _(t: Tables):
    other = F.when(F.col("id") % 2 == 0, "1-URGENT")
    return v.holes(t).filter(filters.same_board(F.col("camera_alias"), other)).select("id")


ADMIT = f"""SELECT h.id, CASE WHEN h.source = 'model' AND s.status = 'completed' THEN 'session is completed'
  WHEN h.source = 'manual' AND s.status = 'active' THEN 'session is still active' END AS reason FROM {v.HOLES} h JOIN {v.SESSIONS} s ON s.id = h.session_id"""


@query("f10_admitted", f"SELECT id FROM ({ADMIT}) WHERE reason IS NULL")
def _(t: Tables):
    return filters.admit(v.holes(t), v.sessions(t))[0].select("id")


@query("f10_refused", f"SELECT id, reason FROM ({ADMIT}) WHERE reason IS NOT NULL")
def _(t: Tables):
    return filters.admit(v.holes(t), v.sessions(t))[1].select("id", "reason")


@query("f15_validate_rows", r"""SELECT c_custkey, list_filter([CASE WHEN NOT regexp_matches(alias, '^[A-Za-z0-9][A-Za-z0-9_-]{1,62}$') THEN 'alias' END,
  CASE WHEN first NOT BETWEEN 224 AND 239 THEN 'mcast_ip' END, CASE WHEN port NOT BETWEEN 1 AND 65535 THEN 'mcast_port' END,
  CASE WHEN regexp_matches(iface, '[^A-Za-z0-9 ._:#()*-]') THEN 'iface' END], lambda x: x IS NOT NULL) AS reasons
  FROM (SELECT c_custkey, CASE WHEN c_nationkey % 5 = 0 THEN c_name ELSE 'Cam_' || c_custkey END AS alias, c_nationkey * 10 AS first,
  CAST(floor(c_acctbal * 10) AS BIGINT) AS port, CASE WHEN c_nationkey % 4 = 0 THEN 'eth/0' ELSE 'eth 0' END AS iface FROM customer)""")
def _(t: Tables):
    c = F.col
    rows = t.customer.select(
        "c_custkey", F.when(c("c_nationkey") % 5 == 0, c("c_name")).otherwise(F.concat(F.lit("Cam_"), c("c_custkey").cast("string"))).alias("alias"),
        F.concat((c("c_nationkey") * 10).cast("string"), F.lit(".1.2.3")).alias("mcast_ip"),
        F.floor(c("c_acctbal") * 10).cast("string").alias("mcast_port"),
        F.when(c("c_nationkey") % 4 == 0, "eth/0").otherwise("eth 0").alias("iface"))
    return filters.validate_rows(rows).select("c_custkey", "reasons")


@query("f16_camera_status", f"""SELECT alias, CASE WHEN NOT enabled THEN 'disabled' WHEN alias IN (SELECT 'Cam' || s_nationkey FROM supplier WHERE s_acctbal > 0) THEN 'live' ELSE 'no_signal' END AS status FROM {v.CAMERAS}""")
def _(t: Tables):
    alive = t.supplier.filter("s_acctbal > 0").select(F.concat(F.lit("Cam"), F.col("s_nationkey").cast("string")).alias("alias")).distinct().withColumn("alive", F.lit(True))
    return filters.camera_status(v.cameras(t), alive).select("alias", "status")


@query("f17_project", "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS description FROM supplier")
def _(t: Tables):
    from pyspark.sql.types import StringType, StructField, StructType

    from boardsight.sources.signals import project
    named = t.supplier.withColumnsRenamed({"s_suppkey": "id", "s_name": "description"})
    return project(named, StructType([StructField("id", StringType()), StructField("description", StringType())]))


@query("j1_sessions_with_counts", f"SELECT s.id, s.name, count(h.id) AS hole_count FROM {v.SESSIONS} s LEFT JOIN {v.HOLES} h ON h.session_id = s.id AND h.deleted_at IS NULL GROUP BY ALL")
def _(t: Tables):
    return ss.sessions_with_counts(v.sessions(t), v.holes(t)).select("id", "name", "hole_count")


@query("j2_session_detail", f"""SELECT s.id, 0 AS part, coalesce(hole_ids, []) AS hole_ids, coalesce(run_ids, []) AS run_ids FROM {v.SESSIONS} s
  LEFT JOIN (SELECT session_id, list(id ORDER BY camera_alias NULLS LAST, created_at, id) AS hole_ids FROM {v.HOLES} WHERE deleted_at IS NULL GROUP BY 1) h ON h.session_id = s.id
  LEFT JOIN (SELECT o_custkey AS session_id, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS run_ids FROM orders WHERE o_orderstatus = 'P' GROUP BY 1) r ON r.session_id = s.id""")
def _(t: Tables):
    ranked = ss.rank_per_board(v.holes(t)).withColumn("rank", F.col("rank").cast("int"))
    runs = t.orders.filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("taken_at"))
    full = ss.session_detail(v.sessions(t), ranked, runs)
    return full.select("id", "part", F.transform("bullet_holes", lambda h: h["id"]).alias("hole_ids"), F.transform("runs", lambda r: r["id"]).alias("run_ids"))


@query("j3_range_tree", """SELECT l_orderkey * 10 + l_linenumber AS hit_id, o_orderkey AS event_id, c_custkey AS range_id, p_size AS center_x FROM lineitem
  JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey LEFT JOIN part ON p_partkey = l_partkey""")
def _(t: Tables):
    c = F.col
    ranges = t.customer.select(c("c_custkey").alias("id"), c("c_name").alias("description"))
    events = t.orders.select(c("o_orderkey").alias("id"), c("o_custkey").alias("range_id"), c("o_totalprice").alias("start_time"))
    targets = t.part.select(c("p_partkey").alias("id"), c("p_size").alias("center_x"), c("p_size").alias("center_y"))
    hits = t.lineitem.select((c("l_orderkey") * 10 + c("l_linenumber")).alias("id"), c("l_orderkey").alias("event_id"), c("l_partkey").alias("target_id"),
                             c("l_quantity").alias("range_to_target"), c("l_tax").alias("pos_x"), c("l_tax").alias("pos_y"))
    return ss.range_tree(ranges, events, hits, targets).select("hit_id", "event_id", "range_id", "center_x")


@query("j4_cascade_delete", "SELECT count(*) AS n, sum(l_orderkey) AS keys FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE o_custkey % 10 <> 0")
def _(t: Tables):
    left = t.customer.filter("c_custkey % 10 <> 0")
    orders = ss.cascade_delete(left, t.orders, "o_custkey", "c_custkey")
    lines = ss.cascade_delete(orders, t.lineitem, "l_orderkey", "o_orderkey")
    return lines.agg(F.count(F.lit(1)).alias("n"), F.sum("l_orderkey").alias("keys"))


ASOF = """(SELECT p.event_id, p.user_id, p.ts, r.event_id AS run_id, r.ts AS run_at FROM (SELECT * FROM events WHERE event_type <> 'signup') p
  ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') r ON r.user_id = p.user_id AND r.ts <= p.ts)"""
FIRST = "(SELECT user_id, arg_min(event_id, ts) AS first_id, min(ts) AS first_ts FROM events WHERE event_type = 'signup' GROUP BY user_id)"


def _points_and_runs(t: Tables):
    points = t.events.filter("event_type <> 'signup'").select("event_id", "user_id", F.col("ts").alias("seen"))
    runs = t.events.filter("event_type = 'signup'").select("user_id", F.col("event_id").alias("id"), F.col("ts").alias("taken_at"))
    return points, runs


@query("j5_asof_or_first", f"SELECT event_id, coalesce(run_id, first_id) AS run_id FROM {ASOF} a LEFT JOIN {FIRST} USING (user_id)")
def _(t: Tables):
    points, runs = _points_and_runs(t)
    return ss.asof_or_first(points, runs, ["user_id"], "seen").select("event_id", "run_id")


@query("j6_asof_bounded", f"SELECT event_id, CASE WHEN ts <= TIMESTAMP '2024-01-25 00:00:00' THEN run_id END AS place FROM {ASOF}")
def _(t: Tables):
    points, runs = _points_and_runs(t)
    points = points.withColumn("until", F.lit("2024-01-25 00:00:00").cast("timestamp_ntz"))
    found = ss.asof_bounded(points, runs, ["user_id"], "seen", "until", "taken_at", ["id"])
    return found.select("event_id", F.col("asof.id").alias("place"))


@query("j7_from_earlier_run", f"""SELECT event_id, coalesce(coalesce(run_at, first_ts) <> last_ts, false) AS from_earlier FROM {ASOF} a LEFT JOIN {FIRST} USING (user_id)
  LEFT JOIN (SELECT user_id, max(ts) AS last_ts FROM events WHERE event_type = 'signup' GROUP BY user_id) USING (user_id)""")
def _(t: Tables):
    points, runs = _points_and_runs(t)
    now = ss.latest(runs, ["user_id"], "taken_at").select("user_id", "taken_at")
    return ss.from_earlier_run(points, runs, now, ["user_id"], "seen").select("event_id", "from_earlier")


@query("j16_boards_of", f"""WITH s AS (SELECT 1 AS src, session_id, camera_alias, id AS pos FROM {v.HOLES} WHERE source = 'manual'
   UNION ALL SELECT 2, session_id, camera_alias, id FROM {v.HOLES} WHERE target_index = 1 UNION ALL SELECT 3, session_id, camera_alias, id FROM {v.HOLES}
   UNION ALL SELECT 4, session_id, camera_alias, id FROM {v.HOLES} WHERE deleted_at IS NOT NULL),
  a AS (SELECT session_id, camera_alias, min(struct_pack(src := src, pos := pos)) AS spot FROM (SELECT * FROM s WHERE camera_alias IS NOT NULL
   UNION ALL SELECT 0, session_id, alias, pos FROM (SELECT DISTINCT session_id FROM s), {v.CAMERAS} WHERE enabled) GROUP BY ALL
   UNION ALL SELECT DISTINCT session_id, NULL, struct_pack(src := 9, pos := 0) FROM s WHERE camera_alias IS NULL AND src IN (2, 3))
  SELECT session_id, camera_alias, row_number() OVER (PARTITION BY session_id ORDER BY spot.src, spot.pos, camera_alias) AS board_order FROM a""")
def _(t: Tables):
    h = v.holes(t).withColumn("pos", F.col("id"))
    return ss.boards_of(v.cameras(t), h.filter("source = 'manual'"), h.filter("target_index = 1"), h, h.filter("deleted_at is not null")).select(
        "session_id", "camera_alias", "board_order")


@query("j18_backfill_alias", f"""SELECT h.id, coalesce(c.alias, r.a) AS camera_alias FROM {v.HOLES} h LEFT JOIN {v.SESSIONS} s ON s.id = h.session_id
  LEFT JOIN (SELECT id, min(alias) AS alias FROM {v.CAMERAS} WHERE id < 3 GROUP BY id) c ON c.id = s.camera_id
  LEFT JOIN (SELECT session_id, min(camera_alias) AS a FROM {v.HOLES} WHERE target_index = 1 GROUP BY 1) r ON r.session_id = h.session_id""")
def _(t: Tables):
    cams = v.cameras(t).filter("id < 3").groupBy("id").agg(F.min("alias").alias("alias"))
    return ss.backfill_alias(v.holes(t).drop("camera_alias"), v.sessions(t), cams, v.holes(t).filter("target_index = 1")).select("id", "camera_alias")


@query("j21_name_taken", "SELECT p_partkey, count(*) OVER (PARTITION BY lower(trim(p_name)), p_brand) > 1 AS taken FROM part")
def _(t: Tables):
    names = t.part.select(F.col("p_partkey").alias("id"), F.concat(F.upper("p_name"), F.lit(" "), F.col("p_brand"), F.lit(" ")).alias("name"))
    return ss.name_taken(names, names).select(F.col("id").alias("p_partkey"), "taken")


@query("j22_diff_wanted", f"""WITH w AS (SELECT DISTINCT session_id, camera_alias FROM {v.HOLES} WHERE target_index = 1), r AS (SELECT DISTINCT session_id, camera_alias FROM {v.HOLES} WHERE target_index = 2)
  SELECT *, 'end' AS action FROM (SELECT * FROM r EXCEPT SELECT * FROM w) UNION ALL SELECT *, 'start' FROM (SELECT * FROM w EXCEPT SELECT * FROM r)""")
def _(t: Tables):
    h = v.holes(t)
    return ss.diff_wanted(h.filter("target_index = 1"), h.filter("target_index = 2"), ["session_id", "camera_alias"])


RANKS = f"SELECT id, row_number() OVER (PARTITION BY session_id, camera_alias ORDER BY created_at, id) AS rank FROM {v.HOLES}"


@query("w2_rank_per_board", f"{RANKS} WHERE deleted_at IS NULL")
def _(t: Tables):
    return ss.rank_per_board(v.holes(t)).select("id", "rank")


@query("w3_close_ranks", f"{RANKS} WHERE deleted_at IS NULL AND id % 3 <> 0")
def _(t: Tables):
    ranked = ss.rank_per_board(v.holes(t))
    gone = ranked.filter("id % 3 = 0").select("id", F.col("created_at").alias("deleted_at"))
    return ss.close_ranks(m.soft_delete(ranked, gone)).select("id", "rank")


@query("w4_latest", "SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY user_id")
def _(t: Tables):
    return ss.latest(t.events, ["user_id"], "ts", ["event_id"]).select("user_id", "event_id", "ts")


@query("a1_count_rows", f"SELECT session_id, count(*) FILTER (deleted_at IS NULL) AS n FROM {v.HOLES} GROUP BY 1")
def _(t: Tables):
    return ss.count_rows(v.holes(t), ["session_id"], F.col("deleted_at").isNull())


@query("a2_distinct_boards", f"SELECT DISTINCT session_id, camera_alias FROM {v.HOLES}")
def _(t: Tables):
    return ss.distinct_boards(v.holes(t))


@query("s12_export_holes", f"""SELECT session_id, coalesce(camera_alias, '') AS board, row_number() OVER (PARTITION BY session_id, camera_alias ORDER BY created_at, id) AS rank,
  round(position_x, 6) AS position_x, round(position_y, 6) AS position_y FROM {v.HOLES} WHERE deleted_at IS NULL""")
def _(t: Tables):
    return ss.export_holes(ss.rank_per_board(v.holes(t))).select("session_id", "board", "rank", r6("position_x"), r6("position_y"))


@query("s15_export_gate", f"SELECT id FROM {v.SESSIONS} WHERE status = 'completed'")
def _(t: Tables):
    return ss.export_gate(v.sessions(t)).select("id")


@query("l8_board_rank_order", f"SELECT id FROM {v.HOLES} WHERE deleted_at IS NULL")
def _(t: Tables):
    return ss.rank_per_board(v.holes(t)).orderBy(F.col("camera_alias").asc_nulls_last(), "rank").select("id")


IN_GROUP = "(target_index IS NOT NULL AND x_mm IS NOT NULL AND y_mm IS NOT NULL)"
STATS = """count(*) AS n, avg(x) AS mx, avg(y) AS my"""


def group_sql(rows: str, keys: str) -> str:
    """Group statistics by plain SQL: all pairs for the spread."""
    on = " AND ".join(f"a.{k} IS NOT DISTINCT FROM b.{k}" for k in keys.split(", "))
    qual = ", ".join(f"a.{k}" for k in keys.split(", "))
    return f"""WITH p AS (SELECT {keys}, x, y FROM {rows}), c AS (SELECT {keys}, {STATS} FROM p GROUP BY ALL),
  r AS (SELECT {qual}, sqrt((a.x - b.mx) ** 2 + (a.y - b.my) ** 2) AS r FROM p a JOIN c b ON {on}),
  s AS (SELECT {keys}, quantile_cont(r, 0.5) AS cep, avg(r) AS mean_r, sqrt(avg(r * r)) AS rms FROM r GROUP BY ALL),
  e AS (SELECT {qual}, max(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS spread FROM p a JOIN p b ON {on} GROUP BY ALL)"""


def group_cols(keys: str) -> str:
    on = lambda b: " AND ".join(f"c.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys.split(", "))
    return ", ".join([f"c.{k}" for k in keys.split(", ")]) + f""", c.n, round(c.mx, 6) AS mpi_x_mm, round(c.my, 6) AS mpi_y_mm,
  round(CASE WHEN n > 1 THEN cep END, 6) AS cep_mm, round(CASE WHEN n > 1 THEN mean_r END, 6) AS mean_radius_mm, round(CASE WHEN n > 1 THEN rms END, 6) AS rms_radius_mm,
  round(CASE WHEN n > 1 THEN spread END, 6) AS extreme_spread_mm FROM c JOIN s ON {on('s')} JOIN e ON {on('e')}"""


def _measures():
    return [r6(c) for c in groups.STATS[1:]]


@query("a3_group_stats", group_sql(v.POINTS, "label") + " SELECT " + group_cols("label"))
def _(t: Tables):
    return groups.group_stats(v.points(t), ["label"], "x", "y").select("label", "n", *_measures())


GROUPED = f"(SELECT session_id, camera_alias, target_index, x_mm AS x, y_mm AS y FROM {v.HOLES} WHERE deleted_at IS NULL AND {IN_GROUP})"


@query("a3_hole_groups", group_sql(GROUPED, "session_id, camera_alias, target_index") + " SELECT " + group_cols("session_id, camera_alias, target_index"))
def _(t: Tables):
    return groups.hole_groups(filters.not_deleted(v.holes(t))).select("session_id", "camera_alias", "target_index", "n", *_measures())


MISS = f"(NOT {IN_GROUP} AND target_index IS NULL AND source = 'model')"


@query("a4_exclusions", f"SELECT session_id, camera_alias, count(*) FILTER ({MISS}) AS misses, count(*) FILTER (NOT {IN_GROUP} AND NOT {MISS}) AS without_position FROM {v.HOLES} GROUP BY ALL")
def _(t: Tables):
    return groups.exclusions(v.holes(t))


@query("a5_misses", f"SELECT session_id, camera_alias, count(*) FILTER (target_index IS NULL) AS misses FROM {v.HOLES} GROUP BY ALL")
def _(t: Tables):
    return groups.misses(v.holes(t))


@query("a6_order_boards", f"SELECT DISTINCT camera_alias FROM {v.HOLES}")
def _(t: Tables):
    return groups.order_boards(v.holes(t).select("camera_alias").distinct())


BOUNDS = f"""(SELECT session_id, camera_alias, min_x, min_y, max_x - min_x AS cw, max_y - min_y AS ch FROM (SELECT session_id, camera_alias, least(0.0, min(position_x)) AS min_x, greatest(1405.0, max(position_x)) AS max_x,
  least(0.0, min(position_y)) AS min_y, greatest(1120.0, max(position_y)) AS max_y FROM {v.HOLES} GROUP BY ALL))"""


@query("a15_canvas_bounds", f"""SELECT session_id, camera_alias, round(min_x, 6) AS min_x, round(min_y, 6) AS min_y, round(cw, 6) AS cw, round(ch, 6) AS ch, round(ch / cw * 100, 6) AS pad_pct,
  round(-min_x / cw * 100, 6) AS img_left, round(-min_y / ch * 100, 6) AS img_top, round(1405.0 / cw * 100, 6) AS img_width, round(1120.0 / ch * 100, 6) AS img_height FROM {BOUNDS}""")
def _(t: Tables):
    b = groups.canvas_bounds(v.holes(t))
    return b.select("session_id", "camera_alias", *[(F.round(c, 6) + 0.0).alias(c) for c in b.columns[2:]])


@query("a16_canvas_percent", f"""SELECT h.id, round((position_x - min_x) / cw * 100, 6) AS left_pct, round((position_y - min_y) / ch * 100, 6) AS top_pct
  FROM {v.HOLES} h JOIN {BOUNDS} b ON h.session_id = b.session_id AND h.camera_alias IS NOT DISTINCT FROM b.camera_alias""")
def _(t: Tables):
    h = v.holes(t)
    return groups.canvas_percent(h, groups.canvas_bounds(h)).select("id", r6("left_pct"), r6("top_pct"))


@query("s13_export_groups", group_sql(GROUPED, "session_id, camera_alias, target_index") + f""" SELECT session_id, camera_alias, target, n, mpi_x_mm, extreme_spread_mm FROM (
  SELECT session_id, camera_alias, 'Target ' || (target_index + 1) AS target, n, mpi_x_mm, extreme_spread_mm FROM (SELECT {group_cols('session_id, camera_alias, target_index')})
  UNION ALL SELECT session_id, camera_alias, 'Misses', count(*) FILTER ({MISS}), NULL, NULL FROM {v.HOLES} WHERE deleted_at IS NULL GROUP BY ALL
  UNION ALL SELECT session_id, camera_alias, 'Without a position', count(*) FILTER (NOT {IN_GROUP} AND NOT {MISS}), NULL, NULL FROM {v.HOLES} WHERE deleted_at IS NULL GROUP BY ALL)""")
def _(t: Tables):
    return groups.export_groups(filters.not_deleted(v.holes(t))).select("session_id", "camera_alias", "target", "n", r6("mpi_x_mm"), r6("extreme_spread_mm"))


UUID = """(SELECT id, substr(d, 1, 8) || '-' || substr(d, 9, 4) || '-5' || substr(d, 14, 3) || '-' || substr('89ab', CAST(instr('0123456789abcdef', substr(d, 17, 1)) - 1 AS INT) % 4 + 1, 1) || substr(d, 18, 3) || '-' || substr(d, 21, 12) AS key
  FROM (SELECT id, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(session_id || ':' || coalesce(camera_alias, 'none') || ':' || id || ':' || CAST(round_even(position_x, 0) AS BIGINT) || ':' || CAST(round_even(position_y, 0) AS BIGINT))) AS d FROM """ + v.HOLES + "))"


@query("x12_derived_key", f"SELECT id, key FROM {UUID}")
def _(t: Tables):
    key = tx.x_derived_key(F.col("session_id").cast("string"), F.coalesce("camera_alias", F.lit("none")), F.col("id"), F.col("position_x"), F.col("position_y"))
    return v.holes(t).select("id", key.alias("key"))


@query("s14_payload", f"""SELECT h.id, k.key AS idempotency_key, strftime(first_seen_at, '%Y-%m-%dT%H:%M:%S') || '.000Z' AS first_seen_at, round(position_x, 6) AS x, target_index FROM {v.HOLES} h JOIN {UUID} k USING (id)""")
def _(t: Tables):
    h = v.holes(t).select("id", F.col("session_id").cast("string").alias("session_id"), F.coalesce("camera_alias", F.lit("none")).alias("camera"), F.col("id").alias("first_frame"),
                          F.col("first_seen_at").cast("timestamp").alias("first_seen_at"), F.col("position_x").alias("x"), F.col("position_y").alias("y"), "target_index", "x_mm", "y_mm")
    said = F.from_json("payload", "idempotency_key string, first_seen_at string, position struct<x:double>, target_index int")
    return groups.to_payload(h).select("id", said.alias("p")).select("id", "p.idempotency_key", "p.first_seen_at", F.round("p.position.x", 6).alias("x"), "p.target_index")


@query("d1_append", "SELECT o_orderkey, o_totalprice FROM orders UNION ALL SELECT o_orderkey + 1000000000, o_totalprice FROM orders WHERE o_orderstatus = 'O'")
def _(t: Tables):
    base = t.orders.select("o_orderkey", "o_totalprice")
    more = t.orders.filter("o_orderstatus = 'O'").select((F.col("o_orderkey") + 1000000000).alias("o_orderkey"), "o_totalprice")
    return m.append(base, more)


@query("d2_insert_absent", f"""SELECT id, session_id, idempotency_key FROM {v.HOLES} WHERE source = 'manual' UNION ALL SELECT id, session_id, idempotency_key FROM (SELECT * FROM {v.HOLES} WHERE source = 'model'
   AND (session_id, coalesce(camera_alias, '')) NOT IN (SELECT session_id, coalesce(camera_alias, '') FROM {v.HOLES} WHERE source = 'manual')) QUALIFY row_number() OVER (PARTITION BY session_id, coalesce(camera_alias, '') ORDER BY id) = 1""")
def _(t: Tables):
    h = v.holes(t).select("id", "session_id", "idempotency_key", "source", F.coalesce("camera_alias", F.lit("")).alias("board"))
    return m.insert_absent(h.filter("source = 'manual'"), h.filter("source = 'model'"), ["session_id", "board"], ["id"]).select("id", "session_id", "idempotency_key")


D3 = f"""SELECT id FROM {v.HOLES} WHERE source = 'manual' UNION ALL SELECT id FROM {v.HOLES} WHERE source = 'model' AND idempotency_key IS NULL
  UNION ALL SELECT id FROM (SELECT * FROM {v.HOLES} WHERE source = 'model' AND idempotency_key IS NOT NULL
   AND (session_id, idempotency_key) NOT IN (SELECT session_id, idempotency_key FROM {v.HOLES} WHERE source = 'manual' AND idempotency_key IS NOT NULL)) QUALIFY row_number() OVER (PARTITION BY session_id, idempotency_key ORDER BY id) = 1"""


@query("d3_idempotent_insert", D3)
def _(t: Tables):
    h = v.holes(t).select("id", "session_id", "idempotency_key", "source")
    return m.idempotent_insert(h.filter("source = 'manual'"), h.filter("source = 'model'"), ["session_id", "idempotency_key"], ["id"]).select("id")


@query("d3_stored_row", f"""SELECT id, CASE WHEN idempotency_key IS NULL THEN id ELSE first_value(id) OVER (PARTITION BY session_id, idempotency_key ORDER BY source = 'model', id) END AS stored_id
  FROM {v.HOLES} QUALIFY source = 'model'""")
def _(t: Tables):
    h = v.holes(t).select("id", "session_id", "idempotency_key", "source")
    return m.stored_row(h.filter("source = 'manual'"), h.filter("source = 'model'"), ["session_id", "idempotency_key"], "id", ["id"]).select("id", "stored_id")


@query("d4_patch", """SELECT c_custkey, coalesce((SELECT arg_max(o_totalprice, o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus <> 'P'), c_acctbal) AS start_time,
  coalesce((SELECT arg_max(o_orderpriority, o_orderkey) FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F'), c_name) AS description FROM customer""")
def _(t: Tables):
    table = t.customer.select("c_custkey", F.col("c_acctbal").alias("start_time"), F.col("c_name").alias("description"))
    changes = t.orders.select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("v"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("start_time"),
                              F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority")).alias("description"))
    return m.patch(table, changes, "c_custkey", "v", ["start_time", "description"])


@query("d5_soft_delete", f"SELECT h.id, coalesce(h.deleted_at, d.at) AS deleted_at FROM {v.HOLES} h LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS at FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) d ON d.l_orderkey = h.id")
def _(t: Tables):
    log = t.lineitem.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"), F.col("l_shipdate").alias("deleted_at"))
    return m.soft_delete(v.holes(t), log).select("id", "deleted_at")


@query("d6_audit_constraints", f"""SELECT 'one active session' AS rule, 'active' AS key, count(*) AS rows FROM {v.SESSIONS} WHERE status = 'active' HAVING count(*) > 1
  UNION ALL SELECT 'hole key', session_id || '|' || idempotency_key, count(*) FROM {v.HOLES} WHERE idempotency_key IS NOT NULL GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT 'run start', session_id || '|' || coalesce(camera_alias, '') || '|' || taken, count(*) FROM (SELECT *, year(created_at) AS taken FROM {v.HOLES}) GROUP BY ALL HAVING count(*) > 1
  UNION ALL SELECT 'camera alias', lower(p_name), count(*) FROM part GROUP BY ALL HAVING count(*) > 1""")
def _(t: Tables):
    runs = v.holes(t).withColumn("taken_at", F.year("created_at"))
    return m.audit_constraints(v.sessions(t), v.holes(t), runs, t.part.select(F.upper("p_name").alias("alias")))


def _event_log(t: Tables):
    """Events as a log: hole events, and signups as updates of their session."""
    whole = F.floor("value").cast("int")
    kind = F.when(F.col("event_type") == "error", "bullet_deleted").when(F.col("event_type") == "signup", "session_updated").otherwise("bullet_created")
    return t.events.select(
        F.col("user_id").alias("session_id"), (whole % 40).cast("string").alias("bullet_id"), (whole % 40).alias("slot"), F.col("event_id").alias("seq"), F.col("event_id").alias("bullet_event"),
        kind.alias("type"), (whole % 40 % 3).alias("camera_alias"), F.struct((whole * 100).alias("w"), (whole % 40).alias("s")).alias("rank"),
        F.concat(F.lit("n"), (whole % 5).cast("string")).alias("name"), F.when(whole % 2 == 0, "active").otherwise("completed").alias("status"),
        F.when(whole % 2 == 1, F.col("ts").cast("timestamp")).alias("ended_at"))


@query("u18_headers", """SELECT user_id, 'n' || (whole % 5) AS name, CASE WHEN whole % 2 = 0 THEN 'active' ELSE 'completed' END AS status, CASE WHEN whole % 2 = 1 THEN epoch_us(ts) END AS ended_us
  FROM (SELECT user_id, event_id, ts, CAST(floor(value) AS INT) AS whole FROM events WHERE event_type = 'signup') QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def _(t: Tables):
    return ss.fold_events(_event_log(t))[1].select(F.col("session_id").alias("user_id"), "name", "status", F.unix_micros("ended_at").alias("ended_us"))


@query("u18_fold_events", """SELECT event_id AS bullet_event, user_id, slot, row_number() OVER (PARTITION BY user_id, board ORDER BY was, slot) AS rank FROM (SELECT *, CAST(value AS INT) % 40 AS slot, CAST(value AS INT) % 40 % 3 AS board,
  CAST(value * 100 AS BIGINT) AS was FROM (SELECT event_id, user_id, event_type, floor(value) AS value FROM events WHERE event_type <> 'signup')
  QUALIFY row_number() OVER (PARTITION BY user_id, CAST(value AS INT) % 40 ORDER BY event_id DESC) = 1) WHERE event_type <> 'error'""")
def _(t: Tables):
    return ss.fold_events(_event_log(t))[0].select("bullet_event", F.col("session_id").alias("user_id"), "slot", "rank")


VERSIONS = """(SELECT user_id, event_id, ts, CASE WHEN event_type IN ('click', 'view') THEN 'active' ELSE 'completed' END AS status, 'n' || (CAST(floor(value) AS BIGINT) % 3) AS name FROM events)"""


def _versions(t: Tables):
    return t.events.select("user_id", "event_id", "ts", F.when(F.col("event_type").isin("click", "view"), "active").otherwise("completed").alias("status"),
                           F.concat(F.lit("n"), (F.floor("value") % 3).cast("string")).alias("name"))


@query("u20_change_report", f"""WITH w AS (SELECT *, lag(status) OVER p AS ps, lag(name) OVER p AS pn, min(ts) OVER (PARTITION BY user_id) AS t0 FROM {VERSIONS} WINDOW p AS (PARTITION BY user_id ORDER BY event_id))
  SELECT user_id, event_id, CASE WHEN status = 'completed' THEN 'completed' ELSE 'reopened' END AS change, round(CASE WHEN status = 'completed' THEN (epoch_us(ts) - epoch_us(t0)) / 1e6 END, 6) AS duration_s, NULL AS previous_name FROM w WHERE status <> ps
  UNION ALL SELECT user_id, event_id, 'renamed', NULL, pn FROM w WHERE name <> pn""")
def _(t: Tables):
    first = t.events.groupBy("user_id").agg(F.min("ts").cast("timestamp").alias("started_at"))
    versions = _versions(t).withColumn("ended_at", F.col("ts").cast("timestamp")).join(first, "user_id")
    return ss.change_report(versions, "user_id", "event_id").select("user_id", "event_id", "change", F.round("duration_s", 6).alias("duration_s"), "previous_name")


@query("u21_end_times", f"""WITH c AS (SELECT *, max(CASE WHEN status = 'active' THEN (ts, event_id) END) OVER (PARTITION BY user_id) AS re FROM {VERSIONS})
  SELECT user_id, arg_max(status, (ts, event_id)) AS status, min(CASE WHEN status = 'completed' AND (re IS NULL OR (ts, event_id) > re) THEN ts END) AS ended_at FROM c GROUP BY user_id""")
def _(t: Tables):
    return ss.end_times(_versions(t), "user_id", "ts", ["event_id"])


@query("x20_durations", """SELECT o_orderkey, CAST(s // 60 AS BIGINT) || 'm ' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') || 's' AS report, CASE WHEN s >= 3600 THEN (s // 3600) || 'h ' ELSE '' END || (s % 3600 // 60) || 'm ' || (s % 60) || 's' AS long,
  (r // 60) || ':' || lpad(CAST(r % 60 AS VARCHAR), 2, '0') AS short FROM (SELECT o_orderkey, CAST(floor(o_totalprice / 10) AS BIGINT) AS s, CAST(floor(o_totalprice / 100 + 0.5) AS BIGINT) AS r FROM orders)""")
def _(t: Tables):
    start = F.timestamp_seconds(F.lit(1_700_000_000))
    end = F.timestamp_seconds(F.lit(1_700_000_000) + F.floor(F.col("o_totalprice") / 10))
    return t.orders.select("o_orderkey", tx.x_report_duration(start, end).alias("report"), tx.x_long_duration(start, end).alias("long"), tx.x_length(F.col("o_totalprice") / 100).alias("short"))


@query("x21_mm_label", "SELECT s_suppkey, CASE WHEN s_nationkey % 5 = 0 THEN '—' ELSE printf('%+.1f', CAST(s_nationkey - 12 AS DOUBLE)) || ', ' || printf('%+.1f', CAST(s_nationkey AS DOUBLE) / 5 - 3.01) || ' mm' END AS label FROM supplier")
def _(t: Tables):
    x = F.when(F.col("s_nationkey") % 5 != 0, F.col("s_nationkey") - 12)
    return t.supplier.select("s_suppkey", tx.x_mm_label(x, F.col("s_nationkey") / 5 - 3.01).alias("label"))


@query("x22_file_name", r"""SELECT o_orderkey, 'session_' || coalesce(nullif(trim(regexp_replace(regexp_replace(o_orderpriority || ' #' || o_orderstatus || '?', '[^A-Za-z0-9_\s-]', '_', 'g'), '\s+', '_', 'g'), '_'), ''), 'session') || '_' || strftime(o_orderdate, '%Y%m%d') || '.csv' AS file FROM orders""")
def _(t: Tables):
    name = F.concat("o_orderpriority", F.lit(" #"), "o_orderstatus", F.lit("é"))
    return t.orders.select("o_orderkey", tx.x_file_name(name, F.col("o_orderdate"), "csv").alias("file"))


@query("x23_iso_ms", "SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(CAST(epoch_us(ts) // 1000 % 1000 AS VARCHAR), 3, '0') || 'Z' AS at, epoch_us(ts) // 1000 AS ms FROM events")
def _(t: Tables):
    text = tx.x_iso_ms(F.col("ts").cast("timestamp"))
    return t.events.select("event_id", text.alias("at"), F.unix_millis(tx.x_parse_iso(F.regexp_replace(text, "Z$", "+00:00"))).alias("ms"))


@query("x25_name_key", "SELECT p_partkey, lower(trim(p_name)) || ' strasse équipe σασ' AS key FROM part")
def _(t: Tables):
    name = F.concat(F.lit("\u00a0 \t"), F.upper("p_name"), F.lit(" STRAße ÉQUIPE Σας\u2003\n "))
    return t.part.select("p_partkey", tx.x_name_key(name).alias("key"))


@query("x26_plain_json", "SELECT o_orderkey, o_custkey AS k, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S.000Z') AS at FROM orders")
def _(t: Tables):
    said = tx.x_plain_json(F.struct(F.col("o_custkey").alias("k"), F.col("o_orderdate").cast("timestamp").alias("at")))
    return t.orders.select("o_orderkey", F.from_json(said, "k long, at string").alias("j")).select("o_orderkey", "j.*")


@query("x27_request_level", """SELECT p_partkey, CASE WHEN p_size * 15 >= 500 THEN 'error' WHEN p_size * 15 >= 400 THEN 'warning' WHEN p_type = 'SMALL' OR p_partkey % 3 = 0 THEN 'debug' ELSE 'info' END AS level FROM part""")
def _(t: Tables):
    method = F.when(F.col("p_type") == "SMALL", "OPTIONS").otherwise("GET")
    path = F.when(F.col("p_partkey") % 3 == 0, "/health").otherwise("/healthy")
    return t.part.select("p_partkey", tx.x_request_level(F.col("p_size") * 15, method, path).alias("level"))


@query("x28_truth_folder", "SELECT c_custkey, 'cust-omer-' || c_custkey AS folder FROM customer")
def _(t: Tables):
    return t.customer.select("c_custkey", tx.x_truth_folder(F.concat(F.lit("Cust_Omer_"), F.col("c_custkey").cast("string"), F.lit(".mkv"))).alias("folder"))


@query("x14_ring_score", f"""SELECT id, CASE WHEN d <= 111.5 THEN 10 WHEN d <= 220.5 THEN 9 WHEN d <= 322.4 THEN 8 WHEN d <= 425.1 THEN 7 WHEN d <= 528.2 THEN 6 ELSE 0 END AS score
  FROM (SELECT id, sqrt((position_x - 695.4) ** 2 + (position_y - 639.2) ** 2) AS d FROM {v.HOLES})""")
def _(t: Tables):
    d = geo.x_distance(F.col("position_x"), F.col("position_y"), *geo.RING_CENTRE)
    return v.holes(t).select("id", geo.x_ring_score(d).alias("score"))


@query("x13_millimetres", f"""SELECT id, round((position_x - 695.4) * 0.1763, 6) AS x_mm, round(-(position_y - 639.2) * 0.1763, 6) AS y_mm, CAST(NULL AS VARCHAR) AS reason FROM {v.HOLES} WHERE camera_alias IS NOT NULL
  UNION ALL SELECT id, NULL, NULL, 'no print scale' FROM {v.HOLES} WHERE camera_alias IS NULL""")
def _(t: Tables):
    scale = F.when(F.col("camera_alias").isNotNull(), 0.1763)
    mm = geo.x_millimetres(F.col("position_x"), F.col("position_y"), *geo.RING_CENTRE, scale)
    return v.holes(t).select("id", F.round(mm["x_mm"], 6).alias("x_mm"), F.round(mm["y_mm"], 6).alias("y_mm"), geo.x_scale_reason(scale).alias("reason"))


H = [[1.01, 0.02, 5.0], [-0.03, 0.98, 7.0], [1e-5, 2e-5, 1.0]]


def _matrix():
    return F.array(*[F.array(*[F.lit(x) for x in row]) for row in H])


def _project(x: str, y: str) -> tuple[str, str]:
    w = f"({H[2][0]} * {x} + {H[2][1]} * {y} + {H[2][2]})"
    return tuple(f"(({H[i][0]} * {x} + {H[i][1]} * {y} + {H[i][2]}) / {w})" for i in (0, 1))


@query("x9_x10_project", f"SELECT id, round({_project('position_x', 'position_y')[0]}, 6) AS px, round({_project('position_x', 'position_y')[1]}, 6) AS py, round(position_x, 6) AS bx, round(position_y, 6) AS by_ FROM {v.HOLES}".replace("0.02 *", "CAST(0.02 AS DOUBLE) *"))
def _(t: Tables):
    there = geo.x_project(_matrix(), F.col("position_x"), F.col("position_y"))
    rows = v.holes(t).select("id", there.alias("p"))
    back = geo.x_project(geo.x_adjugate(_matrix()), F.col("p.x"), F.col("p.y"))
    return rows.select("id", F.round("p.x", 6).alias("px"), F.round("p.y", 6).alias("py"), back.alias("b")).select(
        "id", "px", "py", F.round("b.x", 6).alias("bx"), F.round("b.y", 6).alias("by_"))


@query("x11_fit", f"SELECT id, round((720 - 1280 * (400 / 720.0)) / 2 + position_x * (1280 * (400 / 720.0)) / 1920, 6) AS x, round(position_y * 400.0 / 1080, 6) AS y FROM {v.HOLES} WHERE id % 2 = 0 UNION ALL SELECT id, NULL, NULL FROM {v.HOLES} WHERE id % 2 = 1")
def _(t: Tables):
    spot = F.struct(F.col("position_x").alias("x"), F.col("position_y").alias("y"))
    shown = F.when(F.col("id") % 2 == 0, 1280.0).otherwise(1000.0)
    wide = geo.x_fit(spot, 1920, 1080, shown, 720, 720, 400)
    return v.holes(t).select("id", F.round(wide["x"], 6).alias("x"), F.round(wide["y"], 6).alias("y"))

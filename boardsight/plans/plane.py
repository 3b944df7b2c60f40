"""Queries over points, marks, matching, scoring and comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardsight.functions import geometry as geo
from boardsight.operators import filters, scoring as sc, spatial as sp
from boardsight.plans import views as v
from boardsight.plans.registry import SQL, Tables, query

r6 = lambda c: F.round(c, 6).alias(c)
D = "sqrt((p.x - m.x) ** 2 + (p.y - m.y) ** 2)"
PAIRS = f"(SELECT p.id, p.label, m.mark_id, {D} AS d FROM {v.POINTS} p JOIN {v.MARKS} m ON p.label = m.label)"


@query("f9_finite", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity <> 7 AND l_linenumber <> 3")
def _(t: Tables):
    rows = t.lineitem.withColumns({
        "x": F.when(F.col("l_quantity") == 7, F.lit(float("nan"))).otherwise(F.col("l_quantity")),
        "y": F.when(F.col("l_linenumber") == 3, F.lit(float("-inf"))).otherwise(F.col("l_tax"))})
    return filters.finite(rows, ["x", "y"]).select("l_orderkey", "l_linenumber")


RECTS = """(SELECT n_nationkey AS idx, n_regionkey * 300.0 AS x0, n_regionkey * 300.0 + 280 AS x1, n_nationkey * 40.0 AS y0, n_nationkey * 40.0 + 100 AS y1 FROM nation)"""


def _rects(t: Tables):
    c = F.col
    return t.nation.select(c("n_nationkey").alias("idx"), (c("n_regionkey") * 300.0).alias("x0"), (c("n_regionkey") * 300.0 + 280).alias("x1"),
                           (c("n_nationkey") * 40.0).alias("y0"), (c("n_nationkey") * 40.0 + 100).alias("y1"))


@query("f11_assign_rect", f"""SELECT id, coalesce(min(idx), -1) AS sheet FROM (SELECT id, position_x AS x, position_y AS y FROM {v.HOLES}) LEFT JOIN {RECTS} ON x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY id""")
def _(t: Tables):
    pts = v.holes(t).select("id", F.col("position_x").alias("x"), F.col("position_y").alias("y"))
    return filters.assign_rect(pts, _rects(t), []).select("id", "sheet")


# an outline of four corners: a diamond inscribed in each rectangle, so inside is |dx|/a + |dy|/b <= 1
@query("f12_assign_polygon", f"""SELECT id, min(idx) AS target_index FROM (SELECT id, position_x AS x, position_y AS y FROM {v.HOLES}) LEFT JOIN {RECTS}
  ON abs(x - x0 - 140) / 140 + abs(y - y0 - 50) / 50 <= 1 GROUP BY id""")
def _(t: Tables):
    corner = lambda x, y: F.struct((F.col("x0") + x).cast("double").alias("x"), (F.col("y0") + y).cast("double").alias("y"))
    shapes = _rects(t).select("idx", F.array(corner(140, 0), corner(280, 50), corner(140, 100), corner(0, 50)).alias("outline"))
    pts = v.holes(t).select("id", F.col("position_x").alias("x"), F.col("position_y").alias("y"))
    return filters.assign_polygon(pts, shapes, []).select("id", "target_index")


@query("j8_distance_join", f"SELECT id, mark_id, round(d, 6) AS distance FROM {PAIRS} WHERE d <= 60")
def _(t: Tables):
    return sp.distance_join(v.points(t), v.marks(t), 60.0, ["label"]).select("id", "mark_id", r6("distance"))


@query("j8_distance_join_strict", f"SELECT id, mark_id FROM {PAIRS} WHERE d < 45")
def _(t: Tables):
    return sp.distance_join(v.points(t), v.marks(t), 45.0, ["label"], inclusive=False).select("id", "mark_id")


@query("j9_nearest", f"SELECT id, arg_min(mark_id, (d, mark_id)) AS mark_id, round(min(d), 6) AS distance FROM {PAIRS} GROUP BY id")
def _(t: Tables):
    return sp.nearest(v.points(t), v.marks(t), ["label"], mark_id="mark_id").select("id", "mark_id", r6("distance"))


@query("j9_nearest_within", f"SELECT id, arg_min(mark_id, (d, mark_id)) FILTER (d <= 50) AS mark_id, round(min(d) FILTER (d <= 50), 6) AS distance FROM {PAIRS} GROUP BY id")
def _(t: Tables):
    return sp.nearest(v.points(t), v.marks(t), ["label"], 50.0, "mark_id").select("id", "mark_id", r6("distance"))


STRIP = f"(SELECT id, min(d) AS d FROM {PAIRS} GROUP BY id)"


@query("j10_survivors", f"SELECT id FROM {STRIP} WHERE d >= 60")
def _(t: Tables):
    return sp.strip_known(v.points(t), v.marks(t), 60.0, ["label"])[0].select("id")


@query("j10_residuals", f"SELECT id, round(d, 6) AS distance FROM {STRIP} WHERE d < 60")
def _(t: Tables):
    return sp.strip_known(v.points(t), v.marks(t), 60.0, ["label"])[1].select("id", r6("distance"))


@query("j11_marks_to_draw", f"SELECT mark_id FROM {PAIRS} GROUP BY mark_id HAVING min(d) >= 20")
def _(t: Tables):
    return sp.marks_to_draw(v.marks(t), v.points(t), 20.0, ["label"]).select("mark_id")


@query("j14_missed_on_mark", f"SELECT id, arg_min(mark_id, (d, mark_id)) AS mark_id FROM {PAIRS} WHERE d <= 40 GROUP BY id")
def _(t: Tables):
    return sp.missed_on_mark(v.points(t), v.marks(t), 40.0, ["label"]).select("id", "mark_id")


@query("x16_cause", f"SELECT id AS found_id, CASE WHEN d <= 40 THEN 'displacement' WHEN d > 80 THEN 'detector' ELSE 'unknown' END AS cause FROM {STRIP} WHERE id % 3 <> 0")
def _(t: Tables):
    found = v.points(t).withColumnRenamed("id", "found_id")
    return sc.attribute(found, found.filter("found_id % 3 = 0"), v.marks(t), ["label"], 40.0).select("found_id", "cause")


@query("a23_residual_summary", f"""SELECT p.label, round(quantile_cont(d, 0.5), 6) AS median, count(*) AS n, round(max(d), 6) AS max, round(max(d), 1) >= 60 AS at_radius FROM {STRIP} s JOIN {v.POINTS} p USING (id) WHERE d < 60 GROUP BY ALL""")
def _(t: Tables):
    dropped = sp.strip_known(v.points(t), v.marks(t), 60.0, ["label"])[1]
    return sc.residual_summary(dropped, 60.0, ["label"]).select("label", r6("median"), "n", r6("max"), "at_radius")


@query("g1_label_groups", f"""WITH RECURSIVE e AS (SELECT p.id AS a, m.id AS b FROM {v.POINTS} p JOIN {v.POINTS} m ON p.label = m.label AND {D} < 40), r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
  SELECT a AS id, min(b) AS group_id FROM r GROUP BY a""")
def _(t: Tables):
    return sp.label_groups(v.points(t), ["label"], 40.0).select("id", "group_id")


@query("u3_spread", f"SELECT p.label, round(max({D}), 6) AS extreme_spread FROM {v.POINTS} p JOIN {v.POINTS} m USING (label) GROUP BY ALL")
def _(t: Tables):
    return sp.spread(v.points(t), ["label"]).select("label", r6("extreme_spread"))


@query("u14_carry_points", f"""WITH o AS (SELECT p.label, p.id AS p, m.mark_id AS m, m.x - p.x AS ox, m.y - p.y AS oy, {D} AS reach FROM {v.POINTS} p JOIN {v.MARKS} m ON p.label = m.label WHERE {D} < 80),
  g AS (SELECT s.label, s.p AS sp, s.m AS sm, s.reach AS sr, o.p, arg_min(struct_pack(ox := o.ox, oy := o.oy), (sqrt((o.ox - s.ox) ** 2 + (o.oy - s.oy) ** 2), o.m)) AS o, min(sqrt((o.ox - s.ox) ** 2 + (o.oy - s.oy) ** 2)) AS stray
   FROM o s JOIN o ON o.label = s.label AND sqrt((o.ox - s.ox) ** 2 + (o.oy - s.oy) ** 2) < 20 WHERE s.reach < 60 GROUP BY ALL),
  b AS (SELECT label, sp, sm FROM (SELECT label, sp, sm, sr, count(*) AS n, sum(CAST(stray AS DECIMAL(30, 9))) AS total FROM g GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY label ORDER BY n DESC, total, sp, sr, sm) = 1)
  SELECT label, round(quantile_cont(o.ox, 0.5), 6) AS dx, round(quantile_cont(o.oy, 0.5), 6) AS dy, count(*) AS agreeing FROM g JOIN b USING (label, sp, sm) GROUP BY label""")
def _(t: Tables):
    return sp.carry_points(v.points(t), v.marks(t), ["label"]).select("label", r6("dx"), r6("dy"), "agreeing")


@query("j12_match_one_to_one")
def _(t: Tables):
    pairs = sc.match_one_to_one(v.points(t).withColumnRenamed("id", "truth_id"), v.marks(t).withColumnRenamed("mark_id", "found_id"), 40.0, ["label"])
    return pairs.select("label", "truth_id", "found_id", r6("distance"))


@query("j13_new_marks")
def _(t: Tables):
    return sc.new_marks(v.points(t), v.marks(t).withColumnRenamed("mark_id", "id"), 40.0, ["label"]).select("label", "id")


@query("a7_score_marks")
def _(t: Tables):
    truth = v.points(t).withColumnRenamed("id", "truth_id").withColumn("in_scope", F.col("truth_id") % 5 != 0)
    found = v.marks(t).withColumnRenamed("mark_id", "found_id")
    return sc.score_marks(truth, found, 40.0, ["label"]).select("label", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


@query("a7_score", """WITH o AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'O'), f AS (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem WHERE l_linestatus = 'F'),
  c AS (SELECT s_suppkey AS k, (SELECT count(*) FROM f WHERE l_suppkey = s_suppkey) AS nf, (SELECT count(*) FROM o WHERE l_suppkey = s_suppkey) AS nt,
   (SELECT count(*) FROM o JOIN f USING (l_suppkey, l_partkey) WHERE l_suppkey = s_suppkey) AS tp FROM supplier)
  SELECT k AS l_suppkey, tp, nf - tp AS fp, nt - tp AS fn, round(CASE WHEN nf > 0 THEN tp / nf ELSE 0 END, 6) AS precision, round(CASE WHEN nt > 0 THEN tp / nt ELSE 0 END, 6) AS recall,
  round(CASE WHEN tp > 0 THEN 2 * tp / (nf + nt) ELSE 0 END, 6) AS f1 FROM c WHERE nf > 0""")
def _(t: Tables):
    side = lambda s: t.lineitem.filter(f"l_linestatus = '{s}'").select("l_suppkey", "l_partkey").distinct()
    n = lambda df, name: df.groupBy("l_suppkey").agg(F.count(F.lit(1)).alias(name))
    truth, found = side("O"), side("F")
    out = sc.score(truth.join(found, ["l_suppkey", "l_partkey"]), n(found, "n_found"), n(truth, "n_truth"), ["l_suppkey"])
    return out.select("l_suppkey", "tp", "fp", "fn", r6("precision"), r6("recall"), r6("f1"))


SUMMARY = """count(*) AS n, count(*) FILTER (on_target) AS on_target, round(avg(dx), 6) AS bias_dx, round(avg(dy), 6) AS bias_dy, round(avg(abs(dx)), 6) AS adx_mean, round(quantile_cont(abs(dx), 0.95), 6) AS adx_p95,
  round(max(abs(dx)), 6) AS adx_max, round(avg(abs(dy)), 6) AS ady_mean, round(quantile_cont(abs(dy), 0.95), 6) AS ady_p95, round(max(abs(dy)), 6) AS ady_max, round(avg(radial), 6) AS radial_mean,
  round(quantile_cont(radial, 0.95), 6) AS radial_p95, round(max(radial), 6) AS radial_max, count(*) FILTER (abs(dx) < 5 AND abs(dy) < 5) AS under"""


@query("a8_error_summary", f"SELECT camera, {SUMMARY} FROM {v.ERRORS} GROUP BY GROUPING SETS ((camera), ())")
def _(t: Tables):
    out = sc.error_summary(v.errors(t), ["camera"])
    return out.select("camera", "n", "on_target", "under", *[r6(c) for c in out.columns if c not in ("camera", "n", "on_target", "under")])


@query("x15_position_error", f"SELECT id, round((position_x - y_mm) * 0.2, 6) AS dx, round(-(position_y - x_mm) * 0.2, 6) AS dy, round(0.2 * sqrt((position_x - y_mm) ** 2 + (position_y - x_mm) ** 2), 6) AS radial FROM {v.HOLES}")
def _(t: Tables):
    e = geo.x_position_error(F.col("position_x"), F.col("position_y"), F.col("y_mm"), F.col("x_mm"), 0.2)
    return v.holes(t).select("id", e.alias("e")).select("id", *[F.round(f"e.{c}", 6).alias(c) for c in ("dx", "dy", "radial")])


STAGE = lambda name, e: f"SELECT '{name}' AS stage, count({e}) AS n, round(quantile_cont({e}, 0.5), 6) AS p50, round(quantile_cont({e}, 0.95), 6) AS p95, round(quantile_cont({e}, 0.99), 6) AS p99, round(max({e}), 6) AS max FROM lineitem"  # noqa: E731,E501


@query("a9_latency_summary", " UNION ALL ".join([STAGE("look", "l_extendedprice"), STAGE("inference", "l_quantity"), STAGE("registration", "CASE WHEN l_returnflag = 'N' THEN l_extendedprice * l_tax END"), STAGE("idle", "CAST(NULL AS DOUBLE)")]))
def _(t: Tables):
    rows = t.lineitem.select(F.col("l_extendedprice").alias("a"), F.col("l_quantity").alias("b"),
                             F.when(F.col("l_returnflag") == "N", F.col("l_extendedprice") * F.col("l_tax")).alias("c"), F.lit(None).cast("double").alias("d"))
    out = sc.latency_summary(rows, {"look": "a", "inference": "b", "registration": "c", "idle": "d"})
    return out.select("stage", "n", r6("p50"), r6("p95"), r6("p99"), r6("max"))


@query("a17_pool_label", """SELECT o_custkey, CASE WHEN bool_or(o_orderstatus = 'F') THEN 'REGRESSION' WHEN bool_and(o_orderstatus = 'O') THEN 'UNSEEN' ELSE 'UNLABELLED' END AS pooled FROM orders GROUP BY 1""")
def _(t: Tables):
    label = F.when(F.col("o_orderstatus") == "F", "REGRESSION").when(F.col("o_orderstatus") == "O", "UNSEEN").otherwise("UNLABELLED")
    return sc.pool_label(t.orders.withColumn("label", label), ["o_custkey"])


@query("a26_first_event", "SELECT user_id, event_type, min(ts) AS ts FROM events GROUP BY ALL")
def _(t: Tables):
    return sc.first_event(t.events, ["user_id", "event_type"], "ts")


@query("j20_event_identity", "SELECT epoch_us(ts) // 1000 AS ms, CAST(round_even(value, 0) AS BIGINT) AS x, CAST(round_even(value / 2, 0) AS BIGINT) AS y, count(*) AS n FROM events GROUP BY ALL")
def _(t: Tables):
    key = sc.event_identity(F.col("ts").cast("timestamp"), F.col("value"), F.col("value") / 2)
    return t.events.groupBy(key.alias("k")).agg(F.count(F.lit(1)).alias("n")).select(F.unix_millis("k.at").alias("ms"), "k.x", "k.y", "n")


@query("u13_hit_to_report", "SELECT o_orderkey AS truth_id, round(o_totalprice / 100 - l.arrival / 25.0, 6) AS hit_to_report FROM orders LEFT JOIN (SELECT l_orderkey, min(l_quantity) AS arrival FROM lineitem WHERE l_returnflag = 'A' GROUP BY 1) l ON l_orderkey = o_orderkey")
def _(t: Tables):
    arrivals = t.lineitem.filter("l_returnflag = 'A'").groupBy(F.col("l_orderkey").alias("truth_id")).agg(F.min("l_quantity").alias("arrival"))
    pairs = t.orders.select(F.col("o_orderkey").alias("truth_id"), (F.col("o_totalprice") / 100).alias("reported"), F.lit(25.0).alias("fps"))
    return sc.hit_to_report(pairs, arrivals, []).select("truth_id", r6("hit_to_report"))


LAT = """WITH f AS (SELECT user_id, event_id AS idx, CASE WHEN event_type <> 'error' THEN event_id + 100 END AS stamp, value * 10 AS taken, value / 100 AS wait FROM events),
  o AS (SELECT user_id, arg_min(stamp - idx, idx) FILTER (stamp IS NOT NULL) AS off FROM f GROUP BY 1),
  d AS (SELECT user_id, idx, taken, wait, value / 1000 AS look, value AS sent_at FROM f JOIN o USING (user_id) JOIN (SELECT user_id, event_id AS idx, value FROM events WHERE event_type <> 'view') USING (user_id, idx))"""


@query("j19_latency_stages", LAT + """ SELECT user_id, stage, CAST(sum(CAST(round(s * 1e5) AS BIGINT)) AS BIGINT) AS total, count(*) AS n FROM (SELECT user_id, 'sent_to_decoded' AS stage, taken - wait - sent_at AS s FROM d UNION ALL SELECT user_id, 'frame_wait', wait FROM d UNION ALL SELECT user_id, 'look_time', look FROM d
  UNION ALL SELECT user_id, 'persistence', taken + 9 - taken - look FROM d WHERE idx % 3 = 0 UNION ALL SELECT user_id, 'posted', 1.0 FROM d WHERE idx % 6 = 0
  UNION ALL SELECT user_id, 'delivered', 2.0 FROM d WHERE idx % 9 = 0 UNION ALL SELECT user_id, 'sent_to_delivered', taken + 11 - sent_at FROM d WHERE idx % 9 = 0) GROUP BY ALL""")
def _(t: Tables):
    c = F.col
    frames = t.events.select("user_id", c("event_id").alias("index"), F.when(c("event_type") != "error", c("event_id") + 100).alias("stamp"), (c("value") * 10).alias("taken"), (c("value") / 100).alias("wait"))
    sent = t.events.select("user_id", (c("event_id") + 100).alias("number"), c("value").alias("sent_at"))
    looks = t.events.filter("event_type <> 'view'").select("user_id", c("event_id").alias("index"), c("value").alias("look_ms"))
    confirmed = c("value") * 10 + 9
    holes = t.events.filter("event_id % 3 = 0").select("user_id", c("event_id").alias("first_frame"), confirmed.alias("confirmed"),
                                                       F.when(c("event_id") % 6 == 0, confirmed + 1).alias("posted"), F.when(c("event_id") % 9 == 0, confirmed + 2).alias("delivered"))
    out = sc.latency_stages(sent, frames, looks, holes, ["user_id"])
    return out.groupBy("user_id", "stage").agg(F.sum(F.round(F.col("seconds") * 1e5).cast("long")).alias("total"), F.count(F.lit(1)).alias("n"))


@query("j19_stamp_mismatches", LAT + " SELECT user_id, count(*) FILTER (stamp IS NULL OR stamp <> off + idx) AS stamp_mismatches FROM f JOIN o USING (user_id) GROUP BY 1")
def _(t: Tables):
    c = F.col
    frames = t.events.select("user_id", c("event_id").alias("index"), F.when(c("event_type") != "error", c("event_id") + 100).alias("stamp"))
    return sc.stamp_mismatches(frames, ["user_id"])


# two runs of one bench: the lines of an order under either status, a third status as the shifted control
RUN = lambda flag: f"(SELECT l_suppkey % 10 AS rec, l_orderkey AS truth, max(CASE WHEN l_discount < 0.03 THEN 'FN' WHEN l_discount > 0.09 THEN 'out of scope' ELSE 'TP' END) AS outcome, avg(l_tax) * 50 AS dx, avg(l_quantity) / 10 AS dy FROM lineitem WHERE l_returnflag = '{flag}' GROUP BY ALL)"  # noqa: E731,E501


def _run(t: Tables, flag: str):
    c = F.col
    kind = F.when(c("l_discount") < 0.03, "FN").when(c("l_discount") > 0.09, "out of scope").otherwise("TP")
    return t.lineitem.filter(c("l_returnflag") == flag).groupBy((c("l_suppkey") % 10).alias("recording"), c("l_orderkey").alias("truth")).agg(
        F.max(kind).alias("outcome"), (F.avg("l_tax") * 50).alias("dx"), (F.avg("l_quantity") / 10).alias("dy"))


U11 = f"""WITH b AS (SELECT r.rec, r.truth, r.outcome AS ro, n.outcome AS no, sqrt((r.dx - n.dx) ** 2 + (r.dy - n.dy) ** 2) AS mv, greatest(abs(n.dx), abs(n.dy)) >= 5 AS ov,
   c.outcome <> 'TP' AS xl, c.outcome = 'TP' AND sqrt((r.dx - c.dx) ** 2 + (r.dy - c.dy) ** 2) > 1 AS xm, c.outcome = 'TP' AND greatest(abs(c.dx), abs(c.dy)) >= 5 AS xo
   FROM {RUN('A')} r JOIN {RUN('N')} n USING (rec, truth) LEFT JOIN {RUN('R')} c USING (rec, truth)), s AS (SELECT *, ro = 'out of scope' OR no = 'out of scope' AS sc FROM b),
  f AS (SELECT rec, truth, 'scope' AS kind, false AS noise FROM s WHERE sc AND ro <> no UNION ALL SELECT rec, truth, 'gained', false FROM s WHERE NOT sc AND ro = 'FN' AND no = 'TP'
   UNION ALL SELECT rec, truth, 'lost', coalesce(xl, false) FROM s WHERE NOT sc AND ro = 'TP' AND no = 'FN' UNION ALL SELECT rec, truth, 'moved', coalesce(xm, false) FROM s WHERE NOT sc AND ro = 'TP' AND no = 'TP' AND mv > 1
   UNION ALL SELECT rec, truth, 'over limit', coalesce(xo, false) FROM s WHERE NOT sc AND ro = 'TP' AND no = 'TP' AND ov)"""


@query("j15_compare_truth", U11 + " SELECT rec AS recording, 'truth #' || truth AS hole, kind, noise FROM f")
def _(t: Tables):
    return sc.compare_truth(_run(t, "A"), _run(t, "N"), _run(t, "R").withColumn("shift", F.lit(8)))


@query("u11_judge_runs", U11 + " SELECT rec AS recording, NOT bool_or(kind IN ('lost', 'moved', 'over limit') AND NOT noise) AS passed FROM f GROUP BY 1")
def _(t: Tables):
    found = sc.compare_truth(_run(t, "A"), _run(t, "N"), _run(t, "R").withColumn("shift", F.lit(8)))
    return sc.passed(sc.judge_runs(found), ["recording"])


@query("u11_comparable", """SELECT coalesce(r.k, n.k) AS recording, CASE WHEN n.k IS NULL THEN 'not run' ELSE 'not comparable' END AS kind FROM (SELECT p_partkey AS k, p_type AS a, p_size % 3 AS b FROM part WHERE p_partkey % 5 <> 0) r
  FULL JOIN (SELECT p_partkey AS k, p_type AS a, p_size % 4 AS b FROM part WHERE p_partkey % 7 <> 0) n ON r.k = n.k WHERE r.k IS NULL OR n.k IS NULL OR r.b <> n.b""")
def _(t: Tables):
    side = lambda skip, mod: t.part.filter(F.col("p_partkey") % skip != 0).select(F.col("p_partkey").alias("recording"), F.col("p_type").alias("unit"), (F.col("p_size") % mod).alias("stride"))
    return sc.comparable(side(5, 3), side(7, 4), ["unit", "stride"]).select("recording", "kind")


@query("u11_false_positives")
def _(t: Tables):
    pts = v.points(t).select(F.col("label").alias("recording"), F.col("id").alias("found"), "x", "y")
    later = v.marks(t).select(F.col("label").alias("recording"), F.col("mark_id").alias("found"), "x", "y")
    return sc.compare_false_positives(pts.filter("found % 3 = 0"), later.filter("found % 2 = 0"), pts.filter("found % 3 = 1"))


@query("u12_compare_moved", f"""SELECT rec, truth, round(n.dx - r.dx, 6) AS moved_x, round(n.dy - r.dy, 6) AS moved_y, n.truth IS NULL AS dropped FROM {RUN('A')} r LEFT JOIN {RUN('N')} n USING (rec, truth)""".replace("n.truth IS NULL", "n.outcome IS NULL"))
def _(t: Tables):
    seen = lambda flag: _run(t, flag).withColumnRenamed("recording", "rec").withColumn("seen_at", F.col("dy"))
    out = sc.compare_moved(seen("A"), seen("N"), seen("A").select("rec", "truth"), ["rec"])
    return out.select("rec", "truth", r6("moved_x"), r6("moved_y"), "dropped")


BOX = "(SELECT l_orderkey, l_linenumber, l_quantity AS ax, l_tax * 100 AS ay, 10.0 + l_linenumber AS aw, 8.0 AS ah, l_discount * 300 AS bx, l_linenumber * 2.0 AS by_, 9.0 AS bw, 12.0 AS bh FROM lineitem)"
OVER = "greatest(least(ax + aw / 2, bx + bw / 2) - greatest(ax - aw / 2, bx - bw / 2), 0) * greatest(least(ay + ah / 2, by_ + bh / 2) - greatest(ay - ah / 2, by_ - bh / 2), 0) / least(aw * ah, bw * bh)"
DIST = "sqrt((ax - bx) ** 2 + (ay - by_) ** 2)"


@query("x17_x18_same_mark", f"SELECT l_orderkey, l_linenumber, round({OVER}, 6) AS overlap, {DIST} < 3 OR {OVER} > 0.5 OR {DIST} < 0.5 * (sqrt(aw * aw + ah * ah) + sqrt(bw * bw + bh * bh)) / 2 AS same FROM {BOX}")
def _(t: Tables):
    c = F.col
    box = lambda *e: F.struct(*[x.cast("double").alias(n) for n, x in zip(("cx", "cy", "w", "h"), e)])
    a = box(c("l_quantity"), c("l_tax") * 100, c("l_linenumber") + 10.0, F.lit(8.0))
    b = box(c("l_discount") * 300, c("l_linenumber") * 2.0, F.lit(9.0), F.lit(12.0))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(geo.x_overlap(a, b), 6).alias("overlap"), geo.x_same_mark(a, b, 3.0).alias("same"))


@query("x19_scaled_tolerance", "SELECT p_partkey, round(40.0 * p_size / p_retailprice, 6) AS tolerance FROM part")
def _(t: Tables):
    return t.part.select("p_partkey", F.round(geo.x_scaled_tolerance(40, F.col("p_size"), F.col("p_retailprice")), 6).alias("tolerance"))


# the same with a board key that is null for one board: points of label 0
def _boards(df):
    return df.withColumn("board", F.when(F.col("label") != 0, F.col("label").cast("string"))).drop("label")


@query("j8_pairs_by_board", f"SELECT id, mark_id, round(d, 6) AS distance FROM {PAIRS} WHERE d <= 60")
def _(t: Tables):
    return sp.distance_join(_boards(v.points(t)), _boards(v.marks(t)), 60.0, ["board"]).select("id", "mark_id", r6("distance"))


@query("j9_nearest_by_board", f"SELECT id, arg_min(mark_id, (d, mark_id)) FILTER (d <= 50) AS mark_id, round(min(d) FILTER (d <= 50), 6) AS distance FROM {PAIRS} GROUP BY id")
def _(t: Tables):
    return sp.nearest(_boards(v.points(t)), _boards(v.marks(t)), ["board"], 50.0, "mark_id").select("id", "mark_id", r6("distance"))


@query("j10_survivors_by_board", f"SELECT id FROM {STRIP} WHERE d >= 60")
def _(t: Tables):
    return sp.strip_known(_boards(v.points(t)), _boards(v.marks(t)), 60.0, ["board"])[0].select("id")


@query("g1_groups_by_board", SQL["g1_label_groups"])
def _(t: Tables):
    return sp.label_groups(_boards(v.points(t)), ["board"], 40.0).select("id", "group_id")


@query("u14_carry_by_board", f"SELECT CASE WHEN label <> 0 THEN CAST(label AS VARCHAR) END AS board, dx, dy, agreeing FROM ({SQL['u14_carry_points']})")
def _(t: Tables):
    return sp.carry_points(_boards(v.points(t)), _boards(v.marks(t)), ["board"]).select("board", r6("dx"), r6("dy"), "agreeing")


def _keyed(df, by: str):
    return df.withColumn("board", F.when(F.col(by) % 3 != 0, F.col(by) % 3))


@query("f11_rect_by_board", f"""SELECT id, coalesce(min(idx), -1) AS sheet FROM (SELECT id, position_x AS x, position_y AS y FROM {v.HOLES}) LEFT JOIN {RECTS} ON id % 3 = idx % 3 AND x BETWEEN x0 AND x1 AND y BETWEEN y0 AND y1 GROUP BY id""")
def _(t: Tables):
    pts = _keyed(v.holes(t).select("id", F.col("position_x").alias("x"), F.col("position_y").alias("y")), "id")
    return filters.assign_rect(pts, _keyed(_rects(t), "idx"), ["board"]).select("id", "sheet")


@query("f12_polygon_by_board", f"""SELECT id, min(idx) AS target_index FROM (SELECT id, position_x AS x, position_y AS y FROM {v.HOLES}) LEFT JOIN {RECTS}
  ON id % 3 = idx % 3 AND abs(x - x0 - 140) / 140 + abs(y - y0 - 50) / 50 <= 1 GROUP BY id""")
def _(t: Tables):
    corner = lambda x, y: F.struct((F.col("x0") + x).cast("double").alias("x"), (F.col("y0") + y).cast("double").alias("y"))
    shapes = _keyed(_rects(t), "idx").select("idx", "board", F.array(corner(140, 0), corner(280, 50), corner(140, 100), corner(0, 50)).alias("outline"))
    pts = _keyed(v.holes(t).select("id", F.col("position_x").alias("x"), F.col("position_y").alias("y")), "id")
    return filters.assign_polygon(pts, shapes, ["board"]).select("id", "target_index")

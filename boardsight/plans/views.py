"""The given tables read as the data model: customers as sessions, orders as
holes, events as looks and signals, embeddings as points. Each view comes with
its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from boardsight.core.ordered import Ordered
from boardsight.plans.registry import Tables

US = "epoch_us"


def sessions(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name"),
        F.when(F.col("c_acctbal") < 0, "active").otherwise("completed").alias("status"),
        F.col("c_acctbal").alias("created_at"), F.concat(F.lit("Cam"), F.col("c_nationkey").cast("string")).alias("own_alias"),
        (F.col("c_nationkey") % 7).alias("camera_id"))


SESSIONS = """(SELECT c_custkey AS id, c_name AS name, CASE WHEN c_acctbal < 0 THEN 'active' ELSE 'completed' END AS status,
  c_acctbal AS created_at, 'Cam' || c_nationkey AS own_alias, c_nationkey % 7 AS camera_id FROM customer)"""


def holes(t: Tables) -> DataFrame:
    c = F.col
    return t.orders.select(
        c("o_orderkey").alias("id"), c("o_custkey").alias("session_id"),
        F.when(c("o_orderpriority") != "4-NOT SPECIFIED", c("o_orderpriority")).alias("camera_alias"),
        c("o_orderdate").alias("first_seen_at"), c("o_orderdate").alias("created_at"),
        (c("o_totalprice") % 1700 - 100).alias("position_x"), (c("o_totalprice") % 1301).alias("position_y"),
        F.when(c("o_orderkey") % 5 != 0, (c("o_orderkey") % 3).cast("int")).alias("target_index"),
        F.when(c("o_orderkey") % 7 != 0, c("o_totalprice") % 97).alias("x_mm"),
        F.when(c("o_orderkey") % 7 != 0, c("o_totalprice") % 89).alias("y_mm"),
        F.when(c("o_orderstatus") == "F", "manual").otherwise("model").alias("source"),
        F.when(c("o_orderkey") % 4 != 0, F.concat(F.lit("k"), (c("o_orderkey") % 50).cast("string"))).alias("idempotency_key"),
        F.when(c("o_orderstatus") == "P", c("o_orderdate")).alias("deleted_at"))


HOLES = """(SELECT o_orderkey AS id, o_custkey AS session_id,
  CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN o_orderpriority END AS camera_alias,
  o_orderdate AS first_seen_at, o_orderdate AS created_at,
  o_totalprice % 1700 - 100 AS position_x, o_totalprice % 1301 AS position_y,
  CASE WHEN o_orderkey % 5 <> 0 THEN CAST(o_orderkey % 3 AS INT) END AS target_index,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice % 97 END AS x_mm,
  CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice % 89 END AS y_mm,
  CASE WHEN o_orderstatus = 'F' THEN 'manual' ELSE 'model' END AS source,
  CASE WHEN o_orderkey % 4 <> 0 THEN 'k' || (o_orderkey % 50) END AS idempotency_key,
  CASE WHEN o_orderstatus = 'P' THEN o_orderdate END AS deleted_at FROM orders)"""


def cameras(t: Tables) -> DataFrame:
    return t.nation.select((F.col("n_nationkey") % 7).alias("id"), F.col("n_nationkey").alias("pos"),
                           F.concat(F.lit("Cam"), F.col("n_nationkey").cast("string")).alias("alias"),
                           (F.col("n_regionkey") % 2 == 0).alias("enabled"))


CAMERAS = """(SELECT n_nationkey % 7 AS id, n_nationkey AS pos, 'Cam' || n_nationkey AS alias, n_regionkey % 2 = 0 AS enabled FROM nation)"""


def signals(t: Tables) -> DataFrame:
    """Events as motion signals."""
    c = F.col
    return t.events.select(
        c("event_id"), c("ts").alias("timestamp"), c("event_type").alias("description"),
        c("event_type").isin("click", "view").alias("isCmd"), (c("user_id") % 4).cast("int").alias("axis"),
        F.when(c("event_type") == "purchase", F.lit(float("nan"))).otherwise(c("value")).alias("value"))


def looks(t: Tables) -> DataFrame:
    """Events as looks: per user in time order, an error being a lost one. One
    detection a look, at a place the value decides."""
    c = F.col
    rows = Ordered(t.events, ["user_id"], ["ts", "event_id"]).row_number("frame").done()
    spot = F.floor(c("value") / 20)
    box = F.struct((spot * 40.0 + c("value") % 3).alias("cx"), (spot % 4 * 55.0).alias("cy"), F.lit(12.0).alias("w"), F.lit(12.0).alias("h"))
    return rows.select(
        "user_id", (c("frame") - 1).alias("frame"), F.when(c("event_type") == "error", "lost").otherwise("registered").alias("status"),
        "event_type", "value", "ts", "event_id", spot.alias("spot"),
        F.when(c("event_type") == "click", F.array()).otherwise(F.array(box)).alias("detections"))


LOOKS = """(SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame,
  CASE WHEN event_type = 'error' THEN 'lost' ELSE 'registered' END AS status, event_type, value, ts, event_id,
  CAST(floor(value / 20) AS BIGINT) AS spot FROM events)"""


def tracks(t: Tables) -> DataFrame:
    """Given sightings: of a look that saw something, the mark its value names."""
    seen = looks(t).filter("status = 'registered' and event_type <> 'click'")
    firsts = seen.groupBy("user_id", "spot").agg(F.min("frame").alias("first"))
    return seen.join(firsts, ["user_id", "spot"]).select("user_id", F.col("spot").cast("string").alias("cand_id"), "frame", "first")


TRACKS = f"""(SELECT user_id, CAST(spot AS VARCHAR) AS cand_id, frame, min(frame) OVER (PARTITION BY user_id, spot) AS first
  FROM {LOOKS} WHERE status = 'registered' AND event_type <> 'click')"""


def points(t: Tables) -> DataFrame:
    c = F.col
    return t.embeddings.select(c("vec_id").alias("id"), "label", (c("embedding")[0].cast("double") * 1000).alias("x"),
                               (c("embedding")[1].cast("double") * 1000).alias("y"))


POINTS = """(SELECT vec_id AS id, label, CAST(embedding[1] AS DOUBLE) * 1000 AS x, CAST(embedding[2] AS DOUBLE) * 1000 AS y FROM embeddings)"""


def marks(t: Tables) -> DataFrame:
    """Other points of the same plane."""
    c = F.col
    return t.embeddings.select(c("vec_id").alias("mark_id"), "label", (c("embedding")[2].cast("double") * 1000).alias("x"),
                               (c("embedding")[3].cast("double") * 1000).alias("y"))


MARKS = """(SELECT vec_id AS mark_id, label, CAST(embedding[3] AS DOUBLE) * 1000 AS x, CAST(embedding[4] AS DOUBLE) * 1000 AS y FROM embeddings)"""


def errors(t: Tables) -> DataFrame:
    """Position errors of matched pairs."""
    c = F.col
    return t.lineitem.select(
        c("l_linestatus").alias("camera"), (c("l_returnflag") == "A").alias("on_target"),
        ((c("l_quantity") - 25) / 5).alias("dx"), ((c("l_discount") - 0.05) * 100).alias("dy")).withColumn("radial", F.hypot("dx", "dy"))


ERRORS = """(SELECT camera, on_target, dx, dy, sqrt(dx*dx + dy*dy) AS radial FROM (SELECT l_linestatus AS camera, l_returnflag = 'A' AS on_target,
  (l_quantity - 25) / 5 AS dx, (l_discount - 0.05) * 100 AS dy FROM lineitem))"""


def splits(t: Tables) -> DataFrame:
    """Vectors with a split and two 64-bit hashes: which values are high, and
    which are low."""
    e = F.col("embedding")
    bits = lambda test: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
                                    lambda a, i: a.bitwiseOR(F.when(test(i), F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))))
    return t.embeddings.select(
        "vec_id", "embedding", F.when(F.col("label") < 7, "train").when(F.col("label") < 9, "valid").otherwise("test").alias("split"),
        bits(lambda i: F.get(e, i) > 0.15).alias("h1"), bits(lambda i: F.get(e, i) < -0.15).alias("h2"))

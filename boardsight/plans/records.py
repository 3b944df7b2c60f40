"""Queries over logs, labels, manifests, files and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from boardsight.functions import signals as fn
from boardsight.operators import quality as q
from boardsight.plans import views as v
from boardsight.plans.registry import Tables, query
from boardsight.sources import files

r6 = lambda c: F.round(c, 6).alias(c)


def log_lines(t: Tables):
    """Events as JSON lines of a service, some blank, broken or bare."""
    c = F.col
    known = F.struct(F.date_format(c("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSXXX").alias("time"), F.element_at(fn.literal_map({
        "click": "info", "view": "debug", "purchase": "warning", "signup": "critical", "error": "odd"}), c("event_type")).alias("level"),
        F.lit("backend").alias("service"), F.concat(F.lit("Event "), c("event_type")).alias("message"), c("user_id").alias("user"))
    bare = F.to_json(F.struct(F.concat(F.lit("bare "), c("event_id").cast("string")).alias("message")))
    line = (F.when(c("event_id") % 11 == 0, "   ").when(c("event_id") % 13 == 0, F.lit('{"message": "cut'))
            .when(c("event_id") % 17 == 0, F.lit('{"message": 5}')).when(c("event_id") % 7 == 0, bare).otherwise(F.to_json(known)))
    return t.events.select("event_id", line.alias("value"))


GOOD = "event_id % 11 <> 0 AND event_id % 13 <> 0 AND event_id % 17 <> 0"
LEVEL = "CASE WHEN event_id % 7 = 0 THEN 'info' ELSE CASE event_type WHEN 'click' THEN 'info' WHEN 'view' THEN 'debug' WHEN 'purchase' THEN 'warning' WHEN 'signup' THEN 'critical' ELSE 'odd' END END"


@query("s7_parse_logs", f"""SELECT event_id, {LEVEL} AS level, CASE WHEN event_id % 7 = 0 THEN 'unknown' ELSE 'backend' END AS service, CASE WHEN event_id % 7 = 0 THEN 'bare ' || event_id ELSE 'Event ' || event_type END AS message,
  CASE WHEN event_id % 7 <> 0 THEN CAST(user_id AS VARCHAR) END AS "user" FROM events WHERE {GOOD}""")
def _(t: Tables):
    logs = files.parse_logs(log_lines(t))
    return logs.select("event_id", "level", "service", "message", F.try_element_at("fields", F.lit("user")).alias("user"))


@query("f5_search_logs", f"""SELECT event_id FROM events WHERE {GOOD} AND event_id % 7 <> 0 AND event_type IN ('purchase', 'signup', 'error') AND contains(lower('Event ' || event_type || '  {{"user":"' || user_id || '"}}'), 'p')""")
def _(t: Tables):
    return files.search_logs(files.parse_logs(log_lines(t)), "warning", "backend", " P ").select("event_id")


@query("l7_newest_logs", f"SELECT event_id FROM events WHERE {GOOD} AND event_id % 7 <> 0 ORDER BY epoch_us(ts) // 1000 DESC LIMIT 500")
def _(t: Tables):
    return files.newest_logs(files.parse_logs(log_lines(t)), 500).select("event_id")


@query("d7_merge_logs", f"SELECT count(*) AS n, count(DISTINCT event_id) AS distinct_n FROM (SELECT event_id FROM events WHERE {GOOD} UNION ALL SELECT event_id FROM events WHERE {GOOD} AND event_id % 7 <> 0)")
def _(t: Tables):
    logs = files.parse_logs(log_lines(t))
    both = files.merge_logs(logs, logs.filter("service = 'backend'").drop("fields"))
    return both.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("distinct_n"))


def label_lines(t: Tables):
    """Lines as label text: boxes, polygons, and damaged ones."""
    c = lambda *n: F.concat_ws(" ", *[F.col(x).cast("string") for x in n])
    box = c("l_linenumber", "l_discount", "l_tax", "l_quantity", "l_quantity")
    line = (F.when(F.col("l_linenumber") == 3, c("l_linenumber", "l_discount", "l_tax", "l_quantity", "l_tax", "l_discount", "l_discount"))
            .when(F.col("l_linenumber") == 5, c("l_linenumber", "l_discount", "l_tax", "l_quantity", "l_tax", "l_quantity"))
            .when(F.col("l_linenumber") == 6, c("l_linenumber", "l_discount")).otherwise(box))
    return t.lineitem.select("l_orderkey", "l_linenumber", line.alias("value"))


@query("s8_parse_labels", """SELECT l_orderkey, l_linenumber, l_linenumber IN (5, 6) AS damaged, round(CASE l_linenumber WHEN 3 THEN (l_discount + l_quantity + l_discount) / 3 WHEN 5 THEN (l_discount + l_quantity) / 2 WHEN 6 THEN NULL ELSE l_discount END, 6) AS x,
  round(CASE l_linenumber WHEN 3 THEN (l_tax + l_tax + l_discount) / 3 WHEN 5 THEN (l_tax + l_tax) / 2 WHEN 6 THEN NULL ELSE l_tax END, 6) AS y FROM lineitem""")
def _(t: Tables):
    return files.parse_labels(label_lines(t)).select("l_orderkey", "l_linenumber", "damaged", r6("x"), r6("y"))


@query("s8_label_damage", "SELECT l_orderkey, count(*) FILTER (l_linenumber <> 6) AS labels, count(*) FILTER (l_linenumber IN (5, 6)) AS damaged FROM lineitem GROUP BY 1")
def _(t: Tables):
    return files.label_damage(files.parse_labels(label_lines(t)), ["l_orderkey"])


@query("s9_strict_labels", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber IN (5, 6))")
def _(t: Tables):
    return files.strict_labels(files.parse_labels(label_lines(t)), "l_orderkey")[0].select("l_orderkey", "l_linenumber")


@query("s9_refused_files", "SELECT l_orderkey, count(*) AS damaged_lines FROM lineitem WHERE l_linenumber IN (5, 6) GROUP BY 1")
def _(t: Tables):
    return files.strict_labels(files.parse_labels(label_lines(t)), "l_orderkey")[1]


def manifest_lines(t: Tables):
    """One manifest of one entry a line, keyed by the hash of the part's name."""
    c = F.col
    entry = F.struct(F.concat(c("p_name"), F.lit(".mkv")).alias("file"), c("p_brand").alias("capture_setup"), c("p_size").cast("double").alias("fps"),
                     F.array(F.lit(0.0), c("p_retailprice")).alias("window"), (c("p_size") % 4 == 0).alias("never_trained"))
    return t.part.select(F.to_json(F.create_map(F.sha2(c("p_partkey").cast("string"), 256), entry)).alias("value"))


@query("s10_parse_manifest", "SELECT sha256(CAST(p_partkey AS VARCHAR)) AS sha256, p_name || '.mkv' AS file, p_brand AS capture_setup, CAST(p_size AS DOUBLE) AS fps, round(p_retailprice, 6) AS until FROM part")
def _(t: Tables):
    return files.parse_manifest(manifest_lines(t)).select("sha256", "file", "capture_setup", "fps", F.round(F.col("window")[1], 6).alias("until"))


@query("s10_with_setup", "SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 2 = 0 THEN p_brand END AS capture_setup FROM lineitem JOIN part ON p_partkey = l_partkey")
def _(t: Tables):
    listed = t.lineitem.select("l_orderkey", "l_linenumber", F.sha2(F.when(F.col("l_partkey") % 2 == 0, F.col("l_partkey")).otherwise(-1).cast("string"), 256).alias("sha256"))
    return files.with_setup(listed, files.parse_manifest(manifest_lines(t))).select("l_orderkey", "l_linenumber", "capture_setup")


@query("f14_trainable", "SELECT l_orderkey, l_linenumber FROM lineitem JOIN part ON p_partkey = l_partkey WHERE p_size % 4 <> 0")
def _(t: Tables):
    listed = t.lineitem.select("l_orderkey", "l_linenumber", F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"))
    return files.trainable(listed, files.parse_manifest(manifest_lines(t))).select("l_orderkey", "l_linenumber")


@query("d8_fingerprint", """SELECT lang, sha256(string_agg(h, chr(10) ORDER BY c)) AS fingerprint FROM (SELECT lang, i // 10000 AS c, sha256(string_agg(name || ':' || sha256(text), chr(10) ORDER BY i)) AS h
  FROM (SELECT lang, 'd' || lpad(CAST(doc_id AS VARCHAR), 9, '0') AS name, text, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM documents WHERE source <> 'web') GROUP BY ALL) GROUP BY lang""")
def _(t: Tables):
    named = t.documents.select("lang", F.when(F.col("source") == "web", ".hidden").otherwise(F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 9, "0"))).alias("name"), F.col("text").alias("content"))
    return files.fingerprint(named, ["board.arrival.txt"], ["lang"])


@query("d8_truth_hash", """SELECT lang, sha256(string_agg(name || chr(0) || text || chr(0), '' ORDER BY photo, name)) AS truth_hash FROM
  (SELECT lang, 'd' || doc_id AS name, coalesce(text, '') AS text, CASE WHEN source = 'src5' THEN doc_id ELSE -1 END AS photo FROM documents WHERE source NOT IN ('src3', 'src4')) GROUP BY lang""")
def _(t: Tables):
    c = F.col
    named = t.documents.select("lang", F.when(c("source") == "src3", ".hidden").when(c("source") == "src4", "board.arrival.txt").otherwise(F.concat(F.lit("d"), c("doc_id").cast("string"))).alias("name"),
                               c("text").alias("content"), F.when(c("source") == "src5", c("doc_id")).alias("photo"))
    return files.truth_hash(named, ["board.arrival.txt"], ["lang"], photograph="photo")


MAD = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda p: abs(CAST(p[1] AS DOUBLE) - CAST(p[2] AS DOUBLE)))) / 64"


@query("d9_near_duplicate_pairs", f"SELECT a.vec_id AS a, b.vec_id AS b, round({MAD}, 6) AS mad FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {MAD} < 0.1")
def _(t: Tables):
    return q.near_duplicate_pairs(t.embeddings, "vec_id", "embedding", 0.1).select("a", "b", r6("mad"))


@query("d9_near_duplicates", f"""WITH RECURSIVE e AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS i FROM embeddings),
  near AS (SELECT b.label, b.i, list(a.i) AS before FROM e a JOIN e b ON a.label IS NOT DISTINCT FROM b.label AND a.i < b.i WHERE {MAD} < 0.1 GROUP BY ALL),
  r AS (SELECT label, i, [i] AS kept FROM e WHERE i = 1 UNION ALL
    SELECT e.label, e.i, CASE WHEN len(list_intersect(r.kept, coalesce(near.before, []))) > 0 THEN r.kept ELSE list_append(r.kept, e.i) END
    FROM r JOIN e ON e.label IS NOT DISTINCT FROM r.label AND e.i = r.i + 1 LEFT JOIN near ON near.label IS NOT DISTINCT FROM e.label AND near.i = e.i),
  k AS (SELECT label, unnest(kept) AS i FROM r QUALIFY row_number() OVER (PARTITION BY label ORDER BY r.i DESC) = 1)
  SELECT vec_id, e.label FROM e JOIN k ON e.label IS NOT DISTINCT FROM k.label AND e.i = k.i""")
def _(t: Tables):
    return q.near_duplicates(t.embeddings, "embedding", 0.1, ["label"], "vec_id").select("vec_id", "label")


SPLIT = "(SELECT *, CASE WHEN label < 7 THEN 'train' WHEN label < 9 THEN 'valid' ELSE 'test' END AS split FROM embeddings)"
HAM = """len(list_filter(list_zip(a.embedding, b.embedding), lambda p: (p[1] > 0.15) <> (p[2] > 0.15))) <= 6 AND len(list_filter(list_zip(a.embedding, b.embedding), lambda p: (p[1] < -0.15) <> (p[2] < -0.15))) <= 6"""
LEAK = f"(SELECT a.split AS ga, b.split AS gb, a.vec_id AS ia, b.vec_id AS ib FROM {SPLIT} a JOIN {SPLIT} b ON a.split < b.split WHERE {HAM})"


@query("d10_split_leakage", f"SELECT ga, gb, count(*) AS pairs FROM {LEAK} GROUP BY ALL")
def _(t: Tables):
    return q.split_leakage(v.splits(t))


@query("d10_leaked_share", f"""SELECT split, count(*) AS rows, count(*) FILTER (vec_id IN (SELECT ia FROM {LEAK} WHERE gb = 'train' UNION ALL SELECT ib FROM {LEAK} WHERE ga = 'train')) AS leaked FROM {SPLIT} WHERE split <> 'train' GROUP BY 1""")
def _(t: Tables):
    return q.leaked_share(v.splits(t)).select("split", "rows", "leaked")


FRAMES = "(SELECT l_suppkey AS clip, l_orderkey AS frame, CASE WHEN l_linenumber < 5 THEN 'train' WHEN l_linenumber = 5 THEN 'valid' ELSE 'test' END AS split FROM lineitem)"


@query("d11_nearest_train_frame", f"""SELECT f.clip, f.frame, f.split, least(f.frame - p.frame, n.frame - f.frame) AS distance FROM (SELECT * FROM {FRAMES} WHERE split <> 'train') f
  ASOF LEFT JOIN (SELECT * FROM {FRAMES} WHERE split = 'train') p ON p.clip = f.clip AND p.frame <= f.frame ASOF LEFT JOIN (SELECT * FROM {FRAMES} WHERE split = 'train') n ON n.clip = f.clip AND n.frame >= f.frame""")
def _(t: Tables):
    return q.nearest_train_frame(_frames(t)).select("clip", "frame", "split", "distance")


def _frames(t: Tables):
    split = F.when(F.col("l_linenumber") < 5, "train").when(F.col("l_linenumber") == 5, "valid").otherwise("test")
    return t.lineitem.select(F.col("l_suppkey").alias("clip"), F.col("l_orderkey").alias("frame"), split.alias("split"))


@query("d11_distance_histogram", f"""SELECT split, CASE WHEN d IS NULL THEN 'no train frames' WHEN d > 10 THEN '>10' ELSE CAST(d AS VARCHAR) END AS bucket, count(*) AS frames FROM (SELECT f.split, least(f.frame - p.frame, n.frame - f.frame) AS d FROM (SELECT * FROM {FRAMES} WHERE split <> 'train') f
  ASOF LEFT JOIN (SELECT * FROM {FRAMES} WHERE split = 'train') p ON p.clip = f.clip AND p.frame <= f.frame ASOF LEFT JOIN (SELECT * FROM {FRAMES} WHERE split = 'train') n ON n.clip = f.clip AND n.frame >= f.frame) GROUP BY ALL""")
def _(t: Tables):
    return q.distance_histogram(q.nearest_train_frame(_frames(t)))


@query("d12_group_split", """SELECT o_orderkey, CASE WHEN h < 8 THEN 'train' WHEN h < 9 THEN 'valid' ELSE 'test' END AS split FROM (SELECT o_orderkey, CAST('0x' || substr(md5(CAST(o_custkey AS VARCHAR)), 1, 8) AS BIGINT) % 10 AS h FROM orders)""")
def _(t: Tables):
    return q.group_split(t.orders, "o_custkey", {"train": 8, "valid": 1, "test": 1}).select("o_orderkey", "split")


@query("a22_audit_splits", """SELECT split, images, boxes, round(boxes / images, 6) AS boxes_per_image, round(share_A, 6) AS "share_A", round(share_N, 6) AS "share_N", bad_degenerate, bad_tiny, bad_outside FROM (SELECT split, count(DISTINCT l_orderkey) AS images, count(*) AS boxes,
   count(*) FILTER (l_returnflag = 'A') / count(*) AS share_A, count(*) FILTER (l_returnflag = 'N') / count(*) AS share_N, count(*) FILTER (w <= 0 OR h <= 0) AS bad_degenerate, count(*) FILTER (w * h < 4) AS bad_tiny, count(*) FILTER (l_quantity + w > 55) AS bad_outside
   FROM (SELECT *, l_linestatus AS split, l_linenumber - 2 AS w, l_linenumber AS h FROM lineitem) GROUP BY split)""")
def _(t: Tables):
    c = F.col
    boxes = t.lineitem.select(c("l_linestatus").alias("split"), c("l_returnflag").alias("class"), c("l_quantity").alias("x"), F.lit(0.0).alias("y"), (c("l_linenumber") - 2).alias("w"), c("l_linenumber").alias("h"),
                              F.lit(55).alias("width"), F.lit(100).alias("height"), F.lit(1.0).alias("area"))
    images = t.lineitem.select(c("l_linestatus").alias("split"), "l_orderkey").distinct()
    out = q.audit_splits(boxes, images, ["A", "N"], q.box_rules("width", "height", ["A", "N", "R"]))
    return out.select("split", "images", "boxes", r6("boxes_per_image"), r6("share_A"), r6("share_N"), "bad_degenerate", "bad_tiny", "bad_outside")

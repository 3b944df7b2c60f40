"""Results do not depend on which path a key's size takes."""

import itertools
import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from boardsight.core import ordered
from boardsight.core.ordered import Ordered
from boardsight.core.percentiles import percentiles
from boardsight.operators import quality, spatial, tracking
from boardsight.plans import views
from boardsight.plans.registry import Tables
from boardsight.sources import files, packets


def skewed(events):
    """A third of all rows under one key, one value on a third of them."""
    hot = F.when(F.col("event_id") % 3 == 0, 0).otherwise(F.col("user_id") + 1)
    return events.withColumn("k", hot).withColumn("value", F.when(F.col("event_id") % 3 == 1, 5.0).otherwise(F.col("value")))


def test_ordered_windows_agree(events):
    def build(n):
        o = Ordered(skewed(events), ["k"], ["ts", "event_id"], n).lag(p="value").lead(q="event_id").row_number("rn")
        o = o.running_sum("s", F.lit(1)).running_max("m", F.col("event_id") % 17)
        return o.last_known("l", F.when(F.col("event_id") % 5 == 0, F.col("event_id"))).done()
    plain = build(10 ** 9)
    cut = build(60).select(plain.columns)
    assert sorted(map(str, plain.collect())) == sorted(map(str, cut.collect()))


def test_percentiles_agree(events):
    rows = skewed(events)
    get = lambda n: {r.k: (round(r.p50, 9), round(r.p95, 9)) for r in percentiles(rows, ["k"], "value", {"p50": 0.5, "p95": 0.95}, n).collect()}
    assert get(10 ** 9) == get(50)


def test_throttle_agrees(events):
    rows = skewed(events).select("k", "event_id", "ts")
    get = lambda n: sorted(r.event_id for r in tracking.throttle(rows, ["k"], "ts", 3_600_000, ["event_id"], n).collect())
    assert get(10 ** 9) == get(120)


def test_dense_cells_agree(spark):
    t = Tables(spark, "/root/testdata/sf0.001")
    pts, marks = views.points(t), views.marks(t)
    for r in (None, 60.0):
        get = lambda n: {x.id: (x.mark_id, x.distance) for x in spatial.nearest(pts, marks, [], r, "mark_id", dense_cell=n).collect()}  # noqa: E731,B023
        assert get(10 ** 6) == get(4)


def test_search_descends_without_writing_places(spark, monkeypatch):
    t = Tables(spark, "/root/testdata/sf0.001")
    pts, marks = views.points(t).withColumn("label", F.when(F.col("label") != 0, F.col("label"))), views.marks(t)
    marks = marks.withColumn("label", F.when(F.col("label") != 0, F.col("label")))
    written = []
    monkeypatch.setattr(spatial, "cut", lambda df, real=spatial.cut: written.append(df.columns) or real(df))
    got = {r.id: (r.mark_id, r.distance) for r in spatial.nearest(pts, marks, ["label"], None, "mark_id", dense_cell=2).collect()}
    assert written == [["label", "mx", "my", "_mid"]]
    spots = marks.collect()
    for p in pts.collect():
        near = min((math.hypot(p.x - m.x, p.y - m.y), m.mark_id) for m in spots if m.label == p.label)
        assert got[p.id][0] == near[1] and abs(got[p.id][1] - near[0]) < 1e-9


def test_spread_is_exact(spark):
    rows = views.points(Tables(spark, "/root/testdata/sf0.001"))
    got = {r.label: r.extreme_spread for r in spatial.spread(rows, ["label"], few=4).collect()}
    by = {}
    for r in rows.collect():
        by.setdefault(r.label, []).append((r.x, r.y))
    for label, pts in by.items():
        want = max((math.dist(a, b) for a, b in itertools.combinations(pts, 2)), default=None)
        assert got[label] == want or abs(got[label] - want) < 1e-9


def test_capture_files(spark, tmp_path):
    import struct
    tcp = bytes.fromhex("00" * 12 + "0800" + "45000000" + "00000000" + "40060000" + "0a000001" + "0a000002") + struct.pack(">HHIIBBHHH", 5000, 4949, 7, 0, 0x50, 0, 0, 0, 0)
    body = bytes.fromhex("AA550000020131") + struct.pack(">f", 1.5) + b"\xff"
    packet = tcp + body
    head = struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 65535, 1)
    record = lambda p, t: struct.pack("<IIII", t, 250, len(p), len(p)) + p
    (tmp_path / "a.pcap").write_bytes(head + record(packet, 10) + record(tcp, 11))
    got = packets.read_packets(spark, str(tmp_path / "*.pcap"))
    row = got.first()
    assert got.count() == 1 and (row.src_ip, row.dst_port, row.seq) == ("10.0.0.1", 4949, 7)
    motion = packets.decode_motion(packets.read_captures(spark, str(tmp_path / "*.pcap")))[0].first()
    assert (motion.description, motion.value, motion.axis, motion.isCmd) == ("MOT_SetSpeed", 1.5, 2, True)
    (tmp_path / "b.pcap").write_bytes(head + record(packet, 10) + record(packet, 11)[:-3])
    (tmp_path / "c.pcap").write_bytes(b"not a capture")
    refused = {r.path.rsplit("/")[-1]: (r.n, r.reason) for r in packets.refused_captures(spark, str(tmp_path / "*.pcap")).collect()}
    assert refused == {"b.pcap": (1, "cut off"), "c.pcap": (0, "unknown kind of file")}
    assert packets.read_captures(spark, str(tmp_path / "*.pcap")).count() == 3


def test_timing_and_log_files(spark, tmp_path):
    (tmp_path / "t.csv").write_text("# made by hand\nframe,registered,look_ms,inference_ms\n1,1,10.5,\n2,1,11.5,4\n")
    rows = files.read_timing(spark, str(tmp_path / "t.csv"), ["frame", "registered", "look_ms", "inference_ms"]).orderBy("frame").collect()
    assert [r.inference_ms for r in rows] == [None, 4.0]
    (tmp_path / "backend.log").write_text('{"time":"2024-01-01T00:00:01+00:00","level":"error","service":"backend","message":"b","n":1}\n\nnot json\n{"x":1}\n')
    (tmp_path / "frontend.log").write_text('{"time":"2024-01-01T00:00:02Z","message":"bare"}\n')
    logs = files.newest_logs(files.read_logs(spark, str(tmp_path / "*.log")), 5).collect()
    assert [(r.message, r.level, r.service) for r in logs] == [("bare", "info", "unknown"), ("b", "error", "backend")]


def test_text_and_struct_orders_are_cut(spark):
    """Names with a long common beginning, and struct order columns, are cut like numbers; ties share a slice."""
    rows = [("k", f"frame_{i // 2:06d}", i) for i in range(1000)] + [("c", "frame_1", 5), ("k", None, -1)]
    df = spark.createDataFrame(rows, "key string, name string, i long").repartition(4)
    for order in (F.col("name"), F.struct("name", "i")):
        placed, was_cut = ordered.slice_hot(df.withColumn("o", order), ["key"], "o", 50)
        sizes = {r["_slice"]: r["count"] for r in placed.filter("key = 'k'").groupBy("_slice").count().collect()}
        assert was_cut and len(sizes) > 10 and max(sizes.values()) < 200
        out = ordered.Ordered(df.withColumn("o", order), ["key"], ["o", "i"], 50).row_number("n").lag(before="i").done().collect()
        want = sorted((r for r in rows if r[0] == "k"), key=lambda r: (r[1] is not None, r[1] or "", r[2]))
        got = sorted((r for r in out if r["key"] == "k"), key=lambda r: r["n"])
        assert [r["i"] for r in got] == [r[2] for r in want] and [r["before"] for r in got] == [None, *[r[2] for r in want[:-1]]]


def test_many_slices_go_by_range(spark, monkeypatch):
    monkeypatch.setattr(ordered, "QUANTILES", 3)
    df = spark.range(500).withColumn("key", F.lit(1))
    out = ordered.Ordered(df, ["key"], ["id"], 40).running_sum("s", F.col("id")).done().collect()
    assert all(r["s"] == r["id"] * (r["id"] + 1) // 2 for r in out)


def test_hash_pairs_in_blocks(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-2 ** 63, 2 ** 63 - 1, (6, 2))
    rows = []
    for i in range(120):
        flips = [sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 6), replace=False)) for _ in range(2)]
        rows.append((["test", "train", "valid", None][i % 4], *[int(np.uint64(v) ^ np.uint64(f)) for v, f in zip(base[i % 6].view(np.uint64), flips)]))
    rows = [(g, *[v - 2 ** 64 if v >= 2 ** 63 else v for v in hs]) for g, *hs in rows] + [("test", None, 1), ("train", None, 1)]
    df = spark.createDataFrame([*rows, *rows[:9]], "split string, h1 long, h2 long")
    rows = [r for r in [*rows, *rows[:9]] if None not in r]
    near = lambda p, q: all(((x ^ y) & (2 ** 64 - 1)).bit_count() <= 6 for x, y in zip(p[1:], q[1:]))
    want = Counter((p[0], q[0]) for p in rows for q in rows if p[0] < q[0] and near(p, q))
    for n in (10 ** 6, 16):
        got = quality.hash_pairs(df, "split", rows_in_a_block=n).groupBy("ga", "gb").agg(F.sum(F.col("na") * F.col("nb")).alias("n"))
        assert want and {(r.ga, r.gb): r.n for r in got.collect()} == want


def test_equal_bands_are_not_paired_in_the_plan(spark):
    """Hashes of mostly clear bits share most of their bands; that made nearly all pairs, each once a band."""
    df = spark.range(3000).selectExpr("IF(id % 2 = 0, 'a', 'b') AS split", "id * 4096 AS h1", "shiftleft(id, 50) AS h2")
    plan = quality.hash_pairs(df, "split")._jdf.queryExecution().toString()
    assert "Generate explode" not in plan and "FlatMapCoGroups" in plan


def test_near_duplicates_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(5)
    heaps = rng.normal(0, 0.125, (5, 8))
    rows = [(i, ["x", None][i % 2], [float(np.float32(v)) for v in heaps[i % 5] + rng.normal(0, 0.04, 8)]) for i in range(150)]
    rows += [(150, "x", None), (151, "x", [1.0, None]), (152, "x", rows[0][2][:7]), (153, "x", rows[0][2])]
    df = spark.createDataFrame(rows, "id long, k string, v array<float>")
    mad = lambda a, b: sum(abs(x - y) for x, y in zip(a, b)) / len(a)
    alike = lambda p, q: p[1] == q[1] and None not in (p[2], q[2]) and len(p[2]) == len(q[2]) and None not in p[2] and mad(p[2], q[2]) < 0.05
    want, kept = set(), []
    for q in rows:
        want |= {(p[0], q[0]) for p in rows if p[0] < q[0] and alike(p, q)}
        kept += [q] if not any(alike(p, q) for p in kept) else []
    for n in (7, 10 ** 6):
        got = quality.near_duplicate_pairs(df, "id", "v", 0.05, ["k"], n).collect()
        assert len(want) > 100 and len(got) == len(want) and {(r.a, r.b) for r in got} == want
        left = quality.near_duplicates(df, "v", 0.05, ["k"], "id", n).collect()
        assert sorted(r.id for r in left) == [r[0] for r in kept]
    # vectors of one cell that are not alike were settled one a round
    written = []
    monkeypatch.setattr(quality, "cut", lambda df, real=quality.cut: written.append(1) or real(df))
    apart = spark.createDataFrame([(i, [float(v) for v in rng.normal(0, 0.05, 64)]) for i in range(2100)], "id long, v array<float>")
    assert quality.near_duplicates(apart, "v", 0.02).count() == 2100 and len(written) < 12

"""A stream fed in pieces gives what the batch operator gives."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F, types as T

from boardsight.operators import tracking
from boardsight.streaming import feeds, ontime, runs
from boardsight.streaming.runs import drain, replay

T0 = dt.datetime(2024, 1, 1)


def at(seconds):
    return T0 + dt.timedelta(seconds=seconds)


@pytest.fixture
def feed(spark, tmp_path):
    """Write batches as files in order and read them back as a stream."""
    made = iter(range(1000))

    def make(batches, schema):
        folder = str(tmp_path / f"in{next(made)}")
        for i, rows in enumerate(batches):
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
        return stream, spark.read.schema(schema).parquet(folder)
    return make


def run(stream, name, mode="append"):
    query = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        query.processAllAvailable()
        return stream.sparkSession.sql(f"select * from {name}").collect()
    finally:
        query.stop()


@pytest.mark.parametrize("files, newest_first, late", [(1, False, "1 second"), (3, False, "1 second"), (3, True, "1 hour")])
def test_sampled_feed_equals_throttle(spark, files, newest_first, late):
    rows = [("a", at(s)) for s in (0, 0.4, 0.8, 1.2, 2.5)] + [("b", at(s)) for s in (0, 5)]
    batch = spark.createDataFrame(rows, "key string, timestamp timestamp")
    control = spark.createDataFrame([("a", "me", 1000)], "key string, client string, interval_ms long")
    out = drain(feeds.sampled_feed(replay(batch, "timestamp", files, newest_first), control, late=late)).collect()
    want = sorted(r.timestamp for r in tracking.throttle(batch.filter("key = 'a'"), ["key"], "timestamp", 1000).collect())
    assert sorted(r.timestamp for r in out) == want == [at(0), at(1.2), at(2.5)] and not any(r.late for r in out)


def test_rows_behind_the_watermark_go_to_a_side_table(spark, tmp_path):
    rows = [("a", at(10 * i)) for i in range(12)] + [(None, at(1))]
    batch = spark.createDataFrame(rows, "key string, timestamp timestamp")
    control = spark.createDataFrame([("a", "me", 1)], "key string, client string, interval_ms long")
    sent = feeds.sampled_feed(replay(batch, "timestamp", 4, newest_first=True), control, late="1 second")
    sink, late = str(tmp_path / "sink"), str(tmp_path / "late")
    ontime.write_on_time(sent, sink, late, str(tmp_path / "state"), {"availableNow": True}).awaitTermination(120)
    kept, behind = (sorted(r.timestamp for r in spark.read.parquet(f).collect()) for f in (sink, late))
    assert sorted(kept + behind) == [at(10 * i) for i in range(12)] and behind and max(kept) == at(110)


def test_live_feed_follows_requests(spark):
    data = spark.createDataFrame([("k", at(s), i) for i, s in enumerate((0, 1, 2, 3, 4, 5, 6, 7, 8))], "key string, timestamp timestamp, n int")
    asks = [("k", at(1), 1, "register", "a", None), ("k", at(2.5), 2, "interval", "b", 9000), ("k", at(3), 3, "interval", "a", 2000),
            ("k", at(5.5), 4, "register", "b", None), ("k", at(6.5), 5, "drop", "a", None), ("k", at(8), 6, "register", "b", 1000)]
    control = spark.createDataFrame(asks, "key string, timestamp timestamp, seq int, action string, client string, interval_ms long")
    for files, back in ((1, False), (3, True)):
        out = drain(feeds.live_feed(replay(data, "timestamp", files, back), replay(control, "timestamp", files), late="1 hour")).collect()
        assert sorted((r.n, r.client) for r in out) == [(1, "a"), (2, "a"), (3, "a"), (5, "a"), (8, "b")]


def test_subscriptions_first_client_holds(spark):
    log = [(1, "register", "k", "a", 10), (2, "register", "k", "b", 20), (3, "interval", "k", "a", 30),
           (4, "register", "m", "a", 5), (5, "drop", "m", "a", None), (6, "register", "m", "b", 7)]
    got = feeds.subscriptions(spark.createDataFrame(log, "seq int, action string, key string, client string, interval_ms int"))
    assert sorted(map(tuple, got.select("key", "client", "interval_ms").collect())) == [("k", "a", 30), ("m", "b", 7)]


def test_idempotent_stream(feed):
    rows = [("s", "k1", 1, at(0)), ("s", "k1", 2, at(1)), ("s", None, 3, at(2)), ("s", None, 4, at(2)), ("s", "k2", 5, at(3))]
    stream, _ = feed([rows[:1], rows[1:]], "session string, idem string, id int, timestamp timestamp")
    got = run(feeds.idempotent_stream(stream, ["session", "idem"]), "idem")
    assert sorted(r.id for r in got) == [1, 3, 4, 5]


def test_idempotent_ingest_drops_retries_for_good(spark, feed, tmp_path):
    rows = [("s", "k1", 1), ("s", "k1", 2), ("s", None, 3), (None, "k1", 4)], [("s", "k1", 5), ("s", None, 6), ("t", "k1", 7)], [("s", "k1", 8), (None, "k1", 9)]
    stream, _ = feed(rows, "session string, idem string, id int")
    base = str(tmp_path / "base")
    args = (stream, ["session", "idem"], ["id"], f"{base}/rows", f"{base}/keys")
    for state in ("state", "state", "again"):  # drained, restarted with nothing new, and all batches run again
        feeds.idempotent_ingest(*args, f"{base}/{state}", {"availableNow": True}).awaitTermination(120)
        assert sorted(r.id for r in spark.read.parquet(f"{base}/rows").collect()) == [1, 3, 4, 6, 7]


def _looks():
    def look(f):
        seen = 10 <= f < 30
        return ("r", f, "registered", [(50.0, 50.0, 10.0, 10.0)] if seen else [])
    return [look(f) for f in range(60)]


LOOKS = "recording string, frame int, status string, detections array<struct<cx:double,cy:double,w:double,h:double>>"


@pytest.mark.parametrize("cuts, late", [((25, 40), 5), ((25, 40), 100)])
def test_persistence_stream_equals_batch(feed, cuts, late):
    looks = _looks()
    parts = [looks[:cuts[0]], looks[cuts[0]:cuts[1]], looks[cuts[1]:]]
    ordered = parts if late < 60 else parts[::-1]
    stream, batch = feed([*ordered, [(None, 10**9, None, None)]], LOOKS)
    got = run(feeds.persistence_stream(stream, ["recording"], late_frames=late), f"persist{late}")
    batch = batch.filter("recording is not null")
    tracks = tracking.retrack(batch, ["recording"])
    want = tracking.persistence(tracks, batch, ["recording"]).filter("verdict = 'persisted'").collect()
    assert [(r["first"], r.persistence) for r in got] == [(r["first"], r.persistence) for r in want] == [(10, 0.8)]


def test_missing_frames_count_as_tried(feed):
    looks = [r for r in _looks() if r[1] % 3]  # two of three frames came
    stream, _ = feed([looks[20:], looks[:20], [(None, 10**9, None, None)]], LOOKS)
    got = run(feeds.persistence_stream(stream, ["recording"], late_frames=100, fill_missing=True), "missing")
    assert [(r["first"], r.judged_frame, round(r.persistence, 3)) for r in got] == [(10, 35, round(14 / 17, 3))]


def test_follow_runs_equals_keep_if_moved(feed):
    rows = [("a", at(0), [(0.0, 0.0)]), ("a", at(1), [(1.5, 0.0)]), ("a", at(2), [(2.5, 0.0)]), ("a", at(1.5), [(90.0, 0.0)]), ("a", at(3), [(2.6, 0.0)])]
    rows = [(r, t, o, i) for i, (r, t, o) in enumerate(rows)]
    # the look at 1.5 arrives after that at 2, and the second at 3 is no newer: neither changes anything
    rows += [("a", at(3), [(50.0, 0.0)], 5), ("a", at(4), [(5.0, 0.0)], 6)]
    for k, batches in enumerate(([rows], [rows[:2], rows[2:]], [rows[:4], rows[4:]], [[r] for r in rows])):
        stream, still = feed(batches, "run string, looked_at timestamp, outline array<struct<x:double,y:double>>, n long")
        got = run(feeds.follow_runs(stream, ["run"], "n"), f"follow{k}")
        want = tracking.keep_if_moved(still, ["run"], "looked_at", "outline", tie=["n"]).collect()
        assert sorted(r["at"] for r in got) == sorted(r["looked_at"] for r in want) == [at(0), at(2), at(4)]


def wait_for(stream, name, seconds=60):
    """Rows of a query with timers, which never runs out of work by itself."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("append").trigger(processingTime="1 second").start()
    try:
        end = time.time() + seconds
        while time.time() < end:
            got = stream.sparkSession.sql(f"select * from {name}").collect()
            if got:
                return got
            time.sleep(0.5)
        return []
    finally:
        query.stop()


def test_alive_stream_starts(feed):
    rows = [("c", at(0), 10), ("c", at(1), 20), ("c", at(2), 30)]
    stream, _ = feed([rows[:1], rows[1:]], "camera string, timestamp timestamp, bytes long")
    got = wait_for(feeds.alive_stream(stream, ["camera"], "bytes"), "alive")
    assert (got[0].alive, got[0].at_ms) == (True, dt.datetime(2024, 1, 1, 0, 0, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_stalls_reports_silent_run(feed):
    stream, _ = feed([[("r", at(0), False)], [("q", at(1), True)]], "run string, timestamp timestamp, down boolean")
    got = wait_for(feeds.stalls(stream, ["run"], after_s=1, down_s=3600), "stalls")
    assert [(r.run, r.camera_down) for r in got] == [("r", False)]


def test_metrics_stream(feed):
    rows = [("m", "parse", True, 2), ("m", "parse", False, 1)]
    stream, _ = feed([rows, rows], "source string, stage string, ok boolean, n long")
    got = run(feeds.metrics_stream(stream, ["parse"]), "metrics", "complete")
    assert [(r.parse_ok, r.parse_fail) for r in got] == [(4, 2)]


def test_metrics_are_sent_only_as_they_change(spark):
    rows = [("m", "parse", True, 1, at(0)), ("m", "parse", True, 1, at(0.02)), ("m", "parse", False, 1, at(0.05)), ("m", "other", True, 1, at(0.5)),
            ("m", "parse", True, 0, at(0.6)), ("m", "parse", True, 2, at(1)), ("m", "parse", True, 1, at(1.01))]
    batch = spark.createDataFrame(rows, "source string, stage string, ok boolean, n long, timestamp timestamp")
    for files, back in ((1, False), (3, True)):
        out = drain(feeds.metrics_changes(replay(batch, "timestamp", files, back), ["parse"], late="1 hour")).orderBy("at_us").collect()
        zero = out[0].at_us
        assert [((r.at_us - zero) // 1000, r.parse_ok, r.parse_fail) for r in out] == [(0, 1, 0), (100, 2, 1), (1000, 4, 1), (1100, 5, 1)]


def test_busy_streams_are_put_together_message_by_message(spark):
    rows = [("x", 2, at(0.5), "b</e>"), ("x", 1, at(0), "a"), ("x", 1, at(0.2), "A"), ("x", 3, at(1), "c"), ("x", 4, at(9), "d"), ("x", 5, at(10), "e</e>"), ("y", 1, at(0), "last")]
    batch = spark.createDataFrame(rows, "conn string, seq long, timestamp timestamp, payload string")
    for files, back in ((1, False), (3, True)):
        by = {ends: drain(feeds.reassemble_on_time(replay(batch, "timestamp", files, back), ["conn"], ends=ends, late="1 hour")).collect() for ends in (None, "</e>")}
        assert sorted((r.conn, r.segments, r.text) for r in by[None]) == [("x", 2, "de</e>"), ("x", 3, "Ab</e>c"), ("y", 1, "last")]
        assert sorted((r.conn, r.segments, r.text) for r in by["</e>"]) == [("x", 1, "c"), ("x", 2, "Ab</e>"), ("x", 2, "de</e>"), ("y", 1, "last")]


def test_reassemble_stream_equals_batch(feed):
    whole = "<s:Envelope><a/></s:Envelope>"
    rows = [("x", 2, at(0.5), whole[10:]), ("x", 1, at(0), whole[:10]), ("x", 9, at(60), "late"), ("x", 10, at(120), "later")]
    stream, batch = feed([rows[:2], rows[2:3], rows[3:]], "conn string, seq long, timestamp timestamp, payload string")
    got = run(feeds.reassemble_stream(stream, ["conn"]), "reasm")
    assert [r.envelope for r in got if r.segments == 2] == [whole]
    batch_text = [r.text for r in tracking.reassemble(batch, ["conn"]).collect()]
    assert whole in batch_text


def test_ingest_writes_rows_and_dead_letters(spark, feed, tmp_path, events):
    from boardsight.plans.registry import Tables
    from boardsight.plans.telemetry import motion_packets
    packets = motion_packets(Tables(spark, "/root/testdata/sf0.001")).select(F.col("ts").cast("timestamp").alias("timestamp"), "packet")
    source = str(tmp_path / "packets")
    packets.repartition(2).write.parquet(source)
    stream = feeds.read_packet_stream(spark, source, 1)
    sink, dead = str(tmp_path / "sink"), str(tmp_path / "dead")
    query = feeds.ingest(stream, sink, dead, str(tmp_path / "cp"), {"availableNow": True})
    query.awaitTermination(120)
    bad = events.filter("event_type = 'error'").count()
    assert spark.read.parquet(dead).count() == bad
    assert spark.read.parquet(sink).count() == events.count() - bad


def test_session_feed(spark):
    rows = [("s1", "bullet_created"), ("s1", "ping"), ("s2", "run_moved")]
    got = feeds.session_feed(spark.createDataFrame(rows, "session_id string, type string"), "s1").collect()
    assert [(r.session_id, r.type) for r in got] == [("s1", "bullet_created")]


def test_keys_share_state_and_landings_are_several_files(spark, monkeypatch):
    folders = []
    monkeypatch.setattr(runs, "new_folder", lambda *a, real=runs.new_folder: folders.append(real(*a)) or folders[-1])
    from boardsight.streaming.ontime import AT, fold_on_time
    at = F.timestamp_seconds(F.col("id") * 60)
    batch = spark.range(60).select(F.when(F.col("id") % 7 > 0, F.col("id") % 7).alias("key"), F.col("id").alias("n"), at.alias("timestamp"))
    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField(AT, T.LongType()), T.StructField("total", T.LongType())])

    def fold(state, rows):
        totals = rows["n"].cumsum() + (state or 0)
        return rows.assign(total=totals)[schema.names], int(totals.iloc[-1])
    want = sorted((k, sum(n for n in range(60) if n % 7 == k and n <= m)) for k in range(1, 7) for m in range(60) if m % 7 == k)
    for buckets, rows_in_a_file in ((1, 10 ** 6), (3, 5)):
        stream = replay(batch, "timestamp", 2, rows_in_a_file=rows_in_a_file)
        assert len(folders) % 3 == 2  # where it lands, where it is made
        out = drain(fold_on_time(stream, ["key"], "timestamp", fold, schema, buckets=buckets)).collect()
        assert sorted((r.key, r.total) for r in out if not r.late) == want and len(out) == len(want)
    # before, each landing was one file, written by one task
    assert spark.read.parquet(folders[-3]).select(F.input_file_name()).distinct().count() > 3

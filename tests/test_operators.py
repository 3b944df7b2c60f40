"""Hand-made expectations for the operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from boardsight.operators import filters, groups, paging, quality, scoring, series, sessions, spatial, tracking

LOOK = "recording string, frame int, status string, detections array<struct<cx:double,cy:double,w:double,h:double>>"


def points(spark, rows, id="id"):
    return spark.createDataFrame([(i, float(x), float(y)) for i, (x, y) in enumerate(rows)], f"{id} int, x double, y double")


def test_group_statistics(spark):
    rows = [("a", 13, -1), ("a", 7, -1), ("a", 13, -9), ("a", 7, -9), ("a", 10, -5), ("b", 0, 0), ("b", 3, 0), ("b", 0, 4), ("c", 2, -3), ("d", 0, 0), ("d", 6, 8)]
    df = spark.createDataFrame([(k, float(x), float(y)) for k, x, y in rows], "k string, x_mm double, y_mm double")
    got = {r.k: r for r in groups.group_stats(df, ["k"]).collect()}
    a, b, c, d = (got[k] for k in "abcd")
    assert (a.n, a.mpi_x_mm, a.mpi_y_mm, a.cep_mm, a.mean_radius_mm, a.extreme_spread_mm) == (5, 10, -5, 5, 4, 10)
    assert a.rms_radius_mm == pytest.approx(math.sqrt(20))
    assert b.cep_mm == pytest.approx(math.sqrt(52) / 3)
    assert b.mean_radius_mm == pytest.approx((5 + math.sqrt(52) + math.sqrt(73)) / 9)
    assert b.rms_radius_mm == pytest.approx(5 * math.sqrt(2) / 3)
    assert (c.n, c.cep_mm, c.mean_radius_mm, c.rms_radius_mm, c.extreme_spread_mm) == (1, None, None, None, None)
    assert (d.cep_mm, d.mean_radius_mm, d.rms_radius_mm, d.extreme_spread_mm) == (5, 5, 5, 10)


def test_exclusions(spark):
    schema = "session_id int, camera_alias string, target_index int, x_mm double, y_mm double, source string"
    rows = [(1, "A", 0, 1.0, 1.0, "model"), (1, "A", None, None, None, "model"), (1, "A", None, 1.0, 1.0, "model"),
            (1, "A", None, None, None, "manual"), (1, "A", 0, None, None, "model")]
    r = groups.exclusions(spark.createDataFrame(rows, schema)).first()
    assert (r.misses, r.without_position) == (2, 2)


@pytest.mark.parametrize("truth, found, tol, pairs", [
    ([(0, 0)], [(1, 0), (2, 0), (3, 0)], 10, [(0, 0)]),
    ([(0, 0)], [(9, 0), (1, 0)], 10, [(1, 0)]),
    ([(0, 0)], [(100, 0)], 40, []),
    ([(0, 0), (10, 0)], [(4, 0), (-5, 0)], 7, [(0, 1), (1, 0)]),
    ([(0, 0), (0, 6)], [(0, 0), (0, 1), (0, 4)], 6, [(0, 0), (2, 1)]),
])
def test_matching(spark, truth, found, tol, pairs):
    got = scoring.match_one_to_one(points(spark, truth, "truth_id"), points(spark, found, "found_id"), tol)
    assert sorted((r.found_id, r.truth_id) for r in got.collect()) == pairs


def best_by_trying(n, edges):
    """(pairs, total) of the matching with most pairs and then the least total."""
    def rest(i, used):
        if i == n:
            return 0, 0.0
        ways = [rest(i + 1, used)]
        for a, b, d in edges:
            if a == i and b not in used:
                k, c = rest(i + 1, used | {b})
                ways.append((k + 1, c + d))
        return min(ways, key=lambda w: (-w[0], w[1]))
    return rest(0, frozenset())


def test_assignment_is_least():
    rng = np.random.default_rng(1)
    for _ in range(300):
        n, m = rng.integers(1, 6, 2)
        edges = [(i, j, float(rng.integers(0, 9)) / 2) for i in range(n) for j in range(m) if rng.random() < 0.6]
        if edges:
            a, b, d = (np.array(x) for x in zip(*edges))
            got = scoring.assign(a, b, d)
            assert len(set(a[got])) == len(set(b[got])) == len(got)
            assert (len(got), d[got].sum()) == pytest.approx(best_by_trying(n, edges))


@pytest.mark.parametrize("limit", [500_000, 3])
def test_matching_by_key_with_nulls_equals_trying(spark, limit):
    rng = np.random.default_rng(3)
    edges = [(k, int(i), int(j), float(rng.integers(1, 20))) for k in ("a", "b", None) for i in range(5) for j in range(5) if rng.random() < 0.45]
    df = spark.createDataFrame(edges, "key string, truth_id int, found_id int, distance double")
    got = {k: [] for k in ("a", "b", None)}
    for r in scoring.match_edges(df, ["key"], limit).collect():
        got[r["key"]].append(r["distance"])
    for k, d in got.items():
        assert (len(d), sum(d)) == best_by_trying(5, [e[1:] for e in edges if e[0] == k])
    assert scoring.match_edges(df.limit(0), ["key"], limit).count() == 0


def test_error_summary(spark):
    rows = [(1.0, 1.0, math.sqrt(2), True), (4.8, -3.7, 5.0, True), (-0.7, -1.1, 1.3, False), (5.0, 0.0, 5.0, True)]
    r = scoring.error_summary(spark.createDataFrame(rows, "dx double, dy double, radial double, on_target boolean")).first()
    assert (r.n, r.on_target, r.under) == (4, 3, 3)
    assert r.adx_p95 == pytest.approx(np.percentile([1, 4.8, .7, 5], 95))


def looks(spark, frames, seen, lost=(), unseen=()):
    kind = lambda f: "lost" if f in lost else "unseen" if f in unseen else "registered"
    return spark.createDataFrame([("r", f, kind(f), [(50.0, 50.0, 10.0, 10.0)] if f in seen else []) for f in frames], LOOK)


@pytest.mark.parametrize("frames, seen, first, share, verdict", [
    (range(40), range(10, 40), 10, 1.0, "persisted"),
    (range(60), [10, 13, 19, 25], 10, 0.16, "rejected"),
    (range(300), range(10, 30), 10, 0.8, "persisted"),
    (range(30, 40), range(30, 38), 30, 0.8, "undecided"),
])
def test_persistence(spark, frames, seen, first, share, verdict):
    df = looks(spark, frames, set(seen))
    tracks = tracking.retrack(df, ["recording"])
    got = [(r["first"], r.persistence, r.verdict) for r in tracking.persistence(tracks, df, ["recording"]).collect()]
    assert got == [(first, pytest.approx(share), verdict)]


def test_rejected_candidate_reopens(spark):
    df = looks(spark, range(80), {0, 1} | set(range(40, 80)))
    tracks = tracking.retrack(df, ["recording"])
    got = sorted((r["first"], r.verdict) for r in tracking.persistence(tracks, df, ["recording"]).collect())
    assert got == [(0, "rejected"), (40, "persisted")]


def test_blind_run(spark):
    seen = {0: True, 1: True, 2: False, 4: False, 5: False, 6: True, 7: False}
    r = series.longest_blind_run(spark.createDataFrame([("p", f, s) for f, s in seen.items()], "k string, frame int, seen boolean"), ["k"]).first()
    assert (r.blind_first, r.blind_last, r.blind_frames) == (2, 5, 3)


@pytest.mark.parametrize("at, flash", [(120, None), (150, (60, 62))])
def test_step_arrival(spark, at, flash):
    d = np.where(np.arange(200) < at, 1.0, 9.0) + np.random.default_rng(0).normal(0, 0.3, 200)
    if flash:
        d[flash[0]:flash[1]] = 20
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(d)], "s string, frame int, d double")
    assert series.step_arrival(df, ["s"]).first().arrival == at
    assert series.step_arrival(df, ["s"], per_block=40).first().arrival == at


def test_gap_and_rate_rules(spark):
    df = spark.createDataFrame([(i, dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=t)) for i, t in enumerate([0, 400, 800, 1200, 2500])], "id int, ts timestamp")
    assert [r.id for r in paging.gap_filter(df, "ts", "id", 1000).orderBy("id").collect()] == [0, 4]
    one = df.withColumn("k", F.lit("k"))
    assert [r.id for r in tracking.throttle(one, ["k"], "ts", 1000).orderBy("id").collect()] == [0, 3, 4]


def test_collapse_repeats(spark):
    df = spark.createDataFrame([("k", t) for t in (0, 1000, 59000, 61000)], "k string, ts long")
    assert [(r.ts, r.repeats) for r in tracking.collapse_repeats(df, ["k"], "ts").orderBy("ts").collect()] == [(0, 0), (61000, 2)]


def test_frame_index_after_untimed(spark):
    df = spark.createDataFrame([("a", i, t) for i, t in enumerate([0, 40, 80, 200, 200, 200, 240, 280, 281, 400])], "k string, o int, ts long")
    got = [(r.frame, r.untimed) for r in series.frame_index(df, ["k"], "o", "ts").orderBy("o").collect()]
    assert [f for f, _ in got] == [0, 1, 2, 5, 6, 7, 8, 9, 10, 12] and [i for i, (_, u) in enumerate(got) if u] == [4, 5]


def test_asof_rules(spark):
    at = lambda h, m, s=0: dt.datetime(2024, 1, 1, h, m, s)
    runs = spark.createDataFrame([("s", "first", at(10, 0)), ("s", "second", at(10, 5))], "session_id string, id string, taken_at timestamp")
    holes = spark.createDataFrame([("s", 1, at(10, 4, 59)), ("s", 2, at(10, 5)), ("s", 3, at(10, 30)), ("s", 4, at(9, 59))], "session_id string, hole int, first_seen_at timestamp")
    got = {r.hole: r.run_id for r in sessions.asof_or_first(holes, runs).collect()}
    assert got == {1: "first", 2: "second", 3: "second", 4: "first"}


def test_label_groups_and_marks(spark):
    got = {r.id: r.group_id for r in spatial.label_groups(points(spark, [(0, 0), (100, 0), (15, 0), (30, 0)]), [], 18.0).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 0}
    left = spatial.marks_to_draw(points(spark, [(112, 115), (100, 120), (900, 470)]), points(spark, [(100, 100), (900, 500)]), 20.0)
    assert sorted(r.id for r in left.collect()) == [1, 2]


def test_polygon_edges_count(spark):
    square = [(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)]
    shapes = spark.createDataFrame([(0, square), (1, [(x + 5, y) for x, y in square])], "idx int, outline array<struct<x:double,y:double>>")
    got = {r.id: r.target_index for r in filters.assign_polygon(points(spark, [(5, 5), (12, 5), (0, 5), (20, 5), (15, 10)]), shapes, []).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: None, 4: 1}


def test_keep_in_order_drops_only_against_kept(spark):
    rows = spark.createDataFrame([(i,) for i in range(4)], "id int")
    chain = spark.createDataFrame([(0, 1), (1, 2), (2, 3)], "a int, b int")
    assert sorted(r.id for r in quality.keep_in_order(rows, chain, [], "id").collect()) == [0, 2]


def test_displaced_tracks_fold_on_a_null_board_too(spark):
    rows = [(b, c, first, seen, x, 0.0) for b in ("A", None) for c, first, seen, x in (("c1", 1, [1, 5], 10.0), ("c2", 2, [2], 10.5))]
    tracks = spark.createDataFrame(rows, "board string, cand_id string, first int, seen array<int>, x double, y double")
    got = {(r["board"], r["cand_id"]): r["into"] for r in tracking.merge_displaced(tracks, ["board"], (0.0, 0.0)).collect()}
    assert got == {("A", "c1"): None, ("A", "c2"): "c1", (None, "c1"): None, (None, "c2"): "c1"}


def test_displaced_tracks_at_the_centre(spark):
    rows = [("a", 0, [0, 9], 200.0, 5.0), ("b", 2, [2, 3], 200.0, 5.0), ("c", 3, [3, 4], 200.0001, 5.0), ("d", 4, [5], 200.0 + 1e-13, 5.0), ("e", 5, [6], 210.0, 5.0)]
    tracks = spark.createDataFrame(rows, "cand_id string, first int, seen array<int>, x double, y double")
    got = {r.cand_id: r.into for r in tracking.merge_displaced(tracks, [], (200.0, 5.0)).collect()}
    assert got == {"a": None, "b": "a", "c": None, "d": None, "e": None}


def test_label_groups_search_few_points(spark, monkeypatch):
    rng = np.random.default_rng(5)
    heap = [(x, y) for x, y in rng.uniform(0, 150, (400, 2))]
    # two more groups: their cells lie beside each other, and only an inner point links or parts them
    rows = heap + [(400 + 3 * i, 3 * j) for i in range(8) for j in range(8)] + [(439.5, 9.5), (470, 9)]
    searched = []
    monkeypatch.setattr(spatial, "nearest", lambda p, *a, real=spatial.nearest, **k: searched.append(p.count()) or real(p, *a, **k))
    got = {r.id: r.group_id for r in spatial.label_groups(points(spark, rows), [], 18.5).collect()}
    want = list(range(len(rows)))
    for _ in rows:
        for i, p in enumerate(rows):
            want[i] = min(want[j] for j, q in enumerate(rows) if math.dist(p, q) < 18.5)
        if all(want[i] == want[want[i]] for i in want) and want == [min(want[j] for j, q in enumerate(rows) if math.dist(p, q) < 18.5) for p in rows]:
            break
    assert [got[i] for i in range(len(rows))] == want
    assert sum(searched) < len(rows)

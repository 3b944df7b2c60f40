"""Crowded keys matched by place, held against the matching over all their pairs."""

import numpy as np
import pytest

from boardsight.operators import matching, scoring


def total(a, b, pairs):
    i, j = pairs
    assert len(set(i.tolist())) == len(set(j.tolist())) == len(i)
    return len(i), matching.gap(a[i], b[j]).sum()


@pytest.mark.parametrize("scale, grid", [(100, 0), (30, 0), (100, 30), (60, 60)])
def test_places_are_matched_as_over_all_pairs(scale, grid):
    rng = np.random.default_rng(scale + grid)
    for _ in range(25):
        a, b = (rng.normal(0, scale, (rng.integers(1, 60), 2)) for _ in "ab")
        if grid:
            a, b = np.round(a / grid) * grid, np.round(b / grid) * grid
        d = np.hypot(a[:, None, 0] - b[None, :, 0], a[:, None, 1] - b[None, :, 1])
        i, j = np.nonzero(d <= 40)
        best = scoring.assign(i, j, d[i, j]) if len(i) else np.zeros(0, int)
        got = matching.match_places(a, b, 40.0)
        assert (d[got] <= 40).all()
        assert total(a, b, got) == pytest.approx((len(best), d[i, j][best].sum()))


def test_pairs_of_a_crowded_key_are_not_listed():
    rng = np.random.default_rng(4)
    a, b = rng.normal(0, 5, (2, 3_000, 2))  # nine million pairs within reach
    i, j = matching.match_places(a, b, 40.0)
    assert len(i) == 3_000
    listed = matching.nearest_pairs(a, b, 40.0, matching.NEAREST)[0]
    assert len(listed) == 3_000 * matching.NEAREST


def test_crowded_keys_equal_the_others(spark):
    rng = np.random.default_rng(6)
    rows = lambda n: [(k, int(i), *map(float, rng.normal(0, 60, 2))) for k in ("a", "b", None) for i in range(n)]
    truth = spark.createDataFrame([*rows(40), ("a", 99, None, 1.0), ("a", 98, float("nan"), 1.0), (None, 99, 0.5, 0.5)], "key string, truth_id long, x double, y double").filter("x is null or not isnan(x)")
    found = spark.createDataFrame([*rows(30), ("b", 2**60 + 1, 0.25, 0.5)], "key string, found_id long, x double, y double")
    def seen(a, b, keys, limit):
        got = scoring.match_one_to_one(a, b, 40.0, keys, limit).collect()
        return sorted((*(str(r[c]) for c in keys), r.truth_id, r.found_id, round(r.distance, 9)) for r in got)

    assert seen(truth, found, ["key"], 0) == seen(truth, found, ["key"], 10**9)
    one = truth.filter("key = 'a'"), found.filter("key = 'a'")
    assert seen(*one, [], 0) == seen(*one, [], 10**9)


def test_a_mark_of_several_places_is_one(spark):
    truth = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 0.0)], "truth_id int, x double, y double")
    found = spark.createDataFrame([(1, 1.0, 0.0), (2, 10.5, 0.0)], "found_id int, x double, y double")
    for limit in (0, 10**9):
        assert [(r.truth_id, r.found_id, r.distance) for r in scoring.match_one_to_one(truth, found, 40.0, (), limit).collect()] == [(1, 2, 0.5)]

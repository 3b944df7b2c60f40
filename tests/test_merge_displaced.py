"""Displaced tracks: small keys, keys block against block, shorter lists, shared bits."""

import math

import numpy as np
import pyarrow as pa
import pytest

from boardsight.operators import tracking

CENTRE = (200.0, 5.0)


def folded(rows: list[tuple], fraction: float = 0.35) -> dict:
    """By trying every pair. Rows: key, cand_id, first, seen, x, y."""
    out = {}
    for key, id, first, seen, x, y in rows:
        fits = [(f, i) for k, i, f, s, u, v in rows if k == key and None not in (f, first, u, x) and s and seen and f < first and not set(s) & set(seen)
                and max(seen) <= max(s) and math.sqrt((x - u) ** 2 + (y - v) ** 2) <= fraction * math.sqrt((x - CENTRE[0]) ** 2 + (y - CENTRE[1]) ** 2)]
        out[key, id] = min(fits)[1] if fits else None
    return out


def made(n: int, frames: int, seed: int, keys=("a", None, "b")) -> list[tuple]:
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        seen = sorted({int(v) for v in rng.integers(0, frames, rng.integers(1, 8))})
        x = float(rng.choice([rng.uniform(0, 400), 200.0, rng.normal(200, 3)]))
        rows.append((keys[int(rng.integers(len(keys)))], f"c{i}", seen[0], seen, x, float(rng.uniform(0, 13))))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "board string, cand_id string, first int, seen array<int>, x double, y double")


@pytest.mark.parametrize("how", [{}, {"tracks_in_one_task": 100, "tracks_in_a_block": 16}, {"tracks_in_one_task": 1, "tracks_in_a_block": 40}])
def test_every_way_finds_the_earliest(spark, how):
    rows = made(300, 40, 3) + [("n", "p", None, [1], 10.0, 0.0), ("n", "q", 1, [], 10.0, 0.0), ("n", "r", 2, [2], None, 0.0),
                               ("n", "s", 0, [0, 9], 11.0, 0.0), ("n", "t", 3, [3], 10.0, 0.0), ("n", "u", 0, [0, 9], 10.5, 0.0)]
    got = {(r.board, r.cand_id): r.into for r in tracking.merge_displaced(frame(spark, rows), ["board"], CENTRE, **how).collect()}
    assert got == folded(rows) and got["n", "t"] == "s"


@pytest.mark.parametrize("first_tries, words, frames", [(64, 2 ** 22, 40), (1, 2 ** 22, 3_000), (2, 1, 5_000), (1, 1, 10 ** 12)])
def test_shorter_lists_and_shared_bits(monkeypatch, first_tries, words, frames):
    monkeypatch.setattr(tracking, "FIRST_TRIES", first_tries)
    monkeypatch.setattr(tracking, "SIGHTING_WORDS", words)
    monkeypatch.setattr(tracking, "TRIES_AT_ONCE", 500)
    rows = made(400, frames, 11, ("a", "b"))
    table = pa.table({"board": [r[0] for r in rows], "cand_id": [r[1] for r in rows], "first": [r[2] for r in rows], "_seen": [r[3] for r in rows],
                      "_last": [max(r[3]) for r in rows], "_x": [r[4] for r in rows], "_y": [r[5] for r in rows]})
    fit = tracking._earliest_fit(table, table, ["board"], CENTRE, 0.35)
    assert {r[:2]: rows[i][1] if i >= 0 else None for r, i in zip(rows, fit)} == folded(rows)


def test_no_pairs_are_joined_for_small_keys(spark):
    plan = tracking.merge_displaced(frame(spark, made(50, 40, 5)), ["board"], CENTRE)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Generate" not in plan and "Broadcast" not in plan

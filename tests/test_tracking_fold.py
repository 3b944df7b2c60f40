"""The tracking rule's way to a detection's candidate, against the whole rule."""

import numpy as np
import pandas as pd

from boardsight.operators import tracking


def test_first_match_is_that_of_the_whole_rule():
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(2000):
        pos = np.column_stack([rng.uniform(0, 150, (8, 2)), rng.uniform(1, 90, (8, 2))]).astype(np.float32)
        pos[rng.random(8) < 0.2, 2:] = np.nan
        p = np.array([*rng.uniform(0, 150, 2), *rng.uniform(1, 90, 2)], np.float32)
        if rng.random() < 0.2:
            p[2:] = np.nan
        hit = np.flatnonzero(tracking._matches(pos, p, 20.0))
        got = tracking._first_match(pos, tracking._size(pos), p, tracking._size(p), 20.0)
        assert got == (hit[0] if len(hit) else -1)
        found += len(hit) > 0
    assert 200 < found < 2000


def test_marks_far_apart_are_not_compared_in_full(monkeypatch):
    calls = []
    whole = tracking._matches
    monkeypatch.setattr(tracking, "_matches", lambda *a: calls.append(1) or whole(*a))
    rows = pd.DataFrame({"k": 1, "frame": range(60), "status": "registered", "_d": [[[i % 6 * 100.0, 0.0, 12.0, 12.0]] for i in range(60)]})
    fold = tracking.tracking_fold(["k"], ["k", *[f.name for f in tracking.TRACK_FIELDS]], 20.0, True, 0.5, 25)
    out, _ = fold(None, rows)
    assert len(out) == 60 and out["cand_id"].nunique() == 12  # each window passes once without persisting
    assert not calls

"""Matching and scoring."""

from __future__ import annotations

from functools import reduce
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from boardsight.core.ordered import hot_keys, null_safe_join
from boardsight.core.percentiles import ROWS_IN_ONE_STATE, percentiles
from boardsight.core.runtime import cut
from boardsight.functions.geometry import TRUTH_TOLERANCE, x_cause
from boardsight.operators.matching import gap, match_places, nearest_pairs
from boardsight.operators.spatial import components, distance_join, nearest

# Bounds of the run comparison, mm.
MOVE_MM, LIMIT_MM = 1.0, 5.0
EDGES_IN_ONE_TASK = 500_000


def assign(rows: np.ndarray, cols: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Which of the sparse edges (row, column, cost) make the one-to-one matching of most pairs, and of those the least total cost.

    Row by row, a shortest augmenting path over reduced costs. A row may also stay alone, at a price above all
    costs together, so pairs come first. A search ends at the nearest free column, so it sees only
    the neighbourhood it has to rearrange; memory is that of the edges.
    """
    order = np.lexsort((cols, rows))
    n = int(rows.max()) + 1 if len(rows) else 0
    first = np.searchsorted(rows[order], np.arange(n + 1)).tolist()
    to, price, edge = cols[order].tolist(), cost[order].tolist(), order.tolist()
    alone = (float(cost.max()) + 1.0) * (n + 1) if n else 0.0
    v = [0.0] * (int(cols.max()) + 1 if len(cols) else 0)  # potentials of columns; those of rows follow from their pairs
    owner, by = [-1] * len(v), [-1] * len(v)  # the row a column has, and over which edge
    taken = [-1] * n
    for start in range(n):
        best: dict[int, float] = {}
        way: dict[int, tuple[int, int]] = {}
        settled: dict[int, float] = {}
        heap: list[tuple[float, int]] = []
        row, base = start, 0.0
        limit, last = alone, (start, -1)  # the cheapest way that ends with a row left alone: that row is ``last``
        end = -1
        while True:
            for k in range(first[row], first[row + 1]):
                j = to[k]
                d = base + price[k] - v[j]
                if j not in settled and d < best.get(j, limit):
                    best[j], way[j] = d, (row, k)
                    heappush(heap, (d, j))
            while heap and (heap[0][1] in settled or heap[0][0] > best[heap[0][1]]):
                heappop(heap)
            if not heap or heap[0][0] >= limit:
                break
            d, j = heappop(heap)
            settled[j] = d
            if owner[j] < 0:
                end = j
                break
            row = owner[j]
            # The row's pair has no slack, so the way goes on at the same distance.
            base = d - (price[by[j]] - v[j])
            if base + alone < limit:
                limit, last = base + alone, (row, j)
        reach = settled[end] if end >= 0 else limit
        for j, d in settled.items():
            if d < reach:
                v[j] += d - reach
        if end < 0:
            row, j = last
            if row == start:
                continue
            taken[row] = -1
            end = j
        while True:
            row, k = way[end]
            owner[end], by[end] = row, k
            before, taken[row] = taken[row], k
            if row == start:
                break
            end = to[before]
    return np.array([edge[k] for k in taken if k >= 0], int)


def match_edges(edges: DataFrame, keys: list[str], edges_in_one_task: int = EDGES_IN_ONE_TASK) -> DataFrame:
    """J12 over given edges (keys, truth_id, found_id, distance): the one-to-one
    pairs, most pairs first, then least total distance.

    Of the found marks that only one truth can use, none but the nearest ever
    is, and the other way round; the rest are dropped. Keys of few edges are
    solved whole, many at once. Those of more than ``edges_in_one_task`` fall
    apart into connected components first.
    """
    keys = list(keys)
    edges = cut(edges.select(*keys, "truth_id", "found_id", "distance"))  # read several times below
    schema = T.StructType([edges.schema[c] for c in (*keys, "truth_id", "found_id", "distance")])

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["truth_id", "found_id"], ignore_index=True)
        rows, cols = (pdf.groupby([*keys, c], dropna=False, sort=False).ngroup().to_numpy() for c in ("truth_id", "found_id"))
        return pdf.loc[assign(rows, cols, pdf["distance"].to_numpy()), schema.names]

    # Marks of different keys never share an edge, so many small keys are solved at once.
    hot, n_hot, in_hot = hot_keys(edges, keys, edges_in_one_task)
    parts = 1 + 8 * (edges.count() - in_hot) // edges_in_one_task
    few = null_safe_join(edges, hot.select(*keys), keys, "left_anti") if n_hot else edges
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)) if keys else F.lit(0)
    pairs = few.groupBy(part.alias("_part")).applyInPandas(solve, schema)
    if not n_hot:
        return cut(pairs)
    many = null_safe_join(edges, hot.select(*keys), keys, "left_semi")
    many = _only_best_of_lone(_only_best_of_lone(many, keys, "truth_id", "found_id"), keys, "found_id", "truth_id")
    many = cut(many.select(*keys, "truth_id", "found_id", "distance"))
    side = lambda c, s: F.struct(F.lit(s).alias("s"), F.col(c).cast("string").alias("i"))
    links = many.select(*keys, side("truth_id", "t").alias("a"), side("found_id", "f").alias("b"))
    ends = links.select(*keys, F.col("a").alias("node")).unionByName(links.select(*keys, F.col("b").alias("node"))).distinct()
    labels = components(ends.withColumn("_label", F.col("node")), links, keys)
    tagged = null_safe_join(many.withColumn("node", side("truth_id", "t")), labels, [*keys, "node"]).drop("node")
    return cut(pairs.unionByName(tagged.groupBy(*keys, "_label").applyInPandas(solve, schema)))


def _only_best_of_lone(edges: DataFrame, keys: list[str], one: str, many: str) -> DataFrame:
    """Drop edges of ``many`` marks reachable only from one ``one`` mark, but for
    that one's nearest such mark."""
    degree = edges.groupBy(*keys, many).agg(F.count(F.lit(1)).alias("_deg"))
    tagged = null_safe_join(edges, degree, [*keys, many])
    lone = tagged.filter(F.col("_deg") == 1)
    best = lone.groupBy(*keys, one).agg(F.min_by(F.struct(many, "distance"), F.struct("distance", many)).alias("_b"))
    kept = best.select(*keys, one, F.col(f"_b.{many}").alias(many), F.col("_b.distance").alias("distance"))
    return tagged.filter(F.col("_deg") > 1).select(kept.columns).unionByName(kept)


def match_one_to_one(truth: DataFrame, found: DataFrame, tol: float, keys: list[str] = (), pairs_in_one_task: int = EDGES_IN_ONE_TASK) -> DataFrame:
    """Pairs of truth (truth_id, x, y) and found (found_id, x, y) marks, with their ``distance``.

    Keys that could have more than ``pairs_in_one_task`` pairs are matched by place, so
    their pairs are not listed; a task holds the marks of one such key.
    """
    keys = list(keys)
    truth, found = truth.select(*keys, "truth_id", "x", "y"), found.select(*keys, "found_id", "x", "y")
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    both = null_safe_join(count(truth, "_t"), count(found, "_f"), keys)
    crowded = cut(both.filter(F.col("_t").cast("double") * F.col("_f") > pairs_in_one_task).select(*keys, "_t"))
    n_crowded = crowded.count()
    side = lambda df, how: null_safe_join(df, crowded.select(*keys), keys, how) if n_crowded else df
    edges = distance_join(side(truth, "left_anti"), side(found, "left_anti"), tol, keys)
    pairs = match_edges(edges.select(*keys, "truth_id", "found_id", "distance"), keys)
    if not n_crowded:
        return pairs
    # by number and in many parts, for few bytes are much work and keys must not meet in a task
    dealt = lambda df: side(df, "left_semi").repartition(min(20 * n_crowded, 2_000), *keys).groupBy(*keys)
    matched = dealt(truth).cogroup(dealt(found)).applyInArrow(_by_place(keys, float(tol), pairs.schema), pairs.schema)
    return pairs.unionByName(cut(matched))


def _by_place(keys: list[str], tol: float, schema: T.StructType):
    def places(marks: pa.Table, name: str) -> tuple[pa.Table, np.ndarray]:
        at = np.column_stack([marks[c].to_numpy().astype(float) for c in ("x", "y")])
        marks = marks.filter(pa.array(np.isfinite(at).all(axis=1)))  # others are within reach of none
        if not pa.types.is_nested(marks[name].type):
            marks = marks.sort_by(name)
        return marks, np.column_stack([marks[c].to_numpy().astype(float) for c in ("x", "y")])

    def solve(truth: pa.Table, found: pa.Table) -> pa.Table:
        truth, a = places(truth, "truth_id")
        found, b = places(found, "found_id")
        rows, cols = (pd.factorize(t[c].to_numpy(), use_na_sentinel=False)[0] for t, c in ((truth, "truth_id"), (found, "found_id")))
        if len(set(rows)) == len(rows) and len(set(cols)) == len(cols):
            i, j = match_places(a, b, tol)
        else:  # a mark of several places: its pairs are listed
            i, j = nearest_pairs(a, b, tol, len(b))
            best = assign(rows[i], cols[j], gap(a[i], b[j]))
            i, j = i[best], j[best]
        columns = [*[truth[k].take(pa.array(i)) for k in keys], truth["truth_id"].take(pa.array(i)), found["found_id"].take(pa.array(j)), pa.array(gap(a[i], b[j]))]
        return pa.table(dict(zip(schema.names, columns, strict=True)))
    return solve


def new_marks(before: DataFrame, after: DataFrame, tol: float, keys: list[str] = ()) -> DataFrame:
    """After-marks (id, x, y) no before-mark is matched to."""
    pairs = match_one_to_one(before.withColumnRenamed("id", "truth_id"), after.withColumnRenamed("id", "found_id"), tol, keys)
    return null_safe_join(after, pairs.select(*keys, F.col("found_id").alias("id")), [*keys, "id"], "left_anti")


def score(pairs: DataFrame, n_found: DataFrame, n_truth: DataFrame, keys: list[str],
          claimed: DataFrame | None = None) -> DataFrame:
    """TP, FP, FN, precision, recall, F1 per key. ``n_found`` and
    ``n_truth`` (in scope only) are counts per key; ``claimed`` counts the
    detections that out-of-scope truth claims, which are no false positives."""
    tp = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("tp"))
    rows = null_safe_join(null_safe_join(n_found, n_truth, keys, "left"), tp, keys, "left")
    rows = rows.withColumn("claimed", F.lit(0)) if claimed is None else null_safe_join(rows, claimed, keys, "left")
    rows = rows.fillna(0, ["tp", "n_truth", "claimed"])
    rows = rows.withColumns({"fp": F.col("n_found") - F.col("tp") - F.col("claimed"), "fn": F.col("n_truth") - F.col("tp")})
    part = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return rows.select(*keys, "tp", "fp", "fn", part(tp, tp + fp).alias("precision"), part(tp, tp + fn).alias("recall"),
                       F.when(tp > 0, 2 * tp / (2 * tp + fp + fn)).otherwise(0.0).alias("f1"))


def score_marks(truth: DataFrame, found: DataFrame, tol: float, keys: list[str]) -> DataFrame:
    """J12 and A7 together; truth carries ``in_scope``. Out-of-scope truth is
    matched second, against the detections left over."""
    inside = match_one_to_one(truth.filter("in_scope"), found, tol, keys)
    left = null_safe_join(found, inside.select(*keys, "found_id"), [*keys, "found_id"], "left_anti")
    outside = match_one_to_one(truth.filter("not in_scope"), left, tol, keys)
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    every = truth.select(*keys).unionByName(found.select(*keys)).distinct()
    n_found = null_safe_join(every, count(found, "n_found"), keys, "left").fillna(0, ["n_found"])
    return score(inside, n_found, count(truth.filter("in_scope"), "n_truth"), keys, count(outside, "claimed"))


def attribute(found: DataFrame, pairs: DataFrame, marks: DataFrame, keys: list[str], tol: float = TRUTH_TOLERANCE) -> DataFrame:
    """X16 with J9: each false positive's nearest baseline mark and likely cause."""
    false = null_safe_join(found, pairs.select(*keys, "found_id"), [*keys, "found_id"], "left_anti")
    return nearest(false, marks, keys).withColumn("cause", x_cause(F.col("distance"), tol))


def error_summary(errors: DataFrame, by: list[str] | None = None, rows_in_one_state: int = ROWS_IN_ONE_STATE) -> DataFrame:
    """Pooled and per ``by`` (null where pooled): n, on-target, bias, mean,
    P95 and largest of |dX|, |dY| and radial, and how many are strictly under
    5 mm on both axes."""
    abs_ = errors.withColumns({"adx": F.abs("dx"), "ady": F.abs("dy")})
    sums = [F.count(F.lit(1)).alias("n"), F.count_if("on_target").alias("on_target"),
            F.avg("dx").alias("bias_dx"), F.avg("dy").alias("bias_dy"),
            *[f(c).alias(f"{c}_{n}") for c in ("adx", "ady", "radial") for n, f in (("mean", F.avg), ("max", F.max))],
            F.count_if((F.col("adx") < LIMIT_MM) & (F.col("ady") < LIMIT_MM)).alias("under")]

    def at(keys: list[str]) -> DataFrame:
        if not hot_keys(abs_, keys, rows_in_one_state)[1]:
            return abs_.groupBy(*keys).agg(*sums, *[F.percentile(c, F.lit(0.95)).alias(f"{c}_p95") for c in ("adx", "ady", "radial")])
        out = abs_.groupBy(*keys).agg(*sums)
        for c in ("adx", "ady", "radial"):
            p = percentiles(abs_, keys, c, {f"{c}_p95": 0.95}, rows_in_one_state)
            out = null_safe_join(out, p, keys) if keys else out.join(F.broadcast(p))
        return out
    pooled = at([])
    return pooled if not by else at(by).unionByName(pooled, allowMissingColumns=True)


def latency_summary(df: DataFrame, stages: dict[str, str], rows_in_one_state: int = ROWS_IN_ONE_STATE) -> DataFrame:
    """N, P50, P95, P99 and largest per stage ``{name: column}``; a stage
    never reached has n 0 and nothing else."""
    long = df.select(F.explode(F.map_from_arrays(
        F.array(*[F.lit(s) for s in stages]), F.array(*[F.col(c).cast("double") for c in stages.values()]))).alias("stage", "ms"))
    return percentiles(long, ["stage"], "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, rows_in_one_state,
                       extra=[F.count("ms").alias("n"), F.max("ms").alias("max")])


def pool_label(df: DataFrame, keys: list[str], label: str = "label") -> DataFrame:
    """Any REGRESSION makes the pool one; it is UNSEEN only if all is."""
    c = F.col(label)
    return df.groupBy(*keys).agg(
        F.when(F.bool_or(c == "REGRESSION"), "REGRESSION").when(F.bool_and(c == "UNSEEN"), "UNSEEN")
        .otherwise("UNLABELLED").alias("pooled"))


def detection_rate(looks: DataFrame, positions: DataFrame, r: float, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rate per position, the look-by-look ``seen`` rows W5 takes).
    Positions (position_id, x, y) pair one-to-one with each registered look's
    detections within ``r``."""
    registered = looks.filter(F.col("status") == "registered")
    dets = registered.select(*keys, "frame", F.posexplode("detections").alias("found_id", "_d")).select(
        *keys, "frame", "found_id", F.col("_d.cx").alias("x"), F.col("_d.cy").alias("y"))
    near = distance_join(dets, positions.select(*keys, F.col("position_id").alias("truth_id"), "x", "y"), r, keys)
    pairs = match_edges(near.select(*keys, "frame", "truth_id", "found_id", "distance"), [*keys, "frame"])
    hits = pairs.groupBy(*keys, F.col("truth_id").alias("position_id")).agg(
        F.count_distinct("frame").alias("hits"), F.min("frame").alias("first"), F.max("frame").alias("last"))
    looked = registered.groupBy(*keys).agg(F.count_distinct("frame").alias("looked"))
    rates = null_safe_join(null_safe_join(positions, looked, keys, "left"), hits, [*keys, "position_id"], "left")
    rates = rates.fillna(0, ["looked", "hits"]).withColumn("rate", F.try_divide(F.col("hits"), F.col("looked")))
    grid = null_safe_join(registered.select(*keys, "frame").distinct(), positions.select(*keys, "position_id"), keys)
    seen = null_safe_join(grid, pairs.select(*keys, "frame", F.col("truth_id").alias("position_id"), F.lit(True).alias("seen")),
                          [*keys, "frame", "position_id"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return rates, seen


def wander_summary(df: DataFrame, keys: list[str], rows_in_one_state: int = ROWS_IN_ONE_STATE) -> DataFrame:
    """P95 of drift and jitter, and median, P95 and largest error length
    per mark. Rows carry ``drift``, ``jitter``, ``error``."""
    out = percentiles(df, keys, "error", {"median": 0.5, "p95": 0.95}, rows_in_one_state,
                      extra=[F.count(F.lit(1)).alias("frames"), F.max("error").alias("max")])
    for c in ("drift", "jitter"):
        out = null_safe_join(out, percentiles(df, keys, c, {f"{c}_p95": 0.95}, rows_in_one_state), keys)
    return out


def residual_summary(dropped: DataFrame, radius: float, keys: list[str] = (), rows_in_one_state: int = ROWS_IN_ONE_STATE) -> DataFrame:
    """N, median and largest residual of the marks J10 drops, and whether
    the largest sits at the match radius (to the 0.1 it is reported to)."""
    out = percentiles(dropped, list(keys), "distance", {"median": 0.5}, rows_in_one_state,
                      extra=[F.count("distance").alias("n"), F.max("distance").alias("max")])
    return out.withColumn("at_radius", F.coalesce(F.round("max", 1) >= round(radius, 1), F.lit(False)))


def first_event(df: DataFrame, keys: list[str], ts: str) -> DataFrame:
    """A26."""
    return df.groupBy(*keys).agg(F.min(ts).alias(ts))


def event_identity(at: Column, x: Column, y: Column) -> Column:
    """What names one event in every log: its time cut to the millisecond
    and its place rounded to the px."""
    return F.struct(F.date_trunc("millisecond", at).alias("at"), F.bround(x, 0).cast("long").alias("x"), F.bround(y, 0).cast("long").alias("y"))


STAGES = ["sent_to_decoded", "frame_wait", "look_time", "persistence", "posted", "delivered", "sent_to_delivered"]


def latency_stages(sent: DataFrame, frames: DataFrame, looks: DataFrame, holes: DataFrame, keys: list[str]) -> DataFrame:
    """Durations in seconds, long form (stage, seconds). ``sent`` (number,
    sent_at), ``frames`` (index, stamp, taken, wait), ``looks`` (index,
    look_ms), ``holes`` (first_frame, confirmed, posted, delivered). A frame's
    number is its stamp, or the first stamp's offset plus its index."""
    first = frames.filter(F.col("stamp").isNotNull()).groupBy(*keys).agg(F.min_by(F.col("stamp") - F.col("index"), "index").alias("_off"))
    f = null_safe_join(frames, first, keys).withColumn("number", F.coalesce("stamp", F.col("_off") + F.col("index")))
    done = null_safe_join(null_safe_join(f, looks, [*keys, "index"]), sent, [*keys, "number"])
    done = done.withColumns({"look": F.col("look_ms") / 1000}).withColumn("look_end", F.col("taken") + F.col("look"))
    per_frame = done.select(*keys, F.explode(F.create_map(
        F.lit("sent_to_decoded"), F.col("taken") - F.col("wait") - F.col("sent_at"),
        F.lit("frame_wait"), F.col("wait"), F.lit("look_time"), F.col("look"))).alias("stage", "seconds"))
    ends = done.select(*keys, F.col("index").alias("first_frame"), "sent_at", "look_end")
    h = null_safe_join(holes, ends, [*keys, "first_frame"])
    per_hole = h.select(*keys, F.explode(F.create_map(
        F.lit("persistence"), F.col("confirmed") - F.col("look_end"),
        F.lit("posted"), F.col("posted") - F.col("confirmed"),
        F.lit("delivered"), F.col("delivered") - F.col("confirmed"),
        F.lit("sent_to_delivered"), F.col("delivered") - F.col("sent_at"))).alias("stage", "seconds"))
    return per_frame.unionByName(per_hole).filter(F.col("seconds").isNotNull())


def stamp_mismatches(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Frames whose stamp is unread or not the first stamp's offset plus
    their index."""
    first = frames.filter(F.col("stamp").isNotNull()).groupBy(*keys).agg(F.min_by(F.col("stamp") - F.col("index"), "index").alias("_off"))
    off = F.coalesce(F.col("stamp") != F.col("_off") + F.col("index"), F.lit(True))
    return null_safe_join(frames, first, keys).groupBy(*keys).agg(F.count_if(off).alias("stamp_mismatches"))


def hit_to_report(pairs: DataFrame, arrivals: DataFrame, keys: list[str], fps: str = "fps") -> DataFrame:
    """Reported less arrival / fps; null without a labelled arrival."""
    return null_safe_join(pairs, arrivals, [*keys, "truth_id"], "left").withColumn(
        "hit_to_report", F.col("reported") - F.col("arrival") / F.col(fps))


def _moved(p: str, q: str) -> Column:
    return F.hypot(F.col(f"{q}dx") - F.col(f"{p}dx"), F.col(f"{q}dy") - F.col(f"{p}dy"))


def _over(p: str) -> Column:
    return F.greatest(F.abs(f"{p}dx"), F.abs(f"{p}dy")) >= LIMIT_MM


def compare_truth(ref: DataFrame, new: DataFrame, controls: DataFrame, keys: list[str] = ("recording",)) -> DataFrame:
    """J15, U11 by truth id: one row per finding: lost, gained, moved, over
    limit, scope; ``noise`` when a shifted control of the reference shows the
    same. Rows carry ``truth, outcome, dx, dy``; controls further ``shift``."""
    keys = list(keys)
    cols = ["outcome", "dx", "dy"]
    was = ref.select(*keys, "truth", *[F.col(c).alias(f"r_{c}") for c in cols])
    now = new.select(*keys, "truth", *[F.col(c).alias(f"n_{c}") for c in cols])
    both = null_safe_join(was, now, [*keys, "truth"])
    under = null_safe_join(controls.select(*keys, "truth", *[F.col(c).alias(f"c_{c}") for c in cols]),
                           was, [*keys, "truth"])
    hit = F.col("c_outcome") == "TP"
    noise = under.groupBy(*keys, "truth").agg(
        F.bool_or(~hit).alias("noise_lost"), F.bool_or(hit & (_moved("r_", "c_") > MOVE_MM)).alias("noise_moved"),
        F.bool_or(hit & _over("c_")).alias("noise_over"))
    rows = null_safe_join(both, noise, [*keys, "truth"], "left")
    r, n = F.col("r_outcome"), F.col("n_outcome")
    scoped = (r == "out of scope") | (n == "out of scope")
    found_both = ~scoped & (r != "FN") & (n == "TP")

    def finding(kind: str, when: Column, noisy: Column) -> Column:
        return F.when(when, F.struct(F.lit(kind).alias("kind"), F.coalesce(noisy, F.lit(False)).alias("noise")))
    no = F.lit(False)
    found = F.array(
        finding("scope", scoped & (r != n), no), finding("gained", ~scoped & (r == "FN") & (n == "TP"), no),
        finding("lost", ~scoped & (r != "FN") & (n != "TP"), F.col("noise_lost")),
        finding("moved", found_both & (_moved("r_", "n_") > MOVE_MM), F.col("noise_moved")),
        finding("over limit", found_both & _over("n_"), F.col("noise_over")))
    return rows.select(*keys, F.concat(F.lit("truth #"), F.col("truth").cast("string")).alias("hole"),
                       F.explode(F.filter(found, lambda f: f.isNotNull())).alias("_f")).select(*keys, "hole", "_f.*")


def compare_false_positives(ref: DataFrame, new: DataFrame, controls: DataFrame, keys: list[str] = ("recording",),
                            tol: float = TRUTH_TOLERANCE) -> DataFrame:
    """J15, U11 by position: false positives added (noise if a control has one
    within the tolerance) and removed. Rows carry ``found, x, y``."""
    keys = list(keys)
    pairs = match_one_to_one(ref.withColumnRenamed("found", "truth_id"), new.withColumnRenamed("found", "found_id"), tol, keys)
    added = null_safe_join(new, pairs.select(*keys, F.col("found_id").alias("found")), [*keys, "found"], "left_anti")
    added = nearest(added, controls, keys, max_r=tol).select(
        *keys, F.concat(F.lit("FP found #"), F.col("found").cast("string")).alias("hole"), F.lit("added").alias("kind"),
        F.col("distance").isNotNull().alias("noise"))
    removed = null_safe_join(ref, pairs.select(*keys, F.col("truth_id").alias("found")), [*keys, "found"], "left_anti").select(
        *keys, F.concat(F.lit("reference FP found #"), F.col("found").cast("string")).alias("hole"), F.lit("removed").alias("kind"),
        F.lit(False).alias("noise"))
    return added.unionByName(removed)


def comparable(ref: DataFrame, new: DataFrame, settings: list[str], keys: list[str] = ("recording",)) -> DataFrame:
    """Recordings not run, or not comparable since a setting differs or
    they are only in the new result."""
    keys = list(keys)
    a = ref.select(*keys, F.struct(*settings).alias("_r"))
    b = new.select(*keys, F.struct(*settings).alias("_n"))
    cond = reduce(lambda p, q: p & q, [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys])
    both = a.alias("a").join(b.alias("b"), cond, "full_outer").select(
        *[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], "_r", "_n")
    kind = F.when(F.col("_n").isNull(), "not run").when(F.col("_r").isNull() | (F.col("_r") != F.col("_n")), "not comparable")
    return both.select(*keys, F.lit("-").alias("hole"), kind.alias("kind"), F.lit(False).alias("noise")).filter(F.col("kind").isNotNull())


FAILS = ["lost", "added", "moved", "over limit", "not run", "not comparable"]


def judge_runs(*findings: DataFrame) -> DataFrame:
    """All findings, with those that fail the rule marked; recordings not
    ruled on keep only that finding."""
    every = reduce(lambda a, b: a.unionByName(b), findings)
    out = every.withColumn("fails", F.col("kind").isin(FAILS) & ~F.col("noise"))
    ruled = out.filter(F.col("kind").isin("not run", "not comparable")).select("recording").distinct()
    others = out.filter(~F.col("kind").isin("not run", "not comparable")).join(ruled, "recording", "left_anti")
    return others.unionByName(out.filter(F.col("kind").isin("not run", "not comparable")))


def passed(findings: DataFrame, keys: list[str] = ()) -> DataFrame:
    """Passes when no finding that is not noise fails it."""
    return findings.groupBy(*keys).agg((~F.coalesce(F.bool_or("fails"), F.lit(False))).alias("passed"))


def compare_moved(control: DataFrame, case: DataFrame, truths: DataFrame, keys: list[str]) -> DataFrame:
    """Per truth how far it moved and how much later it was first seen,
    case less control, and whether the case dropped it. Rows of the runs carry
    ``truth, seen_at, dx, dy``."""
    side = lambda df, p: df.select(*keys, "truth", *[F.col(c).alias(f"{p}{c}") for c in ("seen_at", "dx", "dy")])
    rows = null_safe_join(null_safe_join(truths, side(control, "b_"), [*keys, "truth"], "left"), side(case, "a_"), [*keys, "truth"], "left")
    return rows.select(
        *keys, "truth", (F.col("a_dx") - F.col("b_dx")).alias("moved_x"), (F.col("a_dy") - F.col("b_dy")).alias("moved_y"),
        (F.col("a_seen_at") - F.col("b_seen_at")).alias("delay"),
        (F.col("b_seen_at").isNotNull() & F.col("a_seen_at").isNull()).alias("dropped"))

"""Data quality and split leakage."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from boardsight.core.ordered import Ordered, null_safe_join
from boardsight.core.pairs import ROWS_IN_A_BLOCK, deal, try_pairs
from boardsight.core.runtime import cut
from boardsight.operators.sessions import latest_at

SEGMENTS = 3


def mean_abs_difference(a: Column, b: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x.cast("double") - y.cast("double"))), F.lit(0.0), lambda s, v: s + v)
    return total / F.size(a)


def _cells(df: DataFrame, vec: str, max_mad: float) -> DataFrame:
    """Grid cell of the means of the vector's thirds. Two vectors closer than
    ``max_mad`` differ in each third's mean by at most ``max_mad`` times the
    vector's length over the third's, so they lie in neighbouring cells."""
    n = F.size(vec)
    step = F.floor(n / SEGMENTS).cast("int")
    cells = []
    for i in range(SEGMENTS):
        size = step if i < SEGMENTS - 1 else n - step * (SEGMENTS - 1)
        part = F.slice(F.col(vec), step * i + 1, size)
        mean = F.aggregate(part, F.lit(0.0), lambda s, v: s + v.cast("double")) / size
        cells.append(F.floor(mean / (n / size * max_mad)).cast("long").alias(f"c{i}"))
    return df.withColumn("_cell", F.struct(*cells))


def distinct_vectors(df: DataFrame, id: str, vec: str, keys: list[str]) -> DataFrame:
    """One row per different vector and key, under its first id, with how many
    rows bear it: exact copies never meet each other."""
    return df.groupBy(*keys, F.col(vec)).agg(F.min(id).alias(id), F.count(F.lit(1)).alias("copies"))


def _comparable(vec: Column) -> Column:
    """Whether the vector has a distance to any other: nulls have none."""
    return vec.isNotNull() & (F.size(vec) > 0) & F.forall(vec, lambda v: v.isNotNull())


class Nearness:
    """Which vectors of a pandas column differ from a given one by less than ``max_mad`` in the mean, as ``mean_abs_difference`` adds it up."""

    def __init__(self, vectors, max_mad: float):
        self.rows = np.stack(list(vectors))
        self.columns = np.ascontiguousarray(self.rows.T)  # added up a place at a time, over all vectors
        self.space = np.empty_like(self.columns)
        self.max_mad = max_mad

    def near(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row numbers, means)."""
        np.abs(np.subtract(self.columns, vector[:, None], out=self.space), out=self.space)
        total = np.add.reduce(self.space, 0)
        # sums in the vectors' own precision only pass over what is far for certain
        maybe = np.flatnonzero(total <= self.max_mad * len(vector) * (1 + 1e-4))
        exact = np.add.accumulate(np.abs(self.rows[maybe].astype(float) - vector.astype(float)), 1)[:, -1] / len(vector)
        return maybe[exact < self.max_mad], exact[exact < self.max_mad]


def near_duplicate_pairs(rows: DataFrame, id: str, vec: str, max_mad: float, keys: list[str] = (), rows_in_a_block: int = ROWS_IN_A_BLOCK) -> DataFrame:
    """Pairs (a < b) of different vectors closer than ``max_mad``.

    Vectors are dealt into blocks by cell, and blocks tried against those that
    hold a neighbouring cell. Where most vectors share a cell those are all
    blocks, and the tries grow with the square of the rows.
    """
    keys = list(keys)
    placed = rows.select(*keys, F.col(id).alias("a"), F.col(vec).alias("v")).filter(_comparable(F.col("v"))).withColumn("dim", F.size("v"))
    group = F.struct(*keys, "dim")
    cell = [f"_cell.c{i}" for i in range(SEGMENTS)]
    blocks = deal(_cells(placed, "v", max_mad).select(*keys, "dim", "a", "v", "_cell"), [*keys, "dim", "_cell"], rows_in_a_block)
    ends = blocks.groupBy("_block").agg(F.min(group).alias("g0"), F.max(group).alias("g1"), *[f(c).alias(f"c{i}{e}") for i, c in enumerate(cell) for f, e in ((F.min, 0), (F.max, 1))])
    a, b = ends.alias("a"), ends.alias("b")
    meet = (F.col("a._block") <= F.col("b._block")) & (F.col("a.g0") <= F.col("b.g1")) & (F.col("b.g0") <= F.col("a.g1"))
    for i in range(SEGMENTS):
        meet = meet & (F.col(f"a.c{i}0") - 1 <= F.col(f"b.c{i}1")) & (F.col(f"b.c{i}0") - 1 <= F.col(f"a.c{i}1"))
    pairs = a.join(b, meet).select(F.col("a._block").alias("_i"), F.col("b._block").alias("_j"))
    fields = [blocks.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("a", blocks.schema["a"].dataType), T.StructField("b", blocks.schema["a"].dataType), T.StructField("mad", T.DoubleType())])

    def tries(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        own = left["_i"].iloc[0] == left["_j"].iloc[0]
        every = pd.concat([left, right], ignore_index=True).groupby([*keys, "dim"], dropna=False, sort=False).ngroup().to_numpy()
        out = []
        here, there = every[:len(left)], every[len(left):]
        for g in np.intersect1d(here, there):
            one, other = left[here == g], right[there == g]
            held, ids = Nearness(other["v"], max_mad), other["a"].to_numpy()
            for i, x in zip(one["a"], one["v"]):
                at, mad = held.near(x)
                for k, m in zip(at, mad):
                    if ids[k] > i or (not own and ids[k] < i):
                        out.append((*one[keys].iloc[0], min(i, ids[k]), max(i, ids[k]), m))
        return pd.DataFrame(out, columns=schema.names)
    return try_pairs(blocks.drop("_cell"), pairs, tries, schema)


def near_duplicates(df: DataFrame, vec: str, max_mad: float, keys: list[str] = (), id: str = "id",
                    rows_in_a_block: int = 2 * ROWS_IN_A_BLOCK) -> DataFrame:
    """The rows kept when, in id order, a row is dropped if it nearly repeats
    a kept one of its key.

    Exact copies stand and fall with their first. Each round settles the next
    block of each key in id order by itself, and what nearly repeats a row
    kept there goes from all later blocks, so no pairs are made, however dense
    a heap is. There are as many rounds as a key has blocks with rows left.
    """
    keys = list(keys)
    rest = distinct_vectors(df, id, vec, keys).select(*keys, F.col(id).alias("at"), F.col(vec).alias("v"))
    lone = rest.filter(~_comparable(F.col("v"))).select(*keys, "at")
    rest = rest.filter(_comparable(F.col("v"))).withColumn("dim", F.size("v"))
    by = [*keys, "dim"]
    rest = Ordered(rest, by, ["at"]).row_number("n").done().withColumn("block", F.floor((F.col("n") - 1) / rows_in_a_block)).drop("n")
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = lambda rows: rows.select(*[F.col(c).alias(c) for c in rows.columns]).repartition(tasks, *by, "block")  # noqa: E731 - few bytes, much work
    rest = cut(dealt(rest))

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at", ignore_index=True)
        held, open_ = Nearness(pdf["v"], max_mad), np.ones(len(pdf), bool)
        for i, x in enumerate(pdf["v"]):
            if open_[i]:
                at, _ = held.near(x)
                open_[at[at > i]] = False
        return pdf[open_]

    def left_over(pdf: pd.DataFrame, heads: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty or heads.empty:
            return pdf
        held, open_ = Nearness(pdf["v"], max_mad), np.ones(len(pdf), bool)
        for x in heads["v"]:
            open_[held.near(x)[0]] = False
        return pdf[open_]

    kept = [lone]
    while not rest.isEmpty():
        blocks = rest.select(*by, "block").distinct()
        first = cut(blocks.groupBy(*by).agg(F.min("block").alias("block")))
        heads = cut(dealt(null_safe_join(rest, first, [*by, "block"], "left_semi")).groupBy(*by, "block").applyInPandas(settle, rest.schema))
        kept.append(heads.select(*keys, "at"))
        later = null_safe_join(rest, first, [*by, "block"], "left_anti")
        targets = null_safe_join(blocks, first, [*by, "block"], "left_anti")
        told = null_safe_join(targets, heads.drop("block"), by).select(rest.columns)
        rest = cut(dealt(later).groupBy(*by, "block").cogroup(dealt(told).groupBy(*by, "block")).applyInPandas(left_over, rest.schema))
    kept = reduce(lambda a, b: a.unionByName(b), kept)
    return null_safe_join(df, kept.withColumnRenamed("at", id), [*keys, id], "left_semi")


def keep_in_order(rows: DataFrame, pairs: DataFrame, keys: list[str], id: str) -> DataFrame:
    """Rows kept when, in id order, a row goes if it pairs with a kept one.
    Each round keeps the rows no undecided row comes before and drops what they
    pair with."""
    open_, edges, kept = cut(rows), cut(pairs.select(*keys, "a", "b")), []
    while True:
        blocked = edges.select(*keys, F.col("b").alias(id)).distinct()
        free = cut(null_safe_join(open_, blocked, [*keys, id], "left_anti"))
        kept.append(free)
        if edges.isEmpty():
            return reduce(lambda a, b: a.unionByName(b), kept)
        gone = null_safe_join(edges, free.withColumnRenamed(id, "a"), [*keys, "a"], "left_semi").select(*keys, F.col("b").alias(id)).distinct()
        done = free.unionByName(gone)
        open_ = cut(null_safe_join(open_, done, [*keys, id], "left_anti"))
        for end in ("a", "b"):
            edges = null_safe_join(edges, done.withColumnRenamed(id, end), [*keys, end], "left_anti")
        edges = cut(edges)


def hash_pairs(df: DataFrame, group: str, h1: str = "h1", h2: str = "h2", bits: int = 6, rows_in_a_block: int = ROWS_IN_A_BLOCK) -> DataFrame:
    """Pairs of different groups whose two hashes both differ in at most
    ``bits`` bits, hashes borne by many rows standing as one (``na``, ``nb``
    rows). Bands of mostly equal bits narrow nothing, so blocks of hashes are
    tried whole: two machine words a pair."""
    uniq = df.groupBy(group, h1, h2).agg(F.count(F.lit(1)).alias("n")).select(F.col(group).alias("g"), F.col(h1).alias("h1"), F.col(h2).alias("h2"), "n")
    uniq = deal(uniq.dropna(subset=["g", "h1", "h2"]), ["g"], rows_in_a_block)
    ends = uniq.groupBy("_block").agg(F.min("g").alias("least"), F.max("g").alias("most"))
    a, b = ends.select(F.col("_block").alias("_i"), "least"), ends.select(F.col("_block").alias("_j"), "most")
    pairs = a.join(b, F.col("least") < F.col("most")).select("_i", "_j")
    names = [("ga", "g"), ("gb", "g"), ("a1", "h1"), ("a2", "h2"), ("na", "n"), ("b1", "h1"), ("b2", "h2"), ("nb", "n")]
    schema = T.StructType([T.StructField(n, uniq.schema[c].dataType) for n, c in names])

    unsigned = lambda df, c: df[c].to_numpy(np.int64).view(np.uint64)  # noqa: E731 - of a negative number, numpy counts the bits of its absolute value

    def tries(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        ia, ib = [], []
        for g, part in left.groupby("g"):
            there = np.flatnonzero((right["g"] > g).to_numpy())
            b1, b2 = unsigned(right, "h1")[there], unsigned(right, "h2")[there]
            for i, x, y in zip(part.index, unsigned(part, "h1"), unsigned(part, "h2")):
                k = np.flatnonzero(np.bitwise_count(b1 ^ x) <= bits)
                k = k[np.bitwise_count(b2[k] ^ y) <= bits]
                if len(k):
                    ia.append(np.full(len(k), i))
                    ib.append(there[k])
        at = lambda df, i: df.take(np.concatenate(i) if i else [])
        sides = {"a": at(left, ia), "b": at(right, ib)}
        return pd.DataFrame({n: sides["a" if "a" in n else "b"][c].to_numpy() for n, c in names})
    return try_pairs(uniq, pairs, tries, schema)


def split_leakage(df: DataFrame, group: str = "split", h1: str = "h1", h2: str = "h2", bits: int = 6) -> DataFrame:
    """Near-duplicate pairs between every two splits."""
    return hash_pairs(df, group, h1, h2, bits).groupBy("ga", "gb").agg(F.sum(F.col("na") * F.col("nb")).alias("pairs"))


def leaked_share(df: DataFrame, train: str = "train", group: str = "split", h1: str = "h1", h2: str = "h2", bits: int = 6) -> DataFrame:
    """Per other split, rows with a near-duplicate in ``train``, and their share."""
    pairs = cut(hash_pairs(df, group, h1, h2, bits))  # both sides read them
    side = lambda here, there, p, q: pairs.filter(F.col(there) == train).select(
        F.col(here).alias(group), F.col(f"{p}1").alias(h1), F.col(f"{p}2").alias(h2), F.col(f"n{p}").alias("n"))
    twins = side("ga", "gb", "a", "b").unionByName(side("gb", "ga", "b", "a")).distinct()
    leaked = twins.groupBy(group).agg(F.sum("n").alias("leaked"))
    total = df.filter(F.col(group) != train).groupBy(group).agg(F.count(F.lit(1)).alias("rows"))
    return (null_safe_join(total, leaked, [group], "left").withColumn("leaked", F.coalesce("leaked", F.lit(0)))
            .withColumn("share", F.col("leaked") / F.col("rows")))


def nearest_train_frame(frames: DataFrame, clip: str = "clip", frame: str = "frame", split: str = "split",
                        train: str = "train") -> DataFrame:
    """Per frame outside train, how far the nearest train frame of its clip
    is (null if the clip has none). Looks both ways along each clip."""
    trained = frames.filter(F.col(split) == train).select(clip, F.col(frame).alias("_f"), F.col(frame).alias("_at"))
    other = frames.filter(F.col(split) != train)
    back = latest_at(other, trained, [clip], frame, "_at", ["_f"]).withColumn("_before", F.col("asof._f")).drop("asof")
    flipped = back.withColumn("_neg", -F.col(frame))
    ahead = latest_at(flipped, trained.withColumn("_neg", -F.col("_f")).drop("_at"), [clip], "_neg", "_neg", ["_f"])
    return ahead.withColumn("distance", F.least(F.col(frame) - F.col("_before"), F.col("asof._f") - F.col(frame))).drop("_before", "_neg", "asof")


def distance_histogram(distances: DataFrame, split: str = "split", top: int = 10) -> DataFrame:
    """Frames per distance, those past ``top`` together, and those of
    clips with no train frame."""
    bucket = (F.when(F.col("distance").isNull(), "no train frames").when(F.col("distance") > top, f">{top}")
              .otherwise(F.col("distance").cast("string")))
    return distances.groupBy(split, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("frames"))


def group_split(df: DataFrame, key: str, shares: dict[str, int]) -> DataFrame:
    """A split per row, all rows of one ``key`` in the same; ``shares`` are
    parts of their sum. A hash of the key decides, so nothing is shuffled."""
    total, edge, out = sum(shares.values()), 0, F.lit(None).cast("string")
    place = F.conv(F.substring(F.md5(F.col(key).cast("string")), 1, 8), 16, 10).cast("long") % total
    for name, part in shares.items():
        out = F.when((place >= edge) & (place < edge + part), name).otherwise(out)
        edge += part
    return df.withColumn("split", out)


def audit_splits(boxes: DataFrame, images: DataFrame, classes: list[str], rules: dict[str, Column], split: str = "split") -> DataFrame:
    """Per split images, boxes, boxes per image, share of each class, and
    boxes failing each quality rule. The classes are named, so no pass is spent
    finding them."""
    n = F.count(F.lit(1))
    b = boxes.groupBy(split).agg(
        n.alias("boxes"), *[(F.count_if(F.col("class") == c) / n).alias(f"share_{c}") for c in classes],
        *[F.count_if(bad).alias(f"bad_{r}") for r, bad in rules.items()])
    i = images.groupBy(split).agg(F.count(F.lit(1)).alias("images"))
    return null_safe_join(i, b, [split], "left").withColumn("boxes_per_image", F.col("boxes") / F.col("images"))


# The checks of the annotation audit, over x, y, w, h, image size, area and class.
def box_rules(width: str, height: str, classes: list[str]) -> dict[str, Column]:
    c = F.col
    return {
        "degenerate": (c("w") <= 0) | (c("h") <= 0),
        "tiny": c("w") * c("h") < 4,
        "outside": (c("x") < 0) | (c("y") < 0) | (c("x") + c("w") > c(width)) | (c("y") + c("h") > c(height)),
        "area": c("area") <= 0,
        "unknown_class": ~c("class").isin(classes),
    }

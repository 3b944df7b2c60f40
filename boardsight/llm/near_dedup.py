"""Near-duplicate documents by b-bit MinHash.

A text's set holds its distinct shingles of ``width`` words. 128 minima of the set are taken;
bands of four of them give candidate keys, and of each minimum two bits are kept, packed into
four numbers. Two such signatures agree by chance in a quarter of the places; corrected for
that, the count of agreeing places estimates the similarity, and pairs far under the threshold
go without another look. The others are confirmed on their full sets.

At the threshold of 0.8 a pair shares none of the 32 bands once in twenty million, and its
estimate is five deviations over the mark. Nothing else is left out, and no group is expanded
into all its pairs: see ``link``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from boardsight.llm.common import appended, sized, small_batches, staged

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
SLACK = 0.22  # how far under the threshold an estimate may lie
RARE = 16  # sets that a shingle may be in to count as rare
BLOCK = 4096  # shingles hashed together
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB)]


@cache
def multipliers() -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(128)
    return r.integers(0, 2**63, (HASHES, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1), r.integers(0, 2**63, (HASHES, 1), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M[1]
    x = (x ^ (x >> np.uint64(27))) * _M[2]
    return x ^ (x >> np.uint64(31))


def shingles(text: bytes | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text in UTF-8: words are parted by ASCII blanks, A-Z lowered."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    n = min(width, len(words))
    out = np.full(len(words) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = mixed(out * _M[0] + h[k:len(h) - n + 1 + k])
    return np.unique(out)


def sketch(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Band keys, and two bits of each minimum in four numbers (low bits in the first two)."""
    a, b = multipliers()
    low = np.full(HASHES, 2**64 - 1, dtype=np.uint64)
    for at in range(0, len(s), BLOCK):
        low = np.minimum(low, (a * s[at:at + BLOCK] + b).min(axis=1))
    low = mixed(low)
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        keys = mixed(keys * _M[0] + row)
    bits = np.concatenate([low & np.uint64(1), low >> np.uint64(1) & np.uint64(1)]).astype(np.uint8)
    return keys.view(np.int64), np.packbits(bits).view(np.int64)


def sketched(texts: list, width: int) -> Iterator[tuple]:
    """Of each text in UTF-8: size of its set, two hashes of the whole set, packed bits and band keys."""
    for text in texts:
        s = shingles(text, width)
        if len(s):
            keys, bits = sketch(s)
            same = mixed(s * _M[1])
            yield len(s), int(np.bitwise_xor.reduce(same).view(np.int64)), int(np.add.reduce(same * _M[0]).view(np.int64)), bits.tolist(), keys.tolist()
        else:
            yield 0, 0, 0, None, None


def _sets(frames: Iterable[pd.DataFrame], width: int) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"id": frame["doc_id"], "shingles": [shingles(t, width).view(np.int64) for t in frame["text"]]})


def estimate(a: str, b: str) -> Column:
    """Similarity of two signatures, corrected for agreement by chance."""
    apart = sum((F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k))).bitwiseOR(F.get(a, F.lit(k + 2)).bitwiseXOR(F.get(b, F.lit(k + 2))))) for k in (0, 1)), F.lit(0))
    return ((1 - apart / HASHES) - 0.25) / 0.75


def components(edges: DataFrame) -> DataFrame:
    """``edges`` (a, b: ids) as (id, least): the least id that each of their ids reaches.

    Stars are merged until nothing changes: every id's greater neighbours are hung on its least
    one, then its smaller ones. A few rounds do for any shape; each is written, so none is
    worked out twice, and only the number and a checksum of the edges reach the driver.
    """
    e = staged(edges.filter("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = None
    while True:
        both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).union(e.select("lo", "hi"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        least = large.groupBy(F.col("hi").alias("u")).agg(F.min("lo").alias("m"))
        small = large.withColumnRenamed("hi", "u").join(least, "u")
        e = staged(small.select(F.greatest("lo", "m").alias("hi"), F.least("lo", "m").alias("lo")).union(small.select("u", "m")).filter("hi <> lo").distinct(), "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("hi", "lo").cast("decimal(20,0)"))).first()
        if tuple(now) == mark:
            return e.select(F.col("hi").alias("id"), F.col("lo").alias("least")).union(e.select("lo", "lo").distinct())
        mark = tuple(now)


def sets_of(docs: DataFrame, ids: DataFrame, width: int) -> DataFrame:
    """The full sets (id, shingles) of the documents with these ids, made anew from their texts."""
    wanted = staged(ids, "wanted")
    texts = docs.join(sized(wanted.withColumnRenamed("id", "__id"), 16), F.expr("doc_id = __id"), "left_semi")
    return staged(small_batches(texts).select("doc_id", F.col("text").cast("binary").alias("text")).mapInPandas(lambda f: _sets(f, width), "id long, shingles array<long>"), "sets")


def confirm(pairs: DataFrame, sets: DataFrame, threshold: int) -> DataFrame:
    """The pairs (a, b) whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return staged(both.filter(100 * common >= threshold * (F.size("sa") + F.size("sb") - common)).select("a", "b"), "links")


def rare_shingles(sets: DataFrame) -> DataFrame:
    """(s, id, n) of the shingles that at most ``RARE`` of these sets have."""
    each = sets.select("id", F.explode("shingles").alias("s"))
    few = each.groupBy("s").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") <= RARE)
    return staged(each.join(few, "s"), "rare")


def link(sketches: DataFrame, docs: DataFrame, threshold: int, width: int) -> DataFrame:
    """(id, least) of the representatives (doc_id, bits, bands) that are linked to others.

    First every member of a band's bucket is tried with the least id there. What is confirmed
    makes components. A bucket whose members are then all in one component holds nothing new.
    In the others, no pair stays untried unless its ends are already together or what their full
    sets can have in common is too little. That is no more than the lesser count of frequent
    shingles of the two, and the rare ones in common: pairs with any of those are found by a
    join on rare shingles, of a bounded number of rows each; pairs without are ruled out by the
    frequent ones alone. Texts changed at random have too few of these.
    """
    c = F.col
    keyed = sketches.select(c("doc_id").alias("id"), F.explode("bands").alias("band"))
    crowded = staged(keyed.groupBy("band").agg(F.min("id").alias("lead"), F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    members = staged(keyed.join(crowded, "band").select("band", "id", "lead"), "members")
    sigs = staged(sketches.join(members.select(c("id").alias("__i")).distinct(), F.expr("doc_id = __i"), "left_semi").select(c("doc_id").alias("id"), "bits"), "signatures")

    def likely(pairs: DataFrame) -> DataFrame:
        both = pairs.distinct().join(sigs.select(c("id").alias("a"), c("bits").alias("x")), "a").join(sigs.select(c("id").alias("b"), c("bits").alias("y")), "b")
        return staged(both.filter(estimate("x", "y") >= threshold / 100 - SLACK).select("a", "b"), "pairs")

    tried = likely(members.filter("id <> lead").select(c("lead").alias("a"), c("id").alias("b")))
    first = confirm(tried, sets_of(docs, tried.select(c("a").alias("id")).union(tried.select("b")).distinct(), width), threshold)
    stars = staged(components(first), "components")
    open_ = staged(_parted(members.select("band", "id"), stars), "open")
    sets = sets_of(docs, open_.select("id").distinct(), width)
    rare = rare_shingles(sets)
    # An id with several texts has the least size and counts all shingles of its largest as frequent.
    sizes = sets.groupBy("id").agg(F.min(F.size("shingles")).alias("size"), F.max(F.size("shingles")).alias("most"), F.count(F.lit(1)).alias("texts"))
    sizes = sizes.join(rare.groupBy("id").agg(F.count(F.lit(1)).alias("rare")), "id", "left")
    sizes = sizes.select("id", "size", (c("most") - F.when(c("texts") == 1, F.coalesce("rare", F.lit(0))).otherwise(0)).alias("often"))
    sizes = staged(open_.select("id", "part").distinct().join(sizes, "id"), "sizes")

    def possible(pairs: DataFrame, more: Column) -> DataFrame:
        """Pairs (a, b) of different components whose sets can be similar, with ``more`` in common beside frequent shingles."""
        of = lambda x: sizes.select(c("id").alias(x), c("part").alias(f"p{x}"), c("size").alias(f"n{x}"), c("often").alias(f"o{x}"))
        most = F.least("oa", "ob") + more
        both = pairs.join(of("a"), "a").join(of("b"), "b")
        return both.filter((c("pa") != c("pb")) & (100 * most >= threshold * (c("na") + c("nb") - most))).select("a", "b")

    met = rare.filter("n > 1").select("s", "id").distinct()
    met = met.withColumnRenamed("id", "a").join(met.withColumnRenamed("id", "b"), "s").filter("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"))
    able = open_.join(sizes.filter(100 * c("often") >= threshold * c("size")).select("id", "size", "often"), "id")
    able = staged(able.join(sketches.select(c("doc_id").alias("id"), "bands"), "id"), "able")
    strays = able.filter("part <> main").select("band", c("id").alias("a"), c("part").alias("pa"), c("size").alias("na"), c("often").alias("oa"), c("bands").alias("ba"))
    others = able.select("band", c("id").alias("b"), c("part").alias("pb"), "main", c("size").alias("nb"), c("often").alias("ob"), c("bands").alias("bb"))
    most = F.least("oa", "ob")
    # Two strays meet once, a stray and a member of the largest component once, and that in the first of their common bands.
    cross = strays.join(others, "band").filter("pa <> pb AND (pb = main OR a < b)").filter(100 * most >= threshold * (c("na") + c("nb") - most))
    cross = cross.filter(F.get(F.array_intersect("ba", "bb"), F.lit(0)) == c("band"))
    cross = cross.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    left = cross.union(possible(met, c("shared"))).distinct().join(tried, ["a", "b"], "left_anti")
    return components(stars.select(c("id").alias("a"), c("least").alias("b")).union(confirm(likely(left), sets, threshold)))


def _parted(members: DataFrame, stars: DataFrame) -> DataFrame:
    """``members`` (band, id) of buckets that hold several components, with their own (part) and the bucket's largest (main)."""
    placed = members.join(stars, "id", "left").withColumn("part", F.coalesce("least", "id")).drop("least")
    sizes = placed.groupBy("band", "part").agg(F.count(F.lit(1)).alias("n"))
    split = sizes.groupBy("band").agg(F.max_by("part", F.struct("n", "part")).alias("main"), F.count(F.lit(1)).alias("parts")).filter("parts > 1").drop("parts")
    return placed.join(split, "band")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: int = 80) -> DataFrame:
    """Columns doc_id, n_shingles, component_id and kept, one row for each row of ``docs``.

    Two texts are linked if 100 times their common shingles are ``threshold`` times those of
    either, or more. component_id is the least id reached over links, the own included; the row
    with that id is kept. A text of fewer than ``width`` words has one shingle, a null text or
    one without words none and no links. Rows of one id count as one document: each has the
    links of both. A row without an id is linked with nothing and kept.

    Texts of equal sets are first brought to the least id among them, by a partial aggregate, so
    a group of copies costs no more than its rows.
    """
    c = F.col
    docs = docs.select(c(doc_id).alias("doc_id"), c(text).alias("text"))
    rows = staged(appended(docs.select("doc_id", c("text").cast("binary").alias("text")), "text", lambda: lambda texts: sketched(texts, width),
                           "n_shingles long, h1 long, h2 long, bits array<long>, bands array<long>", drop=True), "sketches")
    full = rows.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    same = staged(full.groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")), "copies")
    reps = full.join(same.select("h1", "h2", c("rep").alias("doc_id")), ["h1", "h2", "doc_id"], "left_semi").dropDuplicates(["doc_id", "h1", "h2"])
    # An id with several texts has several sets: each stands for it.
    alike = full.join(same.filter("n > 1"), ["h1", "h2"]).filter("rep <> doc_id").select(c("rep").alias("a"), c("doc_id").alias("b"))
    linked = link(reps, docs, threshold, width)
    least = components(linked.select(c("id").alias("a"), c("least").alias("b")).union(alike))
    out = rows.select("doc_id", "n_shingles").join(least.select(c("id").alias("doc_id"), "least"), "doc_id", "left")
    component = F.coalesce("least", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(component == c("doc_id"), F.lit(True)).alias("kept"))

"""Benchmark decontamination: a prefix-filtered join of item windows with documents.

An item's windows are ``WINDOW`` consecutive words; its tokens for the join are word shingles.
Documents' shingles are matched to those of the benchmark, counted, and ordered by rarity. A
window that occurs has all its shingles there, so one of them, its rarest, is enough to find it:
that is its prefix. A match of the prefix gives a place; the place must lie in a stretch of
matched shingles long enough for the window; then every shingle of the window is compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, Window as W

from boardsight.llm.common import ascii_lower, sized, staged

WINDOW = 10
SHINGLE = 3
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Runs of letters and digits, and of whatever is not ASCII, with A-Z lowered."""
    return F.coalesce(F.regexp_extract_all(ascii_lower(text), F.lit(WORD), 0), F.array().cast("array<string>"))


def _runs(w: Column, size: int) -> Column:
    """All shingles of ``size`` words, in order, as text."""
    if size == 1:
        return w
    n = F.size(w)
    parts = [F.slice(w, k + 1, F.greatest(n - size + 1, F.lit(0))) for k in range(size)]
    return F.transform(F.arrays_zip(*[p.alias(f"w{k}") for k, p in enumerate(parts)]), lambda x: F.concat_ws(" ", *[x[f"w{k}"] for k in range(size)]))


def item_windows(benchmark: DataFrame, item_id: str, text: str, window: int) -> DataFrame:
    """A row for each distinct window text of each item: item, size (of its shingles), width (words), tokens (its shingles)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words(F.col(text)).alias("w")).filter(F.size("w") > 0)
    width = F.least(F.lit(window), F.size("w"))
    at = items.select("item", "w", width.alias("width"), F.explode(F.sequence(F.lit(1), F.size("w") - width + 1)).alias("at"))
    cut = at.select("item", "width", F.least(F.lit(SHINGLE), F.col("width")).alias("size"), F.slice("w", F.col("at"), F.col("width")).alias("w"))
    tokens = F.when(F.col("size") == 1, _runs(F.col("w"), 1))
    for k in range(2, SHINGLE + 1):
        tokens = tokens.when(F.col("size") == k, _runs(F.col("w"), k))
    return cut.select("item", "size", "width", tokens.alias("tokens")).distinct()


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
         item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Occurrences of item windows: doc_id, h (a hash of the text), start, width, item.

    Repeated rows of a document give its occurrences once. Items without words match nothing;
    an item with a null id matches, with a null item.
    """
    c = F.col
    windows = staged(item_windows(benchmark, item_id, item_text, window), "windows")
    known = staged(windows.select("size", F.explode("tokens").alias("token")).distinct().select("size", "token", F.xxhash64("token").alias("t")), "tokens")
    kinds = sorted(r["size"] for r in known.select("size").distinct().collect())  # 1, 2, 3 at most
    found = []
    for size in kinds:
        w = c("w")
        text_words = docs.select(c(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), words(c(text)).alias("w"))
        parts = [F.slice(w, k + 1, F.greatest(F.size(w) - size + 1, F.lit(0))).alias(f"w{k}") for k in range(size)]
        each = text_words.select("doc_id", "h", F.posexplode(F.arrays_zip(*parts)).alias("pos", "s"))
        token = F.concat_ws(" ", *[c("s")[f"w{k}"] for k in range(size)])
        match = each.select("doc_id", "h", "pos", token.alias("token")).join(
            sized(known.filter(c("size") == size).select("token", "t"), 64 + 16 * size), "token").select("doc_id", "h", "pos", "t").distinct()
        match = staged(match, "matches")
        # Rarity, over all documents; a window with a shingle that occurs nowhere is out.
        often = match.groupBy("t").agg(F.count(F.lit(1)).alias("n"))
        own = windows.filter(c("size") == size).select("item", "width", F.transform("tokens", lambda x: F.xxhash64(x)).alias("ts"))
        prefix = (own.select("width", "ts").distinct().select("width", "ts", F.posexplode("ts").alias("off", "t")).join(often, "t", "left")
                  .groupBy("width", "ts").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "t", "off")).alias("rarest"))
                  .filter("rarest.n > 0").select("width", "ts", c("rarest.t").alias("t"), c("rarest.off").alias("off")))
        prefix = staged(prefix, "prefixes")
        # Stretches of matched places, and what is matched around each place.
        by_doc = W.partitionBy("doc_id", "h").orderBy("pos")
        stretch = match.withColumn("run", c("pos") - F.row_number().over(by_doc))
        runs = W.partitionBy("doc_id", "h", "run")
        reach = window - size
        placed = (stretch.withColumn("first", F.min("pos").over(runs)).withColumn("last", F.max("pos").over(runs))
                  .withColumn("near", F.collect_list(F.struct("pos", "t")).over(by_doc.rangeBetween(-reach, reach))))
        tried = placed.join(sized(prefix, 200), "t").withColumn("start", c("pos") - c("off")).filter(
            (c("start") >= c("first")) & (c("start") + F.size("ts") - 1 <= c("last")))
        whole = F.forall(F.transform("ts", lambda x, i: F.struct((c("start") + i).alias("pos"), x.alias("t"))), lambda e: F.array_contains("near", e))
        sure = tried.filter(whole).select("doc_id", "h", "start", "width", "ts")
        found.append(sure.join(sized(own, 250), ["width", "ts"]).select("doc_id", "h", "start", "width", "item"))
    if not found:
        return docs.select(c(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.lit(0).alias("start"), F.lit(0).alias("width"), F.lit("").alias("item")).filter("false")
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each row of ``docs``: doc_id, h (a hash of the text), n_words, n_hit, n_items, items_sha256, contaminated.

    A word inside any occurrence of a window counts once in n_hit. n_items counts the items
    with ids that have occurring windows; items_sha256 digests those ids, sorted as text and
    joined by commas (of none: the digest of the empty text). A null text has no words.
    Repeated rows get repeated results; an empty benchmark finds nothing.
    """
    c = F.col
    got = staged(hits(docs, benchmark, doc_id, text, item_id, item_text, window), "hits")
    spans = got.groupBy("doc_id", "h", "start").agg(F.max(c("start") + c("width")).alias("end"))
    before = F.coalesce(F.max("end").over(W.partitionBy("doc_id", "h").orderBy("start").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    covered = spans.withColumn("new", F.greatest(F.lit(0), c("end") - F.greatest("start", before))).groupBy("doc_id", "h").agg(F.sum("new").alias("n_hit"))
    items = got.select("doc_id", "h", "item").distinct().groupBy("doc_id", "h").agg(F.sort_array(F.collect_set("item")).alias("items"))
    both = covered.join(items, covered["doc_id"].eqNullSafe(items["doc_id"]) & (covered["h"] == items["h"])).select(
        covered["doc_id"].alias("__d"), covered["h"].alias("__h"), "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    every = docs.select(c(doc_id).alias("doc_id"), F.xxhash64(text).alias("h"), F.size(words(c(text))).cast("long").alias("n_words"))
    none = F.sha2(F.lit(""), 256)
    return every.join(both, c("doc_id").eqNullSafe(c("__d")) & (c("h") == c("__h")), "left").select(
        "doc_id", "h", "n_words", F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"),
        F.coalesce("items_sha256", none).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"))

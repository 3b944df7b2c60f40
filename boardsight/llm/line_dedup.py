"""Lines that repeat, exactly or but for one edit: the earliest of them is kept.

Near pairs are found by a deletion-neighbourhood join. A line's variants within one edit are
itself, the line with a character wiped out, and the line without it; lines that share a
variant are at most one edit apart (a wiped-out character stands for a substitution, a missing
one for an insertion or deletion). Variants of whole lines would be as many as the text has
characters, so they are made only where a pair can be: one edit leaves all but one of a line's
equal stretches as they are, and lines that share no such rest with any other line are done.
Halves are tried for all lines, eighths for what is left, then the variants of one eighth.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from boardsight.llm.common import sized, staged

LEAST_CHARS = 20  # in shorter lines one edit makes another line: only exact repeats count there
FINE = 8


def _rest(line: Column, n: Column, length: Column, j: Column, parts: int) -> tuple[Column, Column, Column]:
    """Of stretch ``j`` of ``parts`` in a line of ``n`` characters, laid out for lines of ``length``: what is before, in it, and after."""
    start, end = F.floor(j * length / parts), F.floor((j + 1) * length / parts)
    after = length - end
    return F.substring(line, F.lit(1), start.cast("int")), F.substring(line, (start + 1).cast("int"), (n - after - start).cast("int")), F.substring(line, (n - after + 1).cast("int"), after.cast("int"))


def _places(parts: int) -> Column:
    """(length, j): each stretch of the line as it is, and laid out for lines one shorter."""
    return F.array(*[F.struct((F.col("n") - less).alias("length"), F.lit(j).alias("j")) for less in (0, 1) for j in range(parts)])


def _lines(docs: DataFrame) -> DataFrame:
    """Lines with something on them: doc_id, t (a hash of the text), pos, line and its hashes h1 and h2."""
    c = F.col
    each = docs.select("doc_id", F.xxhash64("text").alias("t"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line")).filter(F.trim("line") != "")
    return each.select("doc_id", "t", "pos", "line", F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), c("line")).alias("h2"))


def near_repeats(lines: DataFrame, uniq: DataFrame, docs: DataFrame) -> DataFrame:
    """Hashes (h1, h2) of the lines that follow a line at most one edit away.

    ``uniq`` (h1, h2, first, halves) has a row for each distinct line.
    """
    c = F.col
    halves = uniq.filter("halves IS NOT NULL").select("h1", "h2", "first", F.explode("halves").alias("key"))
    common = staged(halves.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key"), "halves")
    maybe = staged(halves.join(sized(common, 16), "key", "left_semi").select("h1", "h2", "first").distinct(), "maybe")
    # The text of these lines, from where each stands first.
    wanted = staged(maybe.select(c("first.doc_id").alias("__d")).distinct(), "holders")
    held = _lines(docs.join(sized(wanted, 16), F.expr("doc_id <=> __d"), "left_semi"))
    spots = maybe.select(c("h1").alias("m1"), c("h2").alias("m2"), "first")
    texts = held.join(sized(spots, 64), F.expr("h1 = m1 AND h2 = m2 AND pos = first.pos AND doc_id <=> first.doc_id")).select("h1", "h2", "first", "line")
    texts = staged(texts.dropDuplicates(["h1", "h2"]).withColumn("n", F.length("line")), "texts")
    fine = texts.select("h1", "h2", "first", "n", "line", F.explode(_places(FINE)).alias("at"))
    before, middle, after = _rest(c("line"), c("n"), c("at.length"), c("at.j"), FINE)
    fine = fine.select("h1", "h2", "first", "n", c("at.length").alias("length"), middle.alias("middle"), F.xxhash64("at.length", "at.j", before, after).alias("key"))
    shared = staged(fine.groupBy("key").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("key"), "eighths")
    close = fine.join(sized(shared, 16), "key", "left_semi")
    # Variants. A line one longer than ``length`` only loses a character here; one of that length has one wiped out, or stays.
    places = F.when(F.length("middle") > 0, F.sequence(F.lit(1), F.length("middle"))).otherwise(F.array().cast("array<int>"))
    without = lambda i: F.concat(F.substring(c("middle"), F.lit(1), i - 1), F.substring(c("middle"), i + 1, F.length("middle")))
    longer = c("n") > c("length")
    variants = F.when(longer, F.transform(places, lambda i: F.xxhash64(c("key"), F.lit(0), without(i)))).otherwise(
        F.concat(F.transform(places, lambda i: F.xxhash64(c("key"), i, without(i))), F.array(F.xxhash64(c("key"), F.lit(0), c("middle")))))
    line = F.struct(c("first.doc_id").alias("doc_id"), c("first.pos").alias("pos"), "h1", "h2")
    each = staged(close.select(line.alias("me"), longer.alias("longer"), F.explode(F.array_distinct(variants)).alias("variant")), "variants")
    # In a bucket all of one length are one substitution apart; a longer one is an insertion away from the single shorter one.
    met = each.groupBy("variant").agg(F.count(F.lit(1)).alias("k"), F.min(F.when(~c("longer"), c("me"))).alias("short"), F.min(F.when(c("longer"), c("me"))).alias("long")).filter("k > 1")
    pairs = each.join(met, "variant")
    other = F.when(c("longer"), c("short")).when(c("long").isNull(), c("short")).otherwise(c("long"))
    pairs = pairs.select("me", other.alias("other")).filter("other < me").select(
        c("me.h1").alias("h1"), c("me.h2").alias("h2"), c("other.h1").alias("o1"), c("other.h2").alias("o2")).distinct()
    both = pairs.join(texts.select("h1", "h2", c("line").alias("mine")), ["h1", "h2"]).join(texts.select(c("h1").alias("o1"), c("h2").alias("o2"), c("line").alias("theirs")), ["o1", "o2"])
    return both.filter(F.levenshtein("mine", "theirs", 1) >= 0).select("h1", "h2").distinct()


def drops(docs: DataFrame) -> DataFrame:
    """Lines to drop: doc_id, t (a hash of the text) and their places, for the texts that have any."""
    c = F.col
    lines = _lines(docs)
    n = F.length("line")
    keys = F.transform(_places(2), lambda p: F.xxhash64(p["length"], p["j"], F.when(p["j"] == 0, F.substring(c("line"), (n - (p["length"] - F.floor(p["length"] / 2)) + 1).cast("int"), (p["length"] - F.floor(p["length"] / 2)).cast("int")))
                       .otherwise(F.substring(c("line"), F.lit(1), F.floor(p["length"] / 2).cast("int")))))
    keyed = lines.withColumn("n", n).select("doc_id", "pos", "h1", "h2", F.when(c("n") >= LEAST_CHARS, keys).alias("halves"))
    uniq = keyed.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "pos")).alias("first"), F.count(F.lit(1)).alias("times"), F.first("halves").alias("halves"))
    uniq = staged(uniq, "lines")
    near = near_repeats(lines, uniq, docs)
    # What is left of each line that repeats: its first place, or none if an earlier line is near.
    repeated = uniq.filter("times > 1").select("h1", "h2", c("first.doc_id").alias("d"), c("first.pos").alias("p"))
    single = near.select("h1", "h2", F.lit(None).cast("long").alias("d"), F.lit(-1).alias("p"))
    stays = staged(repeated.unionByName(single).groupBy("h1", "h2").agg(F.min_by("d", "p").alias("d"), F.min("p").alias("p")), "stays")
    gone = lines.join(sized(stays, 48), ["h1", "h2"]).filter(~((c("pos") == c("p")) & c("doc_id").eqNullSafe(c("d"))))
    return gone.groupBy("doc_id", "t").agg(F.sort_array(F.collect_set("pos")).alias("places"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of the texts, and n_lines and n_dropped added; n_chars, if there, follows.

    A line goes if an earlier one, by id of its document and place in it, is equal to it or, from
    ``LEAST_CHARS`` characters on, one edit away (itself kept or not). Blank lines stay. Every
    document stays, with an empty text if all its lines went; a null text stays null, with no
    lines. Null ids come before all others. Repeated rows stand at the same places, so they keep
    the same lines; rows of one id with different texts are ordered by place, then by a hash of the line.
    """
    c = F.col
    keys = docs.select(c(doc_id).alias("doc_id"), c(text).alias("text"))
    out = staged(drops(keys), "drops").select(c("doc_id").alias("__d"), c("t").alias("__t"), c("places").alias("__places"))
    docs = docs.drop("n_lines", "n_dropped")
    marked = docs.withColumn("__h", F.xxhash64(text)).join(out, F.expr(f"`{doc_id}` <=> __d AND __h = __t"), "left")
    lines = F.split(c(text), "\n", -1)
    kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), c("__places"))
    new = F.when(c("__places").isNull() | c(text).isNull(), c(text)).otherwise(F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n"))
    result = marked.withColumn("n_lines", F.when(c(text).isNull(), 0).otherwise(F.size(lines)).cast("long")).withColumn("n_dropped", F.coalesce(F.size("__places"), F.lit(0)).cast("long"))
    result = result.withColumn(text, new)
    if "n_chars" in docs.columns:
        result = result.withColumn("n_chars", F.length(text).cast("long"))
    return result.select(*[c(f"`{x}`") for x in docs.columns], "n_lines", "n_dropped")

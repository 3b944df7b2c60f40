"""Mixing sources to target weights by Pfair scheduling.

Each source's rows are cut into blocks of ``block_rows``, in a random order that a seed fixes.
With weight w, block i may be placed from slot floor(i / w) on and must be placed before slot
ceil((i + 1) / w); every slot goes to the waiting block with the earliest deadline. At any slot
each source is then less than one block away from its share, until it runs dry. A source that
ends early leaves its slots empty and the others in proportion; the mixture ends when the sources
that have run dry held more than ``ENDED_PERCENT`` of the slots.

Weights are whole numbers of slots in a period, so the schedule repeats: one period is worked
out by a fold in SQL over the (few) sources, and each block finds its slot by arithmetic.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F, Window as W

from boardsight.llm.common import sized, staged

PERIOD = 1000  # slots; a weight is rounded to a whole number of them, one at least
BLOCK_ROWS = 16
STRETCH_ROWS = 4096  # rows of a source ranked in one task
ENDED_PERCENT = 5  # of the slots, that sources may have held which have run dry, before the mixture ends


def target_weights(counts: DataFrame, source: str = "source", rows: str = "n", power: float = 0.7, period: int = PERIOD) -> DataFrame:
    """Slots of each source in a period: its rows to ``power`` (under 1: small sources get more than their share).

    Largest remainders get what rounding down leaves over, so the slots of a period are all given
    away. A period is ``period`` slots, or so many times that as leaves one for each source.
    Columns: source, q (slots), period.
    """
    c = F.col
    every = W.partitionBy()
    sized = counts.select(c(source).alias("source"), F.pow(c(rows).cast("double"), power).alias("w"), F.count(F.lit(1)).over(every).alias("sources"))
    period_of = F.lit(period) * (1 + F.floor(c("sources") / period))
    share = sized.select("source", period_of.alias("period"), (1 + F.floor(c("w") / F.sum("w").over(every) * (period_of - c("sources")))).cast("long").alias("least"),
                         (c("w") / F.sum("w").over(every) * (period_of - c("sources"))).alias("exact"))
    left = c("period") - F.sum("least").over(every)
    order = F.row_number().over(W.partitionBy().orderBy(F.round(c("exact") - F.floor("exact"), 9).desc(), c("source").asc_nulls_first()))
    return share.select("source", (c("least") + F.when(order <= left, 1).otherwise(0)).alias("q"), "period")


def one_period(weights: DataFrame) -> DataFrame:
    """The slots of one period: source, k (which of its blocks in the period), at (the slot).

    ``weights`` has a row a source: source, q, period. Slot t goes to the source whose next block
    is released (floor(k * period / q) <= t) and has the earliest deadline
    (ceil((k + 1) * period / q)); of equal ones, the first by name, null first.
    """
    c = F.col
    listed = weights.agg(F.array_sort(F.collect_list(F.struct(c("source").isNotNull().alias("known"), "source", "q"))).alias("s"), F.max("period").alias("period"))
    start = F.struct(F.transform("s", lambda x: F.lit(0).cast("long")).alias("given"), F.array().cast("array<int>").alias("turns"))

    def step(state, t):
        choice = F.array_min(F.filter(F.transform(c("s"), lambda x, i: F.struct(
            F.when((F.get(state["given"], i) < x["q"]) & (F.floor(F.get(state["given"], i) * c("period") / x["q"]) <= t),
                   F.ceil((F.get(state["given"], i) + 1) * c("period") / x["q"])).alias("due"), i.cast("int").alias("i"))), lambda x: x["due"].isNotNull()))
        return F.struct(F.transform(state["given"], lambda g, i: F.when(i == choice["i"], g + 1).otherwise(g)).alias("given"),
                        F.concat(state["turns"], F.array(F.coalesce(choice["i"], F.lit(-1)))).alias("turns"))

    turns = listed.filter("period IS NOT NULL").select("s", F.posexplode(F.aggregate(F.sequence(F.lit(0).cast("long"), c("period").cast("long") - 1), start, step, lambda x: x["turns"])).alias("at", "i"))
    k = F.row_number().over(W.partitionBy("i").orderBy("at")) - 1
    return turns.filter("i >= 0").select(F.get("s", c("i"))["source"].alias("source"), k.cast("long").alias("k"), c("at").cast("long").alias("at"))


def by_source(table: DataFrame, name: str, source: str) -> DataFrame:
    """``table`` written once, and marked for broadcast if its rows times its longest row fit."""
    table = staged(table, name)
    longest = table.agg(F.max(F.octet_length(F.col(source).cast("string")))).first()[0] or 0
    return sized(table, longest + 64)


def mix(docs: DataFrame, weights: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text", source: str = "source",
        block_rows: int = BLOCK_ROWS, seed: int = 7, stretch_rows: int = STRETCH_ROWS, ended_percent: int = ENDED_PERCENT) -> DataFrame:
    """``docs`` with their place in the mixture: mix_block, mix_slot, mix_row and in_mix; sort by mix_slot, mix_row.

    Every row comes back once. ``in_mix`` marks the full blocks in slots before the mixture ends, that is
    while the sources that have run dry held no more than ``ended_percent`` of the slots; rows of
    sources that have more than their weight follow after it. A null source is a source. Places go by a
    digest of id and text, so rows of one id, or of none, are spread; repeated rows take neighbouring places. Names of the added columns that ``docs`` has already are replaced.

    A source may hold most rows: it is ranked in stretches of hash order of about
    ``stretch_rows``, each with the count of those before it.
    """
    c = F.col
    docs = docs.drop("mix_block", "mix_slot", "mix_row", "in_mix")
    # 60 bits of a digest that other engines compute alike; a null id and a null text have digests of their own.
    own = F.coalesce(F.md5(c(text)), F.lit("null"))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(c(doc_id).cast("string"), F.lit("null")), F.lit(":"), own))
    keyed = docs.withColumn("__h", F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"))
    counts = docs.groupBy(c(source).alias("source")).agg(F.count(F.lit(1)).alias("n"))
    weights = target_weights(counts) if weights is None else weights
    period = by_source(one_period(weights).select(c("source").alias("__p"), c("k").alias("__k"), c("at").alias("__at")), "period", "__p")
    # Stretches: equal ranges of the digest, as many for each source as its rows ask for. A source is dry at
    # the slot where its first block that is not full would stand.
    full = F.floor(c("n") / block_rows)
    plan = (counts.join(weights.withColumnRenamed("source", "__w"), F.expr("source <=> __w"))
            .join(period, c("source").eqNullSafe(c("__p")) & (full % c("q") == c("__k")))
            .select(c("source").alias("__source"), c("q").alias("__q"), c("period").alias("__period"), F.ceil(c("n") / stretch_rows).alias("__stretches"), full.alias("__full"),
                    (F.floor(full / c("q")) * c("period") + c("__at")).alias("__ends")))
    plan = plan.withColumn("__ended", F.sum("__q").over(W.partitionBy().orderBy("__ends")))
    over = F.min(F.when(100 * c("__ended") > ended_percent * c("__period"), c("__ends"))).over(W.partitionBy())
    plan = plan.withColumn("__dry", F.coalesce(over, F.max("__ends").over(W.partitionBy()))).drop("__ends", "__ended")
    placed = keyed.join(by_source(plan, "mixture", "__source"), c(source).eqNullSafe(c("__source"))).withColumn("__stretch", F.floor(c("__h") / F.lit(2.0**60) * c("__stretches")))
    sizes = placed.groupBy("__source", "__stretch").agg(F.count(F.lit(1)).alias("size"))
    before = sizes.select(c("__source").alias("__s"), c("__stretch").alias("__t"), (F.sum("size").over(W.partitionBy("__source").orderBy("__stretch")) - c("size")).alias("__before"))
    placed = placed.withColumn("__tie", F.xxhash64(text))
    within = F.row_number().over(W.partitionBy("__source", "__stretch").orderBy("__h", c(doc_id), "__tie"))
    ranked = placed.withColumn("__within", within).join(before, F.expr("__source <=> __s AND __stretch = __t"))
    rank = c("__before") + c("__within") - 1
    blocked = ranked.withColumn("mix_block", F.floor(rank / block_rows)).withColumn("mix_row", (rank % block_rows).cast("int"))
    slotted = blocked.join(period, F.expr("__source <=> __p AND mix_block % __q = __k"))
    return slotted.withColumn("mix_slot", F.floor(c("mix_block") / c("__q")) * c("__period") + c("__at")).select(
        *[c(f"`{x}`") for x in docs.columns], "mix_block", "mix_slot", "mix_row", ((c("mix_slot") < c("__dry")) & (c("mix_block") < c("__full"))).alias("in_mix"))

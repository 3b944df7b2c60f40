"""From raw documents to a mixed training corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the ``docs`` of the next. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from boardsight.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from boardsight.llm.common import sized, staged

#: Texts with this probability of being toxic, or more, go.
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not toxic, by a model of the labels; null and empty texts stay."""
    model = toxicity.learn(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model, name="__toxic").filter(F.col("__toxic") < TOXIC).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that an earlier document or line has already."""
    return line_dedup.dedup_lines(docs).select(*docs.columns)


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: that with the least id. Those without words stay."""
    groups = near_dedup.near_duplicates(docs, width=5, threshold=80)
    gone = staged(groups.filter("NOT kept").select(F.col("doc_id").alias("__gone")).distinct(), "gone")
    return docs.join(sized(gone, 8), F.expr("doc_id = __gone"), "left_anti")


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    hits = decontaminate.hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaks = staged(hits.select(F.col("doc_id").alias("__d"), F.col("h").alias("__h")).distinct(), "leaks")
    return docs.join(sized(leaks, 16), F.expr("doc_id <=> __d AND xxhash64(text) = __h"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their place in the mixture of sources; sort by mix_slot, mix_row."""
    return mixing.mix(docs)


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_lines), ("near_dedup", drop_near), ("decontaminate", drop_leaks), ("mix_sources", mix)]

#: SQL can't express the learnt stage; the tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared checkpoint folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

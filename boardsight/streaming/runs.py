"""Run a stream over the files there are and read what it wrote."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from boardsight.core.runtime import ensure_checkpoint_dir


def new_folder(spark: SparkSession, name: str) -> str:
    """A new place in the shared checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4()}"


def read_table_stream(spark: SparkSession, folder: str, files: str, files_per_trigger: int = 100) -> DataFrame:
    """The stored files of a folder that match ``files``, as a stream."""
    schema = spark.read.parquet(f"{folder}/{files}").schema
    return (spark.readStream.schema(schema).option("pathGlobFilter", files)
            .option("maxFilesPerTrigger", files_per_trigger).parquet(folder))


def drain(stream: DataFrame) -> DataFrame:
    """All rows an append stream gives for the input there is now, written to
    and read from the shared checkpoint folder."""
    spark = stream.sparkSession
    base = new_folder(spark, "stream")
    query = (stream.writeStream.format("parquet").option("path", f"{base}/rows").option("checkpointLocation", f"{base}/state")
             .outputMode("append").trigger(availableNow=True).start())
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/rows")


ROWS_IN_A_FILE = 50_000


def replay(df: DataFrame, ts: str, files: int = 1, newest_first: bool = False, files_per_trigger: int = 1, final: str = "2999-01-01",
           rows_in_a_file: int = ROWS_IN_A_FILE) -> DataFrame:
    """``df`` as a stream of ``files`` landings, cut by ``ts`` and coming one after another, the newest rows first if asked for.

    A big landing is several files, as many for each and taken together, so that no task writes it alone.
    The last one holds one row with nothing but the time ``final``: it moves the watermark past all others.
    """
    spark = df.sparkSession
    path, staged = new_folder(spark, "replay"), new_folder(spark, "landings")
    kind = df.schema[ts].dataType
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    low, high = df.agg(F.min(us), F.max(us)).first()
    part = F.least(F.lit(files - 1), F.floor((us - F.lit(low)) * files / F.lit(max(1, (high or 0) - (low or 0))))) if low is not None else F.lit(0)
    # what makes the rows runs once, in as many tasks as it likes
    df.withColumn("_part", F.coalesce(part, F.lit(0)).cast("int")).write.parquet(staged)
    landed = spark.read.schema(T.StructType([*df.schema.fields, T.StructField("_part", T.IntegerType())])).parquet(staged)
    sizes = [r["count"] for r in landed.groupBy("_part").count().collect()]  # no more than there are landings
    n = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(1, min(sizes, default=0) // rows_in_a_file))
    for k in sorted(range(files), reverse=newest_first):
        rows = landed.filter(F.col("_part") == k).drop("_part")
        (rows.repartition(n) if n > 1 else rows.coalesce(1)).write.mode("append").parquet(path)
    tick = spark.range(1).select(*[F.lit(final).cast("timestamp").cast(kind).alias(c) if c == ts else F.lit(None).cast(df.schema[c].dataType).alias(c) for c in df.columns])
    tick.coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files_per_trigger * n).parquet(path)

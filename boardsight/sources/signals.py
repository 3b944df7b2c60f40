"""Signal tables: read, append, archive, drop."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from boardsight import schemas
from boardsight.functions import signals as fn


def split_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(rows breaking no rule, rows with the first ``reason`` that applies)."""
    reason = F.coalesce(*[F.when(broken, F.lit(name)) for name, broken in rules.items()])
    tagged = df.withColumn("reason", reason)
    return tagged.filter(F.col("reason").isNull()).drop("reason"), tagged.filter(F.col("reason").isNotNull())


def read_signals(spark: SparkSession, path: str, pipe: str, start=None, end=None,
                 renames: dict[str, str] | None = None, range_id: str | None = None) -> DataFrame:
    """One pipe's signals, columns named, NaN measures read as null. Time
    bounds also prune the ``day`` partitions the writer lays down."""
    schema = schemas.SIGNALS[pipe]
    parts = [T.StructField("day", T.DateType())]
    if range_id is not None:
        parts.insert(0, T.StructField("range_id", T.StringType()))
    df = spark.read.schema(T.StructType(schema.fields + parts)).parquet(path)
    if range_id is not None:
        df = df.filter(F.col("range_id") == range_id)
    if start is not None:
        df = df.filter((F.col("day") >= F.to_date(F.lit(start))) & (F.col("timestamp") >= F.lit(start)))
    if end is not None:
        df = df.filter((F.col("day") <= F.to_date(F.lit(end))) & (F.col("timestamp") <= F.lit(end)))
    renames = renames or {}
    clean = {m: F.nanvl(F.col(m), F.lit(None).cast("double")) for m in schemas.MEASURES[pipe]}
    return df.select(*[clean.get(c, F.col(c)).alias(renames.get(c, c)) for c in schema.names])


def stamp(df: DataFrame, pipe: str, ts: str = "timestamp") -> DataFrame:
    """Rows as the store takes them: signal key as id, partition day."""
    axis = F.col("axis") if pipe == "motion" else None
    key = fn.x_signal_key(F.lit(pipe), F.col("description"), F.col("isCmd"), axis)
    return df.withColumn("id", key).withColumn("day", F.to_date(F.col(ts)))


def write_rows(df: DataFrame, path: str, mode: str = "append", by: tuple[str, ...] = ("day",)) -> None:
    """Append rows, one sorted run per day and id so row groups prune. Writers
    spread each day over many tasks: hashing on day alone would put a busy day
    in one."""
    sort = [c for c in ("id", "timestamp") if c in df.columns]
    spread = df.repartitionByRange(*by, *sort)
    (spread.sortWithinPartitions(*by, *sort).write.mode(mode).partitionBy(*by).parquet(path))


def write_signals(stream: DataFrame, path: str, checkpoint: str, pipe: str,
                  trigger: str | dict = "1 second"):
    """Append a stream of signals; the trigger is the batch age (or any
    trigger by name), the row bound is the source's own rate option. Returns
    the running query."""
    return (stamp(stream, pipe).writeStream.format("parquet").partitionBy("day")
            .option("path", path).option("checkpointLocation", checkpoint)
            .trigger(**(trigger if isinstance(trigger, dict) else {"processingTime": trigger})).outputMode("append").start())


def archive_session(df: DataFrame, range_id: str, ts: str = "timestamp") -> DataFrame:
    """S3: the live rows as one session's snapshot."""
    return df.withColumns({"range_id": F.lit(range_id), "day": F.to_date(F.col(ts))})


def write_archive(df: DataFrame, path: str, range_id: str, ts: str = "timestamp") -> None:
    """S3: store a snapshot; writing the same session again replaces it."""
    spark = df.sparkSession
    snapshot = archive_session(df, range_id, ts)
    sort = [c for c in ("id", ts) if c in df.columns]
    (snapshot.repartitionByRange("day", *sort).sortWithinPartitions("day", *sort)
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("range_id", "day").parquet(path))


def drop_session(table: DataFrame, range_id: str | None = None, start=None, end=None,
                 ts: str = "timestamp") -> DataFrame:
    """The table without one session's rows, or without a time span, or
    empty when neither is named."""
    gone = []
    if range_id is not None:
        gone.append(F.col("range_id").eqNullSafe(F.lit(range_id)))
    if start is not None:
        gone.append(F.coalesce(F.col(ts) >= F.lit(start), F.lit(False)))
    if end is not None:
        gone.append(F.coalesce(F.col(ts) <= F.lit(end), F.lit(False)))
    if not gone:
        return table.limit(0)
    return table.filter(~reduce(lambda a, b: a & b, gone))


def time_range(df: DataFrame, ts: str, start, end, closed: str = "both") -> DataFrame:
    """``[start, end]`` or, with ``closed='left'``, ``[start, end)``. The
    bounds are cast to the column's own type so the filter reaches the scan."""
    kind = df.schema[ts].dataType
    lo, hi = F.lit(start).cast(kind), F.lit(end).cast(kind)
    upper = F.col(ts) <= hi if closed == "both" else F.col(ts) < hi
    return df.filter((F.col(ts) >= lo) & upper)


def to_sample(df: DataFrame, pipe: str, ts: str = "timestamp") -> DataFrame:
    """the uniform (key, ts_ms, value) sample of one pipe's rows."""
    c = F.col
    value = {
        "motion": lambda: fn.x_motion_value(c("isCmd"), c("value")),
        "safety": lambda: fn.x_safety_value(c("state")),
        "onvif": lambda: fn.x_picture_value(c("description"), c("zoom"), c("measurement")),
    }[pipe]()
    axis = c("axis") if pipe == "motion" else None
    return df.select(fn.x_signal_key(F.lit(pipe), c("description"), c("isCmd"), axis).alias("key"),
                     fn.x_epoch_ms(c(ts)).alias("ts_ms"), value.alias("value"))


def project(df: DataFrame, schema: T.StructType) -> DataFrame:
    """exactly the columns and types of ``schema``."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])

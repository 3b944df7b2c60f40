"""Label, manifest, timing and log files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from boardsight.core.ordered import Ordered
from boardsight.functions import text as tx

LOG_FIELDS = ("time", "level", "service", "logger", "message")


def parse_logs(lines: DataFrame, column: str = "value") -> DataFrame:
    """Log records of JSON lines. Lines that are blank, unreadable or have
    no text message are dropped; level and service get defaults; every other
    field stays, as JSON text per name, in ``fields``."""
    obj = F.try_parse_json(F.trim(F.col(column)))
    rows = lines.filter(F.trim(F.col(column)) != "").withColumn("_v", obj).filter(F.col("_v").isNotNull())

    def text(name: str):
        # only a JSON string counts as that field's text
        typed = F.schema_of_variant(F.try_variant_get("_v", f"$.{name}", "variant")) == "STRING"
        return F.when(typed, F.try_variant_get("_v", f"$.{name}", "string"))

    whole = F.try_variant_get("_v", "$", "map<string,variant>")
    rest = F.map_filter(whole, lambda k, _: ~k.isin(*LOG_FIELDS))
    plain = F.transform_values(rest, lambda _, v: F.to_json(v))
    others = [c for c in lines.columns if c != column]
    return rows.select(
        *others,
        F.coalesce(text("time"), F.lit("")).alias("time"),
        F.coalesce(text("level"), F.lit("info")).alias("level"),
        F.coalesce(text("service"), F.lit("unknown")).alias("service"),
        text("logger").alias("logger"), text("message").alias("message"), plain.alias("fields"),
    ).filter(F.col("message").isNotNull())


def read_logs(spark: SparkSession, glob: str | list[str]) -> DataFrame:
    """The log files of any number of services."""
    lines = spark.read.text(glob).select("value", F.col("_metadata.file_path").alias("path"))
    return parse_logs(lines)


def merge_logs(*logs: DataFrame) -> DataFrame:
    """D7."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), logs)


def parse_labels(lines: DataFrame, column: str = "value") -> DataFrame:
    """One row per label line: its centroid, whether it is a box, whether it
    is damaged (under four values, or an odd number of them)."""
    rows = lines.withColumn("_t", F.trim(F.regexp_replace(F.col(column), r"\s+", " "))).filter("_t <> ''")
    words = F.split("_t", " ")
    rows = rows.withColumns({"class": words[0].try_cast("int"),
                             "_n": F.size(words) - 1,
                             "_v": F.transform(F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
                                               lambda w: w.try_cast("double"))})
    pairs = F.floor(F.col("_n") / 2).cast("int")
    def every_other(odd: int):
        places = F.filter(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: (i % 2 == odd) & (i < pairs * 2))
        return F.transform(places, lambda i: F.try_element_at(F.col("_v"), i.cast("int") + 1))

    halves = [every_other(0), every_other(1)]

    def mean(values):
        return F.aggregate(values, F.lit(0.0), lambda a, v: a + v) / pairs

    readable, box = F.col("_n") >= 4, F.col("_n") == 4
    return rows.withColumns({
        "damaged": (F.col("_n") < 4) | (F.col("_n") % 2 == 1),
        "is_box": box,
        "x": F.when(box, F.col("_v")[0]).when(readable, mean(halves[0])),
        "y": F.when(box, F.col("_v")[1]).when(readable, mean(halves[1])),
    }).drop("_t", "_n", "_v", column)


def read_labels(spark: SparkSession, glob: str) -> DataFrame:
    """Label lines with the file they are from."""
    return parse_labels(spark.read.text(glob).select("value", F.col("_metadata.file_path").alias("path")))


def label_damage(labels: DataFrame, keys: list[str]) -> DataFrame:
    """Labels and damaged lines per file."""
    return labels.groupBy(*keys).agg(F.count_if(F.col("x").isNotNull()).alias("labels"),
                                     F.count_if("damaged").alias("damaged"))


def read_labels_strict(spark: SparkSession, glob: str) -> DataFrame:
    """As ``read_labels``, but a damaged line fails the read."""
    return refuse_damaged(read_labels(spark, glob))


def strict_labels(labels: DataFrame, by: str = "path") -> tuple[DataFrame, DataFrame]:
    """The labels of the files without a damaged line, and the refused files
    with how many of their lines are damaged."""
    refused = labels.groupBy(by).agg(F.count_if("damaged").alias("damaged_lines")).filter("damaged_lines > 0")
    marks = refused.select(F.col(by).alias("_refused"))
    return labels.join(marks, F.col(by).eqNullSafe(F.col("_refused")), "left_anti"), refused


def refuse_damaged(labels: DataFrame) -> DataFrame:
    """Fail the job on the first damaged line."""
    refused = F.raise_error(F.concat(F.lit("damaged label line in "), F.coalesce("path", F.lit("input"))))
    flag = F.when(F.col("damaged"), refused.cast("boolean")).otherwise(F.lit(True))
    return labels.filter(flag)


MANIFEST_ENTRY = "file string, capture_setup string, fps double, window array<double>, never_trained boolean"


def parse_manifest(df: DataFrame, column: str = "value") -> DataFrame:
    """One row per recording of a manifest text keyed by content hash."""
    entries = F.from_json(F.col(column), f"map<string, struct<{MANIFEST_ENTRY.replace(' ', ':').replace(',:', ',')}>>")
    return df.select(F.explode(entries).alias("sha256", "entry")).select("sha256", "entry.*")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """S10."""
    return parse_manifest(spark.read.text(path, wholetext=True))


def hash_files(spark: SparkSession, glob: str) -> DataFrame:
    """Content hash of each file."""
    return (spark.read.format("binaryFile").load(glob)
            .select("path", F.sha2("content", 256).alias("sha256")))


def with_setup(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Manifest fields by content hash; unlisted files keep nulls."""
    return files.join(manifest, "sha256", "left")


def trainable(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """every file but those the manifest marks as never trained on."""
    return with_setup(files, manifest).filter(~F.coalesce("never_trained", F.lit(False)))


def read_timing(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A timing table with ``#`` comment lines; an empty cell is a stage
    that was not reached."""
    schema = ", ".join(f"`{c}` {'int' if c == 'frame' else 'boolean' if c == 'registered' else 'double'}" for c in columns)
    return spark.read.schema(schema).option("comment", "#").option("header", True).csv(path)


def truth_hash(files: DataFrame, skip: list[str], keys: list[str], name: str = "name", content: str = "content",
               photograph: str | None = None) -> DataFrame:
    """One digest per folder over its files in order of name, each as its
    name, a zero byte, its bytes and a zero byte, then over its photographs
    (``photograph``: a column that numbers them, null for other files). Files in
    ``skip`` and hidden ones are left out.

    One digest is one stream of bytes, so a folder is read by one task; its
    files pass through in sorted batches and are never gathered.
    """
    keys = list(keys)
    place = F.col(photograph) if photograph else F.lit(None).cast("int")
    kept = files.select(*keys, F.col(name).alias("_name"), F.col(content).cast("binary").alias("_bytes"), place.alias("_photo"))
    kept = kept.filter(F.col("_photo").isNotNull() | (~F.col("_name").isin(skip) & ~F.col("_name").startswith(".")))
    dealt = kept.repartition(*[F.col(k) for k in keys]).sortWithinPartitions(*keys, F.col("_photo").asc_nulls_first(), F.col("_name").cast("binary"))
    kinds = [kept.schema[k] for k in keys]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, digest = None, None
        done: list[tuple] = []
        for batch in batches:
            for *key, label, data, _ in zip(*[batch.column(c).to_pylist() for c in batch.schema.names], strict=True):
                if digest is None or key != at:
                    if digest is not None:
                        done.append((*at, digest.hexdigest()))
                    at, digest = key, hashlib.sha256()
                digest.update(label.encode() + b"\0" + (data or b"") + b"\0")
        if digest is not None:
            done.append((*at, digest.hexdigest()))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in done], to_arrow_type(f.dataType)) for i, f in enumerate(schema)], names=schema.names)

    schema = T.StructType([*kinds, T.StructField("truth_hash", T.StringType())])
    return dealt.mapInArrow(run, schema)


def fingerprint(files: DataFrame, skip: list[str], keys: list[str] = (), name: str = "name",
                content: str = "content", per_chunk: int = 10_000) -> DataFrame:
    """One hash per folder over its sorted (name, content) pairs, without
    the files in ``skip`` and hidden ones. Files are hashed where they are read,
    their hashes chunk by chunk, so no task gathers a whole folder."""
    keys = list(keys)
    kept = files.filter(~F.col(name).isin(skip) & ~F.col(name).startswith("."))
    hashed = kept.select(*keys, F.col(name).alias("_n"), F.sha2(F.col(content).cast("binary"), 256).alias("_h"))
    placed = Ordered(hashed, keys, ["_n"]).row_number("_i").done().withColumn("_c", F.floor((F.col("_i") - 1) / per_chunk))
    listed = lambda order, text: F.sha2(F.array_join(F.transform(
        F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("t")))), lambda s: s["t"]), "\n"), 256)
    chunks = placed.groupBy(*keys, "_c").agg(listed("_i", F.concat_ws(":", "_n", "_h")).alias("_ch"))
    return chunks.groupBy(*keys).agg(listed("_c", F.col("_ch")).alias("fingerprint"))


def newest_logs(logs: DataFrame, k: int = 5000) -> DataFrame:
    """The newest k records; unreadable times sink to the end. A top-k, so
    each task hands on k rows at most."""
    ranked = logs.withColumn("at", tx.x_parse_iso(F.col("time")))
    return ranked.orderBy(F.col("at").desc_nulls_last(), "service", "message").limit(k)


def search_logs(logs: DataFrame, min_level: str = "debug", service: str = "all", text: str = "") -> DataFrame:
    """records at or above a level (unknown levels stay), of one service,
    holding the text anywhere."""
    rank = tx.x_level_rank(F.col("level"))
    df = logs.filter((rank == 0) | (rank >= tx.LEVELS.index(min_level) + 1))
    if service != "all":
        df = df.filter(F.col("service") == service)
    needle = text.strip().lower()
    if needle:
        hay = F.concat_ws(" ", "message", F.coalesce("logger", F.lit("")), F.to_json("fields"))
        df = df.filter(F.lower(hay).contains(needle))
    return df

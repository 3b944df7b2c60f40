"""What several of these operators share: staged tables, folds of rows, checked broadcasts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_type

from boardsight.core.runtime import ensure_checkpoint_dir

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes handed to Python at once.
BATCH_BYTES = 8 << 20

#: A side of a join is broadcast up to this many bytes, after it has been counted.
BROADCAST_BYTES = 16 << 20


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared checkpoint folder and go on from the written rows.

    A lost executor costs a read of the table, not the work that made it.
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a staged table, marked for broadcast if its rows are counted to fit ``limit``."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def ascii_lower(text: Column) -> Column:
    """A-Z lowered, all else as it is."""
    return F.translate(text, UPPER, LOWER)


def remainder(doc_id: Column, mod: int) -> Column:
    """crc32 of the id as text, modulo ``mod``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % mod


def held_out(doc_id: Column, mod: int) -> Column:
    """Rows kept away from learning: those of remainder 2. A null id is not held out, and not learnt from."""
    return F.coalesce(remainder(doc_id, mod) == 2, F.lit(False))


def learnt(doc_id: Column, mod: int) -> Column:
    return F.coalesce(remainder(doc_id, mod) != 2, F.lit(False))


def small_batches(df: DataFrame) -> DataFrame:
    """``df``, in a session whose Arrow batches hold ``BATCH_BYTES`` at most, so that long texts don't pile up in Python."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return df


def appended(df: DataFrame, column: str, make: Callable[[], Callable[[list], Iterable[tuple]]], fields: str, drop: bool = False, at_once: int = 1024) -> DataFrame:
    """``df`` with more columns, made in Python from the values of ``column``, a batch at a time.

    ``make`` is called once a task and gives a function from a list of values, ``at_once`` at most,
    to one tuple of ``fields`` for each. Other columns pass through untouched; those of the same names are
    replaced, and ``column`` itself goes with ``drop``.
    """
    new = T.StructType.fromDDL(fields)
    kept = [f for f in df.schema if f.name not in new.names and not (drop and f.name == column)]
    types = [to_arrow_type(f.dataType) for f in new]
    names = [f.name for f in kept] + new.names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in (whole.slice(at, at_once) for whole in batches for at in range(0, whole.num_rows, at_once)):
            rows = list(work(batch.column(column).to_pylist()))
            made = [pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + made, names=names)

    return small_batches(df).mapInArrow(run, T.StructType([*kept, *new.fields]))

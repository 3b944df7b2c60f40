"""Sequential rules over streams whose rows come in any order, within a watermark.

Rows wait in keyed state until the watermark has passed them and are then folded in order of event
time, so how rows are spread over files and in which order files come makes no difference. A row older
than one already folded comes too late: it is not folded, but given out with ``late`` set, to be kept in
a side table and counted.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from boardsight.streaming.stateful import use_state_store

LEAST = np.iinfo(np.int64).min

BLOCK = T.StructType([T.StructField("rows", T.BinaryType())])
AT = "at_us"  # event time in the state; the watermark's own column is left out, or late rows would go unseen
BUCKET, KEY = "on_time_bucket", "on_time_key"
BUCKETS = 512  # a call to the state costs milliseconds, so keys share one: this many, however many keys there are


class OnTimeFold(StatefulProcessor):
    """Buffers the rows of a bucket of keys as Arrow blocks in a list; a timer at the oldest of them folds what the watermark has passed, key by key.

    ``due(state)`` names a time at which a key has something to give out though no row comes; once the watermark is
    there, ``flush(key, state, passed)`` gives it.
    """

    def __init__(self, fold, keys: list[str], columns: list[str], order: list[str], schema: T.StructType, due=None, flush=None):
        self.fold, self.keys, self.columns, self.order, self.schema = fold, keys, columns, [AT, *order], schema
        self.due, self.flush = due, flush

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", BLOCK)
        self.state = handle.getValueState("fold", BLOCK)

    def _known(self) -> dict:
        """Of each key in the bucket: its values, the newest time folded, its state."""
        return pickle.loads(self.state.get()[0]) if self.state.exists() else {}

    def _wake(self, oldest: int) -> None:
        oldest = int(-(-oldest // 1000))
        timers = list(self.handle.listTimers())
        if not timers or oldest < min(timers):
            for t in timers:
                self.handle.deleteTimer(t)
            self.handle.registerTimer(oldest)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows, ignore_index=True)
        batch.columns = self.columns
        batch = batch[batch[self.keys[0]].notna()]  # a filter before the state would be moved before the watermark
        if batch.empty:
            return
        highs = {k: high for k, (_, high, _) in self._known().items()}
        late = batch[AT].to_numpy("int64") <= np.array([highs.get(k, LEAST) for k in batch[KEY]])
        fresh = batch[~late]
        if len(fresh):
            self.held.appendValue((pack(fresh),))
            self._wake(int(fresh[AT].min()))
        if late.any():
            yield self._out(batch[late], True)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        blocks = [unpack(b[0]) for b in self.held.get()] if self.held.exists() else []
        known, made, wake = self._known(), [], []
        if blocks:
            rows = pd.concat(blocks, ignore_index=True) if len(blocks) > 1 else blocks[0]
            ready = rows[AT] <= passed
            due, rest = rows[ready], rows[~ready]
            self.held.clear()
            if len(rest):
                self.held.appendValue((pack(rest),))
                wake.append(int(rest[AT].min()))
            due = due.sort_values([KEY, *self.order], ignore_index=True)
            names = due[KEY].to_numpy()
            starts = np.flatnonzero(np.r_[True, names[1:] != names[:-1]]) if len(due) else []
            for a, b in zip(starts, [*starts[1:], len(due)]):
                part = due.iloc[a:b].reset_index(drop=True)
                values, _, state = known.get(names[a]) or (tuple(part[self.keys].iloc[0]), None, None)
                out, state = self.fold(state, part)
                known[names[a]] = (values, int(part[AT].iloc[-1]), state)
                made.append(out)
        if self.flush is not None:
            for name, (values, high, state) in known.items():
                at = self.due(state)
                if at is not None and at <= passed:
                    out, state = self.flush(values, state, passed)
                    known[name] = (values, high, state)
                    made.append(out)
                    at = self.due(state)
                if at is not None:
                    wake.append(at)
        if made := [out for out in made if len(out)]:
            yield self._out(pd.concat(made, ignore_index=True), False)
        if known:
            self.state.update((pickle.dumps(known),))
        if wake:
            self.handle.registerTimer(int(-(-min(wake) // 1000)))

    def _out(self, rows: pd.DataFrame, late: bool) -> pd.DataFrame:
        rows = rows.assign(late=late)
        return rows.reindex(columns=self.schema.names).astype(object) if late else rows[self.schema.names]

    def close(self) -> None:
        pass


def pack(rows: pd.DataFrame) -> bytes:
    table = pa.Table.from_pandas(rows, preserve_index=False)
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def unpack(block: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(block).read_all().to_pandas()


def fold_on_time(stream: DataFrame, keys: list[str], ts: str, fold, schema: T.StructType, order: list[str] = (), late: str = "1 minute",
                 due=None, flush=None, buckets: int = BUCKETS) -> DataFrame:
    """``fold(state, rows)`` over each key's rows in order of ``ts``, then ``order``, as the watermark passes them.

    ``fold`` gets rows with ``at_us`` for ``ts`` and gives rows of ``schema`` and the next state, of plain values.
    The output has ``late`` besides; late rows carry those of their columns that ``schema`` has. Rows with a null first
    key only move the watermark on. ``late`` is how far behind the newest row others may come. ``due`` and ``flush`` are
    for what a key gives out when no row comes (see ``OnTimeFold``).
    """
    use_state_store(stream.sparkSession)
    rows = stream.withWatermark(ts, late).withColumn(AT, F.unix_micros(ts)).drop(ts)
    out = T.StructType([*[T.StructField(f.name, f.dataType) for f in schema], T.StructField("late", T.BooleanType())])
    # the keys as text: a number with nulls beside it does not arrive as one
    rows = rows.withColumns({KEY: F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}), BUCKET: F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")})
    return rows.groupBy(BUCKET).transformWithStateInPandas(
        statefulProcessor=OnTimeFold(fold, list(keys), rows.columns, list(order), out, due, flush), outputStructType=out, outputMode="append", timeMode="EventTime")


def write_on_time(folded: DataFrame, sink: str, late_sink: str, checkpoint: str, trigger: dict | None = None):
    """Append what was folded to ``sink`` and late rows to ``late_sink``. The batch number names the folder, so a batch
    that is run again replaces what it wrote."""
    def write(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        for late, path in ((False, sink), (True, late_sink)):
            rows = batch.filter(F.col("late") == late).drop("late").withColumn("batch", F.lit(number))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)
        batch.unpersist()
    return (folded.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())

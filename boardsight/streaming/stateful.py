"""Keyed state for streams: the same folds the batch operators run, fed
micro-batch by micro-batch, with the state kept by Spark."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
TEXT = T.StructType([T.StructField("text", T.StringType())])


def use_state_store(spark) -> None:
    """Keyed state needs the RocksDB store, which keeps state on disk rather
    than in executor memory."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)


class FoldProcessor(StatefulProcessor):
    """Feeds each key's new rows, in order, to a fold. Rows older than the
    newest one folded before come too late for a sequential rule and are left
    out, as a watermark does; with ``keep_late`` the rule gets them where they
    arrived."""

    def __init__(self, fold, columns: list[str], order: list[str], schema: T.StructType, timer_ms=None, expire=None, keep_late: bool = False):
        self.keep_late = keep_late
        self.columns = columns
        self.fold, self.order, self.schema = fold, order, schema
        self.timer_ms, self.expire = timer_ms, expire

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", TEXT)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(rows, ignore_index=True)
        batch.columns = self.columns  # names with a leading underscore do not arrive as such
        text = self.state.get() if self.state.exists() else None
        high, state = json.loads(text[0]) if text else (None, None)
        lead = self.order[0]
        number = batch[lead].astype("int64") if str(batch[lead].dtype).startswith("datetime") else batch[lead]
        if high is not None and not self.keep_late:
            batch, number = batch[number >= high], number[number >= high]
        if batch.empty:
            return
        out, state = self.fold(state, batch.sort_values(self.order, ignore_index=True))
        self.state.update((json.dumps([float(number.max()), state]),))
        if self.timer_ms is not None:
            for old in self.handle.listTimers():
                self.handle.deleteTimer(old)
            wait = self.timer_ms(state) if callable(self.timer_ms) else self.timer_ms
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + wait)
        if len(out):
            yield out[self.schema.names]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.expire is None or not self.state.exists():
            return
        high, state = json.loads(self.state.get()[0])
        out, state = self.expire(key, high, state)
        self.state.update((json.dumps([high, state]),))
        if out is not None and len(out):
            yield out[self.schema.names]

    def close(self) -> None:
        pass


def fold_stream(stream: DataFrame, keys: list[str], order: list[str], fold, schema: T.StructType,
                timer_ms=None, expire=None, keep_late: bool = False) -> DataFrame:
    """A fold over a keyed stream, append output. For a key that stays silent for
    ``timer_ms`` of wall clock (a number, or a function of its state),
    ``expire(key, newest order value, state)`` gives rows and the state after."""
    use_state_store(stream.sparkSession)
    return stream.groupBy(*keys).transformWithStateInPandas(
        statefulProcessor=FoldProcessor(fold, stream.columns, order, schema, timer_ms, expire, keep_late), outputStructType=schema,
        outputMode="append", timeMode="None" if timer_ms is None else "ProcessingTime")

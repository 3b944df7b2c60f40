"""Streaming forms."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from boardsight.functions import signals as fn
from boardsight.operators.series import stage_counters
from boardsight.operators.tracking import MOVED_PX, PERSIST, TRACK_FIELDS, WINDOW, moved_fold, throttle_fold, tracking_fold
from boardsight.functions.geometry import MATCH_PX
from boardsight.sources.packets import decode_motion
from boardsight.sources.signals import stamp
from boardsight.core.ordered import null_safe_join
from boardsight.streaming.ontime import AT, fold_on_time
from boardsight.streaming.stateful import fold_stream


def read_packet_stream(spark, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Packets (timestamp, packet) landing as parquet files. The rate
    option is what holds a fast producer back."""
    schema = T.StructType([T.StructField("timestamp", T.TimestampType()), T.StructField("packet", T.BinaryType())])
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def ingest(stream: DataFrame, sink: str, dead_letters: str, checkpoint: str, trigger: dict | None = None):
    """Decode and append each micro-batch, rejects with their
    reason beside it. The batch number names its folder, so a batch that is run
    again after a failure replaces what it wrote rather than adding to it."""
    def write(batch: DataFrame, number: int) -> None:
        ok, rejects = decode_motion(batch)
        rows = stamp(ok, "motion")
        (rows.sortWithinPartitions("day", "id", "timestamp").withColumn("batch", F.lit(number)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch", "day").parquet(sink))
        (rejects.withColumn("batch", F.lit(number)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(dead_letters))
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())


def subscriptions(requests: DataFrame) -> DataFrame:
    """The control table after a log of requests (seq, action, key, client,
    interval_ms): the first client to register a key holds it until it drops
    it; its latest interval counts."""
    holder = W.partitionBy("key").orderBy("seq")  # requests per key are typed by people
    marked = requests.withColumn("_ep", F.coalesce(F.sum(F.when(F.col("action") == "drop", 1).otherwise(0)).over(
        holder.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    last = marked.groupBy("key").agg(F.max("_ep").alias("_last"), F.max_by("action", "seq").alias("_action"))
    open_ = marked.join(last, "key").filter((F.col("_ep") == F.col("_last")) & (F.col("_action") != "drop"))
    first = F.min(F.when(F.col("action") == "register", F.struct("seq", "client")))
    held = open_.groupBy("key").agg(first.alias("_f"))
    set_by = open_.join(held, "key").filter(F.col("client") == F.col("_f.client")).groupBy("key", "client").agg(
        F.max_by("interval_ms", "seq").alias("interval_ms"))
    return set_by


def sampled_feed(stream: DataFrame, control: DataFrame, ts: str = "timestamp", key: str = "key", late: str = "1 minute") -> DataFrame:
    """The rows subscribers get: those of subscribed keys, at most one per
    interval after the last sent. Event time, so a replay gives the same rows
    in whatever files they come. Rows that come later than ``late`` behind the
    newest are marked by the column ``late`` and were not sent."""
    # a left join, so that rows without a key still move the watermark on
    rows = stream.join(control, key, "left").filter(F.col("client").isNotNull() | F.col(key).isNull())
    schema = T.StructType([f for f in rows.schema if f.name != ts] + [T.StructField(AT, T.LongType())])

    def fold(last, batch: pd.DataFrame):
        interval = batch["interval_ms"].iloc[-1]
        if pd.isna(interval):
            return batch, last
        marked, last = throttle_fold(float(interval), [*schema.names, "_kept"])(last, batch.assign(_ms=batch[AT] / 1000))
        return marked[marked["_kept"]], last
    sent = fold_on_time(rows, [key, "client"], ts, fold, schema, late=late)
    return sent.withColumn(ts, F.timestamp_micros(AT)).drop(AT)


CONTROL = ["action", "client", "interval_ms", "seq"]


def live_feed(data: DataFrame, control: DataFrame, ts: str = "timestamp", key: str = "key", late: str = "1 minute") -> DataFrame:
    """R4 into R3: rows of ``data`` as subscribers get them while subscriptions
    change. ``control`` rows are (key, time, seq, action, client, interval_ms)
    with the action ``register``, ``interval`` or ``drop``; both are folded
    together by key in order of time, a control row before data of its time.

    The first client to register a key holds it until it drops it, and what
    others ask is passed over. No interval, or 0, sends every row; a changed
    one counts from the last row sent by an interval.
    """
    rest = [c for c in data.columns if c not in (key, ts)]
    asked = control.select(key, ts, *[F.col(c).alias(f"c_{c}") for c in CONTROL], *[F.lit(None).cast(data.schema[c].dataType).alias(c) for c in rest])
    kinds = {f"c_{c}": control.schema[c].dataType for c in CONTROL}
    rows = data.select(key, ts, *[F.lit(None).cast(k).alias(c) for c, k in kinds.items()], *rest).unionByName(asked)
    schema = T.StructType([data.schema[key], T.StructField(AT, T.LongType()), *[data.schema[c] for c in rest], T.StructField("client", T.StringType())])

    def fold(state, batch: pd.DataFrame):
        client, interval, last = state or (None, None, None)
        asks = batch["c_action"].notna().to_numpy()
        out, start = [], 0
        for i in [*asks.nonzero()[0], len(batch)]:
            part = batch.iloc[start:i]
            if len(part) and client is not None:
                if interval is not None:
                    part, last = throttle_fold(float(interval), [*batch.columns, "_kept"])(last, part.assign(_ms=part[AT] / 1000))
                    part = part[part["_kept"]]
                out.append(part.assign(client=client))
            if i < len(batch):
                client, interval, last = subscribed((client, interval, last), *batch.iloc[i][["c_action", "c_client", "c_interval_ms"]])
            start = i + 1
        sent = pd.concat(out, ignore_index=True) if out else batch.iloc[:0].assign(client=None)
        return sent[schema.names], [client, interval, last]
    sent = fold_on_time(rows.withColumn("c_data", F.col("c_action").isNull()), [key], ts, fold, schema, ["c_data", "c_seq"], late)
    return sent.withColumn(ts, F.timestamp_micros(AT)).drop(AT)


def subscribed(state: tuple, action: str, client: str, interval_ms) -> tuple:
    """(client, interval, last sent) of a key after one request."""
    holder, interval, last = state
    if holder is not None and client != holder:
        return state
    if action == "drop":
        return None, None, None
    if holder is None and action != "register":
        return state
    interval = None if pd.isna(interval_ms) or interval_ms <= 0 else float(interval_ms)
    return client, interval, last if interval is not None else None


def metrics_stream(events: DataFrame, stages: list[str]) -> DataFrame:
    """Running counters; write it in update mode with a 100 ms trigger, so
    only what changed is sent."""
    return stage_counters(events, stages)


def metrics_changes(events: DataFrame, stages: list[str], ts: str = "timestamp", interval_ms: int = 100, late: str = "1 minute") -> DataFrame:
    """Snapshots of each source's counters as they change: one at once, then
    what changes within ``interval_ms`` of the last together when that time is
    over, and none while nothing changes. Columns as A10's, with ``at_us``."""
    names = [f"{s}_{end}" for s in stages for end in ("ok", "fail")]
    schema = T.StructType([events.schema["source"], T.StructField(AT, T.LongType()), *[T.StructField(n, T.LongType()) for n in names]])
    wait = interval_ms * 1000
    slim = events.select("source", ts, "stage", "ok", F.coalesce(F.col("n"), F.lit(1)).cast("long").alias("n"))

    def rows_of(source, sent: list) -> pd.DataFrame:
        return pd.DataFrame([(source, at, *counts) for at, counts in sent], columns=schema.names)

    def fold(state, rows: pd.DataFrame):
        counts, last, changed = state or ([0] * len(names), None, False)
        sent = []
        for at, stage, ok, n in zip(rows[AT].tolist(), rows["stage"], rows["ok"], rows["n"].tolist()):
            name = f"{stage}_{'ok' if ok else 'fail'}"
            if changed and at >= last + wait:
                last, changed = last + wait, False
                sent.append((last, list(counts)))
            if name in names and n:
                counts[names.index(name)] += n
                changed = True
                if last is None or at >= last + wait:
                    last, changed = at, False
                    sent.append((at, list(counts)))
        return rows_of(rows["source"].iloc[0], sent), [counts, last, changed]

    def due(state):
        return state[1] + wait if state and state[2] else None

    def flush(key, state, passed):
        at = due(state)
        if at is None or at > passed:
            return rows_of(key[0], []), state
        return rows_of(key[0], [(at, state[0])]), [state[0], at, False]
    return fold_on_time(slim, ["source"], ts, fold, schema, late=late, due=due, flush=flush)


def reassemble_on_time(segments: DataFrame, keys: list[str], ts: str = "timestamp", seq: str = "seq", data: str = "payload",
                       idle_s: float = 5, ends: str | None = None, late: str = "5 seconds") -> DataFrame:
    """The text of each burst once the stream has been idle, or with
    ``ends``, a pattern in a closing segment, of each message as it closes, so
    that a busy stream keeps no more than one message. Segments are put in
    order of their number; a repeated number counts once, the last sent."""
    slim = segments.select(*keys, ts, F.col(seq).alias("seq"), F.hex(data).alias("part"), (F.col(data).cast("string").rlike(ends) if ends else F.lit(False)).alias("closes"))
    fields = [T.StructField("started_us", T.LongType()), T.StructField("segments", T.LongType()), T.StructField("part", T.StringType())]
    schema = T.StructType([segments.schema[k] for k in keys] + fields)
    idle = int(idle_s * 1_000_000)

    def rows_of(key, bursts: list) -> pd.DataFrame:
        made = [(*key, first, len(held), "".join(held[k] for k in sorted(held, key=int))) for first, _, held in bursts]
        return pd.DataFrame(made, columns=schema.names)

    def fold(state, rows: pd.DataFrame):
        done = []
        for at, number, part, closes in zip(rows[AT].tolist(), rows["seq"].tolist(), rows["part"], rows["closes"]):
            if state and at - state[1] >= idle:
                done.append(state)
                state = None
            state = [state[0] if state else at, at, {**(state[2] if state else {}), str(number): part}]
            if closes:
                done.append(state)
                state = None
        return rows_of(rows[keys].iloc[0], done), state

    def due(state):
        return state[1] + idle if state else None

    def flush(key, state, passed):
        if not state or due(state) > passed:
            return rows_of(key, []), state
        return rows_of(key, [state]), None
    out = fold_on_time(slim, keys, ts, fold, schema, ["seq"], late, due, flush)
    text = F.unhex("part").cast("string")
    return out.select(*keys, F.timestamp_micros("started_us").alias("started"), "segments", text.alias("text"), fn.x_envelope(text).alias("envelope"), "late")


def reassemble_stream(segments: DataFrame, keys: list[str], ts: str = "timestamp", seq: str = "seq", data: str = "payload",
                      idle: str = "5 seconds", late: str = "5 seconds") -> DataFrame:
    """Text of each burst once the stream has been idle."""
    packed = F.sort_array(F.collect_list(F.struct(F.col(seq).alias("s"), F.hex(data).alias("d"))))
    whole = F.unhex(F.array_join(F.transform(packed, lambda p: p["d"]), "")).cast("string")
    bursts = (segments.withWatermark(ts, late).groupBy(F.session_window(ts, idle), *keys)
              .agg(F.count(F.lit(1)).alias("segments"), whole.alias("text")))
    return bursts.select(*keys, F.col("session_window.start").alias("started"), "segments", "text",
                         fn.x_envelope(F.col("text")).alias("envelope"))


def idempotent_stream(stream: DataFrame, keys: list[str], ts: str = "timestamp", within: str = "1 hour") -> DataFrame:
    """R7 in bounded state: the first of rows with one key, a retry within the
    watermark being dropped; rows with a null key all pass. For keys that must
    stay unique for good there is ``idempotent_ingest``."""
    watched = stream.withWatermark(ts, within)
    keyed = watched.filter(F.col(keys[-1]).isNotNull()).dropDuplicatesWithinWatermark(keys)
    return keyed.unionByName(watched.filter(F.col(keys[-1]).isNull()))


KEY_BUCKETS = 64


def idempotent_ingest(stream: DataFrame, keys: list[str], order: list[str], sink: str, store: str, checkpoint: str,
                      trigger: dict | None = None, buckets: int = KEY_BUCKETS):
    """Append the first row of each key to ``sink``, for good: a retry
    after any time is dropped. Rows whose last key is null all pass.

    The keys seen are a table of their own, in buckets of a hash of the key.
    Each micro-batch reads the buckets its keys fall in, of earlier batches
    only, and then adds its new keys under its number. A batch run again after
    a failure so finds what it found before, and replaces what it wrote.
    """
    spark = stream.sparkSession
    seen = T.StructType([*[stream.schema[k] for k in keys], T.StructField("bucket", T.IntegerType()), T.StructField("batch", T.LongType())])
    spark.createDataFrame([], seen).write.mode("append").partitionBy("bucket", "batch").parquet(store)  # so that there is a folder to read

    def replace(rows: DataFrame, path: str, *parts: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*parts).parquet(path)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        named = F.col(keys[-1]).isNotNull()
        rest = [c for c in batch.columns if c not in (*keys, *order)]
        firsts = (batch.filter(named).groupBy(*keys).agg(F.min(F.struct(*[c for c in order if c not in keys], *rest)).alias("_r")).select(*keys, "_r.*")
                  .withColumn("bucket", F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")).persist())
        touched = [r["bucket"] for r in firsts.select("bucket").distinct().collect()]  # no more than there are buckets
        known = session.read.schema(seen).parquet(store).filter(F.col("bucket").isin(touched) & (F.col("batch") < number))
        new = null_safe_join(firsts, known.select(*keys, "bucket"), [*keys, "bucket"], "left_anti").persist()
        rows = new.select(*batch.columns).unionByName(batch.filter(~named))
        replace(rows.withColumn("batch", F.lit(number).cast("long")), sink, "batch")
        # a bucket's keys in one task, or each of the tasks would write a file to each bucket
        replace(new.select(*keys, "bucket").withColumn("batch", F.lit(number).cast("long")).repartition("bucket"), store, "bucket", "batch")
        new.unpersist()
        firsts.unpersist()
    return (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "1 second"})).start())


PERSISTED = [T.StructField("cand_id", T.StringType()), T.StructField("first", T.LongType()), T.StructField("judged_frame", T.LongType()),
             T.StructField("x", T.DoubleType()), T.StructField("y", T.DoubleType()), T.StructField("persistence", T.DoubleType())]


def persistence_stream(looks: DataFrame, keys: list[str], match_px: float = MATCH_PX, persist: float = PERSIST, window: int = WINDOW,
                       late_frames: int = WINDOW, fill_missing: bool = False) -> DataFrame:
    """Candidates that persist, each once, as its window passes.

    The frame number is the event time: looks may come in any order up to
    ``late_frames`` behind the newest, in whatever files, and later ones are
    marked by ``late``. Frames a stream missed come as ``unseen`` rows and count
    as tried; with ``fill_missing`` a frame that has not come by the time the
    watermark passes it is taken for one.
    """
    slim = looks.select(*keys, F.col("frame").cast("long").alias("frame"), "status", F.transform(
        "detections", lambda d: F.array(*[d[c].cast("double") for c in ("cx", "cy", "w", "h")])).alias("_d"), F.timestamp_millis("frame").alias("_at"))
    slim = slim.withColumnRenamed("_d", "d").withColumnRenamed("_at", "shown")
    schema = T.StructType([slim.schema[k] for k in keys] + PERSISTED)

    def fold(state, rows: pd.DataFrame):
        newest, inner_state = state or (None, None)
        judged: list = []
        known = rows[[*keys, "frame", "status", "d"]].rename(columns={"d": "_d"})
        if fill_missing:
            known = with_missing(known, keys, newest)
        inner = tracking_fold(keys, [*keys, *[f.name for f in TRACK_FIELDS]], match_px, True, persist, window, judged)
        _, inner_state = inner(inner_state, known)
        out = pd.DataFrame(judged, columns=[f.name for f in PERSISTED])
        for k in keys:
            out[k] = rows[k].iloc[0]
        return out, [int(rows["frame"].max()), inner_state]
    return fold_on_time(slim, keys, "shown", fold, schema, late=f"{late_frames} milliseconds")


def with_missing(rows: pd.DataFrame, keys: list[str], newest: int | None) -> pd.DataFrame:
    """Looks in order of frame, with an ``unseen`` one for each frame left out since ``newest``."""
    first = int(rows["frame"].iloc[0]) if newest is None else newest + 1
    gone = sorted(set(range(first, int(rows["frame"].iloc[-1]))) - set(rows["frame"]))
    blank = pd.DataFrame({"frame": gone, "status": "unseen", "_d": [[] for _ in gone], **{k: rows[k].iloc[0] for k in keys}})
    return pd.concat([rows, blank[rows.columns]]).sort_values("frame", ignore_index=True) if gone else rows


def stalls(stream: DataFrame, keys: list[str], ts: str = "timestamp", after_s: float = 10, down_s: float = 120, down: str = "down") -> DataFrame:
    """A row for each run that shows no look for ``after_s``, or
    ``down_s`` while its camera is down, of wall clock."""
    rows = stream.select(*keys, F.unix_millis(ts).alias("_ms"), F.col(down).alias("_down"))
    schema = T.StructType([rows.schema[k] for k in keys] + [
        T.StructField("last_ms", T.DoubleType()), T.StructField("camera_down", T.BooleanType())])

    def fold(state, batch: pd.DataFrame):
        return pd.DataFrame({f.name: [] for f in schema}), bool(batch["_down"].iloc[-1])

    def expire(key, high, is_down):
        return pd.DataFrame([(*key, high, bool(is_down))], columns=schema.names), is_down

    def wait(is_down) -> int:
        return int((down_s if is_down else after_s) * 1000)
    return fold_stream(rows, keys, ["_ms"], fold, schema, wait, expire)


def alive_stream(stream: DataFrame, keys: list[str], counter: str, ts: str = "timestamp", stale_s: float = 3) -> DataFrame:
    """A row whenever a counter starts growing, and one when it has not
    grown for ``stale_s``."""
    rows = stream.select(*keys, F.unix_millis(ts).alias("_ms"), F.col(counter).cast("long").alias("_c"))
    schema = T.StructType([rows.schema[k] for k in keys] + [T.StructField("at_ms", T.DoubleType()), T.StructField("alive", T.BooleanType())])

    def fold(state, batch: pd.DataFrame):
        counter, grown, live = state or (None, None, False)
        changes = []
        for at, c in zip(batch["_ms"], batch["_c"]):
            if counter is not None and c > counter:
                grown = int(at)
            now = grown is not None and at - grown < stale_s * 1000
            if now != live:
                changes.append((*batch[keys].iloc[0], float(at), now))
            counter, live = int(c), now
        return pd.DataFrame(changes, columns=schema.names), [counter, grown, live]

    def expire(key, high, state):
        gone = pd.DataFrame([(*key, high, False)] if state[2] else [], columns=schema.names)
        return gone, [state[0], None, False]
    return fold_stream(rows, keys, ["_ms"], fold, schema, int(stale_s * 1000), expire)


FEED_TYPES = ["bullet_created", "bullet_deleted", "session_updated", "detection_updated", "run_moved"]


def session_feed(events: DataFrame, session: str | Column) -> DataFrame:
    """The live events of one session."""
    return events.filter((F.col("session_id") == session) & F.col("type").isin(FEED_TYPES))


def follow_runs(stream: DataFrame, keys: list[str], arrival: str, ts: str = "looked_at", outline: str = "outline", moved_px: float = MOVED_PX) -> DataFrame:
    """As a run is looked at, the places it has moved to; a look no
    newer than any that arrived before it changes nothing. ``arrival`` numbers
    looks as they arrive, so batch borders make no difference."""
    slim = stream.select(*keys, F.col(arrival).alias("_arrival"), F.unix_millis(ts).alias("_ms"),
                         F.flatten(F.transform(outline, lambda p: F.array(p["x"], p["y"]))).alias("_xy"))
    schema = T.StructType([*[slim.schema[k] for k in keys], slim.schema["_ms"], slim.schema["_xy"]])
    inner = moved_fold(moved_px, schema.names)

    def fold(state, rows: pd.DataFrame):
        high, last = state or (None, None)
        before = rows["_ms"].cummax().shift()
        before = before if high is None else before.fillna(high).clip(lower=high)
        rows = rows[~(rows["_ms"] <= before)].reset_index(drop=True)
        if rows.empty:
            return rows[schema.names], state
        out, last = inner(last, rows)
        return out, [int(rows["_ms"].max()), last]
    return fold_stream(slim, keys, ["_arrival"], fold, schema, keep_late=True).select(
        *keys, F.timestamp_millis("_ms").alias("at"), F.col("_xy").alias("outline"))


def watched_until(stream: DataFrame, keys: list[str], ts: str = "looked_at") -> DataFrame:
    """How far each run has been watched, which only moves forward."""
    return stream.groupBy(*keys).agg(F.max(ts).alias("watched_until"))

"""Streams: windowed figures, sessions, histories and de-duplication with a time to live, progress, message assembly.

Each builder takes a streaming or a batch DataFrame and returns one; both give the same rows, so a query's plan can be tested in
batch. Filling a knowledge base from a stream is in store.py.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

#: Size of quantile sketches: a rank is off by less than half a percent, nearly always.
SKETCH_K = 800


def on_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """ts as a timestamp with time zone, which watermarks ask for."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


# --- figures --------------------------------------------------------------------------------------------------------


def windowed_sketches(events: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """events(ts, scope, elapsed) -> start, scope, n, n_values, total, sketch by window.

    The quantiles of a window are a sketch of bounded size, in the state of a stream as in a stored column; sketches of windows or
    scopes add up (see rolled_up). Nulls count in n only.
    """
    timed = on_time(events).withWatermark("ts", delay)
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    value = F.col("elapsed").cast("double")
    out = timed.groupBy(frame, "scope").agg(F.count(F.lit(1)).alias("n"), F.count("elapsed").alias("n_values"), F.sum(value).alias("total"), F.kll_sketch_agg_double(value, SKETCH_K).alias("sketch"))
    return out.select(F.col("window.start").alias("start"), "scope", "n", "n_values", "total", "sketch")


def _quantile(sketch: Column, share: float) -> Column:
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def rolled_up(sketches: DataFrame, *by: str | Column, quantiles: tuple[float, ...] = (0.5, 0.95)) -> DataFrame:
    """windowed_sketches' rows -> the keys, n, mean and a column p50, p95, ... for each quantile, over all windows of a key."""
    out = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("n_values").alias("_values"), F.sum("total").alias("_total"), F.kll_merge_agg_double("sketch", SKETCH_K).alias("_sketch"))
    keys = [c for c in out.columns if c not in ("n", "_values", "_total", "_sketch")]
    return out.select(*keys, "n", F.round(F.col("_total") / F.col("_values"), 4).alias("mean"), *[_quantile(F.col("_sketch"), q).alias(f"p{round(100 * q)}") for q in quantiles])


def windowed_figures(events: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """events(ts, scope, elapsed) -> start, scope, n, mean, p95 by window; rows later than the delay are dropped.

    A batch gives exact percentiles, a stream those of sketches: an exact one would keep all values of a window in the state.
    """
    if events.isStreaming:
        made = windowed_sketches(events, window, slide, delay)
        return made.select("start", "scope", "n", F.round(F.col("total") / F.col("n_values"), 4).alias("mean"), F.round(_quantile(F.col("sketch"), 0.95), 6).alias("p95"))
    frame = F.window("ts", window, slide) if slide else F.window("ts", window)
    out = on_time(events).groupBy(frame, "scope").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("elapsed"), 4).alias("mean"), F.round(F.percentile("elapsed", 0.95), 6).alias("p95"))
    return out.select(F.col("window.start").alias("start"), "scope", "n", "mean", "p95")


# --- sessions -------------------------------------------------------------------------------------------------------


def sessions(events: DataFrame, gap: str = "4 hours", delay: str = "4 hours") -> DataFrame:
    """events(ts, user_id) -> user_id, start, end, n of sessions that end after `gap` without an event."""
    timed = on_time(events).withWatermark("ts", delay)
    out = timed.groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return out.select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def _millis(ts) -> int:
    return int(pd.Timestamp(ts).value // 1_000_000)


class _LastMessages(StatefulProcessor):
    """Keeps the newest messages of a session; a timer on event time frees the state of a session that has been idle."""

    def __init__(self, most: int, ttl_ms: int):
        self.most, self.ttl_ms = most, ttl_ms

    def init(self, handle):
        self.handle = handle
        self.kept = handle.getListState("kept", "at LONG, text STRING")

    def handleInputRows(self, key, rows, timerValues):
        held = list(self.kept.get()) if self.kept.exists() else []
        held = [(m[0], m[1]) for m in held]
        news = pd.concat(list(rows)).sort_values(["ts", "seq"], kind="stable")
        out = []
        for ts, seq, text in zip(news["ts"], news["seq"], news["text"]):
            at = _millis(ts)
            if held and at - held[-1][0] > self.ttl_ms:
                held = []
            held = [*held, (at, text)][-self.most :]
            out.append((key[0], ts, seq, "\n".join(t or "" for _, t in held), len(held)))
        self.kept.put(held)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(held[-1][0] + self.ttl_ms)
        yield pd.DataFrame(out, columns=["session", "ts", "seq", "history", "n"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.kept.clear()
        return iter(())

    def close(self):
        pass


def session_history(messages: DataFrame, most: int = 6, ttl_hours: int = 4, delay: str = "0 seconds") -> DataFrame:
    """messages(session, ts, seq, text) -> session, ts, seq, history, n: for each message the last `most` messages of its session, itself
    last, as far as none came more than the time to live after the one before.

    A stream keeps those messages and no others, and forgets a session when the watermark says that it is idle; it wants the
    RocksDB state store. Messages are ordered by (ts, seq); null texts are empty.
    """
    slim = on_time(messages.select("session", "ts", F.col("seq").cast("long").alias("seq"), "text"))
    if messages.isStreaming:
        timed = slim.withWatermark("ts", delay).groupBy("session")
        kind = dict(slim.dtypes)["session"]
        return timed.transformWithStateInPandas(_LastMessages(most, ttl_hours * 3_600_000), f"session {kind}, ts TIMESTAMP, seq LONG, history STRING, n INT", "Append", "EventTime")
    order = Window.partitionBy("session").orderBy("ts", "seq")
    idle = F.unix_millis("ts") - F.unix_millis(F.lag("ts").over(order)) > ttl_hours * 3_600_000
    parts = slim.withColumn("_idle", F.coalesce(idle.cast("int"), F.lit(0)))
    parts = parts.withColumn("_part", F.sum("_idle").over(order))
    last = Window.partitionBy("session", "_part").orderBy("ts", "seq").rowsBetween(1 - most, 0)
    held = F.collect_list(F.coalesce("text", F.lit(""))).over(last)
    return parts.select("session", "ts", "seq", F.array_join(held, "\n").alias("history"), F.size(held).alias("n"))


# --- de-duplication -------------------------------------------------------------------------------------------------


class _FirstWithin(StatefulProcessor):
    """Keeps when a key was last let through; a timer on event time frees it after the time to live."""

    def __init__(self, ttl_ms: int, columns: list[str], ts: str, tie: str):
        self.ttl_ms, self.columns, self.ts, self.tie = ttl_ms, columns, ts, tie

    def init(self, handle):
        self.handle = handle
        self.kept = handle.getValueState("kept", "at LONG")

    def handleInputRows(self, key, rows, timerValues):
        kept = self.kept.get()[0] if self.kept.exists() else None
        news = pd.concat(list(rows)).sort_values([self.ts, self.tie], kind="stable")
        chosen = []
        for i, ts in enumerate(news[self.ts]):
            at = _millis(ts)
            if kept is None or at - kept > self.ttl_ms:
                kept = at
                chosen.append(i)
        if chosen:
            self.kept.update((kept,))
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(kept + self.ttl_ms + 1)
        yield news.iloc[chosen][self.columns]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.kept.clear()
        return iter(())

    def close(self):
        pass


def _scan(batches: Iterator[pa.RecordBatch], ttl_ms: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (_key, _at): a mask of those that are let through, in constant memory whatever a key's rows."""
    last, kept = None, None
    for batch in batches:
        keys, at = batch.column("_key").to_numpy(zero_copy_only=False), batch.column("_at").to_numpy()
        chosen = np.zeros(len(batch), bool)
        starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else []
        for start, end in zip(starts, [*starts[1:], len(keys)]):
            if keys[start] != last:
                last, kept = keys[start], None
            place = start if kept is None else start + int(np.searchsorted(at[start:end], kept + ttl_ms, "right"))
            while place < end:
                chosen[place], kept = True, at[place]
                place = start + int(np.searchsorted(at[start:end], kept + ttl_ms, "right"))
        yield batch.drop_columns(["_key", "_at"]).filter(pa.array(chosen))


def first_within(df: DataFrame, key: str, ttl_hours: int = 168, ts: str = "ts", tie: str | None = None, delay: str = "0 seconds") -> DataFrame:
    """The rows of df that no row of the same key precedes within the time to live of the one last let through: a cache entry serves
    `ttl_hours` and is made anew by the first row after them. Equal times go by `tie`.

    A stream keeps one time a key and frees it by event time (it wants the RocksDB state store); rows later than the watermark are
    dropped. A batch sorts by key and time and lets the rows stream by. Rows without a key or a time are left out.
    """
    timed, tie = on_time(df, ts).where(F.col(key).isNotNull() & F.col(ts).isNotNull()), tie or ts
    ttl_ms = ttl_hours * 3_600_000
    if df.isStreaming:
        columns = timed.columns
        return timed.withWatermark(ts, delay).groupBy(key).transformWithStateInPandas(_FirstWithin(ttl_ms, columns, ts, tie), timed.schema, "Append", "EventTime")
    # equal hashes of different keys would make them one: 64 bits of two seeds stand for a key
    sorted_ = timed.withColumns({"_key": F.concat_ws("|", F.xxhash64(key).cast("string"), F.xxhash64(F.lit(1), key).cast("string")), "_at": F.unix_millis(ts)})
    sorted_ = sorted_.repartition("_key").sortWithinPartitions("_key", "_at", tie)
    return sorted_.mapInArrow(lambda it: _scan(it, ttl_ms), timed.schema)


# --- progress and messages ------------------------------------------------------------------------------------------


def latest_progress(messages: DataFrame) -> DataFrame:
    """messages(job_id, ts, stage, percent) -> the newest of each job; run in update or complete mode."""
    return messages.groupBy("job_id").agg(F.max(F.struct("ts", "percent", "stage")).alias("m")).select("job_id", F.col("m.ts").alias("ts"), F.col("m.stage").alias("stage"), F.col("m.percent").alias("percent"))


def assembled(parts: DataFrame) -> DataFrame:
    """parts(msg_id, seq, type, data) -> msg_id, content of messages whose `done` part has come."""
    chunk = F.when(F.col("type") == "text", F.struct("seq", "data"))
    out = parts.groupBy("msg_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(chunk)), lambda x: x["data"]), "").alias("content"), F.max((F.col("type") == "done").cast("int")).alias("done"))
    return out.where("done = 1").select("msg_id", "content")

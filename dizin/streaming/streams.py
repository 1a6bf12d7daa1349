"""Streams: rollup of progress events, runs that end, and ingest that may be repeated."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from dizin.tables import KeyedTable, latest  # noqa: F401


def progress_rollup(events: DataFrame, run: str = "run", kind: str = "kind", seq: str = "seq", progress: str = "progress", done: str = "done", error: str = "error") -> DataFrame:
    """T1. Per run: its events, the last progress, and its state (done, error, running); batch or stream.

    Max and min_by merge in any order, so late events change nothing that they should not.
    """
    return events.groupBy(run).agg(
        F.count("*").alias("events"), F.count_if(F.col(kind) == error).alias("errors"), F.max_by(progress, seq).alias("progress"), F.max_by(kind, seq).alias("last_kind")
    ).withColumn("state", F.when(F.col("last_kind") == done, "done").when(F.col("last_kind") == error, "error").otherwise("running"))


def windowed_counts(events: DataFrame, ts: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """T1. Events per window and kind; a stream forgets a window once the watermark has passed it."""
    marked = events.withWatermark(ts, late) if events.isStreaming else events
    return marked.groupBy(F.window(ts, width).alias("w"), kind).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), kind, "events")


#: What is told of a run that has ended.
ENDED = "run string, state string, events long, progress double, ended timestamp"


def _events(events: DataFrame, run: str, ts: str, seq: str, kind: str, progress: str) -> DataFrame:
    return events.select(F.col(run).cast("string").alias("run"), F.col(ts).cast("timestamp").alias("ts"), F.col(seq).cast("long").alias("seq"), F.col(kind).alias("kind"), F.col(progress).cast("double").alias("progress"))


def ended_runs(events: DataFrame, run: str = "run", ts: str = "ts", seq: str = "seq", kind: str = "kind", progress: str = "progress", done: str = "done", error: str = "error", silent: int = 1800, now: Column | None = None) -> DataFrame:
    """T1. ``ENDED`` for each run of a batch of events that has ended: at its first ``done`` or ``error`` event, or ``timeout`` at the last event before more than ``silent`` seconds without one.

    Later events do not reopen a run; they do not count. Events go by time, then ``seq``. ``now`` is the time until which silence counts after the last event of a run: that of the last event of all, if none is given.
    """
    each = _events(events, run, ts, seq, kind, progress)
    order = Window.partitionBy("run").orderBy("ts", "seq")
    if now is None:
        each = each.join(F.broadcast(each.agg(F.max("ts").alias("now"))))  # one row
    else:
        each = each.withColumn("now", now)
    following = F.coalesce(F.lead("ts").over(order), "now")
    is_end = F.col("kind").isin(done, error)
    late = F.unix_micros(following) - F.unix_micros("ts") > silent * 1_000_000
    marked = each.withColumn("ends", F.when(is_end, F.when(F.col("kind") == done, "done").otherwise("error")).when(late, "timeout"))
    # The first end of a run, and its events up to there.
    first = F.min(F.when(F.col("ends").isNotNull(), F.struct("ts", "seq", "ends"))).over(Window.partitionBy("run")).alias("end")
    kept = marked.select("*", first).filter("end is not null and struct(ts, seq) <= struct(end.ts, end.seq)")
    return kept.groupBy("run").agg(F.first("end.ends").alias("state"), F.count("*").alias("events"), F.max_by("progress", F.struct("ts", "seq")).alias("progress"), F.first("end.ts").alias("ended"))


def _ms(us: int) -> int:
    """The first whole millisecond that is not before ``us``."""
    return -(-us // 1000)


class _Runs(StatefulProcessor):
    """Events of a run wait until the watermark has passed them, and are then judged in order; a timer ends a silent run.

    Each call of the state is a message to the executor, so what arrives together is one entry, and a run has one timer that counts: the earliest event that waits, or the end of its silence.
    """

    def __init__(self, done: str, error: str, silent: int):
        self.done, self.error, self.silent = done, error, silent * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "us array<long>, seq array<long>, kind array<string>, progress array<double>")
        self.held = handle.getValueState("held", "events long, progress double, us long, ended boolean, due long")

    def _held(self) -> tuple:
        return self.held.get() or (0, None, None, False, None)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        *told, ended, due = self._held()
        if not ended:
            first = due
            for part in rows:
                us = part["ts"].astype("datetime64[us]").astype("int64").tolist()
                self.waiting.appendValue((us, part["seq"].tolist(), part["kind"].tolist(), [None if pd.isna(x) else x for x in part["progress"].tolist()]))
                first = min(_ms(min(us)), _ms(min(us)) if first is None else first)
            if first != due:
                self.handle.registerTimer(first)
                self.held.update((*told, ended, first))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events, progress, last, ended, due = self._held()
        at = timerValues.getCurrentWatermarkInMs()
        # A timer that an earlier one has overtaken has nothing to do.
        if not ended and due <= at:
            every = sorted((x for part in self.waiting.get() for x in zip(*part, strict=True)), key=lambda x: (x[0], x[1]))
            ready = [x for x in every if _ms(x[0]) <= at]
            state = None
            for us, _, kind, new in ready:
                if last is not None and us - last > self.silent * 1000:
                    state = "timeout"
                    break
                events, progress, last = events + 1, new, us
                if kind in (self.done, self.error):
                    state = "done" if kind == self.done else "error"
                    break
            if state is None and last is not None and at * 1000 - last > self.silent * 1000:
                state = "timeout"
            left = every[len(ready) :] if state is None else []
            if left and ready:
                self.waiting.put([tuple(map(list, zip(*left, strict=True)))])
            elif every and not left:
                self.waiting.clear()
            due = None
            if state is None:
                due = min([_ms(x[0]) for x in left[:1]] + ([last // 1000 + self.silent + 1] if last is not None else []))
                self.handle.registerTimer(due)
            self.held.update((events, progress, last, state is not None, due))
            if state is not None:
                yield pd.DataFrame({"run": [key[0]], "state": [state], "events": [events], "progress": [progress], "ended": [pd.Timestamp(last, unit="us")]})

    def close(self) -> None:
        pass


def run_stream(events: DataFrame, run: str = "run", ts: str = "ts", seq: str = "seq", kind: str = "kind", progress: str = "progress", done: str = "done", error: str = "error", silent: int = 1800, late: str = "10 minutes") -> DataFrame:
    """T1. The same rows as ``ended_runs`` from a stream, each when its run ends; silence counts up to the watermark.

    A run's events are kept until the watermark has passed them, so they may come in any order within ``late``; of an ended run one small row stays, which keeps it ended.
    The session needs the state store of RocksDB (``spark.sql.streaming.stateStore.providerClass``).
    """
    each = _events(events, run, ts, seq, kind, progress).withWatermark("ts", late)
    return each.groupBy("run").transformWithStateInPandas(_Runs(done, error, silent), ENDED, "Append", "EventTime")


def _stream_id(spark: SparkSession, checkpoint: str) -> str:
    """The id that a stream keeps in its checkpoint; a new checkpoint has a new one."""
    return json.loads(spark.read.text(f"{checkpoint.rstrip('/')}/metadata", wholetext=True).first()[0])["id"]


def ingest(source: DataFrame, key: str, path: str, checkpoint: str, buckets: int = 64):
    """T2. Starts a stream that adds the changes of ``source`` to the keyed table at ``path``, each batch as a part of its own.

    A batch is named by the stream (the id in its checkpoint) and its number, and taken once: replayed after a failure it changes nothing. With a new checkpoint
    the source is read again under another name, so nothing that was taken before is overwritten, what the source has forgotten stays, and what comes again
    is the same change of the same key, of which the table tells the last. ``KeyedTable.compact`` keeps the table as small as its keys.
    """
    taken = KeyedTable(source.sparkSession, path, key, buckets)

    def add(batch: DataFrame, number: int) -> None:
        taken.append(batch, _stream_id(batch.sparkSession, checkpoint), number)

    return source.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def ingested(spark: SparkSession, path: str, key: str, seq: str, value=None, buckets: int = 64) -> DataFrame:
    """T2. The last change of each key at ``path``; of one key if ``value`` is given, for which its bucket alone is read."""
    return KeyedTable(spark, path, key, buckets).read(value, seq)

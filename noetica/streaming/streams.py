"""Streaming forms: drop-folder ingestion, session windows, recurrence, load gates. Late rows past the watermark are dropped and counted."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQueryListener

from noetica.operators.tasks import BURST, COOL_HOURS, STALL_DAYS, is_single, span
from noetica.storage import there

WATERMARK, GAP = "2 hours", "2 hours"


def watch(spark: SparkSession, folder: str, schema: T.StructType, kind: str = "json", files_per_trigger: int = 1000) -> DataFrame:
    """Rows of files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(kind).load(folder)


def ingest(stream: DataFrame, table: str, checkpoint: str, key: str = "uuid", buckets: int = 64):
    """Appends each batch's rows that the Parquet table lacks; resumes by the checkpoint, and a batch that runs twice adds nothing twice.

    The table is partitioned by hash buckets of the key, in a column `bucket`. A batch reads the keys of the buckets it hits only,
    so a small batch reads a small part of a large table; buckets should be so many that one has some hundred MB.
    """
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")

    def add(batch: DataFrame, _: int) -> None:
        new = batch.dropDuplicates([key]).withColumn("bucket", bucket)
        have = there(batch.sparkSession, table)
        if have is not None:
            hit = [r.bucket for r in new.select("bucket").distinct().collect()]  # as many as buckets at most
            new = new.join(have.where(F.col("bucket").isin(hit)).select(key), key, "left_anti")
        new.write.mode("append").partitionBy("bucket").parquet(table)

    return stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class LateRows(StreamingQueryListener):
    """Counts the rows that came after their watermark, by run of a query; add it with spark.streams.addListener(...)."""

    def __init__(self):
        self.counts: dict[str, int] = {}

    def onQueryProgress(self, event) -> None:  # noqa: N802
        run, late = str(event.progress.runId), sum(s.numRowsDroppedByWatermark for s in event.progress.stateOperators)
        self.counts[run] = self.counts.get(run, 0) + late

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass


def sessions(stream: DataFrame, key: str, at: str, gap: str = GAP) -> DataFrame:
    """(key, started, last_at, n) of windows that a gap over two hours ends; last_at is the end less the gap."""
    window = F.session_window(at, gap)
    out = stream.withWatermark(at, WATERMARK).groupBy(window.alias("w"), key).agg(F.count("*").alias("n"))
    return out.select(key, F.col("w.start").alias("started"), (F.col("w.end") - F.expr(f"INTERVAL {gap}")).alias("last_at"), "n")


def idle(stream: DataFrame, key: str, at: str, burst: int = BURST) -> DataFrame:
    """Sessions of a burst; in append mode each comes out once the watermark says that two idle hours followed it."""
    return sessions(stream, key, at).where(F.col("n") >= burst)


def loads(stream: DataFrame, at: str, source: str, width: str = "1 hour", slide: str = "10 minutes", most: int = 3) -> DataFrame:
    """(started, n_sources, n, busy, single) of sliding windows; the number of sources is approximate."""
    out = stream.withWatermark(at, WATERMARK).groupBy(F.window(at, width, slide).alias("w")).agg(F.approx_count_distinct(source).alias("n_sources"), F.count("*").alias("n"), span(at).alias("span"))
    return out.select(F.col("w.start").alias("started"), "n_sources", "n", (F.col("n_sources") > most).alias("busy"), is_single().alias("single"))


class _Recurrence(StatefulProcessor):
    """Keeps a key's sources with first and last time; gives a row once when it first recurs."""

    def __init__(self, sources: int, days: int, keep: int):
        self.sources, self.days, self.keep = sources, days, keep * 24 * 3600 * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getMapState("seen", T.StructType([T.StructField("source", T.StringType())]), T.StructType([T.StructField("first", T.TimestampType()), T.StructField("last", T.TimestampType())]), self.keep)
        self.told = handle.getValueState("told", T.StructType([T.StructField("told", T.BooleanType())]), self.keep)

    def handleInputRows(self, key, rows, timer):  # noqa: N802
        for batch in rows:
            for source, group in batch.groupby("source"):
                first, last = group["ts"].min(), group["ts"].max()
                if self.seen.containsKey((source,)):
                    old = self.seen.getValue((source,))
                    first, last = min(first, pd.Timestamp(old[0])), max(last, pd.Timestamp(old[1]))
                self.seen.updateValue((source,), (first.to_pydatetime(), last.to_pydatetime()))
        spans = [(pd.Timestamp(v[0]), pd.Timestamp(v[1])) for _, v in self.seen.iterator()]
        span = (max(s[1] for s in spans) - min(s[0] for s in spans)).days
        if len(spans) >= self.sources and span >= self.days and not self.told.exists():
            self.told.update((True,))
            yield pd.DataFrame({"key": [key[0]], "n_sources": [len(spans)], "days": [span]})

    def close(self) -> None:
        pass


def recurrence(stream: DataFrame, sources: int = 3, days: int = 14, keep: int = 365) -> DataFrame:
    """(key, n_sources, days), once for each key of (key, source, ts) that so many sources mention over so many days.

    Needs the RocksDB state store. A key keeps one entry for each source, for `keep` days of processing time after the last
    mention, so state grows with the keys of that time; a key that recurs after it is told again.
    """
    return stream.groupBy("key").transformWithStateInPandas(_Recurrence(sources, days, keep), "key string, n_sources int, days int", outputMode="update", timeMode="processingTime")


DAY, HOUR = 24 * 3600 * 1000, 3600 * 1000
LONG = T.LongType()


class _Stalls(StatefulProcessor):
    """A thread's last activity, when it was last surfaced, and whether this stall has been told; rows wait until the watermark passes them.

    Times are milliseconds. One timer is set at a time: for the next row that waits, the next stall, or the end of the window.
    """

    def __init__(self, window: tuple[int, int], cool: int):
        self.from_, self.to, self.cool = window[0] * DAY, window[1] * DAY, cool * HOUR

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.thread = handle.getValueState("thread", T.StructType([T.StructField("last", LONG), T.StructField("surfaced", LONG), T.StructField("told", T.BooleanType())]))
        self.waiting = handle.getListState("waiting", T.StructType([T.StructField("at", LONG), T.StructField("surfaced", T.BooleanType())]))

    def _due(self, last: int | None, surfaced: int | None, told: bool) -> int | None:
        """When the thread should be told next: not during a cool-down, and not past its window."""
        if last is None or told:
            return None
        due = max(last + self.from_, surfaced + self.cool if surfaced is not None else last)
        return due if due <= last + self.to else None

    def _advance(self, key, upto: int):
        """Takes in what has waited long enough, in order, and tells of stalls in between and since."""
        last, surfaced, told = self.thread.get() if self.thread.exists() else (None, None, False)
        rows = sorted((r[0], r[1]) for r in self.waiting.get()) if self.waiting.exists() else []
        ready, rest, out = [r for r in rows if r[0] <= upto], [r for r in rows if r[0] > upto], []
        for at, is_surfaced in [*ready, (upto + 1, None)]:
            due = self._due(last, surfaced, told)
            if due is not None and due < at:
                out.append((key[0], pd.Timestamp(last, unit="ms"), pd.Timestamp(due, unit="ms"), (due - last) // DAY))
                surfaced, told = due, True
            if is_surfaced:
                surfaced = at if surfaced is None else max(surfaced, at)
            elif is_surfaced is not None and (last is None or at > last):
                last, told = at, False
        gone = last is None or last + self.to <= upto
        if gone and (surfaced is None or surfaced + self.cool <= upto):
            self.thread.clear()
        else:
            self.thread.update((last, surfaced, told))
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        due = self._due(last, surfaced, told)
        ends = [x for x in (last + self.to if last is not None else None, surfaced + self.cool if surfaced is not None else None) if x is not None and x > upto]
        if times := [*(r[0] for r in rest), *([due] if due is not None else []), *([max(ends)] if ends else [])]:
            self.handle.registerTimer(max(upto + 1, min(times)))
        if out:
            yield pd.DataFrame(out, columns=["thread_id", "last_at", "due_at", "idle_days"])

    def handleInputRows(self, key, rows, timerValues):  # noqa: N802, N803
        for batch in rows:
            self.waiting.appendList([(int(t.value // 1_000_000), k == "surfaced") for t, k in zip(batch["at"], batch["kind"], strict=True)])
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N802, N803
        yield from self._advance(key, timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def stalls(stream: DataFrame, window: tuple[int, int] = STALL_DAYS, cool_hours: int = COOL_HOURS, late: str = WATERMARK) -> DataFrame:
    """(thread_id, last_at, due_at, idle_days) of threads that stall, once for each stall, from rows (thread_id, at, kind).

    A thread is due when it has been idle for the first days of the window, and not while it is in the cool-down after it was
    surfaced, by this stream or by a row of kind 'surfaced'; then it is due at the end of the cool-down if that is still within the
    window. Any other kind is activity and arms the timer again; activity at the very moment a thread is due comes too late. What
    comes out depends on the rows' times only: rows that are less than `late` behind wait and are put in order, later ones are dropped.
    A thread without activity for the whole window leaves no state. Needs the RocksDB state store.
    """
    rows = stream.select(F.col("thread_id").cast("string").alias("thread_id"), "at", "kind").withWatermark("at", late)
    return rows.groupBy("thread_id").transformWithStateInPandas(_Stalls(window, cool_hours), "thread_id string, last_at timestamp, due_at timestamp, idle_days long", outputMode="append", timeMode="eventTime")

"""Polling a folder, debouncing, incremental runs, stage order, progress; and event-time windows beyond that."""

from __future__ import annotations

import queue
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle, TimerValues

STAGES = ("index", "video", "classical", "embed", "tag", "story")


def candidates(files: DataFrame, known: DataFrame) -> DataFrame:
    """Files with no row, or whose time differs by more than a microsecond. ``known``: path, mtime of photos and videos."""
    k = known.groupBy("path").agg(F.max("mtime").alias("_mtime"))
    return files.join(k, "path", "left").where(F.col("_mtime").isNull() | (F.abs(F.col("mtime") - F.col("_mtime")) > 1e-6)).drop("_mtime")


#: The state store that state with a time to live needs, and the setting that names it.
STORE_KEY, STORE = "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Debounce(StatefulProcessor):
    """Of each path its last poll, size and time; given up when nothing comes for the time to live."""

    def __init__(self, ttl_ms: int):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", "poll long, size long, mtime double", self.ttl_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timers: TimerValues) -> Iterator[pd.DataFrame]:
        last, out = self.seen.get() if self.seen.exists() else None, []
        for poll, size, mtime in sorted(x for pdf in rows for x in zip(pdf["poll"].tolist(), pdf["size"].tolist(), pdf["mtime"].tolist(), strict=True)):
            if last is not None and tuple(last) == (poll - 1, size, mtime):
                out.append(poll)
            last = (poll, size, mtime)
        self.seen.update(last)
        yield pd.DataFrame({"poll": pd.Series(out, dtype="int64"), "path": pd.Series([key[0]] * len(out), dtype="object")})

    def close(self) -> None:
        pass


def debounced(polls: DataFrame, ttl_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """(poll, path) of a stream of polls (poll, path, size, mtime): a path comes out when two polls in a row agree on it.

    A path that a poll misses is forgotten: the state holds the number of the poll that saw it last. State of a path that has
    not been seen for ``ttl_ms`` is removed, so that files that vanish leave nothing; keep it above the time between two
    polls. It needs the state store STORE, set where the session is made.
    """
    if polls.sparkSession.conf.get(STORE_KEY, None) != STORE:
        raise ValueError(f"{STORE_KEY} must be {STORE}")
    polls = polls.select("poll", "path", "size", "mtime")
    return polls.groupBy("path").transformWithStateInPandas(_Debounce(ttl_ms), "poll long, path string", "append", "processingTime")


def each_batch(stream: DataFrame, index: Callable[[DataFrame], int], stages: Iterable[Callable[[], None]], checkpoint: str) -> StreamingQuery:
    """Z3: indexes each batch's paths, and runs the later stages where rows were added."""

    def run(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty() and index(batch) > 0:
            for s in stages:
                s()

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def run_stages(stages: dict[str, Callable[[], None]], pending: Callable[[str], bool], cancelled: Callable[[], bool] = lambda: False) -> list[str]:
    """The stages in order, those without pending work passed over, until cancelled; the names that ran."""
    ran = []
    for name in STAGES:
        if cancelled():
            break
        if name in stages and pending(name):
            stages[name]()
            ran.append(name)
    return ran


class Progress(StreamingQueryListener):
    """Fans messages out to subscribers; a subscriber whose queue of 100 is full misses what comes."""

    def __init__(self, size: int = 100):
        self.size, self.queues = size, []

    def subscribe(self) -> queue.Queue:
        self.queues.append(queue.Queue(self.size))
        return self.queues[-1]

    def publish(self, message: dict) -> None:
        for q in self.queues:
            try:
                q.put_nowait(message)
            except queue.Full:
                pass

    def onQueryStarted(self, event) -> None:
        self.publish({"event": "started", "id": str(event.id)})

    def onQueryProgress(self, event) -> None:
        self.publish({"event": "progress", "rows": event.progress.numInputRows})

    def onQueryIdle(self, event) -> None:
        self.publish({"event": "idle", "id": str(event.id)})

    def onQueryTerminated(self, event) -> None:
        self.publish({"event": "ended", "id": str(event.id)})


def tumbling(events: DataFrame, at: str, width: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """Counts per window and key; on a stream, rows later than ``late`` are dropped with their state."""
    return events.withWatermark(at, late).groupBy(F.window(at, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def sessionised(events: DataFrame, at: str, gap: str, by: list[str], late: str = "10 minutes") -> DataFrame:
    """(start, end, by, n) of sessions without a gap of ``gap``."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap), *by).agg(F.count("*").alias("n")).select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *by, "n")

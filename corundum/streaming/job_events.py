"""Job events as a stream: the state machine of each job, the changes worth telling, and a sink that
takes each batch once."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from corundum.sources.folders import _at, exists, names_in

#: What may follow what; a job that has ended takes no event.
NEXT = {None: {"queued"}, "queued": {"running", "cancelled", "interrupted"}, "running": {"completed", "failed", "cancelled", "interrupted", "running"}}
ENDED = ("completed", "failed", "cancelled", "interrupted")
STATES = (None, "queued", "running", *ENDED, "?")
#: How long the state of a job that has ended is kept, and of one that nothing is heard of.
KEEP_ENDED_MS, KEEP_SILENT_MS = 24 * 3600 * 1000, 30 * 24 * 3600 * 1000
EVENT = "job_id string, event_id long, ts timestamp, asked string, status string, allowed boolean, changed boolean"

#: The state after an event, by event and state; an event that isn't allowed leaves it.
_ALLOWED = np.array([[e in NEXT.get(s, ()) for s in STATES] for e in STATES])
_AFTER = np.where(_ALLOWED, np.arange(len(STATES))[:, None], np.arange(len(STATES))[None, :])


def advance_job(asked: pd.Series, payload: pd.Series, status: str | None, told: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For events of one job in order, from a status and its payload: the state after each, whether
    it was allowed, and whether it changed the job. Each event is a map of states; maps are composed
    by doubling, so no event waits for the one before."""
    codes = np.array([STATES.index(a) if a in STATES[1:-1] else len(STATES) - 1 for a in asked])
    maps, shift = _AFTER[codes], 1
    while shift < len(maps):
        maps = np.concatenate((maps[:shift], np.take_along_axis(maps[shift:], maps[:-shift], axis=1)))
        shift *= 2
    start = STATES.index(status)
    after = maps[:, start]
    allowed = _ALLOWED[codes, np.concatenate(([start], after[:-1]))]
    at = np.flatnonzero(allowed)
    changed = np.zeros(len(codes), bool)
    texts = payload.to_numpy(object)[at]
    before = [(status, told), *zip(after[at][:-1].tolist(), texts[:-1])]
    changed[at] = [(STATES[s], t) != ((b if k == 0 else STATES[b]), p) for k, (s, t, (b, p)) in enumerate(zip(after[at].tolist(), texts, before))]
    return after, allowed, changed


class Jobs(StatefulProcessor):
    """A job's status and payload as a value with a time to live, and a timer that forgets a job some
    time after its end."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "status string, payload string", ttlDurationMs=KEEP_SILENT_MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        status, told = self.job.get() if self.job.exists() else (None, None)
        events = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        after, allowed, changed = advance_job(events["status"], events["payload"], status, told)
        if allowed.any():
            new, payload = STATES[int(after[-1])], events["payload"].to_numpy(object)[allowed][-1]
            self.job.update((new, payload))
            if new in ENDED:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + KEEP_ENDED_MS)
        yield pd.DataFrame({"job_id": key[0], "event_id": events["event_id"], "ts": events["ts"], "asked": events["status"], "status": [STATES[s] for s in after.tolist()], "allowed": allowed, "changed": changed})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        self.job.clear()
        return iter(())

    def close(self) -> None:
        pass


def advance(events: DataFrame) -> DataFrame:
    """Each event with the status that its job has after it, whether it was allowed, and whether
    the job changed by it. events: job_id string, event_id long, ts timestamp, status string, payload
    string. State lies in the embedded store, whose size memory doesn't bound."""
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    source = events.select("job_id", "event_id", "ts", "status", "payload")
    return source.groupBy("job_id").transformWithStateInPandas(Jobs(), EVENT, "append", "ProcessingTime")


def changes(events: DataFrame) -> DataFrame:
    """The events to tell: those that change what was told last of their job."""
    return advance(events).where("changed")


class ChangeSink:
    """Rows of a stream's batches in folder. A batch lies under its number and counts once its mark is
    there; a batch that comes again is passed over if it has its mark, else written anew. So a stream
    that dies anywhere tells each change once."""

    def __init__(self, spark: SparkSession, folder: str, schema: str = EVENT):
        self.spark, self.folder, self.schema = spark, folder, schema

    def _mark(self, batch_id: int) -> str:
        return f"{self.folder}/marks/{batch_id}"

    def write(self, rows: DataFrame, batch_id: int) -> None:
        if exists(self.spark, self._mark(batch_id)):
            return
        rows.write.mode("overwrite").parquet(f"{self.folder}/batches/{batch_id}")
        fs, p = _at(self.spark, self._mark(batch_id))
        fs.create(p).close()

    def read(self) -> DataFrame:
        """The rows of all batches that have their marks."""
        paths = [f"{self.folder}/batches/{m}" for m in names_in(self.spark, f"{self.folder}/marks") if m.isdigit()]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


def tell(events: DataFrame, sink: ChangeSink, checkpoint: str) -> StreamingQuery:
    """Starts a stream that tells the changes of what has come since its last run into the sink, and
    ends when there is no more. Timers run with the next events: batches without any, of which a
    stream with timers has no last, are off for this stream."""
    conf, key = events.sparkSession.conf, "spark.sql.streaming.noDataMicroBatches.enabled"
    before = conf.get(key)
    out = changes(events).writeStream.outputMode("append").foreachBatch(sink.write)
    conf.set(key, "false")
    try:  # a stream takes the settings that hold as it starts
        return out.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        conf.set(key, before)


def activity(events: DataFrame, *, window: str = "5 minutes", delay: str = "10 minutes") -> DataFrame:
    """Events by status and window of event time; later than delay, they are left out."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", window), "status").agg(F.count("*").alias("n"))

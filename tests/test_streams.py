"""The job stream: its state machine, its state over restarts, and its sink."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from corundum.streaming import job_events

SCHEMA = "job_id string, event_id long, ts timestamp, status string, payload string"


def plain(events, status=None, told=None):
    """One event after the other."""
    out = []
    for asked, payload in events:
        allowed = asked in job_events.NEXT.get(status, ())
        changed = allowed and (asked, payload) != (status, told)
        if allowed:
            status, told = asked, payload
        out.append((status, allowed, changed))
    return out


def test_maps_of_states_equal_one_event_after_the_other():
    rng = random.Random(3)
    words = ["queued", "running", "running", "running", "completed", "failed", "cancelled", "interrupted", "nonsense", None]
    for _ in range(400):
        events = [(rng.choice(words), rng.choice(["a", "b", None])) for _ in range(rng.randint(1, 40))]
        status = rng.choice([None, "queued", "running", "failed"])
        told = None if status is None else rng.choice(["a", None])
        after, allowed, changed = job_events.advance_job(pd.Series([e for e, _ in events], dtype=object), pd.Series([p for _, p in events], dtype=object), status, told)
        assert [(job_events.STATES[s], bool(a), bool(c)) for s, a, c in zip(after, allowed, changed)] == plain(events, status, told)


def events_of(spark, *rows):
    df = spark.createDataFrame(list(rows), "job_id string, event_id long, status string, payload string")
    return df.select("job_id", "event_id", F.timestamp_seconds("event_id").alias("ts"), "status", "payload")


def run(spark, tmp_path, sink, *rows):
    if rows:
        events_of(spark, *rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in")
    assert job_events.tell(stream, sink, f"file://{tmp_path}/c").awaitTermination(180)


def test_a_batch_that_fails_is_told_once(spark, tmp_path, monkeypatch):
    """Begun again three times; the second batch fails after its rows are written, before its mark."""
    sink = job_events.ChangeSink(spark, f"file://{tmp_path}/out")
    told = lambda: sorted((r.event_id, r.status) for r in sink.read().collect())
    run(spark, tmp_path, sink, ("a", 1, "queued", "x"), ("a", 2, "running", "x"), ("b", 3, "running", "x"))
    assert told() == [(1, "queued"), (2, "running")]
    exists, write = job_events._at, job_events.ChangeSink.write

    def fails(self, rows, batch_id):
        monkeypatch.setattr(job_events, "_at", lambda *a: (_ for _ in ()).throw(RuntimeError("killed")))
        write(self, rows, batch_id)

    monkeypatch.setattr(job_events.ChangeSink, "write", fails)
    with pytest.raises(Exception, match="killed"):
        run(spark, tmp_path, sink, ("a", 4, "running", "y"), ("a", 5, "completed", "y"))
    monkeypatch.setattr(job_events, "_at", exists)
    monkeypatch.setattr(job_events.ChangeSink, "write", write)
    assert told() == [(1, "queued"), (2, "running")]  # the rows are there, their mark isn't
    run(spark, tmp_path, sink)
    assert told() == [(1, "queued"), (2, "running"), (4, "running"), (5, "completed")]
    run(spark, tmp_path, sink, ("a", 6, "running", "z"), ("b", 7, "queued", "x"))  # a has ended
    assert told()[-1] == (7, "queued") and len(told()) == 5
    sink.write(events_of(spark, ("z", 9, "queued", "x")).select("job_id", "event_id", "ts", F.col("status").alias("asked"), "status", F.lit(True).alias("allowed"), F.lit(True).alias("changed")), 0)
    assert len(told()) == 5  # a batch that comes again


def test_job_stream(spark, tmp_path):
    rows = [("a", 1, "queued", "x"), ("a", 2, "running", "x"), ("a", 3, "running", "x"), ("a", 4, "running", "y"), ("a", 5, "completed", "y"), ("a", 6, "running", "z"), ("b", 7, "running", "x"), ("b", 8, "queued", "x"), ("b", 9, "cancelled", "x")]
    sink = job_events.ChangeSink(spark, f"file://{tmp_path}/out")
    run(spark, tmp_path, sink, *rows)
    got = sink.read().select("event_id", "status").orderBy("event_id").collect()
    assert [tuple(r) for r in got] == [(1, "queued"), (2, "running"), (4, "running"), (5, "completed"), (8, "queued"), (9, "cancelled")]

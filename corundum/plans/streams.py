"""Queries that run a stream over a table, in parts as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corundum.plans.base import query, view
from corundum.sources.folders import scratch
from corundum.streaming.job_events import ChangeSink, tell

# A user is a job; what its events ask for goes by their type.
JOB_EVENTS = """SELECT CAST(user_id AS VARCHAR(20)) AS job_id, CAST(event_id AS BIGINT) AS event_id, ts, CAST(CAST(floor(value / 8) AS INT) AS VARCHAR(20)) AS payload,
 CASE WHEN event_type = 'signup' THEN 'queued' WHEN event_type = 'purchase' AND event_id % 9 = 0 THEN 'completed' WHEN event_type = 'error' AND event_id % 7 = 0 THEN 'failed' WHEN event_type = 'error' AND event_id % 11 = 0 THEN 'cancelled' ELSE 'running' END AS status FROM {events}"""


# A job's first event to queue, its first to run or to end after that, and its first end after that;
# between the last two what runs is told where its payload differs from the one before.
@query(f"""WITH e AS ({JOB_EVENTS}), n AS (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS i FROM e),
q AS (SELECT job_id, min(i) AS q FROM n WHERE status = 'queued' GROUP BY 1),
r AS (SELECT n.job_id, min(i) AS r FROM n JOIN q ON q.job_id = n.job_id WHERE i > q AND status IN ('running', 'cancelled') GROUP BY 1),
s AS (SELECT n.job_id, n.status AS how FROM n JOIN r ON r.job_id = n.job_id AND n.i = r.r),
t AS (SELECT n.job_id, min(i) AS t FROM n JOIN r ON r.job_id = n.job_id JOIN s ON s.job_id = n.job_id WHERE how = 'running' AND i > r AND status IN ('completed', 'failed', 'cancelled') GROUP BY 1),
k AS (SELECT n.*, lag(payload) OVER (PARTITION BY n.job_id ORDER BY i) AS before, r, t FROM n JOIN r ON r.job_id = n.job_id JOIN s ON s.job_id = n.job_id LEFT JOIN t ON t.job_id = n.job_id WHERE how = 'running' AND status = 'running' AND i >= r AND i < coalesce(t, 1000000000))
SELECT n.job_id, event_id, status FROM n JOIN q ON q.job_id = n.job_id AND i = q UNION ALL SELECT n.job_id, event_id, status FROM n JOIN r ON r.job_id = n.job_id AND i = r
UNION ALL SELECT n.job_id, event_id, status FROM n JOIN t ON t.job_id = n.job_id AND i = t UNION ALL SELECT job_id, event_id, status FROM k WHERE i > r AND payload <> before""")
def job_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changes told by a stream that is begun again twice, as parts of the events come."""
    folder = scratch(spark)
    events = view(spark, sf_dir, JOB_EVENTS)
    most = events.agg(F.max("event_id")).first()[0] or 0
    sink = ChangeSink(spark, f"{folder}/told")
    source = events.select("job_id", "event_id", "ts", "status", "payload")
    for k in range(3):
        source.where(F.floor(3 * F.col("event_id") / (most + 1)) == k).write.parquet(f"{folder}/events/{k}")
        stream = spark.readStream.schema(source.schema).option("recursiveFileLookup", "true").parquet(f"{folder}/events")
        tell(stream, sink, f"{folder}/checkpoint").awaitTermination()
    return sink.read().select("job_id", "event_id", "status")

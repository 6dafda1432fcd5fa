"""Jobs as events: the latest state of each, progress, the roll-up over domains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corundum.schemas import DOMAINS

STAGES, TICKS = 5, 8
# The record type that is taken where none is named, the columns of exported records,
# the characters of a source's text in a snapshot.
DEFAULT_TITLE = "Benzimidazoles"
RECORD_COLUMNS = ("object_id", "primary_value", "property", "evidence", "confidence")
SNAPSHOT_CHARS = 250_000


def progress(stage: Column, tick: Column) -> Column:
    """Per cent, 98 at most, of stage (from 0) and tick."""
    return F.least(F.lit(98), F.bround((stage / STAGES + tick / TICKS / STAGES) * 100, 0).cast("int"))


def latest(events: DataFrame, *, by: str, at: str, tie: str) -> DataFrame:
    """The last event of each job; a full order, so ties don't differ between runs. The aggregation
    sums before the shuffle, which a window wouldn't."""
    row = F.struct(at, tie, F.struct(*events.columns).alias("row"))
    return events.groupBy(F.col(by).alias("key")).agg(F.max(row)["row"].alias("row")).select("row.*")


def interrupted(jobs: DataFrame) -> DataFrame:
    """Jobs found running or queued at a start are interrupted."""
    return jobs.withColumn("status", F.when(F.col("status").isin("running", "queued"), "interrupted").otherwise(F.col("status")))


def changes(events: DataFrame, *, by: str, order: list[str], value: str) -> DataFrame:
    """Events whose value differs from the one before, and the first."""
    before = F.lag(value).over(Window.partitionBy(by).orderBy(*order))
    return events.withColumn("before", before).where(F.col("before").isNull() | ~F.col("before").eqNullSafe(F.col(value)))


def dashboard(jobs: DataFrame, domains: DataFrame) -> DataFrame:
    """A row a domain: score and record count of its latest completed job, number of such jobs, the
    difference from its baseline. jobs: job_id, domain, status, updated_at, macro_f1, record_count;
    domains: domain, baseline."""
    c = F.col
    done = jobs.where("status = 'completed' and macro_f1 is not null")
    last = done.groupBy("domain").agg(F.max(F.struct("updated_at", "job_id", "macro_f1", "record_count")).alias("j"), F.count("*").alias("run_count"))
    out = domains.join(last, "domain", "left")
    return out.select(
        "domain", "baseline", c("j.macro_f1").alias("current"), F.round(c("j.macro_f1") - c("baseline"), 3).alias("delta"), F.coalesce("j.record_count", F.lit(0)).alias("record_count"),
        F.coalesce("run_count", F.lit(0)).alias("run_count"), c("j.job_id").alias("job_id"), F.when(c("j").isNotNull(), "completed run").otherwise("no completed runs").alias("status"),
    )


def summary(board: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row over the dashboard."""
    done = jobs.where("status = 'completed' and macro_f1 is not null").agg(F.count("*").alias("completed_runs"), F.coalesce(F.sum("record_count"), F.lit(0)).alias("total_rows"))
    both = F.col("current").isNotNull() & F.col("baseline").isNotNull()
    means = board.agg(F.count("current").alias("tracked_domains"), F.avg("current").alias("c"), F.avg(F.when(both, F.col("baseline"))).alias("b"))
    return means.crossJoin(done).select("tracked_domains", "completed_runs", "total_rows", F.round("b", 3).alias("avg_baseline"), F.round("c", 3).alias("avg_current"), F.round(F.col("c") - F.col("b"), 3).alias("avg_delta"))


def public_view(jobs: DataFrame, secrets: tuple[str, ...] = ("api_key",), logs: int = 30) -> DataFrame:
    """Jobs without their keys, only whether there is one, and with their last log lines."""
    out = jobs
    for s in secrets:
        if s in out.columns:
            out = out.withColumn(f"{s}_configured", F.coalesce(F.col(s), F.lit("")) != "").drop(s)
    return out.withColumn("logs", F.slice("logs", F.greatest(F.size("logs") - logs + 1, F.lit(1)), logs)) if "logs" in out.columns else out


def domain_title(name: Column) -> Column:
    """The title of the record type that a name stands for in any case, else that of the default."""
    out = F.lit(DEFAULT_TITLE)
    for d in DOMAINS.values():
        out = F.when(F.lower(name) == d.title.lower(), F.lit(d.title)).otherwise(out)
    return out


def domain_key(title: Column) -> Column:
    """The key of a record type's title as it is written; null for others."""
    out = F.lit(None).cast("string")
    for d in DOMAINS.values():
        out = F.when(title == d.title, F.lit(d.key)).otherwise(out)
    return out


def takes_whole_pipeline(source_type: Column, title: Column, saved_path: Column) -> Column:
    """Whether a job's source can go through scrape, agents and model: a saved PDF or archive, and a
    record type of the registry."""
    there = F.lower(F.coalesce(source_type, F.lit(""))).isin("pdf", "zip") & domain_key(title).isNotNull()
    return F.coalesce(there & (F.coalesce(saved_path, F.lit("")) != ""), F.lit(False))


def newest_first(jobs: DataFrame, limit: int | None = None) -> DataFrame:
    """Jobs by their beginning, the newest first; of one time by id."""
    ordered = jobs.orderBy(F.desc_nulls_last("created_at"), "job_id")
    return ordered if limit is None else ordered.limit(limit)


def snapshots(jobs: DataFrame, secrets: tuple[str, ...] = ("api_key",)) -> DataFrame:
    """job_id and snapshot, the job as JSON: without its keys, only whether there is one, and with its
    source's text cut."""
    kept = public_view(jobs, secrets, logs=2**31 - 1)
    if "source_text" in kept.columns:
        kept = kept.withColumn("source_text", F.left(F.coalesce("source_text", F.lit("")), F.lit(SNAPSHOT_CHARS)))
    return kept.select("job_id", F.to_json(F.struct(*(F.col(f"`{x}`") for x in kept.columns)), {"ignoreNullFields": "false"}).alias("snapshot"))


def record_table(records: DataFrame) -> DataFrame:
    """The columns that a job's records are exported with, empty where a record lacks one."""
    have = lambda x: F.coalesce(F.col(f"`{x}`").cast("string"), F.lit("")) if x in records.columns else F.lit("")
    return records.select(*(have(x).alias(x) for x in RECORD_COLUMNS))

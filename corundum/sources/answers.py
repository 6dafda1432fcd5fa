"""A model's answers, kept: no request is asked again once a task that asked it has committed.

A request goes by a hash of all that the model is given. A call asks what the ledger lacks, in tasks of
few requests each, or of a small share of a large call's. A task commits its answers to the ledger's folder as it ends, whatever becomes of the
job, so a job that dies leaves the answers of the tasks that were done, and its repetition asks the rest.
Requests that failed are asked again, some times in one call, and by later calls."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corundum.sources.adapters import Client, complete
from corundum.sources.folders import exists

c = F.col
#: Requests of a task: what is asked again if it dies.
PER_TASK = 64
#: Tasks of a call, beyond which each has more requests (a two-thousandth of the call's): a task costs a
#: tenth of a second and a file beside its requests, which tasks of 64 would spend most of a large call on.
MOST_TASKS = 2_000
KEPT = "request string, content string, error string, asked_at timestamp"


def request_hash(model: str) -> Column:
    """Of a row with system, prompt and images."""
    images = F.coalesce(F.transform("images", lambda i: F.sha2(i, 256)), F.array().cast("array<string>"))
    return F.sha2(F.to_json(F.struct(F.lit(model).alias("model"), F.coalesce("system", F.lit("")).alias("system"), F.coalesce("prompt", F.lit("")).alias("prompt"), images.alias("images"))), 256)


class Answers:
    """The ledger in folder, shared storage on a cluster. model: whatever an answer depends on beside
    the request. attempts: how often a call asks a request that fails. per_second: requests of one
    task in a second, at most; as many tasks ask at a time as the session has cores for them."""

    def __init__(self, spark: SparkSession, folder: str, model: str = "", *, attempts: int = 2, per_second: float | None = None):
        self.spark, self.folder, self.model, self.attempts, self.per_second = spark, folder, model, attempts, per_second

    def kept(self) -> DataFrame:
        """request, content, error: the first answer of each request, or its last error."""
        if not exists(self.spark, self.folder):
            return self.spark.range(0).select(*(F.lit(None).cast("string").alias(n) for n in ("request", "content", "error")))
        rows = self.spark.read.schema(KEPT).option("recursiveFileLookup", "true").parquet(self.folder)
        first = F.min(F.when(c("content").isNotNull(), F.struct("asked_at", "content")))
        return rows.groupBy("request").agg(first["content"].alias("content"), F.max(F.struct("asked_at", "error"))["error"].alias("error")).withColumn("error", F.when(c("content").isNull(), c("error")))

    def ask(self, requests: DataFrame, client: Client) -> DataFrame:
        """request_id, content, error of requests (request_id, system, prompt, images). Those that
        ask the same are asked once."""
        hashed = requests.select("request_id", "system", "prompt", "images", request_hash(self.model).alias("request"))
        for _ in range(self.attempts):
            lacking = hashed.join(self.kept().where("content is not null").select("request"), "request", "left_anti")
            n = lacking.agg(F.count_distinct("request")).first()[0]
            if not n:
                break
            one = lacking.groupBy("request").agg(F.any_value(F.struct("system", "prompt", "images")).alias("r"))  # equal in all rows
            dealt = one.select(c("request").alias("request_id"), "r.*").repartition(min(-(-n // PER_TASK), MOST_TASKS), "request_id")
            told = complete(dealt, client, per_second=self.per_second).select(c("request_id").alias("request"), "content", "error", F.current_timestamp().alias("asked_at"))
            # Version 2 of the committer: a task's files are in place as it ends, not as the job does.
            told.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").parquet(f"{self.folder}/{uuid.uuid4().hex}")
        return hashed.select("request_id", "request").join(self.kept(), "request", "left").select("request_id", "content", "error")

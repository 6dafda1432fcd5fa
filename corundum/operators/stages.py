"""Stages over documents that are run again only for what has changed.

A ledger holds which documents a stage has been run for: the document, a hash of what the stage was
given (the document's content and the settings of all stages before), a hash of the stage's own settings,
and the run whose output holds its rows. A stage is run for the documents that the ledger lacks; the rows
of the others come from the runs before. So a second run touches what has changed, and a changed setting
runs its stage again and those after it, not those before.

A run's output is written before its entries, so a run that dies in between is made again; entries are
one a document, the latest. Documents that have gone aren't asked for, and their rows aren't read."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corundum.sources.folders import exists

c = F.col
ENTRY = "doc_id string, given string, run string, made_at timestamp"


@dataclass(frozen=True)
class Stage:
    """make gets the documents to run for, as they were given, and what the stages before give of
    these, by name; it returns rows with doc_id, of the columns of schema (DDL). A stage that is off
    is passed over: it gives no rows, and those after it are run as if it weren't there."""

    name: str
    schema: str
    make: Callable[[DataFrame, dict[str, DataFrame]], DataFrame]
    settings: dict = field(default_factory=dict)
    on: bool = True

    @property
    def version(self) -> str:
        return hashlib.sha256(json.dumps([self.name, self.schema, self.settings], sort_keys=True, default=str).encode()).hexdigest()[:24]


class StageLedger:
    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def entries(self, stage: Stage) -> DataFrame:
        """doc_id, given, run of a stage under its present settings: the latest of each document and
        what it was given."""
        path = f"{self.folder}/{stage.name}/{stage.version}/entries"
        if not exists(self.spark, path):
            return self.spark.range(0).select(*(F.lit(None).cast("string").alias(n) for n in ("doc_id", "given", "run")))
        rows = self.spark.read.schema(ENTRY).parquet(path)
        return rows.groupBy("doc_id", "given").agg(F.max(F.struct("made_at", "run"))["run"].alias("run"))

    def run(self, docs: DataFrame, stage: Stage, given: DataFrame, before: dict[str, DataFrame]) -> DataFrame:
        """The rows of a stage for docs. given: doc_id and the hash of what the stage is given."""
        at = f"{self.folder}/{stage.name}/{stage.version}"
        # Joins are by shuffles: sizes are guessed from files whose ids are packed, and a table of ids
        # that is taken for small would go through the driver.
        lacking = given.join(self.entries(stage).select("doc_id", "given").hint("merge"), ["doc_id", "given"], "left_anti")
        if not lacking.isEmpty():
            run = uuid.uuid4().hex
            ids = lacking.select("doc_id")
            only = lambda df: df.join(ids.hint("merge"), "doc_id", "left_semi")
            made = stage.make(only(docs), {name: only(df) for name, df in before.items()})
            made.select(*(c(f"`{f}`") for f in _names(stage.schema))).write.parquet(f"{at}/rows/run={run}")
            lacking.select("doc_id", "given", F.lit(run).alias("run"), F.current_timestamp().alias("made_at")).write.mode("append").parquet(f"{at}/entries")
        if not exists(self.spark, f"{at}/rows"):
            return self.spark.createDataFrame([], stage.schema)
        rows = self.spark.read.schema(f"{stage.schema}, run string").parquet(f"{at}/rows")
        current = given.join(self.entries(stage).hint("merge"), ["doc_id", "given"]).select("doc_id", "run")
        return rows.join(current.hint("merge"), ["doc_id", "run"], "left_semi").drop("run")


def _names(schema: str) -> list[str]:
    from pyspark.sql.types import StructType

    return StructType.fromDDL(schema).names


def run_stages(docs: DataFrame, stages: list[Stage], ledger: StageLedger, *, content: list[str] | None = None) -> dict[str, DataFrame]:
    """The rows of each stage that is on, by name. docs has a doc_id (one row each); content names the
    columns that a document's content is (by default all others)."""
    columns = content or [x for x in docs.columns if x != "doc_id"]
    given = docs.select(c("doc_id").cast("string").alias("doc_id"), F.sha2(F.to_json(F.struct(*(c(f"`{x}`") for x in columns)), {"ignoreNullFields": "false"}), 256).alias("given"))
    out: dict[str, DataFrame] = {}
    for stage in stages:
        if not stage.on:
            continue
        out[stage.name] = ledger.run(docs, stage, given, dict(out))
        given = given.withColumn("given", F.sha2(F.concat_ws(":", "given", F.lit(stage.version)), 256))
    return out

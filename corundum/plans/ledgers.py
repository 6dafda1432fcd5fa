"""Queries over what is kept between runs: answers of a model, rows of stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corundum.operators.stages import Stage, StageLedger, run_stages
from corundum.plans.base import query, view
from corundum.sources.answers import Answers
from corundum.sources.folders import scratch

c = F.col

# Orders ask for their customer and priority, many the same; a tenth of the orders comes later, when
# another client answers.
ASKED = "SELECT concat('o', CAST(o_orderkey AS VARCHAR(20))) AS request_id, 'Name the customer.' AS system, concat(CAST(o_custkey AS VARCHAR(20)), ' ', o_orderpriority) AS prompt, o_orderkey % 10 = 0 AS late FROM {orders}"


def _client(name: str):  # noqa: ANN202
    return lambda: lambda system, prompt, images: f"{name}: {prompt}"


@query(f"WITH a AS ({ASKED}), k AS (SELECT DISTINCT prompt FROM a WHERE NOT late) SELECT request_id, concat(CASE WHEN k.prompt IS NULL THEN 'second' ELSE 'first' END, ': ', a.prompt) AS content FROM a LEFT JOIN k ON k.prompt = a.prompt")
def kept_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    answers = Answers(spark, f"{scratch(spark)}/answers", "a model")
    asked = view(spark, sf_dir, ASKED).withColumn("images", F.lit(None).cast("array<binary>"))
    answers.ask(asked.where("not late"), _client("first"))
    return answers.ask(asked, _client("second")).select("request_id", "content")


# Parts are documents; a third of them change between two runs, a seventh go; the second of three
# stages has another setting in the second run.
BEFORE = "SELECT CAST(p_partkey AS VARCHAR(20)) AS doc_id, p_name AS text FROM {part}"
AFTER = "SELECT CAST(p_partkey AS VARCHAR(20)) AS doc_id, CASE WHEN p_size % 3 = 0 THEN concat(p_name, ' changed') ELSE p_name END AS text FROM {part} WHERE p_partkey % 7 <> 0"


def _stages(run: int, setting: int) -> list[Stage]:
    rows = "doc_id string, n bigint, made_in int"
    words = lambda docs, _: docs.select("doc_id", F.size(F.split("text", " ")).cast("long").alias("n"), F.lit(run).alias("made_in"))
    more = lambda source, by: lambda docs, found: found[source].select("doc_id", (c("n") * by).alias("n"), F.lit(run).alias("made_in"))
    return [Stage("words", rows, words), Stage("scaled", rows, more("words", setting), {"by": setting}), Stage("doubled", rows, more("scaled", 2)), Stage("none", rows, words, on=False)]


@query("""WITH d AS (SELECT CAST(p_partkey AS VARCHAR) AS doc_id, len(string_split(p_name, ' ')) + CASE WHEN p_size % 3 = 0 THEN 1 ELSE 0 END AS n, CASE WHEN p_size % 3 = 0 THEN 2 ELSE 1 END AS made FROM part WHERE p_partkey % 7 <> 0)
SELECT doc_id, 'words' AS stage, CAST(n AS BIGINT) AS n, made AS made_in FROM d UNION ALL SELECT doc_id, 'scaled', CAST(n * 5 AS BIGINT), 2 FROM d UNION ALL SELECT doc_id, 'doubled', CAST(n * 10 AS BIGINT), 2 FROM d""")
def stage_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each stage has after the second run, and the run in which it was made."""
    ledger = StageLedger(spark, f"{scratch(spark)}/stages")
    run_stages(view(spark, sf_dir, BEFORE), _stages(1, 3), ledger)
    found = run_stages(view(spark, sf_dir, AFTER), _stages(2, 5), ledger)
    named = [df.select("doc_id", F.lit(name).alias("stage"), "n", "made_in") for name, df in found.items()]
    return named[0].union(named[1]).union(named[2])

"""Queries that go through files: what the driver's tables say is written to a scratch folder and read
again by the readers, each with its SQL."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corundum.operators import evaluate, jobs, normalize
from corundum.plans.base import query, view
from corundum.schemas import DOMAINS
from corundum.sources import adapters, tables
from corundum.sources.folders import scratch
from corundum.sources.store import export_csv, export_jsonl

c = F.col


@query("SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS name, concat('a,\"', c_mktsegment, '\"', chr(10), 'b') AS note, concat('[\"', c_nationkey, '\"]') AS listed FROM customer")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exported with quotes and line breaks in values, read by the suffix's reader."""
    out = f"{scratch(spark)}/customers.csv"
    rows = view(spark, sf_dir, "SELECT c_custkey AS k, concat(' ', c_name, ' ') AS name, concat('a,\"', c_mktsegment, '\"\n', 'b') AS note, array(CAST(c_nationkey AS STRING)) AS listed FROM {customer}")
    flat = rows.withColumn("note", F.concat(F.lit('a,"'), F.regexp_extract("note", r'"([^"]*)"', 1), F.lit('"\nb')))
    escaped = flat.select("k", "name", "note", F.to_json("listed").alias("listed"))
    escaped.write.csv(out, header=True, escape='"', quoteAll=True)
    return tables.read_any(spark, out)


@query("SELECT CAST(s_suppkey AS VARCHAR) AS pdf, 'NOT_DETECTED' AS smiles, s_name AS name, CAST(s_nationkey AS VARCHAR) AS perm, 'NOT_DETECTED' AS \"logP\" FROM supplier")
def prediction_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A prediction table written as its CSV and read as the scorer reads it."""
    d = DOMAINS["eyedrops"]
    samples = view(spark, sf_dir, "SELECT s_name AS compound, CAST(s_nationkey AS STRING) AS perm, concat('x/', CAST(s_suppkey AS STRING), '.pdf') AS file FROM {supplier}")
    out = f"{scratch(spark)}/predictions.csv"
    export_csv(normalize.sample_frame(d, samples, c("file")), out)
    return evaluate.prepare_prediction(d, tables.read_table(spark, out)).select("pdf", "smiles", "name", c("`perm (cm/s)`").alias("perm"), "logP")


# An archive for each nation: its suppliers' files, a folder, a hidden and a foreign file; one of them broken.
def _pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for r in pdf.itertuples():
            data = io.BytesIO()
            with zipfile.ZipFile(data, "w") as z:
                z.writestr("folder/", "")
                z.writestr(".hidden.pdf", "h")
                z.writestr("README.md", "r")
                for name in r.names:
                    z.writestr(f"{name}.{'PDF' if r.n_nationkey % 2 else 'pdf'}", name)
            out.append((f"z{r.n_nationkey}", b"broken" if r.n_nationkey % 5 == 0 else data.getvalue()))
        yield pd.DataFrame(out, columns=["path", "content"])


@query("""WITH s AS (SELECT s_nationkey AS k, s_name AS name, row_number() OVER (PARTITION BY s_nationkey ORDER BY lower(s_name)) AS nth FROM supplier)
SELECT concat('z', k) AS path, nth, concat(name, CASE WHEN k % 2 = 1 THEN '.PDF' ELSE '.pdf' END) AS member, name AS told, FALSE AS failed FROM s WHERE nth <= 3 AND k % 5 <> 0
UNION ALL SELECT DISTINCT concat('z', k), NULL, NULL, NULL, TRUE FROM s WHERE k % 5 = 0""", nth="INTEGER")
def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the limit: the first members of an archive."""
    named = view(spark, sf_dir, "SELECT s_nationkey AS n_nationkey, collect_list(s_name) AS names FROM {supplier} GROUP BY 1")
    files = named.mapInPandas(_pack, "path string, content binary")
    found = tables.archive_members(files, most=3)
    return found.select("path", "nth", "member", F.decode("content", "utf-8").alias("told"), c("error").isNotNull().alias("failed"))


def _pages():  # noqa: ANN202
    def parse(content: bytes) -> list[dict]:
        if content.startswith(b"bad"):
            raise ValueError("not a document")
        return [{"text": t, "width": 1.0} for t in content.decode().split("\f")]

    return parse


@query("""SELECT CAST(p_partkey AS VARCHAR) AS doc_id, k AS page_number, CASE k WHEN 1 THEN p_name WHEN 2 THEN p_brand END AS text, CAST(NULL AS VARCHAR) AS error FROM part CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) z WHERE p_size % 4 <> 0
UNION ALL SELECT CAST(p_partkey AS VARCHAR), NULL, NULL, 'not a document' FROM part WHERE p_size % 4 = 0""", page_number="INTEGER")
def parsed_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two pages of documents, by a stand-in for a parser that fails on some."""
    body = F.concat(F.when(c("p_size") % 4 == 0, "bad").otherwise(""), "p_name", F.lit("\f"), "p_brand", F.lit("\fthird"))
    files = view(spark, sf_dir, "SELECT p_partkey, p_size, p_name, p_brand FROM {part}").select(c("p_partkey").cast("string").alias("doc_id"), body.cast("binary").alias("content"))
    return adapters.parse_files(files, _pages, first=2).select("doc_id", "page_number", "text", "error")


@query("SELECT concat('a', CAST(s_suppkey AS VARCHAR)) AS article FROM supplier")
def article_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = f"{scratch(spark)}/ids.txt"
    lines = view(spark, sf_dir, "SELECT explode(array(concat('  a', CAST(s_suppkey AS STRING), ' '), '', '   ')) AS value FROM {supplier}")
    lines.write.text(out)
    return tables.read_list(spark, out)


@query("SELECT c_custkey AS job_id, CASE c_custkey % 4 WHEN 0 THEN 'interrupted' WHEN 1 THEN 'interrupted' WHEN 2 THEN 'failed' ELSE 'completed' END AS status, c_custkey % 3 = 0 AS api_key_configured FROM customer")
def job_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jobs written as files, read at a start: what ran is interrupted, keys aren't shown."""
    out = f"{scratch(spark)}/jobs"
    state = F.element_at(F.array(*map(F.lit, ("running", "queued", "failed", "completed"))), (c("k") % 4 + 1).cast("int"))
    export_jsonl(view(spark, sf_dir, "SELECT c_custkey AS k FROM {customer}").select(c("k").alias("job_id"), state.alias("status"), F.when(c("k") % 3 == 0, "secret").alias("api_key")), out)
    found = spark.read.schema("job_id bigint, status string, api_key string").json(out)
    return jobs.public_view(jobs.interrupted(found)).select("job_id", "status", "api_key_configured")


@query("SELECT CAST(n_nationkey AS VARCHAR) AS name, sha256(concat('content of ', n_name)) AS sha256, left(concat('content of ', n_name), 12) AS head FROM nation")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a folder each: their hash, and the beginning of their text."""
    out = f"{scratch(spark)}/texts"
    view(spark, sf_dir, "SELECT concat('content of ', n_name) AS value, CAST(n_nationkey AS STRING) AS k FROM {nation}").write.partitionBy("k").option("lineSep", "\x01").text(out)
    name = F.regexp_extract("path", r"/k=(\d+)/", 1)
    files = tables.read_files(spark, f"{out}/k=*")
    texts = tables.read_text(spark, f"{out}/k=*", limit=12).select(name.alias("name"), c("text").alias("head"))
    body = F.regexp_replace(F.decode("content", "utf-8"), "\x01", "")
    return files.select(name.alias("name"), F.when(F.sha2("content", 256) == c("sha256"), F.sha2(body, 256)).alias("sha256")).join(texts, "name")


@query("SELECT row_number() OVER (ORDER BY c_custkey) AS nth, CAST(c_custkey AS VARCHAR) AS k, concat(c_name, chr(10), '\"', c_mktsegment, '\"') AS note FROM customer")
def quoted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of files whose values go over lines, in the order of the files."""
    out = f"{scratch(spark)}/notes.csv"
    rows = view(spark, sf_dir, "SELECT c_custkey, concat(c_name, chr(10), '\"', c_mktsegment, '\"') AS note FROM {customer}")
    rows.orderBy("c_custkey").write.csv(out, header=True, escape='"', quoteAll=True)
    return tables.read_rows(spark, out, "d").select("nth", c("row")["c_custkey"].alias("k"), c("row")["note"].alias("note"))

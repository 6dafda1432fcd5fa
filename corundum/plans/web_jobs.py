"""Queries over jobs as a web client sees them: what a job may go through, in which order jobs are
listed, and what is stored of one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corundum.functions.values import as_float
from corundum.operators import jobs
from corundum.plans.base import query, view
from corundum.sources import tables

c = F.col

# Orders are jobs; the customer's number picks the name of the record type, in some case.
_NAMES = ("EyeDrops", "benzimidazoles", "Oxazolidinones", "CO-CRYSTALS", "Complexes", "nanozymes", "Synergy", "Nanomag", "cytotox", "SELTOX", "unknown", "")
_NAME = "CASE o_custkey % 12 " + " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate(_NAMES)) + " END"
_TITLE = "CASE lower(name) " + " ".join(f"WHEN '{t.lower()}' THEN '{t}'" for t in ("EyeDrops", "Benzimidazoles", "Oxazolidinones", "Co-crystals", "Complexes", "Nanozymes", "Synergy", "Nanomag", "Cytotox", "SelTox")) + " ELSE 'Benzimidazoles' END"
WEB = f"SELECT CAST(o_orderkey AS VARCHAR(20)) AS job_id, {_NAME} AS name, CASE o_orderstatus WHEN 'F' THEN 'PDF' WHEN 'O' THEN 'zip' ELSE 'csv' END AS source_type, CASE WHEN o_custkey % 5 <> 0 THEN concat('/up/', CAST(o_custkey AS VARCHAR(20))) ELSE '' END AS saved_path, o_orderdate AS created_at, concat(o_orderpriority, chr(34), CAST(o_custkey AS VARCHAR(20)), chr(34)) AS source_text FROM {{orders}}"


@query(f"SELECT job_id, {_TITLE} AS title, name IN ('EyeDrops', 'Oxazolidinones', 'Complexes', 'Synergy', 'Nanomag') AND source_type IN ('PDF', 'zip') AND saved_path <> '' AS whole FROM ({WEB}) w")
def pipeline_eligibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, WEB)
    return found.select("job_id", jobs.domain_title(c("name")).alias("title"), jobs.takes_whole_pipeline(c("source_type"), c("name"), c("saved_path")).alias("whole"))


@query(f"SELECT job_id, CAST(row_number() OVER (ORDER BY created_at DESC, job_id) AS INTEGER) AS place FROM ({WEB}) w QUALIFY place <= 80")
def jobs_newest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the limit: the list that a client is shown."""
    shown = jobs.newest_first(view(spark, sf_dir, WEB), 80)
    return shown.select("job_id", F.row_number().over(Window.orderBy(F.desc("created_at"), "job_id")).alias("place"))


@query(f"SELECT job_id, concat('{{\"job_id\":\"', job_id, '\",\"name\":\"', name, '\",\"source_text\":', to_json(substr(source_text, 1, 250000)), ',\"api_key_configured\":', CASE WHEN name <> '' THEN 'true' ELSE 'false' END, '}}') AS snapshot FROM ({WEB}) w")
def job_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, WEB).select("job_id", "name", "source_text", F.when(c("name") != "", F.concat(F.lit("key of "), c("name"))).alias("api_key"))
    return jobs.snapshots(found)


@query("SELECT CAST(c_custkey AS VARCHAR) AS object_id, CAST(c_acctbal AS VARCHAR) AS primary_value, '' AS property, c_name AS evidence, '' AS confidence FROM customer")
def record_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT c_name AS evidence, c_nationkey AS other, CAST(c_acctbal AS STRING) AS primary_value, c_custkey AS object_id FROM {customer}")
    return jobs.record_table(rows)


# Members of archives under names that files can have; numbers in texts as readers find them.
@query("SELECT p_partkey, concat(CASE WHEN p_size < 10 THEN '0' ELSE '' END, CAST(p_size AS VARCHAR), '-', regexp_replace(concat(p_name, ' (', p_type, ').pdf'), '[^A-Za-z0-9._-]', '_', 'g')) AS target, CASE WHEN p_size % 2 = 0 THEN CAST(p_retailprice AS DOUBLE) END AS price FROM part")
def stored_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = view(spark, sf_dir, "SELECT p_partkey, CAST(p_size AS INT) AS nth, concat('folder/', p_name, ' (', p_type, ').pdf') AS member, CASE WHEN p_size % 2 = 0 THEN concat(' ', CAST(p_retailprice AS STRING)) ELSE p_type END AS told FROM {part}")
    return tables.member_names(parts).select("p_partkey", "target", as_float(c("told")).alias("price"))

"""Queries over structures that are put together from the tables' numbers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corundum.functions.smiles import structure
from corundum.operators import evidence
from corundum.plans.base import query, view

c = F.col

# An atom with k neighbours and a chain behind a single, double or triple bond: it is right if the
# atom has so many bonds. A ring is right if it is closed.
ATOMS = "SELECT * FROM (VALUES (0, 'C', 4), (1, 'N', 3), (2, 'O', 2), (3, 'S', 6), (4, 'P', 7), (5, 'B', 3), (6, 'Cl', 1), (7, '[N+]', 4), (8, '[O-]', 1), (9, '[C-]', 3), (10, '[Si]', 4)) a(atom, name, most)"
BUILT = f"""SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20))) AS id, k, o, most, whole,
 concat('N', CASE WHEN k > 0 THEN '(C)' ELSE '' END, CASE WHEN ring THEN 'C1CC' ELSE 'C' END, CASE WHEN ring AND whole THEN 'C1' ELSE '' END, '.', name, repeat('(F)', CAST(k AS INT)), substr('-=#', CAST(o AS INT), 1), repeat('C', CAST(l_linenumber AS INT))) AS text, ring
FROM (SELECT *, l_suppkey % 8 AS k, 1 + l_orderkey % 3 AS o, l_partkey % 11 AS number, l_partkey % 3 = 0 AS ring, l_orderkey % 5 <> 0 AS whole FROM {{lineitem}}) q JOIN ({ATOMS}) a ON a.atom = q.number"""


@query(f"SELECT id, CASE WHEN k + o <= most AND (whole OR NOT ring) THEN 'valid' ELSE 'invalid' END AS status FROM ({BUILT}) b")
def structure_validity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, BUILT).select("id", structure(c("text"))["status"].alias("status"))


# A chain with a branch somewhere, begun at either end, and a ring that is begun at any atom and
# spelled with double bonds at either places: what a spelling stands for is a, b, x and y.
SPELLED = """SELECT least(a, b) AS a, greatest(a, b) AS b, x, y,
 concat(repeat('C', CAST(a AS INT)), 'C(', substr('OSNF', CAST(1 + x AS INT), 1), ')', repeat('C', CAST(b AS INT)), '.', CASE l_linenumber % 5 WHEN 0 THEN concat('c1ccccc1', y) WHEN 1 THEN concat('C1=CC=CC=C1', y) WHEN 2 THEN concat(y, 'C1=CC=CC=C1') WHEN 3 THEN concat('c1cc(', y, ')ccc1') ELSE concat('C1(', y, ')C=CC=CC=1') END) AS text
FROM (SELECT l_linenumber, 1 + l_partkey % 9 AS a, 1 + l_suppkey % 7 AS b, l_orderkey % 4 AS x, CASE (l_orderkey + l_partkey) % 3 WHEN 0 THEN 'F' WHEN 1 THEN 'N' ELSE 'CC' END AS y FROM {lineitem}) q"""


@query(f"SELECT a, b, x, y, count(*) AS rows, 1 AS forms, 1 AS structures FROM (SELECT a, b, x, CASE WHEN y = 'CC' THEN 'C' ELSE y END AS y FROM ({SPELLED}) s) q GROUP BY 1, 2, 3, 4", forms="BIGINT", structures="BIGINT")
def canonical_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """forms: canonical texts of a structure's spellings; structures: what the text of one stands for."""
    key = ["a", "b", "x", "y"]
    spelled = view(spark, sf_dir, SPELLED).withColumn("y", F.when(c("y") == "CC", "C").otherwise(c("y")))
    found = spelled.select(*key, structure(c("text"))["canonical"].alias("form")).groupBy(*key, "form").agg(F.count("*").alias("n"))
    shared = found.groupBy("form").agg(F.count("*").alias("of_form"))
    return found.join(shared, "form").groupBy(*key).agg(F.sum("n").alias("rows"), F.count("*").alias("forms"), F.max("of_form").alias("structures"))


# Two pieces of evidence a part name a chain, one from either end; they name one structure if the
# chains are as long.
TWICE = """SELECT CAST(p_partkey AS VARCHAR(20)) AS doc_id, concat('e', CAST(k AS VARCHAR(20))) AS evidence_id, concat(CAST(p_size AS VARCHAR(20)), 'a') AS caption,
 concat('Chemical structure | smiles=', CASE WHEN k = 1 THEN concat(repeat('C', CAST(1 + p_partkey % 4 AS INT)), 'O') ELSE concat('O', repeat('C', CAST(1 + p_size % 4 AS INT))) END, ' | source') AS text FROM {part} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) n"""
PAIRS = "SELECT CAST(p_partkey AS VARCHAR(20)) AS doc_id, concat('r', CAST(p_partkey AS VARCHAR(20))) AS record_id, concat(CAST(p_size AS VARCHAR(20)), 'a') AS compound_id, CAST(p_size AS VARCHAR(20)) AS target_value FROM {part}"


@query("""SELECT CAST(p_partkey AS VARCHAR(20)) AS doc_id, CASE WHEN p_partkey % 4 = p_size % 4 THEN 'accepted' ELSE 'needs_review' END AS decision,
 CASE WHEN p_partkey % 4 = p_size % 4 THEN '' ELSE 'conflicting_smiles' END AS issues FROM part""")
def spelled_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, TWICE).withColumns({"source_type": F.lit("chemical_structure_smiles"), "metadata": F.lit(None).cast("string"), "confidence": F.lit(0.9)})
    measured = view(spark, sf_dir, PAIRS).withColumns({"file_id": F.lit("main"), "page_number": F.lit(1), "bacteria": F.lit("E. coli"), "target_type": F.lit("MIC"), "target_units": F.lit("mM")})
    decided = evidence.conflict_decisions(evidence.compound_links(measured, evidence.structures(found)))
    return decided.select("doc_id", "decision", F.array_join(c("canonical.issues"), ",").alias("issues"))

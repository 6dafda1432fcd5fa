"""Queries over the driver's tables, each with the SQL that says the same.

The tables hold no chemistry, so views give their rows the form of table cells, pages, captions or
jobs; a view is one SQL text for both engines. {name} stands for a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corundum.functions import chemistry, text, values
from corundum.operators import context, evaluate, evidence, heuristics, jobs, layout, normalize, rank, route
from corundum.plans.base import ORACLES, QUERIES, query, rounded, view
from corundum.schemas import DOMAINS
from corundum.sources import web

c = F.col


# Evaluation: suppliers are articles; a third of the predictions is off.
TRUTH = """SELECT concat('S', CAST(l_suppkey AS VARCHAR(20)), '.pdf') AS pdf, CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) AS target_value,
 CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS target_type, l_linestatus AS bacteria FROM {lineitem}"""
PREDICTION = """SELECT concat('S', CAST(l_suppkey AS VARCHAR(20))) AS pdf, CAST(CAST(CASE WHEN l_linenumber % 3 = 0 THEN l_quantity + 1 ELSE l_quantity END AS INT) AS VARCHAR(20)) AS target_value,
 CASE WHEN l_returnflag = 'R' THEN NULL ELSE l_returnflag END AS target_type, CASE WHEN l_linenumber = 5 THEN 'X' ELSE l_linestatus END AS bacteria FROM {lineitem} WHERE l_linenumber <> 7"""
FIELDS = ["target_type", "target_value", "bacteria"]
_CELLS = " UNION ALL ".join(f"SELECT lower(pdf) AS article, '{f}' AS col, coalesce({f}, 'NOT_DETECTED') AS v, {t} AS t, {p} AS p FROM {side}" for side, t, p in (("truth", 1, 0), ("pred", 0, 1)) for f in FIELDS)
_EVAL = f"""WITH truth AS (SELECT replace(pdf, '.pdf', '') AS pdf, target_value, target_type, bacteria FROM ({TRUTH}) q), pred AS ({PREDICTION}), cells AS ({_CELLS}),
counts AS (SELECT article, col, v, sum(t) AS t, sum(p) AS p FROM cells GROUP BY 1, 2, 3),
sums AS (SELECT article, col, sum(least(t, p)) AS tp, sum(greatest(p - t, 0)) AS fp, sum(greatest(t - p, 0)) AS fn FROM counts GROUP BY 1, 2),
pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall FROM sums),
per AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END AS f1 FROM pr),
article_list AS (SELECT DISTINCT lower(pdf) AS article FROM truth)"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    d = DOMAINS["benzimidazole"]
    truth = view(spark, sf_dir, TRUTH).withColumn("pdf", values.article_of_file(c("pdf")))
    return evaluate.prepare_truth(d, truth), evaluate.prepare_prediction(d, view(spark, sf_dir, PREDICTION))


MEANS = ("tp", "fp", "fn", "precision", "recall", "f1")


@query(_EVAL + " SELECT col AS field, " + ", ".join(f"round(sum({m}) / (SELECT count(*) FROM article_list), 6) AS {m}" for m in MEANS) + " FROM per WHERE article IN (SELECT article FROM article_list) GROUP BY 1")
def eval_per_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.evaluate(*_sides(spark, sf_dir), FIELDS), *MEANS).withColumnRenamed("column", "field")


@query(_EVAL + " SELECT round(avg(f), 6) AS macro_f1 FROM (SELECT col, sum(f1) / (SELECT count(*) FROM article_list) AS f FROM per GROUP BY 1) q")
def eval_macro_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.macro_f1(evaluate.evaluate(*_sides(spark, sf_dir), FIELDS)), "macro_f1")


_SUBSET = "SELECT concat('S', CAST(s_suppkey AS VARCHAR(20))) AS article FROM {supplier} WHERE s_nationkey < 8 UNION ALL SELECT 'elsewhere' AS article"


@query(_EVAL + f", chosen AS (SELECT lower(article) AS article FROM ({_SUBSET}) q) SELECT col AS field, " + ", ".join(f"round(sum({m}) / (SELECT count(*) FROM chosen), 6) AS {m}" for m in MEANS) + " FROM per JOIN chosen USING (article) GROUP BY 1")
def eval_article_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(evaluate.evaluate(*_sides(spark, sf_dir), FIELDS, articles=view(spark, sf_dir, _SUBSET)), *MEANS).withColumnRenamed("column", "field")


@query(_EVAL + " SELECT article, col AS field, tp, fp, fn, round(f1, 6) AS f1 FROM per")
def eval_per_article(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evaluate.article_metrics(*_sides(spark, sf_dir), FIELDS)
    return found.select("article", c("column").alias("field"), "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


# Evidence: a supplier is a document with one table, its line items are the rows.
ROWS = """SELECT CAST(l_suppkey AS VARCHAR(20)) AS doc_id, concat('t', CAST(l_suppkey AS VARCHAR(20))) AS table_id, concat('e', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20))) AS evidence_id,
 CAST(l_linenumber AS INT) AS row_index, concat(CAST(l_partkey AS VARCHAR(20)), 'a') AS compound_cell,
 CASE WHEN l_returnflag = 'N' THEN concat(CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), ' ug/mL') WHEN l_returnflag = 'A' THEN concat('MIC <', CAST(CAST(l_quantity AS INT) AS VARCHAR(20)), ',5 mg/L') ELSE 'n.d.' END AS cell FROM {lineitem}"""
TABLES = """SELECT CAST(s_suppkey AS VARCHAR(20)) AS doc_id, 'main' AS file_id, CAST(1 + s_nationkey AS INT) AS page_number, concat('t', CAST(s_suppkey AS VARCHAR(20))) AS table_id,
 CASE s_suppkey % 3 WHEN 0 THEN 'MIC values against E. coli' WHEN 1 THEN 'Inhibition zone diameters (mm)' ELSE 'Summary' END AS caption FROM {supplier}"""


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    tables = view(spark, sf_dir, TABLES).withColumn("columns", F.array(F.lit("Compound"), F.lit("Value")))
    rows = view(spark, sf_dir, ROWS).withColumns({"row_id": c("evidence_id"), "cells": F.array("compound_cell", "cell"), "normalized_text": F.lit(None).cast("string")})
    return tables, rows


# In a table called Summary only a cell that names its target says what is measured, and a plan
# doesn't read targets from cells: such tables give no record.
_MEASURED = f"""WITH t AS ({TABLES}), r AS ({ROWS}),
m0 AS (SELECT r.doc_id, r.table_id, r.evidence_id, t.page_number, r.compound_cell AS compound_id, CASE WHEN t.caption LIKE 'MIC%' THEN 'MIC' ELSE 'INHIBITION_ZONE' END AS target_type,
 CASE WHEN r.cell LIKE 'MIC%' THEN '<' ELSE '=' END AS target_relation, CASE WHEN r.cell LIKE 'MIC%' THEN replace(replace(replace(r.cell, 'MIC <', ''), ' mg/L', ''), ',', '.') ELSE replace(r.cell, ' ug/mL', '') END AS target_value,
 CASE WHEN r.cell LIKE 'MIC%' THEN 'mg/L' ELSE 'µg/mL' END AS target_units, CASE WHEN t.caption LIKE '%coli%' THEN 'Escherichia coli' ELSE 'NOT_DETECTED' END AS bacteria, concat('Value: ', r.cell) AS raw_text
 FROM r JOIN t ON t.doc_id = r.doc_id AND t.table_id = r.table_id WHERE r.cell <> 'n.d.' AND t.caption <> 'Summary'),
m AS (SELECT *, concat('tm:', substr(sha1(concat(evidence_id, '|1|', compound_id, '|', target_type, '|', target_value, '|', target_units, '|', CASE WHEN bacteria = 'NOT_DETECTED' THEN '' ELSE bacteria END)), 1, 16)) AS record_id FROM m0)"""
_RECORD = "record_id, doc_id, table_id, evidence_id, page_number, compound_id, target_type, target_relation, target_value, target_units, bacteria, raw_text"


@query(_MEASURED + f" SELECT {_RECORD}, CASE WHEN bacteria = 'NOT_DETECTED' THEN 0.95 ELSE 0.95 END AS confidence FROM m")
def table_measurements(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evidence.measurements(*_tables(spark, sf_dir)).select(*_RECORD.split(", "), F.round("confidence", 6).alias("confidence"))


@query(f"""WITH t AS ({TABLES}), r AS ({ROWS}), told AS (SELECT DISTINCT table_id FROM r WHERE cell <> 'n.d.')
SELECT t.doc_id, t.table_id, 0 AS compound_index, CASE WHEN caption LIKE 'MIC%' THEN 'MIC' WHEN caption LIKE 'Inhib%' THEN 'INHIBITION_ZONE' END AS target_type, CASE WHEN caption LIKE 'Inhib%' THEN 'mm' END AS target_units,
 CASE WHEN caption = 'Summary' OR told.table_id IS NULL THEN 0 ELSE 1 END AS n_columns, CASE WHEN caption = 'Summary' THEN 0.55 WHEN told.table_id IS NULL THEN 0.73 ELSE 0.8975 END AS confidence
FROM t LEFT JOIN told ON told.table_id = t.table_id""")
def table_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    plans = evidence.plan_tables(*_tables(spark, sf_dir))
    return plans.select("doc_id", "table_id", "compound_index", "target_type", "target_units", F.coalesce(F.size("measurement_columns"), F.lit(0)).alias("n_columns"), F.round("confidence", 6).alias("confidence"))


# Every fourth part has a structure, every eighth two.
STRUCTURES = """SELECT DISTINCT CAST(l_suppkey AS VARCHAR(20)) AS doc_id, concat('s', CAST(l_partkey AS VARCHAR(20)), '-', CAST(k AS VARCHAR(20))) AS evidence_id, concat(CAST(l_partkey AS VARCHAR(20)), 'a') AS caption,
 concat('Chemical structure | smiles=C', CASE WHEN k = 1 THEN 'C' ELSE 'N' END, CAST(l_partkey % 7 AS VARCHAR(20)), ' | source') AS text FROM {lineitem} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 AS k) n WHERE l_partkey % 4 = 0 AND (k = 1 OR l_partkey % 8 = 0)"""
_LINKED = _MEASURED + f""", s AS (SELECT doc_id, evidence_id AS smiles_evidence_id, caption AS compound_id, substr(replace(text, 'Chemical structure | smiles=', ''), 1, 3) AS smiles FROM ({STRUCTURES}) q),
l AS (SELECT concat('cl:', substr(sha1(concat(m.record_id, '|', coalesce(s.smiles_evidence_id, 'missing'))), 1, 16)) AS link_id, m.*, s.smiles_evidence_id, coalesce(s.smiles, 'NOT_DETECTED') AS smiles,
 round(0.54 + CASE WHEN s.smiles IS NULL THEN 0 ELSE 0.25 + 0.9 * 0.08 END + CASE WHEN m.bacteria = 'NOT_DETECTED' THEN 0 ELSE 0.05 END + 0.04, 6) AS confidence, CASE WHEN s.smiles IS NULL THEN 'needs_review' ELSE 'accepted' END AS status
 FROM m LEFT JOIN s ON s.doc_id = m.doc_id AND s.compound_id = m.compound_id)"""


def _links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, STRUCTURES).withColumns({"source_type": F.lit("chemical_structure_smiles"), "metadata": F.lit(None).cast("string"), "confidence": F.lit(0.9)})
    return evidence.compound_links(evidence.measurements(*_tables(spark, sf_dir)), evidence.structures(found))


@query(_LINKED + " SELECT link_id, doc_id, compound_id, record_id AS measurement_record_id, smiles_evidence_id, smiles, confidence, status FROM l")
def compound_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("link_id", "doc_id", "compound_id", "measurement_record_id", "smiles_evidence_id", "smiles", F.round("confidence", 6).alias("confidence"), "status")


@query(_LINKED + " SELECT doc_id, count(*) AS links, sum(CASE WHEN status = 'accepted' THEN 0 ELSE 1 END) AS missing FROM l GROUP BY 1")
def missing_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy("doc_id").agg(F.count("*").alias("links"), F.sum(F.size("issues")).alias("missing"))


@query(_LINKED + """ SELECT concat('cr:', substr(sha1(concat(compound_id, '|', target_type, '|', target_value, '|', target_units, '|', bacteria)), 1, 16)) AS decision_id, doc_id, compound_id, target_type, target_value, target_units, bacteria,
 CASE WHEN max(CASE WHEN status = 'accepted' THEN 0 ELSE 1 END) = 1 OR count(DISTINCT CASE WHEN smiles <> 'NOT_DETECTED' THEN smiles END) > 1 THEN 'needs_review' ELSE 'accepted' END AS decision,
 least(max(confidence), CASE WHEN max(CASE WHEN status = 'accepted' THEN 0 ELSE 1 END) = 1 THEN 0.62 ELSE 1 END, CASE WHEN count(DISTINCT CASE WHEN smiles <> 'NOT_DETECTED' THEN smiles END) > 1 THEN 0.55 ELSE 1 END) AS confidence
FROM l GROUP BY doc_id, compound_id, target_type, target_value, target_units, bacteria""")
def conflict_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = evidence.conflict_decisions(_links(spark, sf_dir))
    k = c("canonical")
    return found.select("decision_id", "doc_id", "compound_id", *(k[n].alias(n) for n in ("target_type", "target_value", "target_units", "bacteria")), "decision", F.round("confidence", 6).alias("confidence"))


SCAFFOLDS = """SELECT concat('p', CAST(p_partkey AS VARCHAR(20))) AS evidence_id, CAST(p_partkey % 50 AS VARCHAR(20)) AS doc_id, p_name AS caption, p_brand AS title,
 CASE p_size % 3 WHEN 0 THEN concat('Scaffold with R', CAST(p_size % 4 AS VARCHAR(20)), ' and R', CAST(p_size % 5 AS VARCHAR(20)), ' for 6a-6', substr('bcdef', CAST(1 + p_size % 5 AS INT), 1)) WHEN 1 THEN 'the substituent is fixed' ELSE 'nothing of it' END AS text FROM {part}"""


@query(f"""WITH s AS ({SCAFFOLDS}) SELECT evidence_id, doc_id, CASE WHEN text LIKE 'Scaffold%' THEN 'needs_review' ELSE 'detected' END AS status,
 CASE WHEN text LIKE 'Scaffold%' THEN regexp_extract(text, '6a-6[b-f]', 0) ELSE 'NOT_DETECTED' END AS compound_range,
 CASE WHEN text LIKE 'Scaffold%' THEN CASE WHEN substr(text, 15, 2) = substr(text, 22, 2) THEN substr(text, 15, 2) ELSE concat(least(substr(text, 15, 2), substr(text, 22, 2)), ',', greatest(substr(text, 15, 2), substr(text, 22, 2))) END ELSE '' END AS sites
FROM s WHERE text <> 'nothing of it'""")
def scaffold_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, SCAFFOLDS).withColumns({"file_id": F.lit("main"), "page_number": F.lit(1), "source_type": F.lit("paragraph")})
    return evidence.scaffolds(rows).select(c("source_evidence_id").alias("evidence_id"), "doc_id", "status", "compound_range", F.array_join("variable_sites", ",").alias("sites"))


@query("""WITH r AS (SELECT l_orderkey, concat('| ', l_returnflag, ' | ', CAST(CAST(l_quantity AS INT) AS VARCHAR), ' |') AS line, l_linenumber, CAST(l_partkey AS VARCHAR) AS row_id, l_quantity, l_returnflag FROM lineitem)
SELECT CAST(o_orderkey AS VARCHAR) AS doc_id, concat('Table ', o_orderpriority, '. ', o_orderstatus, chr(10), chr(10), '| flag | quantity |', chr(10), '| --- | --- |', chr(10), string_agg(line, chr(10) ORDER BY l_linenumber, row_id, line)) AS markdown
FROM orders JOIN r ON l_orderkey = o_orderkey GROUP BY o_orderkey, o_orderpriority, o_orderstatus""")
def page_context_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, "SELECT CAST(o_orderkey AS STRING) AS doc_id, CAST(o_orderkey AS STRING) AS table_id, 1 AS page_number, concat('Table ', o_orderpriority) AS label, o_orderstatus AS caption, array('flag', 'quantity') AS columns FROM {orders} WHERE o_orderkey IN (SELECT l_orderkey FROM {lineitem})")
    r = view(spark, sf_dir, "SELECT CAST(l_orderkey AS STRING) AS doc_id, CAST(l_orderkey AS STRING) AS table_id, CAST(l_linenumber AS INT) AS row_index, CAST(l_partkey AS STRING) AS row_id, array(l_returnflag, CAST(CAST(l_quantity AS INT) AS STRING)) AS cells FROM {lineitem}")
    return context.table_markdown(t, r).select("doc_id", "markdown")


@query("SELECT conv_id, CAST(floor((n - 1) / 4) AS BIGINT) AS \"window\", min(turn) AS first_turn, max(turn) AS last_turn, count(*) AS pages FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) q GROUP BY 1, 2")
def page_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = view(spark, sf_dir, "SELECT conv_id, turn FROM {conversations}")
    return context.page_windows(turns, 4, by="conv_id", order="turn").withColumnsRenamed({"first": "first_turn", "last": "last_turn"})


@query("SELECT conv_id, turn, last_value(CASE WHEN role = 'system' THEN text END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM conversations")
def section_carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = view(spark, sf_dir, "SELECT conv_id, turn, role, text FROM {conversations}")
    return context.carry_forward(turns, F.when(c("role") == "system", c("text")), "section", ["conv_id"], ["turn"]).select("conv_id", "turn", "section")


BEST = """SELECT CAST(l_orderkey AS VARCHAR(20)) AS doc_id, CAST(l_linenumber AS INT) AS page_number, CASE WHEN l_returnflag = 'N' THEN 'Table 1' ELSE NULL END AS label, concat('t', CAST(l_partkey AS VARCHAR(20))) AS table_id, CASE WHEN l_linestatus = 'O' THEN 'pymupdf_layout' ELSE 'other' END AS parser,
 CAST(l_quantity AS INT) AS n_rows, CAST(l_tax * 100 AS INT) AS n_columns, CAST(l_discount * 100 AS INT) AS n_filled, concat(CAST(l_suppkey AS VARCHAR(20)), '-', CAST(l_extendedprice AS VARCHAR(30))) AS seq FROM {lineitem}"""


@query(f"""WITH t AS (SELECT *, n_rows * greatest(n_columns, 1) + n_filled / 100.0 + CASE WHEN parser = 'pymupdf_layout' THEN 0.2 ELSE 0.0 END AS s FROM ({BEST}) q)
SELECT doc_id, page_number, table_id, CAST(round(s, 4) AS DOUBLE) AS score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, lower(coalesce(label, table_id)) ORDER BY s DESC, seq) AS n FROM t) q WHERE n = 1""")
def dedupe_best_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.best_tables(view(spark, sf_dir, BEST)).select("doc_id", "page_number", "table_id", F.round("score", 4).alias("score"))


ANCHORS = "SELECT concat('a', CAST(event_id AS VARCHAR(20))) AS anchor_id, CAST(user_id AS VARCHAR(20)) AS doc_id, CAST(extract(day FROM ts) AS INT) AS page_number FROM {events} WHERE event_type = 'signup'"
NEARBY = "SELECT concat('e', CAST(event_id AS VARCHAR(20))) AS evidence_id, CAST(user_id AS VARCHAR(20)) AS doc_id, CAST(extract(day FROM ts) AS INT) AS page_number FROM {events} WHERE event_type = 'purchase'"


@query(f"""SELECT anchor_id, evidence_id, distance, n AS nth FROM (SELECT a.anchor_id, e.evidence_id, abs(e.page_number - a.page_number) AS distance, row_number() OVER (PARTITION BY a.doc_id, a.anchor_id ORDER BY abs(e.page_number - a.page_number), e.evidence_id) AS n
FROM ({ANCHORS}) a JOIN ({NEARBY}) e ON e.doc_id = a.doc_id AND e.page_number BETWEEN greatest(a.page_number - 1, 1) AND a.page_number + 1) q WHERE n <= 5""")
def nearby_band_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = context.near_pages(view(spark, sf_dir, ANCHORS), view(spark, sf_dir, NEARBY), reach=1, top=5)
    return near.select("anchor_id", "evidence_id", F.abs(c("page_number") - c("anchor_page")).alias("distance"), "nth")


@query("SELECT i.user_id, i.event_id, min(abs(date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', i.ts)) - date_diff('second', TIMESTAMP '2024-01-01', date_trunc('second', a.ts)))) AS distance FROM events i LEFT JOIN events a ON a.user_id = i.user_id AND a.event_type = 'error' WHERE i.event_type = 'purchase' GROUP BY 1, 2")
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = "unix_timestamp(ts) - unix_timestamp(TIMESTAMP '2024-01-01 00:00:00') AS at"
    items = view(spark, sf_dir, f"SELECT user_id, event_id, {at} FROM {{events}} WHERE event_type = 'purchase'")
    anchors = view(spark, sf_dir, f"SELECT user_id, {at} FROM {{events}} WHERE event_type = 'error'")
    return context.nearest_distance(items, anchors, by="user_id", at="at").select("user_id", "event_id", "distance")


# Ranking: a source's documents are a document's evidence, the language stands for its kind.
SKILL = rank.Skill("demo", ("idiot", "api_key"), ("the", "password", "tion"))
RANKED = "SELECT source AS doc_id, concat('d', CAST(doc_id AS VARCHAR(20))) AS evidence_id, CAST(doc_id AS INT) AS page_number, CASE lang WHEN 'en' THEN 'paragraph' WHEN 'fr' THEN 'table_row' WHEN 'de' THEN 'table_caption' ELSE 'chemical_structure_smiles' END AS source_type, text, 0.5 + (doc_id % 10) / 10.0 AS confidence FROM {documents}"


def _hits(terms: tuple[str, ...]) -> str:
    one = lambda t: f"regexp_matches(lower(text), '(?:^|[^\\pL\\pN_]){t}(?:$|[^\\pL\\pN_])')" if t.isalnum() else f"contains(lower(text), '{t}')"
    return "list_filter([" + ", ".join(f"CASE WHEN {one(t.lower())} THEN '{t}' END" for t in terms) + "], lambda x: x IS NOT NULL)"


_SCORED = f"""WITH e AS (SELECT *, {_hits(SKILL.terms)} AS m FROM ({RANKED}) q), s AS (SELECT *, len(m) + CASE source_type WHEN 'table_row' THEN 1.25 WHEN 'table_caption' THEN 0.75 WHEN 'chemical_structure_smiles' THEN 1.0 ELSE 0 END
 + CASE WHEN regexp_matches(text, '(?:^|[^A-Za-z])[0-9]') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\\b(?:SMILES|MIC|pMIC|IC50|EC50|AgNP|Fe3O4|TiO2|SiO2|ZnO|AuNP|DOTA|logK|lgK|Km|Vmax)\\b') THEN 0.7 ELSE 0 END + least(0.5, greatest(0.0, confidence - 0.5)) AS score FROM e WHERE len(m) > 0),
r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 6) DESC, page_number, evidence_id) AS rank FROM s), top AS (SELECT * FROM r WHERE rank <= 20)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, RANKED).withColumn("confidence", c("confidence").cast("double"))
    return rank.candidates(rows, SKILL, top=20)


@query(_SCORED + " SELECT doc_id, rank, CAST(round(score, 3) AS DOUBLE) AS score, evidence_id, array_to_string(m, ',') AS matched FROM top")
def evidence_rank_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir).select("doc_id", "rank", "score", "evidence_id", F.array_join("matched_terms", ",").alias("matched"))


@query(_SCORED + """, k AS (SELECT *, CASE source_type WHEN 'table_row' THEN 'row' WHEN 'chemical_structure_smiles' THEN 'structure' ELSE 'text' END AS kind FROM top),
f AS (SELECT *, row_number() OVER (PARTITION BY doc_id, kind ORDER BY rank) AS n FROM k), p AS (SELECT *, (kind = 'text' AND n <= 2) OR (kind = 'row' AND n <= 2) AS first FROM f),
a AS (SELECT p.doc_id, p.evidence_id, min(abs(p.page_number - q.page_number)) AS far FROM p LEFT JOIN p q ON q.doc_id = p.doc_id AND q.first GROUP BY 1, 2),
g AS (SELECT p.*, row_number() OVER (PARTITION BY p.doc_id, kind ORDER BY coalesce(a.far, 0), rank) AS s FROM p JOIN a ON a.doc_id = p.doc_id AND a.evidence_id = p.evidence_id),
h AS (SELECT *, first OR (kind = 'structure' AND s <= 2) AS chosen FROM g), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN chosen THEN 0 ELSE 1 END, rank) AS turn FROM h)
SELECT doc_id, evidence_id, rank FROM t WHERE turn <= 6""")
def quota_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.select_balanced(_ranked(spark, sf_dir), 6).select("doc_id", "evidence_id", "rank")


@query(f"WITH e AS (SELECT doc_id, unnest([{{'field': 'idiot', 'hit': len({_hits(rank.field_terms('idiot'))}) > 0}}, {{'field': 'api_key', 'hit': len({_hits(rank.field_terms('api_key'))}) > 0}}]) AS h FROM ({RANKED}) q), g AS (SELECT doc_id, h.field AS field, sum(CASE WHEN h.hit THEN 1 ELSE 0 END) AS hits FROM e GROUP BY 1, 2) SELECT doc_id, field, hits, CASE WHEN hits >= 3 THEN 'present' WHEN hits > 0 THEN 'partial' ELSE 'missing' END AS status FROM g")
def field_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.field_coverage(view(spark, sf_dir, RANKED), SKILL)


PAGES = "SELECT CAST(doc_id AS VARCHAR(20)) AS doc_id, 'main' AS file_id, CAST(1 + doc_id % 40 AS INT) AS page_number, concat('p', CAST(doc_id AS VARCHAR(20))) AS page_id, text FROM {documents}"
FIGURES = """SELECT concat('f', CAST(p_partkey AS VARCHAR(20))) AS figure_id, CAST(p_partkey % 20 AS VARCHAR(20)) AS doc_id, 'main' AS file_id, CAST(p_size AS INT) AS page_number, CASE WHEN p_size % 7 = 0 THEN 'scheme' ELSE 'figure' END AS kind,
 concat(p_name, CASE p_size % 4 WHEN 0 THEN ' synthesis' WHEN 1 THEN ' Docking pose' WHEN 2 THEN ' hybrids, inhibition' ELSE '' END) AS caption FROM {part}"""
FACTS = "SELECT CAST(k AS VARCHAR(20)) AS doc_id, k % 2 AS table_rows, k % 3 AS smiles_count, k % 5 AS compound_ids FROM (SELECT DISTINCT p_partkey % 20 AS k FROM {part}) q"


@query(f"""WITH p AS ({PAGES}), f AS (SELECT f.*, table_rows, smiles_count, compound_ids, lower(caption) AS low, compound_ids > smiles_count OR smiles_count = 0 AS depends FROM ({FIGURES}) f JOIN ({FACTS}) d ON d.doc_id = f.doc_id),
g AS (SELECT *, kind = 'scheme' OR regexp_matches(low, 'synthesis|structure|hybrid|derivatives') AS rich, regexp_matches(low, 'docking|interaction|binding|pose|enzyme|active site|inhibition|activity|mic|zone|antimicrobial|antibacterial|antifungal|graph') AS telling FROM f)
SELECT concat(doc_id, ':main:p', lpad(CAST(page_number AS VARCHAR), 4, '0'), ':document_ocr') AS task_id, doc_id, 'document_ocr' AS task_type, 90 AS priority FROM p WHERE length(trim(text, ' \n\t')) < 500
UNION ALL SELECT concat(doc_id, ':main:p', lpad(CAST(page_number AS VARCHAR), 4, '0'), ':table_ocr'), doc_id, 'table_ocr', 75 FROM p WHERE contains(lower(text), 'table') AND CAST(doc_id AS BIGINT) % 3 <> 0
UNION ALL SELECT concat(figure_id, ':structure_detection'), doc_id, 'chemical_structure_detection', CASE WHEN depends OR kind = 'scheme' THEN 85 ELSE 55 END FROM g WHERE rich
UNION ALL SELECT concat(figure_id, ':ocsr'), doc_id, 'ocsr', CASE WHEN depends OR kind = 'scheme' THEN 80 ELSE 50 END FROM g WHERE rich
UNION ALL SELECT concat(figure_id, ':vlm_describe'), doc_id, 'vlm_describe', CASE WHEN table_rows > 0 THEN 60 ELSE 80 END FROM g WHERE telling
UNION ALL SELECT concat(figure_id, ':light_ocr'), doc_id, 'image_text_ocr', 35 FROM g WHERE kind = 'figure' AND rich AND NOT depends""")
def visual_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = view(spark, sf_dir, PAGES)
    tables = pages.where("CAST(doc_id AS BIGINT) % 3 = 0").select("doc_id", "file_id", "page_number")
    tasks = route.page_tasks(pages, tables).unionByName(route.figure_tasks(view(spark, sf_dir, FIGURES), view(spark, sf_dir, FACTS)))
    return route.best_tasks(tasks).select("task_id", "doc_id", "task_type", "priority")


RAW = """SELECT concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20))) AS id, CASE l_linenumber % 7 WHEN 0 THEN concat('~', q) WHEN 1 THEN concat(q, ' ± 0.5') WHEN 2 THEN ' n/a ' WHEN 3 THEN concat('about ', q, ' min^-1') WHEN 4 THEN concat(q, ' x 10^-3') WHEN 5 THEN '' ELSE q END AS raw, q
 FROM (SELECT *, CAST(CAST(l_quantity AS INT) AS VARCHAR(20)) AS q FROM {lineitem}) z"""


@query(f"""SELECT id, CASE WHEN raw IN (' n/a ', '') THEN 'NOT_DETECTED' ELSE replace(replace(raw, 'min^-1', 'min-1'), '10^-', '10-') END AS v,
 CASE WHEN raw IN (' n/a ', '') THEN 'NOT_DETECTED' WHEN raw LIKE 'about%' THEN concat(q, ' min-1') WHEN raw LIKE '% x 10%' THEN CAST(CAST(q AS INT) / 1000.0 AS VARCHAR) ELSE q END AS n,
 CASE WHEN raw = q THEN concat(q, '.0') ELSE trim(raw) END AS w FROM ({RAW}) z""")
def normalize_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = values.value(c("raw"))
    return view(spark, sf_dir, RAW).select("id", v.alias("v"), values.numeric_text(v).alias("n"), values.whole_as_decimal(c("raw")).alias("w"))


@query("SELECT p_partkey, CASE WHEN p_size % 2 = 0 THEN concat(p_name, '.v', CAST(p_size AS VARCHAR)) ELSE concat(p_name, '.v', CAST(p_size AS VARCHAR)) END AS plain, concat(p_name, '.v', CAST(p_size AS VARCHAR), CASE WHEN p_size % 2 = 0 THEN '.PDF' ELSE '.pdf' END) AS full FROM part")
def pdf_identifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = view(spark, sf_dir, "SELECT p_partkey, concat('a/b/', p_name, '.v', CAST(p_size AS STRING), CASE WHEN p_size % 2 = 0 THEN '.PDF' ELSE '' END) AS f FROM {part}")
    return files.select("p_partkey", values.pdf_identifier(DOMAINS["nanozymes"], c("f")).alias("plain"), values.pdf_identifier(DOMAINS["synergy"], c("f")).alias("full"))


NANO = """SELECT CAST(l_suppkey AS VARCHAR(20)) AS pdf, concat(CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20))) AS id, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey AS VARCHAR(20)) ELSE 'NOT_DETECTED' END AS length, CASE WHEN l_linenumber % 3 = 0 THEN '7' ELSE 'NOT_DETECTED' END AS width, CASE WHEN l_linenumber = 5 THEN '9' ELSE 'NOT_DETECTED' END AS depth,
 CASE WHEN l_suppkey % 3 = 0 AND l_returnflag = 'N' THEN '0.1' ELSE 'NOT_DETECTED' END AS km_value, CASE WHEN l_suppkey % 3 = 0 AND l_linestatus = 'F' THEN '0.2' ELSE NULL END AS vmax_value FROM {lineitem}"""


@query(f"""WITH n AS ({NANO}), k AS (SELECT *, coalesce(km_value, 'NOT_DETECTED') <> 'NOT_DETECTED' OR coalesce(vmax_value, 'NOT_DETECTED') <> 'NOT_DETECTED' AS has FROM n), g AS (SELECT pdf, bool_or(has) AS told FROM k GROUP BY 1)
SELECT id, k.pdf, length, CASE WHEN length <> 'NOT_DETECTED' AND width = 'NOT_DETECTED' THEN length ELSE width END AS width, CASE WHEN depth <> 'NOT_DETECTED' THEN depth WHEN length <> 'NOT_DETECTED' THEN length ELSE width END AS depth FROM k JOIN g ON g.pdf = k.pdf WHERE has OR NOT told""")
def nanozyme_fill_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.drop_setup_rows(normalize.fill_dimensions(view(spark, sf_dir, NANO))).select("id", "pdf", "length", "width", "depth")


@query("SELECT o_orderkey, concat('x:', substr(sha1(concat(CAST(o_orderkey AS VARCHAR), '|', coalesce(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus END, 'None'), '|', o_orderpriority)), 1, 16)) AS id FROM orders")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = view(spark, sf_dir, "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS s, o_orderpriority FROM {orders}")
    return orders.select("o_orderkey", values.stable_id("x", c("o_orderkey"), c("s"), c("o_orderpriority")).alias("id"))


_HREF = """regexp_extract_all(html, '<a [^>]*href="([^"]*)"', 1)"""


@query(f"SELECT page_id, position, href FROM (SELECT page_id, unnest({_HREF}) AS href, generate_subscripts({_HREF}, 1) AS position FROM pages) q")
def html_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return web.anchors(view(spark, sf_dir, "SELECT page_id, url, html FROM {pages}")).select("page_id", (c("position") + 1).cast("long").alias("position"), "href")


@query(f"SELECT page_id, count(DISTINCT href) AS n FROM (SELECT page_id, unnest({_HREF}) AS href FROM pages) q WHERE contains(lower(href), 'th') OR contains(lower(href), 'on') GROUP BY 1")
def marked_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = web.anchors(view(spark, sf_dir, "SELECT page_id, url, html FROM {pages}"))
    return found.where(route.holds_any(F.lower("href"), ("th", "on"))).groupBy("page_id").agg(F.countDistinct("href").alias("n"))


@query(r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), k AS (SELECT doc_id, t, list_filter(regexp_extract_all(t, '\b[A-ZBCNOFPSIbcnops0-9@+\-\[\]\(\)=#$\\/%.]{6,}\b', 0), lambda x: upper(x) NOT IN ('RESULTS', 'METHODS', 'SUPPORT', 'ACTIVITY', 'COMPOUND', 'FIGURE') AND (regexp_matches(x, '[=#\[\]()/\\]') OR regexp_matches(x, '[0-9].*[0-9]'))) AS s FROM d)
SELECT doc_id, CASE WHEN trim(t, E' \n\t') = '' THEN 0 ELSE len(regexp_split_to_array(trim(t, E' \n\t'), '\s+')) END AS text_tokens, least(20, len(list_distinct(s))) AS detected_smiles FROM k""")
def doc_text_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heuristics.source_summary(view(spark, sf_dir, "SELECT doc_id, text FROM {documents}")).select("doc_id", "text_tokens", "detected_smiles")


@query(r"SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE concat(rtrim(substr(t, 1, 119)), '...') END AS snippet FROM (SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents) q")
def snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "SELECT doc_id, text FROM {documents}").select("doc_id", text.snippet(c("text"), 120).alias("snippet"))


@query("SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(replace(text, '–', '-'), '−', '-'), chr(10)), lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS cleaned FROM documents".replace("\\\\", "\\"))
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, "SELECT doc_id, text FROM {documents}").select("doc_id", text.clean(c("text")).alias("cleaned"))


JOBS = "SELECT event_id AS job_id, event_type AS domain, CASE WHEN user_id % 4 = 0 THEN 'failed' ELSE 'completed' END AS status, ts AS updated_at, value AS macro_f1, CAST(user_id AS BIGINT) AS record_count FROM {events}"
BOARD = "SELECT DISTINCT event_type AS domain, CASE WHEN event_type = 'error' THEN NULL ELSE 100.0 END AS baseline FROM {events}"


@query(f"""WITH j AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY updated_at DESC, job_id DESC) AS n, count(*) OVER (PARTITION BY domain) AS k FROM ({JOBS}) q WHERE status = 'completed')
SELECT b.domain, j.macro_f1 AS current, CAST(round(j.macro_f1 - b.baseline, 3) AS DOUBLE) AS delta, coalesce(j.record_count, 0) AS record_count, coalesce(j.k, 0) AS run_count, j.job_id FROM ({BOARD}) b LEFT JOIN j ON j.domain = b.domain AND j.n = 1""")
def domain_dashboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    board = jobs.dashboard(view(spark, sf_dir, JOBS), view(spark, sf_dir, BOARD).withColumn("baseline", c("baseline").cast("double")))
    return board.select("domain", "current", "delta", "record_count", "run_count", "job_id")


@query("SELECT user_id, event_id, event_type AS status FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) q WHERE n = 1")
def job_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = view(spark, sf_dir, "SELECT user_id, event_id, ts, event_type AS status FROM {events}")
    return jobs.latest(states, by="user_id", at="ts", tie="event_id").select("user_id", "event_id", "status")


@query("SELECT user_id, event_id, event_type AS status FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events) q WHERE b IS NULL OR b <> event_type")
def job_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = view(spark, sf_dir, "SELECT user_id, event_id, ts, event_type AS status FROM {events}")
    return jobs.changes(states, by="user_id", order=["ts", "event_id"], value="status").select("user_id", "event_id", "status")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, concat(json_extract_string(props, '$.k'), ',', 'x') AS listed FROM events")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, "SELECT event_id, props FROM {events}")
    k = F.get_json_object("props", "$.k")
    listed = values.json_strings(F.concat(F.lit("["), k, F.lit(', "x"]')))
    return rows.select("event_id", k.try_cast("long").alias("k"), F.array_join(listed, ",").alias("listed"))


@query("""WITH s AS (SELECT user_id, event_id, event_type, epoch(date_trunc('second', ts)) AS x0 FROM events), g AS (SELECT *, CASE WHEN x0 - lag(x0 + 3600) OVER (PARTITION BY user_id ORDER BY x0, event_id) <= 7200 THEN 0 ELSE 1 END AS o FROM s),
i AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY x0, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM g)
SELECT user_id, CAST(island AS BIGINT) AS island, string_agg(event_type, ' ' ORDER BY x0, event_id) AS text, CAST(max(x0) - min(x0) AS DOUBLE) AS width FROM i GROUP BY 1, 2""")
def spans_to_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = view(spark, sf_dir, "SELECT user_id, event_id AS span_id, event_type AS text, CAST(unix_timestamp(ts) AS DOUBLE) AS x0, CAST(unix_timestamp(ts) + 3600 AS DOUBLE) AS x1, 0.0D AS y0, 1.0D AS y1 FROM {events}")
    merged = layout.merge_spans(spans, by=["user_id"], gap=7200.0)
    return merged.select("user_id", "island", "text", (c("x1") - 3600 - c("x0")).alias("width"))


LINES = "SELECT CAST(user_id AS VARCHAR(20)) AS doc_id, CAST(event_id AS INT) AS line, CASE WHEN event_type = 'error' THEN 'x' ELSE concat(CAST(event_id AS VARCHAR(20)), 'a') END AS a, CASE WHEN value > 300 THEN 'none' ELSE '5' END AS b, '-' AS d FROM {events}"


@query(f"""WITH l AS (SELECT *, a <> 'x' AND b = '5' AS data FROM ({LINES}) q), f AS (SELECT *, max(CASE WHEN data THEN 1 ELSE 0 END) OVER w AS begun FROM l WINDOW w AS (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
g AS (SELECT *, min(CASE WHEN data THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS ok FROM f WHERE begun = 1) SELECT doc_id, line FROM g WHERE ok = 1""")
def take_while_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = view(spark, sf_dir, LINES).select("doc_id", "line", F.array("a", "b", "d").alias("cells"))
    return layout.data_rows(lines, by=["doc_id"]).select("doc_id", "line")


@query("SELECT user_id % 5 AS stage, user_id % 8 AS tick, CAST(least(98, round_even(((user_id % 5) / 5.0 + (user_id % 8) / 8.0 / 5.0) * 100, 0)) AS INT) AS progress FROM events GROUP BY user_id")
def job_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = view(spark, sf_dir, "SELECT user_id % 5 AS stage, user_id % 8 AS tick FROM {events} GROUP BY user_id")
    return users.select("stage", "tick", jobs.progress(c("stage"), c("tick")).alias("progress"))


CELLS = "SELECT event_id, CASE event_id % 6 WHEN 0 THEN concat('MIC ', CAST(user_id AS VARCHAR(20)), ' ug/mL') WHEN 1 THEN concat('Km = ', CAST(user_id AS VARCHAR(20)), '.5') WHEN 2 THEN concat('a', CAST(user_id AS VARCHAR(20)), ' or ', CAST(user_id AS VARCHAR(20)), ' nM') WHEN 3 THEN concat(' >= ', CAST(user_id AS VARCHAR(20)), ' ') WHEN 4 THEN concat(CAST(user_id AS VARCHAR(20)), ' things') ELSE 'none' END AS cell, CAST(user_id AS VARCHAR(20)) AS u FROM {events}"


@query(f"""SELECT event_id, CASE event_id % 6 WHEN 1 THEN '=' WHEN 3 THEN '>=' END AS relation, CASE WHEN event_id % 6 IN (0, 2, 3) THEN u WHEN event_id % 6 = 1 THEN concat(u, '.5') END AS value, CASE event_id % 6 WHEN 0 THEN 'µg/mL' WHEN 2 THEN 'nM' END AS units FROM ({CELLS}) q""")
def measured_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = view(spark, sf_dir, CELLS).select("event_id", chemistry.measured(c("cell")).alias("m"))
    return found.select("event_id", "m.relation", "m.value", "m.units")


#: Columns whose type differs between the engines, as the DataFrame has them.
CASTS = {
    "eval_per_article": {"tp": "BIGINT", "fp": "BIGINT", "fn": "BIGINT"},
    "table_measurements": {"confidence": "DOUBLE"},
    "table_plans": {"confidence": "DOUBLE"},
    "compound_links": {"confidence": "DOUBLE"},
    "missing_links": {"missing": "BIGINT"},
    "conflict_decisions": {"confidence": "DOUBLE"},
    "nearby_band_topk": {"nth": "INTEGER"},
    "evidence_rank_topk": {"rank": "INTEGER"},
    "quota_candidates": {"rank": "INTEGER"},
    "field_coverage": {"hits": "BIGINT"},
    "doc_text_tokens": {"text_tokens": "INTEGER", "detected_smiles": "INTEGER"},
}
for _name, _types in CASTS.items():
    _casts = ", ".join(f"CAST({k} AS {t}) AS {k}" for k, t in _types.items())
    ORACLES[_name] = f"SELECT * REPLACE ({_casts}) FROM ({ORACLES[_name]}) typed"

"""Queries on how far documents are from extraction. A source's documents are a document's evidence
and the language stands for its kind, as in the ranking queries."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corundum.operators import checker, rank, route
from corundum.plans.base import query, view
from corundum.plans.queries import _SCORED, RANKED, SKILL, _hits
from corundum.schemas import DOMAINS
from corundum.sources import adapters

c = F.col

ALIASED = rank.Skill("aliased", ("idiot", "smiles"), ("the",), {"idiot": ("moron", "api key"), "smiles": ("password",)})
LOOSE = rank.Skill("loose", ("token", "den"), ("und",))

# Counts of a document's parts, by source; every third source has no table rows.
_SCORE = """CASE source_type WHEN 'table_row' THEN 1.25 WHEN 'table_caption' THEN 0.75 WHEN 'chemical_structure_smiles' THEN 1.0 ELSE 0 END
 + CASE WHEN regexp_matches(text, '(?:^|[^A-Za-z])[0-9]') THEN 0.5 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)\\b(?:SMILES|MIC|pMIC|IC50|EC50|AgNP|Fe3O4|TiO2|SiO2|ZnO|AuNP|DOTA|logK|lgK|Km|Vmax)\\b') THEN 0.7 ELSE 0 END + least(0.5, greatest(0.0, confidence - 0.5))"""


def _evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, RANKED).withColumn("confidence", c("confidence").cast("double"))


def _bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _evidence(spark, sf_dir)
    documents = e.select("doc_id").distinct().withColumns({"source_path": F.concat("doc_id", F.lit(".pdf")), "created_at": F.lit(0)})
    tasks = e.where("page_number % 2 = 0").select("doc_id")
    detections = e.where("page_number % 5 = 0").select("doc_id", F.when(c("page_number") % 10 == 0, "C").alias("smiles"))
    notes = documents.select("doc_id", F.lit(3).alias("pages_count"), F.array(F.lit("a note")).alias("notes"))
    return checker.bundle(documents, e.withColumn("source_type", F.when((c("source_type") == "table_row") & (F.length("doc_id") % 3 == 0), "paragraph").otherwise(c("source_type"))), e.where("page_number % 7 = 0"), e.where("false"), tasks, detections, notes)


_BUNDLES = f"""WITH e AS (SELECT *, CASE WHEN source_type = 'table_row' AND length(doc_id) % 3 = 0 THEN 'paragraph' ELSE source_type END AS kind FROM ({RANKED}) q),
b AS (SELECT doc_id, count(*) AS evidence, count(*) FILTER (kind = 'table_row') AS rows, count(*) FILTER (kind IN ('table_caption', 'figure_caption')) AS captions, count(*) FILTER (page_number % 7 = 0) AS tables, count(*) FILTER (page_number % 2 = 0) AS visual_tasks, count(*) FILTER (page_number % 5 = 0) AS detections,
 CASE WHEN count(*) FILTER (kind = 'chemical_structure_smiles') > 0 THEN count(*) FILTER (kind = 'chemical_structure_smiles') ELSE count(*) FILTER (page_number % 10 = 0) END AS smiles FROM e GROUP BY 1)"""


@query(_BUNDLES + " SELECT doc_id, concat(doc_id, '.pdf') AS source_path, evidence, rows AS table_rows, tables, visual_tasks, detections, smiles, 0 AS figures, 'a note' AS notes FROM b", figures="BIGINT")
def document_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _bundles(spark, sf_dir).select("doc_id", "source_path", "evidence", checker.kind_count("table_row").alias("table_rows"), "tables", "visual_tasks", "detections", "smiles", "figures", F.array_join("notes", ",").alias("notes"))


@query(_BUNDLES + """ SELECT doc_id, 'evidence_blocks' AS name, 'pass' AS status, concat(evidence, ' blocks of evidence') AS detail FROM b UNION ALL SELECT doc_id, 'table_rows', CASE WHEN rows > 0 THEN 'pass' ELSE 'warn' END, concat(rows, ' table rows') FROM b UNION ALL SELECT doc_id, 'captions', CASE WHEN captions > 0 THEN 'pass' ELSE 'warn' END, concat(captions, ' captions') FROM b
UNION ALL SELECT doc_id, 'structure_smiles', CASE WHEN smiles > 0 THEN 'pass' ELSE 'warn' END, concat(smiles, ' structures') FROM b UNION ALL SELECT doc_id, 'visual_followup', 'warn', concat(visual_tasks, ' visual tasks wait') FROM b WHERE visual_tasks > 0 AND smiles = 0""")
def pipeline_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checker.pipeline_checks(_bundles(spark, sf_dir))


def _scores(skill: rank.Skill) -> str:
    """CTEs f, s and k: coverage, best score and check of a skill."""
    hits = ", ".join(f"sum(CASE WHEN len({_hits(skill.terms_of(f))}) > 0 THEN 1 ELSE 0 END) AS h{i}" for i, f in enumerate(skill.fields))
    part = " + ".join(f"CASE WHEN h{i} >= 3 THEN 1.0 WHEN h{i} > 0 THEN 0.5 ELSE 0.0 END" for i in range(len(skill.fields)))
    structure = "CASE WHEN b.smiles > 0 THEN 1.0 WHEN b.detections > 0 THEN 0.55 WHEN b.visual_tasks > 0 THEN 0.35 ELSE 0.15 END" if skill.needs_structure else "1.0"
    lost = "WHEN b.smiles = 0 THEN 'needs_visual_or_ocsr' " if skill.needs_structure else ""
    return f"""f AS (SELECT doc_id, round(({part}) / {len(skill.fields)}.0, 3) AS coverage FROM (SELECT doc_id, {hits} FROM ({RANKED}) q GROUP BY 1) h),
m AS (SELECT doc_id, len({_hits(skill.terms)}) AS n, {_SCORE} AS extra FROM ({RANKED}) q), s AS (SELECT doc_id, max(round(n + extra, 3)) AS best FROM m WHERE n > 0 GROUP BY 1),
k AS (SELECT f.doc_id, CAST(coverage AS DOUBLE) AS coverage, CAST(best AS DOUBLE) AS best, round(coverage * 0.62 + CAST(round(least(1.0, ln(1 + coalesce(best, 0)) / 3), 3) AS DOUBLE) * 0.26 + {structure} * 0.12, 3) AS score, b.smiles, b.rows FROM f JOIN b ON b.doc_id = f.doc_id LEFT JOIN s ON s.doc_id = f.doc_id),
z AS (SELECT k.*, CASE WHEN best IS NULL THEN 'low_signal' {lost.replace("b.smiles", "smiles")}WHEN score >= 0.68 AND coverage >= 0.55 THEN 'ready_for_single_agent_review' WHEN score >= 0.42 THEN 'partial_evidence' ELSE 'low_signal' END AS status FROM k)"""


@query(_BUNDLES + ", " + _scores(ALIASED) + " SELECT doc_id, coverage, best, score, status FROM z", score="DOUBLE")
def skill_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = _bundles(spark, sf_dir).select("doc_id", "smiles", "detections", "visual_tasks")
    return rank.skill_check(_evidence(spark, sf_dir), ALIASED, counts)


@query(_BUNDLES + ", " + _scores(ALIASED) + """ SELECT doc_id, concat_ws('; ', CASE WHEN smiles = 0 THEN 'detect and read structures: records of this kind name them' END, CASE WHEN rows = 0 THEN 'no table rows: look at table extraction, or read tables from images' END,
 CASE WHEN coverage < 0.5 THEN 'evidence covers too few fields: route by this, don''t extract' END, CASE WHEN best IS NOT NULL THEN 'give the best evidence and the skill''s prompt to the first extraction' END) AS advice FROM z""")
def skill_advice(spark: SparkSession, sf_dir: str) -> DataFrame:
    bundles = _bundles(spark, sf_dir)
    checked = rank.skill_check(_evidence(spark, sf_dir), ALIASED, bundles.select("doc_id", "smiles", "detections", "visual_tasks"))
    return checker.recommendations(checked, bundles, ALIASED).select("doc_id", F.array_join("advice", "; ").alias("advice"))


_BOTH = f"""WITH o AS ({_BUNDLES}, {_scores(ALIASED)} SELECT doc_id, 'aliased' AS skill, score, status FROM z UNION ALL SELECT * FROM ({_BUNDLES}, {_scores(LOOSE)} SELECT doc_id, 'loose' AS skill, score, status FROM z) y)"""


@query(_BOTH + " SELECT doc_id, skill, CAST(score AS DOUBLE) AS score, status, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, skill) AS nth FROM o", nth="INTEGER")
def best_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checker.check_skills(_evidence(spark, sf_dir), [ALIASED, LOOSE], _bundles(spark, sf_dir)).select("doc_id", "skill", "score", "status", "nth")


#: Skills of three record types with the package's own words for their fields; the texts name few of them.
OF_TYPES = tuple(rank.Skill.of(DOMAINS[k], ("password", "token")) for k in ("nanozymes", "cytotoxicity", "seltox"))
_TYPES = " UNION ALL ".join(f"SELECT * FROM ({_BUNDLES}, {_scores(s)} SELECT doc_id, '{s.name}' AS skill, coverage, best, score, status FROM z) y{i}" for i, s in enumerate(OF_TYPES))


@query(f"SELECT * FROM ({_TYPES}) t", score="DOUBLE")
def type_skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All skills in one pass over the evidence."""
    counts = _bundles(spark, sf_dir).select("doc_id", "smiles", "detections", "visual_tasks")
    return rank.check_all(_evidence(spark, sf_dir), list(OF_TYPES), counts)


def _examples(field: str) -> str:
    return f"SELECT doc_id, '{field}' AS field, evidence_id, page_number, array_to_string({_hits(ALIASED.terms_of(field))}[1:8], ',') AS terms FROM ({RANKED}) q WHERE len({_hits(ALIASED.terms_of(field))}) > 0"


@query(f"WITH e AS ({' UNION ALL '.join(map(_examples, ALIASED.fields))}), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, field ORDER BY page_number, evidence_id) AS nth FROM e) SELECT doc_id, field, nth, evidence_id, terms FROM n WHERE nth <= 3", nth="INTEGER")
def field_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the limit: the first three examples of a field."""
    return rank.field_examples(_evidence(spark, sf_dir), ALIASED).select("doc_id", "field", "nth", "evidence_id", F.array_join("matched_terms", ",").alias("terms"))


WORDS = ("the", "password", "idiot", "und")


@query(f"WITH m AS (SELECT doc_id, len({_hits(WORDS)}) AS n, {_SCORE} AS extra FROM ({RANKED}) q) SELECT doc_id, round(ln(1 + sum(CASE WHEN n > 0 THEN CAST(n + extra AS DOUBLE) ELSE 0 END)), 3) AS score, count(*) FILTER (n > 0) AS hits FROM m GROUP BY 1", score="DOUBLE")
def variant_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rank.variant_score(_evidence(spark, sf_dir), WORDS)


# Facts of documents from their text and the first cells of their tables.
# Signs beyond ASCII go, as the engines differ on what a word is there.
_FACTS = "SELECT source AS doc_id, concat(regexp_replace(text, '[^ -~]', ' '{G}), ' CCO(=O)', CAST(doc_id % 7 AS VARCHAR(20)), 'ccccc x') AS text FROM {documents}"
FACT_PAGES = _FACTS.replace("{G}", "")
FACT_ROWS = "SELECT source AS doc_id, concat(CAST(doc_id % 40 AS VARCHAR(20)), CASE WHEN doc_id % 2 = 0 THEN 'a' ELSE 'A' END, ' and 7b') AS cell FROM {documents} WHERE doc_id % 3 = 0"


@query(f"""WITH p AS (SELECT doc_id, unnest(regexp_extract_all(text, '\\b[A-Z][A-Za-z0-9@+\\-\\[\\]\\(\\)=#$\\\\/]{{8,}}\\b', 0)) AS s FROM ({_FACTS.replace("{G}", ", 'g'")}) q), r AS (SELECT doc_id, count(*) AS n FROM ({FACT_ROWS}) q GROUP BY 1), i AS (SELECT doc_id, unnest(regexp_extract_all(cell, '(?i)\\b\\d{{1,3}}[a-z]\\b', 0)) AS i FROM ({FACT_ROWS}) q)
SELECT d.doc_id, coalesce(r.n, 0) AS table_rows, coalesce((SELECT count(DISTINCT s) FROM p WHERE p.doc_id = d.doc_id), 0) AS smiles_count, coalesce((SELECT count(DISTINCT lower(i)) FROM i WHERE i.doc_id = d.doc_id), 0) AS compound_ids FROM (SELECT DISTINCT source AS doc_id FROM documents) d LEFT JOIN r ON r.doc_id = d.doc_id""")
def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = view(spark, sf_dir, FACT_ROWS).select("doc_id", F.array("cell").alias("cells"))
    return route.document_facts(view(spark, sf_dir, FACT_PAGES), rows, rows)


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN concat('| a | b |', chr(10), '| --- | --- |', chr(10), '| x/', CAST(user_id AS VARCHAR), ' | 1 |', chr(10), '|  |  |') WHEN 1 THEN concat('| a | b |', chr(10), '| --- | --- |', chr(10), '| ', CAST(user_id AS VARCHAR), ' |  |') END AS markdown FROM events")
def final_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = c("user_id").cast("string")
    k = c("event_id") % 4
    answer = F.when(k == 0, F.concat(F.lit('[{"a":"x|'), user, F.lit('","b":1},{"b":null}]'))).when(k == 1, F.concat(F.lit('{"a":"'), user, F.lit('"}'))).when(k == 2, "no json").otherwise("[1]")
    rows = view(spark, sf_dir, "SELECT event_id, user_id FROM {events}").withColumn("answer", answer)
    return checker.final_table(rows, ("a", "b"), by="event_id")


def _echo():  # noqa: ANN202
    """A stand-in for a model: it lists the ids of the evidence that it is given."""

    def ask(system: str, prompt: str, images: list[bytes]) -> str:
        return json.dumps([{"id": e["evidence_id"], "rank": e["rank"]} for e in json.loads(prompt.split("Evidence:\n", 1)[1])])

    return ask


@query(_SCORED + " SELECT doc_id, concat('| id | rank |', chr(10), '| --- | --- |', chr(10), string_agg(concat('| ', evidence_id, ' | ', rank, ' |'), chr(10) ORDER BY rank)) AS markdown FROM top WHERE rank <= 5 GROUP BY 1")
def checked_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a check gives to the first extraction, and its answer as a table."""
    best = rank.candidates(_evidence(spark, sf_dir), SKILL, top=5)
    answers = adapters.complete(checker.requests(best, SKILL, "extract").drop("doc_id"), _echo)
    return checker.final_table(answers.select(c("request_id").alias("doc_id"), c("content").alias("answer")), ("id", "rank"))

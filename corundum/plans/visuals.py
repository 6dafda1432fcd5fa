"""Queries on figures, crops and structures, and on the store that keeps them. Parts are figures,
line items are crops of them, orders are the evidence around."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corundum.functions.core import once
from corundum.operators import recognition, route, visual, work
from corundum.plans.base import query, view
from corundum.sources.folders import scratch
from corundum.sources.store import EvidenceStore

c = F.col

FIGURES = """SELECT CAST(p_partkey % 50 AS VARCHAR(20)) AS doc_id, 'main' AS file_id, CAST(p_size AS INT) AS page_number, concat('f', CAST(p_partkey AS VARCHAR(20))) AS figure_id, p_brand AS label, CASE WHEN p_size % 9 = 0 THEN NULL ELSE p_name END AS caption, concat(p_name, '.png') AS image_path, 'figure' AS kind, p_partkey FROM {part}"""
CROPS = """SELECT CAST(l_partkey % 50 AS VARCHAR(20)) AS doc_id, 'main' AS file_id, 1 AS page_number, concat('d', CAST(l_orderkey AS VARCHAR(20)), '-', CAST(l_linenumber AS VARCHAR(20)), '-', CAST(l_partkey AS VARCHAR(20)), '-', CAST(l_suppkey AS VARCHAR(20)), '-', CAST(CAST(l_quantity AS INT) AS VARCHAR(20))) AS detection_id, concat('task', CAST(l_orderkey AS VARCHAR(20))) AS task_id,
 CASE WHEN l_partkey % 3 = 0 THEN concat('f', CAST(l_partkey AS VARCHAR(20))) END AS parent_figure_id, concat(l_returnflag, '.png') AS image_path, CASE l_returnflag WHEN 'N' THEN concat('C', CAST(l_linenumber AS VARCHAR(20))) WHEN 'A' THEN ' ' END AS smiles, l_linestatus AS provider, CAST(l_discount * 10 AS DOUBLE) AS confidence, l_linenumber, l_quantity FROM {lineitem}"""
AROUND = """SELECT CAST(o_custkey % 50 AS VARCHAR(20)) AS doc_id, CAST(1 + o_orderkey % 50 AS INT) AS page_number, concat('e', CAST(o_orderkey AS VARCHAR(20))) AS evidence_id, CASE o_orderstatus WHEN 'F' THEN 'table_row' WHEN 'O' THEN 'paragraph' ELSE CASE WHEN o_orderkey % 2 = 0 THEN 'figure_caption' ELSE 'section_heading' END END AS source_type, concat(' text  ', o_orderpriority) AS text FROM {orders}"""


def _crops(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, CROPS).withColumns({"bbox": F.lit(None).cast("array<double>"), "label_nearby": F.lit(None).cast("string"), "metadata": F.lit(None).cast("string")})


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    figures = view(spark, sf_dir, FIGURES)
    pages = view(spark, sf_dir, "SELECT CAST(s_suppkey % 50 AS STRING) AS doc_id, 'main' AS file_id, CAST(1 + s_nationkey AS INT) AS page_number, concat(' page  of ', min(s_name)) AS text FROM {supplier} GROUP BY 1, 2, 3")
    return work.figure_items(figures, pages, _crops(spark, sf_dir), view(spark, sf_dir, AROUND), most_crops=3)


@query(f"""WITH f AS ({FIGURES}), d AS ({CROPS}), e AS ({AROUND}), p AS (SELECT CAST(s_suppkey % 50 AS VARCHAR) AS doc_id, 1 + s_nationkey AS page_number, concat('page of ', min(s_name)) AS page_text FROM supplier GROUP BY 1, 2),
k AS (SELECT parent_figure_id AS figure_id, detection_id, row_number() OVER (PARTITION BY parent_figure_id ORDER BY CASE WHEN trim(coalesce(smiles, '')) <> '' THEN 0 ELSE 1 END, detection_id) AS n FROM d WHERE parent_figure_id IS NOT NULL),
kk AS (SELECT figure_id, string_agg(concat('crop:', detection_id), ',' ORDER BY n) AS crops FROM k WHERE n <= 3 GROUP BY 1),
m AS (SELECT f.figure_id, e.evidence_id, row_number() OVER (PARTITION BY f.figure_id ORDER BY CASE WHEN e.page_number = f.page_number THEN 0 ELSE 1 END, CASE e.source_type WHEN 'table_row' THEN 0 WHEN 'paragraph' THEN 1 ELSE 2 END, e.evidence_id) AS n
 FROM f JOIN kk USING (figure_id) JOIN e ON e.doc_id = f.doc_id AND e.page_number BETWEEN greatest(1, f.page_number - 1) AND f.page_number + 1 AND e.source_type <> 'section_heading'),
mm AS (SELECT figure_id, string_agg(evidence_id, ',' ORDER BY n) AS nearby FROM m WHERE n <= 12 GROUP BY 1)
SELECT f.figure_id, f.page_number, coalesce(f.caption, '') AS caption, coalesce(p.page_text, '') AS page_text, kk.crops, coalesce(mm.nearby, '') AS nearby FROM f JOIN kk USING (figure_id) LEFT JOIN mm USING (figure_id) LEFT JOIN p ON p.doc_id = f.doc_id AND p.page_number = f.page_number""")
def figure_work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = lambda column, field: F.coalesce(F.array_join(F.transform(column, lambda x: x[field]), ","), F.lit(""))
    return _items(spark, sf_dir).select("figure_id", "page_number", "caption", "page_text", names("crops", "crop_label").alias("crops"), names("nearby", "evidence_id").alias("nearby"))


# An analysis maps compounds to crops: one that is there, one twice, one unknown, one without a name.
def _chemical(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = view(spark, sf_dir, "SELECT concat('f', CAST(p_partkey AS STRING)) AS figure_id, CAST(p_partkey % 50 AS STRING) AS doc_id, CAST(p_size AS INT) AS page_number, p_name AS caption, p_partkey, p_size FROM {part}")
    label = F.concat(F.lit("crop:"), c("p_partkey").cast("string"))
    mapping = lambda compound, crop, sure: F.struct(compound.alias("compound_id"), crop.alias("crop_label"), F.lit(sure).alias("confidence"))
    own = F.concat(c("p_size").cast("string"), F.lit("a"))
    analysis = F.struct(F.lit("s").alias("summary"), F.array(mapping(F.concat(F.lit(" "), own), label, 0.5), mapping(own, label, 0.9), mapping(F.lit("1"), F.lit("crop:none"), 0.5), mapping(F.lit("  "), label, 0.5)).alias("mappings"), F.array(F.struct(label.alias("crop_label"), (c("p_size") % 4 == 0).alias("requires_substituent_resolution"))).alias("scaffolds"))
    crop = F.struct(label.alias("crop_label"), F.concat(F.lit("d"), c("p_partkey").cast("string")).alias("detection_id"), F.lit("x.png").alias("image_path"), F.lit(None).cast("array<double>").alias("bbox"), F.when(c("p_size") % 3 == 0, F.lit("CC")).otherwise("").alias("recognised_smiles"), F.lit(0.7).alias("recognised_confidence"))
    results = parts.select("doc_id", "figure_id", "page_number", "caption", F.array(crop).alias("crops"), F.when(c("p_size") % 7 == 0, F.when(c("p_size") % 2 == 0, F.lit("no json"))).otherwise(F.to_json(analysis)).alias("analysis"))
    return work.chemical_items(results)


_CHEMICAL = "SELECT concat('f', CAST(p_partkey AS VARCHAR)) AS figure_id, concat(CAST(p_size AS VARCHAR), 'a') AS compound_id, concat('d', CAST(p_partkey AS VARCHAR)) AS detection_id, CAST(p_partkey % 50 AS VARCHAR) AS doc_id, p_size, p_partkey FROM part WHERE p_size % 7 <> 0"


@query(f"SELECT figure_id, compound_id, detection_id, CAST(0.5 AS DOUBLE) AS mapping_confidence, p_size % 4 = 0 AS open_scaffold FROM ({_CHEMICAL}) q")
def chemical_work_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _chemical(spark, sf_dir).select("figure_id", "compound_id", "detection_id", "mapping_confidence", "open_scaffold")


# Recognitions of the chemical items: the model's structure by the part's size, the recogniser's.
_MODEL = "CASE WHEN p_size % 5 = 0 THEN '' WHEN p_size % 5 = 1 THEN 'C*' ELSE 'CCO' END"


def _decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.regexp_extract("compound_id", r"^(\d+)", 1).cast("int")
    model = F.when(size % 5 == 0, F.lit("none")).when(size % 5 == 1, F.lit(" C*")).otherwise(F.lit("CCO"))
    read = once(_chemical(spark, sf_dir), F.struct(visual.clean_smiles(model).alias("model_smiles"), visual.clean_smiles(c("recognised_smiles")).alias("recognised_smiles")), "read")
    records = read.drop("recognised_smiles").select("*", "read.*")
    checked = F.when(size % 5 == 2, F.lit(None).cast("boolean")).otherwise(size % 5 == 3)
    return visual.accept(records.withColumns({"model_validity": visual.validity(c("model_smiles"), checked), "recognised_validity": visual.validity(c("recognised_smiles"), F.lit(True))}))


_DECIDED = f"""WITH q AS ({_CHEMICAL}), v AS (SELECT *, {_MODEL} AS m, CASE WHEN p_size % 5 < 2 OR p_size % 5 = 4 THEN 'invalid' WHEN p_size % 5 = 2 THEN 'not_checked' ELSE 'valid' END AS mv, CASE WHEN p_size % 3 = 0 THEN 'valid' ELSE 'invalid' END AS rv FROM q),
d AS (SELECT *, CASE WHEN p_size % 4 = 0 THEN 'rejected' WHEN mv = 'valid' OR rv = 'valid' THEN 'accepted' WHEN mv = 'not_checked' THEN 'needs_review' ELSE 'rejected' END AS validation_status,
 CASE WHEN p_size % 4 = 0 THEN 'NOT_DETECTED' WHEN mv = 'valid' THEN m WHEN rv = 'valid' THEN 'CC' WHEN mv = 'not_checked' THEN m ELSE 'NOT_DETECTED' END AS final_smiles FROM v)"""


@query(_DECIDED + " SELECT figure_id, validation_status, final_smiles FROM d")
def ocr_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _decided(spark, sf_dir).select("figure_id", "validation_status", "final_smiles")


@query(_DECIDED + " SELECT doc_id, count(*) FILTER (validation_status = 'accepted') AS accepted, count(*) FILTER (validation_status = 'needs_review') AS needs_review, count(*) FILTER (validation_status = 'rejected') AS rejected FROM d GROUP BY 1")
def ocr_decision_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.decisions(_decided(spark, sf_dir))


# Two agents with a stand-in for their model: a figure's first crop is compound 1a, read by its page.
def _two() -> Callable[[str, str, list[bytes]], str]:
    def ask(system: str, prompt: str, images: list[bytes]) -> str:
        told = json.loads(prompt.split("\n", 1)[1])
        if system == "analyse":
            if told["page_number"] % 6 == 0:
                raise RuntimeError("the model is away")
            return "```json\n" + json.dumps({"mappings": [{"compound_id": "1a", "crop_label": told["crops"][0]["crop_label"], "confidence": 0.5}], "scaffolds": [{"crop_label": told["crops"][0]["crop_label"], "requires_substituent_resolution": told["page_number"] % 5 == 0}]}) + "\n```"
        return json.dumps({"smiles": "CCO", "confidence": 0.9}) if told["crop_label"].endswith(tuple("02468")) else "I can't read it"

    return ask


@query(f"""WITH f AS ({FIGURES}), d AS (SELECT *, trim(coalesce(smiles, '')) AS s FROM ({CROPS}) q), k AS (SELECT parent_figure_id AS figure_id, detection_id, s, row_number() OVER (PARTITION BY parent_figure_id ORDER BY CASE WHEN s <> '' THEN 0 ELSE 1 END, detection_id) AS n FROM d WHERE parent_figure_id IS NOT NULL),
r AS (SELECT f.figure_id, k.detection_id, f.page_number AS p, k.s, CAST(right(k.detection_id, 1) AS INT) % 2 = 0 AS read FROM f JOIN k ON k.figure_id = f.figure_id AND k.n = 1 WHERE f.page_number % 6 <> 0)
SELECT figure_id, detection_id, '1a' AS compound_id, CASE WHEN p % 5 = 0 THEN 'NOT_DETECTED' WHEN read THEN 'CCO' WHEN s <> '' THEN s ELSE 'NOT_DETECTED' END AS smiles, CASE WHEN p % 5 = 0 THEN 'rejected' WHEN read OR s <> '' THEN 'accepted' ELSE 'rejected' END AS validation_status FROM r""")
def two_agent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = work.two_agents(_items(spark, sf_dir), _two, ("analyse", "read"), check=lambda s: F.length(s) > 1)
    return work.ocr_table(found).select("figure_id", "detection_id", "compound_id", "smiles", "validation_status")


# Every other recognised part has a detection; of those some know a structure already.
_KNOWN = "SELECT concat('d', CAST(p_partkey AS VARCHAR(20))) AS detection_id, CAST(p_partkey % 50 AS VARCHAR(20)) AS doc_id, 'main' AS file_id, CAST(p_size AS INT) AS page_number, concat('f', CAST(p_partkey AS VARCHAR(20))) AS parent_figure_id, 'x.png' AS image_path, CASE WHEN p_partkey % 4 = 0 THEN 'OLD' ELSE ' ' END AS smiles, 0.25 AS confidence FROM {part} WHERE p_partkey % 2 = 0"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, _KNOWN).withColumns({"confidence": c("confidence").cast("double"), "bbox": F.lit(None).cast("array<double>")})


def _accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = _decided(spark, sf_dir).select("doc_id", "detection_id", "compound_id", c("final_smiles").alias("smiles"), F.lit("").alias("canonical_smiles"), "validation_status", "smiles_source", F.lit(None).cast("double").alias("agent_confidence"), "mapping_confidence", "mapping_evidence")
    return work.accepted(records, _known(spark, sf_dir))


@query(_DECIDED + " SELECT concat(detection_id, ':chemical_agent:', compound_id) AS evidence_id, compound_id AS caption, CAST(0.5 AS DOUBLE) AS confidence, concat('compound_id=', compound_id, ' | smiles=', final_smiles) AS text FROM d WHERE validation_status = 'accepted' AND p_partkey % 2 = 0")
def accepted_structures(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = work.structure_evidence(_accepted(spark, sf_dir))
    return found.select("evidence_id", "caption", "confidence", F.regexp_extract("text", r"(compound_id=\S+ \| smiles=\S+)", 1).alias("text"))


@query(_DECIDED + f" SELECT k.detection_id, CASE WHEN trim(k.smiles) = '' AND d.detection_id IS NOT NULL THEN d.final_smiles ELSE k.smiles END AS smiles, CASE WHEN trim(k.smiles) = '' AND d.detection_id IS NOT NULL THEN 0.5 ELSE 0.25 END AS confidence FROM ({_KNOWN}) k LEFT JOIN d ON d.detection_id = k.detection_id AND d.validation_status = 'accepted'", confidence="DOUBLE")
def filled_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work.filled_detections(_known(spark, sf_dir), _accepted(spark, sf_dir)).select("detection_id", "smiles", "confidence")


@query(f"SELECT detection_id FROM ({CROPS}) q WHERE provider = 'O' AND (smiles IS NULL OR trim(smiles) = '')")
def recognition_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.to_recognise(_crops(spark, sf_dir), provider="O").select("detection_id")


# What a recogniser answers for each crop, of which some are too small to be asked about.
_ANSWERS = f"""WITH d AS ({CROPS}), w AS (SELECT detection_id, CAST(l_quantity * 2 AS INT) AS width, 40 + CAST(l_linenumber AS INT) AS height, l_linenumber AS k, confidence FROM d),
a AS (SELECT *, CASE WHEN width < 32 THEN concat('crop is too small: ', CAST(width AS VARCHAR), 'x', CAST(height AS VARCHAR)) WHEN width * height < 2000 THEN concat('crop area is too small: ', CAST(width AS VARCHAR), 'x', CAST(height AS VARCHAR)) END AS crop_problem,
 CASE k WHEN 1 THEN '' WHEN 2 THEN 'null' WHEN 3 THEN 'C*C' WHEN 4 THEN 'C.C' ELSE 'CCO' END AS s FROM w)"""


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    crops = _crops(spark, sf_dir).withColumns({"width": (c("l_quantity") * 2).cast("int"), "height": F.lit(40) + c("l_linenumber").cast("int")})
    problem = visual.crop_problem(c("width"), c("height"))
    k = c("l_linenumber")
    smiles = F.when(k == 1, "").when(k == 2, " null").when(k == 3, "C*C").when(k == 4, "C.C").otherwise("CCO")
    asked = crops.select("doc_id", "detection_id", F.when(problem.isNull(), smiles).alias("smiles"), F.when(problem.isNull(), c("confidence")).alias("confidence"), problem.alias("problem"), F.when(problem.isNull(), "answered").otherwise("skipped").alias("outcome"))
    return recognition.judged(asked, least=0.3)


_OUTCOMES = _ANSWERS + """, p AS (SELECT *, CASE WHEN crop_problem IS NOT NULL THEN crop_problem WHEN k IN (1, 2) THEN 'no structure was read' WHEN confidence < 0.3 THEN 'confidence is below 0.3' WHEN k = 3 THEN 'the structure isn''t valid' END AS problem FROM a)"""


@query(_OUTCOMES + " SELECT detection_id, CASE WHEN problem IS NULL THEN 'completed' ELSE 'skipped' END AS outcome, problem, CASE WHEN crop_problem IS NOT NULL OR k IN (1, 2) THEN CASE WHEN crop_problem IS NULL AND confidence < 0.5 THEN 'low_confidence' ELSE '' END ELSE concat_ws(',', CASE WHEN confidence < 0.5 THEN 'low_confidence' END, CASE WHEN k = 3 THEN 'wildcard_or_r_group' END, CASE WHEN k = 4 THEN 'multiple_components_or_fragment' END) END AS flags FROM p")
def recognition_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _answers(spark, sf_dir).select("detection_id", "outcome", "problem", F.array_join("flags", ",").alias("flags"))


@query(_OUTCOMES + """ SELECT d.detection_id, CASE WHEN p.problem IS NULL THEN p.s ELSE d.smiles END AS smiles, CASE WHEN p.problem IS NULL THEN 'completed' ELSE 'skipped' END AS status, CASE WHEN d.l_linenumber % 2 = 0 THEN 'c' END AS caption FROM d JOIN p USING (detection_id)""")
def recognised_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = F.when(c("l_linenumber") % 2 == 0, F.lit('{"caption":"c","ocsr":"old"}')).otherwise(F.lit("not an object"))
    found = recognition.after_recognition(_crops(spark, sf_dir).withColumn("metadata", old), _answers(spark, sf_dir), "m")
    told = F.get_json_object(F.get_json_object("metadata", "$.ocsr"), "$.status")
    return found.select("detection_id", "smiles", told.alias("status"), F.get_json_object("metadata", "$.caption").alias("caption"))


@query(f"SELECT parent_figure_id AS figure_id, count(*) FILTER (trim(coalesce(smiles, '')) <> '') AS structures, CASE WHEN count(*) FILTER (trim(coalesce(smiles, '')) <> '') > 0 THEN 'completed' ELSE 'skipped' END AS status FROM ({CROPS}) q GROUP BY doc_id, 1")
def figure_recognition_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recognition.figure_states(_crops(spark, sf_dir)).select("figure_id", "structures", "status")


# Detection tasks of parts, the boxes found for them, and their figures' recognition tasks.
TASKS = """SELECT concat('f', CAST(p_partkey AS VARCHAR(20)), ':', k) AS task_id, CAST(p_partkey % 50 AS VARCHAR(20)) AS doc_id, 'main' AS file_id, CAST(p_size AS INT) AS page_number, CASE k WHEN 'd' THEN 'chemical_structure_detection' ELSE 'ocsr' END AS task_type, concat('f', CAST(p_partkey AS VARCHAR(20))) AS target_id, CAST(p_size % 3 AS INT) AS priority,
 CASE p_partkey % 5 WHEN 0 THEN 'running' ELSE 'pending' END AS status, CAST(p_partkey AS BIGINT) AS part FROM {part} CROSS JOIN (SELECT 'd' AS k UNION ALL SELECT 'o' AS k) z"""


@query(f"""WITH t AS ({TASKS}) SELECT task_id, CASE WHEN part % 5 = 0 THEN status WHEN task_type = 'ocsr' THEN CASE WHEN part % 3 = 0 THEN 'pending' ELSE 'skipped' END ELSE CASE WHEN part % 3 = 0 THEN 'completed' ELSE 'skipped' END END AS status FROM t""")
def detection_task_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    tasks = view(spark, sf_dir, TASKS)
    ran = recognition.tasks_of(tasks)
    boxes = ran.where("part % 3 = 0").select("task_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("box_index"), F.array(F.lit(0.0)).alias("bbox"), F.lit(0.7).alias("confidence"), F.lit("x.png").alias("image_path"))
    return recognition.after_detection(tasks, ran, recognition.detections_of(ran, boxes, "heuristic")).select("task_id", "status")


@query(f"""WITH t AS ({TASKS}) SELECT concat(target_id, ':det:', lpad(CAST(i + 1 AS VARCHAR), 3, '0'), ':image') AS evidence_id, concat('Chemical structure candidate from ', target_id, ' | crop: x', CAST(i AS VARCHAR), '.png | bbox: [0.0,', CAST(i AS VARCHAR), '.0] | caption: ', CASE WHEN part % 2 = 0 THEN 'even' ELSE '' END) AS text FROM t CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) z WHERE task_type <> 'ocsr' AND part % 5 <> 0 AND part % 3 = 0""")
def detection_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ran = recognition.tasks_of(view(spark, sf_dir, TASKS)).withColumn("caption", F.when(c("part") % 2 == 0, "even").otherwise(""))
    boxes = ran.where("part % 3 = 0").select("task_id", F.explode(F.sequence(F.lit(0), F.lit(1))).alias("box_index")).select("task_id", "box_index", F.array(F.lit(0.0), c("box_index").cast("double")).alias("bbox"), F.lit(0.7).alias("confidence"), F.concat(F.lit("x"), c("box_index").cast("string"), F.lit(".png")).alias("image_path"))
    return recognition.image_evidence(recognition.detections_of(ran, boxes, "heuristic")).select("evidence_id", "text")


@query(f"SELECT task_id FROM ({TASKS}) q WHERE task_type = 'ocsr' AND status = 'pending' ORDER BY priority DESC, page_number, task_id LIMIT 25")
def task_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the limit: the next tasks of a queue."""
    return route.queue(recognition.tasks_of(view(spark, sf_dir, TASKS), "ocsr"), 25).select("task_id")


@query(f"""WITH d AS (SELECT doc_id, count(*) AS detections, count(*) FILTER (trim(coalesce(smiles, '')) <> '') AS n FROM ({CROPS}) q GROUP BY 1), e AS (SELECT doc_id, count(*) FILTER (source_type = 'table_row' AND CAST(doc_id AS INT) % 2 = 0) AS n FROM ({AROUND}) q GROUP BY 1)
SELECT coalesce(d.doc_id, e.doc_id) AS doc_id, CASE WHEN coalesce(e.n, 0) > 0 THEN e.n ELSE coalesce(d.n, 0) END AS smiles, coalesce(d.detections, 0) AS detections FROM d FULL JOIN e ON e.doc_id = d.doc_id""")
def structure_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when((c("source_type") == "table_row") & (c("doc_id").cast("int") % 2 == 0), "chemical_structure_smiles").otherwise(c("source_type"))
    return recognition.structure_counts(view(spark, sf_dir, AROUND).withColumn("source_type", kind), _crops(spark, sf_dir))


IMAGES = "SELECT l_orderkey, l_linenumber, l_partkey, CAST(l_quantity AS INT) AS w, CAST(l_linenumber * 10 AS INT) AS h FROM {lineitem}"


@query(f"""SELECT w, h, CASE WHEN w < 32 OR h < 32 THEN concat('crop is too small: ', CAST(w AS VARCHAR), 'x', CAST(h AS VARCHAR)) WHEN w * h < 2000 THEN concat('crop area is too small: ', CAST(w AS VARCHAR), 'x', CAST(h AS VARCHAR)) END AS problem, CASE WHEN w * h > 1000 THEN 0.55 WHEN w * h > 200 THEN 0.72 ELSE 0.62 END AS confidence, count(*) AS n FROM ({IMAGES}) q GROUP BY 1, 2""", confidence="DOUBLE")
def crop_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = view(spark, sf_dir, IMAGES).groupBy("w", "h").agg(F.count("*").alias("n"))
    return sizes.select("w", "h", visual.crop_problem(c("w"), c("h")).alias("problem"), visual.box_confidence(c("w") * c("h"), F.lit(2500)).alias("confidence"), "n")


# Images drawn from supplier keys: two black blocks, near enough to be one or not.
def _draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        for at in range(0, len(pdf), 64):  # a batch of keys is some kilobytes, its images a gigabyte
            out = []
            for r in pdf.iloc[at : at + 64].itertuples():
                gap = int(r.s_nationkey) * 4 + 16  # boxes have a margin of 8 on either side
                rgb = np.full((120, 300, 3), 255, np.uint8)
                rgb[36:84, 36:76] = 0
                rgb[36:84, 76 + gap : 116 + gap] = 0
                out.append((str(r.s_suppkey), 300, 120, rgb.tobytes()))
            yield pd.DataFrame(out, columns=["task_id", "width", "height", "pixels"])


@query("SELECT CAST(s_suppkey AS VARCHAR) AS task_id, CASE WHEN s_nationkey * 4 + 1 <= 28 THEN 1 ELSE 2 END AS boxes, CASE WHEN s_nationkey * 4 + 1 <= 28 THEN 111 + s_nationkey * 4 ELSE 55 END AS first_width FROM supplier", boxes="BIGINT", first_width="INTEGER")
def connected_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = view(spark, sf_dir, "SELECT s_suppkey, s_nationkey FROM {supplier}").repartition(spark.sparkContext.defaultParallelism, "s_suppkey")  # few bytes, much work
    images = keys.mapInPandas(_draw, "task_id string, width int, height int, pixels binary")
    found = visual.detect(images)
    width = (F.get("bbox", F.lit(2)) - F.get("bbox", F.lit(0))).cast("int")
    return found.groupBy("task_id").agg(F.count("*").alias("boxes"), F.min_by(width, "box_index").alias("first_width"))


# The store: written, updated, cleared, and read again.
BLOCKS = "SELECT concat('e', CAST(o_orderkey AS VARCHAR(20))) AS evidence_id, CAST(o_custkey AS VARCHAR(20)) AS doc_id, CASE o_orderstatus WHEN 'F' THEN 'table_row' WHEN 'P' THEN NULL ELSE 'agent_compound_link' END AS source_type, o_orderpriority AS text, o_orderkey FROM {orders}"


def _store(spark: SparkSession, sf_dir: str) -> tuple[EvidenceStore, DataFrame]:
    store = EvidenceStore(spark, f"{scratch(spark)}/store", buckets=16)
    blocks = view(spark, sf_dir, BLOCKS)
    store.write("evidence_blocks", blocks)
    return store, blocks


@query(f"SELECT evidence_id, doc_id, CASE WHEN o_orderkey % 3 = 0 THEN 'new' ELSE text END AS text FROM ({BLOCKS}) q UNION ALL SELECT concat('added', doc_id), doc_id, 'new' FROM (SELECT DISTINCT doc_id FROM ({BLOCKS}) z WHERE o_orderkey % 3 = 0) y")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, blocks = _store(spark, sf_dir)
    changed = blocks.where("o_orderkey % 3 = 0").select("evidence_id", "doc_id", F.lit("new").alias("text"))
    added = changed.select("doc_id").distinct().select(F.concat(F.lit("added"), "doc_id").alias("evidence_id"), "doc_id", F.lit("new").alias("text"))
    store.upsert("evidence_blocks", changed.union(added), "evidence_id")
    return store.read("evidence_blocks").select("evidence_id", "doc_id", "text")


@query(f"SELECT doc_id, source_type, count(*) AS n FROM ({BLOCKS}) q WHERE NOT (CAST(doc_id AS INT) % 2 = 0 AND coalesce(source_type, '') = 'agent_compound_link') GROUP BY 1, 2")
def store_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, blocks = _store(spark, sf_dir)
    store.clear("evidence_blocks", blocks.where("CAST(doc_id AS INT) % 2 = 0"), source_type="agent_compound_link")
    return store.counts(blocks)


@query(f"""WITH b AS ({BLOCKS}) SELECT evidence_id, doc_id FROM b WHERE CAST(doc_id AS INT) % 3 <> 0 UNION ALL SELECT concat('again', doc_id), doc_id FROM (SELECT DISTINCT doc_id FROM b WHERE CAST(doc_id AS INT) % 6 = 0) z""")
def store_rescrape(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are scraped again, some of which have become empty."""
    store, blocks = _store(spark, sf_dir)
    docs = blocks.where("CAST(doc_id AS INT) % 3 = 0").select("doc_id").distinct()
    again = docs.where("CAST(doc_id AS INT) % 6 = 0").select(F.concat(F.lit("again"), "doc_id").alias("evidence_id"), "doc_id")
    store.put_document({"evidence_blocks": again}, docs)
    return store.read("evidence_blocks").select("evidence_id", "doc_id")


@query(f"WITH b AS ({BLOCKS}) SELECT 'evidence_blocks' AS table_name, count(*) AS n FROM b UNION ALL SELECT 'figures', 0 UNION ALL SELECT 'table_rows', count(*) FROM b WHERE source_type = 'table_row'")
def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    store, blocks = _store(spark, sf_dir)
    rows = blocks.select(F.concat("evidence_id", F.when(c("source_type") == "table_row", "").otherwise("x")).alias("evidence_id"), "doc_id", c("evidence_id").alias("row_id"))
    store.write("table_rows", store.attach_rows(rows, store.read("evidence_blocks")).where("evidence_id not like '%x'"))
    return store.table_counts("evidence_blocks", "figures", "table_rows")


@query(f"""WITH b AS ({BLOCKS}), v AS (SELECT 1 AS version, source_type FROM b UNION ALL SELECT 2, source_type FROM b WHERE CAST(doc_id AS INT) % 2 <> 0 OR coalesce(source_type, '') <> 'table_row'
 UNION ALL SELECT 3, source_type FROM b WHERE (CAST(doc_id AS INT) % 2 <> 0 OR coalesce(source_type, '') <> 'table_row') AND CAST(doc_id AS INT) % 3 <> 0) SELECT version, source_type, count(*) AS n FROM v GROUP BY 1, 2""")
def store_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the store held after each of three changes, read after all of them."""
    store, blocks = _store(spark, sf_dir)
    store.clear("evidence_blocks", blocks.where("CAST(doc_id AS INT) % 2 = 0"), source_type="table_row")
    store.reset(blocks.where("CAST(doc_id AS INT) % 3 = 0"))
    of = lambda v: store.at(v).read("evidence_blocks").groupBy("source_type").agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "source_type", "n")
    return of(1).union(of(2)).union(of(3))

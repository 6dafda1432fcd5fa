"""The state of visual tasks: what is detected and recognised, what it does to detections, evidence
and tasks. A detector or recogniser is an adapter (visual.detect, adapters); here its answers meet
the tables. Every function gives the new rows of a table; EvidenceStore writes them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corundum.functions.values import strip
from corundum.operators.visual import clean_smiles, crop_problem, quality_flags, validity
from corundum.operators.work import has_smiles
from corundum.schemas import shaped

#: States of tasks that a detector takes up (again).
OPEN = ("pending", "skipped", "completed")
BATCH = 8

c = F.col


def tasks_of(tasks: DataFrame, kind: str = "chemical_structure_detection") -> DataFrame:
    return tasks.where((c("task_type") == kind) & c("status").isin(*OPEN))


def detections_of(tasks: DataFrame, boxes: DataFrame, provider: str) -> DataFrame:
    """structure_detections of boxes (task_id, box_index, bbox, confidence, image_path) that a detector
    found for tasks (with figure caption as caption)."""
    d = tasks.select("task_id", "doc_id", "file_id", "page_number", "target_id", *(["caption"] if "caption" in tasks.columns else [F.lit("").alias("caption")])).join(boxes, "task_id")
    out = d.withColumns({
        "detection_id": F.concat("target_id", F.lit(":det:"), F.format_string("%03d", c("box_index") + 1)), "parent_figure_id": c("target_id"), "provider": F.lit(provider),
        "metadata": F.to_json(F.struct("caption")),
    })
    return shaped("structure_detections", out)


def image_evidence(detections: DataFrame) -> DataFrame:
    """An evidence block for each crop."""
    caption = F.coalesce(F.get_json_object("metadata", "$.caption"), F.lit(""))
    box = F.when(c("bbox").isNotNull(), F.concat(F.lit("bbox: "), F.to_json("bbox")))
    text = F.concat_ws(" | ", F.concat(F.lit("Chemical structure candidate from "), "parent_figure_id"), F.concat(F.lit("crop: "), F.coalesce("image_path", F.lit(""))), box, F.concat(F.lit("caption: "), caption))
    out = detections.withColumns({"evidence_id": F.concat("detection_id", F.lit(":image")), "source_type": F.lit("chemical_structure_image"), "title": c("parent_figure_id"), "caption": caption, "text": text, "parser": c("provider")})
    return shaped("evidence_blocks", out)


def without_earlier(detections: DataFrame, evidence: DataFrame, tasks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """detections and evidence without what earlier runs of these tasks left."""
    ids = tasks.select("doc_id", "task_id").distinct()
    gone = detections.join(ids, ["doc_id", "task_id"], "left_semi").select("doc_id", F.concat("detection_id", F.lit(":image")).alias("evidence_id"))
    return detections.join(ids, ["doc_id", "task_id"], "left_anti"), evidence.join(gone, ["doc_id", "evidence_id"], "left_anti")


def after_detection(tasks: DataFrame, ran: DataFrame, detections: DataFrame) -> DataFrame:
    """tasks with new states: of those that ran, completed if anything was detected, else skipped;
    their figure's recognition task is pending or skipped."""
    found = detections.groupBy("doc_id", "task_id").agg(F.count("*").alias("n"))
    done = ran.select("doc_id", "task_id", "target_id").join(found, ["doc_id", "task_id"], "left").withColumn("any", F.coalesce(c("n") > 0, F.lit(False)))
    own = done.select("doc_id", "task_id", F.when(c("any"), "completed").otherwise("skipped").alias("own"))
    sibling = done.groupBy("doc_id", "target_id").agg(F.max("any").alias("any")).select("doc_id", "target_id", F.when(c("any"), "pending").otherwise("skipped").alias("sibling"))
    out = tasks.join(own, ["doc_id", "task_id"], "left").join(sibling, ["doc_id", "target_id"], "left")
    state = F.coalesce(F.when(c("task_type") == "ocsr", c("sibling")), c("own"), c("status"))
    return out.withColumn("status", state).select(*tasks.columns)


def to_recognise(detections: DataFrame, *, provider: str | None = None, rerun: bool = False) -> DataFrame:
    """Crops with an image and, unless it is a rerun, without a structure; of one detector if given."""
    out = detections.where("image_path is not null")
    if provider:
        out = out.where(c("provider") == provider)
    return out if rerun else out.where(~has_smiles(c("smiles")))


def recognise(crops: DataFrame, factory: Callable[[], Callable[[list[bytes]], list[dict]]], *, batch: int = BATCH) -> DataFrame:
    """doc_id, detection_id, smiles, confidence, problem of crops (doc_id, detection_id, width, height,
    content). The recogniser is made once in each worker and asked for batch images at a time; a
    batch that fails gives its error to each of its crops."""
    usable = crops.withColumn("problem", crop_problem(c("width"), c("height")))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = factory()
        for pdf in batches:
            out: list[tuple] = []
            good = pdf[pdf["problem"].isna()]
            out += [(r.doc_id, r.detection_id, None, None, r.problem, "skipped") for r in pdf[pdf["problem"].notna()].itertuples()]
            for at in range(0, len(good), batch):
                part = list(good.iloc[at : at + batch].itertuples())
                try:
                    answers = ask([bytes(r.content) for r in part])
                    out += [(r.doc_id, r.detection_id, a.get("smiles"), a.get("confidence"), None, "answered") for r, a in zip(part, answers)]
                except Exception as e:  # a batch that fails mustn't stop the others
                    out += [(r.doc_id, r.detection_id, None, None, str(e)[:1000], "failed") for r in part]
            yield pd.DataFrame(out, columns=["doc_id", "detection_id", "smiles", "confidence", "problem", "outcome"])

    return usable.select("doc_id", "detection_id", "problem", "content").mapInPandas(run, "doc_id string, detection_id string, smiles string, confidence double, problem string, outcome string")


def judged(answers: DataFrame, *, least: float = 0.0, checked: Column | None = None) -> DataFrame:
    """answers with clean_smiles, flags and outcome: completed if a structure was read, is sure enough
    and isn't invalid, else skipped with its problem; failed stays failed."""
    a = answers.withColumn("clean_smiles", clean_smiles(c("smiles")))
    unsure = F.coalesce(c("confidence") < least, F.lit(False))
    problem = F.when(c("outcome") != "answered", c("problem")).when(c("clean_smiles") == "", "no structure was read").when(unsure, F.concat(F.lit("confidence is below "), F.lit(str(least)))).when(validity(c("clean_smiles"), checked) == "invalid", "the structure isn't valid")
    outcome = F.when(c("outcome") == "failed", "failed").when(problem.isNotNull(), "skipped").otherwise("completed")
    return a.withColumns({"problem": problem, "outcome": outcome, "flags": quality_flags(c("clean_smiles"), c("confidence"))})


def with_outcome(metadata: Column, provider: Column, status: Column, output: Column) -> Column:
    """Metadata (a JSON object, or anything else for none) with an entry on the recognition."""
    old = F.from_json(F.when(F.startswith(strip(F.coalesce(metadata, F.lit(""))), F.lit("{")), metadata), "map<string,string>")
    bare = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: k != "ocsr")
    entry = F.to_json(F.struct(provider.alias("provider"), status.alias("status"), output.alias("output")))
    return F.to_json(F.map_concat(bare, F.create_map(F.lit("ocsr"), entry)))


def after_recognition(detections: DataFrame, outcomes: DataFrame, provider: str) -> DataFrame:
    """detections with the structures of judged() answers and what came of each in their metadata."""
    o = outcomes.select("doc_id", "detection_id", c("clean_smiles"), c("confidence").alias("sure"), "problem", "outcome", "flags")
    out = detections.join(o, ["doc_id", "detection_id"], "left")
    good = c("outcome") == "completed"
    told = F.struct(F.when(good, c("flags")).alias("quality_flags"), "problem")
    return out.withColumns({
        "smiles": F.when(good, c("clean_smiles")).otherwise(c("smiles")), "confidence": F.when(good, F.coalesce("sure", "confidence")).otherwise(c("confidence")),
        "metadata": F.when(c("outcome").isNotNull(), with_outcome(c("metadata"), F.lit(provider), c("outcome"), told)).otherwise(c("metadata")),
    }).select(*detections.columns)


def smiles_evidence(detections: DataFrame, outcomes: DataFrame, provider: str) -> DataFrame:
    """An evidence block for each structure that was read."""
    o = outcomes.where("outcome = 'completed'").select("doc_id", "detection_id", c("clean_smiles"), c("confidence").alias("sure"))
    d = detections.join(o, ["doc_id", "detection_id"])
    caption = F.coalesce(F.get_json_object("metadata", "$.caption"), F.lit(""))
    text = F.concat_ws(" | ", F.concat(F.lit("Chemical structure SMILES: "), "clean_smiles"), F.concat(F.lit("crop: "), "image_path"), F.concat(F.lit("parent figure: "), F.coalesce("parent_figure_id", F.lit(""))), F.concat(F.lit("caption: "), caption))
    out = d.withColumns({"evidence_id": F.concat("detection_id", F.lit(":smiles")), "source_type": F.lit("chemical_structure_smiles"), "title": c("parent_figure_id"), "caption": caption, "text": text, "metadata": F.to_json(F.struct("detection_id", "task_id", "image_path")), "parser": F.lit(provider), "confidence": c("sure")})
    return shaped("evidence_blocks", out)


def figure_states(detections: DataFrame) -> DataFrame:
    """doc_id, figure_id, structures, status of recognition: completed if any structure was read."""
    n = F.count_if(has_smiles(c("smiles")))
    return detections.groupBy("doc_id", c("parent_figure_id").alias("figure_id")).agg(n.alias("structures")).withColumn("status", F.when(c("structures") > 0, "completed").otherwise("skipped"))


def recognition_tasks(tasks: DataFrame, detections: DataFrame) -> DataFrame:
    """tasks with the states of their figures' recognition."""
    s = figure_states(detections).select("doc_id", c("figure_id").alias("target_id"), c("status").alias("new"))
    state = F.when((c("task_type") == "ocsr") & c("new").isNotNull(), c("new")).otherwise(c("status"))
    return tasks.join(s, ["doc_id", "target_id"], "left").withColumn("status", state).select(*tasks.columns)


def structure_counts(evidence: DataFrame, detections: DataFrame) -> DataFrame:
    """doc_id, smiles, detections: structures told by evidence, by detections where there is no such
    evidence; never both, which would count each twice."""
    e = evidence.groupBy("doc_id").agg(F.count_if(c("source_type") == "chemical_structure_smiles").alias("e"))
    d = detections.groupBy("doc_id").agg(F.count_if(has_smiles(c("smiles"))).alias("d"), F.count("*").alias("detections"))
    both = e.join(d, "doc_id", "full").na.fill(0, ["e", "d", "detections"])
    return both.select("doc_id", F.when(c("e") > 0, c("e")).otherwise(c("d")).alias("smiles"), "detections")

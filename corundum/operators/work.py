"""What image models are asked about: figures with their crops and neighbours, then each compound
that a figure's analysis maps to a crop; and what comes back, as evidence."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corundum.functions.core import once
from corundum.functions.text import compact, slug
from corundum.functions.values import strip
from corundum.operators.visual import accept, clean_smiles, validity
from corundum.schemas import MISSING, shaped
from corundum.sources.adapters import Client, complete, json_payload
from corundum.sources.answers import Answers
from corundum.sources.folders import scratch, settled

#: Evidence that is shown beside a figure, and the order of its kinds.
NEARBY = ("paragraph", "table_caption", "table_row", "figure_caption")
MOST_NEARBY, NEARBY_CHARS, PAGE_CHARS, MOST_CROPS = 12, 900, 2500, 12
#: A figure's analysis, as the model is asked to give it.
ANALYSIS = """summary string, mappings array<struct<compound_id:string,crop_label:string,confidence:double,evidence:string>>,
 scaffolds array<struct<crop_label:string,variable_sites:array<string>,compound_range:array<string>,requires_substituent_resolution:boolean>>, warnings array<string>"""
#: Columns of the exported recognitions, in order.
OCR_COLUMNS = (
    "compound_id", "figure_id", "page_number", "detection_id", "smiles", "canonical_smiles", "smiles_source", "validation_status", "validation_error",
    "mapping_confidence", "agent_confidence", "molscribe_confidence",
)

c = F.col


def has_smiles(x: Column) -> Column:
    return F.coalesce(strip(x) != "", F.lit(False))


def figure_crops(detections: DataFrame, most: int = MOST_CROPS) -> DataFrame:
    """doc_id, figure_id, crops: the first crops of each figure, those with a structure before
    others."""
    first = Window.partitionBy("doc_id", "parent_figure_id").orderBy(F.when(has_smiles(c("smiles")), 0).otherwise(1), "detection_id")
    crops = detections.where("parent_figure_id is not null").withColumn("nth", F.row_number().over(first)).where(c("nth") <= most)
    crop = F.struct("nth", F.concat(F.lit("crop:"), "detection_id").alias("crop_label"), "detection_id", "image_path", "bbox", c("smiles").alias("recognised_smiles"), c("confidence").alias("recognised_confidence"))
    listed = F.transform(F.array_sort(F.collect_list(crop)), lambda x: x.dropFields("nth"))  # most of them at most
    return crops.groupBy("doc_id", c("parent_figure_id").alias("figure_id")).agg(listed.alias("crops"))


def nearby_evidence(figures: DataFrame, evidence: DataFrame, most: int = MOST_NEARBY) -> DataFrame:
    """doc_id, page_number, nearby: evidence that figures of a page are shown beside: of their own page
    first, then of those beside it, table rows before paragraphs before the rest. A page gives its
    first ones only, as no figure is shown more, and all figures of a page have one list. Pages are
    exploded to those they reach, so the join is on equal keys."""
    page = c("page_number")
    kind = F.when(c("source_type") == "table_row", 0).when(c("source_type") == "paragraph", 1).otherwise(2)
    own = Window.partitionBy("doc_id", "page_number").orderBy("kind", "evidence_id")
    told = evidence.where(c("source_type").isin(*NEARBY)).select("doc_id", "page_number", "evidence_id", "source_type", "text", kind.alias("kind"))
    told = told.withColumn("of_page", F.row_number().over(own)).where(c("of_page") <= most)
    reach = figures.select("doc_id", page.alias("own_page")).distinct().select("doc_id", "own_page", F.explode(F.sequence(F.greatest(c("own_page") - 1, F.lit(1)), F.greatest(c("own_page") + 1, F.lit(1)))).alias("page_number"))
    order = Window.partitionBy("doc_id", "own_page").orderBy(F.when(page == c("own_page"), 0).otherwise(1), "kind", "evidence_id")
    first = reach.join(told, ["doc_id", "page_number"]).withColumn("nth", F.row_number().over(order)).where(c("nth") <= most)
    item = F.struct("nth", "evidence_id", "page_number", "source_type", F.left(compact(c("text")), F.lit(NEARBY_CHARS)).alias("text"))
    listed = F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("nth"))  # most of them at most
    return first.groupBy("doc_id", c("own_page").alias("page_number")).agg(listed.alias("nearby"))


def figure_items(figures: DataFrame, pages: DataFrame, detections: DataFrame, evidence: DataFrame, *, most_crops: int = MOST_CROPS) -> DataFrame:
    """A row for each figure with any detection: its page's text, crops and nearby evidence. Figures
    without a crop go before anything is joined to them; detections are read once."""
    f = figures.join(figure_crops(detections, most_crops), ["doc_id", "figure_id"])
    page = pages.select("doc_id", "file_id", "page_number", F.left(compact(F.coalesce("text", F.lit(""))), F.lit(PAGE_CHARS)).alias("page_text"))
    near = nearby_evidence(figures, evidence).select(c("doc_id").alias("of_doc"), c("page_number").alias("of_page"), "nearby")
    out = f.join(page, ["doc_id", "file_id", "page_number"], "left")
    out = out.join(near, (c("doc_id") == c("of_doc")) & c("page_number").eqNullSafe(c("of_page")), "left")  # figures without a page have a list too
    return out.select("doc_id", "figure_id", "page_number", "label", F.coalesce("caption", F.lit("")).alias("caption"), "image_path", "kind", F.coalesce("page_text", F.lit("")).alias("page_text"), "nearby", "crops")


def figure_requests(items: DataFrame, instructions: str) -> DataFrame:
    """request_id, system, prompt of figure items, as adapters.complete takes them; the images, that
    of the figure and of its crops, are named in order."""
    crops = F.transform("crops", lambda x: F.struct(x["crop_label"].alias("crop_label"), x["bbox"].alias("bbox"), x["recognised_smiles"].alias("recognised_smiles")))
    told = F.to_json(F.struct(c("figure_id").alias("image_id"), "page_number", "label", "caption", "page_text", "nearby", crops.alias("crops")))
    return items.select(F.concat_ws(":", "doc_id", "figure_id").alias("request_id"), F.lit(instructions).alias("system"), F.concat(F.lit("Analyse this figure. Answer with one JSON object.\n"), told).alias("prompt"), F.concat(F.array("image_path"), F.transform("crops", lambda x: x["image_path"])).alias("image_paths"))


def chemical_items(results: DataFrame) -> DataFrame:
    """A row for each compound and crop that a figure's analysis maps: the crop, the scaffold told of
    it, how sure the mapping is. results: doc_id, figure_id, page_number, caption, crops, analysis
    (JSON). Mappings of unknown crops or without a compound go; of repeated ones the first stays."""
    read = once(results.where("analysis is not null"), F.from_json("analysis", ANALYSIS), "a")
    item = read.select("doc_id", "figure_id", "page_number", "caption", "crops", "a", F.posexplode("a.mappings").alias("nth", "m"))
    item = once(item, F.struct(strip(c("m.crop_label")).alias("crop_label"), strip(c("m.compound_id")).alias("compound_id")), "key")
    crop = F.get(F.filter("crops", lambda x: x["crop_label"] == c("key.crop_label")), F.lit(0))
    scaffold = F.get(F.filter("a.scaffolds", lambda x: x["crop_label"] == c("key.crop_label")), F.lit(0))
    item = once(item, F.struct(crop.alias("crop"), scaffold.alias("scaffold")), "of").where("of.crop is not null and key.compound_id <> ''")
    item = item.select("*", "key.crop_label", "key.compound_id", "of.crop", "of.scaffold")
    first = Window.partitionBy("doc_id", "compound_id", "crop_label").orderBy("page_number", "figure_id", "nth")
    item = item.withColumn("seen", F.row_number().over(first)).where("seen = 1")
    return item.select(
        "doc_id", "figure_id", "page_number", F.coalesce("caption", F.lit("")).alias("caption"), "compound_id", "crop_label", c("crop.detection_id").alias("detection_id"), c("crop.image_path").alias("image_path"),
        c("crop.recognised_smiles").alias("recognised_smiles"), c("crop.recognised_confidence").alias("recognised_confidence"), c("m.confidence").alias("mapping_confidence"), c("m.evidence").alias("mapping_evidence"),
        c("scaffold.requires_substituent_resolution").alias("open_scaffold"), c("a.summary").alias("summary"), c("a.warnings").alias("warnings"),
    )


def decisions(records: DataFrame) -> DataFrame:
    """doc_id, accepted, needs_review, rejected: how many of each."""
    of = lambda s: F.count_if(c("validation_status") == s).alias(s)
    return records.groupBy("doc_id").agg(*map(of, ("accepted", "needs_review", "rejected")))


def ocr_table(records: DataFrame) -> DataFrame:
    """The columns that recognitions are exported with."""
    return records.select(*(c(n) if n in records.columns else F.lit(None).cast("string").alias(n) for n in OCR_COLUMNS))


def accepted(records: DataFrame, detections: DataFrame) -> DataFrame:
    """Accepted recognitions with a structure, each with its detection: what is imported. records:
    doc_id, detection_id, compound_id, smiles, canonical_smiles, validation_status, smiles_source,
    agent_confidence, mapping_confidence, mapping_evidence."""
    best = F.coalesce(F.nullif("canonical_smiles", F.lit("")), c("smiles"))
    good = once(records.where("validation_status = 'accepted'"), strip(best), "best_smiles").where((c("best_smiles") != "") & (c("best_smiles") != MISSING))
    d = detections.select("doc_id", "detection_id", "file_id", "page_number", "parent_figure_id", c("image_path").alias("crop_path"), "bbox", c("smiles").alias("known_smiles"))
    return good.join(d, ["doc_id", "detection_id"])


def structure_evidence(found: DataFrame) -> DataFrame:
    """Evidence blocks of accepted() rows; a later one of the same compound and crop takes the place
    of an earlier one."""
    compound = F.coalesce(F.nullif(strip("compound_id"), F.lit("")), F.lit("unknown"))
    f = found.withColumn("compound_id", compound)
    sure = F.coalesce(F.nullif(c("agent_confidence").try_cast("double"), F.lit(0.0)), c("mapping_confidence").try_cast("double"))
    parts = (("compound_id", "compound_id"), ("smiles", "smiles"), ("canonical_smiles", "best_smiles"), ("validation_status", "validation_status"), ("smiles_source", "smiles_source"), ("mapping_confidence", "mapping_confidence"), ("agent_confidence", "agent_confidence"), ("mapping_evidence", "mapping_evidence"))
    told = F.concat_ws(" | ", *(F.concat(F.lit(f"{k}="), F.coalesce(c(v).cast("string"), F.lit("None"))) for k, v in parts), F.concat(F.lit("parent figure: "), F.coalesce("parent_figure_id", F.lit("None"))), F.concat(F.lit("crop: "), F.coalesce("crop_path", F.lit("None"))))
    out = f.withColumns({
        "evidence_id": F.concat(c("detection_id"), F.lit(":chemical_agent:"), slug(c("compound_id"))), "source_type": F.lit("chemical_structure_smiles"), "title": c("parent_figure_id"), "caption": c("compound_id"),
        "text": F.concat(F.lit("Chemical agent SMILES: "), told), "metadata": F.to_json(F.struct(F.lit("chemical_ocr_agent").alias("source"), "compound_id")), "parser": F.lit("chemical_ocr_agent"), "confidence": sure,
    })
    one = Window.partitionBy("doc_id", "evidence_id").orderBy(F.desc_nulls_last("confidence"), "text")
    return shaped("evidence_blocks", out.withColumn("nth", F.row_number().over(one)).where("nth = 1"))


def filled_detections(detections: DataFrame, found: DataFrame) -> DataFrame:
    """Detections with an accepted structure where they had none; the surest of several."""
    sure = F.coalesce(F.nullif(c("agent_confidence").try_cast("double"), F.lit(0.0)), c("mapping_confidence").try_cast("double"))
    best = found.groupBy("doc_id", "detection_id").agg(F.max_by(F.struct(c("best_smiles").alias("s"), sure.alias("sure")), F.struct(sure, c("best_smiles"))).alias("new"))
    out = detections.join(best, ["doc_id", "detection_id"], "left")
    take = ~has_smiles(c("smiles")) & c("new").isNotNull()
    return out.withColumns({"smiles": F.when(take, c("new.s")).otherwise(c("smiles")), "confidence": F.when(take, F.coalesce("new.sure", "confidence")).otherwise(c("confidence"))}).drop("new").select(*detections.columns)


def _answered(rows: DataFrame, requests: Callable[[DataFrame], DataFrame], client: Client, images: DataFrame | None, kept: Answers | None = None) -> DataFrame:
    """rows (with request_id) with content and error of the client's answers to requests(rows). Rows are
    written first, as they are read twice, answers as they are asked once. images: path and content; a
    request's are given in the order of its image_paths."""
    folder = scratch(rows.sparkSession)
    rows = settled(rows, f"{folder}/rows")
    asked = requests(rows)
    if images is not None:
        one = asked.select("request_id", F.posexplode("image_paths").alias("nth", "path")).join(images.select("path", "content"), "path")
        listed = one.groupBy("request_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("nth", "content"))), lambda x: x["content"]).alias("images"))  # a figure's crops at most
        asked = asked.join(listed, "request_id", "left")
    else:
        asked = asked.withColumn("images", F.lit(None).cast("array<binary>"))
    asked = asked.select("request_id", "system", "prompt", "images")
    answers = settled(complete(asked, client), f"{folder}/answers") if kept is None else kept.ask(asked, client)
    return rows.join(answers, "request_id", "left")


def analyses(items: DataFrame, instructions: str, client: Client, *, images: DataFrame | None = None, kept: Answers | None = None) -> DataFrame:
    """figure_items() with analysis, the JSON object that the client gives of each (null if it gives
    none), and error."""
    rows = items.withColumn("request_id", F.concat_ws(":", "doc_id", "figure_id"))
    found = _answered(rows, lambda x: figure_requests(x, instructions), client, images, kept)
    return found.withColumn("analysis", F.to_json(json_payload(c("content")))).drop("request_id", "content")


def compound_requests(items: DataFrame, instructions: str) -> DataFrame:
    """request_id, system, prompt, image_paths of chemical_items()."""
    told = F.to_json(F.struct("compound_id", "crop_label", "caption", "recognised_smiles", "mapping_evidence", "open_scaffold", "summary"))
    return items.select(F.concat_ws(":", "doc_id", "detection_id", "compound_id").alias("request_id"), F.lit(instructions).alias("system"), F.concat(F.lit("Read this structure. Answer with one JSON object.\n"), told).alias("prompt"), F.array("image_path").alias("image_paths"))


def recognitions(items: DataFrame, instructions: str, client: Client, *, images: DataFrame | None = None, check: Callable[[Column], Column] | None = None, kept: Answers | None = None) -> DataFrame:
    """chemical_items() with the structure that the client reads, what a toolkit says of it (check;
    none: it isn't asked), and which is accepted."""
    rows = items.withColumn("request_id", F.concat_ws(":", "doc_id", "detection_id", "compound_id"))
    found = _answered(rows, lambda x: compound_requests(x, instructions), client, images, kept)
    v = json_payload(c("content"))
    read = F.struct(F.try_variant_get(v, "$.smiles", "string").alias("smiles"), F.try_variant_get(v, "$.confidence", "double").alias("sure"))
    found = once(found, read, "told")
    bare = F.struct(clean_smiles(c("told.smiles")).alias("model_smiles"), clean_smiles(c("recognised_smiles")).alias("recognised_smiles"))
    found = once(found, bare, "bare").drop("recognised_smiles").select("*", "bare.*")
    asked = check or (lambda _: F.lit(None).cast("boolean"))
    judged = F.struct(*(validity(c(s), asked(c(s))).alias(f"{s.removesuffix('_smiles')}_validity") for s in ("model_smiles", "recognised_smiles")))
    found = accept(once(found, judged, "judged").select("*", "judged.*"))
    unread = F.coalesce("error", F.when(c("validation_status") == "rejected", "no structure is valid"))
    out = found.withColumns({"smiles": c("final_smiles"), "canonical_smiles": c("final_smiles"), "agent_confidence": c("told.sure"), "molscribe_confidence": c("recognised_confidence"), "validation_error": unread})
    return out.drop("request_id", "content", "told", "bare", "judged")


def two_agents(items: DataFrame, client: Client, instructions: tuple[str, str], *, images: DataFrame | None = None, check: Callable[[Column], Column] | None = None, kept: Answers | None = None) -> DataFrame:
    """Recognised compounds of figures: each figure is analysed, each compound that it maps is read."""
    return recognitions(chemical_items(analyses(items, instructions[0], client, images=images, kept=kept)), instructions[1], client, images=images, check=check, kept=kept)

"""Visual tasks: which pages and figures need recognition, and how urgently."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corundum.functions.values import strip

# Caption words that call for a task, patterns of structures and compound ids.
DOCKING_WORDS = ("docking", "interaction", "interactions", "binding", "pose", "enzyme", "active site")
ACTIVITY_WORDS = ("inhibition", "activity", "mic", "zone", "antimicrobial", "antibacterial", "antifungal", "graph")
STRUCTURE_WORDS = ("synthesis", "structure", "structures", "hybrid", "hybrids", "derivatives")
SMILES = r"\b[A-Z][A-Za-z0-9@+\-\[\]\(\)=#$\\/]{8,}\b"
COMPOUND_ID = r"(?i)\b\d{1,3}[a-z]\b|\b\d{1,3}[a-z]-\d{1,3}[a-z]\b"
LITTLE_TEXT = 500

TASK = ["task_id", "doc_id", "file_id", "page_number", "task_type", "target_type", "target_id", "provider_hint", "priority", "reason"]


def holds_any(text: Column, words: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def _task(kind: str, target: str, key: Column, target_id: Column, provider: str, priority: Column, reason: Column) -> list[Column]:
    return [key.alias("task_id"), F.col("doc_id"), F.col("file_id"), F.col("page_number"), F.lit(kind).alias("task_type"), F.lit(target).alias("target_type"), target_id.alias("target_id"), F.lit(provider).alias("provider_hint"), priority.cast("int").alias("priority"), reason.alias("reason")]


def page_tasks(pages: DataFrame, tables: DataFrame) -> DataFrame:
    """Pages with little text, and pages that speak of a table where none was found."""
    c = F.col
    key = lambda what: F.format_string(f"%s:%s:p%04d:{what}", "doc_id", "file_id", "page_number")
    size = F.length(strip(c("text")))
    bare = pages.where(size < LITTLE_TEXT).select(*_task("document_ocr", "page", key("document_ocr"), c("page_id"), "surya_or_paddleocr", F.lit(90), F.format_string("The page has %d characters of text.", size)))
    lost = pages.where(F.contains(F.lower("text"), F.lit("table"))).join(tables.select("doc_id", "file_id", "page_number").distinct(), ["doc_id", "file_id", "page_number"], "left_anti")
    return bare.unionByName(lost.select(*_task("table_ocr", "page", key("table_ocr"), c("page_id"), "surya_table_or_paddle_structure", F.lit(75), F.lit("A table is spoken of, none was found."))))


def document_facts(pages: DataFrame, tables: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, table_rows, smiles_count, compound_ids: distinct structures in a document's text and
    distinct compound ids in first cells of its tables."""
    smiles = pages.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(SMILES), F.lit(0))).alias("s")).groupBy("doc_id").agg(F.countDistinct("s").alias("smiles_count"))
    first = F.get("cells", F.lit(0))
    ids = rows.select("doc_id", F.explode(F.regexp_extract_all(first, F.lit(COMPOUND_ID), F.lit(0))).alias("i")).groupBy("doc_id").agg(F.countDistinct(F.lower("i")).alias("compound_ids"))
    count = rows.groupBy("doc_id").agg(F.count("*").alias("table_rows"))
    docs = pages.select("doc_id").union(tables.select("doc_id")).distinct()
    return docs.join(count, "doc_id", "left").join(smiles, "doc_id", "left").join(ids, "doc_id", "left").na.fill(0, ["table_rows", "smiles_count", "compound_ids"])


def figure_tasks(figures: DataFrame, facts: DataFrame) -> DataFrame:
    """Detection and recognition of structures, description of plots, light recognition of labels:
    each figure makes its tasks as an array, which is exploded."""
    c = F.col
    low = F.lower(F.coalesce("caption", F.lit("")))
    depends = (c("compound_ids") > c("smiles_count")) | (c("smiles_count") == 0)
    scheme = c("kind") == "scheme"
    rich = scheme | holds_any(low, STRUCTURE_WORDS)
    boosted = depends | scheme
    task = lambda when, suffix, kind, provider, priority, reason: F.when(when, F.struct(F.lit(suffix).alias("suffix"), F.lit(kind).alias("kind"), F.lit(provider).alias("provider"), priority.cast("int").alias("priority"), F.lit(reason).alias("reason")))
    tasks = F.array_compact(F.array(
        task(rich, "structure_detection", "chemical_structure_detection", "structure_detector", F.when(boosted, 85).otherwise(55), "The caption speaks of structures; ids of text and tables may be told from them."),
        task(rich, "ocsr", "ocsr", "molscribe_or_decimer", F.when(boosted, 80).otherwise(50), "Structures that are found have to be read."),
        task(holds_any(low, DOCKING_WORDS + ACTIVITY_WORDS), "vlm_describe", "vlm_describe", "vlm", F.when(c("table_rows") > 0, 60).otherwise(80), "The caption names what only the image shows."),
        task((c("kind") == "figure") & rich & ~depends, "light_ocr", "image_text_ocr", "surya_or_paddleocr", F.lit(35), "Labels may stand in the figure, though text and tables tell most of it."),
    ))
    out = figures.join(facts, "doc_id", "left").na.fill(0, ["table_rows", "smiles_count", "compound_ids"]).select("*", F.explode(tasks).alias("t"))
    return out.select(F.concat("figure_id", F.lit(":"), "t.suffix").alias("task_id"), "doc_id", "file_id", "page_number", c("t.kind").alias("task_type"), F.lit("figure").alias("target_type"), c("figure_id").alias("target_id"), c("t.provider").alias("provider_hint"), c("t.priority").alias("priority"), c("t.reason").alias("reason"))


def best_tasks(tasks: DataFrame) -> DataFrame:
    """Of tasks with the same id the most urgent."""
    first = Window.partitionBy("doc_id", "task_id").orderBy(F.desc("priority"), "task_type", "reason")
    return tasks.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def route(pages: DataFrame, tables: DataFrame, rows: DataFrame, figures: DataFrame) -> DataFrame:
    tasks = page_tasks(pages, tables).unionByName(figure_tasks(figures, document_facts(pages, tables, rows)))
    return best_tasks(tasks)


def queue(tasks: DataFrame, limit: int) -> DataFrame:
    """The next tasks: most urgent first, by page and id."""
    return tasks.orderBy(F.desc("priority"), "page_number", "task_id").limit(limit)

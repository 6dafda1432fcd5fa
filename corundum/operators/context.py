"""Build the text that extraction reads: pages with their tables and evidence, windows of pages,
headings carried forward, what lies near a figure."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corundum.functions.core import present
from corundum.functions.text import markdown_table
from corundum.functions.values import strip

#: Evidence that extraction is shown.
CONTEXT_SOURCES = (
    "table_caption", "figure_caption", "figure_image", "scheme_image", "chemical_structure_image", "chemical_structure_smiles",
    "agent_table_measurement", "agent_compound_link", "agent_conflict_decision", "agent_scaffold_resolution",
)


def carry_forward(df: DataFrame, value: Column, into: str, by: list[str], order: list[str]) -> DataFrame:
    """The last value that isn't null, up to and including each row."""
    past = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(into, F.last(value, ignorenulls=True).over(past))


def table_markdown(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, table_id, page_number, markdown: label and caption above the table. A table's rows
    are gathered, which a page of paper bounds."""
    listed = rows.groupBy("doc_id", "table_id").agg(F.array_sort(F.collect_list(F.struct("row_index", "row_id", "cells"))).alias("r"))
    cells = F.transform(F.coalesce("r", F.array().cast("array<struct<row_index:int,row_id:string,cells:array<string>>>")), lambda x: x["cells"])
    body = markdown_table(F.coalesce("columns", F.array().cast("array<string>")), cells)
    label = F.coalesce("label", F.lit(""))
    dotted = F.when(label == "", label).otherwise(F.concat(F.regexp_replace(label, r"\.$", ""), F.lit(".")))
    head = F.array_join(present(dotted, F.col("caption")), " ")
    text = F.array_join(present(head, body), "\n\n")
    return tables.join(listed, ["doc_id", "table_id"], "left").select("doc_id", "table_id", "page_number", text.alias("markdown"))


def page_text(pages: DataFrame, evidence: DataFrame) -> DataFrame:
    """pages with context: their own text, then what was found on them."""
    c = F.col
    label = F.array_join(present(*(c(x) for x in ("source_type", "section", "title", "caption"))), " | ")
    line = F.when(label == "", strip(F.coalesce("text", F.lit("")))).otherwise(F.concat(label, F.lit(": "), strip(F.coalesce("text", F.lit("")))))
    chosen = evidence.where(c("source_type").isin(*CONTEXT_SOURCES) & c("page_number").isNotNull())
    found = chosen.groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("source_type", "evidence_id", line.alias("line")))).alias("found"))
    block = F.when(F.size("found") > 0, F.concat(F.lit("SCRAPER EVIDENCE\n"), F.array_join(F.transform("found", lambda x: x["line"]), "\n")))
    whole = F.when(c("found").isNull(), c("text")).otherwise(F.array_join(present(strip(c("text")), block), "\n\n"))
    return pages.join(found, ["doc_id", "page_number"], "left").withColumn("context", whole).drop("found")


def document(pages: DataFrame, tables: DataFrame, rows: DataFrame, evidence: DataFrame) -> DataFrame:
    """doc_id, page_number, context, tables, whole: a page's text with what was found on it, its
    tables in Markdown in order of their ids, and both together."""
    shown = table_markdown(tables, rows).groupBy("doc_id", "page_number").agg(F.array_sort(F.collect_list(F.struct("table_id", "markdown"))).alias("t"))
    out = page_text(pages, evidence).join(shown, ["doc_id", "page_number"], "left")
    listed = F.filter(F.transform(F.coalesce("t", F.array().cast("array<struct<table_id:string,markdown:string>>")), lambda x: x["markdown"]), lambda x: x != "")
    out = out.withColumn("tables", listed)
    return out.select("doc_id", "page_number", "context", "tables", _whole().alias("whole"))


def _whole() -> Column:
    """A page's number, its context and its tables, as a model reads them."""
    number = F.col("page_number").cast("string")
    titled = F.transform("tables", lambda x, i: F.concat(F.lit("TABLE "), number, F.lit("."), (i + 1).cast("string"), F.lit("\n"), x))
    return F.array_join(F.concat(present(F.concat(F.lit("PAGE "), number), strip(F.coalesce("context", F.lit("")))), titled), "\n\n")


def parsed_document(pages: DataFrame) -> DataFrame:
    """document() of pages as a parser gives them (adapters.parse_files), without a scrape: files that
    couldn't be read have none."""
    tables = F.filter(F.coalesce("tables", F.array().cast("array<string>")), lambda x: strip(x) != "")
    read = pages.where("error is null").select("doc_id", "page_number", F.col("text").alias("context"), tables.alias("tables"))
    return read.withColumn("whole", _whole())


def window_text(pages: DataFrame, size: int = 4) -> DataFrame:
    """doc_id, window (from 0), n_windows, text: pages of document() in windows of size."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number"))
    w = pages.select("doc_id", "page_number", "whole", F.floor((nth - 1) / size).alias("window"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "whole"))), lambda x: x["whole"]), "\n\n")
    out = w.groupBy("doc_id", "window").agg(text.alias("text"))  # size pages each
    count = out.groupBy("doc_id").agg(F.count("*").alias("n_windows"))
    return out.join(count, "doc_id")


def page_windows(pages: DataFrame, size: int = 4, *, by: str = "doc_id", order: str = "page_number") -> DataFrame:
    """by, window (from 0), first, last, pages: consecutive pages, size at a time."""
    nth = F.row_number().over(Window.partitionBy(by).orderBy(order))
    numbered = pages.select(by, order, F.floor((nth - 1) / size).alias("window"))
    return numbered.groupBy(by, "window").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("pages"))


def cut_context(c: Column, limit: int) -> Column:
    """The text cut at limit, at the last line break before it; nothing for a limit of 0."""
    if limit <= 0:
        return F.lit("")
    head = F.left(c, F.lit(limit))
    at_line = F.when(F.contains(head, F.lit("\n")), F.regexp_replace(head, r"(?s)\n[^\n]*\z", "")).otherwise(head)
    return F.when(F.length(c) <= limit, c).otherwise(F.concat(at_line, F.lit("\n[truncated]")))


def captioned(tables: DataFrame, captions: DataFrame) -> DataFrame:
    """The k-th table of a page with its k-th caption, the last one for those beyond."""
    on = ["doc_id", "page_number"]
    t = tables.withColumn("k", F.row_number().over(Window.partitionBy(*on).orderBy("table_id")))
    numbered = captions.withColumn("k", F.row_number().over(Window.partitionBy(*on).orderBy("evidence_id")))
    size = numbered.groupBy(*on).agg(F.max("k").alias("n"))
    nth = numbered.select(*on, "k", F.col("text").alias("caption_text"))
    return t.join(size, on, "left").withColumn("k", F.least("k", "n")).join(nth, [*on, "k"], "left").drop("n")


def near_pages(anchors: DataFrame, evidence: DataFrame, *, reach: int = 1, top: int = 12, rank: list[Column] | None = None) -> DataFrame:
    """For each anchor (anchor_id, doc_id, page_number) the top evidence at most reach pages away:
    anchors are exploded to the pages they reach, so that the join is on equal keys."""
    pages = F.explode(F.sequence(F.greatest(F.col("page_number") - reach, F.lit(1)), F.greatest(F.col("page_number") + reach, F.lit(1)))).alias("page_number")
    spread = anchors.select("anchor_id", "doc_id", F.col("page_number").alias("anchor_page"), pages)
    joined = spread.join(evidence, ["doc_id", "page_number"])
    order = rank or [F.abs(F.col("page_number") - F.col("anchor_page")), F.col("evidence_id")]
    nth = F.row_number().over(Window.partitionBy("doc_id", "anchor_id").orderBy(*order))
    return joined.withColumn("nth", nth).where(F.col("nth") <= top)


def nearest_distance(items: DataFrame, anchors: DataFrame, *, by: str, at: str) -> DataFrame:
    """items with distance, to the nearest anchor of the same key before or after; null without
    any. Both are put in one order and the nearest positions are carried from either side."""
    both = items.select(by, at, F.lit(1).alias("is_item"), F.struct(*items.columns).alias("item")).unionByName(anchors.select(by, at, F.lit(0).alias("is_item"), F.lit(None).cast(items.select(F.struct(*items.columns).alias("i")).schema["i"].dataType).alias("item")))
    place = F.when(F.col("is_item") == 0, F.col(at))
    up = Window.partitionBy(by).orderBy(F.asc(at), "is_item").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(by).orderBy(F.desc(at), "is_item").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("before", F.last(place, True).over(up)).withColumn("after", F.last(place, True).over(down)).where("is_item = 1")
    distance = F.least(F.col(at) - F.col("before"), F.col("after") - F.col(at))
    return found.select("item.*", distance.alias("distance"))

"""From a parser's blocks and spans to the evidence tables: text blocks, tables by layout with a
parser's own tables where a page has none, rows and figures as evidence, diagnostics.

blocks: doc_id, file_id, page_number, block_index, text, bbox, first_spans (spans in its first line).
spans: doc_id, file_id, page_number, block_index, span_id, text, x0, y0, x1, y1.
raw_tables: doc_id, file_id, page_number, table_index, raw (rows of cells), as a parser finds them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corundum.functions.core import let, once, present
from corundum.functions.text import caption, clean, compact, heading, row_text, slug
from corundum.functions.values import strip
from corundum.operators.context import carry_forward
from corundum.operators.layout import best_tables, cluster_lines, data_rows, figure_box, is_data_line, is_super_header, merge_spans
from corundum.schemas import shaped
from corundum.sources.folders import scratch, settled

PAGE = ["doc_id", "file_id", "page_number"]
REGION = [*PAGE, "caption_block"]
#: Characters that a block of text, a page's text and a paragraph of a table's page have at least.
LEAST_BLOCK, LEAST_PAGE, LEAST_BODY = 20, 50, 90
# How sure the parts of a scrape are, and the line that ends a manuscript's tables.
SURE = {"text": 0.75, "layout": 0.86, "raw": 0.7, "figure": 0.65}
END_OF_TABLES = "for peer review"

c = F.col


def _at(*parts: Column | str) -> Column:
    """doc:file:p0001 and further parts."""
    return F.concat_ws(":", "doc_id", "file_id", F.format_string("p%04d", "page_number"), *parts)


def text_evidence(blocks: DataFrame) -> DataFrame:
    """Blocks of text as evidence: short ones go, the section is carried on across pages, what
    stands as a caption or heading is told by kind, and ids number the blocks of a page."""
    kept = once(blocks, clean(c("text")), "cleaned").where(F.length("cleaned") >= LEAST_BLOCK)
    kept = once(kept, F.struct(heading(c("cleaned")).alias("title"), F.lower(caption(c("cleaned"))["kind"]).alias("kind")), "read")
    kept = carry_forward(kept, c("read.title"), "section", ["doc_id", "file_id"], ["page_number", "block_index"])
    nth = F.row_number().over(Window.partitionBy(*PAGE).orderBy("block_index"))
    source = F.when(c("read.kind") == "table", "table_caption").when(c("read.kind").isNotNull(), "figure_caption").when(c("read.title").isNotNull(), "section_heading").otherwise("paragraph")
    out = kept.select(
        *PAGE, "block_index", _at(F.lit("text"), F.format_string("%04d", nth)).alias("evidence_id"), source.alias("source_type"), "section", c("read.title").alias("title"),
        F.when(c("read.kind").isNotNull(), c("cleaned")).alias("caption"), c("cleaned").alias("text"), "bbox", F.lit("text_blocks").alias("parser"), F.lit(SURE["text"]).alias("confidence"),
    )
    return shaped("evidence_blocks", out)


def is_body_paragraph(text: Column, first_spans: Column) -> Column:
    """Running text: long, its first line of three spans at most, no caption."""
    return (F.length(text) >= LEAST_BODY) & (first_spans <= 3) & caption(text).isNull()


def blocks_with_data(spans: DataFrame) -> DataFrame:
    """The blocks (PAGE, block_index) that hold a line of table data by themselves."""
    by = [*PAGE, "block_index"]
    lines = merge_spans(cluster_lines(spans, PAGE, within="block_index"), by=[*by, "line"])
    cells = F.transform(F.array_sort(F.collect_list(F.struct("x0", "island", "text"))), lambda s: s["text"])
    return lines.groupBy(*by, "line").agg(cells.alias("cells")).where(is_data_line(c("cells"))).select(*by).distinct()


def caption_regions(blocks: DataFrame, with_data: DataFrame) -> DataFrame:
    """REGION, label, caption, block_index: the blocks after each caption of a table. A region ends
    before the next caption, before running text once it has data, and before a manuscript's last
    line. Of captions with one label on a page the first counts. A page's blocks meet its captions
    only, which a page bounds."""
    b = blocks.select(*PAGE, "block_index", "first_spans", clean(c("text")).alias("text"))
    b = b.withColumn("cap", caption(c("text")))
    caps = b.where(F.lower("cap.kind") == "table").select(*PAGE, c("block_index").alias("caption_block"), F.concat(F.lit("Table "), "cap.label").alias("label"), c("text").alias("caption"))
    data = with_data.select(*PAGE, "block_index", F.lit(True).alias("has_data"))
    after = b.join(data, [*PAGE, "block_index"], "left").join(caps, PAGE).where("block_index > caption_block")
    order = Window.partitionBy(*REGION).orderBy("block_index")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.contains(F.lower("text"), F.lit(END_OF_TABLES)) | (c("cap").isNotNull() & (F.row_number().over(order) > 1))
    ends = ends | (F.coalesce(F.max("has_data").over(before), F.lit(False)) & is_body_paragraph(c("text"), c("first_spans")))
    marked = after.withColumn("ends", ends.cast("int")).withColumn("ended", F.max("ends").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.where("ended = 0").select(*REGION, "label", "caption", "block_index")


def repaired(columns: Column) -> Column:
    """Column names of which one took its empty neighbour's organism along: it is given back."""
    stuck = " A. niger"
    taken = lambda i: F.coalesce(F.contains(F.get(columns, i), F.lit(stuck)) & F.startswith(F.get(columns, i + 1), F.lit("column_")), F.lit(False))
    return F.transform(columns, lambda x, i: F.when(taken(i), F.trim(F.replace(x, F.lit(stuck), F.lit("")))).when((i > 0) & taken(i - 1), F.lit(stuck.strip())).otherwise(x))


def layout_tables(blocks: DataFrame, spans: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tables and their rows, read from where spans stand: REGION lines to data rows, header spans to
    the nearest column of the first one. Regions and lines are read several times and cost a pass in
    Python, so they are written in between, and so is what comes out."""
    folder = scratch(spans.sparkSession)
    regions = settled(caption_regions(blocks, blocks_with_data(spans)), f"{folder}/regions")
    held = spans.join(regions, [*PAGE, "block_index"]).withColumn("span_id", F.concat_ws(":", F.format_string("%06d", "block_index"), "span_id"))
    about = regions.groupBy(*REGION).agg(F.min("label").alias("label"), F.min("caption").alias("caption"))
    merged = merge_spans(cluster_lines(held, REGION), by=[*REGION, "line"]).withColumn("text", compact(clean(c("text"))))
    listed = F.array_sort(F.collect_list(F.struct("x0", "island", "text")))
    lines = merged.groupBy(*REGION, "line").agg(listed.alias("s"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    lines = settled(lines.withColumn("cells", F.transform("s", lambda x: x["text"])), f"{folder}/lines")
    data = data_rows(lines, by=REGION)
    first = data.groupBy(*REGION).agg(F.min_by("s", "line").alias("columns_at"), F.min("line").alias("first_line"), F.max("line").alias("last_line"))
    heads = lines.join(first, REGION).where("line < first_line").select(*REGION, "line", "columns_at", F.explode("s").alias("h"))
    heads = heads.where((c("h.text") != "") & ~is_super_header(c("h.text")))
    distance = F.transform("columns_at", lambda x: F.abs(x["x0"] - c("h.x0")))
    named = heads.withColumn("column", (F.array_position(distance, F.array_min(distance)) - 1).cast("int"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("line", "h.x0", "h.text"))), lambda x: x["text"])
    named = named.groupBy(*REGION, "column").agg(F.array_join(parts, " ").alias("name"))
    names = named.groupBy(*REGION).agg(F.map_from_entries(F.collect_list(F.struct("column", "name"))).alias("names"))  # as many as the table has columns
    empty = lambda i: F.when(i == 0, F.lit("compound")).otherwise(F.concat(F.lit("column_"), (i + 1).cast("string")))
    columns = F.transform("columns_at", lambda _, i: F.coalesce(F.try_element_at("names", i), empty(i)))
    box = lines.join(first, REGION).where("line <= last_line").groupBy(*REGION).agg(F.array(F.min("x0"), F.min("y0"), F.max("x1"), F.max("y1")).alias("bbox"))
    table_id = _at(F.lit("layout_table"), slug(F.lower("label")))
    tables = first.join(names, REGION, "left").join(about, REGION).join(box, REGION).withColumn("columns", repaired(columns)).where(F.size("columns") >= 2)
    nth = F.row_number().over(Window.partitionBy(*PAGE, F.lower("label")).orderBy("caption_block"))
    tables = tables.withColumn("nth", nth).where("nth = 1").withColumns({"table_id": table_id, "parser": F.lit("layout"), "confidence": F.lit(SURE["layout"])})
    tables = settled(tables.select("caption_block", *(x for x in tables.columns if x in ("table_id", *PAGE, "label", "caption", "columns", "bbox", "parser", "confidence"))), f"{folder}/tables")
    row_index = F.row_number().over(Window.partitionBy(*REGION).orderBy("line"))
    rows = data.withColumn("row_index", row_index).join(tables.select(*REGION, "table_id"), REGION).select("doc_id", "table_id", "row_index", "cells")
    return shaped("tables", tables), settled(rows, f"{folder}/rows")


def raw_tables(raw: DataFrame, captions: DataFrame, layout: DataFrame) -> tuple[DataFrame, DataFrame]:
    """tables and rows of what a parser found on pages without a table by layout: cleaned, filled up
    to the widest row, empty rows dropped, the first row as the header; the k-th table of a page is
    told by its k-th caption, or by its last."""
    left = raw.join(layout.select(*PAGE).distinct(), PAGE, "left_anti")
    cells = F.transform(F.filter("raw", lambda r: r.isNotNull()), lambda r: F.transform(r, lambda x: compact(clean(F.coalesce(x, F.lit(""))))))
    width = lambda rows: F.coalesce(F.array_max(F.transform(rows, lambda r: F.size(r))), F.lit(0))
    full = let(cells, lambda rows: F.filter(F.transform(rows, lambda r: F.concat(r, F.array_repeat(F.lit(""), width(rows) - F.size(r)))), lambda r: F.exists(r, lambda x: x != "")))
    found = once(left, full, "rows").where(F.size("rows") >= 2)
    numbered = captions.where("source_type = 'table_caption'").select(*PAGE, F.row_number().over(Window.partitionBy(*PAGE).orderBy("evidence_id")).alias("k"), c("text").alias("caption"))
    most = numbered.groupBy(*PAGE).agg(F.max("k").alias("n"))
    found = found.join(most, PAGE, "left").withColumn("k", F.least("table_index", "n")).join(numbered, [*PAGE, "k"], "left")
    told = caption(c("caption"))
    label = F.coalesce(F.concat(F.initcap(told["kind"]), F.lit(" "), told["label"]), F.concat(F.lit("Table "), c("table_index").cast("string")))
    found = found.withColumns({"table_id": _at(F.lit("table"), F.format_string("%03d", "table_index")), "label": label, "columns": F.get("rows", F.lit(0)), "parser": F.lit("raw"), "confidence": F.lit(SURE["raw"])})
    rows = found.select("doc_id", "table_id", F.posexplode(F.slice("rows", 2, F.size("rows"))).alias("i", "cells")).select("doc_id", "table_id", (c("i") + 1).alias("row_index"), "cells")
    return shaped("tables", found), rows


def all_tables(by_layout: tuple[DataFrame, DataFrame], by_parser: tuple[DataFrame, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """Both kinds, of each page's tables with one label the fullest."""
    tables, rows = (a.unionByName(b) for a, b in zip(by_layout, by_parser))
    filled = F.size(F.filter("cells", lambda x: F.coalesce(x, F.lit("")) != ""))
    size = rows.groupBy("doc_id", "table_id").agg(F.count("*").cast("int").alias("n_rows"), F.sum(filled).alias("n_filled"))
    scored = tables.join(size, ["doc_id", "table_id"]).withColumns({"n_columns": F.size("columns"), "seq": F.concat(F.when(c("parser") == "layout", "0").otherwise("1"), c("table_id"))})
    scored = scored.withColumn("parser", F.when(c("parser") == "layout", "pymupdf_layout").otherwise(c("parser")))
    best = best_tables(scored).select("doc_id", "table_id")
    return tables.join(best, ["doc_id", "table_id"], "left_semi"), rows.join(best, ["doc_id", "table_id"], "left_semi")


def row_evidence(tables: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows as the store has them, and their evidence: label | caption | column: cell and so on."""
    t = tables.select(*PAGE, "table_id", "label", "caption", "columns", "bbox", "parser", "confidence")
    r = rows.join(t, ["doc_id", "table_id"]).withColumn("evidence_id", F.concat("table_id", F.lit(":row:"), F.format_string("%04d", "row_index")))
    r = r.withColumn("text", row_text(c("label"), c("caption"), c("columns"), c("cells")))
    blocks = r.withColumns({"source_type": F.lit("table_row"), "title": c("label"), "metadata": F.to_json(F.struct("table_id", "row_index"))})
    stored = r.withColumns({"row_id": c("evidence_id"), "normalized_text": c("text")})
    return shaped("table_rows", stored), shaped("evidence_blocks", blocks)


def figures(captions: DataFrame, pages: DataFrame, folder: str = "figures") -> DataFrame:
    """Figures above their captions: label, kind, box and where the image is to be put. Of captions
    with one label on a page the first counts; boxes that are too small are no figures."""
    told = caption(c("text"))
    f = captions.where("source_type = 'figure_caption'").withColumn("told", told)
    # Which word stands for which: the short form is written out.
    label = F.concat(F.replace(F.initcap("told.kind"), F.lit("Fig."), F.lit("Figure")), F.lit(" "), "told.label")
    f = f.withColumn("label", label).withColumn("kind", F.when(F.startswith(F.lower("label"), F.lit("scheme")), "scheme").otherwise("figure"))
    place = Window.partitionBy("doc_id", "file_id").orderBy("page_number", "evidence_id")
    f = f.withColumn("place", F.row_number().over(place)).withColumn("nth", F.row_number().over(Window.partitionBy(*PAGE, "kind", F.lower("label")).orderBy("evidence_id"))).where("nth = 1")
    f = f.join(pages.select(*PAGE, "width"), PAGE, "left")
    box = figure_box(F.get("bbox", F.lit(0)), F.get("bbox", F.lit(1)), F.get("bbox", F.lit(2)), c("width"))
    f = f.withColumn("bbox", box).where("bbox is not null")
    image = F.concat(F.lit(f"{folder}/"), F.format_string("%03d_p%04d_%s.png", "place", "page_number", slug(c("label"))))
    out = f.withColumns({"figure_id": _at("kind", slug(F.lower("label"))), "caption": c("text"), "image_path": image, "ocr_text": F.lit(""), "parser": F.lit("render"), "confidence": F.lit(SURE["figure"])})
    return shaped("figures", out)


def figure_evidence(found: DataFrame) -> DataFrame:
    text = F.array_join(present(F.coalesce(F.nullif("label", F.lit("")), c("kind")), c("caption"), F.concat(F.lit("image_path: "), "image_path"), F.when(strip("ocr_text") != "", F.concat(F.lit("ocr: "), strip("ocr_text")))), " | ")
    out = found.withColumns({"evidence_id": F.concat("figure_id", F.lit(":image")), "source_type": F.concat("kind", F.lit("_image")), "title": c("label"), "text": text, "metadata": F.to_json(F.struct("figure_id", "image_path"))})
    return shaped("evidence_blocks", out)


def diagnostics(pages: DataFrame, tables: DataFrame, rows: DataFrame, found: DataFrame, evidence: DataFrame) -> DataFrame:
    """doc_id, counts and notes: pages with hardly any text, no tables, tables without captions."""
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").cast("int").alias(name))
    bare = F.length(strip(F.coalesce("text", F.lit("")))) < LEAST_PAGE
    per = pages.groupBy("doc_id").agg(F.count("*").cast("int").alias("pages_count"), F.slice(F.array_sort(F.collect_list(F.when(bare, c("page_number")))), 1, 20).alias("bare"))
    captions = evidence.where("source_type = 'table_caption'").groupBy("doc_id").agg(F.count("*").alias("captions"))
    parts = [count(evidence, "evidence_count"), count(tables, "tables_count"), count(rows, "table_rows_count"), count(found, "figures_count"), captions]
    whole = reduce(lambda a, b: a.join(b, "doc_id", "left"), parts, per).na.fill(0)
    notes = F.array_compact(F.array(
        F.when(F.size("bare") > 0, F.concat(F.lit("hardly any text on pages "), F.array_join(F.transform("bare", lambda x: x.cast("string")), ", "))),
        F.when(c("tables_count") == 0, "no tables"),
        F.when((c("tables_count") > 0) & (c("captions") == 0), "tables without captions"),
    ))
    return shaped("diagnostics", whole.withColumn("notes", notes))


def scrape(pages: DataFrame, blocks: DataFrame, spans: DataFrame, raw: DataFrame) -> dict[str, DataFrame]:
    """All evidence tables of any number of documents."""
    text = text_evidence(blocks)
    by_layout = layout_tables(blocks, spans)
    tables, cells = all_tables(by_layout, raw_tables(raw, text, by_layout[0]))
    rows, of_rows = row_evidence(tables, cells)
    shown = figures(text, pages)
    evidence = text.unionByName(of_rows).unionByName(figure_evidence(shown))
    return {"pages": shaped("pages", pages), "evidence_blocks": evidence, "tables": tables, "table_rows": rows, "figures": shown, "diagnostics": diagnostics(pages, tables, rows, shown, evidence)}

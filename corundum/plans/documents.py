"""Queries from blocks to evidence tables, contexts and records, each with its SQL. Suppliers' pages
hold a laid-out table each, events are blocks of text, conversations are documents of pages."""

from __future__ import annotations

import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corundum.functions import text
from corundum.functions.core import let
from corundum.operators import context, extract, layout, scrape
from corundum.plans.base import query, view
from corundum.schemas import DOMAINS

c = F.col

# Blocks of text: captions of tables and figures, headings, what is too short, and paragraphs.
BLOCKS = """SELECT CAST(user_id AS VARCHAR(20)) AS doc_id, 'main' AS file_id, CAST(1 + floor(event_id / 400) AS INT) AS page_number, CAST(event_id AS INT) AS block_index,
 CASE event_id % 7 WHEN 0 THEN concat('Table ', CAST(1 + event_id % 5 AS VARCHAR(20)), '. Values of the compounds') WHEN 1 THEN concat('Discussion of the ', event_type) WHEN 2 THEN concat('Fig. ', CAST(event_id % 50 AS VARCHAR(20)), '. Activity of the samples')
 WHEN 3 THEN 'short' ELSE concat('A paragraph  of text with the number ', CAST(event_id AS VARCHAR(20)), ' in it.') END AS text, CAST(event_id % 90 AS DOUBLE) AS x0, CAST(event_id % 700 AS DOUBLE) AS y0 FROM {events}"""
_TEXT = f"""WITH b AS (SELECT *, block_index % 7 AS k, regexp_replace(text, ' +', ' ', 'g') AS t FROM ({BLOCKS}) q WHERE text <> 'short'), n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number ORDER BY block_index) AS nth,
 last_value(CASE WHEN k = 1 THEN t END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY page_number, block_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM b),
e AS (SELECT *, concat(doc_id, ':main:p', lpad(CAST(page_number AS VARCHAR), 4, '0'), ':text:', lpad(CAST(nth AS VARCHAR), 4, '0')) AS evidence_id, CASE k WHEN 0 THEN 'table_caption' WHEN 1 THEN 'section_heading' WHEN 2 THEN 'figure_caption' ELSE 'paragraph' END AS source_type FROM n)"""


def _blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, BLOCKS).withColumns({"bbox": F.array("x0", "y0", c("x0") + 200, c("y0") + 20), "first_spans": F.lit(1)})


@query(_TEXT + " SELECT evidence_id, source_type, section, CASE WHEN k = 1 THEN t END AS title, CASE WHEN k IN (0, 2) THEN t END AS caption, t AS text FROM e")
def text_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scrape.text_evidence(_blocks(spark, sf_dir)).select("evidence_id", "source_type", "section", "title", "caption", "text")


@query(_TEXT + """, f AS (SELECT *, concat('Figure ', CAST(block_index % 50 AS VARCHAR)) AS label, row_number() OVER (PARTITION BY doc_id ORDER BY page_number, evidence_id) AS place FROM e WHERE k = 2),
 g AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page_number, label ORDER BY evidence_id) AS first, greatest(0, y0 - 6) AS bottom FROM f),
 h AS (SELECT *, greatest(0, bottom - 330) AS top, greatest(0, least(x0 - 18, 40)) AS l, least(600, greatest(x0 + 218, 560)) AS r FROM g WHERE first = 1)
SELECT concat(doc_id, ':main:p', lpad(CAST(page_number AS VARCHAR), 4, '0'), ':figure:figure_', CAST(block_index % 50 AS VARCHAR)) AS figure_id, label, concat('figures/', lpad(CAST(place AS VARCHAR), 3, '0'), '_p', lpad(CAST(page_number AS VARCHAR), 4, '0'), '_Figure_', CAST(block_index % 50 AS VARCHAR), '.png') AS image_path,
 concat(CAST(CAST(l AS INT) AS VARCHAR), ',', CAST(CAST(top AS INT) AS VARCHAR), ',', CAST(CAST(r AS INT) AS VARCHAR), ',', CAST(CAST(bottom AS INT) AS VARCHAR)) AS box, concat(label, ' | ', t, ' | image_path: figures/', lpad(CAST(place AS VARCHAR), 3, '0'), '_p', lpad(CAST(page_number AS VARCHAR), 4, '0'), '_Figure_', CAST(block_index % 50 AS VARCHAR), '.png') AS text
FROM h WHERE bottom - top >= 40 AND r - l >= 80""")
def figure_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _blocks(spark, sf_dir)
    pages = blocks.select("doc_id", "file_id", "page_number").distinct().withColumn("width", F.lit(600.0))
    found = scrape.figures(scrape.text_evidence(blocks), pages)
    shown = scrape.figure_evidence(found).select(F.regexp_replace("evidence_id", ":image$", "").alias("figure_id"), "text")
    box = F.array_join(F.transform("bbox", lambda x: x.cast("int").cast("string")), ",")
    return found.select("figure_id", "label", "image_path", box.alias("box")).join(shown, "figure_id")


# A supplier's page: a caption, a header, one to three data rows, running text, a line of data that
# is no longer the table's. Every other page has only what a parser found.
NUMBERS = "(SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5 UNION ALL SELECT 6)"
_LAID = "SELECT CAST(s_suppkey % 10 AS VARCHAR(20)) AS doc_id, 'main' AS file_id, CAST(s_suppkey AS INT) AS page_number, CAST(s_nationkey AS INT) AS nation, s_name AS name FROM {supplier}"
LAID_BLOCKS = f"""SELECT doc_id, file_id, page_number, CAST(k AS INT) AS block_index, CASE k WHEN 0 THEN concat('Table ', CAST(1 + nation % 9 AS VARCHAR(20)), '. ', name) WHEN 1 THEN 'Compound MIC E. coli' WHEN 5 THEN 'Running text that goes on for long enough to be told from a table, which it does by being so much longer than any cell.'
 ELSE concat(CAST(k AS VARCHAR(20)), 'a 5 7') END AS text, CAST(CASE WHEN k IN (0, 5) THEN 1 ELSE 3 END AS INT) AS first_spans FROM ({_LAID}) q CROSS JOIN {NUMBERS} n WHERE nation % 2 = 0 AND (k < 2 OR k > 4 OR k - 2 <= nation % 3)"""
_SPANS = f"SELECT doc_id, file_id, page_number, k, nation FROM ({_LAID}) q CROSS JOIN {NUMBERS} n WHERE nation % 2 = 0 AND k <> 0 AND k <> 5 AND (k < 2 OR k > 4 OR k - 2 <= nation % 3)"
LAID_SPANS = f"""SELECT doc_id, file_id, page_number, CAST(k AS INT) AS block_index, s AS span_id, CASE WHEN k = 1 THEN CASE s WHEN 'a' THEN 'Compound' WHEN 'b' THEN 'MIC' WHEN 'c' THEN 'E.' ELSE 'coli' END ELSE CASE s WHEN 'a' THEN concat(CAST(k AS VARCHAR(20)), 'a') WHEN 'b' THEN CAST(nation AS VARCHAR(20)) ELSE '<7' END END AS text,
 CAST(x AS DOUBLE) AS x0, CAST(20 * k + x / 100 AS DOUBLE) AS y0, CAST(x + 8 AS DOUBLE) AS x1, CAST(20 * k + 12 AS DOUBLE) AS y1 FROM ({_SPANS}) q CROSS JOIN (SELECT 'a' AS s, 0 AS x UNION ALL SELECT 'b', 100 UNION ALL SELECT 'c', 200 UNION ALL SELECT 'd', 209) z WHERE s <> 'd' OR k = 1"""


@query(f"""SELECT concat(doc_id, ':main:p', lpad(CAST(page_number AS VARCHAR), 4, '0'), ':layout_table:table_', CAST(1 + nation % 9 AS VARCHAR)) AS table_id, concat('Table ', CAST(1 + nation % 9 AS VARCHAR)) AS label, concat('Table ', CAST(1 + nation % 9 AS VARCHAR), '. ', name) AS caption, 'Compound,MIC,E. coli' AS columns,
 CAST(k - 1 AS INT) AS row_index, concat(CAST(k AS VARCHAR), 'a,', CAST(nation AS VARCHAR), ',<7') AS cells, CAST(20 * (2 + nation % 3) + 12 AS DOUBLE) AS bottom FROM ({_LAID}) q CROSS JOIN {NUMBERS} n WHERE nation % 2 = 0 AND k BETWEEN 2 AND 2 + nation % 3""")
def layout_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables, rows = scrape.layout_tables(view(spark, sf_dir, LAID_BLOCKS), view(spark, sf_dir, LAID_SPANS))
    joined = rows.join(tables.select("doc_id", "table_id", "label", "caption", "columns", "bbox"), ["doc_id", "table_id"])
    return joined.select("table_id", "label", "caption", F.array_join("columns", ",").alias("columns"), "row_index", F.array_join("cells", ",").alias("cells"), F.get("bbox", F.lit(3)).alias("bottom"))


# What a parser finds on every page: a table with a ragged and an empty row, and one without rows.
RAW = f"SELECT doc_id, file_id, page_number, CAST(i AS INT) AS table_index, nation, name FROM ({_LAID}) q CROSS JOIN (SELECT 1 AS i UNION ALL SELECT 2 AS i) n"
CAPTIONS = f"SELECT doc_id, file_id, page_number, concat(doc_id, '-', CAST(page_number AS VARCHAR(20))) AS evidence_id, 'table_caption' AS source_type, concat('TABLE 7a. About ', name) AS text FROM ({_LAID}) q WHERE nation % 4 = 1"


@query(f"""WITH l AS ({_LAID}) SELECT concat(doc_id, ':main:p', lpad(CAST(page_number AS VARCHAR), 4, '0'), ':layout_table:table_', CAST(1 + nation % 9 AS VARCHAR)) AS table_id, concat('Table ', CAST(1 + nation % 9 AS VARCHAR)) AS label, concat('Table ', CAST(1 + nation % 9 AS VARCHAR), '. ', name) AS caption, 1 + nation % 3 AS n_rows, '2a,' || CAST(nation AS VARCHAR) || ',<7' AS first_row FROM l WHERE nation % 2 = 0
UNION ALL SELECT concat(doc_id, ':main:p', lpad(CAST(page_number AS VARCHAR), 4, '0'), ':table:001'), CASE WHEN nation % 4 = 1 THEN 'Table 7a' ELSE 'Table 1' END, CASE WHEN nation % 4 = 1 THEN concat('TABLE 7a. About ', name) END, 1, concat(name, ',') FROM l WHERE nation % 2 = 1""", n_rows="BIGINT")
def all_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    by_layout = scrape.layout_tables(view(spark, sf_dir, LAID_BLOCKS), view(spark, sf_dir, LAID_SPANS))
    raw = view(spark, sf_dir, RAW)
    rows = F.array(F.array(F.lit(" a "), F.lit("b")), F.array("name"), F.array(F.lit(""), F.lit(None)))
    raw = raw.withColumn("raw", F.when(c("table_index") == 1, rows).otherwise(F.slice(rows, 1, 1)))
    tables, cells = scrape.all_tables(by_layout, scrape.raw_tables(raw, view(spark, sf_dir, CAPTIONS), by_layout[0]))
    size = cells.groupBy("table_id").agg(F.count("*").alias("n_rows"), F.min_by("cells", "row_index").alias("first"))
    return tables.join(size, "table_id").select("table_id", "label", "caption", "n_rows", F.array_join("first", ",").alias("first_row"))


# Regions after captions, where blocks that end them come in all kinds.
ENDS = """SELECT CAST(user_id AS VARCHAR(20)) AS doc_id, 'main' AS file_id, 1 AS page_number, CAST(event_id AS INT) AS block_index, CAST(1 AS INT) AS first_spans, event_id % 5 = 1 AS has_data,
 CASE event_id % 11 WHEN 0 THEN concat('Table ', CAST(event_id AS VARCHAR(20)), '. Caption') WHEN 3 THEN 'For peer review only' WHEN 5 THEN 'Running text that goes on for long enough to be told from a table, which it does by being so much longer than any cell.' ELSE 'cells' END AS text FROM {events}"""


@query(f"""WITH b AS ({ENDS}), r AS (SELECT x.doc_id, x.block_index AS caption_block, y.block_index, row_number() OVER w AS n, y.block_index % 11 AS k, max(CASE WHEN y.has_data THEN 1 ELSE 0 END) OVER (PARTITION BY x.doc_id, x.block_index ORDER BY y.block_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS data
 FROM b x JOIN b y ON y.doc_id = x.doc_id AND y.block_index > x.block_index WHERE x.block_index % 11 = 0 WINDOW w AS (PARTITION BY x.doc_id, x.block_index ORDER BY y.block_index)),
s AS (SELECT *, max(CASE WHEN k = 3 OR (k = 0 AND n > 1) OR (k = 5 AND data = 1) THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, caption_block ORDER BY block_index) AS ended FROM r) SELECT doc_id, caption_block, block_index FROM s WHERE ended = 0""")
def caption_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = view(spark, sf_dir, ENDS)
    return scrape.caption_regions(blocks, blocks.where("has_data")).select("doc_id", "caption_block", "block_index")


TOLD = "SELECT CAST(o_custkey AS VARCHAR(20)) AS doc_id, 'main' AS file_id, 1 AS page_number, concat('t', CAST(o_orderkey AS VARCHAR(20))) AS table_id, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE concat('Table ', o_orderstatus) END AS label, o_orderpriority AS caption, o_orderkey, o_orderstatus FROM {orders}"


@query(f"""SELECT concat(table_id, ':row:0001') AS evidence_id, concat(CASE WHEN label IS NULL THEN '' ELSE concat(label, ' | ') END, caption, ' | id: ', CAST(o_orderkey AS VARCHAR), CASE WHEN o_orderstatus = 'F' THEN '' ELSE concat(' | column_2: ', o_orderstatus) END) AS text, concat('{{"table_id":"', table_id, '","row_index":1}}') AS metadata FROM ({TOLD}) q""")
def row_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = view(spark, sf_dir, TOLD).withColumns({"columns": F.array(F.lit("id"), F.lit("")), "bbox": F.lit(None).cast("array<double>"), "parser": F.lit("x"), "confidence": F.lit(0.5)})
    r = t.select("doc_id", "table_id", F.lit(1).alias("row_index"), F.array(c("o_orderkey").cast("string"), F.when(c("o_orderstatus") != "F", c("o_orderstatus")).otherwise("")).alias("cells"))
    return scrape.row_evidence(t, r)[1].select("evidence_id", "text", "metadata")


@query(f"""WITH p AS (SELECT CAST(conv_id AS VARCHAR) AS doc_id, turn + 1 AS page_number, length(trim(text, ' \n\t')) < 50 AS bare, role FROM conversations), g AS (SELECT doc_id, count(*) AS pages, count(*) FILTER (role = 'user') AS tables, count(*) FILTER (role = 'system') AS captions, list(page_number ORDER BY page_number) FILTER (bare) AS bare FROM p GROUP BY 1)
SELECT doc_id, pages AS pages_count, tables AS tables_count, captions AS evidence_count, concat_ws('; ', CASE WHEN len(bare) > 0 THEN concat('hardly any text on pages ', array_to_string(bare[1:20], ', ')) END, CASE WHEN tables = 0 THEN 'no tables' END, CASE WHEN tables > 0 AND captions = 0 THEN 'tables without captions' END) AS notes FROM g""", pages_count="INTEGER", tables_count="INTEGER", evidence_count="INTEGER")
def diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    found = scrape.diagnostics(pages, pages.where("role = 'user'"), pages.where("false"), pages.where("false"), pages.where("role = 'system'").withColumn("source_type", F.lit("table_caption")))
    return found.select("doc_id", "pages_count", "tables_count", "evidence_count", F.array_join("notes", "; ").alias("notes"))


PAGES = "SELECT CAST(conv_id AS VARCHAR(20)) AS doc_id, 'main' AS file_id, CAST(turn + 1 AS INT) AS page_number, role, text, turn FROM {conversations}"


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view(spark, sf_dir, PAGES)


# A user's page has a table, an assistant's two pieces of evidence of which one is shown.
_WHOLE = f"""WITH p AS ({PAGES}), w AS (SELECT doc_id, page_number, turn, role, concat('PAGE ', CAST(page_number AS VARCHAR), chr(10), chr(10), trim(text, ' \n\t'), CASE WHEN role = 'user' THEN concat(chr(10), chr(10), 'TABLE ', CAST(page_number AS VARCHAR), '.1', chr(10), 'Table 1.', chr(10), chr(10), '| role | turn |', chr(10), '| --- | --- |', chr(10), '| user | ', CAST(turn AS VARCHAR), ' |')
 WHEN role = 'assistant' THEN concat(chr(10), chr(10), 'SCRAPER EVIDENCE', chr(10), 'figure_caption | Results | Fig: a/b ', CAST(turn AS VARCHAR)) ELSE '' END) AS whole FROM p)"""


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _pages(spark, sf_dir)
    users = pages.where("role = 'user'").withColumns({"table_id": F.concat("doc_id", F.lit("-"), c("turn").cast("string")), "label": F.lit("Table 1."), "caption": F.lit(None).cast("string"), "columns": F.array(F.lit("role"), F.lit("turn"))})
    rows = users.select("doc_id", "table_id", F.lit(1).alias("row_index"), F.lit("r").alias("row_id"), F.array("role", c("turn").cast("string")).alias("cells"))
    told = pages.where("role = 'assistant'").withColumn("source_type", F.explode(F.array(F.lit("paragraph"), F.lit("figure_caption"))))
    told = told.select("doc_id", "page_number", "source_type", F.lit("Results").alias("section"), F.lit("").alias("title"), F.lit("Fig").alias("caption"), F.concat(F.lit(" a/b "), c("turn").cast("string")).alias("text"), F.lit("e").alias("evidence_id"))
    return context.document(pages, users, rows, told)


@query(_WHOLE + " SELECT doc_id, page_number, whole FROM w")
def document_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents(spark, sf_dir).select("doc_id", "page_number", "whole")


@query(_WHOLE + ", n AS (SELECT *, CAST(floor((row_number() OVER (PARTITION BY doc_id ORDER BY page_number) - 1) / 3) AS BIGINT) AS part FROM w) SELECT doc_id, part, string_agg(whole, chr(10) || chr(10) ORDER BY page_number) AS text, max(max(part)) OVER (PARTITION BY doc_id) + 1 AS n_windows FROM n GROUP BY 1, 2")
def window_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.window_text(_documents(spark, sf_dir), 3).withColumnRenamed("window", "part").select("doc_id", "part", "text", "n_windows")


@query(_WHOLE + ", t AS (SELECT doc_id, string_agg(whole, chr(10) || chr(10) ORDER BY page_number) AS text FROM w GROUP BY 1) SELECT doc_id, CASE WHEN length(text) <= 600 THEN text ELSE concat(regexp_replace(substr(text, 1, 600), '\n[^\n]*$', ''), chr(10), '[truncated]') END AS text FROM t")
def review_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.contexts(_documents(spark, sf_dir), 600)


# Extraction with a stand-in for a model: it finds ids in windows, and in a review keeps even ones.
STATED = "SELECT CAST(user_id AS VARCHAR(20)) AS doc_id, 'main' AS file_id, CAST(event_id AS INT) AS page_number, concat('id=', CAST(event_id AS VARCHAR(20)), ' value=', CAST(event_id % 10 AS VARCHAR(20))) AS whole FROM {events}"


def _finder() -> Callable[[str, str, list[bytes]], str]:
    def ask(system: str, prompt: str, images: list[bytes]) -> str:
        if "Candidates:" in prompt:
            samples = json.loads(prompt.split("Candidates:\n", 1)[1])["samples"]
            kept = [s | {"target_value": str(int(s["target_value"]) + 1)} for s in samples if int(s["compound_id"]) % 2 == 0]
            return "```json\n" + json.dumps({"samples": kept}) + "\n```"
        return json.dumps([{"compound_id": i, "target_value": v, "unknown": 1} for i, v in re.findall(r"id=(\d+) value=(\d+)", prompt)])

    return ask


@query("SELECT CAST(user_id AS VARCHAR) AS pdf, CAST(event_id AS VARCHAR) AS compound_id, CAST(event_id % 10 + 1 AS VARCHAR) AS target_value, 'NOT_DETECTED' AS bacteria FROM events WHERE event_id % 2 = 0")
def extract_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.records(view(spark, sf_dir, STATED), DOMAINS["benzimidazole"], _finder).select("pdf", "compound_id", "target_value", "bacteria")


@query("SELECT CAST(user_id AS VARCHAR) AS pdf, CAST(event_id AS VARCHAR) AS compound_id, CAST(event_id % 10 + 3 AS VARCHAR) AS target_value FROM events WHERE event_id % 2 = 0 AND user_id % 4 <> 3")
def review_passes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = DOMAINS["benzimidazole"]
    pages = view(spark, sf_dir, STATED).where("CAST(doc_id AS INT) % 4 <> 3")  # articles without a file aren't reviewed
    rows = view(spark, sf_dir, "SELECT CAST(user_id AS STRING) AS pdf, CAST(event_id AS STRING) AS compound_id, CAST(event_id % 10 AS STRING) AS target_value FROM {events}")
    full = rows.select("pdf", *(c(x) if x in rows.columns else F.lit("NOT_DETECTED").alias(x) for x in d.columns))
    return extract.review_passes(full, pages, d, _finder, passes=3).select("pdf", "compound_id", "target_value")


@query("SELECT CAST(p_partkey AS VARCHAR) AS doc_id, CASE WHEN p_size % 5 = 0 THEN 'full' WHEN p_size % 3 = 0 THEN 'model' ELSE 'heuristic' END AS method, CASE WHEN p_size % 5 = 0 THEN 'a' WHEN p_size % 3 = 0 THEN 'b' ELSE 'c' END AS object_id FROM part")
def extraction_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = view(spark, sf_dir, "SELECT CAST(p_partkey AS STRING) AS doc_id, p_size FROM {part}")
    of = lambda where, name: lambda left: left.where(where).select("doc_id", F.lit(name).alias("object_id"))
    return extract.first_with_records(parts, [("full", of("p_size % 5 = 0", "a")), ("model", of("p_size % 3 = 0", "b")), ("heuristic", of("true", "c"))]).select("doc_id", "method", "object_id")


# The agents over the evidence of a table, one after the other, and what they tell as evidence.
@query("""WITH r AS (SELECT l_suppkey, l_returnflag FROM lineitem WHERE l_returnflag <> 'R') SELECT CAST(s_suppkey AS VARCHAR) AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS measurements, CAST(coalesce(n, 0) AS BIGINT) AS links FROM supplier JOIN (SELECT l_suppkey, count(*) AS n FROM r GROUP BY 1) c ON l_suppkey = s_suppkey WHERE s_suppkey % 3 <> 2""")
def agent_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from corundum.plans.queries import _tables

    tables, rows = _tables(spark, sf_dir)
    none = spark.range(0).select(*(F.lit(None).cast("string").alias(n) for n in ("evidence_id", "doc_id", "file_id", "source_type", "title", "caption", "text", "metadata")), F.lit(None).cast("int").alias("page_number"), F.lit(None).cast("double").alias("confidence"))
    _, told = extract.run_agents(tables, rows, none)
    n = lambda kind, name: F.count_if(c("source_type") == kind).alias(name)
    return told.groupBy("doc_id").agg(n("agent_table_measurement", "measurements"), n("agent_compound_link", "links"))


HEADERS = "SELECT CAST(event_id AS BIGINT) AS span_id, CAST(user_id AS BIGINT) AS table_id, CAST(value AS DOUBLE) AS x0, event_type AS text FROM {events}"


@query(f"""WITH h AS ({HEADERS}), k AS (SELECT span_id, i AS "index", row_number() OVER (PARTITION BY span_id ORDER BY abs(x0 - i * 60.0), i) AS n FROM h CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) z) SELECT span_id, "index" FROM k WHERE n = 1""", index="INTEGER")
def nearest_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = view(spark, sf_dir, HEADERS)
    columns = heads.select("table_id").distinct().select("table_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("index")).withColumn("column_x", c("index") * 60.0)
    return layout.nearest_column(heads, columns, by=["table_id"]).select("span_id", "index")


# Each line of a text is a row of its words; the feature is the limit of eighty rows.
@query("""SELECT doc_id, array_to_string(list_transform(string_split(coalesce(text, ''), chr(10))[1:80], lambda l: array_to_string(list_filter(list_transform(string_split(l, ' '), lambda x, i: concat('w', CAST(i AS VARCHAR), ': ', x)), lambda y: NOT ends_with(y, ': ')), '; ')), chr(10)) AS line FROM documents""")
def row_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = lambda words: F.map_from_arrays(F.transform(words, lambda _, i: F.concat(F.lit("w"), (i + 1).cast("string"))), words)
    rows = F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), lambda l: let(F.split(l, " "), row))
    return view(spark, sf_dir, "SELECT doc_id, text FROM {documents}").select("doc_id", text.rows_text(rows).alias("line"))

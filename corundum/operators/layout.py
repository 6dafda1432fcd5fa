"""Tables from the layout of a page: spans to lines, lines to rows, headers to columns.

Clustering spans into lines is a fold whose order matters, so it runs on one page at a time in
Arrow batches; everything after it is relational."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corundum.functions.text import clean
from corundum.functions.values import strip

PAGE = ["doc_id", "page_number"]
LINE_GAP, SPAN_GAP = 4.0, 2.0


def lines_of_page(spans: pd.DataFrame) -> pd.DataFrame:
    """line, of each span: that of the first line that begins within LINE_GAP of it."""
    spans = spans.sort_values(["y0", "x0", "span_id"], kind="stable").reset_index(drop=True)
    tops: list[float] = []
    line = []
    for y in spans["y0"].tolist():
        k = next((i for i, top in enumerate(tops) if abs(top - y) <= LINE_GAP), len(tops))
        if k == len(tops):
            tops.append(y)
        line.append(k)
    return spans.assign(line=line)


def cluster_lines(spans: DataFrame, by: list[str] | None = None, *, within: str | None = None) -> DataFrame:
    """spans (by, as a rule doc_id and page_number; span_id, text, x0, y0, x1, y1) with their line;
    with within, lines are those of each of its values alone."""
    by = PAGE if by is None else by
    names = [*by, *([within] if within else []), "span_id", "text", "x0", "y0", "x1", "y1"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spans.select(*names).schema) + ", line int"
    of_group = (lambda pdf: pd.concat([lines_of_page(part) for _, part in pdf.groupby(within)])) if within else lines_of_page
    return spans.select(*names).where(F.coalesce(strip("text"), F.lit("")) != "").groupBy(*by).applyInPandas(of_group, schema)


def merge_spans(spans: DataFrame, *, by: list[str], gap: float = SPAN_GAP) -> DataFrame:
    """Neighbours on a line at most gap apart as one span: gaps open islands, and an island's texts
    are joined in order. by: the line."""
    row = Window.partitionBy(*by).orderBy("x0", "span_id")
    opens = F.coalesce((F.col("x0") - F.lag("x1").over(row) > gap).cast("int"), F.lit(1))
    marked = spans.withColumn("opens", opens).withColumn("island", F.sum("opens").over(row.rowsBetween(Window.unboundedPreceding, 0)))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("x0", "span_id", "text", "x1"))), lambda s: s["text"])
    whole = F.aggregate(F.slice("parts", 2, F.size("parts")), F.get("parts", F.lit(0)), join_text)
    islands = marked.groupBy(*by, "island").agg(parts.alias("parts"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max_by("x1", F.struct("x0", "span_id")).alias("x1"), F.max("y1").alias("y1"))
    return islands.withColumn("text", whole).drop("parts")


def join_text(left: Column, right: Column) -> Column:
    tight = right.isin(".", ",", ":", ";", ")") | left.rlike(r"[(/-]$")
    return F.when(tight, F.concat(left, right)).otherwise(F.concat(left, F.lit(" "), right))


def is_row_label(c: Column) -> Column:
    return F.trim(F.regexp_replace(clean(c), r"^[- ]+|[- ]+$", "")).rlike(r"^(?:\d+[A-Za-z]?|[A-Za-z]{1,4}\d+[A-Za-z]?|[A-Z][A-Za-zﬂ-]{4,30})$")


def is_value(c: Column) -> Column:
    return (clean(c) == "-") | c.rlike(r"\d")


def is_data_line(cells: Column) -> Column:
    """Three cells or more, a row label first, two values after it."""
    values = F.filter(F.slice(cells, 2, F.greatest(F.size(cells), F.lit(1))), is_value)
    return (F.size(cells) >= 3) & is_row_label(F.get(cells, F.lit(0))) & (F.size(values) >= 2)


def is_super_header(c: Column) -> Column:
    low = F.lower(c)
    return (F.length(c) > 32) | F.contains(low, F.lit("inhibition zone")) | F.contains(low, F.lit("diffusion method"))


def data_rows(lines: DataFrame, *, by: list[str], order: str = "line") -> DataFrame:
    """The first stretch of data lines as wide as its first: what comes before it are headers, what
    follows its end isn't read. lines: by, order, cells."""
    up_to = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    marked = lines.withColumn("data", is_data_line(F.col("cells")))
    marked = marked.withColumn("width", F.first(F.when(F.col("data"), F.size("cells")), True).over(up_to)).where("width is not null")
    good = F.col("data") & (F.size("cells") == F.col("width"))
    return marked.withColumn("good", F.min(good).over(up_to)).where("good").drop("good", "data")


def nearest_column(headers: DataFrame, columns: DataFrame, *, by: list[str]) -> DataFrame:
    """Each header span (span_id, x0) with the column (index, column_x) that begins nearest, the
    first of equals. Columns are as few as a table's."""
    near = F.row_number().over(Window.partitionBy(*by, "span_id").orderBy(F.abs(F.col("x0") - F.col("column_x")), "index"))
    return headers.join(columns, by).withColumn("nth", near).where("nth = 1").drop("nth")


def padded(rows: DataFrame, *, by: list[str]) -> DataFrame:
    """Rows of a table filled up to its widest."""
    width = rows.groupBy(*by).agg(F.max(F.size("cells")).alias("width"))
    full = F.concat("cells", F.array_repeat(F.lit(""), F.col("width") - F.size("cells")))
    return rows.join(width, by).withColumn("cells", full).drop("width")


def best_tables(tables: DataFrame) -> DataFrame:
    """Of tables of a page with one label that with the most cells: rows times columns, then filled
    cells, then the layout parser; the first of equals. tables: doc_id, page_number, label,
    table_id, parser, n_rows, n_columns, n_filled, seq."""
    score = F.col("n_rows") * F.greatest("n_columns", F.lit(1)) + F.col("n_filled") / 100 + F.when(F.col("parser") == "pymupdf_layout", 0.2).otherwise(0.0)
    first = Window.partitionBy("doc_id", "page_number", F.lower(F.coalesce("label", "table_id"))).orderBy(F.desc("score"), "seq")
    return tables.withColumn("score", score).withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth")


def figure_box(x0: Column, y0: Column, x1: Column, page_width: Column) -> Column:
    """The box above a caption that a figure fills; null if too small."""
    bottom = F.greatest(F.lit(0.0), y0 - 6.0)
    top = F.greatest(F.lit(0.0), bottom - 330.0)
    left = F.greatest(F.lit(0.0), F.least(x0 - 18.0, F.lit(40.0)))
    right = F.least(page_width, F.greatest(x1 + 18.0, page_width - 40.0))
    return F.when((bottom - top >= 40) & (right - left >= 80), F.array(left, top, right, bottom))

"""Column functions over document text: cleaning, captions, headings, snippets, table rendering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corundum.functions.core import let, present
from corundum.functions.values import SPACE, replaced, strip

# Signs that parsers write and their plain forms; caption and heading patterns.
PLAIN_SIGNS = (("\u0000", " "), ("ﬂ", "fl"), ("ﬁ", "fi"), ("−", "-"), ("–", "-"))
CAPTION = r"(?im)^\s*(Table|Figure|Fig\.|Scheme)\s+([A-Za-z]?\d+[A-Za-z]?)\.?\s*(.+)"
HEADING = r"(?i)^(abstract|introduction|results|discussion|conclusion|experimental|methods|references)\b"
NUMBERED_HEADING = r"^\d+\.?\s+[A-Z][A-Za-z ,:-]{3,60}$"
SUPPLEMENT_WORDS = ("supplement", "suppdata", "supporting", "esi", "electronic supplementary")
DOI = r"\b10\.\d{4,9}/[-._;()/:A-Za-z0-9]+\b"


def compact(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def clean(c: Column) -> Column:
    """Parser artefacts replaced; each line compacted; lines without text dropped."""
    lines = F.transform(F.split(replaced(c, PLAIN_SIGNS), r"\r\n|\n|\r"), compact)
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def snippet(c: Column, limit: int = 360) -> Column:
    """Compacted; if longer than limit, cut one short of it, without trailing space, and marked."""
    return let(compact(c), lambda x: F.when(F.length(x) <= limit, x).otherwise(F.concat(F.rtrim(F.left(x, F.lit(limit - 1))), F.lit("..."))))


def caption(c: Column) -> Column:
    """A struct of kind, label and rest of the first caption line; null without one."""
    part = lambda k: F.regexp_extract(c, CAPTION, k)
    return F.when(c.rlike(CAPTION), F.struct(part(1).alias("kind"), part(2).alias("label"), part(3).alias("rest")))


def heading(c: Column) -> Column:
    """The first line if it reads as a section heading, else null: 80 characters at most, and begun
    by a section word or a numbered title."""
    first = strip(F.regexp_extract(c, r"\A([^\n\r]*)", 1))
    return let(first, lambda x: F.when((F.length(x) <= 80) & (x.rlike(HEADING) | x.rlike(NUMBERED_HEADING)), x))


def cell(c: Column) -> Column:
    """One line that can't break a table: no line breaks, no bars."""
    return strip(F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\n"), F.lit(" ")), F.lit("|"), F.lit("/")))


def markdown_row(cells: Column) -> Column:
    return F.concat(F.lit("| "), F.array_join(F.transform(cells, cell), " | "), F.lit(" |"))


def markdown_table(columns: Column, rows: Column) -> Column:
    """A Markdown table of a header and an array of rows (arrays of cells): rows without text are
    left out, shorter ones filled up."""
    full = F.filter(rows, lambda r: F.exists(r, lambda x: strip(F.coalesce(x, F.lit(""))) != ""))
    width = F.greatest(F.size(columns), F.coalesce(F.array_max(F.transform(full, lambda r: F.size(r))), F.lit(0)))

    def pad(r: Column, w: Column) -> Column:
        return F.concat(r, F.array_repeat(F.lit(""), F.greatest(w - F.size(r), F.lit(0))))

    def render(w: Column) -> Column:
        rule = F.array(F.concat(F.lit("| "), F.array_join(F.array_repeat(F.lit("---"), w), " | "), F.lit(" |")))
        return F.array_join(F.concat(F.array(markdown_row(pad(columns, w))), rule, F.transform(full, lambda r: markdown_row(pad(r, w)))), "\n")

    return F.when(width > 0, let(width, render)).otherwise(F.lit(""))


def row_text(label: Column, title: Column, columns: Column, cells: Column) -> Column:
    """label | caption | column: cell | ... of one table row, empty cells left out."""
    name = lambda i: F.coalesce(F.nullif(F.get(columns, i), F.lit("")), F.concat(F.lit("column_"), (i + 1).cast("string")))
    shown = F.transform(cells, lambda x, i: F.when(F.coalesce(x, F.lit("")) != "", F.concat(name(i), F.lit(": "), x)))
    return F.array_join(F.concat(present(label, title), F.array_compact(shown)), " | ")


def rows_text(rows: Column, limit: int = 80) -> Column:
    """The first rows (an array of maps) as lines of key: value, empty values left out."""
    line = lambda r: F.array_join(F.transform(F.filter(F.map_entries(r), lambda e: F.coalesce(e["value"], F.lit("")) != ""), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "; ")
    return F.array_join(F.transform(F.slice(rows, 1, limit), line), "\n")


def is_supplement(link: Column) -> Column:
    """A link to a PDF whose address or text says that it is supplementary."""
    marked = F.lit(False)
    for w in SUPPLEMENT_WORDS:
        marked = marked | F.contains(link, F.lit(w))
    return F.contains(link, F.lit(".pdf")) & marked


def dois(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(DOI), F.lit(0))


def slug(c: Column, fill: str = "_") -> Column:
    """Letters, digits, . _ and - ; anything else is filled, not at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", fill), f"^[{fill}.-]+|[{fill}.-]+$", "")

"""Readers: tables, texts, archives, articles, job files; one entry for each file suffix."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corundum.functions.values import clean_article, strip
from corundum.schemas import MISSING
from corundum.sources.quoted import read_quoted

#: Limits of uploads, as their readers state them.
MAX_BYTES, MAX_ARCHIVE_BYTES, MAX_PDFS, TEXT_LIMIT = 50 * 2**20, 120 * 2**20, 12, 250_000
#: Of a column that holds the place of a row.
NTH = "__nth__"
SUFFIXES = (".csv", ".tsv", ".pdf", ".txt", ".md", ".zip")


def read_table(spark: SparkSession, path: str, *, separator: str | None = None, multiline: bool | None = None) -> DataFrame:
    """A CSV or TSV file with a header: every value a stripped string, nothing inferred. A file is
    split among tasks, also where values go over lines (multiline; None: looked for first)."""
    sep, multiline = _form(spark, path, separator, multiline)
    if multiline:
        return _stripped(read_quoted(spark, path, sep))
    return _stripped(spark.read.csv(path, header=True, sep=sep, inferSchema=False, escape='"', mode="PERMISSIVE"))


def _form(spark: SparkSession, path: str, separator: str | None, multiline: bool | None) -> tuple[str, bool]:
    if multiline is None:  # a quote left open at the end of a line
        lone = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
        multiline = not spark.read.text(path).where(lone % 2 == 1).limit(1).isEmpty()
    return separator or ("\t" if path.lower().endswith(".tsv") else ","), multiline


def _stripped(df: DataFrame) -> DataFrame:
    names = [x.lstrip("\ufeff").strip() for x in df.columns]
    return df.toDF(*names).select(*(strip(F.col(f"`{x}`")).alias(x) for x in names))


def read_rows(spark: SparkSession, path: str, doc_id: str, *, separator: str | None = None) -> DataFrame:
    """as_rows() of a CSV or TSV file, also where values go over lines."""
    sep, multiline = _form(spark, path, separator, None)
    if not multiline:
        return as_rows(read_table(spark, path, separator=sep, multiline=False), doc_id)
    return _mapped(_stripped(read_quoted(spark, path, sep, numbered=NTH)), doc_id, NTH)


def preview(df: DataFrame, limit: int = 8) -> DataFrame:
    return df.limit(limit)


def file_order(df: DataFrame, name: str) -> DataFrame:
    """df, as it is read from files, with name: the place of each row, from 1 on, in the order of
    files, their splits and the rows within; the same however the files are split. Rows of a split are
    numbered in a row by their task, so a table of a row a split with the rows before it is all that
    is needed. Of a df that no file stands behind the partitions are taken for splits."""
    try:
        split = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block")]
        df.select(*split)
    except AnalysisException:
        split = [F.lit("").alias("file"), F.spark_partition_id().cast("bigint").alias("block")]
    rows = df.select("*", *split, F.monotonically_increasing_id().alias("at"))
    sizes = rows.groupBy("file", "block").agg(F.min("at").alias("start"), F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = rows.join(sizes.select("file", "block", "start", before.alias("before")), ["file", "block"])
    return placed.select(*(F.col(f"`{x}`") for x in df.columns), (F.col("before") + F.col("at") - F.col("start") + 1).alias(name))


def as_rows(df: DataFrame, doc_id: str) -> DataFrame:
    """doc_id, nth, row: a table as maps of header to value, for readers that don't know its header.
    df is a file as it is read: nth counts from 1 in its order."""
    return _mapped(file_order(df, NTH), doc_id, NTH)


def _mapped(df: DataFrame, doc_id: str, nth: str) -> DataFrame:
    names = [x for x in df.columns if x != nth]
    pairs = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(F.col(f"`{x}`").cast("string") for x in names)))
    return df.select(F.lit(doc_id).alias("doc_id"), F.col(f"`{nth}`").cast("bigint").alias("nth"), pairs.alias("row"))


def read_text(spark: SparkSession, path: str, *, limit: int = TEXT_LIMIT) -> DataFrame:
    """path, text: whole text files, cut at limit characters."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.left(F.decode("content", "utf-8"), F.lit(limit)).alias("text"))


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """article, one a line, without empty lines."""
    return spark.read.text(path).select(strip("value").alias("article")).where("article <> ''")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """path, name, sha256, content of files, one row each."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.sha2("content", 256).alias("sha256"), "content")


def archive_members(files: DataFrame, *, suffix: str = ".pdf", most: int = MAX_PDFS, max_bytes: int = MAX_ARCHIVE_BYTES) -> DataFrame:
    """path, nth, member, content, error of the members of ZIP files with a suffix: no folders,
    hidden files or encrypted members; by name whatever its case; most of them, max_bytes in all. An
    archive or member that can't be read is a row with an error."""

    def members(path: str, content: bytes) -> Iterator[tuple]:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            wanted = [i for i in z.infolist() if not i.is_dir() and i.filename.lower().endswith(suffix) and not any(p.startswith((".", "__MACOSX")) for p in i.filename.split("/"))]
            total = 0
            for nth, i in enumerate(sorted(wanted, key=lambda i: i.filename.lower())[:most], 1):
                total += i.file_size
                if i.flag_bits & 1 or total > max_bytes:
                    continue
                try:
                    yield path, nth, i.filename, z.read(i), None
                except Exception as e:  # one bad member mustn't stop the others
                    yield path, nth, i.filename, None, str(e)[:1000]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[tuple] = []
            for r in pdf.itertuples():
                try:
                    out += members(r.path, r.content)
                except Exception as e:  # nor one bad archive
                    out.append((r.path, None, None, None, str(e)[:1000]))
            yield pd.DataFrame(out, columns=["path", "nth", "member", "content", "error"])

    return files.select("path", "content").mapInPandas(run, "path string, nth int, member string, content binary, error string")


def member_names(members: DataFrame) -> DataFrame:
    """archive_members() with target: the name that each is stored under, its place before its own name
    with anything but letters, digits, ., _ and - replaced, which is cut at 120 characters."""
    bare = F.left(F.regexp_replace(F.element_at(F.split("member", "/"), -1), r"(?U)[^\p{Alnum}._-]", "_"), F.lit(120))
    return members.withColumn("target", F.concat(F.lpad(F.col("nth").cast("string"), F.greatest(F.lit(2), F.length(F.col("nth").cast("string"))), F.lit("0")), F.lit("-"), bare))


def upload_problem(name: F.Column, size: F.Column) -> F.Column:
    """Why a file can't be taken; null if it can."""
    known = F.lit(False)
    for s in SUFFIXES:
        known = known | F.endswith(F.lower(name), F.lit(s))
    return F.when(~known, "the file type isn't known").when(size > MAX_BYTES, "the file is too large")


def read_jobs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Job files, one JSON object each."""
    return spark.read.schema(schema).json(path, multiLine=True)


def open_articles(frame: DataFrame, *, ids: tuple[str, ...] = ("pdf",)) -> DataFrame:
    """doi, pdf_id, first: the distinct open-access articles of a truth table, all its articles where
    it doesn't tell access; first is the place of their first row. The id is the first of ids that
    is given; words for missing aren't."""
    rows = frame.where(F.trim(F.col("access").cast("string")).isin("1", "1.0", "true", "True")) if "access" in frame.columns else frame
    given = lambda name: F.nullif(clean_article(F.col(f"`{name}`").cast("string")), F.lit(MISSING))
    have = [c for c in ids if c in frame.columns]
    if "doi" not in frame.columns or not have:
        return frame.sparkSession.range(0).select(F.lit("").alias("doi"), F.lit("").alias("pdf_id"), F.col("id").alias("first"))
    out = file_order(rows, NTH).select(given("doi").alias("doi"), F.coalesce(*map(given, have)).alias("pdf_id"), F.col(NTH).alias("at"))
    return out.where("doi is not null and pdf_id is not null").groupBy("doi", "pdf_id").agg(F.min("at").alias("first"))


READERS = {".csv": read_table, ".tsv": read_table, ".txt": read_text, ".md": read_text, ".zip": read_files, ".pdf": read_files}


def read_any(spark: SparkSession, path: str) -> DataFrame:
    """By suffix."""
    for suffix, reader in READERS.items():
        if path.lower().endswith(suffix):
            return reader(spark, path)
    raise ValueError(f"no reader for {path}")

"""The corpus pipeline: quality rules, near duplicates, benchmark passages, secrets, token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; it is written as Parquet and read
again as the next one's docs. All but the last return the columns of documents.

1.  quality     drops documents that the quality rules reject.
2.  near        keeps of each group of near duplicates the document of least id.
3.  benchmark   cuts passages of benchmark items; drops documents that are mostly such passages.
4.  secrets     replaces each secret in a text by its kind in brackets.
5.  tokens      adds the byte-level BPE ids (binary, little-endian unsigned 32-bit) and their number.

n_chars is kept equal to the length of the text that leaves a stage.

The session's setting spark.corundum.ledger names the folder of the secrets' ledger: a later run with
the same folder scans only texts that no run has scanned. Unset, a run has a ledger of its own.

Cases, in every stage: null and empty texts are documents without words, so quality drops them, and
the other stages pass them on as they are; of rows that share an id near keeps one, the others keep
them all; rows with a null id are kept; an empty table gives an empty result; columns beyond those of
documents are passed through whatever their names, and a result of the last stage whose name one of
them has gets underscores before it; very long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corundum.llm import bpe, decontaminate, ngram_join, quality, secrets
from corundum.llm.common import drop_all, free_name, table, work_dir, written
from corundum.llm.queries import tokenizer


def _counted(df: DataFrame) -> DataFrame:
    return df.withColumn("n_chars", F.length("text").cast(df.schema["n_chars"].dataType)) if "n_chars" in df.columns else df


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.filter_quality(docs, table(spark, sf_dir, "labels"))


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.deduplicate(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _counted(decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")))


def redacted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ledger = secrets.Ledger(spark, spark.conf.get("spark.corundum.ledger", None) or f"{work_dir(spark)}/ledger")
    ledger.update(docs, path="doc_id")
    spans = free_name(docs, "secret_spans")
    found = ledger.attach(docs, into=spans)
    return _counted(found.withColumn("text", secrets.redact(F.col("text"), F.col(spans))).drop(spans))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode(docs, tokenizer("byte_bpe_multi_50k.tiktoken"), keep=tuple(docs.columns))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", good),
    ("near", near),
    ("benchmark", benchmark),
    ("secrets", redacted),
    ("tokens", tokens),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), work_dir(spark)
    before = None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), folder, name)
        if before:  # nothing reads it any more
            drop_all(spark, folder, before)
        before = name
    return STAGES[-1][1](spark, docs, sf_dir)


#: Scores, components and token ids can't be said in SQL; a brute-force version tests the rows.
ORACLE_SQL = None

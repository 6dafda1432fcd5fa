"""Commands over the engine: python -m corundum.cli domains | schema | evaluate | batch | review-csv |
agents | check | web-links. Models and parsers are adapters: batch and review-csv are told theirs as
module:name of a factory that workers can import (see sources.adapters)."""

from __future__ import annotations

import argparse
import importlib
import json
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corundum.operators import checker, evaluate, extract
from corundum.operators.rank import Skill
from corundum.schemas import DOMAINS, TABLES, domain
from corundum.sources import tables, web
from corundum.sources.adapters import structured_schema
from corundum.sources.answers import Answers
from corundum.sources.store import EvidenceStore, export_csv

#: Tables that a check reads.
PARTS = ("documents", "evidence_blocks", "tables", "figures", "visual_tasks", "structure_detections", "diagnostics")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="corundum")
    sub = p.add_subparsers(dest="command", required=True)
    sub.add_parser("domains", help="list record types")
    schema = sub.add_parser("schema", help="the JSON Schema of a record type")
    schema.add_argument("--domain", required=True, choices=sorted(DOMAINS))
    score = sub.add_parser("evaluate", help="score a prediction CSV against a truth CSV")
    score.add_argument("--domain", required=True, choices=sorted(DOMAINS))
    for name in ("--pred", "--truth-csv"):
        score.add_argument(name, required=True)
    score.add_argument("--articles", help="a file of article ids, one a line")
    score.add_argument("--out")
    agents = sub.add_parser("agents", help="run evidence agents over a store")
    agents.add_argument("--store", required=True)
    for flag in ("table", "scaffold", "linking", "conflict"):
        agents.add_argument(f"--no-{flag}", action="store_true")
    check = sub.add_parser("check", help="how far a store's documents are from extraction")
    check.add_argument("--store", required=True)
    check.add_argument("--domain", choices=sorted(DOMAINS))
    check.add_argument("--top-k", type=int, default=16)
    check.add_argument("--out", required=True)
    for name, told in (("batch", "extract records from a folder of PDFs"), ("review-csv", "review a prediction CSV against its PDFs")):
        many = sub.add_parser(name, help=told)
        many.add_argument("--domain", required=True, choices=sorted(DOMAINS))
        many.add_argument("--pdf-dir", required=True)
        many.add_argument("--parser", required=True, help="module:name of a factory of bytes to pages")
        many.add_argument("--client", required=True, help="module:name of a factory of a request to its answer")
        many.add_argument("--answers", help="a folder that keeps the client's answers")
        many.add_argument("--max-pages", type=int)
        many.add_argument("--out", required=True)
        if name == "batch":
            many.add_argument("--pages-per-window", type=int, default=extract.Settings.pages_per_window)
            many.add_argument("--no-review", action="store_true")
        else:
            many.add_argument("--pred", required=True)
            many.add_argument("--passes", type=int, default=1)
    links = sub.add_parser("web-links", help="supplementary PDFs that fetched pages link to")
    links.add_argument("--pages", required=True, help="Parquet of page_id, url, html")
    links.add_argument("--out", required=True)
    return p


def scores(spark: SparkSession, key: str, pred: str, truth: str, articles: str | None = None) -> DataFrame:
    d = domain(key)
    wanted = tables.read_list(spark, articles) if articles else None
    return evaluate.evaluate(evaluate.prepare_truth(d, tables.read_table(spark, truth)), evaluate.prepare_prediction(d, tables.read_table(spark, pred)), list(d.columns), articles=wanted)


def run_agents(spark: SparkSession, folder: str, which: extract.Agents) -> DataFrame:
    """Agents over all documents of a store, which gets what they find; counts of that."""
    store = EvidenceStore(spark, folder)
    evidence = store.read("evidence_blocks")
    found, blocks = extract.run_agents(store.read("tables"), store.read("table_rows"), evidence, which, before={t: store.read(t) for t in TABLES if t.startswith("agent_")})
    store.put_agents(found, blocks, evidence.select("doc_id").distinct())
    return store.table_counts(*found)


def named(path: str) -> Callable:
    """The factory that module:name stands for."""
    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def pdf_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id (the file's name) and content of a folder's PDFs."""
    files = tables.read_files(spark, folder)
    return files.where(F.endswith(F.lower("name"), F.lit(".pdf"))).select(F.col("name").alias("doc_id"), "content")


def many(spark: SparkSession, a: argparse.Namespace) -> DataFrame:
    """The prediction table of batch or review-csv."""
    d, files, told = domain(a.domain), pdf_files(spark, a.pdf_dir), (named(a.parser), named(a.client))
    answers = Answers(spark, a.answers, a.client) if a.answers else None
    if a.command == "review-csv":
        return extract.review_files(tables.read_table(spark, a.pred), files, d, *told, passes=a.passes, settings=extract.Settings(max_pages=a.max_pages), answers=answers)
    settings = extract.Settings(a.pages_per_window, a.max_pages, not a.no_review)
    return extract.extract_files(files, d, *told, settings, answers)


def check(spark: SparkSession, folder: str, key: str | None, top: int) -> DataFrame:
    """How far each document is from each skill; for one skill also its report, with the best top
    pieces of evidence."""
    store = EvidenceStore(spark, folder)
    parts = {t: store.read(t) for t in PARTS}
    bundles = checker.bundle(*(parts[t] for t in PARTS))
    skills = [Skill.of(d) for d in DOMAINS.values() if key in (None, d.key)]
    evidence = checker.first_evidence(parts["evidence_blocks"])
    found = checker.check_skills(evidence, skills, bundles)
    return found if key is None else found.join(checker.report(evidence, skills[0], bundles, top=top), "doc_id", "left")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(argv)
    if a.command == "domains":
        print("\n".join(f"{d.key}\t{d.title}\t{len(d.columns)} columns" for d in DOMAINS.values()))
        return
    if a.command == "schema":
        print(json.dumps(structured_schema(domain(a.domain)), ensure_ascii=False, indent=2))
        return
    spark = spark or SparkSession.builder.appName("corundum").getOrCreate()
    if a.command == "evaluate":
        out = scores(spark, a.domain, a.pred, a.truth_csv, a.articles)
        if a.out:
            export_csv(out, a.out)
        out.show(100, truncate=False)
        evaluate.macro_f1(out).show()
    elif a.command in ("batch", "review-csv"):
        export_csv(many(spark, a), a.out)
    elif a.command == "agents":
        run_agents(spark, a.store, extract.Agents(not a.no_table, not a.no_scaffold, not a.no_linking, not a.no_conflict)).show(truncate=False)
    elif a.command == "check":
        check(spark, a.store, a.domain, a.top_k).write.mode("overwrite").json(a.out)
    else:
        export_csv(web.supplements(spark.read.parquet(a.pages)), a.out)


if __name__ == "__main__":
    main()

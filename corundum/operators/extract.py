"""From documents to records: evidence agents, what a model reads, its answers, their review, and
which of several ways of extraction a document's records come from. The model is an adapter: a
factory of a function of system text, prompt and images."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corundum.functions.values import pdf_identifier
from corundum.operators import evidence as agents
from corundum.operators.context import cut_context, document, parsed_document, window_text
from corundum.operators.evaluate import prepare_prediction
from corundum.operators.normalize import finalize
from corundum.schemas import Domain
from corundum.sources.adapters import Client, complete, parse_files, review_requests, sample_rows, window_requests
from corundum.sources.answers import Answers
from corundum.sources.folders import remove, scratch, settled

c = F.col


@dataclass(frozen=True)
class Settings:
    """How documents are read: pages of a window, pages in all (None: every one), whether answers
    are reviewed, and the characters of context that a review is given."""

    pages_per_window: int = 4
    max_pages: int | None = None
    review: bool = True
    review_context_chars: int = 60_000


@dataclass(frozen=True)
class Agents:
    """Which evidence agents run. Links need measurements, decisions need links: what isn't run is
    taken from before, or is missing."""

    measure: bool = True
    scaffold: bool = True
    link: bool = True
    decide: bool = True

    @property
    def any(self) -> bool:
        return self.measure or self.scaffold or self.link or self.decide


def run_agents(tables: DataFrame, rows: DataFrame, evidence: DataFrame, which: Agents = Agents(), *, before: dict[str, DataFrame] | None = None) -> tuple[dict[str, DataFrame], DataFrame]:
    """The agents' tables and their evidence blocks: measurements and scaffolds of the evidence that
    isn't the agents' own, links of measurements, decisions on links. Measurements are planned once
    and used thrice, so they are written in between."""
    known = dict(before or {})
    folder = scratch(evidence.sparkSession)
    told = evidence.where(~F.startswith(F.coalesce("source_type", F.lit("")), F.lit("agent_")))
    out: dict[str, DataFrame] = {}
    if which.measure:
        out["agent_table_measurements"] = settled(agents.measurements(tables, rows), f"{folder}/measurements")
    if which.scaffold:
        out["agent_scaffold_resolutions"] = agents.scaffolds(told)
    measured = out.get("agent_table_measurements", known.get("agent_table_measurements"))
    if which.link and measured is not None:
        out["agent_compound_links"] = settled(agents.compound_links(measured, agents.structures(told)), f"{folder}/links")
    links = out.get("agent_compound_links", known.get("agent_compound_links"))
    if which.decide and links is not None:
        out["agent_conflict_decisions"] = agents.conflict_decisions(links)
    return out, agents.agent_evidence(**{k: out.get(t) for k, t in (("measured", "agent_table_measurements"), ("links", "agent_compound_links"), ("decisions", "agent_conflict_decisions"), ("found", "agent_scaffold_resolutions"))})


def documents(parts: dict[str, DataFrame], which: Agents = Agents()) -> DataFrame:
    """Pages as a model reads them (context.document) of a scrape's tables, with what the agents find
    in them."""
    evidence = parts["evidence_blocks"]
    if which.any:
        _, found = run_agents(parts["tables"], parts["table_rows"], evidence, which)
        evidence = evidence.unionByName(found, allowMissingColumns=True)
    return document(parts["pages"], parts["tables"], parts["table_rows"], evidence)


def contexts(pages: DataFrame, limit: int) -> DataFrame:
    """doc_id, text: all pages of a document, cut at limit. Only pages that begin before the limit
    are put together (with the one that shows that there is more), whatever a document's length."""
    size = F.sum(F.length("whole") + 2).over(_in_order())
    near = pages.withColumn("begins", size - F.length("whole") - 2).where(c("begins") <= limit + 2)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "whole"))), lambda x: x["whole"]), "\n\n")
    return near.groupBy("doc_id").agg(cut_context(text, limit).alias("text"))


def _in_order():  # noqa: ANN202
    from pyspark.sql import Window

    return Window.partitionBy("doc_id").orderBy("page_number").rowsBetween(Window.unboundedPreceding, 0)


def _asked(requests: DataFrame, client: Client, answers: Answers | None) -> DataFrame:
    asked = requests.select("request_id", "system", "prompt", "images")
    return complete(asked, client) if answers is None else answers.ask(asked, client)


def candidates(pages: DataFrame, d: Domain, client: Client, settings: Settings = Settings(), answers: Answers | None = None) -> DataFrame:
    """doc_id and the domain's columns: the samples of every window of a document. answers keeps
    what the client tells, so that no window is asked again."""
    kept = pages if settings.max_pages is None else pages.where(c("page_number") <= settings.max_pages)
    requests = window_requests(window_text(kept, settings.pages_per_window), d)
    of_doc = F.regexp_replace("request_id", r":[^:]*\z", "")
    return sample_rows(_asked(requests, client, answers), d).withColumn("doc_id", of_doc).select("doc_id", *(c(f"`{x}`") for x in d.columns))


def reviewed(found: DataFrame, pages: DataFrame, d: Domain, client: Client, settings: Settings = Settings(), answers: Answers | None = None) -> DataFrame:
    """doc_id and the domain's columns: what a review keeps of a document's candidates."""
    requests = review_requests(found, contexts(pages, settings.review_context_chars), d)
    return sample_rows(_asked(requests, client, answers), d).withColumnRenamed("request_id", "doc_id")


def records(pages: DataFrame, d: Domain, client: Client, settings: Settings = Settings(), answers: Answers | None = None) -> DataFrame:
    """The domain's columns and pdf of all documents: windows, candidates, a review of documents that
    have any, final form. Candidates are written in between, so that no request is made twice."""
    found = settled(candidates(pages, d, client, settings, answers), f"{scratch(pages.sparkSession)}/candidates")
    if settings.review:
        found = settled(reviewed(found, pages, d, client, settings, answers), f"{scratch(pages.sparkSession)}/reviewed")
    named = found.withColumn("pdf", pdf_identifier(d, c("doc_id")))
    return finalize(d, named).select(*(c(f"`{x}`") for x in d.columns), "pdf")


def review_passes(predictions: DataFrame, pages: DataFrame, d: Domain, client: Client, *, passes: int = 1, settings: Settings = Settings(), answers: Answers | None = None) -> DataFrame:
    """predictions (the domain's columns and pdf) after passes reviews, each of what the one before
    gave. Only articles with pages are reviewed, the others go. A pass is written before the next."""
    folder = scratch(pages.sparkSession)
    ids = pages.select("doc_id", pdf_identifier(d, c("doc_id")).alias("pdf_of")).distinct()
    for k in range(max(1, passes)):
        found = predictions.withColumn("pdf", pdf_identifier(d, c("pdf"))).join(ids, c("pdf") == c("pdf_of")).select("doc_id", *(c(f"`{x}`") for x in d.columns))
        out = reviewed(found, pages, d, client, settings, answers).withColumn("pdf", pdf_identifier(d, c("doc_id")))
        predictions = settled(finalize(d, out).select(*(c(f"`{x}`") for x in d.columns), "pdf"), f"{folder}/pass{k}")
    return predictions


def extract_files(files: DataFrame, d: Domain, parser: Callable, client: Client, settings: Settings = Settings(), answers: Answers | None = None) -> DataFrame:
    """records() of a batch of files (doc_id, content), all at once: parsed once, written, then read in
    windows. A file that can't be parsed has no records."""
    pages = settled(parsed_document(parse_files(files, parser, first=settings.max_pages)), f"{scratch(files.sparkSession)}/pages")
    return records(pages, d, client, settings, answers)


def review_files(predictions: DataFrame, files: DataFrame, d: Domain, parser: Callable, client: Client, *, passes: int = 1, settings: Settings = Settings(), answers: Answers | None = None) -> DataFrame:
    """A prediction table (of any spelling that the scorer takes) after reviews under its articles'
    files; rows of articles without a file go."""
    pages = settled(parsed_document(parse_files(files, parser, first=settings.max_pages)), f"{scratch(files.sparkSession)}/pages")
    return review_passes(prepare_prediction(d, predictions), pages, d, client, passes=passes, settings=settings, answers=answers)


def first_with_records(docs: DataFrame, stages: list[tuple[str, Callable[[DataFrame], DataFrame]]], *, by: str = "doc_id") -> DataFrame:
    """Each document's records by the first of the stages that gives any, with the stage's name as
    method. A stage (name, function) gets the documents that no stage before has records of, and
    nothing else; what it gives is written before the next is planned, so each is made once."""
    folder = scratch(docs.sparkSession)
    left, parts = docs, []
    for k, (name, make) in enumerate(stages):
        found = settled(make(left).withColumn("method", F.lit(name)), f"{folder}/{k}")
        parts.append(found)
        if k + 1 < len(stages):
            left = settled(left.join(found.select(by).distinct(), by, "left_anti"), f"{folder}/left{k}")
            if k:
                remove(docs.sparkSession, f"{folder}/left{k - 1}")
            if left.isEmpty():
                break
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)

"""How far a scraped document is from extraction: what there is of it, which skills it fits, what is
left to do, and the reports on that. A document is a key, so a corpus is checked in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corundum.functions.text import cell
from corundum.functions.values import strip
from corundum.operators.rank import Skill, candidates, check_all, field_coverage, skill_check
from corundum.operators.recognition import structure_counts

#: Evidence that a check reads of each document, by page and id.
MOST_EVIDENCE = 5000

c = F.col


def bundle(documents: DataFrame, evidence: DataFrame, tables: DataFrame, figures: DataFrame, tasks: DataFrame, detections: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """A row a document: its newest source, diagnostics, how much of everything, evidence by kind.
    Counts are summed before they are joined, and missing parts count 0."""
    newest = documents.groupBy("doc_id").agg(F.max_by("source_path", F.struct("created_at", "source_path")).alias("source_path"))
    kinds = evidence.groupBy("doc_id", "source_type").agg(F.count("*").alias("n"))
    kinds = kinds.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("source_type", "n")))).alias("by_kind"), F.sum("n").alias("evidence"))
    count = lambda df, name: df.groupBy("doc_id").agg(F.count("*").alias(name))
    parts = [kinds, count(tables, "tables"), count(figures, "figures"), count(tasks, "visual_tasks"), structure_counts(evidence, detections), diagnostics.select("doc_id", "pages_count", "notes")]
    out = reduce(lambda a, b: a.join(b, "doc_id", "left"), parts, newest).na.fill(0, ["evidence", "tables", "figures", "visual_tasks", "smiles", "detections"])
    return out.withColumns({"by_kind": F.coalesce("by_kind", F.create_map().cast("map<string,bigint>")), "notes": F.coalesce("notes", F.array().cast("array<string>"))})


def first_evidence(evidence: DataFrame, most: int = MOST_EVIDENCE) -> DataFrame:
    """The evidence that a check reads: a document's first, by page and id."""
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_number", "evidence_id"))
    return evidence.withColumn("nth", nth).where(c("nth") <= most).drop("nth")


def kind_count(kind: str) -> Column:
    return F.coalesce(F.try_element_at("by_kind", F.lit(kind)), F.lit(0))


def pipeline_checks(bundles: DataFrame) -> DataFrame:
    """doc_id, name, status, detail: what a pipeline has produced of a document, and what hasn't come."""
    rows, captions = kind_count("table_row"), kind_count("table_caption") + kind_count("figure_caption")
    check = lambda name, good, bad, detail: F.struct(F.lit(name).alias("name"), F.when(good, "pass").otherwise(bad).alias("status"), detail.alias("detail"))
    n = lambda x, what: F.concat(x.cast("string"), F.lit(what))
    checks = F.array_compact(F.array(
        check("evidence_blocks", c("evidence") > 0, "fail", n(c("evidence"), " blocks of evidence")),
        check("table_rows", rows > 0, "warn", n(rows, " table rows")),
        check("captions", captions > 0, "warn", n(captions, " captions")),
        check("structure_smiles", c("smiles") > 0, "warn", n(c("smiles"), " structures")),
        F.when((c("visual_tasks") > 0) & (c("smiles") == 0), check("visual_followup", F.lit(False), "warn", n(c("visual_tasks"), " visual tasks wait"))),
    ))
    return bundles.select("doc_id", F.explode(checks).alias("x")).select("doc_id", "x.*")


def recommendations(checks: DataFrame, bundles: DataFrame, skill: Skill) -> DataFrame:
    """doc_id and advice, of skill_check() rows: what to do before this skill's records are extracted."""
    both = checks.join(bundles.select("doc_id", "smiles", "by_kind"), "doc_id", "left").withColumn("by_kind", F.coalesce("by_kind", F.create_map().cast("map<string,bigint>")))
    none = F.coalesce(c("smiles"), F.lit(0)) == 0
    advice = F.array_compact(F.array(
        F.when(none, "detect and read structures: records of this kind name them") if skill.needs_structure else F.lit(None).cast("string"),
        F.when(kind_count("table_row") == 0, "no table rows: look at table extraction, or read tables from images"),
        F.when(c("coverage") < 0.5, "evidence covers too few fields: route by this, don't extract"),
        F.when(c("best").isNotNull(), "give the best evidence and the skill's prompt to the first extraction"),
    ))
    return both.select("doc_id", advice.alias("advice"))


def check_skills(evidence: DataFrame, skills: list[Skill], bundles: DataFrame) -> DataFrame:
    """doc_id, skill, nth and what skill_check() says of each skill; nth 1 is the document's best. The
    evidence is read once for all skills."""
    every = check_all(evidence, skills, bundles.select("doc_id", "smiles", "detections", "visual_tasks"))
    return every.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("score"), "skill")))


def report(evidence: DataFrame, skill: Skill, bundles: DataFrame, *, top: int = 16) -> DataFrame:
    """A JSON report a document: check, fields, candidates and advice for one skill."""
    counts = bundles.select("doc_id", "smiles", "detections", "visual_tasks")
    checked = skill_check(evidence, skill, counts, top=top)
    fields = field_coverage(evidence, skill).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("field", "hits", "status"))).alias("fields"))  # as many as the skill has fields
    best = candidates(evidence, skill, top=top).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("rank", "score", "evidence_id", "matched_terms", "snippet"))).alias("candidates"))  # top at most
    out = checked.join(fields, "doc_id", "left").join(best, "doc_id", "left").join(recommendations(checked, bundles, skill), "doc_id", "left")
    return out.select("doc_id", F.to_json(F.struct(F.lit(skill.name).alias("skill"), "status", "score", "coverage", "fields", "candidates", "advice")).alias("report"))


def candidate_lines(found: DataFrame, skill: Skill) -> DataFrame:
    """doc_id, rank and line: each of rank.candidates() as one line of JSON under its skill."""
    told = F.struct(F.lit(skill.name).alias("skill"), "rank", "score", "evidence_id", "page_number", "source_type", "matched_terms", "snippet")
    return found.select("doc_id", "rank", F.to_json(told, {"ignoreNullFields": "false"}).alias("line"))


def report_markdown(reports: DataFrame) -> DataFrame:
    """doc_id and markdown of check_skills() rows with their skill: one table a document, best first."""
    line = F.concat(F.lit("| "), c("skill"), F.lit(" | "), c("status"), F.lit(" | "), F.format_string("%.3f", "score"), F.lit(" | "), F.format_string("%.3f", "coverage"), F.lit(" |"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("nth", line.alias("line")))), lambda x: x["line"])  # a line a skill
    head = F.array(F.lit("| skill | status | score | coverage |"), F.lit("| --- | --- | --- | --- |"))
    return reports.groupBy("doc_id").agg(lines.alias("lines")).select("doc_id", F.array_join(F.concat(head, "lines"), "\n").alias("markdown"))


def requests(best: DataFrame, skill: Skill, prompt: str) -> DataFrame:
    """A request for each document, as adapters.complete takes them: the skill's prompt, its fields and
    the chosen evidence (rank.select_balanced of rank.candidates) by rank."""
    item = F.struct("rank", "evidence_id", "page_number", "source_type", "matched_terms", "snippet")
    listed = best.groupBy("doc_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("evidence"))  # as many as were chosen
    told = F.concat(F.lit(f"Fields: {', '.join(skill.fields)}\nEvidence:\n"), "evidence")
    return listed.select("doc_id", c("doc_id").alias("request_id"), F.lit(prompt).alias("system"), told.alias("prompt"), F.lit(None).cast("array<binary>").alias("images"))


def final_table(answers: DataFrame, columns: tuple[str, ...], *, by: str = "doc_id") -> DataFrame:
    """by, markdown: the objects of a model's answer (JSON, a list or one object) as a table of these
    columns; null where the answer holds none."""
    v = F.try_parse_json("answer")
    listed = answers.select(by, v.alias("v")).withColumn("rows", F.coalesce(F.try_variant_get("v", "$", "array<variant>"), F.array("v")))
    rows = F.filter(F.transform("rows", lambda x: F.from_json(F.to_json(x), "map<string,string>")), lambda m: m.isNotNull())
    line = lambda m: F.concat(F.lit("| "), F.concat_ws(" | ", *(cell(F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(""))) for k in columns)), F.lit(" |"))
    head = F.array(F.lit("| " + " | ".join(columns) + " |"), F.lit("| " + " | ".join("---" for _ in columns) + " |"))
    return listed.withColumn("rows", rows).select(by, F.when(F.size("rows") > 0, F.array_join(F.concat(head, F.transform("rows", line)), "\n")).alias("markdown"))


def parsed_notes(notes: Column) -> Column:
    """Notes of diagnostics, kept as a JSON array, as strings; none if it isn't one."""
    return F.coalesce(F.from_json(F.when(F.startswith(strip(notes), F.lit("[")), notes), "array<string>"), F.array().cast("array<string>"))

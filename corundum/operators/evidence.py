"""Evidence operators: plan tables, read measurements, link structures, settle conflicts, find
scaffolds. All are keyed by doc_id, so that any number of documents run in one job."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corundum.functions import chemistry as chem
from corundum.functions.core import let, once
from corundum.functions.smiles import structure
from corundum.functions.values import stable_id
from corundum.schemas import MISSING

#: Rows of a table that its plan looks at.
SAMPLE_ROWS = 25
KEY = ["doc_id", "table_id"]


def _given(c: Column) -> Column:
    return c.isNotNull() & (c != "")


def _sum(base: float, *parts: tuple[Column, float], cap: float) -> Column:
    total = F.lit(base)
    for condition, worth in parts:
        total = total + F.when(condition, worth).otherwise(0.0)
    return F.least(total, F.lit(cap))


def sample(rows: DataFrame, limit: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows of each table."""
    first = Window.partitionBy(*KEY).orderBy("row_index", "row_id")
    return rows.withColumn("nth", F.row_number().over(first)).where(F.col("nth") <= limit)


def plan_tables(tables: DataFrame, rows: DataFrame) -> DataFrame:
    """doc_id, table_id, compound_index, target_type, target_units, measurement_columns (index,
    column, target_type, target_units, bacteria, confidence, reasons), confidence, reasons.

    One row a table, which holds its sample rows; they are unpivoted to cells and summed per column,
    columns per table."""
    t = tables.select(*KEY, F.coalesce("caption", F.lit("")).alias("caption"), F.coalesce("columns", F.array().cast("array<string>")).alias("columns"))
    few = sample(rows.select("doc_id", "table_id", "row_id", "row_index", "cells"))
    held = few.groupBy(*KEY).agg(F.array_sort(F.collect_list(F.struct("nth", "cells"))).alias("few"))  # SAMPLE_ROWS at most
    whole = F.array_join(F.concat(F.array("caption"), F.col("columns")), " | ")
    all_columns = F.concat(F.lit(" | "), F.array_join("columns", " | "))
    target = chem.target_type(F.concat(whole, F.when(F.size("columns") > 0, all_columns).otherwise(F.lit(""))))
    first_cells = F.coalesce(F.get("few", F.lit(0))["cells"], F.array().cast("array<string>"))
    head = t.join(held, KEY, "left").select("*", chem.compound_column(F.col("columns"), first_cells).alias("compound_index"), target.alias("target_type"), chem.unit_in_brackets(whole).alias("bracket_units"))
    head = head.withColumn("target_units", F.coalesce("bracket_units", chem.default_unit(F.col("target_type"))))

    of_table = (*KEY, "caption", "columns", "compound_index", "target_type", "target_units")
    cells = head.select(*of_table, F.explode("few").alias("row")).select(*of_table, "row.nth", F.posexplode("row.cells").alias("index", "cell")).where("compound_index is null or index <> compound_index")
    column = F.coalesce(F.get("columns", F.col("index")), F.lit(""))
    cells = once(cells.withColumn("column", column).where(~chem.no_value(F.col("cell"))), chem.measured_cell(F.col("cell"), F.col("column")), "hit")
    units_at = F.when(F.col("hit.units").isNotNull(), F.struct("nth", F.col("hit.units").alias("units")))
    per_column = cells.groupBy(*KEY, "index", "column", "caption", "columns", "target_type", "target_units").agg(F.count("hit").alias("hits"), F.count("*").alias("values"), F.min(units_at).alias("units_at")).where("hits > 0")
    near = chem.context(F.col("caption"), F.col("column"))
    own_target = F.coalesce(chem.target_type(F.when(F.size("columns") > 0, F.concat(near, all_columns)).otherwise(near)), F.col("target_type"))
    per_column = per_column.withColumn("own_target", own_target).where("own_target is not null")
    per_column = per_column.withColumn("own_units", F.coalesce("units_at.units", chem.unit_in_brackets(near), "target_units", chem.default_unit(F.col("own_target")))).withColumn("bacteria", chem.organism(F.col("column")))
    c = F.col
    reasons = F.array_compact(F.array(
        F.lit("numeric_cells"), F.concat(F.lit("bacteria:"), c("bacteria")), F.concat(F.lit("units:"), c("own_units")),
        F.when(c("own_target") == c("target_type"), "target_from_table").otherwise("target_from_column"),
    ))
    share = 0.45 + F.least(c("hits") / c("values"), F.lit(1.0)) * 0.2 + 0.12
    sure = F.least(share + F.when(c("own_units").isNotNull(), 0.08).otherwise(0.0) + F.when(c("bacteria").isNotNull(), 0.08).otherwise(0.0), F.lit(0.95))
    plan = F.struct("index", "column", c("own_target").alias("target_type"), c("own_units").alias("target_units"), "bacteria", sure.alias("confidence"), reasons.alias("reasons"))
    plans = per_column.groupBy(*KEY).agg(F.array_sort(F.collect_list(plan)).alias("measurement_columns"))  # as many as the table has columns

    out = head.join(plans, KEY, "left")
    n = F.coalesce(F.size("measurement_columns"), F.lit(0))
    mean = F.aggregate("measurement_columns", F.lit(0.0), lambda a, x: a + x["confidence"]) / n
    score = F.lit(0.35) + F.when(c("compound_index").isNotNull(), 0.2).otherwise(0.0) + F.when(c("target_type").isNotNull(), 0.18).otherwise(0.0) + F.when(n > 0, F.least(n, F.lit(5)) * 0.04 + mean * 0.15).otherwise(0.0)
    why = F.array_compact(F.array(
        F.when(c("compound_index").isNotNull(), "compound_column_detected"), F.concat(F.lit("table_target:"), c("target_type")),
        F.concat(F.lit("table_units:"), c("target_units")), F.when(n > 0, F.concat(F.lit("measurement_columns:"), n.cast("string"))),
    ))
    return out.select(*KEY, "compound_index", "target_type", "target_units", "measurement_columns", F.least(score, F.lit(0.96)).alias("confidence"), why.alias("reasons"))


def plan_records(plans: DataFrame) -> DataFrame:
    """doc_id, table_id and plan, a plan_tables() row as JSON."""
    columns = F.transform(F.coalesce("measurement_columns", F.array().cast(plans.schema["measurement_columns"].dataType)), lambda x: F.struct(*(x[n].alias(n) for n in ("index", "column", "target_type", "target_units", "bacteria", "confidence", "reasons"))))
    told = F.struct("table_id", F.col("compound_index").alias("compound_column_index"), "target_type", "target_units", "confidence", "reasons", columns.alias("measurement_columns"))
    return plans.select(*KEY, F.to_json(told, {"ignoreNullFields": "false"}).alias("plan"))


def measurements(tables: DataFrame, rows: DataFrame, plans: DataFrame | None = None) -> DataFrame:
    """A record for each planned column's value in each row: the schema of agent_table_measurements."""
    plans = plan_tables(tables, rows) if plans is None else plans
    t = tables.select(*KEY, "file_id", "page_number", "caption").join(plans.select(*KEY, "compound_index", "measurement_columns"), KEY)
    # An organism stands in one of the parts it is looked for in: what the column and the caption name is
    # known of the table, and most cells name none.
    t = t.withColumn("measurement_columns", F.transform("measurement_columns", lambda p: F.struct(*(p[n].alias(n) for n in ("index", "column", "target_type", "target_units", "bacteria")), chem.organism(chem.context(p["column"], F.col("caption"))).alias("around"))))
    # A hash table of a partition's tables, so that rows needn't be sorted.
    r = rows.select(*KEY, "row_id", "evidence_id", "row_index", "cells", "normalized_text").join(t.hint("shuffle_hash"), KEY)
    c = F.col
    text = chem.context(c("caption"), F.coalesce(F.nullif(c("normalized_text"), F.lit("")), F.array_join("cells", " | ")))
    def value(p: Column) -> Column:
        return let(F.get("cells", p["index"]), lambda cell: F.struct(p.alias("p"), cell.alias("cell"), chem.measured_cell(cell, p["column"]).alias("m")))

    def of_row(told: Column) -> Column:
        found = F.filter(F.transform(told, value), lambda x: x["m"].isNotNull())
        return F.when(F.size(told) > 0, F.struct(chem.compound_id(c("cells"), text, c("compound_index")).alias("compound_id"), found.alias("found")))

    # All that a row's cells tell is found in one step: each step that explodes copies the row.
    r = once(r, let(F.filter("measurement_columns", lambda p: ~chem.no_value(F.get("cells", p["index"]))), of_row), "of").where("of.compound_id is not null and of.compound_id <> ''")
    r = r.select(*KEY, "file_id", "page_number", "evidence_id", "caption", "of.compound_id", F.explode("of.found").alias("x")).select("*", "x.p", "x.cell", "x.m")
    units = F.coalesce("m.units", "p.target_units", chem.default_unit(c("p.target_type")))
    r = r.withColumn("units", units).withColumn("organism", F.coalesce("p.bacteria", F.when(c("cell").rlike(chem.EPITHET), chem.organism(chem.context(c("p.column"), c("cell"), c("caption")))).otherwise(c("p.around"))))
    blank = lambda x: F.coalesce(x, F.lit(""))
    record_id = stable_id("tm", c("evidence_id"), c("p.index"), c("compound_id"), c("p.target_type"), c("m.value"), blank(c("units")), blank(c("organism")))
    raw = F.when(c("p.column") != "", F.concat(c("p.column"), F.lit(": "), c("cell"))).otherwise(c("cell"))
    sure = _sum(0.58 + 0.1 + 0.1 + 0.1, (c("units").isNotNull(), 0.07), (c("organism").isNotNull(), 0.05), cap=0.95)
    return r.select(
        record_id.alias("record_id"), "doc_id", "file_id", "page_number", "table_id", "evidence_id", "compound_id", c("p.target_type").alias("target_type"),
        F.coalesce("m.relation", F.lit("=")).alias("target_relation"), c("m.value").alias("target_value"), F.coalesce("units", F.lit(MISSING)).alias("target_units"),
        F.coalesce("organism", F.lit(MISSING)).alias("bacteria"), raw.alias("raw_text"), sure.alias("confidence"),
    )


def structures(evidence: DataFrame) -> DataFrame:
    """doc_id, compound_id, smiles_evidence_id, smiles, canonical_smiles and confidence of evidence
    that holds a structure. A text that is no structure is its own canonical form."""
    c = F.col
    found = evidence.where("source_type = 'chemical_structure_smiles'").select("doc_id", c("evidence_id").alias("smiles_evidence_id"), "metadata", "text", "caption", "confidence")
    found = once(found, chem.smiles_of_text(c("text")), "smiles").where("smiles is not null")
    found = once(found, chem.compound_of_smiles(c("metadata"), c("text"), c("caption")), "compound_id").where("compound_id is not null")
    return found.select("doc_id", "smiles_evidence_id", "compound_id", "smiles", "confidence", F.coalesce(structure(c("smiles"))["canonical"], c("smiles")).alias("canonical_smiles"))


def compound_links(measured: DataFrame, smiles: DataFrame) -> DataFrame:
    """Each measurement with each structure of its compound, or with none: the schema of
    agent_compound_links."""
    c = F.col
    m = measured.select("record_id", "doc_id", "file_id", "page_number", "compound_id", "bacteria", "target_type", "target_value", "target_units")
    s = smiles.select("doc_id", "compound_id", "smiles_evidence_id", "smiles", "canonical_smiles", c("confidence").alias("smiles_confidence"))
    # By a shuffle, whatever a guess of the structures' size: links are then settled in its partitions,
    # not by a sort of all that a task reads.
    linked = m.join(s.hint("merge"), ["doc_id", "compound_id"], "left")
    found = c("smiles_evidence_id").isNotNull()
    sure = F.lit(0.54) + F.when(found, 0.25).otherwise(0.0) + F.when(found & c("smiles_confidence").isNotNull(), F.least("smiles_confidence", F.lit(1.0)) * 0.08).otherwise(0.0)
    sure = sure + F.when(c("bacteria") != MISSING, 0.05).otherwise(0.0) + F.when(c("target_units") != MISSING, 0.04).otherwise(0.0)
    return linked.select(
        stable_id("cl", c("record_id"), F.coalesce("smiles_evidence_id", F.lit("missing"))).alias("link_id"), "doc_id", "file_id", "page_number", "compound_id",
        c("record_id").alias("measurement_record_id"), "smiles_evidence_id", F.coalesce("smiles", F.lit(MISSING)).alias("smiles"), F.coalesce("canonical_smiles", F.lit(MISSING)).alias("canonical_smiles"),
        "bacteria", "target_type", "target_value", "target_units", F.least(sure, F.lit(0.96)).alias("confidence"), F.when(found, "accepted").otherwise("needs_review").alias("status"),
        F.when(found, F.array().cast("array<string>")).otherwise(F.array(F.lit("missing_structure_smiles"))).alias("issues"),
    )


def conflict_decisions(links: DataFrame) -> DataFrame:
    """One decision for each compound, target, value, unit and organism of a document: its best link,
    for review if any link is incomplete or its structures differ."""
    c = F.col
    key = ["doc_id", "compound_id", "target_type", "target_value", "target_units", "bacteria"]
    best = F.struct(F.coalesce("confidence", F.lit(0.0)).alias("confidence"), F.struct("link_id", "file_id", "page_number", "canonical_smiles").alias("of"))
    # The first of equals is the one of least link_id: the order is full, so no run differs.
    rank = F.min(F.struct((-best["confidence"]).alias("order"), c("link_id").alias("tie"), best["of"].alias("of")))
    known = F.when(c("canonical_smiles") != MISSING, c("canonical_smiles"))
    g = links.groupBy(*key).agg(rank.alias("b"), F.min(known).alias("least"), F.max(known).alias("most"), F.max(F.when(c("status") != "accepted", 1).otherwise(0)).alias("open"))
    differ = F.coalesce(c("least") != c("most"), F.lit(False))
    issues = F.array_compact(F.array(F.when(c("open") == 1, "incomplete_link"), F.when(differ, "conflicting_smiles")))
    sure = -c("b.order")
    sure = F.when(c("open") == 1, F.least(sure, F.lit(0.62))).otherwise(sure)
    sure = F.when(differ, F.least(sure, F.lit(0.55))).otherwise(sure)
    reason = F.when(differ, "its links name several structures").when(c("open") == 1, "a link lacks its structure").otherwise("the best supported link")
    canonical = F.struct("compound_id", c("b.of.canonical_smiles").alias("smiles"), "target_type", "target_value", "target_units", "bacteria", c("b.of.link_id").alias("source_link_id"), issues.alias("issues"))
    return g.select(
        stable_id("cr", *(c(k) for k in key[1:])).alias("decision_id"), "doc_id", c("b.of.file_id").alias("file_id"), c("b.of.page_number").alias("page_number"), "compound_id",
        F.when(F.size(issues) > 0, "needs_review").otherwise("accepted").alias("decision"), reason.alias("reason"), canonical.alias("canonical"), sure.alias("confidence"),
    )


SCAFFOLD_SOURCES = ("paragraph", "table_caption", "figure_caption", "table_row", "chemical_structure_smiles")


def scaffolds(evidence: DataFrame) -> DataFrame:
    """Evidence that speaks of a scaffold or of variable sites: agent_scaffold_resolutions."""
    c = F.col
    blank = lambda x: F.coalesce(c(x), F.lit(""))
    text = F.concat_ws(" | ", blank("caption"), blank("title"), blank("text"))
    found = evidence.where(c("page_number").isNotNull() & c("source_type").isin(*SCAFFOLD_SOURCES)).withColumn("whole", text).where(c("whole").rlike(chem.SCAFFOLD)).withColumn("variable_sites", chem.variable_sites(c("whole")))
    open_ = F.size("variable_sites") > 0
    return found.select(
        stable_id("sr", c("evidence_id"), F.array_join("variable_sites", ",")).alias("scaffold_id"), "doc_id", "file_id", "page_number", c("evidence_id").alias("source_evidence_id"),
        F.when(open_, "needs_review").otherwise("detected").alias("status"), F.coalesce(chem.compound_range(c("whole")), F.lit(MISSING)).alias("compound_range"), "variable_sites",
        F.when(open_, "variable sites are named; what stands at them has to be put together by hand").otherwise("a scaffold is named").alias("reason"),
    )


def _joined(sep: str, *pairs: tuple[str, Column]) -> Column:
    return F.concat_ws(sep, *(F.concat(F.lit(f"{k}="), F.coalesce(v.cast("string"), F.lit("None"))) for k, v in pairs))


def agent_evidence(measured: DataFrame | None = None, links: DataFrame | None = None, decisions: DataFrame | None = None, found: DataFrame | None = None) -> DataFrame:
    """What the agents found, those that ran, as evidence blocks."""
    c = F.col
    names = F.array_join
    block = lambda df, kind, key, title, caption, text, sure: df.select(F.concat(c(key), F.lit(":evidence")).alias("evidence_id"), "doc_id", "file_id", "page_number", F.lit(kind).alias("source_type"), title.alias("title"), caption.alias("caption"), text.alias("text"), sure.alias("confidence"))
    k = c("canonical")
    parts = [
        measured is not None and block(measured, "agent_table_measurement", "record_id", c("table_id"), c("compound_id"), F.concat(F.lit("Agent table measurement: "), _joined(" | ", *((n, c(f)) for n, f in (("compound_id", "compound_id"), ("target_type", "target_type"), ("relation", "target_relation"), ("target_value", "target_value"), ("target_units", "target_units"), ("bacteria", "bacteria"), ("source_table", "table_id"), ("source_evidence", "evidence_id"), ("raw", "raw_text"))))), c("confidence")),
        links is not None and block(links, "agent_compound_link", "link_id", c("compound_id"), c("status"), F.concat(F.lit("Agent compound link: "), _joined(" | ", *((n, c(n)) for n in ("compound_id", "canonical_smiles", "target_type", "target_value", "target_units", "bacteria", "status")), ("issues", F.coalesce(F.nullif(names("issues", ","), F.lit("")), F.lit("none"))), ("measurement_record_id", c("measurement_record_id")), ("smiles_evidence_id", F.coalesce("smiles_evidence_id", F.lit(MISSING))))), c("confidence")),
        decisions is not None and block(decisions, "agent_conflict_decision", "decision_id", c("compound_id"), c("decision"), F.concat(F.lit("Agent conflict decision: "), _joined(" | ", ("decision", c("decision")), *((n, k[n]) for n in ("compound_id", "smiles", "target_type", "target_value", "target_units", "bacteria")), ("reason", c("reason")))), c("confidence")),
        found is not None and block(found, "agent_scaffold_resolution", "scaffold_id", c("source_evidence_id"), c("status"), F.concat(F.lit("Agent scaffold resolution: "), _joined(" | ", ("status", c("status")), ("compound_range", c("compound_range")), ("variable_sites", F.coalesce(F.nullif(names("variable_sites", ","), F.lit("")), F.lit(MISSING))), ("source_evidence", c("source_evidence_id")), ("reason", c("reason")))), F.when(F.size("variable_sites") > 0, 0.72).otherwise(0.58)),
    ]
    return reduce(DataFrame.unionByName, [p for p in parts if p is not False])

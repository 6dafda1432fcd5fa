"""Steps whose work has to grow no faster than their input."""

import os
import tracemalloc

import pandas as pd
import pyarrow as pa
from pyspark.sql import functions as F

from corundum.functions import chemistry
from corundum.operators import evidence, stages, work
from corundum.plans import visuals
from corundum.sources import adapters, answers
from corundum.sources.answers import Answers


def test_a_page_has_one_list_of_nearby_evidence(spark):
    figures = spark.range(40).select(F.lit("d").alias("doc_id"), F.format_string("f%02d", "id").alias("figure_id"), (1 + F.col("id") % 2).cast("int").alias("page_number"))
    figures = figures.unionByName(figures.limit(1).withColumns({"figure_id": F.lit("none"), "page_number": F.lit(None).cast("int")}))
    kind = F.when(F.col("id") % 3 == 0, "table_row").when(F.col("id") % 3 == 1, "paragraph").otherwise("section_heading")
    evidence = spark.range(300).select(F.lit("d").alias("doc_id"), (1 + F.col("id") % 4).cast("int").alias("page_number"), F.format_string("e%03d", "id").alias("evidence_id"), kind.alias("source_type"), F.lit(" a  b ").alias("text"))
    found = {r["page_number"]: [x["evidence_id"] for x in r["nearby"]] for r in work.nearby_evidence(figures, evidence, 30).collect()}
    told = [(r["page_number"], 0 if r["source_type"] == "table_row" else 1, r["evidence_id"]) for r in evidence.collect() if r["source_type"] != "section_heading"]
    near = lambda p: [e for *_, e in sorted((q != p, k, e) for q, k, e in told if abs(q - (p or 1)) <= (1 if p else 0))][:30]
    assert found == {p: near(p) for p in (1, 2, None)}


def test_a_large_call_is_dealt_to_a_bounded_number_of_tasks(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(answers, "PER_TASK", 1)
    asked = spark.range(0, 2_500, 1, 4).select(F.col("id").cast("string").alias("request_id"), F.lit("s").alias("system"), F.col("id").cast("string").alias("prompt"), F.lit(None).cast("array<binary>").alias("images"))
    found = Answers(spark, f"file://{tmp_path}/a").ask(asked, lambda: lambda system, prompt, images: f"told {prompt}")
    assert found.where("content = 'told ' || request_id").count() == 2_500
    files = [f for _, _, names in os.walk(f"{tmp_path}/a") for f in names if f.startswith("part-")]
    assert 1000 < len(files) <= 2000


def test_images_are_drawn_a_few_at_a_time():
    keys = pd.DataFrame({"s_suppkey": range(1000), "s_nationkey": [k % 25 for k in range(1000)]})
    drawn = [(len(x), list(x.task_id)) for x in visuals._draw(iter([keys]))]
    assert max(n for n, _ in drawn) <= 64 and [k for _, ks in drawn for k in ks] == [str(k) for k in range(1000)]


def test_requests_are_taken_and_answered_a_few_at_a_time(spark):
    """How many requests of one task were asked when its first answers left it."""
    asked = spark.range(0, 1000, 1, 1).select(F.col("id").cast("string").alias("request_id"), F.lit("s").alias("system"), F.lit("p").alias("prompt"), F.array(F.lit("x").cast("binary")).alias("images"))

    def client():
        n = [0]

        def ask(system, prompt, images):
            n[0] += 1
            return f"{n[0]} {system} {prompt} {images!r}"

        return ask

    sizes = adapters.complete(asked, client).mapInArrow(lambda batches: batches, adapters.ANSWER)
    assert sizes.count() == 1000 and sizes.where("content like '1000 s p [b%x%]' and error is null").count() == 1
    run = complete_batches(asked, client)
    assert max(run) <= adapters.AT_ONCE and sum(run) == 1000


def complete_batches(asked, client):
    """Sizes of the batches that complete() gives for one batch of all requests."""
    given = []

    class Requests:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            given.extend(b.num_rows for b in run(iter(asked.toArrow().to_batches())))

    adapters.complete(Requests(), client)
    return given


def test_large_requests_are_held_one_at_a_time(spark):
    """Most bytes of Python's objects while a batch of 64 requests of 1 MB is answered at such length."""
    rows = [{"request_id": str(k), "system": "s", "prompt": "p" * 1_000_000, "images": None} for k in range(64)]
    batch = pa.RecordBatch.from_pylist(rows, pa.schema([("request_id", pa.string()), ("system", pa.string()), ("prompt", pa.string()), ("images", pa.list_(pa.binary()))]))
    told = []

    class Requests:
        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            tracemalloc.start()
            for b in run(iter([batch])):
                told.extend((r["request_id"], len(r["content"]), r["error"]) for at in range(b.num_rows) for r in b.slice(at, 1).to_pylist())
            told.append(tracemalloc.get_traced_memory()[1])
            tracemalloc.stop()

    adapters.complete(Requests(), lambda: lambda system, prompt, images: prompt + "!")
    assert told.pop() < 10_000_000 and told == [(str(k), 1_000_001, None) for k in range(64)]


def test_rows_of_tables_are_read_twice(spark):
    """Once for the plans, once for the values."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    tables = spark.range(5).select(F.lit("d").alias("doc_id"), F.lit("f").alias("file_id"), F.lit(1).alias("page_number"), F.col("id").cast("string").alias("table_id"), F.lit("MIC values").alias("caption"), F.array(F.lit("Compound"), F.lit("Value")).alias("columns"))
    rows = spark.range(200).select(F.lit("d").alias("doc_id"), (F.col("id") % 5).cast("string").alias("table_id"), F.col("id").cast("string").alias("row_id"), F.col("id").cast("string").alias("evidence_id"), F.col("id").cast("int").alias("row_index"), F.array(F.lit("6a"), F.concat(F.col("id").cast("string"), F.lit(" mM"))).alias("cells"), F.lit(None).cast("string").alias("normalized_text"))
    found = evidence.measurements(tables, rows.mapInPandas(counted, rows.schema)).select("evidence_id", "target_value").collect()
    assert sorted(found) == sorted((str(k), str(k)) for k in range(200)) and read.value == 400


def test_a_cell_and_a_structure_are_read_once(spark):
    """A split at a pattern compiles it for each text; a condition on what a text holds reads it again."""
    text = spark.range(1).select(F.lit("e").alias("evidence_id"), F.lit("d").alias("doc_id"), F.lit("chemical_structure_smiles").alias("source_type"), F.lit(None).cast("string").alias("metadata"), F.concat(F.lit("smiles=C"), "id").alias("text"), F.lit("6a").alias("caption"), F.lit(0.9).alias("confidence"))
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(evidence.structures(text)).count("canonical_smiles|smiles") == 1
    found = plan(text.select(chemistry.measured(F.col("text"))))
    assert "split(" in found and found.count("split(") == found.count("split(regexp_replace(")


def test_links_are_settled_behind_a_shuffle(spark):
    measured = spark.range(10).select(F.col("id").cast("string").alias("record_id"), F.col("id").cast("string").alias("doc_id"), F.lit("f").alias("file_id"), F.lit(1).alias("page_number"), F.lit("6a").alias("compound_id"), F.lit("E. coli").alias("bacteria"), F.lit("MIC").alias("target_type"), F.lit("1").alias("target_value"), F.lit("mM").alias("target_units"))
    known = spark.range(2).select(F.col("id").cast("string").alias("doc_id"), F.lit("6a").alias("compound_id"), F.col("id").cast("string").alias("smiles_evidence_id"), F.lit("C").alias("smiles"), F.lit("C").alias("canonical_smiles"), F.lit(0.9).alias("confidence"))
    decided = evidence.conflict_decisions(evidence.compound_links(measured, known))
    assert "Broadcast" not in decided._jdf.queryExecution().executedPlan().toString()
    assert sorted((r["doc_id"], r["decision"]) for r in decided.where("doc_id < 4").collect()) == [("0", "accepted"), ("1", "accepted"), ("2", "needs_review"), ("3", "needs_review")]


def test_stages_send_no_ids_through_the_driver(spark, tmp_path):
    ledger = stages.StageLedger(spark, f"file://{tmp_path}/stages")
    docs = spark.range(20).select(F.col("id").cast("string").alias("doc_id"), F.lit("t").alias("text"))
    stage = stages.Stage("first", "doc_id string, text string", lambda d, _: d)
    found = [stages.run_stages(docs, [stage], ledger)["first"] for _ in range(2)][1]
    assert found.count() == 20 and "BroadcastExchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_figures_and_crops_are_read_once_for_two_agents(spark):
    """Both agents' requests, and what is joined to their answers, are of rows that were written."""
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            read.add(len(b))
            yield b

    place = (F.lit("d").alias("doc_id"), F.lit("f").alias("file_id"), F.lit(1).alias("page_number"))
    figures = spark.range(7).select(*place, F.format_string("f%d", "id").alias("figure_id"), *(F.lit(n).alias(n) for n in ("label", "caption", "image_path", "kind")))
    boxes = spark.range(40).select(F.lit("d").alias("doc_id"), F.format_string("f%d", F.col("id") % 5).alias("parent_figure_id"), F.format_string("x%02d", "id").alias("detection_id"), F.lit("i").alias("image_path"), F.lit(None).cast("array<double>").alias("bbox"), F.lit("C").alias("smiles"), F.lit(0.5).alias("confidence"))
    none = spark.range(0).select(*place, F.lit("e").alias("evidence_id"), F.lit("table_row").alias("source_type"), F.lit("t").alias("text"))
    items = work.figure_items(figures, none, boxes.mapInPandas(counted, boxes.schema), none, most_crops=2)
    found = work.two_agents(items, visuals._two, ("analyse", "read")).select("figure_id", "detection_id").collect()
    assert sorted(map(tuple, found)) == [(f"f{k}", f"x{k:02d}") for k in range(5)] and read.value == 40


def test_values_of_a_row_are_found_in_one_step(spark):
    """Rows are copied by each step that explodes; a join brings them only what is read of a plan."""
    tables = spark.range(1).select(F.lit("d").alias("doc_id"), F.lit("f").alias("file_id"), F.lit(1).alias("page_number"), F.lit("t").alias("table_id"), F.lit("MIC against E. coli").alias("caption"), F.array(F.lit("Compound"), F.lit("Value"), F.lit("S. aureus")).alias("columns"))
    rows = spark.range(2).select(F.lit("d").alias("doc_id"), F.lit("t").alias("table_id"), F.col("id").cast("string").alias("row_id"), F.col("id").cast("string").alias("evidence_id"), F.col("id").cast("int").alias("row_index"), F.array(F.lit("6a"), F.when(F.col("id") == 0, "<= 1,5 mM").otherwise("2 uM, S. aureus"), F.lit("3")).alias("cells"), F.lit(None).cast("string").alias("normalized_text"))
    plans = evidence.plan_tables(tables, rows).localCheckpoint()
    found = evidence.measurements(tables, rows, plans)
    assert sorted(tuple(r) for r in found.select("evidence_id", "target_relation", "target_value", "bacteria").collect()) == [
        ("0", "<=", "1.5", "Escherichia coli"), ("0", "=", "3", "Staphylococcus aureus"), ("1", "=", "2", "Staphylococcus aureus"), ("1", "=", "3", "Staphylococcus aureus"),
    ]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 2

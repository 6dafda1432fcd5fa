import pytest
from pyspark.sql import functions as F

from corundum.operators import evidence as e
from corundum.schemas import MISSING
from corundum.operators import extract
from corundum.sources.store import EvidenceStore

TABLE = "doc_id string, file_id string, page_number int, table_id string, caption string, columns array<string>"
ROW = "doc_id string, table_id string, row_id string, evidence_id string, row_index int, cells array<string>, normalized_text string"
BLOCK = "evidence_id string, doc_id string, file_id string, page_number int, source_type string, title string, caption string, text string, metadata string, confidence double"


@pytest.fixture(scope="module")
def tables(spark):
    t = spark.createDataFrame([("d", "f", 1, "t1", "MIC values against Staphylococcus aureus", ["compound", "MIC", "bacteria"]), ("d", "f", 1, "t2", "Antimicrobial activity using the agar diffusion method. Inhibition Zone Diameters (mm)", ["Compound", "S. aureus", "P. aeruginosa", "E. coli", "S. typhosa"])], TABLE)
    r = spark.createDataFrame([("d", "t1", "r1", "e1", 1, ["6a", "MIC 4 µg/mL", "S. aureus"], None), ("d", "t2", "r2", "e2", 1, ["63a", "28", "26", "21", "19"], None)], ROW)
    return t, r


def test_one_measurement(tables):
    found = e.measurements(*tables).where("table_id = 't1'").collect()
    assert [(r.compound_id, r.target_type, r.target_value, r.target_units, r.bacteria) for r in found] == [("6a", "MIC", "4", "µg/mL", "Staphylococcus aureus")]


def test_wide_table(tables):
    found = e.measurements(*tables).where("table_id = 't2'").collect()
    assert {(r.bacteria, r.target_value) for r in found} == {("Staphylococcus aureus", "28"), ("Pseudomonas aeruginosa", "26"), ("Escherichia coli", "21"), ("Salmonella typhosa", "19")}
    assert {(r.compound_id, r.target_type, r.target_units) for r in found} == {("63a", "INHIBITION_ZONE", "mm")}
    plan = e.plan_tables(*tables).where("table_id = 't2'").first()
    first = plan.measurement_columns[0]
    assert plan.compound_index == 0 and first["index"] == 1 and first.confidence > 0.8
    assert first.reasons == ["numeric_cells", "bacteria:Staphylococcus aureus", "units:mm", "target_from_table"]


def smiles(spark, *rows):
    return spark.createDataFrame([(i, "d", "f", 1, "chemical_structure_smiles", None, None, f"structure | compound_id={c} | smiles={s}", None, 0.9) for i, c, s in rows], BLOCK)


def test_links_and_decisions(spark, tables):
    m = e.measurements(*tables)
    links = e.compound_links(m, e.structures(smiles(spark, ("s1", "6a", "CCO"))))
    assert links.where("status = 'accepted'").count() == 1 and links.where("status = 'needs_review'").count() == 4
    by = {r.compound_id: r for r in e.conflict_decisions(links).collect()}
    assert by["6a"].decision == "accepted" and by["6a"].canonical.smiles == "CCO"
    assert by["63a"].decision == "needs_review" and by["63a"].confidence <= 0.62 and by["63a"].canonical.smiles == MISSING


def test_conflicting_structures(spark, tables):
    links = e.compound_links(e.measurements(*tables), e.structures(smiles(spark, ("s1", "6a", "CCO"), ("s2", "6a", "CCN"))))
    d = e.conflict_decisions(links).where("compound_id = '6a'").first()
    assert d.decision == "needs_review" and d.confidence == 0.55 and d.canonical.issues == ["conflicting_smiles"]


def test_documents_do_not_mix(spark, tables):
    other = smiles(spark, ("s1", "6a", "CCO")).withColumn("doc_id", F.lit("another"))
    assert e.compound_links(e.measurements(*tables), e.structures(other)).where("status = 'accepted'").count() == 0


def test_scaffolds(spark):
    rows = spark.createDataFrame([("e5", "d", "f", 1, "table_caption", None, None, "Table 1. MIC values for compounds 6a-6c with R1 substituents.", None, 0.7), ("e6", "d", "f", 1, "paragraph", None, None, "nothing", None, 0.7), ("e7", "d", "f", None, "paragraph", None, None, "scaffold", None, 0.7)], BLOCK)
    got = e.scaffolds(rows).collect()
    assert [(r.source_evidence_id, r.status, r.compound_range, r.variable_sites) for r in got] == [("e5", "needs_review", "6a-6c", ["R1"])]


def test_empty_tables(spark, tables):
    none = spark.createDataFrame([], ROW)
    assert e.measurements(tables[0], none).count() == 0
    assert e.plan_tables(tables[0], none).count() == 2


def test_store(spark, tables, tmp_path):
    s = EvidenceStore(spark, str(tmp_path), buckets=4)
    m = e.measurements(*tables)
    s.write("agent_table_measurements", m)
    s.write("agent_table_measurements", m.unionByName(m.withColumn("doc_id", F.lit("d2"))))
    assert s.read("agent_table_measurements").groupBy("doc_id").count().count() == 2
    s.write("agent_table_measurements", m.limit(1))
    assert {r["doc_id"]: r["count"] for r in s.read("agent_table_measurements").groupBy("doc_id").count().collect()} == {"d": 1, "d2": 5}
    s.upsert("agent_table_measurements", m, "record_id")
    assert s.read("agent_table_measurements").where("doc_id = 'd'").count() == 5
    s.clear("agent_table_measurements", spark.createDataFrame([("d",)], "doc_id string"), compound_id="6a")
    assert s.read("figures").count() == 0


def test_store_clears_and_resets(spark, tmp_path):
    s = EvidenceStore(spark, f"{tmp_path}/s", buckets=4)
    rows = [("e1", "d1", "agent_x"), ("e2", "d2", "agent_x"), ("e3", "d2", None), ("e4", "d3", "agent_x"), ("e5", None, "agent_x")]
    s.write("evidence_blocks", spark.createDataFrame(rows, "evidence_id string, doc_id string, source_type string"))
    left = lambda: sorted(r.evidence_id for r in s.read("evidence_blocks").collect())
    s.clear("evidence_blocks", spark.createDataFrame([("d1",), ("d2",)], "doc_id string"), source_type="agent_x")
    assert left() == ["e3", "e4", "e5"]  # d1 is empty now; a null is no agent_x
    s.write("evidence_blocks", spark.createDataFrame([], "evidence_id string, doc_id string"), spark.createDataFrame([("d3",), ("d9",)], "doc_id string"))
    assert left() == ["e3", "e5"]
    # A row filed under another document goes with its table.
    s.write("tables", spark.createDataFrame([("t", "d2")], "table_id string, doc_id string"))
    s.write("table_rows", spark.createDataFrame([("r1", "d7", "t", "x"), ("r2", "d7", "u", "e3"), ("r3", "d7", "u", "x")], "row_id string, doc_id string, table_id string, evidence_id string"))
    s.reset(spark.createDataFrame([("d2",)], "doc_id string"))
    assert left() == ["e5"] and [r.row_id for r in s.read("table_rows").collect()] == ["r3"] and s.read("tables").count() == 0
    assert {r.table_name: r.n for r in s.table_counts("tables", "evidence_blocks", "figures").collect()} == {"tables": 0, "evidence_blocks": 1, "figures": 0}


def test_agents_into_the_store(spark, tables, tmp_path):
    s = EvidenceStore(spark, f"{tmp_path}/s", buckets=4)
    s.write("tables", tables[0])
    s.write("table_rows", tables[1])
    told = spark.createDataFrame([("own", "d", "paragraph", "a scaffold with R1"), ("old", "d", "agent_compound_link", "x")], "evidence_id string, doc_id string, source_type string, text string").withColumns({"file_id": F.lit("f"), "page_number": F.lit(1), "caption": F.lit(None).cast("string"), "title": F.lit(None).cast("string"), "metadata": F.lit(None).cast("string"), "confidence": F.lit(0.5)})
    s.write("evidence_blocks", told)
    for _ in range(2):  # a second run leaves the same
        found, blocks = extract.run_agents(s.read("tables"), s.read("table_rows"), s.read("evidence_blocks"))
        s.put_agents(found, blocks, told.select("doc_id"))
        n = {r.table_name: r.n for r in s.table_counts(*found).collect()}
        kinds = {r.source_type: r.n for r in s.counts(told).collect()}
        assert n["agent_table_measurements"] == n["agent_compound_links"] == 5 and n["agent_scaffold_resolutions"] == 1
        assert kinds["agent_compound_link"] == 5 and kinds["paragraph"] == 1 and kinds["agent_scaffold_resolution"] == 1
    some, blocks = extract.run_agents(s.read("tables"), s.read("table_rows"), s.read("evidence_blocks"), extract.Agents(measure=False, scaffold=False, link=False), before={"agent_compound_links": s.read("agent_compound_links")})
    assert list(some) == ["agent_conflict_decisions"] and blocks.count() == some["agent_conflict_decisions"].count()

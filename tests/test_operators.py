import numpy as np
import pytest
from pyspark.sql import functions as F

from corundum.operators import context, evaluate, heuristics, jobs, layout, normalize, rank, route, scrape, visual
from corundum.schemas import DOMAINS, MISSING

METRICS = ("tp", "fp", "fn", "precision", "recall", "f1")


def test_multiset_counts(spark):
    truth = spark.createDataFrame([("p", "a"), ("p", "a"), ("p", "b")], "pdf string, x string")
    pred = spark.createDataFrame([("P", "a"), ("p", "b"), ("p", "b"), ("q", "z")], "pdf string, x string")
    r = evaluate.evaluate(truth, pred, ["x"]).first()
    assert [round(r[m], 6) for m in METRICS] == [2, 1, 1, 0.666667, 0.666667, 0.666667]
    assert evaluate.macro_f1(evaluate.evaluate(truth, pred, ["x"])).first()[0] == pytest.approx(2 / 3)


def test_means_over_articles(spark):
    truth = spark.createDataFrame([("p", "a"), ("q", "a")], "pdf string, x string")
    pred = spark.createDataFrame([("p", "a")], "pdf string, x string")
    assert evaluate.evaluate(truth, pred, ["x"]).first().f1 == 0.5
    wanted = spark.createDataFrame([("P",), ("p",), ("none",)], "article string")
    assert evaluate.evaluate(truth, pred, ["x"], articles=wanted).first().f1 == pytest.approx(2 / 3)
    nothing = evaluate.evaluate(truth.where("false"), pred, ["x"]).collect()
    assert [tuple(r[m] for m in METRICS) for r in nothing] == [(0.0,) * 6]


def test_truth_of_eyedrops(spark):
    df = spark.createDataFrame([("CCO", "n", "-5,2", "-0,3", "", "123456", "0")], "smiles string, name string, `perm (cm/s)` string, logP string, doi string, PMID string, access string")
    r = evaluate.prepare_truth(DOMAINS["eyedrops"], df).first()
    assert (r["pdf"], r["perm (cm/s)"], r["logP"]) == ("123456", "-5.2", "-0.3")


def test_open_access_only_if_any(spark):
    df = spark.createDataFrame([("a", "1", "'='"), ("b", "0", "<")], "pdf string, access string, target_relation string")
    got = evaluate.prepare_truth(DOMAINS["benzimidazole"], df).collect()
    assert [(r.pdf, r.target_relation) for r in got] == [("a", "=")]


def test_prediction_aliases_and_missing_columns(spark):
    df = spark.createDataFrame([("x.pdf", "1,5")], "pdf string, target_value string")
    r = evaluate.prepare_prediction(DOMAINS["complexes"], df).first()
    assert r["pdf"] == "x" and r["target"] == "1.5" and r["SMILES"] == MISSING


def test_samples_of_synergy(spark):
    df = spark.createDataFrame([("Ag", "E. coli", "12.5", "")], "NP string, Bacteria string, `ZOI_drug_mm_or_MIC_µg_ml` string, drug string")
    d = DOMAINS["synergy"]
    out = normalize.normalize_samples(d, df)
    r = out.first()
    assert tuple(out.columns) == d.columns
    assert (r["bacteria"], r["ZOI_drug_mm_or_MIC _µg_ml"], r["drug"]) == ("E. coli", "12.5", MISSING)


def test_samples_of_nanozymes(spark):
    df = spark.createDataFrame([("p", "0.12", None, "13", None, "25"), ("p", None, None, "9", "4", "rt"), ("q", None, None, None, "5", "x")], "pdf string, km_value string, vmax_value string, length string, width string, temperature string")
    got = {(r.pdf, r.length, r.width, r.depth, r.temperature) for r in normalize.finalize(DOMAINS["nanozymes"], df).collect()}
    assert got == {("p", "13", "13", "13", "25.0"), ("q", MISSING, "5", "5", "x")}
    named = normalize.sample_frame(DOMAINS["nanozymes"], df.drop("pdf"), F.lit("dir/a.pdf"))
    assert named.columns[-1] == "pdf" and {r.pdf for r in named.collect()} == {"a"}


def test_sections_cross_pages(spark):
    rows = [("d", "f", 1, 0, "Introduction to the whole matter"), ("d", "f", 1, 1, "short"), ("d", "f", 2, 0, "A paragraph that is long enough to stay."), ("d", "f", 2, 1, "Table 2. Something measured in it")]
    blocks = spark.createDataFrame(rows, "doc_id string, file_id string, page_number int, block_index int, text string").withColumn("bbox", F.lit(None).cast("array<double>"))
    out = scrape.text_evidence(blocks).orderBy("evidence_id").collect()
    assert [(r.evidence_id, r.source_type, r.section) for r in out] == [("d:f:p0001:text:0001", "section_heading", "Introduction to the whole matter"), ("d:f:p0002:text:0001", "paragraph", "Introduction to the whole matter"), ("d:f:p0002:text:0002", "table_caption", "Introduction to the whole matter")]


def test_markdown_and_page_text(spark):
    t = spark.createDataFrame([("d", "t", 1, "Table 1", "Kinetic constants", ["material", "Km"])], "doc_id string, table_id string, page_number int, label string, caption string, columns array<string>")
    r = spark.createDataFrame([("d", "t", 1, "r1", ["CeO2", "0.2 mM", "a|b"]), ("d", "t", 2, "r2", [" ", "", None])], "doc_id string, table_id string, row_index int, row_id string, cells array<string>")
    assert context.table_markdown(t, r).first().markdown == "Table 1. Kinetic constants\n\n| material | Km |  |\n| --- | --- | --- |\n| CeO2 | 0.2 mM | a/b |"
    pages = spark.createDataFrame([("d", 1, " Page text "), ("d", 2, " as is ")], "doc_id string, page_number int, text string")
    e = spark.createDataFrame([("e1", "d", 1, "table_caption", None, None, "Table 1", " Kinetic "), ("e2", "d", 1, "paragraph", None, None, None, "no")], "evidence_id string, doc_id string, page_number int, source_type string, section string, title string, caption string, text string")
    got = {r.page_number: r.context for r in context.page_text(pages, e).collect()}
    assert got == {1: "Page text\n\nSCRAPER EVIDENCE\ntable_caption | Table 1: Kinetic", 2: " as is "}


def test_captions_by_position(spark):
    t = spark.createDataFrame([("d", 1, f"t{k}") for k in range(3)], "doc_id string, page_number int, table_id string")
    caps = spark.createDataFrame([("d", 1, "e1", "A"), ("d", 1, "e2", "B")], "doc_id string, page_number int, evidence_id string, text string")
    assert {r.table_id: r.caption_text for r in context.captioned(t, caps).collect()} == {"t0": "A", "t1": "B", "t2": "B"}


def test_cut_context(spark):
    df = spark.createDataFrame([("line one\nline two\nline three",)], "x string")
    assert df.select(context.cut_context(F.col("x"), 0)).first()[0] == ""
    assert df.select(context.cut_context(F.col("x"), 20)).first()[0] == "line one\nline two\n[truncated]"
    assert df.select(context.cut_context(F.col("x"), 99)).first()[0] == "line one\nline two\nline three"


def test_tasks_of_pages_and_figures(spark):
    pages = spark.createDataFrame([("d", "f", 1, "p1", "a table " + "x" * 600), ("d", "f", 2, "p2", "brief")], "doc_id string, file_id string, page_number int, page_id string, text string")
    tables = spark.createDataFrame([], "doc_id string, file_id string, page_number int")
    rows = spark.createDataFrame([("d", ["6a", "1"]), ("d", ["6b", "2"])], "doc_id string, cells array<string>")
    figures = spark.createDataFrame([("f1", "d", "f", 1, "scheme", "Synthesis of hybrids"), ("f2", "d", "f", 2, "figure", "Docking pose")], "figure_id string, doc_id string, file_id string, page_number int, kind string, caption string")
    got = {r.task_id: r.priority for r in route.route(pages, tables, rows, figures).collect()}
    assert got == {"d:f:p0001:table_ocr": 75, "d:f:p0002:document_ocr": 90, "f1:structure_detection": 85, "f1:ocsr": 80, "f2:vlm_describe": 60}
    assert [r.priority for r in route.queue(route.route(pages, tables, rows, figures), 2).collect()] == [90, 85]


def test_terms_and_skill(spark):
    assert rank.field_terms("target_value") == ("target_value", "target value", "target", "value")
    rows = [("d", f"e{k}", k, "table_row", f"MIC of compound_id {k}, target type MIC", 0.9) for k in range(4)]
    e = spark.createDataFrame(rows, "doc_id string, evidence_id string, page_number int, source_type string, text string, confidence double")
    skill = rank.Skill.of(DOMAINS["benzimidazole"])
    assert skill.needs_structure
    best = rank.candidates(e, skill, top=2).orderBy("rank").collect()
    assert [r.evidence_id for r in best] == ["e0", "e1"] and best[0].score > 4
    structures = spark.createDataFrame([("d", 1, 0, 0)], "doc_id string, smiles int, detections int, visual_tasks int")
    assert rank.skill_check(e, skill, structures).first().status in ("partial_evidence", "ready_for_single_agent_review")
    assert rank.skill_check(e, skill, structures.withColumn("smiles", F.lit(0))).first().status == "needs_visual_or_ocsr"
    assert rank.variant_score(e, ("mic",)).first().hits == 4


def test_equal_scores_go_by_page(spark):
    """2.3 is 2 + 0.3 and, added up, a little more as 1 + 0.5 + 0.7 + 0.1: that isn't a better score."""
    rows = [("d", "e1", 1, "paragraph", "password strain", 0.8), ("d", "e2", 2, "paragraph", "strain and 5 ZnO", 0.6)]
    e = spark.createDataFrame(rows, "doc_id string, evidence_id string, page_number int, source_type string, text string, confidence double")
    best = rank.candidates(e, rank.Skill("s", ("strain",), ("password",)), top=2).orderBy("rank").collect()
    assert [(r.evidence_id, r.score) for r in best] == [("e1", 2.3), ("e2", 2.3)]


def test_terms_of_chemistry_are_whole_words(spark):
    texts = ["a DOTA, b", "dotaí", "ñdota", "éMIC", "ZnO-rods", "\u212am of it"]  # the last in Kelvin's sign
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").where(F.col("t").rlike(rank.CHEMISTRY)).select("i").collect()
    assert sorted(r.i for r in got) == [0, 4, 5]


def test_lines_spans_and_rows(spark):
    spans = [("d", 1, k, t, float(x0), float(y0), float(x1), y0 + 8.0) for k, (t, x0, y0, x1) in enumerate([("6a", 10, 100, 20), ("4", 50, 101, 55), ("(", 56, 102, 58), ("5)", 59, 100, 65), ("-", 90, 103, 92), ("6b", 10, 120, 20), ("7", 50, 121, 52), ("8", 90, 120, 92), ("The end", 10, 140, 60)])]
    df = spark.createDataFrame(spans, "doc_id string, page_number int, span_id int, text string, x0 double, y0 double, x1 double, y1 double")
    lines = layout.cluster_lines(df)
    assert lines.select("line").distinct().count() == 3
    merged = layout.merge_spans(lines, by=["doc_id", "page_number", "line"])
    cells = merged.groupBy("doc_id", "page_number", "line").agg(F.transform(F.array_sort(F.collect_list(F.struct("x0", "text"))), lambda s: s["text"]).alias("cells"))
    assert [r.cells for r in layout.data_rows(cells, by=["doc_id", "page_number"]).orderBy("line").collect()] == [["6a", "4 (5)", "-"], ["6b", "7", "8"]]
    columns = spark.createDataFrame([("d", 0, 10.0), ("d", 1, 50.0)], "doc_id string, index int, column_x double")
    heads = spark.createDataFrame([("d", 1, 12.0), ("d", 2, 30.0), ("d", 3, 99.0)], "doc_id string, span_id int, x0 double")
    assert [r["index"] for r in layout.nearest_column(heads, columns, by=["doc_id"]).orderBy("span_id").collect()] == [0, 0, 1]
    wide = layout.padded(spark.createDataFrame([("t", ["a"]), ("t", ["a", "b"])], "table_id string, cells array<string>"), by=["table_id"])
    assert {tuple(r.cells) for r in wide.collect()} == {("a", ""), ("a", "b")}


def test_figure_box(spark):
    df = spark.createDataFrame([(100.0, 500.0, 300.0, 600.0), (100.0, 30.0, 300.0, 600.0)], "x0 double, y0 double, x1 double, w double")
    got = [r[0] for r in df.select(layout.figure_box(*(F.col(c) for c in ("x0", "y0", "x1", "w")))).collect()]
    assert got == [[40.0, 164.0, 560.0, 494.0], None]


def test_components_of_a_grid():
    rng = np.random.default_rng(1)
    for _ in range(20):
        grid = rng.random((9, 13)) < 0.4
        label = visual.grid_components(grid)
        seen = {}
        for y, x in zip(*np.nonzero(grid)):  # a flood fill
            if (y, x) in seen:
                continue
            todo, name = [(y, x)], (y, x)
            while todo:
                a, b = todo.pop()
                if 0 <= a < 9 and 0 <= b < 13 and grid[a, b] and (a, b) not in seen:
                    seen[a, b] = name
                    todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        pairs = {(seen[y, x], label[y, x]) for y, x in zip(*np.nonzero(grid))}
        assert len(pairs) == len({a for a, _ in pairs}) == len({b for _, b in pairs})


def test_structures_in_an_image(spark):
    rgb = np.full((240, 320, 3), 255, np.uint8)
    rgb[20:100, 30:130] = (200, 30, 30)
    rgb[140:220, 180:290] = (30, 30, 200)
    rgb[5, 300] = 0
    boxes = visual.structure_boxes(rgb)
    assert boxes == [(22, 12, 137, 107), (172, 132, 297, 227)]
    df = spark.createDataFrame([("t", 320, 240, bytearray(rgb.tobytes()))], "task_id string, width int, height int, pixels binary")
    assert [(r.box_index, r.confidence) for r in visual.detect(df).orderBy("box_index").collect()] == [(0, 0.72), (1, 0.72)]
    assert visual.merge_boxes([(0, 0, 40, 40), (45, 0, 90, 40), (200, 0, 240, 40)], (400, 300)) == [(0, 0, 90, 40), (200, 0, 240, 40)]


def test_accepting_structures(spark):
    rows = [("C", "valid", "N", "valid", None), ("C", "invalid", "N", "valid", False), ("C", "not_checked", "N", "not_checked", False), ("", "invalid", "", "invalid", None), ("C", "valid", "N", "valid", True)]
    got = visual.accept(spark.createDataFrame(rows, "model_smiles string, model_validity string, recognised_smiles string, recognised_validity string, open_scaffold boolean")).collect()
    assert [(r.final_smiles, r.validation_status) for r in got] == [("C", "accepted"), ("N", "accepted"), ("C", "needs_review"), (MISSING, "rejected"), (MISSING, "rejected")]
    crops = spark.createDataFrame([(20, 50), (40, 45), (400, 40), (100, 60)], "w int, h int").select(visual.crop_problem(F.col("w"), F.col("h")).alias("p")).collect()
    assert [(r.p or "ok").split(":")[0] for r in crops] == ["crop is too small", "crop area is too small", "crop aspect ratio is too extreme", "ok"]
    flags = spark.createDataFrame([("C*.N", 0.3), ("C", None)], "s string, c double").select(visual.quality_flags(F.col("s"), F.col("c"))).collect()
    assert [r[0] for r in flags] == [["low_confidence", "wildcard_or_r_group", "multiple_components_or_fragment"], []]


def test_records(spark):
    text = spark.createDataFrame([("d", "AgNPs and TiO2 had size of 20 nm, MIC of 5 ug/mL; doi 10.1000/abc.1")], "doc_id string, text string")
    got = heuristics.records_from_text(text, nano=True).orderBy("object_id").collect()
    assert [(r.object_id, r.primary_value, r.property, r.evidence, r.confidence) for r in got] == [("nano-001", "AgNPs", "MIC of 5 ug/mL", "10.1000/abc.1", "0.78"), ("nano-002", "TiO2", "size of 20 nm", "10.1000/abc.1", "0.79")]
    rows = spark.createDataFrame([("d", 1, {"compound": "6a", "MIC": "4"}), ("d", 2, {"other": "x"})], "doc_id string, nth long, row map<string,string>")
    got = heuristics.records_from_rows(rows).orderBy("confidence").collect()
    assert [(r.object_id, r.primary_value, r.property, r.evidence, r.confidence) for r in got] == [("obj-001", "6a", "4", "6a", "0.73"), ("obj-002", "x", "x", "x", "0.74")]
    answer = spark.createDataFrame([("d", '{"records":[{"object_id":"mol-1","primary_value":"CCO","property":"MIC 1 ug/mL","confidence":0.91}]}'), ("e", "not json")], "doc_id string, answer string")
    r = heuristics.records_from_model(answer).collect()
    assert [(x.object_id, x.primary_value, x.property, x.confidence) for x in r] == [("mol-1", "CCO", "MIC 1 ug/mL", "0.91")]
    samples = spark.createDataFrame([("p", "6a", "CCO", "MIC", MISSING)], "pdf string, compound_id string, smiles string, target_type string, bacteria string")
    r = heuristics.records_from_samples(samples, ("compound_id", "smiles", "target_type", "bacteria")).first()
    assert (r.object_id, r.primary_value, r.property) == ("6a", "CCO", "target_type=MIC")


def test_dashboard(spark):
    j = spark.createDataFrame([("j1", "Benzimidazoles", "completed", 5.0, 0.612, 2, "k"), ("j2", "Benzimidazoles", "running", 6.0, 0.999, 9, "")], "job_id string, domain string, status string, updated_at double, macro_f1 double, record_count long, api_key string")
    domains = spark.createDataFrame([("EyeDrops", None), ("Benzimidazoles", 0.217)], "domain string, baseline double")
    board = jobs.dashboard(j, domains)
    got = {r.domain: r for r in board.collect()}
    assert got["EyeDrops"].current is None and got["Benzimidazoles"].delta == 0.395 and got["Benzimidazoles"].run_count == 1
    s = jobs.summary(board, j).first()
    assert (s.tracked_domains, s.completed_runs, s.total_rows, s.avg_current) == (1, 1, 2, 0.612)
    view = jobs.public_view(j)
    assert "api_key" not in view.columns and {r.api_key_configured for r in view.collect()} == {True, False}
    assert {r.status for r in jobs.interrupted(j).collect()} == {"completed", "interrupted"}

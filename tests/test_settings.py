"""Prompt files, skills, environment, model settings and commands."""

import json

import pytest
from pyspark.sql import functions as F

from corundum import cli
from corundum.operators import checker, rank, recognition, scrape
from corundum.sources import prompts
from corundum.sources.store import EvidenceStore


def test_prompt_files_are_read_not_run(tmp_path):
    (tmp_path / "metals.py").write_text('import nothing_like_it\nINSTRUCTIONS = "Find alloys carefully"\nPROMPT = """Give {"alloy_name": x, `grain (um)`: y}"""\nSHORT_PROMPT = "only \'alloy_name\': it"\nN = 3\nX = f(1)\n')
    (tmp_path / "none.py").write_text("A = 'no prompt'")
    known = prompts.prompt_skills(tmp_path, {"metals": ("steel",)})
    assert list(known) == ["metals"]
    s = known["metals"]
    assert list(s.prompts) == ["default", "short"] and s.fields == ("alloy_name", "grain (um)")
    assert s.keywords == ("steel", "alloy_name", "alloy", "name", "grain (um)", "grain", "Find", "alloys", "carefully")
    assert prompts.select_skills(known, "Metals") == ([s], None)
    every, warning = prompts.select_skills(known, "glass")
    assert every == [s] and "glass" in warning
    assert s.skill().terms[:2] == ("steel", "alloy_name")


def test_front_matter(tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "SKILL.md").write_text("---\nname: b\ndescription: does: this\n---\n\nText\n")
    assert prompts.read_skill(tmp_path, "a") == {"name": "b", "description": "does: this", "prompt": "Text"}
    assert prompts.front_matter("no head") == ({}, "no head")
    with pytest.raises(FileNotFoundError, match="there are a"):
        prompts.read_skill(tmp_path, "z")


def test_environment(tmp_path, monkeypatch):
    monkeypatch.setenv("CORUNDUM_SET", "old")
    monkeypatch.setenv("CORUNDUM_NEW", "")
    monkeypatch.delenv("CORUNDUM_NEW")
    (tmp_path / ".env").write_text("# c\nCORUNDUM_SET=new\nexport CORUNDUM_NEW = 'x y'\nbroken\n")
    assert prompts.load_env(tmp_path / ".env") == {"CORUNDUM_NEW": "x y"}
    monkeypatch.setenv("ODD_ONE_API_KEY", "k")
    monkeypatch.setenv("LLM_BASE_URL", "https://m.org/v1/")
    monkeypatch.setenv("LLM_MAX_TOKENS", "many")
    m = prompts.ModelConfig.of("odd-one", default_model="m")
    assert m.url == "https://m.org/v1/chat/completions" and m.max_tokens == 1800 and m.model == "m"
    assert "api_key" not in m.public() and m.public()["api_key_configured"]
    with pytest.raises(ValueError, match="NO_KEY_API_KEY"):
        prompts.ModelConfig.of("no-key")


def test_aliases(tmp_path):
    (tmp_path / "a.csv").write_text("field,alias\noutline,rod\nKm_Value,affinity\n,x\n")
    known = prompts.read_aliases(tmp_path / "a.csv")
    assert known["outline"] == ("rod",) and "Michaelis" in known["km_value"]
    assert rank.field_terms("outline", known) == ("outline", "rod")
    assert rank.field_terms("KM_value", known)[-2:] == ("Michaelis", "kinetic")


def test_commands(spark, tmp_path, capsys):
    cli.main(["domains"])
    assert "nanozymes\tNanozymes\t20 columns" in capsys.readouterr().out
    cli.main(["schema", "--domain", "eyedrops"])
    assert json.loads(capsys.readouterr().out)["required"] == ["samples"]
    (tmp_path / "t.csv").write_text("pdf,smiles,name,perm (cm/s),logP\na.pdf,C,x,1,2\n")
    (tmp_path / "p.csv").write_text("pdf,SMILES,name,perm,logP\na,C,y,1,2\n")
    cli.main(["evaluate", "--domain", "eyedrops", "--pred", str(tmp_path / "p.csv"), "--truth-csv", str(tmp_path / "t.csv"), "--out", str(tmp_path / "out")], spark)
    assert "0.75" in capsys.readouterr().out
    store = EvidenceStore(spark, f"{tmp_path}/s")
    store.write("documents", spark.createDataFrame([("d", "d.pdf")], "doc_id string, source_path string"))
    store.write("evidence_blocks", spark.createDataFrame([("e", "d", "paragraph", 1, "MIC of compound 5a 3 mM")], "evidence_id string, doc_id string, source_type string, page_number int, text string"))
    cli.main(["check", "--store", f"{tmp_path}/s", "--domain", "benzimidazole", "--out", str(tmp_path / "check")], spark)
    assert spark.read.json(str(tmp_path / "check")).where("nth = 1").count() == 1
    cli.main(["agents", "--store", f"{tmp_path}/s", "--no-conflict"], spark)
    assert "agent_compound_links" in capsys.readouterr().out


STANDINS = """
import json, re

def parser():
    def parse(content):
        if content == b"broken":
            raise ValueError("no PDF")
        return [{"text": t} for t in content.decode().split("|")]
    return parse

def client():
    def ask(system, prompt, images):
        with open(LOG, "a") as f:
            f.write(prompt[-40:].replace(chr(10), " ") + chr(10))
        if "Candidates:" in prompt:
            samples = json.loads(prompt.split("Candidates:\\n", 1)[1])["samples"]
            return json.dumps({"samples": [s for s in samples if s["name"] in prompt.split("Candidates:")[0]]})
        return json.dumps([{"name": n, "smiles": "CCO", "logP": v} for n, v in re.findall(r"drug (\\w+) has (\\d+)", prompt)])
    return ask
"""


def test_batch_commands(spark, tmp_path, monkeypatch):
    """A folder of files to a prediction CSV, twice with kept answers, and that CSV reviewed."""
    (tmp_path / "standins.py").write_text(f"LOG = {str(tmp_path / 'log')!r}\n" + STANDINS)
    monkeypatch.syspath_prepend(str(tmp_path))
    spark.sparkContext.addPyFile(str(tmp_path / "standins.py"))
    pdfs = tmp_path / "pdfs"
    pdfs.mkdir()
    for name, text in (("a.pdf", b"drug x has 1|drug y has 2"), ("B.PDF", b"drug z has 3"), ("c.pdf", b"broken"), ("note.txt", b"drug n has 9")):
        (pdfs / name).write_bytes(text)
    told = ["--domain", "eyedrops", "--pdf-dir", str(pdfs), "--parser", "standins:parser", "--client", "standins:client", "--answers", f"file://{tmp_path}/answers"]
    read = lambda out: sorted((r["pdf"], r["name"], r["logP"]) for r in spark.read.csv(out, header=True).collect())
    for out in ("one", "two"):
        cli.main(["batch", *told, "--out", str(tmp_path / out)], spark)
        assert [r[1:] for r in read(str(tmp_path / out))] == [("z", "3"), ("x", "1"), ("y", "2")]
    assert len((tmp_path / "log").read_text().splitlines()) == 4  # a window and a review of two files, asked once
    (tmp_path / "pred.csv").write_text("pdf,SMILES,name,logP\na,C,x,1\na,C,lost,1\nb,C,z,3\nnone,C,x,1\n")
    cli.main(["review-csv", *told, "--pred", str(tmp_path / "pred.csv"), "--passes", "2", "--out", str(tmp_path / "reviewed")], spark)
    assert [r[1] for r in read(str(tmp_path / "reviewed")) if r[0].startswith("a")] == ["x"]


def test_recogniser_batches(spark):
    def factory():
        def ask(images):
            if any(i == b"bad" for i in images):
                raise RuntimeError("no")
            return [{"smiles": i.decode(), "confidence": 0.9} for i in images]

        return ask

    rows = [("d", str(i), 100, 100, c) for i, c in enumerate([b"C", b"CC", b"null", b"bad"])] + [("d", "9", 5, 5, b"C")]
    crops = spark.createDataFrame(rows, "doc_id string, detection_id string, width int, height int, content binary").coalesce(1)
    got = {r.detection_id: (r.outcome, r.clean_smiles) for r in recognition.judged(recognition.recognise(crops, factory, batch=3)).collect()}
    assert got == {"0": ("completed", "C"), "1": ("completed", "CC"), "2": ("skipped", ""), "3": ("failed", ""), "9": ("skipped", "")}


def test_reports(spark):
    rows = spark.createDataFrame([("d", 1, "a", "ready", 0.7, 0.5), ("d", 2, "b", "low", 0.1, 0.0)], "doc_id string, nth int, skill string, status string, score double, coverage double")
    assert checker.report_markdown(rows).first().markdown.split("\n")[2:] == ["| a | ready | 0.700 | 0.500 |", "| b | low | 0.100 | 0.000 |"]
    notes = spark.createDataFrame([('["x","y"]',), ("broken",), (None,)], "n string")
    assert [r[0] for r in notes.select(checker.parsed_notes(F.col("n"))).collect()] == [["x", "y"], [], []]


def test_a_whole_scrape(spark):
    pages = spark.createDataFrame([("d", "main", 1, 600.0, 800.0, "x" * 60)], "doc_id string, file_id string, page_number int, width double, height double, text string")
    block = lambda i, text, n=1: ("d", "main", 1, i, text, [50.0, 400.0, 250.0, 420.0], n)
    blocks = spark.createDataFrame([block(0, "Table 1. MIC of compounds"), block(1, "Compound MIC A. niger", 3), block(2, "5a 1 2", 3), block(3, "Figure 2. Activity of samples")], "doc_id string, file_id string, page_number int, block_index int, text string, bbox array<double>, first_spans int")
    at = [(1, "a", "Compound", 0.0), (1, "b", "MIC A. niger", 100.0), (2, "a", "5a", 0.0), (2, "b", "1", 100.0), (2, "c", "2", 200.0)]
    spans = spark.createDataFrame([("d", "main", 1, b, s, t, x, 20.0 * b, x + 5, 20.0 * b + 9) for b, s, t, x in at], "doc_id string, file_id string, page_number int, block_index int, span_id string, text string, x0 double, y0 double, x1 double, y1 double")
    raw = spark.createDataFrame([], "doc_id string, file_id string, page_number int, table_index int, raw array<array<string>>")
    parts = scrape.scrape(pages, blocks, spans, raw)
    t = parts["tables"].first()
    assert t.columns == ["Compound", "MIC", "A. niger"] and t.label == "Table 1"
    kinds = {r.source_type: r["count"] for r in parts["evidence_blocks"].groupBy("source_type").count().collect()}
    assert kinds == {"table_caption": 1, "figure_caption": 1, "table_row": 1, "figure_image": 1, "paragraph": 1}
    d = parts["diagnostics"].first()
    assert (d.tables_count, d.table_rows_count, d.figures_count, d.notes) == (1, 1, 1, [])

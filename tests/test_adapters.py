import json

from pyspark.sql import functions as F

from corundum.operators import context, normalize
from corundum.schemas import DOMAINS, MISSING
from corundum.sources import adapters


def parser():
    def parse(content):
        if not content:
            raise ValueError("an empty file")
        return [{"text": t, "tables": []} for t in content.decode().split("\f")]

    return parse


def client():
    def ask(system, prompt, images):
        if "fail" in prompt:
            raise RuntimeError("no answer")
        value = prompt.rsplit("MIC ", 1)[1].split()[0]
        return "```json\n" + json.dumps({"samples": [{"compound_id": "6a", "target_value": value, "unknown": 1}]}) + "\n```"

    return ask


def test_from_files_to_records(spark):
    files = spark.createDataFrame([("d", b"MIC 4 of 6a\fsecond page\fthird"), ("e", b"")], "doc_id string, content binary")
    pages = adapters.parse_files(files, parser, first=2)
    got = {(r.doc_id, r.page_number, r.text, r.error) for r in pages.collect()}
    assert got == {("d", 1, "MIC 4 of 6a", None), ("d", 2, "second page", None), ("e", None, None, "an empty file")}
    d = DOMAINS["benzimidazole"]
    windows = spark.createDataFrame([("d", 0, "MIC 4 of 6a"), ("d", 1, "fail")], "doc_id string, window int, text string")
    answers = adapters.complete(adapters.window_requests(windows, d), client)
    assert {(r.request_id, r.error) for r in answers.collect()} == {("d:0", None), ("d:1", "no answer")}
    rows = adapters.sample_rows(answers, d)
    r = normalize.normalize_samples(d, rows, keep=("request_id",)).collect()
    assert [(x.request_id, x.compound_id, x.target_value, x.smiles) for x in r] == [("d:0", "6a", "4", MISSING)]


def test_payloads(spark):
    cases = {'{"a":1}': '{"a":1}', "```json\n[1,2]\n```": "[1,2]", 'Here: [1, {"b":2}] ok': '[1,{"b":2}]', 'so {"a":{"b":1}}.': '{"a":{"b":1}}', "none": None}
    df = spark.createDataFrame(list(cases.items()), "x string, y string")
    assert all(a == b for a, b in df.select(F.to_json(adapters.json_payload(F.col("x"))), "y").collect())


def test_schemas():
    for d in DOMAINS.values():
        item = adapters.structured_schema(d, with_evidence=True)["properties"]["samples"]["items"]
        assert item["required"] == [*d.columns, "_evidence", "_page"]
    assert adapters.structured_schema(DOMAINS["benzimidazole"])["properties"]["samples"]["items"]["properties"]["target_relation"]["enum"] == ["=", "<", ">", MISSING]
    assert "- `target_relation` (string) Allowed values: =, <, >." in adapters.fields_markdown(DOMAINS["benzimidazole"])


def test_windows(spark):
    pages = spark.createDataFrame([("d", n) for n in (1, 2, 4, 5, 9)], "doc_id string, page_number int")
    got = context.page_windows(pages, 2).orderBy("window").collect()
    assert [(r.window, r.first, r.last, r.pages) for r in got] == [(0, 1, 2, 2), (1, 4, 5, 2), (2, 9, 9, 1)]

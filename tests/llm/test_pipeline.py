import re

from pyspark.sql import functions as F

import corpus_pipeline
from corundum.llm import quality, queries
from tests.conftest import SF
from tests.llm.test_llm import brute_components, brute_hits, brute_secrets


def test_contract(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near", "benchmark", "secrets", "tokens"]
    assert {f"op{k}" for k in range(1, 11)} <= {n.split("_")[0] for n in queries.QUERIES}


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, outs = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, before, SF)
        df.write.parquet(f"{tmp_path}/{name}")
        outs[name] = before = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "tokens":
            assert before.columns == docs.columns
    good = [(r["doc_id"], r["text"]) for r in outs["quality"].collect()]
    want, _ = brute_components(good)
    assert sorted(r["doc_id"] for r in outs["near"].collect()) == sorted(set(want.values()))
    near = {r["doc_id"]: r["text"] for r in outs["near"].collect()}
    cut = {r["doc_id"]: r["text"] for r in outs["benchmark"].collect()}
    for i, t in near.items():
        n, hit, _ = brute_hits(items, t)
        if not hit:
            assert cut[i] == t
        elif i in cut:
            assert len(hit) <= n / 2 and len(re.findall(r"\w+", cut[i])) < len(re.findall(r"\w+", t))
    for r in outs["secrets"].collect():
        assert not brute_secrets(r["text"]) and r["n_chars"] == len(r["text"])
    assert outs["tokens"].count() == outs["secrets"].count()
    assert corpus_pipeline.run(spark, SF).count() == outs["tokens"].count()


def odd(spark, n=6):
    """Documents with null and empty texts, null ids, repeated rows and columns of inner names; the ids
    of the first, which comes twice, and of one that is near another."""
    told = spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").select("doc_id")
    whole = quality.base_rules(F.col("text"))["base_failed"]
    good = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 900").where(~whole).join(told, "doc_id").orderBy("doc_id").limit(n).collect()]
    first, near = good[0][0], 10**6
    rows = [*good, good[0], (None, good[1][1] + " and more of it"), (None, None), (near - 2, None), (near - 1, ""), (near, good[2][1] + " password = abcdef0123456789")]
    inner = "ids n_tokens secret_spans blob found_spans row_of_id quality_rules cut_text found".split()
    df = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *inner) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{x} string" for x in inner))
    return df.repartition(2), inner, first, near


def through(spark, docs, tmp_path, run):
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(f"{tmp_path}/{run}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{run}/{name}")
        yield name, docs


def test_stages_with_odd_rows(spark, tmp_path):
    docs, inner, first, near = odd(spark)
    for name, out in through(spark, docs, tmp_path, "odd"):
        rows = out.collect()
        assert out.columns[: len(docs.columns)] == docs.columns
        assert all(r[x] == x for r in rows for x in inner), name
        ids = [r["doc_id"] for r in rows]
        if name == "quality":
            assert near - 2 not in ids and near - 1 not in ids and ids.count(first) == 2 and near in ids
        else:
            assert ids.count(first) == 1 and near not in ids and None in ids
    assert out.columns[-2:] == ["_n_tokens", "_ids"]


def test_stages_of_an_empty_table(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("false")
    assert [out.count() for _, out in through(spark, docs, tmp_path, "none")] == [0] * 5


def test_a_second_run_scans_what_is_new(spark, tmp_path):
    docs, _, first, near = odd(spark, 3)
    spark.conf.set("spark.corundum.ledger", f"file://{tmp_path}/ledger")
    try:
        stage = dict(corpus_pipeline.STAGES)["secrets"]
        assert stage(spark, docs.where(F.col("doc_id") == first), SF).count() == 2
        scanned = spark.read.parquet(f"{tmp_path}/ledger/scanned").count()
        again = {(r["doc_id"], r["text"]) for r in stage(spark, docs, SF).collect()}
        total = spark.read.parquet(f"{tmp_path}/ledger/scanned").count()
        assert scanned == 1 and total == docs.selectExpr("coalesce(text, '') AS t").distinct().count()
        stage(spark, docs, SF).count()
        assert spark.read.parquet(f"{tmp_path}/ledger/scanned").count() == total
        assert any(t and "[ASSIGN]" in t and "abcdef0123456789" not in t for i, t in again if i == near)
    finally:
        spark.conf.unset("spark.corundum.ledger")

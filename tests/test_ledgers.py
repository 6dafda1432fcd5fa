"""Answers, stages and cascades: what was done isn't done again."""

import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corundum.operators import extract
from corundum.operators.stages import Stage, StageLedger, run_stages
from corundum.sources import answers
from corundum.sources.answers import Answers


def requests(spark, n, same=1):
    rows = [(f"r{i}", "s", f"prompt {i // same}") for i in range(n)]
    return spark.createDataFrame(rows, "request_id string, system string, prompt string").withColumn("images", F.lit(None).cast("array<binary>"))


def counting(path, fails=(), dies=None):
    """A client that writes down what it is asked, fails at some prompts, and ends its worker at one."""

    def factory():
        def ask(system, prompt, images):
            with open(path, "a") as f:
                f.write(prompt + "\n")
            if prompt == dies and not os.path.exists(path + ".died"):
                open(path + ".died", "w").close()
                os._exit(1)
            if prompt in fails:
                raise ValueError("no answer")
            return f"told {prompt}"

        return ask

    return factory


def asked(path):
    return Counter(open(path).read().splitlines()) if os.path.exists(path) else Counter()


def test_answers_are_asked_once(spark, tmp_path):
    ledger, log = Answers(spark, f"file://{tmp_path}/a"), str(tmp_path / "log")
    got = {r.request_id: r.content for r in ledger.ask(requests(spark, 30, same=3), counting(log)).collect()}
    assert got == {f"r{i}": f"told prompt {i // 3}" for i in range(30)} and set(asked(log).values()) == {1} and len(asked(log)) == 10
    got = {r.request_id: r.content for r in ledger.ask(requests(spark, 36, same=3), counting(log)).collect()}
    assert len(got) == 36 and set(asked(log).values()) == {1} and len(asked(log)) == 12
    other = Answers(spark, f"file://{tmp_path}/a", "another model")
    other.ask(requests(spark, 3), counting(log))
    assert asked(log)["prompt 0"] == 2


def test_failed_requests_are_asked_again(spark, tmp_path):
    ledger, log = Answers(spark, f"file://{tmp_path}/a", attempts=3), str(tmp_path / "log")
    got = {r.request_id: (r.content, r.error) for r in ledger.ask(requests(spark, 4), counting(log, fails=["prompt 2"])).collect()}
    assert got["r2"] == (None, "no answer") and asked(log) == {"prompt 0": 1, "prompt 1": 1, "prompt 2": 3, "prompt 3": 1}
    got = {r.request_id: (r.content, r.error) for r in ledger.ask(requests(spark, 4), counting(log)).collect()}
    assert got["r2"] == ("told prompt 2", None) and asked(log)["prompt 2"] == 4 and asked(log)["prompt 1"] == 1


def test_a_job_that_dies_halfway(spark, tmp_path, monkeypatch):
    """A worker ends in one task; what other tasks had committed by then isn't asked again."""
    monkeypatch.setattr(answers, "PER_TASK", 4)
    ledger, log = Answers(spark, f"file://{tmp_path}/a"), str(tmp_path / "log")
    try:  # local sessions give a task one attempt, so the job fails; others repeat it
        ledger.ask(requests(spark, 60), counting(log, dies="prompt 17"))
        died = False
    except Exception:
        died = True
    kept = {r.request for r in ledger.kept().where("content is not null").collect()}
    before = asked(log)
    got = {r.request_id: r.content for r in ledger.ask(requests(spark, 60), counting(log, dies="prompt 17")).collect()}
    assert got == {f"r{i}": f"told prompt {i}" for i in range(60)}
    again = asked(log) - before
    if died:
        assert 0 < len(kept) < 60 and sum(again.values()) == 60 - len(kept)
    hashes = {r.request: r.prompt for r in requests(spark, 60).select(answers.request_hash("").alias("request"), "prompt").collect()}
    assert not set(again) & {hashes[k] for k in kept}


def test_rate(spark, tmp_path):
    import time

    df = requests(spark, 12)
    began = time.monotonic()
    Answers(spark, f"file://{tmp_path}/a", per_second=10).ask(df, counting(str(tmp_path / "log"))).collect()
    assert time.monotonic() - began > 1.0  # one task of 12 requests


ROWS = "doc_id string, word string"


def staged(spark, log, settings=None, on=True):
    def words(docs, _):
        n = docs.count()
        log.append(("words", n))
        return docs.select("doc_id", F.explode(F.split("text", " ")).alias("word"))

    def upper(docs, before):
        log.append(("upper", docs.count()))
        return before["words"].select("doc_id", F.upper("word").alias("word"))

    def last(docs, before):
        log.append(("last", docs.count()))
        source = before.get("upper", before["words"])
        return source.select("doc_id", F.concat("word", F.lit("!")).alias("word"))

    return [Stage("words", ROWS, words), Stage("upper", ROWS, upper, settings or {}, on), Stage("last", ROWS, last)]


def docs_of(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def told(found):
    return sorted((r.doc_id, r.word) for r in found["last"].collect())


def test_stages_run_for_what_has_changed(spark, tmp_path):
    ledger, log = StageLedger(spark, f"file://{tmp_path}/l"), []
    found = run_stages(docs_of(spark, a="x y", b="z", c=""), staged(spark, log), ledger)
    assert told(found) == [("a", "X!"), ("a", "Y!"), ("b", "Z!"), ("c", "!")] and log == [("words", 3), ("upper", 3), ("last", 3)]
    log.clear()
    run_stages(docs_of(spark, a="x y", b="z", c=""), staged(spark, log), ledger)
    assert log == []  # nothing has changed
    found = run_stages(docs_of(spark, a="x y", b="w", d="v"), staged(spark, log), ledger)  # one is gone, one is new
    assert told(found) == [("a", "X!"), ("a", "Y!"), ("b", "W!"), ("d", "V!")] and log == [("words", 2), ("upper", 2), ("last", 2)]
    log.clear()
    found = run_stages(docs_of(spark, a="x y", b="w", d="v"), staged(spark, log, {"k": 1}), ledger)
    assert log == [("upper", 3), ("last", 3)]  # a changed setting: its stage and those after
    log.clear()
    found = run_stages(docs_of(spark, a="x y", b="w", d="v"), staged(spark, log, on=False), ledger)
    assert told(found)[0] == ("a", "x!") and log == [("last", 3)]
    log.clear()
    assert told(run_stages(docs_of(spark, a="x y", b="z"), staged(spark, log), ledger)) == [("a", "X!"), ("a", "Y!"), ("b", "Z!")] and log == []  # as once before


def test_a_stage_that_dies_is_run_again(spark, tmp_path):
    ledger, log = StageLedger(spark, f"file://{tmp_path}/l"), []
    stages = staged(spark, log)
    broken = Stage("upper", ROWS, lambda docs, before: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        run_stages(docs_of(spark, a="x"), [stages[0], broken], ledger)
    assert told(run_stages(docs_of(spark, a="x"), stages, ledger)) == [("a", "X!")] and log == [("words", 1), ("upper", 1), ("last", 1)]


def test_a_cascade_asks_for_what_is_left(spark, tmp_path):
    seen = []
    docs = spark.createDataFrame([(f"d{i}", i) for i in range(20)], "doc_id string, k int")

    def stage(name, where):
        def make(left):
            seen.append((name, left.count()))
            return left.where(where).select("doc_id", F.lit(name).alias("by"))

        return name, make

    got = extract.first_with_records(docs, [stage("a", "k % 2 = 0"), stage("b", "k % 3 = 0"), stage("c", "true"), stage("d", "true")])
    assert seen == [("a", 20), ("b", 10), ("c", 7)]  # nothing is left for the fourth
    assert Counter(r.method for r in got.collect()) == {"a": 10, "b": 3, "c": 7} and got.count() == 20

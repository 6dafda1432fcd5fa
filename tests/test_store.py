"""The store under writers at one time, writers that die, and readers beside them."""

import threading

import pytest
from pyspark.sql import functions as F

from corundum.sources.commits import CommitLog, Snapshot, Taken
from corundum.sources.store import Change, EvidenceStore

BLOCK = "evidence_id string, doc_id string, source_type string"


def blocks(spark, *rows):
    return spark.createDataFrame(list(rows), BLOCK)


def held(view, table="evidence_blocks"):
    return sorted(r["evidence_id"] for r in view.read(table).collect())


@pytest.fixture
def store(spark, tmp_path):
    s = EvidenceStore(spark, f"file://{tmp_path}/s", buckets=4)
    s.write("evidence_blocks", blocks(spark, *((f"e{i}", f"d{i}", "paragraph") for i in range(12))))
    return s


def test_a_number_is_given_once(spark, tmp_path):
    log = CommitLog(spark, f"file://{tmp_path}/s")
    log.put(Snapshot(1, {"t": {0: "t/x/doc_bucket=0"}}, frozenset({("t", 0)})))
    with pytest.raises(Taken):
        log.put(Snapshot(1, {}, frozenset()))
    assert log.latest().tables == {"t": {0: "t/x/doc_bucket=0"}} and log.versions() == [1]


def both_at_once(store, monkeypatch, *changes):
    """Run changes in threads, all of which come to their first commit before any makes it."""
    barrier, put, seen = threading.Barrier(len(changes)), CommitLog.put, set()

    def waiting(self, snapshot):
        if threading.get_ident() not in seen:
            seen.add(threading.get_ident())
            barrier.wait(timeout=120)
        return put(self, snapshot)

    monkeypatch.setattr(CommitLog, "put", waiting)
    failed = []

    def run(change):
        try:
            change()
        except Exception as e:
            failed.append(e)

    threads = [threading.Thread(target=run, args=(c,)) for c in changes]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    monkeypatch.setattr(CommitLog, "put", put)
    assert not failed, failed


def test_two_writers_of_one_document(spark, store, monkeypatch):
    """Both changes are there whichever came first, in both tables of each."""
    a = lambda: store.commit(lambda x: (x.upsert("evidence_blocks", blocks(spark, ("a", "d1", "paragraph")), "evidence_id"), x.upsert("figures", spark.createDataFrame([("fa", "d1")], "figure_id string, doc_id string"), "figure_id")))
    b = lambda: store.commit(lambda x: (x.upsert("evidence_blocks", blocks(spark, ("b", "d1", "paragraph"), ("e1", "d1", "new")), "evidence_id"), x.upsert("figures", spark.createDataFrame([("fb", "d1")], "figure_id string, doc_id string"), "figure_id")))
    both_at_once(store, monkeypatch, a, b)
    assert held(store) == sorted([f"e{i}" for i in range(12)] + ["a", "b"])
    assert sorted(r["figure_id"] for r in store.read("figures").collect()) == ["fa", "fb"]
    assert store.read("evidence_blocks").where("evidence_id = 'e1' and source_type = 'new'").count() == 1
    assert store.log.versions() == [1, 2, 3]


def test_two_writers_of_other_documents_change_once(spark, store, monkeypatch):
    view = store.at()
    bucket = {r["doc_id"]: r["b"] for r in view.read("evidence_blocks").select("doc_id", view.bucket_of(F.col("doc_id")).alias("b")).collect()}
    one, other = next((p, q) for p in bucket for q in bucket if bucket[p] != bucket[q])
    made, replace = [], Change.replace

    def counted(self, table, df, docs):
        made.append(table)
        return replace(self, table, df, docs)

    monkeypatch.setattr(Change, "replace", counted)
    both_at_once(store, monkeypatch, lambda: store.write("evidence_blocks", blocks(spark, ("a", one, "x"))), lambda: store.write("evidence_blocks", blocks(spark, ("b", other, "x"))))
    assert len(made) == 2 and {"a", "b"} <= set(held(store)) and len(held(store)) == 12


def test_a_writer_that_dies_leaves_nothing_to_see(spark, store, monkeypatch):
    """It dies after its first table, and before its commit; a repetition makes the whole change."""
    replace, calls = Change.replace, []

    def dies(self, table, df, docs):
        calls.append(table)
        if len(calls) == 2:
            raise RuntimeError("killed")
        return replace(self, table, df, docs)

    parts = {"evidence_blocks": blocks(spark, ("n", "d3", "x")), "figures": spark.createDataFrame([("f", "d3")], "figure_id string, doc_id string")}
    docs = spark.createDataFrame([("d3",)], "doc_id string")
    before = held(store)
    monkeypatch.setattr(Change, "replace", dies)
    with pytest.raises(RuntimeError):
        store.put_document(parts, docs)
    assert held(store) == before and store.log.versions() == [1]
    monkeypatch.setattr(Change, "replace", replace)
    monkeypatch.setattr(CommitLog, "put", lambda self, s: (_ for _ in ()).throw(RuntimeError("killed")))
    with pytest.raises(RuntimeError):
        store.put_document(parts, docs)
    assert held(store) == before
    monkeypatch.undo()
    store.put_document(parts, docs)
    assert "n" in held(store) and "e3" not in held(store) and store.read("figures").count() == 1
    data = store.vacuum(keep=1, hours=0)
    assert data >= 2 and "n" in held(store) and store.read("figures").count() == 1 and len(store.log.versions()) == 1


def test_a_reader_keeps_its_version(spark, store):
    view, rows = store.at(), store.read("evidence_blocks")
    store.reset(spark.createDataFrame([(f"d{i}",) for i in range(6)], "doc_id string"))
    assert len(held(view)) == 12 == rows.count() and len(held(store)) == 6
    assert held(store.at(1)) == held(view)
    store.vacuum(keep=2, hours=0)
    assert len(held(store.at(1))) == 12


def test_what_a_change_is_given_is_read_once(spark, store, monkeypatch):
    """A change that is made again doesn't compute its rows again."""
    runs = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            runs.add(len(b))
            yield b

    df = blocks(spark, ("a", "d1", "x")).mapInPandas(counted, BLOCK)
    both_at_once(store, monkeypatch, lambda: store.write("evidence_blocks", df), lambda: store.write("evidence_blocks", blocks(spark, ("b", "d1", "x"))))
    assert runs.value == 1 and store.read("evidence_blocks").where("doc_id = 'd1'").count() == 1


def test_nothing_to_change_is_no_commit(spark, store):
    store.write("evidence_blocks", blocks(spark).where("false"))
    assert store.log.versions() == [1]

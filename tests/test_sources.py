import csv
import io
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from corundum.sources import quoted, tables, web


def test_tables(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿name, value\n x , 04\n\"a,b\",\n", encoding="utf-8")
    df = tables.read_any(spark, str(tmp_path / "a.csv"))
    assert df.columns == ["name", "value"]
    assert {tuple(r) for r in df.collect()} == {("x", "04"), ("a,b", None)}
    assert {r.row["name"] for r in tables.as_rows(df, "d").collect()} == {"x", "a,b"}
    (tmp_path / "long.csv").write_text("k,v\n" + "".join(f"{i},x\n" for i in range(3000)))
    whole, spark_bytes = spark.conf.get("spark.sql.files.maxPartitionBytes"), "spark.sql.files.maxPartitionBytes"
    try:
        spark.conf.set(spark_bytes, "4096")
        rows = tables.as_rows(tables.read_table(spark, str(tmp_path / "long.csv")), "d")
        assert rows.rdd.getNumPartitions() > 2
        assert {r.nth: r.row["k"] for r in rows.collect()} == {i + 1: str(i) for i in range(3000)}
    finally:
        spark.conf.set(spark_bytes, whole)
    (tmp_path / "lines.csv").write_text('k,v\n1,"a\nb"\n2,c\n')
    assert {tuple(r) for r in tables.read_table(spark, str(tmp_path / "lines.csv")).collect()} == {("1", "a\nb"), ("2", "c")}
    (tmp_path / "a.tsv").write_text("n\tm\n1\t2\n")
    assert tables.read_any(spark, str(tmp_path / "a.tsv")).first().m == "2"
    (tmp_path / "ids.txt").write_text("p1\n\n  p2 \n")
    assert [r.article for r in tables.read_list(spark, str(tmp_path / "ids.txt")).collect()] == ["p1", "p2"]
    assert tables.read_text(spark, str(tmp_path / "ids.txt"), limit=2).first().text == "p1"


def test_archives(spark, tmp_path):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("b.PDF", "A.pdf", "README.md", ".hidden.pdf", "x/c.pdf"):
            z.writestr(name, name)
    (tmp_path / "z.zip").write_bytes(data.getvalue())
    got = tables.archive_members(tables.read_files(spark, str(tmp_path / "z.zip"))).orderBy("nth").collect()
    assert [r.member for r in got] == ["A.pdf", "b.PDF", "x/c.pdf"] and bytes(got[0].content) == b"A.pdf"
    (tmp_path / "broken.zip").write_bytes(b"no archive")
    both = tables.archive_members(tables.read_files(spark, str(tmp_path / "*.zip"))).collect()
    assert len(both) == 4 and [r.member for r in both if r.error] == [None]
    names = spark.createDataFrame([("a.csv", 1), ("a.exe", 1), ("b.PDF", 99 * 2**20)], "n string, s long")
    assert [r[0] for r in names.select(tables.upload_problem(F.col("n"), F.col("s"))).collect()] == [None, "the file type isn't known", "the file is too large"]


def test_links(spark):
    page = [(1, "https://h.org/a/b.html", '<a href="/x/supplement_1.pdf">s</a> <a class="c" href="esi.pdf"> <a href="https://o.org/supporting.pdf"> <a href="/x/supplement_1.pdf"> <a href="main.pdf">')]
    df = spark.createDataFrame(page, "page_id long, url string, html string")
    assert [r.link for r in web.supplements(df).orderBy("position").collect()] == ["https://h.org/x/supplement_1.pdf", "https://h.org/a/esi.pdf", "https://o.org/supporting.pdf"]
    a = spark.createDataFrame([("d", '{"primary_location":{"pdf_url":" u1"},"locations":[{"pdf_url":"u2"},{"pdf_url":"u1"},{}],"open_access":{"oa_url":"u3"}}')], "doi string, answer string")
    assert web.pdf_candidates(a).first().candidates == ["u1", "u2", "u3"]
    assert web.pdf_candidates(a.withColumn("answer", F.lit("no"))).first().candidates == []


def test_addresses(spark):
    cases = {"b.pdf": "https://h.org/a/b.pdf", "../x/./c": "https://h.org/x/c", "?q": "https://h.org/a/p?q", "#f": "https://h.org/a/p?x#f", "//o.org/z": "https://o.org/z", "/r": "https://h.org/r", "mailto:x": "mailto:x", "..": "https://h.org/"}
    df = spark.createDataFrame([("https://h.org/a/p?x", h) for h in cases], "b string, h string")
    assert {r.h: r.l for r in df.select("h", web.absolute(F.col("b"), F.col("h")).alias("l")).collect()} == cases
    page = spark.createDataFrame([(1, "https://h.org/", "<A HREF=a.pdf title='Supporting Information'>x</A><a name=n>y</a>")], "page_id long, url string, html string")
    assert [(r.href, r.label) for r in web.anchors(page).collect()] == [("a.pdf", "a.pdf Supporting Information")]
    assert web.supplements(page).first().link == "https://h.org/a.pdf"


def test_open_articles(spark):
    df = spark.createDataFrame([("d1", "p", "1"), ("d1", "p", "True"), ("d2", "q", "0"), (None, "r", "1")], "doi string, pdf string, access string")
    assert [tuple(r)[:2] for r in tables.open_articles(df).collect()] == [("d1", "p")]
    assert {tuple(r)[:2] for r in tables.open_articles(df.drop("access").union(spark.createDataFrame([("d3", "nan")], "doi string, pdf string"))).collect()} == {("d1", "p"), ("d2", "q")}
    assert tables.open_articles(df.drop("doi")).count() == 0


def split_at(spark, size, fn):
    """fn() with files split at so many bytes."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    spark.conf.set(key, str(size))
    try:
        return fn()
    finally:
        spark.conf.set(key, before)


@pytest.mark.parametrize("seed", range(4))
def test_quoted_files_are_split(spark, tmp_path, seed):
    """Random quotes, separators and line breaks in values: equal to the reader that reads a file in
    one task, at every size of splits, in the order of the file."""
    rng = random.Random(seed)
    pieces = ['"', '""', "\n", "\r\n", ",", "a", "bc d", " ", "é", "\n\n", '"\n"', ";"]
    rows = [["".join(rng.choices(pieces, k=rng.randint(0, 8))) for _ in range(3)] for _ in range(150)]
    with (tmp_path / "q.csv").open("w", newline="", encoding="utf-8") as f:
        w = csv.writer(f, quoting=csv.QUOTE_ALL if seed % 2 else csv.QUOTE_MINIMAL, lineterminator="\r\n" if seed == 2 else "\n")
        w.writerow(["k", "v", "w"])
        w.writerows([[f"r{i}", *r[1:]] for i, r in enumerate(rows)])
    path = str(tmp_path / "q.csv")
    whole = spark.read.csv(path, header=True, multiLine=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).collect()
    want = [tuple(r) for r in whole]
    assert len(want) == 150
    for size in (60, 333, 10**6):
        found = split_at(spark, size, lambda: quoted.read_quoted(spark, path, ",", numbered="nth").collect())
        told = [tuple(r)[1:] for r in sorted(found, key=lambda r: r.nth)]
        if seed == 2:  # the other reader turns line breaks within values into one form
            told = [tuple(x and x.replace("\r\n", "\n") for x in r) for r in told]
        assert told == want
        assert sorted(r.nth for r in found) == list(range(1, 151))
    parts = split_at(spark, 60, lambda: spark.read.text(path, lineSep="\n").rdd.getNumPartitions())
    assert parts > 20


def test_many_splits_meet_their_lines_by_a_merge_join(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(quoted, "FEW_SPLITS", 3)
    (tmp_path / "q").mkdir()
    for k in range(3):
        (tmp_path / f"q/{k}.csv").write_text("k,v\n" + "".join(f'{k}-{i},"a\n{i}\nb"\n\n' for i in range(60)))
    found = split_at(spark, 100, lambda: quoted.read_quoted(spark, str(tmp_path / "q"), ",", numbered="nth").collect())
    assert {r.nth: (r.k, r.v) for r in found} == {1 + 60 * k + i: (f"{k}-{i}", f"a\n{i}\nb") for k in range(3) for i in range(60)}


def test_a_quote_that_is_never_closed(spark, tmp_path):
    (tmp_path / "q.csv").write_text('k,v\n1,a\n2,"b\n3,c\n4,d\n')
    found = split_at(spark, 8, lambda: {r.k: r.v for r in tables.read_table(spark, str(tmp_path / "q.csv")).collect()})
    assert found["1"] == "a" and set(found) == {"1", "2"} and "4,d" in found["2"]


def test_order_of_files_at_every_size_of_splits(spark, tmp_path):
    (tmp_path / "n").mkdir()
    for k in range(4):
        (tmp_path / f"n/{k}.csv").write_text("k,v\n" + "".join(f"{k}-{i},x\n" for i in range(50 * k)))
    (tmp_path / "m.csv").write_text("k,v\n" + "".join(f'{i},"x\n"\n' for i in range(90)))
    want = {f"{k}-{i}" for k in range(4) for i in range(50 * k)}
    orders = [split_at(spark, size, lambda: {r.row["k"]: r.nth for r in tables.read_rows(spark, str(tmp_path / "n"), "d").collect()}) for size in (64, 1000, 10**7)]
    assert orders[0] == orders[1] == orders[2] and set(orders[0]) == want
    assert [k for k, _ in sorted(orders[0].items(), key=lambda x: x[1])] == [f"{k}-{i}" for k in range(4) for i in range(50 * k)]
    lines = split_at(spark, 64, lambda: {r.row["k"]: r.nth for r in tables.read_rows(spark, str(tmp_path / "m.csv"), "d").collect()})
    assert lines == {str(i): i + 1 for i in range(90)}
    (tmp_path / "t.csv").write_text("doi,pdf,access\n" + "".join(f"d{i % 40},p{i % 40},1\n" for i in range(200)))
    firsts = [split_at(spark, size, lambda: {r.doi: r["first"] for r in tables.open_articles(tables.read_table(spark, str(tmp_path / "t.csv"))).collect()}) for size in (50, 10**7)]
    assert firsts[0] == firsts[1] == {f"d{i}": i + 1 for i in range(40)}

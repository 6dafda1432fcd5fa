"""Records of quoted CSV files, which may go over lines, read by all tasks at once.

Whether a line begins a record depends on all quotes before it in its file. A first pass counts, for
each split of a file, its quotes and the records that begin in it, once for a split that begins outside
quotes and once for one that begins within. Prefix sums over the splits of a file tell which of the two
holds, and the number of the first record. A second pass then puts records together within each split;
of a record that goes over splits each gives its part, and only these parts are shuffled.

A quote within a value is doubled, as CSV has it; so within a value that isn't quoted there is none.
Line breaks within values stay as they are. Records without a character but blanks are no records. A quote that is never closed takes the rest of its
file into one record, as it would for a reader that reads the file from its beginning."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

c = F.col
#: Splits whose facts are broadcast at most; more meet their lines by a merge join.
FEW_SPLITS = 20_000
SPLIT = ["file", "block"]


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines with their file and the first byte of their split, in order within a split."""
    return spark.read.text(path, lineSep="\n").select("value", c("_metadata.file_path").alias("file"), c("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("line"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """The parts of a batch that lie in one split."""
    file, block = batch.column("file"), batch.column("block").to_numpy()
    n = batch.num_rows
    if not n:
        return
    names = file.to_numpy(zero_copy_only=False)
    edges = np.flatnonzero(np.concatenate(([True], (block[1:] != block[:-1]) | (names[1:] != names[:-1])))).tolist()
    for a, b in zip(edges, [*edges[1:], n]):
        yield (names[a], int(block[a])), batch.slice(a, b - a)


def _facts(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Of each line whether it has an odd number of quotes, and whether it has more than blanks."""
    odd = pc.count_substring(lines, '"').to_numpy(zero_copy_only=False).astype(np.int64) & 1
    full = pc.greater(pc.utf8_length(pc.utf8_trim_whitespace(lines)), 0).to_numpy(zero_copy_only=False)
    return odd, full


def splits(spark: SparkSession, path: str) -> DataFrame:
    """file, block, inside (whether it begins within quotes), first (the number of the first record
    that begins in it) and n, how many do."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple, list[int]] = {}  # a partition's splits
        for batch in batches:
            for key, part in _runs(batch):
                odd, full = _facts(part.column("value"))
                q, a, b = seen.setdefault(key, [0, 0, 0])
                inside = (q + np.cumsum(odd) - odd) & 1
                seen[key] = [q + int(odd.sum()), a + int((full & (inside == 0)).sum()), b + int((full & (inside == 1)).sum())]
        rows = [(*k, *v) for k, v in seen.items()]
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), *[pa.int64()] * 4))], names=[*SPLIT, "quotes", "outside", "within"])

    counted = _lines(spark, path).drop("line").mapInArrow(count, "file string, block bigint, quotes bigint, outside bigint, within bigint")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = counted.groupBy(*SPLIT).agg(*(F.sum(x).alias(x) for x in ("quotes", "outside", "within")))
    known = summed.withColumn("inside", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2 == 1)
    known = known.withColumn("n", F.when(c("inside"), c("within")).otherwise(c("outside")))
    return known.select(*SPLIT, "inside", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"), "n")


def records(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """file, at (from 0 in each file) and record of the files at path; known: their splits()."""
    known = splits(spark, path) if known is None else known
    few = known.limit(FEW_SPLITS + 1).count() <= FEW_SPLITS
    told = _lines(spark, path).join(known.hint("broadcast" if few else "merge"), SPLIT)
    if not few:
        told = told.sortWithinPartitions(*SPLIT, "line")
    parts = told.select("value", *SPLIT, "inside", "first").mapInArrow(_put_together, "file string, at bigint, block bigint, record string, whole boolean")
    whole, cut = parts.where("whole").select("file", "at", "record"), parts.where("not whole")
    joined = cut.groupBy("file", "at").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "record"))), lambda x: x["record"]), "\n").alias("record"))
    return whole.union(joined).withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def _put_together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records, and parts of those that begin before their split or go beyond it."""
    key, at, inside, held, whole = None, 0, 0, [], True

    def done(out: list, ends: bool) -> None:
        if held:
            out.append((key[0], at, key[1], "\n".join(held), whole and ends))

    for batch in batches:
        out: list[tuple] = []
        for split, part in _runs(batch):
            if split != key:
                done(out, not inside)
                key, held = split, []
                inside = int(part.column("inside")[0].as_py())
                at, whole = part.column("first")[0].as_py() - 1, False  # lines before the first beginning go on with a record
            odd, full = _facts(part.column("value"))
            within = (inside + np.cumsum(odd) - odd) & 1
            for line, begins, blank in zip(part.column("value").to_pylist(), ((within == 0) & full).tolist(), ((within == 0) & ~full).tolist()):
                if begins:
                    done(out, True)
                    at, held, whole = at + 1, [line], True
                elif not blank:
                    held.append(line)
            inside = int(inside + odd.sum()) & 1
        yield _batch(out)
    out = []
    done(out, not inside)
    yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["file", "at", "block", "record", "whole"])


def read_quoted(spark: SparkSession, path: str, sep: str, *, numbered: str | None = None) -> DataFrame:
    """The table of CSV files with headers, all strings; with a column numbered: the place of a row
    in the order of files and their rows, from 1 on."""
    names = spark.read.csv(path, header=True, sep=sep, inferSchema=False, multiLine=True, escape='"').columns
    known = splits(spark, path)
    found = records(spark, path, known).where("at > 0")
    schema = ", ".join(f"c{i} string" for i in range(len(names)))
    row = F.from_csv("record", schema, {"sep": sep, "escape": '"', "mode": "PERMISSIVE"})
    values = [c(f"row.c{i}").alias(n) for i, n in enumerate(names)]
    if not numbered:
        return found.select(row.alias("row")).select(*values)
    files = known.groupBy("file").agg(F.greatest(F.sum("n") - 1, F.lit(0)).alias("rows"))  # a row a file
    before = F.coalesce(F.sum("rows").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = found.join(files.select("file", before.alias("before")), "file")
    return placed.select(row.alias("row"), (c("before") + c("at")).alias(numbered)).select(numbered, *values)

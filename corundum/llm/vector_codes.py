"""Vector code compression: product codes, whose nearest entries are found by vantage-point trees.

Components become integers, vectors are cut into equal consecutive parts, and each part position has
a codebook. It starts as that part of the vectors of least id and is refined in rounds: every part
goes to its nearest entry, then each entry becomes the floor of the mean of its parts. A vector's code
names the nearest entry of each part.

Nearest entries come from a vantage-point tree over the entries of a part position. An inner node
holds an entry, and for each of its two branches the least and the greatest distance of the branch's
entries from it. A branch can hold nothing nearer than d - greatest or least - d. Squared distances are
integers and compared as such; roots are only taken for those bounds, where each is rounded so that
the bound is too low rather than too high, and a branch whose bound equals the best distance is visited
too, as an entry of lower index may tie there.

A task sums its parts by entry, and only sums and counts are shuffled; the driver holds the codebooks,
whose size doesn't depend on the table. Codes are written once, then errors are summed by label.

Cases: vectors that are null, or hold null or non-finite components, are dropped; components beyond
2^20 in magnitude count as that; a vector whose length isn't that of the vector of least id is kept
with null code and error and takes no part in anything; a length that the parts don't divide is filled
up with zeros; fewer vectors than entries make a smaller codebook; null ids come after all others, and
rows that share an id are ordered by their vectors; repeated rows are coded each; an empty table gives
an empty result; other columns aren't read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corundum.llm.common import free_name, map_arrow, type_of, work_dir, written

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Magnitude of an integer component at most: squared distances of parts then fit 64 bits.
MOST = SCALE << 20
#: Entries of a leaf at most.
LEAF = 6
#: Rows that are searched for together.
CHUNK = 4096
#: Salts by which the rows of one label are split.
SALTS = 32
#: Relative error allowed for in a root and in what it is taken of.
SLACK = 2.0**-48


@dataclass
class _Node:
    """entries: a leaf's. Otherwise the vantage point, and a branch with its (least, greatest)
    distance from it, twice."""

    entries: np.ndarray | None = None
    point: int = -1
    branches: list[tuple[_Node, float, float]] = field(default_factory=list)


class Tree:
    """A vantage-point tree over integer vectors, one a row."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors.astype(np.int64)
        self.root = self._grow(np.arange(len(vectors)))

    def _grow(self, at: np.ndarray) -> _Node:
        if len(at) <= LEAF:
            return _Node(entries=at)
        rest = at[1:]
        d = self._squares(self.vectors[rest], at[0])
        order = np.argsort(d, kind="stable")
        half = len(order) // 2
        branches = []
        for part in (order[:half], order[half:]):
            least, greatest = (np.sqrt(float(x)) for x in (d[part].min(), d[part].max()))
            branches.append((self._grow(np.sort(rest[part])), least * (1 - SLACK), greatest * (1 + SLACK)))
        return _Node(point=int(at[0]), branches=branches)

    def _squares(self, queries: np.ndarray, entry: int) -> np.ndarray:
        apart = queries - self.vectors[entry]
        return np.einsum("ij,ij->i", apart, apart)

    def nearest(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest entry of each query, of equally near ones the first, and its squared distance."""
        best = np.full(len(queries), np.iinfo(np.int64).max)
        index = np.full(len(queries), len(self.vectors))
        if len(self.vectors):
            self._visit(self.root, queries.astype(np.int64), np.arange(len(queries)), best, index)
        return index, best

    def _offer(self, entry: int, d: np.ndarray, at: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        better = (d < best[at]) | (d == best[at]) & (entry < index[at])
        best[at[better]], index[at[better]] = d[better], entry

    def _visit(self, node: _Node, queries: np.ndarray, at: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        if not len(at):
            return
        if node.entries is not None:
            for e in node.entries.tolist():
                self._offer(e, self._squares(queries[at], e), at, best, index)
            return
        d = self._squares(queries[at], node.point)
        self._offer(node.point, d, at, best, index)
        root = np.sqrt(d.astype(np.float64))
        low, high = root * (1 - SLACK), root * (1 + SLACK)
        bounds = [np.maximum(np.maximum(low - greatest, least - high), 0.0) for _, least, greatest in node.branches]
        second = bounds[1] < bounds[0]
        for mine, order in ((~second, (0, 1)), (second, (1, 0))):  # the nearer branch first
            for k in order:
                bound = bounds[k][mine]
                open_ = bound * bound * (1 - SLACK) <= best[at[mine]].astype(np.float64) * (1 + SLACK)
                self._visit(node.branches[k][0], queries, at[mine][open_], best, index)


@dataclass(frozen=True)
class Codebooks:
    """entries: (parts, entries, width) integers; length: of the vectors."""

    entries: np.ndarray
    length: int

    def trees(self) -> list[Tree]:
        return [Tree(e) for e in self.entries]

    def digest(self) -> str:
        """Of all components by part, entry and position within the part."""
        return hashlib.sha256(",".join(map(str, self.entries.ravel().tolist())).encode()).hexdigest()

    def decode(self, code: str) -> list[float]:
        """The vector that a code stands for; components are the lower ends of their steps."""
        found = [self.entries[p, int(code[2 * p : 2 * p + 2], 16)] for p in range(len(self.entries))]
        return (np.concatenate(found)[: self.length] / SCALE).tolist()


def integers(vector: Column) -> Column:
    """The integer components of a vector, null where it is to be dropped."""
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    step = lambda x: F.greatest(F.least(F.floor(x.cast("double") * SCALE), F.lit(MOST)), F.lit(-MOST)).cast("int")
    return F.when(vector.isNotNull() & ~F.exists(vector, bad), F.transform(vector, step))


def _chunks(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Batches joined to CHUNK rows or more, with their vectors as a matrix. They have one length."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def joined() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held)
        values = table.column(column).combine_chunks()
        return table, values.flatten().to_numpy(zero_copy_only=False).reshape(len(values), -1).astype(np.int64)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            rows += batch.num_rows
        if rows >= CHUNK:
            yield joined()
            held, rows = [], 0
    if held:
        yield joined()


def _parts(matrix: np.ndarray, parts: int) -> np.ndarray:
    """(parts, rows, width), filled up with zeros."""
    width = -(-matrix.shape[1] // parts)
    filled = np.pad(matrix, ((0, 0), (0, parts * width - matrix.shape[1])))
    return filled.reshape(len(matrix), parts, width).transpose(1, 0, 2)


def fit(vectors: DataFrame, *, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks | None:
    """Codebooks of a table of vec_id and steps, an array of integers; None if it is empty."""
    first = vectors.orderBy(F.col("vec_id").asc_nulls_last(), "steps").limit(entries).select("steps").collect()
    if not first:
        return None
    length = len(first[0]["steps"])
    start = _parts(np.array([r["steps"] for r in first if len(r["steps"]) == length], np.int64).reshape(-1, length), parts)
    books = Codebooks(start, length)
    own = vectors.where(F.size("steps") == length).select("steps")
    for _ in range(rounds):
        shape = books.entries.shape

        def sums(batches: Iterator[pa.RecordBatch], books: Codebooks = books, shape: tuple = shape) -> Iterator[pa.RecordBatch]:
            trees, total, count = books.trees(), np.zeros(shape, np.int64), np.zeros(shape, np.int64)
            for _, matrix in _chunks(batches, 0):
                for p, part in enumerate(_parts(matrix, shape[0])):
                    index, _ = trees[p].nearest(part)
                    np.add.at(total[p], index, part)
                    np.add.at(count[p], index, 1)
            at = np.flatnonzero(count.ravel())
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (at, total.ravel()[at], count.ravel()[at])], names=["slot", "total", "count"])

        found = map_arrow(own, sums, "slot bigint, total bigint, count bigint").groupBy("slot").agg(F.sum("total").alias("total"), F.sum("count").alias("count"))
        new = books.entries.copy().ravel()
        for r in found.collect():  # a row for each component of the codebooks at most
            new[r["slot"]] = r["total"] // r["count"]
        books = Codebooks(new.reshape(shape), length)
    return books


def encode(vectors: DataFrame, books: Codebooks, keep: list[str]) -> DataFrame:
    """keep, code and error of a table with steps; null where the length is another."""
    n = len(keep)
    n_parts, n_entries = books.entries.shape[:2]
    if n_entries > 256:
        raise ValueError("a code has two hex digits a part")

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = books.trees()
        for table, matrix in _chunks(batches, n):
            found, errors = np.zeros((len(matrix), n_parts), np.uint8), np.zeros(len(matrix), np.int64)
            for p, part in enumerate(_parts(matrix, n_parts)):
                index, squares = trees[p].nearest(part)
                found[:, p] = index
                errors += squares
            text = [r.tobytes().hex() for r in found]
            for b in pa.Table.from_arrays([*table.columns[:n], pa.array(text, pa.string()), pa.array(errors)], names=names).to_batches():
                yield b

    names = [*(f"k{i}" for i in range(n)), "code", "error"]
    kept = [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)]
    types = ", ".join(f"k{i} {type_of(vectors, c)}" for i, c in enumerate(keep))
    coded = map_arrow(vectors.where(F.size("steps") == books.length).select(*kept, "steps"), code, f"{types}, code string, error bigint")
    others = vectors.where(F.size("steps") != books.length).select(*kept, F.lit(None).cast("string"), F.lit(None).cast("bigint"))
    return coded.union(others).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), "code", "error")


def compress(df: DataFrame, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """A row for each vector that is kept: vec_id, label, code, error and label_error, the sum of
    the errors of the rows with an equal label (nulls are equal); and the codebooks."""
    source = df.select(F.col(f"`{vec_id}`").alias("vec_id"), F.col(f"`{label}`").alias("label"), integers(F.col(f"`{vector}`")).alias("steps")).where("steps is not null")
    books = fit(source, parts=parts, entries=entries, rounds=rounds)
    if books is None:
        none = source.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error"), F.lit(0).cast("bigint").alias("label_error"))
        return none.where("false"), None
    coded = written(encode(source, books, ["vec_id", "label"]), work_dir(df.sparkSession), "codes")
    salt = free_name(coded, "salt")
    sums = coded.groupBy("label").agg(F.sum("error").alias("label_error")).select(F.col("label").alias("of_label"), "label_error")
    sums = sums.withColumn("of_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))  # one label may hold most rows
    salted = coded.withColumn(salt, F.pmod(F.xxhash64("vec_id", "code"), F.lit(SALTS)).cast("int"))
    joined = salted.join(sums, F.col("label").eqNullSafe(F.col("of_label")) & (F.col(salt) == F.col("of_salt")))
    return joined.select("vec_id", "label", "code", "error", "label_error"), books

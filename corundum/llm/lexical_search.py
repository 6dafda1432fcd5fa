"""Ranked lexical search: best-first branch and bound over trees of maxima.

Terms are weighted by how rare they are, and a document's share of a term grows with its occurrences
and falls with the document's length, all in integers, so that scores are equal in every run.

Queries are dealt into chunks of a checked size. For each chunk one pass over the texts counts the
documents that hold each of its terms; a second pass searches. There a task gathers blocks of
documents. Of each term a block has a tree of maxima: a leaf for each document with the term, which
holds the term's share of the document's score, and above it ranges of FAN documents, of FAN ranges
and so on, each with the greatest share below. The sum of a query's weighted maxima in a range bounds
the score of any document in it. Ranges are opened highest bound first; a range whose bound is lower
than the last of the best documents so far can't change them, and one with an equal bound is opened, as
a document of lower id may tie there. A task keeps its best documents over all its blocks, so later
blocks end at the root where their bounds are too low.

What tasks found is merged by ranks in two steps, salted first. Nothing is shuffled but counts by term
and the best documents of each task and query.

Cases: null texts have no terms, and a document without terms counts nowhere; a query without known
terms finds nothing; terms that a query repeats count as often; rows that share an item_id are a query
each, those that share a doc_id a document each; null ids are given back as they are, null doc_ids after
the others of their score; weights of 0 give no score, so terms that nearly all documents hold find
nothing; empty tables give an empty result; very long texts are read whole; other columns aren't read.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corundum.llm.common import drop_all, map_arrow, type_of, work_dir, written

BEST = 10
#: Children of a range.
FAN = 16
#: Documents and postings of a block, from which on it is searched.
BLOCK_DOCS, BLOCK_POSTINGS = 8192, 1 << 21
#: Terms, repeats included, of a chunk of queries: what is broadcast. One query may have more.
CHUNK_TERMS = 250_000
#: Salts of the first merge.
SALTS = 32
#: A byte of a term stays, an upper-case letter becomes lower-case; all else parts terms.
_TERM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def terms_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TERM).split()


def weight(n: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))


def _shares(tf: np.ndarray, sizes: np.ndarray, n: int, total: int) -> np.ndarray:
    """The share of a term by its occurrences and the size of the document."""
    if len(sizes) and 75 * int(sizes.max()) * n >= 1 << 63:
        m = np.array([25 + 75 * s * n // total for s in sizes.tolist()], np.int64)
    else:
        m = 25 + 75 * sizes * n // total
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def _postings(texts: list, known: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and occurrences of each known term of a list of texts, and the texts' sizes."""
    found, sizes = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = terms_of(t)
        sizes[i] = len(words)
        ids = np.fromiter((known.get(w, -1) for w in words), np.int64, len(words))
        found.append(ids[ids >= 0] + i * len(known))
    key, tf = np.unique(np.concatenate(found) if found else np.zeros(0, np.int64), return_counts=True)
    return key // max(len(known), 1), key % max(len(known), 1), tf, sizes


class Block:
    """The trees of a block of documents, for all terms together: at each level the sorted keys
    term * ranges + range, and the maxima."""

    def __init__(self, doc: np.ndarray, term: np.ndarray, share: np.ndarray, n_docs: int):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        order = np.lexsort((doc, term))
        at, term, share, ranges = doc[order], term[order], share[order], n_docs
        while True:
            self.levels.append((ranges, term * ranges + at, share))
            if ranges <= 1:
                break
            at, ranges = at // FAN, -(-ranges // FAN)
            first = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (at[1:] != at[:-1])))) if len(at) else np.zeros(0, np.int64)
            at, term = at[first], term[first]
            share = np.maximum.reduceat(share, first) if len(first) else share

    def sums(self, level: int, low: int, high: int, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Bounds of the ranges from low up to high of a level; at level 0 the scores."""
        ranges, keys, most = self.levels[level]
        a, b = np.searchsorted(keys, terms * ranges + low), np.searchsorted(keys, terms * ranges + high)
        n = b - a
        where = np.repeat(b - np.cumsum(n), n) + np.arange(n.sum())
        out = np.zeros(high - low, np.int64)
        np.add.at(out, keys[where] - np.repeat(terms * ranges + low, n), most[where] * np.repeat(weights, n))
        return out

    def search(self, terms: np.ndarray, weights: np.ndarray, best: list, k: int, id_of: list) -> list:
        """best, a sorted list of (-score, id is null, id), with what this block adds to it."""
        top = len(self.levels) - 1
        heap = [(-int(self.sums(top, 0, 1, terms, weights)[0]), top, 0)]
        while heap:
            bound, level, at = heapq.heappop(heap)
            if not bound or len(best) == k and bound > best[-1][0]:
                break
            ranges = self.levels[level - 1][0] if level else self.levels[0][0]
            low, high = (at * FAN, min((at + 1) * FAN, ranges)) if level else (0, 1)
            found = self.sums(max(level - 1, 0), low, high, terms, weights)
            least = -best[-1][0] if len(best) == k else 1
            for i in np.flatnonzero(found >= least).tolist():
                if level > 1:
                    heapq.heappush(heap, (-int(found[i]), level - 1, low + i))
                else:
                    own = id_of[low + i]
                    best.append((-int(found[i]), own is None, own))
            if level <= 1:
                best.sort(key=_order)
                del best[k:]
        return best


def _order(x: tuple) -> tuple:
    return (x[0], x[1], x[2]) if not x[1] else (x[0], x[1])


def _chunked(queries: DataFrame) -> tuple[DataFrame, int]:
    """queries (query, item_id, terms) with the chunk of each, and the number of chunks: as many as
    it takes until none has more than CHUNK_TERMS terms or it is one query."""
    total = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = max(1, -(-total // CHUNK_TERMS))
    while True:
        dealt = queries.withColumn("chunk", F.pmod(F.xxhash64("query"), F.lit(n)).cast("int"))
        full = dealt.groupBy("chunk").agg(F.sum(F.size("terms")).alias("terms"), F.count("*").alias("queries")).where(f"terms > {CHUNK_TERMS} and queries > 1")
        if full.isEmpty():
            return dealt, n
        n *= 2


def search(docs: DataFrame, queries: DataFrame, *, text: str = "text", doc_id: str = "doc_id", item_id: str = "item_id", k: int = BEST) -> DataFrame:
    """For each row of queries its k best documents: item_id, rank from 1 on, doc_id, score."""
    spark = docs.sparkSession
    folder = work_dir(spark)
    docs = docs.select(F.col(f"`{doc_id}`").alias("id"), F.col(f"`{text}`").cast("binary").alias("text"))
    id_type, item_type = type_of(docs, "id"), type_of(queries, item_id)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(list(map(terms_of, b.column(2).to_pylist())), pa.list_(pa.binary()))], names=["query", "item", "terms"])

    numbered = queries.select(F.monotonically_increasing_id().alias("query"), F.col(f"`{item_id}`").alias("item"), F.col(f"`{text}`").cast("binary").alias("text"))
    asked = written(map_arrow(numbered, split, f"query bigint, item {item_type}, terms array<binary>"), folder, "queries")
    asked, n_chunks = _chunked(asked)
    found = None
    for c in range(n_chunks):
        rows = asked.where(F.col("chunk") == c).select("query", "terms").collect()  # CHUNK_TERMS terms, or one query
        best = _search(docs, [(r["query"], Counter(map(bytes, r["terms"]))) for r in rows], k, id_type)
        best = written(best, folder, f"best{c}") if n_chunks > 1 else best
        found = found.union(best) if found is not None else best
    order = [F.desc("score"), F.col("id").asc_nulls_last()]
    salted = Window.partitionBy("query", "salt").orderBy(*order)
    found = found.withColumn("salt", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= k)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    items = asked.select("query", "item")
    out = written(ranked.select("query", "rank", "id", "score"), folder, "ranked").join(items, "query")
    drop_all(spark, folder, *(f"best{c}" for c in range(n_chunks)))
    return out.select(F.col("item").alias(item_id), "rank", F.col("id").alias(doc_id), "score")


def _search(docs: DataFrame, queries: list[tuple[int, Counter]], k: int, id_type: str) -> DataFrame:
    """query, id and score of the best documents of each task."""
    spark = docs.sparkSession
    known = {t: i for i, t in enumerate(sorted({t for _, terms in queries for t in terms}))}
    sent = spark.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Documents by term, then under -1 those with a term, and under -2 all terms."""
        known = sent.value
        df, n, total = np.zeros(len(known), np.int64), 0, 0
        for b in batches:
            _, term, _, sizes = _postings(b.column(0).to_pylist(), known)
            df += np.bincount(term, minlength=len(known))
            n, total = n + int((sizes > 0).sum()), total + int(sizes.sum())
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, [-1, -2]), pa.int64()), pa.array(np.append(df[at], [n, total]), pa.int64())], names=["term", "n"])

    counted = map_arrow(docs.select("text"), count, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))
    df = {r["term"]: r["n"] for r in counted.collect()}  # a row for each term of the chunk at most
    n, total = df.pop(-1, 0), df.pop(-2, 0)
    weights = {t: weight(n, df[i]) for t, i in known.items() if i in df}
    parsed = []
    for query, terms in queries:
        own = [(known[t], c * weights[t]) for t, c in terms.items() if weights.get(t)]
        if own:
            parsed.append((query, np.array([t for t, _ in own], np.int64), np.array([w for _, w in own], np.int64)))
    plan = spark.sparkContext.broadcast(parsed)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, queries = sent.value, plan.value
        best: dict[int, list] = {q: [] for q, _, _ in queries}
        ids: list = []
        held: list[tuple] = []
        postings, kind = 0, None

        def flush() -> None:
            doc, term, tf, sizes = (np.concatenate(x) for x in zip(*held))
            block = Block(doc, term, _shares(tf, sizes[doc], n, total), len(ids))
            for q, terms, weights in queries:
                block.search(terms, weights, best[q], k, ids)

        for b in batches:
            kind = b.schema.field(0).type
            doc, term, tf, sizes = _postings(b.column(1).to_pylist(), known)
            held.append((doc + len(ids), term, tf, sizes))
            ids += b.column(0).to_pylist()
            postings += len(doc)
            if len(ids) >= BLOCK_DOCS or postings >= BLOCK_POSTINGS:
                flush()
                ids, held, postings = [], [], 0
        if ids:
            flush()
        rows = [(q, x[2], -x[0]) for q, found in best.items() for x in found]
        if rows:
            q, i, s = zip(*rows)
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, kind), pa.array(s, pa.int64())], names=["query", "id", "score"])

    return map_arrow(docs.select("id", "text"), find, f"query bigint, id {id_type}, score bigint")

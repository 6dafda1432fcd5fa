"""Substring dedup by recompression.

Words get names; rounds then name runs of equal words and, by turns, pairs of neighbours of which
the first falls on the left side and the second on the right side of that round's split of all
names. A name is computed from what it names, so it is the same in every text, task and retry, and
the naming needs no shuffle. A symbol that has grown to ANCHOR words is an anchor. Its span is the
range of words that its making depended on, so a window that holds the span makes the same anchor
wherever it stands.

1.  Anchor names are counted over all texts. A window with an anchor that occurs once occurs once.
2.  The windows that are left are nearly all repeats. They get 128-bit names composed of pairs of
    pairs, and those are counted: what isn't unique is a repeat, exactly.

Counts come with the least reference (key, position), which for a count of one is the reference
itself; so no group is ever gathered, common names are summed before the shuffle, and only unique
ones go back to their texts. Texts travel compressed. Of equal texts one takes part in step 2, with
weight two.

Cases: null and empty texts have no words; texts shorter than a window lose nothing; repeated rows
are texts that occur twice, whatever their ids; null ids are kept; an empty table gives an empty
result; very long texts are read whole; other columns aren't read.

Names are hashes of what they name: a round names runs and pairs alike in every task, so the naming
is global without being shuffled. Words, windows and texts with their ids have 128 bits, anchors 64: two
anchors that share a name by chance count as repeated, and their windows are then counted.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corundum.llm.common import claim, map_arrow, map_texts, work_dir, written

WINDOW = 35
#: Words of an anchor at least; rounds of naming, after which nearly all text lies in anchors.
ANCHOR, ROUNDS = 6, 10
CACHE_SIZE = 1 << 19
#: Parts that the rows of one text are split into.
SALTS = 32
#: What a row goes by between stages.
KEY = ["key", "key2"]
U = np.uint64


class _Names(dict):
    """Word -> index into two arrays of independent 64-bit names."""

    def __init__(self) -> None:
        super().__init__()
        self.values: list[int] = []
        self.done = np.zeros((0, 2), U)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        self[word] = at = len(self)
        h = xxhash.xxh3_128_intdigest(word)
        self.values += (h & (1 << 64) - 1, h >> 64)
        return at

    def forget(self) -> None:
        self.clear()
        self.values, self.done = [], np.zeros((0, 2), U)

    def of(self, texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The two names of each word of all texts in one array, each text followed by a break with
        name 0, and where texts start."""
        claim("substring", self.forget)
        if len(self) > CACHE_SIZE:
            self.forget()
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        first = np.concatenate(([0], np.cumsum(sizes)))
        ids = np.full(int(first[-1]), -1, np.int64)
        for words, at in zip(texts, first.tolist()):
            ids[at : at + len(words)] = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        self.done = np.concatenate((self.done, np.array(self.values, U).reshape(-1, 2)))
        self.values = []
        padded = np.concatenate((self.done, np.zeros((1, 2), U)))
        return padded[ids, 0], padded[ids, 1], first


_names = _Names()


def _name(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    h = (a * U(0x9E3779B97F4A7C15)) ^ (b + U(0xD1B54A32D192ED03) + (a << U(7)))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(29)
    h *= U(0x94D049BB133111EB)
    return h ^ h >> U(32)


def _right(name: np.ndarray, r: int) -> np.ndarray:
    h = (name ^ U(r * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * U(0xD6E8FEB86659FD93)
    return ((h ^ h >> U(32)) * U(0xD6E8FEB86659FD93) >> U(63)).astype(bool)


def anchors(names: np.ndarray, breaks: np.ndarray, least: int = ANCHOR, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names and spans (start, end) of the anchors in an array of word names. Breaks separate
    texts; a span that reaches one depends on the text's edge and lies in no window."""
    n = len(names)
    ends = np.zeros(n, bool)
    ends[breaks] = True
    # Runs of equal words. That a word is no longer a run depends on both its neighbours.
    first = np.flatnonzero(np.concatenate(([True], (names[1:] != names[:-1]) | ends[1:] | ends[:-1])))
    size = np.diff(np.append(first, n))
    name = np.where(size > 1, _name(names[first], size.astype(U)), names[first])
    lo, hi, ends = first - 1, first + size + 1, ends[first]
    for r in range(1, rounds + 1):
        m = len(name)
        small, right = (size < least) & ~ends, _right(name, r)
        at = np.flatnonzero(small[:-1] & small[1:] & ~right[:-1] & right[1:])
        left_of, right_of = np.zeros(m, bool), np.zeros(m, bool)
        left_of[at] = right_of[at + 1] = True
        # A symbol without a partner depends on the neighbour that could have been one.
        lone = np.flatnonzero(small & ~left_of & ~right_of)
        a, b = lone[~right[lone]], lone[right[lone]]
        lo_next, hi_next = lo.copy(), hi.copy()
        hi_next[a] = np.maximum(hi[a], hi[np.minimum(a + 1, m - 1)])
        lo_next[b] = np.minimum(lo[b], lo[np.maximum(b - 1, 0)])
        name[at], size[at] = _name(name[at], name[at + 1]), size[at] + size[at + 1]
        lo_next[at], hi_next[at] = np.minimum(lo[at], lo[at + 1]), np.maximum(hi[at], hi[at + 1])
        stay = ~right_of
        name, size, lo, hi, ends = name[stay], size[stay], lo_next[stay], hi_next[stay], ends[stay]
    found = (size >= least) & ~ends
    return name[found], lo[found], hi[found]


def _windows(low: np.ndarray, high: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names of all windows: powers of two by pairs, composed to length."""
    out = []
    for x in (low, high):
        power, size, name, done = x, 1, None, 0
        rest = length
        while True:
            if rest & size:
                part = power[done : len(x) - length + 1 + done]
                name = part if name is None else _name(name, part)
                done += size
            if size * 2 > length:
                break
            power = _name(power[:-size], power[size:])
            size *= 2
        out.append(name)
    return out[0], out[1]


def _merge(starts: list[int], ends: list[int]) -> list[int]:
    out: list[int] = []
    for a, b in sorted(zip(starts, ends)):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def _pack(z: str | None) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(3).compress((z or "").encode())


def _unpack(z: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdDecompressor().decompress(z)


def _marked(n: int, ranges: list[int]) -> np.ndarray:
    out = np.zeros(n, bool)
    for a, b in zip(ranges[::2], ranges[1::2]):
        out[max(0, a) : b] = True
    return out


def row_key(half: int, doc_id: Column, text: Column) -> Column:
    """One half of the 128 bits that a row goes by."""
    return F.xxhash64(F.lit(half), doc_id, text)


def deduplicate(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept: each text without the words of windows that also start
    elsewhere, its other words joined by one space."""
    spark = docs.sparkSession
    folder = work_dir(spark)
    id_, text_ = F.col(f"`{doc_id}`"), F.col(f"`{text}`")
    keyed = docs.select(*(row_key(k, id_, text_).alias(n) for k, n in enumerate(KEY)), id_.alias("id"), text_.alias("text"))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [(t or "").encode().split() for t in batch.column(2).to_pylist()]
            names, _, first = _names.of(texts)
            name, lo, hi = anchors(names, first[1:] - 1)
            k = np.searchsorted(first, lo, "right") - 1  # lo is a break or -1 where the span reaches one
            inside = (hi - lo <= window) & (lo >= 0) & (hi < first[np.minimum(k + 1, len(first) - 1)]) & (lo != first[np.minimum(k + 1, len(first) - 1)] - 1)
            name, lo, hi, k = name[inside], lo[inside], hi[inside], k[inside]
            keys = [pa.array(batch.column(i).to_numpy(zero_copy_only=False)[k], pa.int64()) for i in range(2)]
            span = (lo - first[k]) << 8 | (hi - lo)
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), *keys, pa.array(span, pa.int64())], names=["name", *KEY, "span"])

    if window >= 256:
        raise ValueError("a span is packed with its length in 8 bits")
    found = map_arrow(keyed.select(*KEY, "text"), find, "name bigint, key bigint, key2 bigint, span bigint")
    least = lambda names: [F.min(n).alias(n) for n in names]  # noqa: E731  of one row, where it is alone
    once = found.groupBy("name").agg(F.count("*").alias("c"), *least([*KEY, "span"])).where("c = 1")
    # A third of all rows may be one text, under one id or none: rows are salted by their number.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")
    digest = keyed.select(*KEY, F.unhex(F.md5(F.coalesce("text", F.lit("")))).alias("digest"), salt.alias("salt"))
    twice = digest.groupBy("digest").agg(F.count("*").alias("c"), F.min(F.struct(*KEY)).alias("main")).where("c > 1")
    twice = twice.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    copies = digest.join(twice, ["digest", "salt"]).select(*KEY, F.when(F.struct(*KEY) == F.col("main"), 1).otherwise(2).alias("copy")).distinct()
    of_key = once.select(*KEY, "span", F.lit(0).alias("copy")).unionByName(copies.select(*KEY, F.lit(None).cast("bigint").alias("span"), "copy"))
    of_key = of_key.groupBy(*KEY).agg(F.collect_list("span").alias("spans"), F.max("copy").alias("copy"))

    def single(rows: list) -> list[list]:
        """Ranges of window starts that hold an anchor that occurs once."""
        out = []
        for spans in rows:
            s = np.array(spans, np.int64)
            lo = s >> 8
            out.append(_merge((lo + (s & 255) - window).tolist(), (lo + 1).tolist()))
        return [out]

    known = written(map_texts(of_key, "spans", single, [("single", "array<int>")], [*KEY, "copy"]), folder, "known")
    packed = map_texts(keyed, "text", lambda rows: [list(map(_pack, rows))], [("z", "binary")], [*KEY, "id"])
    first_look = packed.select(*KEY, "z").join(known, KEY, "left").where("copy is null or copy < 2")

    def name_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, copy, ranges = (batch.column(i).to_pylist() for i in range(2, 5))
            texts = [_unpack(x).split() for x in z]
            low, high, first = _names.of(texts)
            n = len(low) - window + 1
            if n <= 0:
                continue
            open_ = np.zeros(n, bool)
            weight = np.ones(n, np.int32)
            for k, words in enumerate(texts):
                if (m := len(words) - window + 1) > 0:
                    at = int(first[k])
                    open_[at : at + m] = True if copy[k] else ~_marked(m, ranges[k] or [])
                    weight[at : at + m] = 2 if copy[k] else 1
            at = np.flatnonzero(open_)
            if not len(at):
                continue
            a, b = _windows(low, high, window)
            k = np.searchsorted(first, at, "right") - 1
            keys = [pa.array(batch.column(i).to_numpy(zero_copy_only=False)[k]) for i in range(2)]
            yield pa.RecordBatch.from_arrays([pa.array(a[at].view(np.int64)), pa.array(b[at].view(np.int64)), *keys, pa.array((at - first[k]).astype(np.int32)), pa.array(weight[at])], names=["a", "b", *KEY, "at", "weight"])

    windows = map_arrow(first_look.select(*KEY, "z", "copy", "single"), name_windows, "a bigint, b bigint, key bigint, key2 bigint, at int, weight int")
    alone = windows.groupBy("a", "b").agg(F.sum("weight").alias("c"), *least([*KEY, "at"])).where("c = 1")
    alone = alone.groupBy(*KEY).agg(F.collect_list("at").alias("alone"))
    facts = known.select(*KEY, "copy", "single").join(alone, KEY, "full")

    def remove(rows: list) -> list[list]:
        n_words, n_removed, kept = [], [], []
        for r in rows:
            words = _unpack(r["z"]).split()
            m = len(words) - window + 1
            gone = np.zeros(len(words), bool)
            if m > 0 and r["copy"]:
                gone[:] = True
            elif m > 0:
                repeat = ~_marked(m, r["single"] or [])
                if r["alone"]:
                    repeat[r["alone"]] = False
                edge = np.zeros(len(words) + 1, np.int64)
                at = np.flatnonzero(repeat)
                edge[at] += 1
                edge[at + window] -= 1
                gone = np.cumsum(edge)[:-1] > 0
            n_words.append(len(words))
            n_removed.append(int(gone.sum()))
            kept.append(b" ".join([w for w, g in zip(words, gone.tolist()) if not g] if n_removed[-1] else words).decode())
        return [n_words, n_removed, kept]

    last = packed.join(facts, KEY, "left").select(F.col("id"), F.struct("z", "copy", "single", "alone").alias("all"))
    out = map_texts(last, "all", remove, [("n_words", "bigint"), ("n_removed", "bigint"), ("kept", "string")], ["id"])
    return out.select(F.col("id").alias(doc_id), "n_words", "n_removed", "kept")

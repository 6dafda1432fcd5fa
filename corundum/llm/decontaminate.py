"""Benchmark decontamination by a generalised suffix automaton of the test items.

Items are normalised to words and put into one automaton a shard. A document's words stream
through it: the automaton carries the length of the longest match that ends at each word, and
marks on its states say which windows (WINDOW consecutive item words, or a shorter item whole)
end there. Stretches whose neighbouring word pairs no item has can't hold a window and are passed
over at array speed. Broadcasts are bounded: a shard holds about SHARD_WORDS item words (one item
whole at least). A larger benchmark makes more shards. Then one pass over all documents finds those
with any stretch of neighbours that some item of any shard has, by a filter of fixed size; they
alone pass the shards' automata, one after the other.

Cases: null and empty texts have no words; null or wordless items have no window; rows that share
an item_id are one item; a null item_id is left out; repeated documents keep their rows; an empty
benchmark hits nothing; very long texts stream through whole; other columns are passed through
whatever their names, and a result whose name one of them has gets underscores before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corundum.llm.common import claim, drop_all, free_name, map_texts, work_dir, written

WINDOW = 10
#: Item words of one automaton: about 50 MB in a worker.
SHARD_WORDS = 100_000
#: A document with a larger share of its words hit is dropped; from others the hits are cut.
MAX_COVERAGE = 0.5
#: A-Z lower-cased; every ASCII character that isn't a letter or digit ends a word.
NORMAL = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))
PAIR_BITS = 22
#: Bits of the filter of neighbours of all shards.
FILTER_BITS, CACHE_SIZE = 25, 1 << 18


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(NORMAL).split()


class Automaton:
    """Suffix automaton over the word sequences of items, with marks where windows end."""

    def __init__(self, items: dict[str, list[list[bytes]]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        self.length, self.link = [0], [-1]
        self.next: list[dict[int, int]] = [{}]
        self.shortest = 1 << 30
        sequences = [(item, [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words]) for item, texts in items.items() for words in texts if words]
        for _, sequence in sequences:
            last = 0
            for w in sequence:
                last = self._extend(last, w)
        self.items = sorted(items)
        number = {item: i for i, item in enumerate(self.items)}
        #: Of a state: the windows in its class, as (length, items).
        self.marks: dict[int, dict[int, set[int]]] = {}
        pairs = np.zeros(1 << PAIR_BITS, bool)
        for item, sequence in sequences:
            size = min(window, len(sequence))
            self.shortest = min(self.shortest, size)
            for i in range(len(sequence) - size + 1):
                state = self._walk(sequence[i : i + size])
                self.marks.setdefault(state, {}).setdefault(size, set()).add(number[item])
            s = np.array(sequence, np.int64)
            pairs[self._pair(s[:-1], s[1:])] = True
        self.pairs = np.packbits(pairs)
        #: Of a state: the nearest with marks on its way to the root, itself included; -1 if none.
        self.marked = [-1] * len(self.length)
        for state in sorted(range(len(self.length)), key=self.length.__getitem__):
            self.marked[state] = state if state in self.marks else self.marked[self.link[state]] if state else -1

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return (a * 0x9E3779B1 + b * 0x85EBCA6B >> 7) & ((1 << PAIR_BITS) - 1)

    def _new(self, length: int, link: int, edges: dict[int, int]) -> int:
        self.length.append(length)
        self.link.append(link)
        self.next.append(edges)
        return len(self.length) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        clone = self._new(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p != -1 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:  # an earlier item has this prefix
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        state, p = self._new(self.length[last] + 1, 0, {}), last
        while p != -1 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p != -1:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state

    def _walk(self, sequence: list[int]) -> int:
        state = 0
        for w in sequence:
            state = self.next[state][w]
        return state

    def stretches(self, ids: np.ndarray) -> Iterator[tuple[int, int]]:
        """Ranges of words that may hold a window: known words, neighbours a known pair, as long
        as the shortest window at least. Id 0 is an unknown word or the end of a text."""
        if not hasattr(self, "seen"):
            self.seen = np.unpackbits(self.pairs).astype(bool)
        known = ids > 0
        joined = self.seen[self._pair(ids[:-1], ids[1:])] & known[:-1] & known[1:]
        edge = np.flatnonzero(np.diff(np.concatenate(([False], joined, [False])).astype(np.int8)))
        starts, ends = edge[::2], edge[1::2] + 1
        if self.shortest == 1:
            alone = known.copy()
            alone[:-1] &= ~joined
            alone[1:] &= ~joined
            one = np.flatnonzero(alone)
            starts, ends = np.concatenate((starts, one)), np.concatenate((ends, one + 1))
        long = ends - starts >= self.shortest
        return zip(starts[long].tolist(), ends[long].tolist())

    def stream(self, ids: list[int]) -> Iterator[tuple[int, int, set[int]]]:
        """(start, end, items) of each window that occurs in a stretch of words."""
        state = length = 0
        for i, w in enumerate(ids):
            while state and w not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if (to := self.next[state].get(w)) is None:
                continue
            state, length = to, length + 1
            at = self.marked[state]
            while at > 0:
                for size, items in self.marks[at].items():
                    if size <= length:
                        yield i + 1 - size, i + 1, items
                at = self.marked[self.link[at]]

    def search(self, texts: list[list[bytes]]) -> dict[int, tuple[list[int], set[int]]]:
        """Of each text with any: the merged spans of hit words (start, end, start, end, ...) and
        the items."""
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        ids = np.zeros(int(sizes.sum()), np.int64)
        first = np.concatenate(([0], np.cumsum(sizes)))
        for text, at in zip(texts, first.tolist()):
            ids[at : at + len(text)] = np.fromiter(map(self.vocabulary.get, text, repeat(0)), np.int64, len(text))
        found: dict[int, tuple[list[int], set[int]]] = {}
        if not self.vocabulary:
            return found
        for a, b in sorted(self.stretches(ids)):
            k = int(np.searchsorted(first, a, "right")) - 1
            offset = a - int(first[k])
            spans = []
            for start, end, items in self.stream(ids[a:b].tolist()):
                found.setdefault(k, ([], set()))[1].update(items)
                spans.append((start + offset, end + offset))
            for start, end in sorted(spans):
                merged = found[k][0]
                if merged and start <= merged[-1]:
                    merged[-1] = max(merged[-1], end)
                else:
                    merged += [start, end]
        return found


def _items(benchmark: DataFrame, item_id: str, text: str) -> tuple[DataFrame, int]:
    """id and text of the items that have both, and the number of shards."""
    rows = benchmark.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("id"), F.col(text).alias("text"))
    size = rows.agg(F.sum(F.length("text"))).first()[0] or 0
    return rows, max(1, -(-size // (4 * SHARD_WORDS)))  # a word and its separator take four characters or more, as a rule


def shards_of(benchmark: DataFrame, *, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> Iterator[Automaton]:
    """An automaton for each shard of the items; one shard's items at a time are on the driver."""
    rows, n = _items(benchmark, item_id, text)
    for k in range(n):
        items: dict[str, list[list[bytes]]] = {}
        for row in rows.where(F.pmod(F.xxhash64("id"), F.lit(n)) == k).toLocalIterator():
            items.setdefault(row["id"], []).append(words_of(row["text"]))
        yield Automaton(items, window)


class _Hashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


class Neighbours:
    """A filter of the neighbouring words of all items: which texts may hold a window."""

    def __init__(self, benchmark: DataFrame, *, item_id: str, text: str, window: int):
        rows, _ = _items(benchmark, item_id, text)
        bits, self.shortest = np.zeros(1 << FILTER_BITS, bool), window
        for row in rows.select("text").toLocalIterator():
            words = words_of(row["text"])
            if words:
                self.shortest = min(self.shortest, len(words))
                bits[self._slots(words)] = True
        _hashes.clear()
        self.bits = np.packbits(bits)

    @staticmethod
    def _slots(words: list[bytes]) -> np.ndarray:
        """Of each word alone, then of each two neighbours."""
        if len(_hashes) > CACHE_SIZE:
            _hashes.clear()
        h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
        pairs = h[:-1] * np.uint64(0x9E3779B97F4A7C15) ^ h[1:] * np.uint64(0xC2B2AE3D27D4EB4F)
        return np.concatenate((h, pairs)) >> np.uint64(64 - FILTER_BITS)

    def may_hold(self, words: list[bytes]) -> bool:
        if not hasattr(self, "seen"):
            self.seen = np.unpackbits(self.bits).astype(bool)
        n, least = len(words), self.shortest
        if n < least:
            return False
        known = self.seen[self._slots(words)]
        if least == 1:
            return bool(known[:n].any())
        joined = known[n:]
        if least == 2:
            return bool(joined.any())
        run = np.concatenate(([0], np.cumsum(joined)))
        return bool((run[least - 1 :] - run[: -(least - 1)] == least - 1).any())


FOUND = "struct<n_words:bigint,spans:array<bigint>,items:array<string>>"


def _merged(spans: list[int]) -> list[int]:
    """start, end, start, end of ranges, in any order, as disjoint ones."""
    out: list[int] = []
    for start, end in sorted(zip(spans[::2], spans[1::2])):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += [start, end]
    return out


def search(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", into: str = "found", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs with a struct column into: n_words; spans, the merged ranges of hit words as start, end,
    start, end and so on; items, the ids with an occurring window, as sorted strings."""
    spark = docs.sparkSession
    name = free_name(docs, into)
    automata = shards_of(benchmark, item_id=item_id, text=item_text, window=window)
    first, second = next(automata), next(automata, None)
    if second is None:
        model = spark.sparkContext.broadcast(first)

        def fn(texts: list) -> list[list]:
            words = list(map(words_of, texts))
            found = model.value.search(words)
            names = model.value.items
            return [[{"n_words": len(w), "spans": f[0], "items": sorted(names[i] for i in f[1])} for w, f in zip(words, (found.get(i, ([], ())) for i in range(len(words))))]]

        return map_texts(docs, text, fn, [(name, FOUND)], docs.columns)

    folder = work_dir(spark)
    filter_ = spark.sparkContext.broadcast(Neighbours(benchmark, item_id=item_id, text=item_text, window=window))
    flag, both = free_name(docs, "may_hold"), free_name(docs, "both")

    def look(texts: list) -> list[list]:
        claim("neighbours", _hashes.clear)
        words = list(map(words_of, texts))
        return [[{"n_words": len(w), "spans": [], "items": []} for w in words], list(map(filter_.value.may_hold, words))]

    looked = written(map_texts(docs, text, look, [(name, FOUND), (flag, "boolean")], docs.columns), folder, "looked")
    rest = looked.where(f"`{flag}`").drop(flag)
    for k, automaton in enumerate(chain((first, second), automata)):  # an automaton at a time in a worker
        model = spark.sparkContext.broadcast(automaton)

        def add(rows: list, model=model) -> list[list]:
            found = model.value.search([words_of(r["text"]) for r in rows])
            names, out = model.value.items, []
            for i, r in enumerate(rows):
                old, (spans, items) = r["found"], found.get(i, ([], ()))
                out.append({"n_words": old["n_words"], "spans": _merged([*old["spans"], *spans]), "items": sorted({*old["items"], *(names[j] for j in items)})})
            return [out]

        paired = rest.withColumn(both, F.struct(F.col(f"`{text}`").alias("text"), F.col(f"`{name}`").alias("found")))
        rest = written(map_texts(paired, both, add, [(name, FOUND)], docs.columns), folder, f"shard{k}")
        drop_all(spark, folder, f"shard{k - 1}")
        model.destroy()
    return looked.where(f"not `{flag}`").drop(flag).unionByName(rest)


def cut(text: str, spans: list[int]) -> str:
    """text without the words of spans and what stands between them; one space joins the rest."""
    data = text.encode()
    normal = np.frombuffer(data.translate(NORMAL), np.uint8) != 0x20
    edge = np.diff(np.concatenate(([False], normal, [False])).astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    parts, at = [], 0
    for a, b in zip(spans[::2], spans[1::2]):
        parts.append(data[at : starts[a]].rstrip(b" "))
        at = int(ends[b - 1])
    parts.append(data[at:].lstrip(b" "))
    return b" ".join(p for p in parts if p).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text: str = "text", max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """docs, with their columns: from texts with hits these are cut out, and documents of which
    more than max_coverage is hit go. Clean texts stay as they are."""
    name, new = free_name(docs, "found"), free_name(docs, "cut_text")
    verdict = "struct<kept:boolean,text:string>"

    def judged(t: str | None, spans: list[int], n_words: int) -> dict:
        hit = sum(spans[1::2]) - sum(spans[::2])
        return {"kept": hit <= n_words * max_coverage, "text": cut(t, spans) if hit else t}

    automata = shards_of(benchmark)
    first, second = next(automata), next(automata, None)
    if second is None:  # search and cut in one pass
        model = docs.sparkSession.sparkContext.broadcast(first)

        def fn(texts: list) -> list[list]:
            words = list(map(words_of, texts))
            found = model.value.search(words)
            return [[judged(t, found.get(i, ([], ()))[0], len(w)) for i, (t, w) in enumerate(zip(texts, words))]]

        out = map_texts(docs, text, fn, [(new, verdict)], docs.columns)
    else:
        both = free_name(docs, "both")
        found = written(search(docs, benchmark, text=text, into=name), work_dir(docs.sparkSession), "found")
        source = found.withColumn(both, F.struct(F.col(text).alias("text"), F.col(name)["spans"].alias("spans"), F.col(name)["n_words"].alias("n_words")))
        out = map_texts(source, both, lambda rows: [[judged(r["text"], r["spans"], r["n_words"]) for r in rows]], [(new, verdict)], docs.columns)
    out = out.where(F.col(new)["kept"])
    return out.select(*(F.col(new)["text"].alias(text) if c == text else F.col(f"`{c}`") for c in docs.columns))


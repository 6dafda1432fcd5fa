"""Byte-level BPE encoding and decoding.

Pre-tokenisation needs no regex. Every code point gets a class; white space and apostrophes are
refined by what follows them. A class is a transition function on eight states, the functions
generate a small monoid, and composing them is associative, so the state before every character
of a batch comes from a blocked prefix scan over monoid elements. A table on (state, class) then
says where a pre-token starts. The slices go through pair merging, whose results are cached.

Cases: null and empty texts have no tokens and decode to nothing; very long texts are scanned by
SCAN_CHARS or whole, their pieces merged at n log n; repeated rows give repeated rows; a null id
stays null; an empty table gives an empty result; other columns of the input aren't read.
"""

from __future__ import annotations

import base64
import heapq
import sys
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corundum.llm.common import claim, free_names, map_arrow, type_of

LETTER, NUMBER, OTHER, SPACES, LAST_SPACE, LAST_WHITE, SHORT, LONG, RESET = range(9)
START, IN_LETTERS, IN_NUMBERS, IN_OTHERS, IN_SPACES, GLUE, ONE_MORE, TWO_MORE = range(8)
#: Characters of a scan at once.
SCAN_CHARS = 1 << 18
#: Pre-tokens in each of the cache's two halves.
CACHE_SIZE = 1 << 17
#: Bytes up to which a plain search for the least rank beats a heap.
SHORT_PIECE = 64
NEVER = 1 << 62


def _step(state: int, kind: int) -> tuple[int, bool]:
    """The state after a character, and whether a pre-token starts at it."""
    if kind == RESET:
        return START, True
    if state == ONE_MORE:
        return START, False
    if state == TWO_MORE:
        return ONE_MORE, False
    if kind in (SHORT, LONG):
        if state not in (IN_OTHERS, GLUE):
            return (ONE_MORE if kind == SHORT else TWO_MORE), True
        kind = OTHER
    if kind in (LETTER, NUMBER, OTHER):
        run = (IN_LETTERS, IN_NUMBERS, IN_OTHERS)[kind]
        return run, state not in (run, GLUE)
    if kind == SPACES:
        return IN_SPACES, state != IN_SPACES
    return (GLUE if kind == LAST_SPACE else START), True


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """starts[state, class], the monoid element of each class, compose[f, g] (f first), the state
    that each element leads to from START, and the identity."""
    starts = np.array([[_step(s, c)[1] for c in range(9)] for s in range(8)])
    generators = [tuple(_step(s, c)[0] for s in range(8)) for c in range(9)]
    elements = {tuple(range(8)): 0}
    todo = [tuple(range(8))]
    for f in todo:
        for g in generators:
            h = tuple(g[s] for s in f)
            if h not in elements:
                elements[h] = len(elements)
                todo.append(h)
    n = len(elements)
    compose = np.empty((n, n), np.uint8 if n < 256 else np.uint16)
    for f, i in elements.items():
        for g, j in elements.items():
            compose[i, j] = elements[tuple(g[s] for s in f)]
    leads = np.array([f[START] for f in elements], np.uint8)
    return starts, np.array([elements[g] for g in generators], compose.dtype), compose, leads, n


@lru_cache(1)
def _classes() -> np.ndarray:
    import regex

    table = np.full(0x110000, OTHER, np.uint8)
    codes = np.delete(np.arange(0x110000, dtype=np.uint32), slice(0xD800, 0xE000))
    text = codes.tobytes().decode("utf-32-le")
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER)):
        for m in regex.finditer(pattern, text):
            table[codes[m.start() : m.end()]] = kind
    # The code points with the Unicode property White_Space.
    for a, b in ((0x09, 0x0D), (0x20, 0x20), (0x85, 0x85), (0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x2028, 0x2029), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)):
        table[a : b + 1] = SPACES
    return table


def _scan(elements: np.ndarray) -> np.ndarray:
    """Inclusive prefix compositions: within blocks side by side, then over the blocks' totals."""
    _, _, compose, _, _ = _tables()
    n = len(elements)
    if n <= 64:
        out, acc = np.empty_like(elements), 0
        for i, e in enumerate(elements.tolist()):
            acc = compose[acc, e]
            out[i] = acc
        return out
    width = max(8, int(n**0.5) // 4)
    blocks = -(-n // width)
    padded = np.zeros(blocks * width, elements.dtype)
    padded[:n] = elements
    columns = np.ascontiguousarray(padded.reshape(blocks, width).T)
    flat, size = compose.ravel(), compose.shape[1]
    for j in range(1, width):
        columns[j] = flat[columns[j - 1].astype(np.int32) * size + columns[j]]
    before = np.zeros(blocks, elements.dtype)
    before[1:] = _scan(columns[-1])[:-1]
    return flat[before.astype(np.int32)[None, :] * size + columns].T.reshape(-1)[:n]


def boundaries(codes: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Where pre-tokens start, in an array of code points; the characters at breaks separate
    texts, and each starts a slice of its own."""
    starts, generator, _, leads, _ = _tables()
    kind = _classes()[codes]
    kind[breaks] = RESET
    white = kind == SPACES
    follows = np.empty_like(white)  # a character that isn't white space follows in the same text
    follows[:-1] = ~white[1:] & (kind[1:] != RESET)
    follows[-1:] = False
    last = white & follows
    kind[last] = np.where(codes[last] == 32, LAST_SPACE, LAST_WHITE)
    marks = np.flatnonzero((codes == 39) & (kind != RESET))
    if len(marks):
        ahead = np.zeros(len(codes) + 2, np.uint32)
        ahead[: len(codes)] = codes
        ahead[breaks] = 0
        one, two = ahead[marks + 1], ahead[marks + 2]
        s, t, r, e, v, m, l, d = (ord(x) for x in "strevmld")
        kind[marks[(one == s) | (one == t) | (one == m) | (one == d)]] = SHORT
        kind[marks[((one == r) | (one == v)) & (two == e) | (one == l) & (two == l)]] = LONG
    state = np.empty(len(codes), np.uint8)
    state[:1] = START
    state[1:] = leads[_scan(generator[kind])[:-1]]
    return np.flatnonzero(starts[state, kind])


def load_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks in the text form of one base64 token and its rank per line."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: of all adjacent pairs the one of least rank, leftmost first, is
    merged until none has a rank. A heap keeps longer pieces at n log n."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    n = len(piece)
    if n <= SHORT_PIECE:
        parts = [piece[i : i + 1] for i in range(n)]
        near = [ranks.get(piece[i : i + 2], NEVER) for i in range(n - 1)]
        while near and (least := min(near)) < NEVER:
            i = near.index(least)
            parts[i] += parts.pop(i + 1)
            del near[i]
            if i < len(near):
                near[i] = ranks.get(parts[i] + parts[i + 1], NEVER)
            if i:
                near[i - 1] = ranks.get(parts[i - 1] + parts[i], NEVER)
        return [ranks[p] for p in parts]
    end, back, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = [(ranks[p], i, i + 2) for i in range(n - 1) if (p := piece[i : i + 2]) in ranks]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        if not alive[i] or end[i] >= n or end[end[i]] != stop:
            continue
        j = end[i]
        if not alive[j]:
            continue
        alive[j], end[i] = False, stop
        if stop < n:
            back[stop] = i
            if (r := ranks.get(piece[i : end[stop]])) is not None:
                heapq.heappush(heap, (r, i, end[stop]))
        if (k := back[i]) >= 0 and (r := ranks.get(piece[k:stop])) is not None:
            heapq.heappush(heap, (r, k, stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[piece[i : end[i]]])
        i = end[i]
    return out


class Encoder(dict):
    """Pre-token -> its ids as little-endian unsigned 32-bit integers, filled on demand."""

    assert sys.byteorder == "little" and array("I").itemsize == 4

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.pop(word, None)
        if ids is None:
            ids = array("I", merge_pairs(word.encode(), self.ranks)).tobytes()
        if len(word) <= 256:
            if len(self) >= CACHE_SIZE:  # frequent words come back from the older half
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, np.ndarray, np.ndarray]]:
        """Per text: ids, and of each id's pre-token the code-point offset, as run lengths: the
        offsets of the pre-tokens and their numbers of ids."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and (not group or size + len(texts[at]) < SCAN_CHARS):
                group.append(texts[at])
                size += len(texts[at]) + 1
                at += 1
            text = "\n".join(group) + "\n"
            codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
            lengths = np.fromiter(map(len, group), np.int64, len(group))
            breaks = np.cumsum(lengths + 1) - 1
            cut = boundaries(codes, breaks)
            ends = cut.tolist()
            pieces = [text[a:b] for a, b in zip(ends, ends[1:])]
            first = 0
            for start, stop in zip((breaks - lengths).tolist(), np.searchsorted(cut, breaks).tolist()):
                words = pieces[first:stop]
                ids = list(map(self.__getitem__, words))
                yield b"".join(ids), cut[first:stop] - start, np.fromiter(map(len, ids), np.int64, len(ids)) >> 2
                first = stop + 1


def decode_ids(ids: bytes, vocabulary: list[bytes]) -> bytes:
    return b"".join([vocabulary[i] for i in np.frombuffer(ids, "<u4").tolist()])


_loaded: dict[int, tuple[Encoder, list[bytes]]] = {}


def _model(data: bytes) -> tuple[Encoder, list[bytes]]:
    claim("bpe", _loaded.clear)
    key = hash(data)
    if key not in _loaded:
        ranks = load_ranks(data)
        vocabulary = [b""] * (max(ranks.values()) + 1)
        for token, i in ranks.items():
            vocabulary[i] = token
        _loaded.clear()
        _loaded[key] = Encoder(ranks), vocabulary
    return _loaded[key]


def _apply(df: DataFrame, columns: list[str], path: str, fields: list[tuple[str, pa.DataType, str]], fn: Callable, keep: list[str]) -> DataFrame:
    with open(path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())  # as large as the vocabulary, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, vocabulary = _model(model.value)
        for batch in batches:
            out = fn(batch.column(batch.num_columns - 1), encoder, vocabulary)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), *(pa.array(x, t) for x, (_, t, _) in zip(out, fields))], names=[*(f"k{i}" for i in range(batch.num_columns - 1)), *(f"f{i}" for i in range(len(fields)))])

    source = df.select(*(F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)), *(F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(columns)))
    schema = ", ".join([*(f"k{i} {type_of(df, c)}" for i, c in enumerate(keep)), *(f"f{i} {t}" for i, (_, _, t) in enumerate(fields))])
    names = free_names(keep, [n for n, _, _ in fields])
    return map_arrow(source, run, schema).select(*(F.col(f"k{i}").alias(c) for i, c in enumerate(keep)), *(F.col(f"f{i}").alias(n) for i, n in enumerate(names)))


def encode(df: DataFrame, path: str, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",), offsets: bool = False, decoded: bool = False) -> DataFrame:
    """keep, n_tokens, ids (binary, little-endian unsigned 32-bit integers) of every whole text;
    with offsets, the code-point offset of each pre-token and its number of ids; with decoded, the
    ids decoded again (binary). path: the ranks. A result whose name is among keep gets underscores
    before it."""

    def fn(texts: pa.Array, encoder: Encoder, vocabulary: list[bytes]) -> list[list]:
        found = list(encoder.encode([x or "" for x in texts.to_pylist()]))
        out = [[len(x[0]) >> 2 for x in found], [x[0] for x in found]]
        if offsets:
            out += [[x[1] for x in found], [x[2] for x in found]]
        if decoded:
            out.append([decode_ids(x[0], vocabulary) for x in found])
        return out

    many = pa.list_(pa.int64())
    fields = [("n_tokens", pa.int64(), "long"), ("ids", pa.binary(), "binary")]
    fields += [("piece_offsets", many, "array<long>"), ("piece_ids", many, "array<long>")] * offsets
    fields += [("decoded", pa.binary(), "binary")] * decoded
    return _apply(df, [text], path, fields, fn, list(keep))


def decode(df: DataFrame, path: str, *, ids: str = "ids", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep and decoded (binary): the bytes that the ids of each row stand for; null ids: empty."""

    def fn(rows: pa.Array, _: Encoder, vocabulary: list[bytes]) -> list[list]:
        return [[decode_ids(x or b"", vocabulary) for x in rows.to_pylist()]]

    return _apply(df, [ids], path, [("decoded", pa.binary(), "binary")], fn, list(keep))

"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix.

1.  A bounded sketch counts every n-gram of every document; frequent n-grams get a higher class.
    N-grams are numbered by (class, hash), one order for all documents, the rarest first.
2.  Documents with equal sets are one class. Of a set of n only the first n - ceil(t n) + 1
    columns take part: two sets that link must share one of them.
3.  A column's rows are a block. In it each class meets one hub of like size, the class with the
    fewest rarer n-grams; each is compared exactly with the hub that it shares most columns with.
    What links is one group.
4.  The product proper: over pairs of a column's rows that aren't in one group yet, overlap counts
    accumulate, and pairs go whose count, sizes and ranks leave no room for the overlap that a link
    needs. The rest is compared exactly. Rows in the group of a column's hub meet the others only,
    never each other, so a group of copies makes no square.
5.  Components of all links, and of the classes that the rows of one id are in.

No row, partner or candidate is capped or sampled; the sketch decides the order of work only.

Joins whose smaller side still grows with the corpus (hubs, groups, bitmaps, ids to remove) are merge
joins by hint: what is known of a side's size behind filters and aggregations is a guess, and one that
is too small would have it broadcast. A hot key of theirs is split by the adaptive skew join.

Cases: null and empty texts have an empty set and link with nothing; fewer words than n are one
n-gram; rows that share an id are one document that links if any of its rows does; rows with a
null id get a null component; an empty table gives an empty result; very long texts are read whole;
other columns aren't read, and deduplicate() passes them through whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corundum.llm.common import claim, drop_all, free_name, map_arrow, map_texts, type_of, work_dir, written
from corundum.llm.graph import components, of_documents

WORDS = 5
#: Links are at 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Counters of the sketch, whatever the corpus, and blocks that they are shuffled in.
SLOT_BITS, BLOCKS = 23, 256
#: An n-gram is frequent from FREQUENT times a slot's mean on, and from FREQUENT_LEAST.
FREQUENT, FREQUENT_LEAST = 4, 32
#: A number is 3 bits of class and 60 of hash; of a frequent n-gram the last bits are left free for
#: a salt, which splits its block where blocks of one row are dropped.
CLASS_SHIFT, SALT_BITS = 60, 10
#: Rounds in which classes choose a hub; from the third on those that haven't linked.
HUB_ROUNDS = 3
#: 64-bit words of the bitmap of a set's frequent n-grams.
MAP_WORDS = 8
#: Bits of the filter of wanted ids: eight an id, at least and at most two to the power of these;
#: it is made in blocks.
LEAST_FILTER, MOST_FILTER, FILTER_BLOCK = 20, 27, 15
CACHE_SIZE = 1 << 18
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


class _Hashes(dict):
    """Word -> 64-bit hash."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_hashes = _Hashes()


def shingles(texts: list, size: int = WORDS) -> Iterator[np.ndarray]:
    """Per text (bytes or None) the sorted distinct 64-bit hashes of its n-grams; of the whole text
    if it has fewer words."""
    claim("ngram_join", _hashes.clear)
    if len(_hashes) > CACHE_SIZE:
        _hashes.clear()
    words = [(t or b"").translate(LOWER).split() for t in texts]
    sizes = list(map(len, words))
    w = np.fromiter(map(_hashes.__getitem__, chain.from_iterable(words)), np.uint64, sum(sizes))

    def hashed(w: np.ndarray, size: int) -> np.ndarray:
        h = np.full(max(0, len(w) - size + 1), 0x9E3779B97F4A7C15 * size & (1 << 64) - 1, np.uint64)
        for k in range(size):
            h ^= w[k : len(h) + k]
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        return h

    h, at = hashed(w, size), 0
    for n in sizes:
        s = h[at : at + n - size + 1] if n >= size else hashed(w[at : at + n], n) if n else w[:0]
        at += n
        s.sort()
        yield s[np.concatenate(([True], s[1:] != s[:-1]))] if len(s) > 1 else s


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set."""
    mixed = (s ^ s >> np.uint64(31)) * np.uint64(0xD6E8FEB86659FD93)
    return int(s.sum(dtype=np.uint64).view(np.int64)), int((mixed ^ mixed >> np.uint64(32)).sum(dtype=np.uint64).view(np.int64))


def _count(docs: DataFrame, size: int, folder: str) -> DataFrame:
    """One pass over all texts. Rows with a block hold a task's counts of the sketch, the others
    n, low and high, the size and signature of each document's set."""
    width = (1 << SLOT_BITS) // BLOCKS
    names = ["id", "n", "low", "high", "block", "counts"]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SLOT_BITS, np.uint8)
        pack = zstandard.ZstdCompressor(3).compress
        id_type = None
        for batch in batches:
            id_type = batch.schema.field(0).type
            rows = []
            for s in shingles(batch.column(1).to_pylist(), size):
                slots = s >> np.uint64(64 - SLOT_BITS)
                old = counts[slots]
                counts[slots] = old + (old < 255)  # a task's count ends there, and n-grams of one text may share a slot: only the order of work depends on it
                rows.append((len(s), *_signature(s)))
            n, low, high = zip(*rows) if rows else ((), (), ())
            none = pa.nulls(len(rows))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), none.cast(pa.int32()), none.cast(pa.binary())], names=names)
        for b in range(BLOCKS):
            part = counts[b * width : (b + 1) * width]
            if part.any():
                none = pa.nulls(1)
                yield pa.RecordBatch.from_arrays([none.cast(id_type), none.cast(pa.int32()), none.cast(pa.int64()), none.cast(pa.int64()), pa.array([b], pa.int32()), pa.array([pack(part.tobytes())], pa.binary())], names=names)

    source = docs.select("id", F.col("text").cast("binary"))
    return written(map_arrow(source, count, f"id {type_of(docs, 'id')}, n int, low bigint, high bigint, block int, counts binary"), folder, "counts")


def _sketch(counted: DataFrame) -> bytes:
    """The class of each slot: 0, or one for each doubling of its count from the bound on."""
    width = (1 << SLOT_BITS) // BLOCKS
    total = counted.where("block is null").agg(F.sum("n")).first()[0] or 0
    bound = max(FREQUENT_LEAST, FREQUENT * total / (1 << SLOT_BITS))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums.setdefault(b, np.zeros(width, np.uint64))
                sums[b] += np.frombuffer(unpack(c), np.uint8)
        for b, c in sums.items():
            kind = np.clip(np.floor(np.log2(np.maximum(c, 1) / bound)) + 1, 0, 7).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([kind.tobytes()], pa.binary())], names=["block", "kinds"])

    partial = counted.where("block is not null").select("block", "counts")
    kinds = bytearray(1 << SLOT_BITS)
    for row in map_arrow(partial.repartition("block"), add, "block int, kinds binary").collect():  # BLOCKS rows at most, each of a fixed size
        kinds[row["block"] * width : (row["block"] + 1) * width] = row["kinds"]
    return bytes(kinds)


def _numbered(s: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Sorted numbers (class, hash) of n-grams."""
    kind = classes[s >> np.uint64(64 - SLOT_BITS)]
    g = s >> np.uint64(64 - CLASS_SHIFT)
    if kind.any():
        often = kind > 0
        g[often] &= np.uint64(-(1 << SALT_BITS) & (1 << 64) - 1)
        g |= kind.astype(np.uint64) << np.uint64(CLASS_SHIFT)
        g.sort()
    return g


def _bitmap(g: np.ndarray) -> np.ndarray | None:
    """A bitmap of a set's frequent numbers in MAP_WORDS 64-bit words, then how many there are;
    bits that only one of two sets has bound from below what the other lacks."""
    often = g[g >> np.uint64(CLASS_SHIFT) > 0]
    if not len(often):
        return None
    slot = ((often >> np.uint64(SALT_BITS)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - 6)) | ((often >> np.uint64(SALT_BITS)) % np.uint64(MAP_WORDS)) << np.uint64(6)
    words = np.zeros(MAP_WORDS + 1, np.uint64)
    np.bitwise_or.at(words, (slot >> np.uint64(6)).astype(np.int64), np.uint64(1) << (slot & np.uint64(63)))
    words[-1] = len(often)
    return words.view(np.int64)


def _room(n: Column, m: Column, i: Column, j: Column, percent: int) -> Column:
    """Whether sets of n and m whose first common n-gram has ranks i and j can link: what is left
    after the ranks must hold the overlap, and the sizes must be near enough."""
    near = (100 * F.least(n, m) >= percent * F.greatest(n, m))
    return near & ((100 + percent) * F.least(n - i, m - j) >= percent * (n + m))


def _filter_of(ids: DataFrame) -> tuple[int, bytes]:
    """A bitmap of bounded size with the hashed ids set; it spares texts a shuffle and decides
    nothing. Its blocks are made in executors."""
    n = ids.count()
    bits = min(MOST_FILTER, max(LEAST_FILTER, (8 * n).bit_length()))
    slot = _slot(bits)
    blocks = ids.select(F.shiftright(slot, FILTER_BLOCK).alias("block"), slot.bitwiseAND((1 << FILTER_BLOCK) - 1).cast("int").alias("bit"))
    blocks = blocks.groupBy("block").agg(F.collect_set("bit").alias("bits"))  # a block's bits at most

    def pack(rows: list) -> list[list]:
        out = []
        for r in rows:
            block = np.zeros(1 << FILTER_BLOCK, bool)
            block[r] = True
            out.append(np.packbits(block).tobytes())
        return [out]

    whole = bytearray(1 << bits - 3)
    size = 1 << FILTER_BLOCK - 3
    for row in map_texts(blocks, "bits", pack, [("packed", "binary")], ["block"]).collect():  # the filter, in blocks
        whole[row["block"] * size : (row["block"] + 1) * size] = row["packed"]
    return bits, bytes(whole)


def _slot(bits: int) -> Column:
    return F.xxhash64("id").bitwiseAND((1 << bits) - 1)


def _linked(pairs: DataFrame, docs: DataFrame, size: int, percent: int, folder: str, name: str) -> DataFrame:
    """The pairs (a, b) that link, by exact counts over their whole sets, as a written table. docs:
    id, text."""
    n_bits, packed = _filter_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")))
    wanted = docs.sparkSession.sparkContext.broadcast(packed)  # 1 << MOST_FILTER - 3 bytes at most
    id_type = type_of(docs, "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.frombuffer(wanted.value, np.uint8)
        compress = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            slots = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((bits[slots >> 3] >> (7 - (slots & 7)) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([compress(t or b"") for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "z"])

    texts = map_arrow(docs.select("id", F.col("text").cast("binary"), _slot(n_bits).alias("slot")), pack, f"id {id_type}, z binary")
    # Merge joins, the same at every size.
    both = pairs.hint("merge").join(texts.select(F.col("id").alias("a"), F.col("z").alias("x")), "a").hint("merge").join(texts.select(F.col("id").alias("b"), F.col("z").alias("y")), "b")

    def fn(rows: list) -> list[list]:
        unpack = zstandard.ZstdDecompressor().decompress
        out, last = [], (None, None)
        xs = shingles([unpack(r["x"]) for r in rows], size)
        for r, x in zip(rows, xs):
            if last[0] != r["y"]:  # rows come by b
                last = r["y"], next(shingles([unpack(r["y"])], size))
            y = last[1]
            n = len(x) + len(y)
            if len(x) > len(y):
                x, y = y, x
            at = np.searchsorted(y, x)
            common = int((y[np.minimum(at, len(y) - 1)] == x).sum()) if len(y) else 0
            out.append(common > 0 and 100 * common >= percent * (n - common))
        return [out]

    found = map_texts(both.select("a", "b", F.struct("x", "y").alias("texts")), "texts", fn, [("linked", "boolean")], ["a", "b"])
    out = written(found.where("linked").select("a", "b").distinct(), folder, name)
    wanted.destroy()
    return out


def join(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id (the least id with an equal set),
    component_id (the least id that links reach, its own included)."""
    spark = docs.sparkSession
    folder = work_dir(spark)
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    counted = _count(docs, size, folder)
    sketch = spark.sparkContext.broadcast(_sketch(counted))  # 1 << SLOT_BITS bytes, whatever the corpus

    def prefix(rows: list) -> list[list]:
        classes = np.frombuffer(sketch.value, np.uint8)
        out = []
        for s in shingles(rows, size):
            low, high = _signature(s)
            g = _numbered(s, classes)
            out.append((len(g), low, high, g[: len(g) - -(-percent * len(g) // 100) + (len(g) > 0)].view(np.int64), _bitmap(g)))
        return [list(x) for x in zip(*out)] if out else [[], [], [], [], []]

    named = map_texts(docs.select("id", F.col("text").cast("binary")), "text", prefix, [("n", "int"), ("low", "bigint"), ("high", "bigint"), ("columns", "array<bigint>"), ("bits", "array<bigint>")], ["id"])
    classes = named.groupBy("n", "low", "high").agg(F.min("id").alias("rep"), F.first("columns").alias("columns"), F.first("bits").alias("bits"))
    classes = classes.where(F.col("rep").isNotNull() & (F.col("n") > 0))
    c = F.col
    often = lambda g: F.shiftright(g, CLASS_SHIFT) > 0
    salt = F.when(often(c("g")), F.xxhash64("rep").bitwiseAND((1 << SALT_BITS) - 1)).otherwise(F.lit(0).cast("bigint"))
    entries = classes.select("rep", "n", "bits", F.posexplode("columns").alias("i", "g"))
    first_often = often(c("g")) & (c("i") == c("n") - F.get("bits", MAP_WORDS))
    entries = entries.select((c("g") + salt).alias("g"), "rep", F.when(first_often, c("bits")).alias("bits"), (F.shiftleft(c("i").cast("bigint"), 32) + c("n")).alias("rank"))
    block = Window.partitionBy("g").orderBy("rep")
    matched = entries.select("*", F.lead("rep").over(block).alias("after"), F.lag("rep").over(block).alias("before"))
    matched = matched.where(c("before").isNotNull() | c("after").isNotNull() | often(c("g")))
    free = F.when(often(c("g")), c("g").bitwiseAND(-(1 << SALT_BITS))).otherwise(c("g"))
    shared = matched.select(free.alias("g"), "rep", "bits", c("rank").bitwiseAND((1 << 32) - 1).cast("int").alias("n"), F.shiftright("rank", 32).cast("int").alias("i"))
    shared = written(shared, folder, "shared")
    sketch.destroy()

    links = compared = None
    for k in range(HUB_ROUNDS):
        # Sizes on one step of a ladder can link; the second round's steps lie across the first's.
        step = F.floor(F.log(c("n")) / math.log(100 / percent) + (0.5 if k == 1 else 0))
        rows = shared if k < 2 else shared.join(links.select(c("a").alias("rep")).union(links.select("b")).distinct(), "rep", "left_anti")
        rows = rows.select("g", "rep", "n", "i", step.alias("step"))
        hubs = rows.groupBy("g", "step").agg(F.count("*").alias("size"), F.min(F.struct("i", "rep", "n")).alias("hub")).where("size > 1")  # summed before the shuffle
        first = rows.join(hubs.hint("merge"), ["g", "step"]).where((c("rep") != c("hub.rep")) & _room(c("n"), c("hub.n"), c("i"), c("hub.i"), percent))
        votes = first.groupBy("rep", "n", c("hub.rep").alias("hub")).count().where("20 * count >= n")  # a link shares far more; what hubs miss, the product finds
        chosen = votes.groupBy("rep").agg(F.max(F.struct("count", "hub"))["hub"].alias("hub")).select(F.greatest("rep", "hub").alias("a"), F.least("rep", "hub").alias("b")).distinct()
        chosen = written(chosen.join(compared, ["a", "b"], "left_anti") if k else chosen, folder, f"chosen{k}")
        new = _linked(chosen, docs, size, percent, folder, f"links{k}") if not chosen.isEmpty() else chosen
        links, compared = (links.union(new), compared.union(chosen)) if k else (new, chosen)
    groups = components(links, f"{folder}/groups").withColumnRenamed("node", "rep")

    grouped = shared.select("g", "rep", "n", "i").join(groups.hint("merge"), "rep", "left").withColumn("group", F.coalesce("component", "rep")).drop("component")
    maps = shared.where("bits is not null").groupBy("rep").agg(F.first("bits").alias("bits"))
    grouped = written(grouped.join(maps.hint("merge"), "rep", "left"), folder, "grouped")
    main = grouped.groupBy("g").agg(F.min_by("group", F.struct("i", "rep")).alias("main"), F.min("group").alias("least"), F.max("group").alias("most"))
    mixed = grouped.join(main.where("least <> most").select("g", "main").hint("merge"), "g")
    # A frequent column is tiled by size: only rows on one step of the ladder, or on two neighbours,
    # can link, so a row meets three steps; other columns are one tile.
    size_step = F.when(often(c("g")), F.floor(F.log(c("n")) / math.log(100 / percent))).otherwise(F.lit(0)).cast("int")
    tiled = mixed.withColumn("tile", size_step)
    reach = F.when(often(c("g")), F.array(c("tile") - 1, c("tile"), c("tile") + 1)).otherwise(F.array("tile"))
    x, y = tiled.where("group <> main").withColumn("tile", F.explode(reach)).alias("x"), tiled.alias("y")
    once = (c("y.group") == c("y.main")) | (c("x.rep") < c("y.rep"))  # two others meet twice
    room = _room(c("x.n"), c("y.n"), c("x.i"), c("y.i"), percent)
    near = 100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")
    # Of a frequent column only pairs that it could be the first common one of: then all common
    # ones are frequent, and the bitmaps bound their number.
    left_in = lambda a, b: F.get(f"{a}.bits", MAP_WORDS) - sum((F.bit_count(F.get(f"{a}.bits", k).bitwiseAND(F.bitwise_not(F.get(f"{b}.bits", k)))) for k in range(MAP_WORDS)), F.lit(0))
    fits = (100 + percent) * F.least(left_in("x", "y"), left_in("y", "x")) >= percent * (c("x.n") + c("y.n"))
    met = x.join(y, (c("x.g") == c("y.g")) & (c("x.tile") == c("y.tile")) & (c("x.group") != c("y.group")) & once & near & (~often(c("x.g")) | room & F.coalesce(fits, F.lit(True))))
    x_first = c("x.rep") > c("y.rep")
    by_id = lambda name, of: (F.when(x_first, of("x")).otherwise(of("y")).alias(f"{name}a"), F.when(x_first, of("y")).otherwise(of("x")).alias(f"{name}b"))
    # Frequent columns among the prefix: what it holds beyond the n-grams that aren't frequent.
    kept = lambda t: F.greatest(F.floor(c(f"{t}.n") * (100 - percent) / 100) + 1 - c(f"{t}.n") + F.coalesce(F.get(f"{t}.bits", MAP_WORDS), F.lit(0)), F.lit(0))
    met = met.select(*by_id("", lambda t: c(f"{t}.rep")), *by_id("g", lambda t: c(f"{t}.group")), F.greatest("x.n", "y.n").alias("n"), F.least("x.n", "y.n").alias("m"), F.least(kept("x"), kept("y")).alias("frequent"), room.alias("room"))
    counts = met.groupBy("a", "b").agg(F.count("*").alias("count"), *(F.max(k).alias(k) for k in ("room", "n", "m", "frequent", "ga", "gb")))
    # The overlap is at most the columns counted, the frequent ones, which aren't counted
    # everywhere, and what lies beyond the longer prefix.
    most = c("count") + c("frequent") + F.ceil(c("n") * percent / 100) - 1
    pairs = counts.where(c("room") & ((100 + percent) * most >= percent * (c("n") + c("m")))).select("a", "b", "count", F.least("ga", "gb").alias("u"), F.greatest("ga", "gb").alias("v"))
    pairs = written(pairs, folder, "pairs")
    # Of each two groups the likeliest pair goes first; pairs of groups that it joins needn't follow.
    lead = pairs.groupBy("u", "v").agg(F.max(F.struct("count", "a", "b")).alias("p")).select("u", "v", "p.a", "p.b")
    lead = written(lead, folder, "lead")
    lead_links = _linked(lead.select("a", "b"), docs, size, percent, folder, "lead_links")
    joined = components(lead.join(lead_links, ["a", "b"]).select(c("u").alias("a"), c("v").alias("b")), f"{folder}/joined")
    follow = pairs
    for side in ("u", "v"):
        follow = follow.join(joined.select(c("node").alias(side), c("component").alias(f"{side}_of")), side, "left")
    follow = follow.where(F.coalesce("u_of", "u") != F.coalesce("v_of", "v")).select("a", "b")
    follow = written(follow.join(lead.select("a", "b").union(compared), ["a", "b"], "left_anti"), folder, "follow")
    rest = lead_links.union(_linked(follow, docs, size, percent, folder, "follow_links"))
    signed = counted.where("block is null").select("id", "n", "low", "high")
    reps = signed.groupBy("n", "low", "high").agg(F.min("id").alias("rep"))
    out = of_documents(signed, reps, links.union(rest), folder)
    tables = ("shared", "grouped", "pairs", "lead", "lead_links", "follow", "follow_links", *(f"{t}{k}" for t in ("chosen", "links") for k in range(HUB_ROUNDS)))
    drop_all(spark, folder, *tables, "groups", "joined")
    return out.select(c("id").alias(doc_id), "n_shingles", "class_id", "component_id")


def deduplicate(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs, with their columns: of each component the document of least id; of rows that share an
    id one; documents with a null id all."""
    joined = written(join(docs, text=text, doc_id=doc_id), work_dir(docs.sparkSession), "joined")
    gone = joined.where(F.col("component_id") != F.col(doc_id)).select(doc_id).distinct()
    kept = docs.join(gone.hint("merge"), doc_id, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    if joined.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").isEmpty():
        return kept
    order = Window.partitionBy(doc_id).orderBy(F.xxhash64(text))
    name = free_name(docs, "row_of_id")
    return kept.withColumn(name, F.when(F.col(doc_id).isNull(), 1).otherwise(F.row_number().over(order))).where(F.col(name) == 1).drop(name)

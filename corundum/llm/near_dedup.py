"""MinHash near-dedup: one-permutation hashing, banded buckets, stars of candidates.

1.  One hash of each shingle gives both its bin and its value; a bin keeps the least value. An empty
    bin takes over the value of a full one, which a hash of the bin and of the attempt picks, the
    same in every document (optimal densification). So a set is hashed once, not once a bin.
2.  Documents with equal sets are one class. A band of bins names a bucket; classes that link share
    one of the 32 bands of 4 bins but for five in a hundred million at a similarity of just 0.8.
3.  In each bucket every class is a candidate of one centre, so a bucket makes no more pairs than it
    has classes. A class first meets the centre that it shares most buckets with, then, in buckets whose
    classes aren't in one group yet, a second centre.
4.  Classes that these rounds leave in one bucket but in several groups are settled exactly: their
    shingles are counted among themselves and ordered rarest first, and two of them meet at a shingle
    of their first ones only where ranks and sizes leave room for a link; classes of the largest group
    at a shingle meet the others only, never each other. What is one document's own leaves no room,
    so variants of one text that aren't near enough make no pairs.
5.  A candidate is confirmed by counting over both whole sets. Texts travel compressed, a centre's to
    each part of its star and not to each class.
6.  Components of all links, and of the classes that the rows of one id are in; the least id of a
    component stays.

No row, partner or candidate is capped or sampled. A node is an id and the digest of a text.

Cases: null and empty texts have an empty set and link with nothing; fewer words than a shingle are
one; rows that share an id are one document that links if any of its rows does; rows with a null id
have no component and are kept; an empty table gives an empty result; very long texts are read whole;
other columns aren't read, and deduplicate() passes them through whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corundum.llm.common import drop_all, free_name, map_arrow, map_texts, type_of, work_dir, written
from corundum.llm.graph import components, of_documents
from corundum.llm.ngram_join import _filter_of, _signature, _slot, shingles

WORDS = 2
#: Links are at 100 * intersection >= PERCENT * union.
PERCENT = 80
BIN_BITS, ROWS = 7, 4
#: Classes that one copy of a centre's text is compared with, about.
STAR = 256
U = np.uint64


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> U(30)) * U(0xBF58476D1CE4E5B9)
    x = (x ^ x >> U(27)) * U(0x94D049BB133111EB)
    return x ^ x >> U(31)


def signatures(sets: list[np.ndarray], bits: int = BIN_BITS) -> np.ndarray:
    """A row of 2^bits values a set of sorted hashes; of an empty set zeros."""
    bins = 1 << bits
    values, full = np.zeros((len(sets), bins), U), np.zeros((len(sets), bins), bool)
    for k, s in enumerate(sets):
        if len(s):
            at = (s >> U(64 - bits)).astype(np.int64)  # sorted, as the hashes are
            first = np.flatnonzero(np.concatenate(([True], at[1:] != at[:-1])))
            values[k, at[first]], full[k, at[first]] = s[first], True
    row, empty = np.nonzero(~full & full.any(axis=1, keepdims=True))
    attempt = 0
    while len(row):
        attempt += 1
        source = (_mixed(empty.astype(U) << U(32) | U(attempt)) >> U(64 - bits)).astype(np.int64)
        found = full[row, source]
        values[row[found], empty[found]] = values[row[found], source[found]]
        row, empty = row[~found], empty[~found]
    return values


def bands(values: np.ndarray, rows: int = ROWS) -> np.ndarray:
    """The buckets of each signature, a name for each band; a band's number is part of the name."""
    cut = values.reshape(len(values), -1, rows)
    name = np.broadcast_to(np.arange(cut.shape[1], dtype=U) + U(1), cut.shape[:2]).copy()
    for k in range(rows):
        name = _mixed(name * U(0x9E3779B97F4A7C15) ^ cut[:, :, k])
    return name


def _texts_of(ids: DataFrame, docs: DataFrame, folder: str, name: str) -> DataFrame:
    """id and z, its compressed text, of each of ids (one row of several), as a written table."""
    bits, packed = _filter_of(ids)
    wanted = docs.sparkSession.sparkContext.broadcast(packed)  # of bounded size

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marked = np.frombuffer(wanted.value, np.uint8)
        compress = zstandard.ZstdCompressor(3).compress
        for batch in batches:
            slots = batch.column(2).to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array((marked[slots >> 3] >> (7 - (slots & 7)) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([compress(t or b"") for t in batch.column(1).to_pylist()], pa.binary())], names=["id", "z"])

    texts = map_arrow(docs.select("id", F.col("text").cast("binary"), _slot(bits).alias("slot")), pack, f"id {type_of(docs, 'id')}, z binary")
    out = written(texts.dropDuplicates(["id"]).hint("merge").join(ids.distinct(), "id", "left_semi"), folder, name)
    wanted.destroy()
    return out


def confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int, folder: str, name: str) -> DataFrame:
    """The pairs (a, b) that link, by exact counts over their whole sets, as a written table. b is
    the centre: its text goes once to each STAR of its pairs. docs: id, text."""
    node = type_of(docs, "id")
    texts = _texts_of(pairs.select(F.col("a").alias("id")).union(pairs.select("b")), docs, folder, f"{name}_texts")
    # Merge joins, the same at every size.
    stars = pairs.groupBy("b").agg(F.ceil(F.count("*") / STAR).cast("int").alias("parts"))
    members = pairs.hint("merge").join(stars, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("parts")).cast("int").alias("part"))
    members = members.hint("merge").join(texts.select(F.col("id").alias("a"), "z"), "a").select("b", "part", "a", "z")
    centres = stars.hint("merge").join(texts.select(F.col("id").alias("b"), "z"), "b").select("b", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(None).cast(node).alias("a"), "z")
    dealt = centres.union(members).repartition("b", "part").sortWithinPartitions("b", "part", F.col("a").asc_nulls_first())

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        centre = np.zeros(0, U)
        for batch in batches:
            good = []
            sets = shingles([unpack(z) for z in batch.column(2).to_pylist()], size)
            for is_centre, s in zip(batch.column(1).is_null().to_pylist(), sets):
                if is_centre:  # comes before its classes
                    centre = s.copy()
                    good.append(False)
                    continue
                x, y = (s, centre) if len(s) <= len(centre) else (centre, s)
                n, common = len(x) + len(y), 0
                if len(x):
                    at = np.searchsorted(y, x)
                    common = int((y[np.minimum(at, len(y) - 1)] == x).sum())
                good.append(common > 0 and 100 * common >= percent * (n - common))
            yield batch.filter(pa.array(good, pa.bool_())).select([1, 0])

    out = written(map_arrow(dealt.select("b", "a", "z"), compare, f"a {node}, b {node}"), folder, name)
    drop_all(docs.sparkSession, folder, f"{name}_texts")
    return out


def _near(n: Column, m: Column, percent: int) -> Column:
    return 100 * F.least(n, m) >= percent * F.greatest(n, m)


def left_apart(rest: DataFrame, docs: DataFrame, size: int, percent: int, folder: str) -> DataFrame:
    """Pairs (a, b) with their groups u and v of the classes in rest (rep, n, group) that may link
    and are in different groups: all that do are among them."""
    c = F.col
    rest = written(rest.select("rep", "n", "group").distinct(), folder, "rest")
    texts = _texts_of(rest.select(c("rep").alias("id")), docs, folder, "rest_texts")

    def columns(rows: list) -> list[list]:
        unpack = zstandard.ZstdDecompressor().decompress
        return [[s.view(np.int64).copy() for s in shingles([unpack(z) for z in rows], size)]]

    of_rep = map_texts(texts, "z", columns, [("columns", "array<bigint>")], ["id"])
    held = written(of_rep.join(rest.hint("merge"), c("id") == c("rep")).select("rep", "n", "group", F.explode("columns").alias("g")), folder, "rest_columns")
    often = held.groupBy("g").agg(F.count("*").alias("df")).where("df > 1")
    # What only one class has comes first in its order and meets nothing: it counts as ranks.
    ordered = held.hint("merge").join(often, "g").groupBy("rep", "n", "group").agg(F.array_sort(F.collect_list(F.struct("df", "g"))).alias("s"))  # as long as the text
    own = c("n") - F.size("s")
    first = c("n") - F.ceil(c("n") * percent / 100).cast("int") + 1 - own
    entries = ordered.where(first > 0).select("rep", "n", "group", own.alias("own"), F.posexplode(F.slice("s", F.lit(1), first)).alias("at", "x"))
    entries = written(entries.select("rep", "n", "group", (c("own") + c("at")).alias("i"), c("x.g").alias("g")), folder, "rest_entries")
    sizes = entries.groupBy("g", "group").count().groupBy("g").agg(F.max(F.struct("count", "group"))["group"].alias("main"), F.count("*").alias("groups")).where("groups > 1")
    marked = written(entries.join(sizes.select("g", "main").hint("merge"), "g"), folder, "rest_marked")
    x, y = marked.where("group <> main").alias("x"), marked.alias("y")
    once = (c("y.group") == c("y.main")) | (c("x.rep") < c("y.rep"))  # two outside the main group meet twice
    room = (100 + percent) * F.least(c("x.n") - c("x.i"), c("y.n") - c("y.i")) >= percent * (c("x.n") + c("y.n"))
    met = x.join(y, (c("x.g") == c("y.g")) & (c("x.group") != c("y.group")) & once & _near(c("x.n"), c("y.n"), percent) & room)
    met = met.select(F.greatest("x.rep", "y.rep").alias("a"), F.least("x.rep", "y.rep").alias("b"), F.least("x.group", "y.group").alias("u"), F.greatest("x.group", "y.group").alias("v"))
    out = written(met.groupBy("a", "b").agg(F.count("*").alias("count"), F.first("u").alias("u"), F.first("v").alias("v")), folder, "rest_pairs")
    drop_all(docs.sparkSession, folder, "rest", "rest_texts", "rest_columns", "rest_entries", "rest_marked")
    return out


def join(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row a document: doc_id, n_shingles, class_id (the least id with an equal set),
    component_id (the least id that links reach, its own included)."""
    spark = docs.sparkSession
    folder = work_dir(spark)
    c = F.col
    node = F.struct(c(f"`{doc_id}`").alias("id"), F.unhex(F.md5(F.coalesce(c(f"`{text}`"), F.lit("")))).alias("digest"))
    docs = docs.select(node.alias("id"), c(f"`{text}`").alias("text"))

    def hashed(rows: list) -> list[list]:
        sets = list(shingles(rows, size))
        names = bands(signatures(sets)).view(np.int64) if sets else []
        signs = [_signature(s) for s in sets]
        return [list(map(len, sets)), [a for a, _ in signs], [b for _, b in signs], list(names)]

    named = map_texts(docs.select("id", c("text").cast("binary")), "text", hashed, [("n", "int"), ("low", "bigint"), ("high", "bigint"), ("bands", "array<bigint>")], ["id"])
    named = written(named, folder, "named")
    classes = named.where("id.id is not null and n > 0").groupBy("n", "low", "high").agg(F.min("id").alias("rep"), F.first("bands").alias("bands"))
    classes = written(classes, folder, "classes")
    entries = classes.select("rep", "n", F.explode("bands").alias("key"))
    least = entries.groupBy("key").agg(F.min(F.struct("rep", "n")).alias("hub"), F.max("rep").alias("most")).where("hub.rep <> most")
    shared = written(entries.join(least.select("key", "hub").hint("merge"), "key"), folder, "shared")

    votes = shared.where((c("rep") != c("hub.rep")) & _near(c("n"), c("hub.n"), percent)).groupBy("rep", c("hub.rep").alias("centre")).count()
    best = votes.groupBy("rep").agg(F.max(F.struct("count", "centre"))["centre"].alias("b")).select(c("rep").alias("a"), "b")
    compared = written(best, folder, "first_pairs")
    links = confirmed(compared, docs, size, percent, folder, "first_links")

    def apart(k: str) -> DataFrame:
        """The rows of buckets whose classes are in several groups, with their group; written."""
        groups = components(links, f"{folder}/groups{k}").withColumnRenamed("node", "rep")
        grouped = shared.select("key", "rep", "n").join(groups.hint("merge"), "rep", "left").select("key", "rep", "n", F.coalesce("component", "rep").alias("group"))
        grouped = written(grouped, folder, f"grouped{k}")
        several = grouped.groupBy("key").agg(F.min("group").alias("least"), F.max("group").alias("most"), F.max(F.struct("rep", "n")).alias("hub")).where("least <> most")
        out = written(grouped.join(several.select("key", "hub").hint("merge"), "key"), folder, f"apart{k}")
        drop_all(spark, folder, f"groups{k}", f"grouped{k}")
        return out

    rest = apart("1")
    group_of_hub = rest.where("rep = hub.rep").select("key", c("group").alias("hub_group"))
    second = rest.join(group_of_hub.hint("merge"), "key").where((c("group") != c("hub_group")) & _near(c("n"), c("hub.n"), percent)).select(c("rep").alias("a"), c("hub.rep").alias("b")).distinct()
    both_ways = lambda df: df.select("a", "b").union(df.select(c("b").alias("a"), c("a").alias("b")))
    second = written(second.join(both_ways(compared).hint("merge"), ["a", "b"], "left_anti"), folder, "second_pairs")
    if not second.isEmpty():
        links, compared = links.union(confirmed(second, docs, size, percent, folder, "second_links")), compared.union(second)
    rest = apart("2")
    met = left_apart(rest, docs, size, percent, folder)
    pairs = written(met.join(both_ways(compared).hint("merge"), ["a", "b"], "left_anti"), folder, "pairs")
    if not pairs.isEmpty():
        lead = written(pairs.groupBy("u", "v").agg(F.max(F.struct("count", "a", "b")).alias("p")).select("u", "v", "p.a", "p.b"), folder, "lead")
        lead_links = confirmed(lead.select("a", "b"), docs, size, percent, folder, "lead_links")
        joined = components(lead.join(lead_links, ["a", "b"]).select(c("u").alias("a"), c("v").alias("b")), f"{folder}/joined")
        follow = pairs
        for side in ("u", "v"):
            follow = follow.join(joined.select(c("node").alias(side), c("component").alias(f"{side}_of")), side, "left")
        follow = follow.where(F.coalesce("u_of", "u") != F.coalesce("v_of", "v")).select("a", "b")
        follow = written(follow.join(lead.select("a", "b").hint("merge"), ["a", "b"], "left_anti"), folder, "follow")
        links = links.union(lead_links)
        if not follow.isEmpty():
            links = links.union(confirmed(follow, docs, size, percent, folder, "follow_links"))
    signed = named.select(c("id.id").alias("id"), "n", "low", "high")
    out = of_documents(signed, classes.select("n", "low", "high", "rep"), links, folder, lambda rep: rep["id"])
    drop_all(spark, folder, "shared", "apart1", "apart2", "rest_pairs", "pairs", "lead", "joined", "follow", "first_pairs", "second_pairs", "first_links", "second_links", "lead_links", "follow_links")
    return out.select(c("id").alias(doc_id), "n_shingles", "class_id", "component_id")


def deduplicate(docs: DataFrame, *, text: str = "text", doc_id: str = "doc_id", size: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """docs, with their columns: of each component the document of least id; of rows that share an
    id one; documents with a null id all."""
    joined = written(join(docs, text=text, doc_id=doc_id, size=size, percent=percent), work_dir(docs.sparkSession), "joined")
    gone = joined.where(F.col("component_id") != F.col(doc_id)).select(doc_id).distinct()
    kept = docs.join(gone.hint("merge"), doc_id, "left_anti").select(*(F.col(f"`{c}`") for c in docs.columns))
    if joined.where(F.col(doc_id).isNotNull()).groupBy(doc_id).count().where("count > 1").isEmpty():
        return kept
    name = free_name(docs, "row_of_id")
    order = Window.partitionBy(doc_id).orderBy(F.xxhash64(text))
    return kept.withColumn(name, F.when(F.col(doc_id).isNull(), 1).otherwise(F.row_number().over(order))).where(F.col(name) == 1).drop(name)

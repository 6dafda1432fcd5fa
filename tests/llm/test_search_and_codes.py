"""Vector codes, lexical search and MinHash near-dedup against plain versions, on odd rows."""

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from corundum.llm import lexical_search, near_dedup, vector_codes
from tests.llm.test_llm import EXTRA, brute_components, odd_texts

# 11


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """rows: (vec_id, vector). Codes and errors in the order of rows, and the codebooks."""
    steps = {k: [math.floor(256 * float(np.float32(x))) for x in v] for k, (_, v) in enumerate(rows)}
    order = sorted(steps, key=lambda k: (rows[k][0] is None, rows[k][0] or 0, steps[k]))
    width = len(steps[order[0]]) // parts
    cut = {k: [v[p * width : (p + 1) * width] for p in range(parts)] for k, v in steps.items()}
    books = [[cut[k][p] for k in order[:entries]] for p in range(parts)]

    def nearest(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for v in cut.values():
                groups.setdefault(nearest(v[p], books[p])[1], []).append(v[p])
            for i, g in groups.items():
                books[p][i] = [sum(x) // len(g) for x in zip(*g)]
    found = [[nearest(cut[k][p], books[p]) for p in range(parts)] for k in range(len(rows))]
    return [("".join(f"{i:02x}" for _, i in f), sum(d for d, _ in f)) for f in found], books


def vectors(n, dim=32, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(7, dim))
    return [[float(np.float32(x)) for x in centres[rng.integers(7)] + 0.2 * rng.normal(size=dim)] for _ in range(n)]


def test_vector_codes(spark):
    vs = vectors(150)
    rows = [(300 - i, v, i % 3 if i % 5 else None) for i, v in enumerate(vs)]
    rows += [(7, vs[0], 1), (7, vs[3], 1), (None, vs[4], 2), (8, vs[5], None), (8, vs[5], None)]
    dropped = [(1, None, 1), (2, [math.nan, *vs[0][1:]], 1), (3, [*vs[0][1:], math.inf], 1), (4, [None, *vs[0][1:]], 1)]
    df = spark.createDataFrame([(*r, "own") for r in rows + dropped], "vec_id long, embedding array<float>, label int, code string").repartition(3)
    want, books = brute_codes([r[:2] for r in rows])
    got, found = vector_codes.compress(df)
    assert found.entries.tolist() == books
    by_label = Counter()
    for (_, _, label), (_, error) in zip(rows, want):
        by_label[label] += error
    key = lambda r: repr(r)
    assert sorted((tuple(r) for r in got.collect()), key=key) == sorted(((i, label, code, error, by_label[label]) for (i, _, label), (code, error) in zip(rows, want)), key=key)
    assert found.decode(want[0][0])[:2] == [x / 256 for x in books[0][int(want[0][0][:2], 16)]]


def test_nearest_entries_of_a_tree():
    """Ties, equal entries, entries on a line and large distances."""
    rng = np.random.default_rng(2)
    for n, width, most in itertools.product((1, 2, 7, 64, 200), (1, 4), (2, 9, 1 << 28)):
        entries, queries = (rng.integers(-most, most + 1, (k, width)) for k in (n, 500))
        d = ((queries[:, None, :] - entries[None]) ** 2).sum(axis=2)
        index, best = vector_codes.Tree(entries).nearest(queries)
        assert index.tolist() == d.argmin(axis=1).tolist() and best.tolist() == d.min(axis=1).tolist()


def test_vector_codes_of_few_and_unlike(spark):
    rows = [(1, [0.5] * 20, 1), (2, [0.25] * 20, 1), (3, [0.5] * 21, 1), (4, [], None), (5, [3e38] * 20, None)]
    schema = "vec_id long, embedding array<float>, label int"
    got, books = vector_codes.compress(spark.createDataFrame(rows, schema))
    found = {r["vec_id"]: r for r in got.collect()}
    assert books.entries.shape == (16, 3, 2) and len(found) == 5
    assert [(found[i]["code"], found[i]["error"]) for i in (1, 2, 3, 4)] == [("00" * 16, 0), ("01" * 10 + "00" * 6, 0), (None, None), (None, None)]  # the last parts are filled up and equal
    assert found[5]["code"] == "02" * 10 + "00" * 6 and found[3]["label_error"] == 0
    none, books = vector_codes.compress(spark.createDataFrame([], schema))
    assert books is None and none.count() == 0 and len(none.columns) == 5


# 12

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_search(docs, queries, k=10):
    terms = [Counter(TERM.findall((t or "").translate(LOWER))) for _, t in docs]
    sizes = [sum(c.values()) for c in terms]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    df = Counter(t for c in terms for t in c)
    out = []
    for item, text in queries:
        found = []
        for (i, _), c, s in zip(docs, terms, sizes):
            m = 100 - 75 + 75 * s * n // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in TERM.findall((text or "").translate(LOWER)) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, rank, x[3], -x[0]) for rank, x in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize(("block", "fan", "chunk"), [(8192, 16, 250_000), (7, 2, 60)])
def test_search(spark, monkeypatch, block, fan, chunk):
    for name, value in (("BLOCK_DOCS", block), ("FAN", fan), ("CHUNK_TERMS", chunk)):
        monkeypatch.setattr(lexical_search, name, value)
    texts = odd_texts(12, 50)
    rows = [(i, t, "e", -1, "k") for i, t in enumerate(texts)] + [(None, texts[4], "e", -1, "k"), (9, texts[9], "e", -1, "k"), (None, "an id that is null", "e", -1, "k")]
    asked = [(1, texts[5], 0), (2, "a A b é the nothing-known x", 0), (2, texts[9], 0), (3, None, 0), (4, "", 0), (None, texts[4], 0), (5, "zzz unknown", 0), (6, "one one ONE an id", 0)]
    df = spark.createDataFrame(rows, f"doc_id long, {EXTRA}").repartition(3)
    queries = spark.createDataFrame(asked, "item_id int, text string, score int").repartition(2)
    got = lexical_search.search(df, queries)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute_search([r[:2] for r in rows], [q[:2] for q in asked])


def test_search_of_nothing(spark):
    docs, queries = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([("x", "b")], "item_id string, text string")
    assert lexical_search.search(docs.where("false"), queries).count() == 0
    assert lexical_search.search(docs, queries.where("false")).count() == 0
    assert [tuple(r) for r in lexical_search.search(docs, queries).collect()] == brute_search([(1, "a b")], [("x", "b")])


def test_bounds_are_never_below_scores():
    rng = np.random.default_rng(3)
    doc, term = (x.ravel() for x in np.meshgrid(np.arange(100), np.arange(5), indexing="ij"))
    held = rng.random(500) < 0.3
    block = lexical_search.Block(doc[held], term[held], rng.integers(1, 1000, held.sum()), 100)
    terms, weights = np.array([0, 2, 4]), np.array([3, 1, 7])
    scores = block.sums(0, 0, 100, terms, weights)
    for level in range(1, len(block.levels)):
        width = lexical_search.FAN**level
        bounds = block.sums(level, 0, block.levels[level][0], terms, weights)
        assert all(bounds[i // width] >= s for i, s in enumerate(scores))


def test_very_long_documents_have_exact_shares():
    sizes = np.array([10**7, 3], np.int64)
    tf = np.array([5, 2], np.int64)
    n, total = 10**12, 10**15
    want = [10**9 * t // (1000 * t + 8 * (25 + 75 * s * n // total)) for t, s in zip((5, 2), (10**7, 3))]
    assert lexical_search._shares(tf, sizes, n, total).tolist() == want


# 13


def near_rows(seed=8):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choices("abcdef", k=5)) for _ in range(300)]
    texts = odd_texts(9, 20)
    for b in [rng.choices(vocabulary, k=rng.randint(30, 90)) for _ in range(8)]:
        for edits in (0, 0, 1, 1, 2, 3, 4, 5, 6, 8):
            w = list(b)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            texts.append(" ".join(w).upper() if edits == 1 else "\t".join(w))
    chain = rng.choices(vocabulary, k=80)
    texts += [" ".join(chain[k : k + 60]) for k in range(0, 20, 3)] + ["few", "few", "Few", "a b", "a  B"]
    texts += [" ".join([*chain[:30], *rng.choices(vocabulary, k=5)]) for _ in range(40)]
    return [(i, t, "e", -1, "k") for i, t in enumerate(texts)] + [(None, texts[30], "e", -1, "k"), (40, texts[40], "e", -1, "k")]


@pytest.mark.parametrize(("size", "percent", "star"), [(2, 80, 256), (2, 80, 1)])
def test_near_dedup(spark, monkeypatch, size, percent, star):
    monkeypatch.setattr(near_dedup, "STAR", star)
    rows = near_rows()
    df = spark.createDataFrame(rows, f"doc_id long, {EXTRA}").repartition(3)
    want, sizes = brute_components([r[:2] for r in rows], size, percent)
    got = near_dedup.join(df, size=size, percent=percent).collect()
    assert len(got) == len(rows)
    assert [r for r in got if r["doc_id"] is not None and r["component_id"] != want[r["doc_id"]]] == []
    assert all(r["n_shingles"] in sizes[r["doc_id"]] for r in got)
    if star > 1:
        kept = near_dedup.deduplicate(df, size=size, percent=percent)
        ids = [r["doc_id"] for r in kept.collect()]
        assert kept.columns == df.columns and sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1


def test_near_dedup_of_unlike_rows_of_an_id(spark):
    rng = random.Random(15)
    a, b, d = ([f"{k}{rng.randrange(10**6)}" for _ in range(60)] for k in "abd")
    rows = [(3, a), (5, a), (5, b), (7, [*b[:-1], "other"]), (8, d), (9, d), (9, []), (10, d), (10, a), (12, ["alone"]), (12, []), (13, []), (None, b)]
    rows = [(i, " ".join(w)) for i, w in rows]
    want, _ = brute_components(rows, 2, 80)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = near_dedup.join(df).collect()
    assert len(got) == len(rows) and want[7] == 3
    for r in got:
        assert r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]), r
    assert near_dedup.join(df.where("false")).count() == 0


def test_near_dedup_of_very_long_texts_and_text_ids(spark):
    rng = random.Random(16)
    long = [f"w{rng.randrange(10**5)}" for _ in range(60_000)]
    rows = [("1", " ".join(long)), ("2", " ".join(long[2000:])), ("3", " ".join(long[:20_000])), ("4", " ".join(reversed(long)))]
    got = {r["doc_id"]: r["component_id"] for r in near_dedup.join(spark.createDataFrame(rows, "doc_id string, text string")).collect()}
    assert got == {"1": "1", "2": "1", "3": "3", "4": "4"}


def test_signatures_agree_as_sets_do():
    """Unbiased at every size, densified or not, and one band of all is shared at 0.8."""
    rng = np.random.default_rng(4)
    for n in (5, 20, 100, 2000):
        agree, missed = [], 0
        for _ in range(300):
            x = rng.integers(0, 1 << 63, n * 6 // 5, dtype=np.uint64) * np.uint64(2)
            k = n // 5
            a, b = np.unique(x[:n]), np.unique(np.concatenate((x[: n - k // 2], x[n : n + k // 2])))
            values = near_dedup.signatures([a, b])
            agree.append((values[0] == values[1]).mean() - len(np.intersect1d(a, b)) / len(np.union1d(a, b)))
            missed += not (near_dedup.bands(values)[0] == near_dedup.bands(values)[1]).any()
        assert abs(np.mean(agree)) < 0.04 and missed == 0
    assert near_dedup.signatures([np.zeros(0, np.uint64)]).tolist() == [[0] * 128]


def test_vacuum(spark, tmp_path):
    from corundum.sources import folders

    for name in (f"{folders.PREFIX}old", "own"):
        (tmp_path / name).mkdir()
    assert folders.vacuum(spark, f"file://{tmp_path}", 1) == 0
    assert folders.vacuum(spark, f"file://{tmp_path}", 0) == 1 and [p.name for p in tmp_path.iterdir()] == ["own"]

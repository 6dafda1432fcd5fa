"""Quality rules: base rules, and a hashed n-gram log-likelihood ratio.

Every word gives the trigrams of all its code points, or itself if it has less than three, hashed
into BUCKETS. The trusted target is the set of documents labelled good, the raw corpus is all of
them; both are multinomials over buckets with one added count each. A document's score is the sum
over its n-grams of log p(target) - log p(raw), divided by their number; it is kept if no base rule
fails and the score reaches a fixed threshold. All of it is DataFrame functions; what
reaches the driver is two counts a bucket.

Cases: null and empty texts have no words and fail a base rule; without any trusted document the
target says nothing, all scores are 0; several labels of a document count as their largest; rows
with equal ids are judged each by its own text; very long texts are read whole; an empty table gives
an empty result; other columns are left alone, and a result whose name one of them has gets
underscores before it.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corundum.llm.common import WHITE, free_name, let, words_of

BUCKETS = 1 << 16
#: Clean text lies about at the raw corpus, junk about a nat an n-gram below it or more. The room
#: between lets a language be labelled good half as often as the others without being taken for junk.
THRESHOLD = -0.6
SYMBOLS = "#*$%&|<>"
#: Ids of good documents that are broadcast at most: some MB.
FEW_IDS = 200_000


def n_grams(word: Column) -> Column:
    """The number of a word's n-grams: one at each code point but the last two, one at least."""
    return F.greatest(F.length(word) - 2, F.lit(1))


def bucket(word: Column, at: Column) -> Column:
    """The 64-bit xxHash (seed 42) of the n-gram at a place, from 1 on, modulo BUCKETS."""
    return F.xxhash64(F.substring(word, at, F.lit(3))).bitwiseAND(BUCKETS - 1).cast("int")


def repeated_words(words: Column) -> Column:
    """Words in windows of three that are found twice or more in the text, the first included."""
    empty = F.array().cast("array<bigint>")
    hashes = F.when(F.size(words) >= 3, F.transform(F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)))).otherwise(empty)

    def covered(ordered: Column) -> Column:
        same = lambda x, j: F.coalesce(F.get(ordered, j)["h"] == x["h"], F.lit(False))
        twice = F.filter(ordered, lambda x, j: same(x, j - 1) | same(x, j + 1))
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    def count(h: Column) -> Column:
        ordered = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(ordered, covered))

    return let(hashes, count)


def base_rules(text: Column, score: Callable[[Column], Column] | None = None) -> Column:
    """A struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed; with
    score, a function of the words, also its value as log_ratio. Words are split once for both."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^ \t\n\x0B\f\r]"))
    dup_lines = let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x)))

    def rules(words: Column) -> Column:
        more = [score(words).alias("log_ratio")] if score else []
        return F.struct(F.size(words).cast("long").alias("n_words"), repeated_words(words).cast("long").alias("n_repeat_words"), *more)

    s = let(words_of(text), rules)
    return let(s, lambda s: F.struct(
        s["n_words"].alias("n_words"),
        F.length(F.translate(text, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        dup_lines.cast("long").alias("n_dup_lines"),
        s["n_repeat_words"].alias("n_repeat_words"),
        ((s["n_words"] < 50) | (100 * s["n_repeat_words"] > 50 * s["n_words"])).alias("base_failed"),
        *([s["log_ratio"].alias("log_ratio")] if score else []),
    ))


def _counts(words: DataFrame) -> dict[int, int]:
    """N-grams by bucket, of a table of words w. Words repeat, so they are counted before they are cut."""
    counted = words.groupBy("w").count()
    hashed = counted.select("count", "w", F.explode(F.sequence(F.lit(1), n_grams(F.col("w")))).alias("at")).select("count", bucket(F.col("w"), F.col("at")).alias("b"))
    return {r["b"]: r["n"] for r in hashed.groupBy("b").agg(F.sum("count").alias("n")).collect()}  # BUCKETS rows at most


def log_ratios(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> list[float]:
    """log p(target) - log p(raw) of each bucket, over all documents. The raw corpus is counted where
    it lies; of the target only texts that a label is called good for go on, by a semi-join. Its ids
    are broadcast where they are counted to be few, else both sides meet by a merge join, for which
    the planner filters the texts by a sketch of the ids."""
    docs = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    good = labels.where(F.col("quality") == 1).select(F.col("doc_id").alias("id")).distinct()
    few = good.limit(FEW_IDS + 1).count() <= FEW_IDS
    words = lambda df: df.select(F.explode(words_of(F.col("text"))).alias("w"))
    raw_of = _counts(words(docs))
    target_of = _counts(words(docs.join(good.hint("broadcast" if few else "merge"), "id", "left_semi")))
    raw, target = ([1 + of.get(b, 0) for b in range(BUCKETS)] for of in (raw_of, target_of))
    if not target_of:
        return [0.0] * BUCKETS
    log_sum = math.log(sum(target)) - math.log(sum(raw))
    return [math.log(t) - math.log(r) - log_sum for t, r in zip(target, raw)]


def ratio(words: Column, weights: list[float]) -> Column:
    """The log-likelihood ratio of a text's n-grams, by the n-gram; 0 without words."""
    table = F.split(F.lit(",".join(map(repr, weights))), ",").cast("array<double>")  # folded to one literal
    total = F.aggregate(words, F.lit(0.0), lambda a, w: F.aggregate(F.sequence(F.lit(1), n_grams(w)), a, lambda x, at: x + F.get(table, bucket(w, at))))
    number = F.aggregate(words, F.lit(0).cast("bigint"), lambda a, w: a + n_grams(w))
    return F.when(F.size(words) > 0, total / number).otherwise(F.lit(0.0))


def judge(docs: DataFrame, weights: list[float], *, text: str = "text", into: str = "quality_rules", threshold: float = THRESHOLD) -> DataFrame:
    """docs with a struct column into: the fields of base_rules(), log_ratio and kept."""
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_ratio")
    rules = base_rules(F.col(f"`{text}`"), lambda words: ratio(words, weights))
    verdict = lambda x: F.struct(*(x[c].alias(c) for c in fields), (~x["base_failed"] & (x["log_ratio"] >= threshold)).alias("kept"))
    return docs.withColumn(free_name(docs, into), let(rules, verdict))


def filter_quality(docs: DataFrame, labels: DataFrame, *, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The documents that are kept, with their columns."""
    name = free_name(docs, "quality_rules")
    judged = judge(docs, log_ratios(docs, labels, text=text, doc_id=doc_id), text=text, into=name)
    return judged.where(F.col(name)["kept"]).drop(name)

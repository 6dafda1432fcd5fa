"""Toxicity by multiple-instance learning.

A text is a bag of sentences. Each sentence has a score, the logistic of a weighted sum over its
distinct words (hashed whole and by their first letters), and the text's score is their noisy-or,
1 - prod(1 - score): it is toxic if any sentence is. Only texts have labels; the gradient of the
noisy-or carries them to the sentences that explain them, which afterwards locates the offending
sentences.

Training takes at most TRAIN_TEXTS labelled texts, those of least hash, whole; scoring covers every
word of every text.

Cases: null and empty texts have no sentence and score 0; without labels, or with labels of one
kind, every score is the share of toxic labels (0 without any); repeated rows score alike; several
labels of a document count as their largest; an empty table gives an empty result; very long texts
are scored whole; other columns aren't read, but for those of keep.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corundum.llm.common import claim, map_texts

BITS = 20
#: Bound of the labelled texts that training takes.
TRAIN_TEXTS = 6_000
#: Lengths of the hashed beginnings of a word, besides the whole word.
PREFIXES = (4, 5, 6, 7)
#: A feature takes part if its rates in toxic and other training texts differ by that many
#: standard errors, and if it is in that many texts.
LEAST_Z, LEAST_TEXTS = 3.0, 3
EPOCHS, RATE, DECAY, PRIOR = 300, 0.3, 0.02, -5.0
THRESHOLD = 0.7
CACHE_SIZE = 1 << 18
SPLIT = str.maketrans({c: " " for c in "\t\r\x0b\f.,;:!?\"'()[]{}*#$%&|<>=/\\-_"})


def features(word: str) -> list[int]:
    import xxhash

    parts = [f"={word}", *(word[:k] for k in PREFIXES if len(word) >= k)]
    return [xxhash.xxh3_64_intdigest(p) & ((1 << BITS) - 1) for p in parts]


def sentences(text: str | None) -> list[str]:
    """Parts that end in a line break or after . ! ? and white space; never empty."""
    out = []
    for line in (text or "").split("\n"):
        for end in (". ", "! ", "? "):
            line = line.replace(end, end[0] + "\n")
        out += [s for s in line.split("\n") if s.strip()]
    return out


def bag(text: str | None) -> list[set[str]]:
    """The distinct words of each sentence that has any."""
    return [w for s in sentences(text) if (w := set(s.lower().translate(SPLIT).split()))]


def noisy_or(scores: np.ndarray) -> float:
    return float(-np.expm1(np.log1p(-np.minimum(scores, 1 - 1e-12)).sum()))


def logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def fit(examples: Iterable[tuple[str | None, int]]) -> tuple[np.ndarray, float, float]:
    """Weights, bias and the share of toxic labels, by gradient steps on the log loss of noisy-or,
    both kinds of labels weighing the same."""
    known: dict[str, list[int]] = {}
    bags, y = [], []
    for text, label in examples:
        y.append(label)
        found = bag(text)
        for w in set().union(*found).difference(known):
            known[w] = features(w)
        bags.append([np.fromiter(chain.from_iterable(map(known.__getitem__, words)), np.int32) for words in found])
    known.clear()
    weights = np.zeros(1 << BITS, np.float32)
    share = sum(y) / max(1, len(y))
    if share in (0, 1):
        return weights, PRIOR, share
    label = np.array(y, np.float64)
    seen = np.zeros((2, 1 << BITS), np.int32)
    for b, k in zip(bags, y):
        if b:
            seen[k, np.unique(np.concatenate(b))] += 1
    n0, n1 = len(y) - label.sum(), label.sum()
    rate = (seen[0] + seen[1] + 1) / (n0 + n1 + 2)
    z = (seen[1] / n1 - seen[0] / n0) / np.sqrt(rate * (1 - rate) * (1 / n0 + 1 / n1))
    chosen = (np.abs(z) >= LEAST_Z) & (seen.sum(axis=0) >= LEAST_TEXTS)
    number = np.where(chosen, np.cumsum(chosen) - 1, -1)
    used = np.flatnonzero(chosen)
    if not len(used):
        return weights, PRIOR, 0.0
    # One entry for each chosen feature of a sentence; all sentences of a text without any are alike.
    entry, sentence, text_of, m = [], [], [], 0
    for t, b in enumerate(bags):
        for s in b:
            local = number[s]
            local = local[local >= 0]
            entry.append(local)
            sentence.append(np.full(len(local), m))
            text_of.append(t)
            m += 1
    entry, sentence, text_of = np.concatenate(entry), np.concatenate(sentence), np.array(text_of)
    w, bias = np.zeros(len(used)), PRIOR
    importance = np.where(label == 1, 0.5 / n1, 0.5 / n0)
    first, second, first_b, second_b = np.zeros(len(used)), np.zeros(len(used)), 0.0, 0.0
    for step in range(1, EPOCHS + 1):
        p = logistic(bias + np.bincount(sentence, w[entry], m))
        whole = np.clip(-np.expm1(np.bincount(text_of, np.log1p(-np.minimum(p, 1 - 1e-9)), len(y))), 1e-6, 1)
        # d loss / d z of a sentence: p of a clean text, -p (1 - P) / P of a toxic one.
        dz = p * (np.where(label == 1, -(1 - whole) / whole, 1.0) * importance)[text_of]
        grad = np.bincount(entry, dz[sentence], len(used)) + DECAY * w / len(used)
        db = dz.sum()
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        first_b, second_b = 0.9 * first_b + 0.1 * db, 0.99 * second_b + 0.01 * db**2
        scale = RATE * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step) / (1 + step / 100)
        w -= scale * first / (np.sqrt(second) + 1e-8)
        bias -= 0.3 * scale * first_b / (second_b**0.5 + 1e-8)
    weights[used] = w
    return weights, float(bias), share


class Scorer(dict):
    """Word -> its weight, filled on demand."""

    def __init__(self, model: tuple[np.ndarray, float, float]):
        super().__init__()
        self.weights, self.bias, self.share = model

    def __missing__(self, word: str) -> float:
        w = self[word] = float(self.weights[features(word)].sum())
        return w

    def sentence_scores(self, words: list[set[str]]) -> np.ndarray:
        if len(self) > CACHE_SIZE:
            self.clear()
        return logistic(self.bias + np.fromiter((sum(map(self.__getitem__, s)) for s in words), np.float64, len(words)))


def training_rows(docs: DataFrame, labels: DataFrame, rows: Column, *, text: str = "text", doc_id: str = "doc_id", limit: int = TRAIN_TEXTS) -> Iterator[tuple[str | None, int]]:
    """At most limit labelled texts for which rows holds, those of least hash."""
    told = labels.select(F.col("doc_id").alias("id"), F.col("toxic").cast("int").alias("y")).where("y is not null and id is not null")
    told = told.withColumn(doc_id, F.col("id")).where(rows).groupBy("id").agg(F.max("y").alias("y"))
    told = told.orderBy(F.xxhash64("id"), "id").limit(limit)
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text"))
    for r in texts.join(F.broadcast(told), "id").select("text", "y").toLocalIterator():  # limit rows are broadcast
        yield r["text"], r["y"]


_scorers: dict[str, Scorer] = {}


def score(docs: DataFrame, model: tuple[np.ndarray, float, float], *, text: str = "text", keep: list[str], worst: bool = False) -> DataFrame:
    """keep and score, a noisy-or from 0 to 1; with worst, also the sentence that scores highest and
    its score."""
    key = uuid.uuid4().hex
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 1 << BITS weights

    def fn(texts: list) -> list[list]:
        claim("toxicity", _scorers.clear)
        if key not in _scorers:
            _scorers.clear()
            _scorers[key] = Scorer(shared.value)
        scorer = _scorers[key]
        out: list[list] = [[], [], []]
        for t in texts:
            words = bag(t)
            if scorer.share in (0, 1) or not words:
                found = (float(scorer.share) if scorer.share in (0, 1) else 0.0, None, None)
            else:
                p = scorer.sentence_scores(words)
                top = int(p.argmax())
                found = (noisy_or(p), [s for s in sentences(t) if s.translate(SPLIT).split()][top] if worst else None, float(p[top]))
            for column, x in zip(out, found):
                column.append(x)
        return out if worst else out[:1]

    fields = [("score", "double")] + [("worst_sentence", "string"), ("worst_score", "double")] * worst
    return map_texts(docs, text, fn, fields, keep)

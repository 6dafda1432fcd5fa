"""Token counts by a count-only Viterbi search over a unigram vocabulary.

An Aho-Corasick automaton lists all vocabulary pieces in a text; over them a dynamic program carries
two numbers per character, the best score and its number of pieces, and no back pointers. Ties go
as in the tokenizer: edges into a character are tried by ascending start and a later one must score
more, not the same. A character that is no piece itself has an edge of the least score less
UNKNOWN, worth one token for each byte in UTF-8 (byte fallback).

Pieces hold a space mark only at their beginning or are marks only, so the best path of a text is
that of its words, and words are cached.

Cases: null and empty texts have no tokens and score 0; very long texts are counted word by word, a
very long word in one pass; repeated rows give repeated rows; null ids are kept; an empty table gives
an empty result; other columns aren't read, but for those of keep.
"""

from __future__ import annotations

import re
from itertools import repeat

from pyspark.sql import DataFrame

from corundum.llm.common import claim, map_texts

MARK = "▁"
UNKNOWN = 10.0
CACHE_SIZE = 1 << 18
WORDS = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def load_vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model, without its control, unknown and byte pieces."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    return {m.id_to_piece(i): m.get_score(i) for i in range(m.get_piece_size()) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))}


class Counter(dict):
    """Word (with its space marks) -> (tokens, score), filled on demand."""

    def __init__(self, vocabulary: dict[str, float]):
        super().__init__()
        import ahocorasick

        if any(MARK in p.lstrip(MARK) for p in vocabulary):
            raise ValueError("a piece holds a space mark after its first other character")
        self.pieces = ahocorasick.Automaton()
        for p, score in vocabulary.items():
            self.pieces.add_word(p, (len(p), score))
        self.pieces.make_automaton()
        self.single = frozenset(p for p in vocabulary if len(p) == 1)
        self.unknown = min(vocabulary.values()) - UNKNOWN

    def search(self, word: str) -> tuple[int, float]:
        n = len(word)
        best, count = [float("-inf")] * (n + 1), [0] * (n + 1)
        best[0], end, unknown = 0.0, 0, self.unknown

        def settle(upto: int) -> None:
            """Edges of unknown characters into the ends that no piece reached since."""
            nonlocal end
            while end < upto:
                c = word[end]
                if c not in self.single and best[end] + unknown > best[end + 1]:
                    best[end + 1] = best[end] + unknown
                    count[end + 1] = count[end] + len(c.encode())
                end += 1

        for last, (size, score) in self.pieces.iter(word):  # by end, then by ascending start
            settle(last)
            start = last + 1 - size
            total = best[start] + score
            if total > best[last + 1]:
                best[last + 1], count[last + 1] = total, count[start] + 1
        settle(n)
        return count[n], best[n]

    def __missing__(self, word: str) -> tuple[int, float]:
        if len(self) >= CACHE_SIZE:
            self.clear()
        found = self.search(word)
        if len(word) <= 256:
            self[word] = found
        return found

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        if "  " in text or MARK in text or text[-1] == " " or text[0] == " ":
            words = WORDS.findall(MARK + text.replace(" ", MARK))
        else:
            words = map(str.__add__, repeat(MARK), text.split(" "))
        found = list(map(self.__getitem__, words))
        return sum([x[0] for x in found]), sum([x[1] for x in found])


_counters: dict[int, Counter] = {}


def count_tokens(df: DataFrame, vocabulary: dict[str, float], *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep, n_tokens and score, of every whole text."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)  # as large as the vocabulary, whatever the corpus
    key = hash(frozenset(vocabulary.items()))

    def fn(texts: list) -> list[list]:
        claim("token_count", _counters.clear)
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counter(shared.value)
        found = list(map(_counters[key].count, texts))
        return [[x[0] for x in found], [x[1] for x in found]]

    return map_texts(df, text, fn, [("n_tokens", "bigint"), ("score", "double")], list(keep))

"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates every vocabulary match that ends at each character; the
dynamic programme carries the best score and that path's piece count, and keeps no pieces.
Text is split at white space and each word takes a leading U+2581, so words are independent
and a worker computes each different word once.

Tie rules are those of the tokenizers library's Unigram model: starts are tried from left to
right and only a strictly better score replaces an earlier one, so of equal scores the longest
last piece wins; a character that no piece covers costs the lowest score less ten and falls
back to its UTF-8 bytes.

Defined results: null text counts as empty and has no tokens; an empty table gives an empty
result; rows with equal ids are counted separately; further columns are ignored.
"""

from __future__ import annotations

import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.runtime import ship

MARK = "▁"
UNKNOWN_COST = 10.0
_REMEMBERED = 300_000
#: Characters with the Unicode property White_Space.
_WORD = re.compile("[^\t\n\x0b\x0c\r \x85\xa0  -     　]+")
_ODD = re.compile("[\x1c-\x1f]")  # white space to str.split alone


@lru_cache(maxsize=2)
def read_vocabulary(path: str) -> tuple[tuple[str, float], ...]:
    """(piece, score) of the ordinary pieces of a sentencepiece file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    keep = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in keep)


class CountingViterbi:
    def __init__(self, vocabulary):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min((s for _, s in vocabulary), default=0.0) - UNKNOWN_COST
        self.known: dict[str, int] = {}

    def best(self, text: str) -> tuple[float, int]:
        """Best score and the number of pieces of that path."""
        n = len(text)
        ends: list[list] = [[] for _ in range(n)]
        for end, (length, score) in self.automaton.iter(text):  # the longest match of an end comes first
            ends[end].append((length, score))
        scores, counts = [0.0] * (n + 1), [0] * (n + 1)
        for end in range(n):
            best, count, single = None, 0, False
            for length, score in ends[end]:
                total = score + scores[end + 1 - length]
                single |= length == 1
                if best is None or total > best:
                    best, count = total, counts[end + 1 - length] + 1
            if not single:
                total = self.unknown + scores[end]
                if best is None or total > best:
                    best, count = total, counts[end] + len(text[end].encode("utf-8", "replace"))
            scores[end + 1], counts[end + 1] = best, count
        return scores[n], counts[n]

    def count_word(self, word: str) -> int:
        found = self.known.get(word)
        if found is None:
            if len(self.known) > _REMEMBERED:
                self.known.clear()
            found = self.known[word] = self.best(MARK + word)[1]
        return found

    def count(self, text: str | None) -> tuple[int, int]:
        """Words and tokens of a text."""
        if not text:
            return 0, 0
        words = _WORD.findall(text) if _ODD.search(text) else text.split()
        return len(words), sum(map(self.count_word, words))


@lru_cache(maxsize=2)
def viterbi(path: str) -> CountingViterbi:
    return CountingViterbi(read_vocabulary(path))


def token_counts(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens of every document."""

    def run(batches):
        counter = viterbi(vocabulary_path)
        for batch in batches:
            found = [counter.count(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())],
                names=["doc_id", "n_words", "n_tokens"],
            )

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_words long, n_tokens long")

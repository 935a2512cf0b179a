"""Language identification by word-first backoff.

A word that the model knows adds its log frequency in each language; an unseen word falls
back to its longest known character n-grams, five characters first, then four, down to one.
Words are runs of Unicode letters (categories L*).

The model is fitted on a bounded sample of the labelled rows: about ``TRAIN_DOCS`` documents
of each language, chosen by a hash of id and text, so reruns agree.  Every word and n-gram of
that sample is kept, those seen once too; the sample alone bounds what is collected and
broadcast, whatever the corpus holds.

Defined results: null text, and text without a letter, gives ``und`` with score 0; a null
label is never learned from; without any labelled row every document is ``und``; equal scores
go to the first language in code-point order; a null id counts as held out only if its digest
says so (null digests as the empty string); rows with equal ids are predicted separately; a
very long text is read whole, one at a time; an empty table gives an empty result; further
columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import sys
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.llm.common import staged
from cartoflow.llm.textcore import lean
from cartoflow.runtime import ship

TRAIN_DOCS = 3000
LONGEST = 5
#: Words whose backoff scores a worker remembers.
_REMEMBERED = 100_000
#: Texts whose words are looked up at once.
_TEXTS = 256


def _letters() -> re.Pattern:
    """Runs of letters: what ``\\w`` takes besides letters (other digits, fractions, letter-like numbers) is left out as ranges."""
    other = [c for c in map(chr, range(sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal()]
    ranges: list[list[str]] = []
    for c in other:
        if ranges and ord(c) == ord(ranges[-1][1]) + 1:
            ranges[-1][1] = c
        else:
            ranges.append([c, c])
    return re.compile(r"[^\W\d_" + "".join(f"{a}-{b}" for a, b in ranges) + "]+")


_LETTERS = _letters()


def held_out(column: str = "doc_id"):
    """crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _grams(word: str, n: int) -> list[str]:
    padded = f"<{word}>"
    return [padded[i : i + n] for i in range(len(padded) - n + 1)] if n > 1 else list(word)


def _count(batches):
    """Word and n-gram counts by language (its place) of one partition of the training sample."""
    for batch in batches:
        words: dict[int, Counter] = {}
        for place, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words.setdefault(place, Counter()).update(_LETTERS.findall(text.as_py().lower()))
        for place, counts in words.items():
            for n in range(LONGEST + 1):
                found = counts
                if n:
                    found = Counter()
                    for word, c in counts.items():
                        for g in _grams(word, n):
                            found[g] += c
                yield pa.RecordBatch.from_arrays(
                    [pa.array([place] * len(found), pa.int32()), pa.array([n] * len(found), pa.int32()), pa.array(list(found)), pa.array(list(found.values()), pa.int64())],
                    names=["place", "n", "gram", "c"],
                )


class WordFirst:
    """The fitted tables: words first, then n-grams by length, each a place in a matrix of log frequencies by language.

    Grams stay Arrow strings, also where texts are predicted: as Python strings they would take ten times the memory.
    """

    def __init__(self, langs: list[str], tables: list[tuple[pa.Array, np.ndarray]]):
        self.langs = langs
        self.width = max(len(langs), 1)
        self.grams = [grams for grams, _ in tables]
        self.logs = []
        for grams, counts in tables:
            floor = np.log(counts.sum(axis=0, dtype=np.float64) + 0.5 * max(len(grams), 1))
            self.logs.append((np.log(counts + 0.5) - floor).astype(np.float32))
        self.start()

    def start(self):
        self.index: dict[str, int] = {}
        self.rows = np.zeros((1024, self.width), np.float32)

    def __getstate__(self):
        return self.langs, self.width, self.grams, self.logs

    def __setstate__(self, state):
        self.langs, self.width, self.grams, self.logs = state
        self.start()

    def _places(self, n: int, grams: list[str]) -> np.ndarray:
        """The place of each gram of a length in its table, or -1."""
        return pc.fill_null(pc.index_in(pa.array(grams, pa.string()), value_set=self.grams[n]), -1).to_numpy()

    def learn(self, words: list[str]) -> None:
        """Scores of words not met before, all at once: known words first, then the longest known n-grams of the others."""
        first = len(self.index)
        self.index.update(zip(words, range(first, first + len(words)), strict=True))
        while len(self.rows) < len(self.index):
            self.rows = np.concatenate([self.rows, np.zeros_like(self.rows)])
        place = self._places(0, words)
        known = np.flatnonzero(place >= 0)
        self.rows[first + known] = self.logs[0][place[known]]
        rest = np.flatnonzero(place < 0)
        for n in range(LONGEST, 0, -1):
            if not len(rest):
                return
            grams = [_grams(words[k], n) for k in rest.tolist()]
            owner = np.repeat(np.arange(len(rest)), [len(g) for g in grams])
            place = self._places(n, [g for some in grams for g in some])
            hit = place >= 0
            count = np.bincount(owner[hit], minlength=len(rest))
            some = np.flatnonzero(count)
            for k in range(self.width):  # the mean, so that a long unseen word weighs like a known one
                total = np.bincount(owner[hit], self.logs[n][place[hit], k], len(rest))
                self.rows[first + rest[some], k] = total[some] / count[some]
            rest = rest[count == 0]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        found = [_LETTERS.findall(text.lower()) if text else [] for text in texts]
        if len(self.index) > _REMEMBERED:
            self.start()
        new = list({w for words in found for w in words if w not in self.index})
        if new and self.langs:
            self.learn(new)
        langs, scores = [], []
        for words in found:
            if not words or not self.langs:
                langs.append("und")
                scores.append(0.0)
                continue
            total = self.rows[[self.index[w] for w in words]].sum(axis=0, dtype=np.float64)
            best = int(total.argmax())
            langs.append(self.langs[best])
            scores.append(float(1.0 / np.exp(np.maximum(total - total[best], -700.0)).sum()))
        return langs, scores


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> WordFirst:
    ship(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out()).select("doc_id", F.col("lang").cast("string"), "text")
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    langs = sorted(sizes)
    empty = (pa.array([], pa.string()), np.zeros((0, max(len(langs), 1)), np.float32))
    if not sizes:
        return WordFirst([], [empty] * (LONGEST + 1))
    # one row a language
    told = docs.sparkSession.createDataFrame([(x, min(1.0, train_docs / sizes[x]), k) for k, x in enumerate(langs)], "lang string, rate double, place int")
    share = F.pmod(F.xxhash64("doc_id", "text"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    sample = labelled.join(F.broadcast(told), "lang").where(share < F.col("rate")).select("place", "text")
    counts = sample.mapInArrow(lean(_count), "place int, n int, gram string, c long").groupBy("n", "gram", "place").agg(F.sum("c").alias("c"))
    counts = staged(counts, "grams")
    tables = []
    for n in range(LONGEST + 1):
        rows = counts.where(F.col("n") == n).select("gram", "place", "c").toArrow()
        coded = rows.column("gram").combine_chunks().dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        matrix = np.zeros((len(coded.dictionary), len(langs)), np.float32)
        matrix[coded.indices.to_numpy(), rows.column("place").to_numpy()] = rows.column("c").to_numpy()
        tables.append((coded.dictionary.cast(pa.string()), matrix))
    return WordFirst(langs, tables)


def predict(docs: DataFrame, model: WordFirst) -> DataFrame:
    """All columns of ``docs`` with __lang_pred and __score; only the text column is an input."""
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    fields = [(f.name, f.dataType.simpleString()) for f in docs.schema.fields]
    ddl = ", ".join(f"`{n}` {t}" for n, t in [*fields, ("__lang_pred", "string"), ("__score", "double")])
    at = docs.columns.index("text")

    def run(batches):
        model = pickle.loads(packed.value)  # for this task only: the worker lives on in stages that need no model
        for batch in batches:
            langs, scores = [], []
            for a in range(0, len(batch), _TEXTS):
                some = model.predict(batch.column(at).slice(a, _TEXTS).to_pylist())
                langs += some[0]
                scores += some[1]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, "__lang_pred", "__score"])

    return docs.mapInArrow(lean(run), ddl)


def identify(docs: DataFrame, **bounds) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every document."""
    found = predict(docs.select("doc_id", "text"), fit(docs, **bounds))
    return found.select("doc_id", held_out().alias("held_out"), F.col("__lang_pred").alias("lang_pred"), F.col("__score").alias("score"))

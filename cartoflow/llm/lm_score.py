"""Language-model scores of whole texts by a weighted backoff model.

Tokens are words (A-Z lowered) and one end token a document.  The model is a backoff word
n-gram model: the unigram level holds every token of the training documents with add-``ALPHA``
smoothing, the higher levels hold every n-gram that occurs ``LEAST`` times, at every size of
the corpus, absolutely discounted.  ``Automaton`` is that model on one machine: n-grams are
states with an arc per kept continuation and a failure arc, weighted by the backoff mass, to
the next shorter context.

Over the cluster documents are gathered to blocks, written once as places in the block's list of
words.  Level by level a block sends its different n-grams, whose two shorter n-grams are kept,
with their counts to buckets (ranges of the key); the bucket adds up and tells each block the
count of each key it sent, and one block of each key that it answers for it.  That block adds the
n-gram's probability to its context; contexts are added up in buckets likewise and their backoff
weights told to the blocks that ask.  With counts and backoff weights of all its n-grams a block
scores its documents by itself.  Blocks and replies are tables dealt by block, joined in place.

Defined results: null text is empty (its only token is the end); a null id digests as the
empty string; rows with equal ids are scored separately; without training documents every
count is 0; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.llm import textcore
from cartoflow.llm.common import drop_staged, settle, staged, staged_by, staged_count
from cartoflow.runtime import ship

ORDER = 3
#: Occurrences from which an n-gram is kept.
LEAST = 2
#: Share of the training tokens from which an n-gram was broadcast; without effect.
SHARE = 1e-6
#: Tokens a bucket of n-grams, and a block of documents.
PER_BUCKET, BLOCK_TOKENS = 1_000_000, 1_000_000
ALPHA = 0.1
DISCOUNT = 0.5
#: Tokens of a part of a long document that is walked by itself.
PART = 512
#: The end token's name among the hashes of words.
END = np.uint64(0x656E64)
_SHIFT = np.uint64(32)
_CODEC = pa.Codec("zstd", compression_level=1)


def crc_of_id(column: str = "doc_id"):
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def tokens(flat: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes of all documents, each followed by its end token, and the n + 1 offsets."""
    doc, starts, ends = textcore.word_spans(flat, offsets)
    n = len(offsets) - 1
    count = np.bincount(doc, minlength=n) + 1
    at = np.concatenate([[0], np.cumsum(count)])
    out = np.empty(int(at[-1]), np.uint64)
    out[np.arange(len(doc)) + doc] = textcore.span_hashes(flat, starts, ends) if len(doc) else np.zeros(0, np.uint64)
    out[at[1:] - 1] = END
    return out, at


def _token_blocks(batches, size=4 * textcore.BLOCK_BYTES):
    for batch in batches:
        flat, offsets = textcore.column_bytes(batch.column("text"))
        for a, b in textcore.blocks(offsets, size):
            yield batch.slice(a, b - a), *tokens(flat[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])


class Automaton:
    """States and arcs as sorted arrays; state 0 is the empty context."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, different: int):
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order].astype(np.float64)
        self.total, self.norm = total, total + ALPHA * (different + 1)
        n = len(words)
        self.levels = 1
        #: arcs (state << 32 | word) with the state they lead to and their log10 probability
        self.arcs = np.arange(n, dtype=np.uint64)
        self.leads = np.arange(1, n + 1, dtype=np.int64)
        self.logp = np.log10((self.counts + ALPHA) / self.norm) if n else np.zeros(0)
        self.back = np.zeros(n + 1)
        self.fail = np.zeros(n + 1, np.int64)
        self.state_count = np.concatenate([[float(total)], self.counts])
        self.level_start: list[int] = []

    def word_ids(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each word among the frequent ones, or -1."""
        if not len(self.words):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, at, -1)

    def follow(self, state: np.ndarray, word: np.ndarray) -> np.ndarray:
        """The arc of each (state, word), or -1."""
        if not len(self.arcs):
            return np.full(len(state), -1)
        key = (state.astype(np.uint64) << _SHIFT) | np.maximum(word, 0).astype(np.uint64)
        at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
        return np.where((self.arcs[at] == key) & (word >= 0), at, -1)

    def contexts(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """For each token the state of exactly the ``levels`` tokens that end there, or -1."""
        state = np.where(word >= 0, word + 1, -1)
        position = np.arange(len(word)) - np.repeat(at[:-1], np.diff(at))
        for level in range(2, self.levels + 1):
            before = np.full(len(word), -1)
            before[1:] = state[:-1]
            arc = self.follow(np.maximum(before, 0), word)
            low = self.level_start[level - 2]
            good = (before > 0) & (position >= level - 1) & (arc >= 0)
            led = np.where(good, self.leads[np.maximum(arc, 0)], -1)
            state = np.where(led >= low, led, -1)
        return state

    def longer(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Keys of the n-grams one level up whose two shorter n-grams are kept."""
        state = self.contexts(word, at)
        if len(state) < 2:
            return np.zeros(0, np.uint64)
        position = np.arange(len(word)) - np.repeat(at[:-1], np.diff(at))
        good = (state[:-1] > 0) & (state[1:] > 0) & (position[1:] >= self.levels)
        return (state[:-1][good].astype(np.uint64) << _SHIFT) | word[1:][good].astype(np.uint64)

    def add_level(self, keys: np.ndarray, counts: np.ndarray) -> None:
        """Turn kept n-grams into states, arcs and backoff weights."""
        order = np.argsort(keys)
        keys, counts = keys[order], counts[order].astype(np.float64)
        first = len(self.back)
        self.level_start = [*self.level_start, first]
        self.levels += 1
        context, word = (keys >> _SHIFT).astype(np.int64), (keys & np.uint64(0xFFFFFFFF)).astype(np.int64)
        prob = (counts - DISCOUNT) / self.state_count[context]
        lower, failed = self.step(self.fail[context], word)
        kept = np.bincount(context, prob, first)
        below = np.bincount(context, 10.0**lower, first)
        has = np.bincount(context, minlength=first) > 0
        self.back = np.where(has, np.log10(np.maximum(1 - kept, 1e-12) / np.maximum(1 - below, 1e-12)), self.back)
        n = len(keys)
        at = np.argsort(merged := np.concatenate([self.arcs, keys]), kind="stable")
        self.arcs = merged[at]
        self.leads = np.concatenate([self.leads, np.arange(first, first + n)])[at]
        self.logp = np.concatenate([self.logp, np.log10(prob)])[at]
        self.back = np.concatenate([self.back, np.zeros(n)])
        self.fail = np.concatenate([self.fail, failed])
        self.state_count = np.concatenate([self.state_count, counts])

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log10 probability of ``word`` after ``state`` (without the unigram part of rare words) and the next state."""
        gain, out = np.zeros(len(state)), np.zeros(len(state), np.int64)
        waiting, state = np.arange(len(state)), state.copy()
        while len(waiting):
            arc = self.follow(state, word[waiting])
            hit = arc >= 0
            gain[waiting[hit]] += self.logp[arc[hit]]
            out[waiting[hit]] = self.leads[arc[hit]]
            lost = ~hit & (state == 0)  # a rare word: its unigram part is joined later
            on = ~hit & ~lost
            gain[waiting[on]] += self.back[state[on]]
            waiting, state = waiting[on], self.fail[state[on]]
        return gain, out

    def score(self, word: np.ndarray, at: np.ndarray) -> np.ndarray:
        """One left-to-right walk of every document, many side by side.

        Long documents are walked in parts; a part starts with the tokens before it that a
        state can remember, whose own probabilities belong to the part before.
        """
        length = np.diff(at)
        parts = np.maximum(-(-length // PART), 1)
        doc = np.repeat(np.arange(len(length)), parts)
        offset = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * PART
        warm = np.minimum(offset, self.levels - 1)
        size = np.minimum(length[doc] - offset, PART) + warm
        order = np.argsort(-size, kind="stable")
        start, falling, warm = (at[:-1][doc] + offset - warm)[order], -size[order], warm[order]
        total, state = np.zeros(len(order)), np.zeros(len(order), np.int64)
        for i in range(int(size.max(initial=0))):
            active = int(np.searchsorted(falling, -i, side="left"))
            gain, state = self.step(state[:active], word[start[:active] + i])
            total[:active] += gain if i >= self.levels else np.where(warm[:active] <= i, gain, 0.0)
        return np.bincount(doc[order], total, len(length))


def _pack(values: np.ndarray) -> bytes:
    """Values as compressed planes of their bytes, which leaves little of planes that are mostly zero."""
    values = np.ascontiguousarray(values)
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T).tobytes()
    return len(values).to_bytes(8, "little") + (_CODEC.compress(planes, asbytes=True) if planes else b"")


def _unpack(data: bytes, kind) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.zeros(0, kind)
    planes = np.frombuffer(_CODEC.decompress(data[8:], n * size), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def _pack_keys(keys: np.ndarray) -> bytes:
    """Ascending keys by their differences."""
    return _pack(np.diff(keys, prepend=np.uint64(0)))


def _unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpack(data, np.uint64), dtype=np.uint64)


#: What a block of documents holds: its documents, its words (most frequent first) and the place of each token's word.
_BLOCK = "block long, n_tokens long, n_train long, ids binary, held binary, lengths binary, words binary, tokens binary"


def _to_blocks(batches):
    """Documents gathered to blocks of about ``BLOCK_TOKENS`` tokens, one row each."""
    task, made, parts, size = TaskContext.get().partitionId(), 0, [], 0

    def row():
        found, lengths = (np.concatenate([x[i] for x in parts]) for i in (1, 2))
        held = np.concatenate([x[3] for x in parts])
        words, place, counts = np.unique(found, return_inverse=True, return_counts=True)
        order = np.argsort(-counts, kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words), dtype=np.uint32)
        ids = pa.concat_arrays([x[0] for x in parts])
        null = np.asarray(ids.is_null().to_numpy(zero_copy_only=False), bool)
        number = np.column_stack([ids.fill_null(0).to_numpy(), null.astype(np.int64)]).ravel()
        columns = [_pack(number), _pack(held.astype(np.uint8)), _pack(lengths), _pack(words[order]), _pack(rank[place])]
        sizes = [(task << 32) | made, len(found), int(lengths[~held].sum())]
        return pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in sizes] + [pa.array([x], pa.binary()) for x in columns], names=["block", "n_tokens", "n_train", "ids", "held", "lengths", "words", "tokens"])

    for part, found, at in _token_blocks(batches, textcore.BLOCK_BYTES * 2):
        held = np.asarray(part.column("held_out").to_numpy(zero_copy_only=False), bool)
        parts.append((part.column("doc_id"), found, np.diff(at), held))
        size += len(found)
        if size >= BLOCK_TOKENS:
            yield row()
            made, parts, size = made + 1, [], 0
    if size:
        yield row()


class _Level:
    """The n-grams of one length in a block: their ends, different keys, and what the other blocks have told of them."""

    def __init__(self, keys, inverse, where, first, n):
        self.keys, self.where, self.first = keys, where, first
        #: the place among ``keys`` of the n-gram that ends at each token, or -1
        self.place = np.full(n, -1, np.int32)
        self.place[where] = inverse
        self.counts = self.own = self.back = None

    def tell(self, reply: np.ndarray) -> None:
        self.counts, self.own = (reply >> 1).astype(np.int64), (reply & 1).astype(bool)
        #: occurrences in training of the n-gram that ends at each token, 0 if it is not kept
        self.count_at = np.where(self.place >= 0, self.counts[self.place], 0) if len(self.keys) else np.zeros(len(self.place), np.int64)


class _Block:
    """A block of documents with the replies so far; ``levels[0]`` are its words."""

    def __init__(self, row: dict, replies: list[list[bytes]], norm: float, order: int):
        self.norm, self.levels = norm, []
        self.held = _unpack(row["held"], np.uint8).astype(bool)
        self.lengths = _unpack(row["lengths"], np.int64)
        self.ids = _unpack(row["ids"], np.int64).reshape(-1, 2)
        self.n = int(self.lengths.sum())
        self.position = (np.arange(self.n) - np.repeat(np.cumsum(self.lengths) - self.lengths, self.lengths)).astype(np.int32)
        words, tokens = _unpack(row["words"], np.uint64), _unpack(row["tokens"], np.uint32)
        by = np.argsort(words)
        rank = np.empty(len(words), np.int32)
        rank[by] = np.arange(len(words), dtype=np.int32)
        self.levels.append(_Level(words[by], rank[tokens], np.arange(self.n, dtype=np.int32), None, self.n))
        for step, (counts, backs) in enumerate(replies, 1):
            if step <= order:
                self.levels[-1].tell(_unpack(counts, np.int64))
                if step < order:
                    self._longer()
            if step >= 3:
                level = self.levels[step - 3]
                asked, _, _ = self.contexts(step - 2)
                level.back = np.zeros(len(level.keys))
                level.back[asked] = _unpack(backs, np.float64)

    def _longer(self) -> None:
        """The n-grams one word longer whose two shorter n-grams are kept."""
        low = self.levels[-1]
        kept = low.count_at >= LEAST
        where = np.flatnonzero(kept[1:] & kept[:-1] & (self.position[1:] >= len(self.levels))).astype(np.int32) + np.int32(1)
        keys = textcore.combine(low.keys[low.place[where - 1]], low.keys[low.place[where]])
        keys, first, inverse = np.unique(keys, return_index=True, return_inverse=True)
        self.levels.append(_Level(keys, inverse, where, where[first], self.n))

    def trained(self) -> np.ndarray:
        """How often each n-gram of the longest level occurs in the block's training documents."""
        level = self.levels[-1]
        trains = np.repeat(~self.held, self.lengths)[level.where]
        return np.bincount(level.place[level.where[trains]], minlength=len(level.keys)).astype(np.uint32)

    def p(self, n: int, ends: np.ndarray) -> np.ndarray:
        """The probability of the kept n-gram that ends at each of ``ends``, after its first n - 1 words."""
        count = self.levels[n - 1].count_at[ends]
        if n == 1:
            return (count + ALPHA) / self.norm
        return (count - DISCOUNT) / self.levels[n - 2].count_at[ends - 1]

    def contexts(self, n: int):
        """Places of the n-grams whose backoff weight is asked for, and what the n-grams one word longer that this block answers for add up to."""
        low, high = self.levels[n - 1], self.levels[n]
        ends = high.first[high.own & (high.counts >= LEAST)]
        sums = [np.bincount(low.place[ends - 1], x, len(low.keys)) for x in (self.p(n + 1, ends), self.p(n, ends))]
        asked = np.zeros(len(low.keys), bool)
        asked[low.place[ends - 1]] = True
        asked[low.place[self._fails(n) - 1]] = True
        return np.flatnonzero(asked), *sums

    def _fails(self, n: int) -> np.ndarray:
        """Tokens after a kept n-gram that it has no kept n-gram for."""
        before, now = self.levels[n - 1].count_at, self.levels[n].count_at
        return np.flatnonzero((before[:-1] >= LEAST) & (now[1:] < LEAST) & (self.position[1:] > 0)) + 1

    def scores(self):
        """n_known, base_score and score of each document."""
        doc = np.repeat(np.arange(len(self.lengths)), self.lengths)
        every = np.arange(self.n)
        base = np.log10(self.p(1, every))
        gain = base.copy()
        for n in range(2, len(self.levels) + 1):
            at = np.flatnonzero(self.levels[n - 1].count_at >= LEAST)
            gain[at] = np.log10(self.p(n, at))
            at = self._fails(n - 1)
            low = self.levels[n - 2]
            gain[at] += low.back[low.place[at - 1]]
        known = np.bincount(doc[self.levels[0].count_at > 0], minlength=len(self.lengths))
        return known, np.bincount(doc, base, len(self.lengths)), np.bincount(doc, gain, len(self.lengths))


def _pieces(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Where each bucket's part of the ascending ``keys`` starts; buckets are equal ranges of keys."""
    edges = np.array([(i << 64) // buckets for i in range(buckets)], np.uint64)
    return np.append(np.searchsorted(keys, edges), len(keys))


_ASK = "bucket int, block long, kind int, k binary, v binary"
_REPLY = "block long, bucket int, n_keys long, kind int, v binary"


def _ask(block: int, step: int, order: int, state: _Block, buckets: int):
    """One row a bucket and kind: counts of the level ``step``, sums of the contexts two levels below."""
    asks = []
    if step <= order:
        asks.append((0, state.levels[-1].keys, [state.trained()]))
    if step >= 3:
        asked, *sums = state.contexts(step - 2)
        asks.append((1, state.levels[step - 3].keys[asked], [x[asked] for x in sums]))
    for kind, keys, values in asks:
        cuts = _pieces(keys, buckets)
        some = np.flatnonzero(np.diff(cuts))
        k = [_pack_keys(keys[a:b]) for a, b in zip(cuts[some], cuts[some + 1], strict=True)]
        v = [_pack(values[0][a:b] if kind == 0 else np.concatenate([x[a:b] for x in values])) for a, b in zip(cuts[some], cuts[some + 1], strict=True)]
        n = len(some)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.full(n, block, np.int64)), pa.array(np.full(n, kind, np.int32)), pa.array(k, pa.binary()), pa.array(v, pa.binary())], names=["bucket", "block", "kind", "k", "v"])


def _serve(least: int):
    """Adds up a bucket's rows and tells every block of each of its keys: the count and whether the block answers for it, or the backoff weight."""

    def answer(bucket, kind, rows):
        keys = [_unpack_keys(r[1]) for r in rows]
        sizes = [len(x) for x in keys]
        cuts = np.concatenate([[0], np.cumsum(sizes)])
        keys, first, inverse = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
        if kind == 0:
            total = np.bincount(inverse, np.concatenate([_unpack(r[2], np.uint32) for r in rows]), len(keys)).astype(np.int64)
            n_keys = int((total > 0).sum())
            total[total < least] = 0
            told = (total << 1)[inverse]
            told[first] |= 1
        else:
            sums = [_unpack(r[2], np.float64).reshape(2, -1) for r in rows]
            left = [np.maximum(1 - np.bincount(inverse, np.concatenate([x[i] for x in sums]), len(keys)), 1e-12) for i in (0, 1)]
            told, n_keys = np.log10(left[0] / left[1])[inverse], 0
        n = len(rows)
        out = [_pack(told[a:b]) for a, b in itertools.pairwise(cuts)]
        columns = [np.array([r[0] for r in rows], np.int64), np.full(n, bucket, np.int32), np.array([n_keys] + [0] * (n - 1), np.int64), np.full(n, kind, np.int32)]
        return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.array(out, pa.binary())], names=["block", "bucket", "n_keys", "kind", "v"])

    def run(batches):
        held, now = [], None
        for batch in batches:
            for bucket, block, kind, k, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, kind) != now and held:
                    yield answer(*now, held)
                    held = []
                now = (bucket, kind)
                held.append((block, k, v))
        if held:
            yield answer(*now, held)

    return textcore.lean(run)


def _gather(batches):
    """The replies to each block put together, in the order of the keys it asked for."""

    def row(block, held, n_keys):
        out = []
        for kind, as_type in ((0, np.int64), (1, np.float64)):
            mine = [_unpack(v, as_type) for k, v in held if k == kind]
            out.append(_pack(np.concatenate(mine) if mine else np.zeros(0, as_type)))
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([n_keys], pa.int64()), *[pa.array([x], pa.binary()) for x in out]], names=["block", "n_keys", "counts", "backs"])

    held, now, n_keys = [], None, 0
    for batch in batches:
        for block, _, n, kind, v in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if block != now and held:
                yield row(now, held, n_keys)
                held, n_keys = [], 0
            now = block
            n_keys += n
            held.append((kind, v))
    if held:
        yield row(now, held, n_keys)


def _states(batches, steps: int, norm: float, order: int):
    for batch in batches:
        for i in range(len(batch)):
            row = {name: batch.column(name)[i].as_py() for name in batch.schema.names}
            yield row["block"], _Block(row, [[row[f"counts{s}"], row[f"backs{s}"]] for s in range(1, steps + 1)], norm, order)


def lm_scores(docs: DataFrame, order: int = ORDER, share: float = SHARE) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of ``docs`` (doc_id, text).

    Nothing is broadcast any more, so ``share`` changes neither scores nor work.
    """
    spark, since = docs.sparkSession, staged_count()
    ship(spark)
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), (crc_of_id() % 10 == 0).alias("held_out"))
    made = staged(rows.mapInArrow(textcore.lean(_to_blocks), _BLOCK), "blocks")
    tokens_all, total, n_blocks = made.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_train"), F.lit(0)), F.count("*")).first()
    buckets, dealt = max(32, math.ceil(tokens_all / PER_BUCKET)), max(8, n_blocks)
    tables = []

    def bucketed(df, name):
        table, out = staged_by(df, name, "block", dealt)
        tables.append(table)
        return out

    blocks = bucketed(made, "dealt")
    drop_staged(spark, since)
    settle(spark)
    norm, joined = 0.0, blocks
    for step in range(1, order + 2 if order > 1 else 2):

        def ask(batches, step=step, norm=norm):
            for block, state in _states(batches, step - 1, norm, order):
                yield from _ask(block, step, order, state, buckets)
                del state  # before the next one is made

        asked = joined.mapInArrow(textcore.lean(ask), _ASK).repartition(buckets, "bucket").sortWithinPartitions("bucket", "kind", "block")
        told = asked.mapInArrow(_serve(1 if step == 1 else LEAST), _REPLY).repartition(dealt, "block").sortWithinPartitions("block", "kind", "bucket")
        replies = bucketed(told.mapInArrow(textcore.lean(_gather), "block long, n_keys long, counts binary, backs binary"), f"replies{step}")
        del asked, told
        settle(spark)
        if step == 1:
            norm = total + ALPHA * (replies.agg(F.coalesce(F.sum("n_keys"), F.lit(0))).first()[0] + 1)
        joined = joined.join(replies.select("block", F.col("counts").alias(f"counts{step}"), F.col("backs").alias(f"backs{step}")), "block")
    steps = order + 1 if order > 1 else 1

    def score(batches):
        for _, state in _states(batches, steps, norm, order):
            known, base, gain = state.scores()
            ids = pa.array(state.ids[:, 0], mask=state.ids[:, 1] > 0)
            columns = [ids, pa.array(state.held), pa.array(state.lengths), pa.array(known.astype(np.int64)), pa.array(np.full(len(known), total, np.int64)), pa.array(base), pa.array(gain)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
            del state, columns  # before the next one is made

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    scored = staged(joined.mapInArrow(textcore.lean(score), schema), "scores")
    for table in tables:
        spark.sql(f"DROP TABLE IF EXISTS {table}")
    drop_staged(spark, since)
    settle(spark)
    return scored

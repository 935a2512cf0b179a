"""Packing token sequences by Karmarkar-Karp multiway differencing.

Every document's ids (byte-level BPE, then the end id) are cut into windows of exactly the
capacity and a rest; rests are cut into a few uneven pieces, gathered into pools of about a
hundred windows, and each pool is split by the largest differencing method: partial partitions with
opposing imbalances merge until one near-equal partition is left.  Where its largest window
exceeds the capacity, the pool is split again into one window more.  Pools are made from
consecutive rows of one input partition, so nothing is shuffled and a task run again gives
the same sequences.

Defined results: null text is empty (its sequence is the end id alone); rows with equal ids
are packed separately; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import zlib
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.llm.textcore import lean
from cartoflow.runtime import ship

CAPACITY = 1024
END_ID = 0
#: A rest is cut into uneven pieces of these shares and what is left, none below ``LEAST`` tokens: differencing
#: balances the large ones against each other and the small ones even out what remains.
SHARES, LEAST = (2 / 3, 2 / 9, 2 / 27), 4
#: Windows in a pool, and the tokens a window that a pool leaves free for the imbalance that remains.
POOL, FREE = 128, 3

_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_SCHEMA = pa.schema([(x.split()[0], pa.int64()) for x in _DDL.split(", ")])


class ByteBpe:
    """Ids of a tokenizers byte-level BPE file, encoded by tiktoken over the same ranks.

    Falls back to the tokenizers library itself for texts that contain an added token's
    string and for those that tiktoken's pattern engine refuses.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        added = {x["content"] for x in model.get("added_tokens", ())}
        visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(visible))}
        ranks = {bytes(byte_of[c] for c in piece): i for piece, i in model["model"]["vocab"].items() if piece not in added}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.path = path
        self.added = sorted(added)

    @cached_property
    def exact(self):
        """The library's own tokenizer, loaded only where a text needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> np.ndarray:
        if not any(x in text for x in self.added):
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except (ValueError, RuntimeError, BaseException) as problem:  # a panic of the native library is a BaseException
                if isinstance(problem, KeyboardInterrupt | SystemExit | GeneratorExit | MemoryError):
                    raise
        return np.array(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=2)
def byte_bpe(path: str) -> ByteBpe:
    return ByteBpe(path)


def difference(sizes: np.ndarray, parts: int) -> tuple[np.ndarray, int]:
    """The part of each item by multiway differencing, and the largest sum."""
    if parts == 1:
        return np.zeros(len(sizes), np.int64), int(sizes.sum())
    n = len(sizes)
    nodes: list = [None] * n  # merged partitions: (left, right, order of the slots)
    heap = []
    for i, x in enumerate(sizes):
        sums = np.zeros(parts, np.int64)
        sums[0] = x
        heap.append((-int(x), i, sums))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a, left = heapq.heappop(heap)
        _, b, right = heapq.heappop(heap)
        sums = left + right[::-1]  # the largest of one with the smallest of the other
        order = np.argsort(-sums, kind="stable")
        sums = sums[order]
        nodes.append((a, b, order))
        heapq.heappush(heap, (int(sums[-1] - sums[0]), len(nodes) - 1, sums))
    _, root, sums = heap[0]
    part = np.empty(n, np.int64)
    waiting = [(root, np.arange(parts))]
    while waiting:
        node, labels = waiting.pop()
        if node < n:
            part[node] = labels[0]
            continue
        a, b, order = nodes[node]
        slots = np.empty(parts, np.int64)
        slots[order] = labels
        waiting += [(a, slots), (b, slots[::-1])]
    return part, int(sums[0])


def split_pool(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, int]:
    """Near-equal windows for the pieces; the window count rises while the capacity is exceeded."""
    parts = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        part, largest = difference(sizes, parts)
        if largest <= capacity:
            return part, parts
        parts += 1


class _Packer:
    def __init__(self, capacity: int, partition: int):
        self.capacity, self.next_sequence = capacity, partition << 36
        self.pool: list[tuple] = []
        self.pooled = 0
        self.goal = POOL * (capacity - FREE)
        self.out: list[tuple] = []

    def add(self, doc_id, ids: np.ndarray) -> None:
        n, at = len(ids), 0
        while n - at >= self.capacity:
            self.emit(doc_id, ids, at, self.capacity, self.next_sequence, 0)
            self.next_sequence += 1
            at += self.capacity
        while at < n:
            take = min(n - at, self.goal - self.pooled)
            left = take
            for size in (*(int(take * share) for share in SHARES), take):
                size = min(size, left)
                if size == left or (size >= LEAST and left - size >= LEAST):
                    self.pool.append((doc_id, ids, at, size))
                    at, left = at + size, left - size
                if not left:
                    break
            self.pooled += take
            if self.pooled >= self.goal:
                self.flush()

    def emit(self, doc_id, ids, at, size, sequence, offset) -> None:
        self.out.append((doc_id, at, size, zlib.crc32(ids[at : at + size].astype("<u4").tobytes()), len(ids), sequence, offset))

    def flush(self) -> None:
        if not self.pool:
            return
        part, parts = split_pool(np.array([x[3] for x in self.pool]), self.capacity)
        filled = [0] * parts
        for k, (doc_id, ids, at, size) in zip(part.tolist(), self.pool, strict=True):
            self.emit(doc_id, ids, at, size, self.next_sequence + k, filled[k])
            filled[k] += size
        self.next_sequence += parts
        self.pool, self.pooled = [], 0

    def rows(self) -> pa.RecordBatch:
        columns = list(zip(*self.out, strict=True)) if self.out else [()] * len(_SCHEMA)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], schema=_SCHEMA)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches):
        bpe, packer = byte_bpe(tokenizer_path), _Packer(capacity, TaskContext.get().partitionId())
        end = np.array([END_ID], np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, np.concatenate([bpe.ids(text.as_py() or ""), end]))
                if len(packer.out) >= 20_000:
                    yield packer.rows()
        packer.flush()
        yield packer.rows()

    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(lean(run), _DDL)

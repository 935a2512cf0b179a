"""Exact Jaccard self-join on word shingles by PartEnum signatures.

A document's set is its distinct w-word shingles (64-bit hashes).  Sets of one size band and
the next share a tag; within a tag the similarity bounds the symmetric difference by k.  The
hashed shingle domain is split into first-level parts, so that one of them holds at most one
difference, and each of those into second-level parts, of which all subsets that leave one
out are enumerated (small k: one first-level part, of which all halves are enumerated).  Two
sets that are similar enough share at least one signature: no link is lost.

A part that chance leaves without shingles would give unrelated sets one signature.  With
``spare`` parts beyond the least number, ``spare + 1`` parts hold at most one difference, so a
set in which at most ``spare`` parts have a blank signature shares one that is not blank with
each similar set, and emits no blank ones; the few other sets emit theirs.

Equal sets are one class, and only classes go on: one text of each is signed.  Classes that
share a signature are tied to a smallest class of the signature, never as all pairs: within
a task first, so that each task sends a signature once, then over all tasks; the connected units of those ties are verified exactly,
block against block, inside tasks that return a spanning forest and link counts instead of
pairs.  Passages that many documents share can tie more classes into one unit than a block
holds, and at any size most classes into one.  The classes of such units are tied anew by
prefixes: with the shingles of every set ordered from rare to frequent, two similar sets of
n >= m shingles share one of the first n - ceil(n * num / den) + 1 and m - ceil(m * num / den) + 1;
a shingle that no other set has ties nothing, so that common passages, which come last, tie
nothing either.  What is still too large for a block is cut by parity bitmaps, whose distance
never exceeds that of the sets.  A unit's classes are dealt to blocks of about ``BLOCK`` by size band and hash, and only
blocks of one band or of neighbouring bands meet, so a large unit is the work of many tasks.
The number of such meetings grows with the square of the different texts of one unit and band:
the links themselves, which are counted one by one, do too.

Defined results: null text counts as empty; a document without words has the empty set, links
with nothing and is its own component; fewer words than w give one shingle of all words; a
very long text is one set; rows with equal ids and texts are linked like any copies; a null id
never names a component unless it has no other member; an empty table gives an empty result;
further columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cartoflow.llm import textcore
from cartoflow.llm.common import settle, shuffle_partitions, staged, text_or_empty
from cartoflow.llm.graph import components
from cartoflow.llm.textcore import combine, lean, mix
from cartoflow.runtime import ship

#: Second-level parts of each first-level part, where k is above SMALL_K.
SECOND = 3
SMALL_K = 3
#: Signatures that a task gathers before it sends them.
GATHER = 500_000
#: Signatures of a class that one run counts.
_LONGEST = (1 << 16) - 1
#: Classes verified against each other at once.
BLOCK = 512
#: Classes whose bitmaps are compared at once.
WIDE = 2048
#: Rows of a link matrix that are widened to numbers at once.
ROWS = 128
#: Rows of three numbers up to which a table is broadcast to a scan; beyond, both sides are shuffled.
MOST_BROADCAST = 1_000_000


class Scheme:
    """Size bands, difference bounds and parts of a similarity of ``num`` / ``den``."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        self.edges = [1]

    def band(self, sizes: np.ndarray) -> np.ndarray:
        while self.edges[-1] <= int(sizes.max(initial=1)):
            self.edges.append(self.edges[-1] * self.den // self.num + 1)
        return np.searchsorted(np.array(self.edges), sizes, side="right") - 1

    def most_differences(self, tag: int) -> int:
        """Of two similar sets, both of the sizes of bands ``tag`` and ``tag + 1``."""
        self.band(np.array([self.edges[-1] if len(self.edges) < tag + 3 else 1]))
        while len(self.edges) < tag + 3:
            self.edges.append(self.edges[-1] * self.den // self.num + 1)
        largest = self.edges[tag + 2] - 1
        return 2 * largest * (self.den - self.num) // (self.den + self.num)

    def spare_parts(self, tag: int) -> int:
        """First-level parts beyond the least number: about 1.5 times those that chance leaves without a signature in the smallest sets."""
        k, spare = self.most_differences(tag), 0
        for _ in range(4):
            parts = k // 2 + 1 + spare
            blank = parts * min(1.0, SECOND * math.exp(-self.edges[tag] / parts * (SECOND - 1) / SECOND))
            spare = min(math.ceil(1.5 * blank - 0.05), k // 4) if blank > 0.03 else 0
        return spare


def shingle_sets(flat: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each document, ascending within it, and their n + 1 offsets."""
    doc, starts, ends = textcore.word_spans(flat, offsets)
    n = len(offsets) - 1
    if not len(doc):
        return np.zeros(0, np.uint64), np.zeros(n + 1, np.int64)
    words = textcore.span_hashes(flat, starts, ends)
    count = np.bincount(doc, minlength=n)
    m = len(words) - width + 1
    owners, hashes = [], []
    if m > 0:
        inside = doc[:m] == doc[width - 1 :]
        owners.append(doc[:m][inside])
        hashes.append(combine(*[words[k : k + m] for k in range(width)])[inside])
    first = np.concatenate([[0], np.cumsum(count)[:-1]])
    for size in range(1, width):
        few = np.flatnonzero(count == size)
        if len(few):
            owners.append(few)
            hashes.append(mix(combine(*[words[first[few] + k] for k in range(size)]) + np.uint64(size)))
    owner, value = np.concatenate(owners), np.concatenate(hashes)
    order = np.argsort(value, kind="stable")
    order = order[np.argsort(owner[order], kind="stable")]
    owner, value = owner[order], value[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    owner, value = owner[keep], value[keep]
    return value, np.searchsorted(owner, np.arange(n + 1))


def classes(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A 63-bit name of each non-empty set (0 for the empty one)."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(mix(values + np.uint64(0x51ED270B)), out=total[1:])
    size = np.diff(offsets)
    named = mix(total[offsets[1:]] - total[offsets[:-1]] + size.astype(np.uint64)) >> np.uint64(1)
    return np.where(size > 0, np.maximum(named, np.uint64(1)), np.uint64(0)).astype(np.int64)


def signatures(values: np.ndarray, offsets: np.ndarray, scheme: Scheme) -> tuple[np.ndarray, np.ndarray]:
    """(document index, signature) rows of both tags of every set."""
    sizes = np.diff(offsets)
    bands = scheme.band(sizes)
    owners, found = [], []
    low = (values & np.uint64(0xFFFFFFFF)).astype(np.float64)
    high = (values >> np.uint64(32)).astype(np.float64)
    place = mix(values ^ np.uint64(0xA0761D6478BD642F))
    member = np.repeat(np.arange(len(sizes)), sizes)
    for shift in (0, -1):
        tags = bands + shift
        k, spare = np.full(len(sizes), -1), np.zeros(len(sizes), np.int64)
        for tag in np.unique(tags[(sizes > 0) & (tags >= 0)]):
            of = (tags == tag) & (sizes > 0)
            k[of] = scheme.most_differences(int(tag))
            spare[of] = scheme.spare_parts(int(tag))
        wanted = k > 0  # no difference: the class itself
        one_part = wanted & (k <= SMALL_K)
        parts = np.where(one_part, 1, k // 2 + 1 + spare)
        second = np.where(one_part, 2 * k, SECOND)
        slots = np.where(wanted, parts * second, 0)
        base = np.concatenate([[0], np.cumsum(slots)])
        use = wanted[member]
        own = member[use]
        slot = base[own] + (place[use] % slots[own].astype(np.uint64)).astype(np.int64)
        sums = np.bincount(slot, low[use], base[-1]).astype(np.uint64) + (np.bincount(slot, high[use], base[-1]).astype(np.uint64) << np.uint64(32))
        sums = mix(sums + np.uint64(1))
        held = np.bincount(slot, minlength=base[-1])
        # leave one second-level part out
        large = np.flatnonzero(wanted & ~one_part)
        if len(large):
            at = np.concatenate([np.arange(base[d], base[d + 1]) for d in large]) if len(large) < 64 else np.flatnonzero(np.repeat(wanted & ~one_part, slots))
            cube = sums[at].reshape(-1, SECOND)
            left = cube.sum(axis=1, dtype=np.uint64)[:, None] - cube
            owner = np.repeat(large, parts[large])
            part = np.arange(len(owner)) - np.repeat(np.concatenate([[0], np.cumsum(parts[large])[:-1]]), parts[large])
            # a signature of no shingle says nothing; a set may do without where few of its parts have one
            rest = held[at].reshape(-1, SECOND)
            blank = rest.sum(axis=1)[:, None] == rest
            needed = np.bincount(owner[blank.any(axis=1)], minlength=len(sizes)) > spare
            for j in range(SECOND):
                use = ~blank[:, j] | needed[owner]
                owners.append(owner[use])
                found.append(combine(left[use, j], (tags[owner[use]] * 4 + j).astype(np.uint64), part[use].astype(np.uint64)))
        for few in range(1, SMALL_K + 1):
            small = np.flatnonzero(one_part & (k == few))
            if not len(small):
                continue
            cube = sums[base[small][:, None] + np.arange(2 * few)]
            for j, chosen in enumerate(combinations(range(2 * few), few)):
                owners.append(small)
                found.append(combine(cube[:, list(chosen)].sum(axis=1, dtype=np.uint64), (tags[small] * 4 + 3).astype(np.uint64), np.full(len(small), j, np.uint64)))
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(found)


def _blocks(batches, width):
    for batch in batches:
        flat, offsets = textcore.column_bytes(batch.column("text"))
        for a, b in textcore.blocks(offsets):
            part = flat[offsets[a] : offsets[b]]
            yield batch.slice(a, b - a), *shingle_sets(part, offsets[a : b + 1] - offsets[a], width)


def _long(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64) if x.dtype == np.uint64 else x.astype(np.int64))


def linked(rows: list[np.ndarray], sizes: np.ndarray, num: int, den: int, left: np.ndarray | None = None) -> np.ndarray:
    """The boolean link matrix of the sets ``rows``; with ``left``, only pairs across it."""
    n = len(rows)
    owner = np.repeat(np.arange(n), sizes)
    value = np.concatenate(rows)
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = value[1:] != value[:-1]
    ident = np.cumsum(new) - 1
    shared = np.bincount(ident) > 1
    keep = shared[ident]
    owner, ident = owner[keep], (np.cumsum(shared) - 1)[ident[keep]]
    both = np.zeros((n, n), np.float32)
    # a unit of few classes gets no more columns than it has shingles to share
    step = max(1, min(4_000_000 // n, int(shared.sum())))
    for start in range(0, int(shared.sum()), step):
        a, b = np.searchsorted(ident, [start, start + step])
        dense = np.zeros((n, step), np.float32)
        dense[owner[a:b], ident[a:b] - start] = 1
        both += dense @ dense.T
    both = both.astype(np.int64)
    link = both * den >= (sizes[:, None] + sizes[None, :] - both) * num
    np.fill_diagonal(link, False)
    if left is not None:
        link &= left[:, None] != left[None, :]
    return link


def _stars(sig: np.ndarray, cls: np.ndarray):
    """Rows in signature order, the smallest class of each row's signature, and whether the row is the first of its signature."""
    order = np.lexsort((cls, sig))
    sig, cls = sig[order], cls[order]
    new = np.ones(len(sig), bool)
    new[1:] = sig[1:] != sig[:-1]
    return sig, cls, cls[new][np.cumsum(new) - 1], new


def _distinct(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    apart = a != b
    pairs = np.unique(np.stack([a[apart], b[apart]], axis=1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)
    return pairs[:, 0], pairs[:, 1]


_RUNS = "bucket int, cls binary, n binary, sig binary"


def _runs(sig: np.ndarray, cls: np.ndarray, buckets: int, *more: np.ndarray):
    """Per bucket of signatures: its number, classes, their numbers of signatures there, the signatures' low five bytes, and ``more`` of each class."""
    bucket = ((sig >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)
    order = np.lexsort((cls, bucket))
    sig, cls, bucket = sig[order], cls[order], bucket[order]
    low = np.ascontiguousarray(sig.view(np.uint8).reshape(-1, 8)[:, :5])
    new = np.ones(len(sig), bool)
    new[1:] = (cls[1:] != cls[:-1]) | (bucket[1:] != bucket[:-1])
    at = np.flatnonzero(new)
    # a run counts to what two bytes hold; a longer one is several
    size = np.diff(np.append(at, len(sig)))
    if size.max(initial=0) > _LONGEST:
        at = np.concatenate([np.arange(a, a + n, _LONGEST) for a, n in zip(at.tolist(), size.tolist(), strict=True)])
        size = np.diff(np.append(at, len(sig)))
    numbers, starts = np.unique(bucket[at], return_index=True)
    ends = np.append(starts, len(at))[1:]
    edges = np.append(at, len(sig))
    size, cls, more = size.astype(np.uint16), cls[at], [x[order][at] for x in more]
    return [(n, cls[i:j].tobytes(), size[i:j].tobytes(), low[edges[i] : edges[j]].tobytes(), *(x[i:j].tobytes() for x in more)) for n, i, j in zip(numbers.tolist(), starts, ends, strict=True)]


def _stars_sent(pending, buckets):
    """Signatures and classes, each signature once, and the ties found on the way, as rows of ``_RUNS``."""
    sig, cls, center, first = _stars(*(np.concatenate(x) for x in zip(*pending, strict=True)))
    a, b = _distinct(cls, center)
    rows = _runs(sig[first], cls[first], buckets)
    rows += [(n, a[n::buckets].tobytes(), b[n::buckets].tobytes(), None) for n in range(min(buckets, len(a)))]
    return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), pa.binary(), pa.binary(), pa.binary()), strict=True)], names=["bucket", "cls", "n", "sig"])


def _sign(width, num, den, buckets):
    """Signatures by bucket: classes with their numbers of signatures and the signatures' low five bytes; ties found on the way have none.

    The low bytes and the bucket are all that is compared later: signatures that agree in them by chance give one tie too many.
    """

    def run(batches):
        scheme, pending, size = Scheme(num, den), [], 0
        for part, values, offsets in _blocks(batches, width):
            owner, found = signatures(values, offsets, scheme)
            pending.append((found, part.column("cls").to_numpy()[owner]))
            size += len(found)
            if size >= GATHER:
                yield _stars_sent(pending, buckets)
                pending, size = [], 0
        if size:
            yield _stars_sent(pending, buckets)

    return run


def _tie(batches):
    """Ties of the classes in each bucket that share a signature."""

    def solve(held):
        cls = np.concatenate([np.repeat(np.frombuffer(c, np.int64), np.frombuffer(n, np.uint16)) for c, n, _ in held])
        low = np.concatenate([np.frombuffer(x, np.uint8).reshape(-1, 5) for *_, x in held])
        sig = np.zeros((len(low), 8), np.uint8)
        sig[:, :5] = low
        _, cls, center, _ = _stars(sig.view(np.uint64)[:, 0], cls)
        return _distinct(cls, center)

    held, now = [], None
    for batch in batches:
        for bucket, cls, n, sig in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and held:
                yield pa.RecordBatch.from_arrays([_long(x) for x in solve(held)], names=["a", "b"])
                held = []
            now = bucket
            if sig is None:
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(x, np.int64)) for x in (cls, n)], names=["a", "b"])
            else:
                held.append((cls, n, sig))
    if held:
        yield pa.RecordBatch.from_arrays([_long(x) for x in solve(held)], names=["a", "b"])


def _spread(width, buckets):
    """Shingles by bucket, as ``_runs`` with the size of each class."""

    def flush(pending):
        rows = _runs(*(np.concatenate(x) for x in list(zip(*pending, strict=True))[:2]), buckets, np.concatenate([x[2] for x in pending]))
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], names=["bucket", "cls", "n", "sig", "size"])

    def run(batches):
        pending, held = [], 0
        for part, values, offsets in _blocks(batches, width):
            size = np.diff(offsets)
            pending.append((values, np.repeat(part.column("cls").to_numpy(), size), np.repeat(size, size).astype(np.int32)))
            held += len(values)
            if held >= GATHER:
                yield flush(pending)
                pending, held = [], 0
        if held:
            yield flush(pending)

    return run


def _by_bucket(batches):
    """Each bucket of a partition sorted by bucket, with its rows' other values."""
    held, now = [], None
    for batch in batches:
        for bucket, *values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if bucket != now and held:
                yield now, held
                held = []
            now = bucket
            held.append(values)
    if held:
        yield now, held


def _shared(buckets):
    """Of the shingles in each bucket those that occur twice, with their counts, by class: shingles are their bucket and low five bytes from here."""

    def flush(pending):
        cls, size, name, count = (np.concatenate(x) for x in zip(*pending, strict=True))
        bucket = (cls % buckets).astype(np.int32)
        order = np.argsort(bucket, kind="stable")
        numbers, starts = np.unique(bucket[order], return_index=True)
        ends = np.append(starts, len(order))[1:]
        columns = [[x[a:b].tobytes() for a, b in zip(starts, ends, strict=True)] for x in (c[order] for c in (cls, size, name, count))]
        return pa.RecordBatch.from_arrays([pa.array(numbers, pa.int32()), *(pa.array(x, pa.binary()) for x in columns)], names=["bucket", "cls", "size", "name", "count"])

    def run(batches):
        pending, gathered = [], 0
        for bucket, held in _by_bucket(batches):
            times = np.concatenate([np.frombuffer(x[1], np.uint16) for x in held])
            cls, size = (np.repeat(np.concatenate([np.frombuffer(x[i], t) for x in held]), times) for i, t in ((0, np.int64), (3, np.int32)))
            low = np.concatenate([np.frombuffer(x[2], np.uint8).reshape(-1, 5) for x in held])
            name = np.zeros((len(low), 8), np.uint8)
            name[:, :5] = low
            name = name.view(np.uint64)[:, 0] | np.uint64(bucket << 40)
            order = np.argsort(name)
            name = name[order]
            new = np.ones(len(name), bool)
            new[1:] = name[1:] != name[:-1]
            at = np.flatnonzero(new)
            count = np.diff(np.append(at, len(name)))
            count = np.repeat(np.minimum(count, _LONGEST).astype(np.uint16), count)
            many = count > 1
            pending.append((cls[order][many], size[order][many], name[many], count[many]))
            gathered += int(many.sum())
            if gathered >= GATHER:
                yield flush(pending)
                pending, gathered = [], 0
        if gathered:
            yield flush(pending)

    return run


def _prefixes(num, den, buckets):
    """The shared shingles in each class's prefix: its shingles that occur once come first, then the others from rare to frequent."""

    def run(batches):
        pending, gathered = [], 0
        for _, held in _by_bucket(batches):
            cls, size, name, count = (np.concatenate([np.frombuffer(x[i], t) for x in held]) for i, t in enumerate((np.int64, np.int32, np.uint64, np.uint16)))
            order = np.lexsort((name, count, cls))
            cls, size, name = cls[order], size[order].astype(np.int64), name[order]
            new = np.ones(len(cls), bool)
            new[1:] = cls[1:] != cls[:-1]
            at = np.flatnonzero(new)
            shared = np.diff(np.append(at, len(cls)))
            n = size[at]
            least = -(-n * num // den)
            take = n - least + 1 - (n - shared)
            keep = np.arange(len(cls)) - np.repeat(at, shared) < np.repeat(take, shared)
            pending.append((name[keep], cls[keep]))
            gathered += int(keep.sum())
            if gathered >= GATHER:
                yield _stars_sent(pending, buckets)
                pending, gathered = [], 0
        if gathered:
            yield _stars_sent(pending, buckets)

    return run


def _verify(num, den):
    """Per unit and block pair: a spanning forest of the links, and each class's number of linked documents."""

    def flush(held):
        rows = [np.asarray(x["elements"].values).view(np.uint64) for x in held]
        sizes = np.array([len(x) for x in rows])
        side = np.array([x["block"].as_py() for x in held])
        names = np.array([x["cls"].as_py() for x in held])
        weight = np.array([x["docs"].as_py() for x in held])
        link = linked(rows, sizes, num, den, None if (side == side[0]).all() else side)
        label = _labels(link)
        links = link @ weight
        some = links > 0
        return names[some], names[label[some]], links[some]

    def run(batches):
        held, key = [], None
        for batch in batches:
            columns = [batch.column(i) for i in range(batch.num_columns)]
            keys = list(zip(*(columns[i].to_pylist() for i in range(3)), strict=True))
            out = []
            for i, k in enumerate(keys):
                if k != key and held:
                    out.append(flush(held))
                    held = []
                key = k
                held.append({"cls": columns[3][i], "block": columns[4][i], "docs": columns[5][i], "elements": columns[6][i]})
            if out:
                yield pa.RecordBatch.from_arrays([_long(np.concatenate(x)) for x in zip(*out, strict=True)], names=["cls", "other", "links"])
        if held:
            yield pa.RecordBatch.from_arrays([_long(x) for x in flush(held)], names=["cls", "other", "links"])

    return run


def parity(values: np.ndarray, offsets: np.ndarray) -> list[bytes]:
    """A bitmap of each set, of a power of two of at least 64 bits and the set's size: bit i is the parity of the shingles that hash to i.

    Two bitmaps of one width differ in at most as many bits as their sets in shingles, and halves of a bitmap xor to the narrower one.
    """
    sizes = np.diff(offsets)
    wide = np.maximum(64, 1 << np.ceil(np.log2(np.maximum(sizes, 1))).astype(np.int64))
    base = np.concatenate([[0], np.cumsum(wide)])
    owner = np.repeat(np.arange(len(sizes)), sizes)
    place = base[owner] + (mix(values + np.uint64(0x2545F4914F6CDD1D)) & (wide[owner] - 1).astype(np.uint64)).astype(np.int64)
    packed = np.packbits(np.bincount(place, minlength=base[-1]).astype(np.uint8) & 1, bitorder="little").tobytes()
    return [packed[a // 8 : b // 8] for a, b in zip(base[:-1].tolist(), base[1:].tolist(), strict=True)]


def close_pairs(bits: list[bytes], sizes: np.ndarray, num: int, den: int, left: np.ndarray | None = None) -> np.ndarray:
    """The boolean matrix of pairs whose bitmaps and sizes do not rule out a link; with ``left``, only pairs across it.

    The matrix is all that grows with the square of the sets: counts are held for one row at a time.
    """
    n = len(bits)
    close = np.zeros((n, n), bool)
    width = np.array([len(b) for b in bits])
    side = np.zeros(n, np.int64) if left is None else left
    for w in np.unique(width):
        for mine_of in np.unique(side):
            # rows of this width against those as wide or wider, folded
            rows = np.flatnonzero((width == w) & (side == mine_of))
            others = np.flatnonzero((width >= w) & ((left is None) | (side != mine_of)))
            if not len(rows) or not len(others):
                continue
            folded, mine = (_folded(bits, width, of, w) for of in (others, rows))
            size = sizes[others]
            for row, own in zip(rows.tolist(), mine, strict=True):
                m = sizes[row]
                apart = np.bitwise_count(folded ^ own).sum(axis=1, dtype=np.int64)
                alike = np.minimum(size, m) * den >= np.maximum(size, m) * num
                close[row, others] = alike & (apart <= (size + m) * (den - num) // (den + num))
    close |= close.T
    np.fill_diagonal(close, False)
    return close


def _folded(bits: list[bytes], width: np.ndarray, of: np.ndarray, w: int) -> np.ndarray:
    """The bitmaps ``of`` as rows of ``w`` bytes."""
    out = np.empty((len(of), w // 8), np.uint64)
    for wide in np.unique(width[of]):
        some = np.flatnonzero(width[of] == wide)
        out[some] = np.bitwise_xor.reduce(np.frombuffer(b"".join(bits[i] for i in of[some]), np.uint64).reshape(len(some), -1, w // 8), axis=1)
    return out


def _labels(link: np.ndarray) -> np.ndarray:
    """The smallest index that each row of a link matrix reaches."""
    n = len(link)
    label = np.arange(n)
    while True:
        best = np.concatenate([np.where(link[a : a + ROWS], label[None, :], n).min(axis=1, initial=n) for a in range(0, max(n, 1), ROWS)])
        new = np.minimum(label, best)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _close(num, den):
    """Per unit and block pair: a spanning forest of the pairs that bitmaps do not rule out."""

    def solve(held):
        names, side, sizes = (np.array([x[i] for x in held], np.int64) for i in (0, 1, 2))
        close = close_pairs([x[3] for x in held], sizes, num, den, None if (side == side[0]).all() else side)
        label = _labels(close)
        some = label != np.arange(len(label))
        return pa.RecordBatch.from_arrays([_long(names[some]), _long(names[label[some]])], names=["a", "b"])

    def run(batches):
        held, key = [], None
        for batch in batches:
            columns = [c.to_pylist() for c in batch.columns]
            for unit, first, second, *row in zip(*columns, strict=True):
                if (unit, first, second) != key and held:
                    yield solve(held)
                    held = []
                key = (unit, first, second)
                held.append(row)
        if held:
            yield solve(held)

    return run


def _dealt(members: DataFrame, num: int, den: int, size: int) -> DataFrame:
    """``members`` (unit, cls, n) with the block each class is dealt to, of about ``size`` classes.

    Sizes of similar sets differ by den / num at most, so they are of one band or of neighbouring ones.  A unit that fits one block is one.
    """
    large = members.groupBy("unit").agg(F.count("*").alias("all")).where(F.col("all") > size).select("unit", F.lit(True).alias("large"))
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(den / num) + 1e-9).cast("long")
    banded = members.join(large, "unit", "left").withColumn("band", F.when(F.col("large"), band).otherwise(F.lit(0))).drop("large")
    slots = banded.groupBy("unit", "band").agg(F.ceil(F.count("*") / F.lit(size)).alias("slots"))
    return banded.join(slots, ["unit", "band"]).withColumn("block", F.col("band") * F.lit(1 << 32) + F.pmod(F.xxhash64("cls"), F.col("slots"))).drop("band", "slots")


def _meetings(members: DataFrame, num: int, den: int) -> DataFrame:
    """unit, first, second, block: both sides of every pair of a unit's blocks whose sizes can match."""
    spans = members.groupBy("unit", "block").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    l, r = spans.alias("l"), spans.alias("r")
    matched = l.join(r, (F.col("l.unit") == F.col("r.unit")) & (F.col("l.block") <= F.col("r.block")) & (F.col("l.hi") * den >= F.col("r.lo") * num))
    pairs = matched.select(F.col("l.unit").alias("unit"), F.col("l.block").alias("first"), F.col("r.block").alias("second"))
    return pairs.select("unit", "first", "second", F.explode(F.array_distinct(F.array("first", "second"))).alias("block"))


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= MOST_BROADCAST else df


def jaccard_components(docs: DataFrame, width: int = 3, num: int = 90, den: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, text_hash, root of every row of ``docs`` (doc_id, text).

    ``root`` names the component by its sets: rows of one id and different texts have roots of their own.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("string").alias("text"))
    keyed = rows.withColumn("text_hash", F.xxhash64("text"))

    def describe(batches):
        for part, values, offsets in _blocks(batches, width):
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_hash"), _long(np.diff(offsets)), _long(classes(values, offsets))], names=["doc_id", "text_hash", "n", "cls"])

    def sets(batches):
        for part, values, offsets in _blocks(batches, width):
            yield pa.RecordBatch.from_arrays([part.column("cls"), pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), _long(values))], names=["cls", "elements"])

    def parities(batches):
        for part, values, offsets in _blocks(batches, width):
            yield pa.RecordBatch.from_arrays([part.column("cls"), pa.array(parity(values, offsets), pa.binary())], names=["cls", "bits"])

    described = staged(keyed.mapInArrow(lean(describe), "doc_id long, text_hash long, n long, cls long"), "sets")
    class_docs = staged(
        described.where("cls <> 0").groupBy("cls").agg(F.count("*").alias("docs"), F.min("doc_id").alias("least"), F.min("n").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("example")),
        "classes",
    )
    texts = keyed.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("k"), "text_hash", "text")

    def example(of):
        return of.select("cls", F.coalesce("example.doc_id", F.lit(-(2**63))).alias("k"), F.col("example.text_hash").alias("text_hash"))

    total = class_docs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    buckets = max(shuffle_partitions(docs.sparkSession), -(-2 * total // GATHER))
    one_each = texts.join(_small(example(class_docs)), ["k", "text_hash"]).select("cls", "text")
    
    def tied(sent, buckets, name):
        found = sent.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_tie), "a long, b long")
        return components(staged(found.distinct(), name)).select(F.col("node").alias("cls"), F.col("root").alias("unit"))

    def too_large(units):
        return staged(units.groupBy("unit").agg(F.count("*").alias("all")).where(F.col("all") > BLOCK).select("unit"), "crowded", 1)

    units = tied(one_each.mapInArrow(lean(_sign(width, num, den, buckets)), _RUNS), buckets, "ties")
    settle(docs.sparkSession)
    crowded = too_large(units)
    if not crowded.isEmpty():
        # a unit too large for one block is tied anew by the rarest shingles of its classes
        among = staged(units.join(crowded, "unit", "left_semi").join(class_docs, "cls").select("cls", "n", "example"), "among")
        number = max(shuffle_partitions(docs.sparkSession), -(-among.agg(F.sum("n")).first()[0] // GATHER))
        shingles = texts.join(_small(example(among)), ["k", "text_hash"]).select("cls", "text").mapInArrow(lean(_spread(width, number)), f"{_RUNS}, size binary")
        twice = shingles.repartition(number, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_shared(number)), "bucket int, cls binary, size binary, name binary, count binary")
        first = twice.repartition(number, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(_prefixes(num, den, number)), _RUNS)
        units = units.join(crowded, "unit", "left_anti").unionByName(tied(first, number, "prefixes"))
        del shingles, twice, first
        settle(docs.sparkSession)
        crowded = too_large(units)
    if not crowded.isEmpty():
        # a unit too large for one block is cut where no chain of parity bitmaps holds it together
        among = units.join(crowded, "unit", "left_semi").join(class_docs, "cls").select("unit", "cls", "n", "docs", "example")
        among = staged(_dealt(among, num, den, WIDE), "among")
        bits = texts.join(_small(example(among)), ["k", "text_hash"]).select("cls", "text").mapInArrow(lean(parities), "cls long, bits binary").dropDuplicates(["cls"])
        met = among.select("unit", "block", "cls", "n").join(_meetings(among, num, den), ["unit", "block"]).join(bits, "cls")
        met = met.select("unit", "first", "second", "cls", "block", "n", "bits").repartition(F.col("unit"), F.col("first"), F.col("second")).sortWithinPartitions("unit", "first", "second", "cls")
        apart = components(staged(met.mapInArrow(lean(_close(num, den)), "a long, b long"), "close"))
        units = units.join(crowded, "unit", "left_anti").unionByName(apart.select(F.col("node").alias("cls"), F.col("root").alias("unit")))
    members = _dealt(units.join(class_docs, "cls"), num, den, BLOCK)
    members = staged(members.select("unit", "cls", "block", "docs", "n", "example"), "members")
    sides = _meetings(members, num, den)
    examples = texts.join(_small(example(members)), ["k", "text_hash"]).select("cls", "text").mapInArrow(lean(sets), "cls long, elements array<long>")
    examples = staged(examples.dropDuplicates(["cls"]), "examples")
    work = members.select("unit", "block", "cls", "docs").join(sides, ["unit", "block"]).join(examples, "cls")
    work = work.select("unit", "first", "second", "cls", "block", "docs", "elements")
    ordered = work.repartition(F.col("unit"), F.col("first"), F.col("second")).sortWithinPartitions("unit", "first", "second", "cls")
    verified = staged(ordered.mapInArrow(lean(_verify(num, den)), "cls long, other long, links long"), "links")
    joined = components(verified.select(F.col("cls").alias("a"), F.col("other").alias("b")))
    degree = verified.groupBy("cls").agg(F.sum("links").alias("links"))
    owned = class_docs.join(joined.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    named = owned.groupBy("root").agg(F.min("least").alias("component_id"), F.count("*").alias("members"))
    informed = owned.join(named, "root").join(degree, "cls", "left").where("docs > 1 or members > 1")
    informed = informed.select("cls", "component_id", (F.coalesce("links", F.lit(0)) + F.col("docs") - 1).alias("n_links"), "root")
    told = described.join(informed, "cls", "left")
    root = F.coalesce("root", F.when(F.col("cls") != 0, F.col("cls")))
    return told.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), "text_hash", root.alias("root"))

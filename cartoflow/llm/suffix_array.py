"""Suffix arrays by the difference-cover algorithm (cover {1, 2} modulo 3), in numpy."""

from __future__ import annotations

import numpy as np

#: Names and ranks of a string must fit in 21 bits, so that three of them pack into one key.
MOST_SYMBOLS = (1 << 21) - 8
_BITS = 21


def _pack(*parts: np.ndarray) -> np.ndarray:
    key = parts[0].astype(np.int64)
    for p in parts[1:]:
        key = (key << _BITS) | p
    return key


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes of ``symbols`` (integers from 1 to 2**21 - 1) in order.

    Triples at the positions of the cover are sorted and named, the string of names is
    solved by recursion where names repeat, the remaining suffixes are sorted by their first
    symbol and the rank after it, and the two orders are merged.
    """
    n = len(symbols)
    if n > MOST_SYMBOLS:
        raise ValueError(f"{n} symbols; at most {MOST_SYMBOLS}")
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: symbols[i:].tolist()), np.int64)
    s = np.concatenate([symbols.astype(np.int64), np.zeros(3, np.int64)])
    extra = int(n % 3 == 1)  # a made-up suffix keeps the two halves of the names apart
    ones = np.arange(1, n + extra, 3)
    twos = np.arange(2, n + extra, 3)
    if extra:
        ones = np.append(ones, n) if ones[-1] != n else ones
    sample = np.concatenate([ones, twos])

    # sort the sampled triples and name them
    key = _pack(s[sample], s[sample + 1], s[sample + 2])
    order = np.argsort(key)
    ranked = key[order]
    fresh = np.ones(len(sample), bool)
    fresh[1:] = ranked[1:] != ranked[:-1]
    names = np.empty(len(sample), np.int64)
    names[order] = np.cumsum(fresh)
    # recurse where names repeat
    if not fresh.all():
        order = suffix_array(names)
    rank = np.zeros(n + 3, np.int64)
    rank[sample[order]] = np.arange(1, len(sample) + 1)
    covered = sample[order]
    covered = covered[covered < n]

    # the remaining suffixes, by first symbol and the rank of what follows
    zeros = np.arange(0, n, 3)
    rest = zeros[np.argsort(_pack(s[zeros], rank[zeros + 1]))]

    # merge: a suffix of the rest meets those at 1 and at 2 modulo 3 by different keys
    first, second = covered[covered % 3 == 1], covered[covered % 3 == 2]
    below = np.searchsorted(_pack(s[first], rank[first + 1]), _pack(s[rest], rank[rest + 1]))
    below += np.searchsorted(_pack(s[second], s[second + 1], rank[second + 2]), _pack(s[rest], s[rest + 1], rank[rest + 2]))
    out = np.empty(n, np.int64)
    place = below + np.arange(len(rest))
    taken = np.zeros(n, bool)
    taken[place] = True
    out[place] = rest
    out[~taken] = covered
    return out


def repeated_prefixes(flat: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Whether each suffix in ``order`` shares its first ``width`` bytes with a neighbour in it.

    Prefixes are compared in full, eight bytes at a time; pairs drop out where they differ.
    """
    n = len(order)
    same = np.zeros(n, bool)
    if n < 2:
        return same
    words = np.lib.stride_tricks.sliding_window_view(flat, 8)
    alive = np.arange(n - 1)
    for at in [*range(0, width - 7, 8), *([width - 8] if width % 8 else [])]:
        a, b = words[order[alive] + at], words[order[alive + 1] + at]
        alive = alive[np.ascontiguousarray(a).view(np.uint64)[:, 0] == np.ascontiguousarray(b).view(np.uint64)[:, 0]]
        if not len(alive):
            break
    same[alive] = True
    same[alive + 1] = True
    return same

"""Difference-cover suffix sorting of one shard, as deep as a fixed prefix.

Symbols are eight bytes wide, so a position's successor is eight bytes on. Sampled
triples (classes 1 and 2 of three) are sorted and named, and the names are the symbols
of the next level, until a name covers the prefix that matters. On the way back the
positions of class 0 are merged in: each is compared with class 1 by its symbol and the
successor's rank, with class 2 by two symbols and the rank after them.
"""

from __future__ import annotations

import numpy as np

STRIDE = 8


def _named(*columns: np.ndarray) -> np.ndarray:
    """Dense ranks of rows of names; equal rows share a rank."""
    out = columns[0]
    width = max((int(c.max()) if len(c) else 0) for c in columns).bit_length()
    if width * len(columns) <= 63:
        packed = columns[0].astype(np.int64)
        for c in columns[1:]:
            packed = (packed << width) | c
        return np.unique(packed, return_inverse=True)[1]
    for c in columns[1:]:
        out = np.unique((out.astype(np.int64) << 32) | c, return_inverse=True)[1]
    return out


def _at(names: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Names by position; 0 past the end."""
    inside = places < len(names)
    return np.where(inside, names[np.where(inside, places, 0)], 0)


def _merged(classes: np.ndarray, here: np.ndarray, nxt: np.ndarray, rank: dict[int, np.ndarray]) -> np.ndarray:
    """Ranks of positions of all three classes.

    ``here`` and ``nxt`` are symbols of a position and its successor; ``rank[d]`` holds
    ranks of the sampled position d symbols on.
    """
    zero, one, two = (np.flatnonzero(classes == c) for c in range(3))
    first = _named(np.concatenate([here[zero], here[one]]), np.concatenate([rank[1][zero], rank[1][one]]))
    second = _named(np.concatenate([here[zero], here[two]]), np.concatenate([nxt[zero], nxt[two]]), np.concatenate([rank[2][zero], rank[2][two]]))
    n = len(zero)
    ones, twos = np.sort(first[n:]), np.sort(second[n:])
    before = np.searchsorted(ones, first[:n]) + np.searchsorted(twos, second[:n])
    tied = (np.searchsorted(ones, first[:n], "right") > np.searchsorted(ones, first[:n])) | (np.searchsorted(twos, second[:n], "right") > np.searchsorted(twos, second[:n]))
    sampled = np.sort(np.concatenate([rank[0][one], rank[0][two]]))
    place = np.empty(len(classes), np.int64)
    place[zero] = before * 2 + tied
    place[one] = np.searchsorted(sampled, rank[0][one]) * 2 + 1
    place[two] = np.searchsorted(sampled, rank[0][two]) * 2 + 1
    own = np.zeros(len(classes), np.int64)
    own[zero] = np.where(tied, 0, 1 + second[:n])
    return _named(place, own)


def prefix_ranks(text: np.ndarray, wanted: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of the suffixes at ``wanted`` (sorted) by at least ``depth`` bytes, and the
    rank of the eight bytes at every position. The end is padded with zeros."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(STRIDE, np.uint8)])
    value = np.zeros(n, np.uint64)
    for k in range(STRIDE):
        value = (value << np.uint64(8)) | padded[k : k + n]
    symbols = np.unique(value, return_inverse=True)[1]

    levels = []
    names, sample, wide = symbols, np.arange(n), STRIDE
    need = wanted
    while wide < depth + 2 * STRIDE:
        classes = (need // wide) % 3
        levels.append((names, need, classes, wide))
        reach = np.concatenate([need[classes > 0], need[classes < 2] + wide, need[classes != 1] + 2 * wide])
        chosen = sample[(sample // wide) % 3 > 0]
        triple = _named(*(_at(names, chosen + d * wide) for d in range(3)))
        names = np.zeros(n, np.int64)
        names[chosen] = triple + 1
        sample, need, wide = chosen, np.unique(reach[reach < n]), 3 * wide
    rank = names
    for names, need, classes, wide in reversed(levels):
        held = {d: _at(rank, need + d * wide) for d in range(3)}
        merged = _merged(classes, _at(names, need), _at(names, need + wide), held)
        rank = np.zeros(n, np.int64)
        rank[need] = merged + 1
    return rank[wanted], symbols


def repeated(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """Which of the positions ``wanted`` start ``depth`` bytes that another one starts.

    Suffixes are sorted and each compared, byte for byte, with its neighbour.
    """
    if len(wanted) < 2:
        return np.zeros(len(wanted), bool)
    rank, symbols = prefix_ranks(text, wanted, depth)
    order = np.argsort(rank, kind="stable")
    a, b = wanted[order[:-1]], wanted[order[1:]]
    same = np.arange(len(a))
    steps = [*range(0, depth - STRIDE + 1, STRIDE), depth - STRIDE]
    for step in steps:
        same = same[_at(symbols, a[same] + step) == _at(symbols, b[same] + step)]
    out = np.zeros(len(wanted), bool)
    out[order[same]] = True
    out[order[same + 1]] = True
    return out

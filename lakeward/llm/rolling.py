"""Rolling fingerprints, winnowed anchors and runs over one document's symbols.

Everything here works on one NumPy array at a time, inside a Spark task.
"""

from __future__ import annotations

import numpy as np

# Odd, so both have an inverse modulo 2**64.
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``base**i`` and ``base**-i`` modulo 2**64 for i below at least ``n``."""
    held = _powers.get(base)
    if held is None or len(held[0]) < n:
        size = 1 << max(12, (n - 1).bit_length())
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        held = _powers[base] = (out[0], out[1])
    return held[0][:n], held[1][:n]


def windows(symbols: np.ndarray, width: int, which: int = 0) -> np.ndarray:
    """A 64-bit fingerprint of every ``width`` consecutive symbols (uint64)."""
    n = len(symbols)
    if n < width:
        return np.empty(0, np.uint64)
    up, down = powers(BASES[which], n)
    total = np.empty(n + 1, np.uint64)
    total[0] = 0
    np.cumsum(symbols * up, out=total[1:])
    h = (total[width:] - total[:-width]) * down[: n - width + 1]
    return mixed(h)


def mixed(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64: spreads a polynomial's low bits over the word."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sliding(x: np.ndarray, width: int, of: np.ufunc, fill: int) -> np.ndarray:
    """``of`` over every ``width`` neighbours, in three passes whatever the width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, fill, x.dtype)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    ahead = of.accumulate(rows, axis=1).ravel()
    back = of.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return of(back[: n - width + 1], ahead[width - 1 : n])


_PLACE = np.uint64((1 << 24) - 1)


def anchors(h: np.ndarray, width: int, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of the least of every ``width`` neighbouring fingerprints, and the
    first and last window it belongs to, of the windows that are ``valid``.

    Fingerprints are compared by their upper 40 bits and then by place, so what is
    chosen depends on the window alone: equal windows choose the same place in them.
    """
    chunks = []
    step = int(_PLACE) - width
    for base in range(0, max(0, len(h) - width + 1), step):
        part = h[base : base + step + width - 1]
        least = _sliding((part & ~_PLACE) | np.arange(len(part), dtype=np.uint64), width, np.minimum, np.iinfo(np.uint64).max)
        at = np.flatnonzero(valid[base : base + len(least)])
        if not len(at):
            continue
        chosen = (least[at] & _PLACE).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], (chosen[1:] != chosen[:-1]) | (at[1:] != at[:-1] + 1)]))
        last = np.concatenate([first[1:], [len(chosen)]]) - 1
        chunks.append((chosen[first] + base, at[first] + base, at[last] + base))
    if not chunks:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(c) for c in zip(*chunks, strict=True))


def runs(covered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return edges[::2], edges[1::2]


def painted(n: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A mask of length ``n``, true inside any of the intervals."""
    depth = np.zeros(n + 1, np.int32)
    np.add.at(depth, np.clip(starts, 0, n), 1)
    np.add.at(depth, np.clip(ends, 0, n), -1)
    return np.cumsum(depth[:-1]) > 0


_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True


def word_hashes(text: bytes, step: int = 1 << 20) -> np.ndarray:
    """A 64-bit fingerprint of each word of ``text.split()``, all words at once.

    Long texts are worked on in pieces of about ``step`` bytes that end at a blank.
    """
    octets = np.frombuffer(text, np.uint8)
    out, at = [], 0
    while at < len(octets) or not out:
        to = min(at + step, len(octets))
        while to < len(octets) and not _BLANK[octets[to]]:
            to += 1
        part = octets[at:to]
        starts, ends = runs(~_BLANK[part])
        up, down = powers(BASES[0], len(part) + 1)
        total = np.zeros(len(part) + 1, np.uint64)
        np.cumsum((part + np.uint64(1)) * up[:-1], out=total[1:])
        length = (ends - starts).astype(np.uint64)
        out.append(mixed((total[ends] - total[starts]) * down[starts] + length * np.uint64(BASES[1])))
        at = to
        if at >= len(octets):
            break
    return np.concatenate(out)

"""Periodic runs of words: stretches that repeat a block of words four times or more.

Kolpakov and Kucherov's method, for each text apart. A suffix automaton gives the
Lempel-Ziv factors; Main's method finds the runs that cross or touch the start of a
factor and end inside it, from longest common extensions on both sides; a run inside a
factor is a copy of one in the factor's earlier occurrence.

Before that, each text is cut to the stretches that can hold a run: within a run of
exponent 4 and 6 words every four consecutive words stand at least twice in the text,
so places of other words are no part of one, and a run lies in one stretch as a whole.

Texts are worked on one by one inside their task, whole, and nothing is shuffled. A text
takes about 60 bytes for each of its words, and the automaton about 600 bytes for each word of a
stretch, one stretch at a time.

Nulls and ties: a null text and one without words have no run, no kept words and the
hashes of the empty text. A null doc_id is never altered by ``planted``. Rows that
repeat are judged one by one; runs that tie for the longest are told apart by start,
then period. An empty table gives no rows. Other columns may have any name.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm.rolling import mixed
from lakeward.llm.words import rows_of

#: A run has at least so many words, and its period so many times.
LEAST, TIMES = 6, 4
_GRAM = 4
SCHEMA = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"

Run = tuple[int, int, int]
Edit = Callable[[int | None, list[bytes]], list[bytes]]


# ---- factors --------------------------------------------------------------------------


def automaton(w: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The suffix automaton of ``w``: transitions of each state, and where the first
    occurrence of its strings ends."""
    moves: list[dict[int, int]] = [{}]
    link, size, first = [-1], [0], [-1]
    last = 0
    for at, c in enumerate(w):
        state = len(moves)
        moves.append({})
        size.append(size[last] + 1)
        first.append(at)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = state
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if size[p] + 1 == size[q]:
                link[state] = q
            else:
                clone = len(moves)
                moves.append(moves[q].copy())
                size.append(size[p] + 1)
                first.append(first[q])
                link.append(link[q])
                link[q] = link[state] = clone
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = clone
                    p = link[p]
        last = state
    return moves, first


def factors(w: list[int]) -> list[tuple[int, int, int]]:
    """(start, end, source): the longest piece from ``start`` that also starts earlier,
    at ``source``, which it may overlap; a word that is new stands alone, source -1."""
    moves, first = automaton(w)
    out, at, n = [], 0, len(w)
    while at < n:
        state, end, source = 0, at, -1
        while end < n:
            state = moves[state][w[end]]
            if first[state] >= end:
                break
            source = first[state] - (end - at)
            end += 1
        end = max(end, at + 1)
        out.append((at, end, source))
        at = end
    return out


# ---- runs -----------------------------------------------------------------------------


def extensions(v: list[int]) -> list[int]:
    """Entry q: how many words ``v`` and ``v[q:]`` have in common at their start."""
    n = len(v)
    z = [0] * n
    if n:
        z[0] = n
    lo = hi = 0
    for i in range(1, n):
        k = min(hi - i, z[i - lo]) if i < hi else 0
        while i + k < n and v[k] == v[i + k]:
            k += 1
        z[i] = k
        if i + k > hi:
            lo, hi = i, i + k
    return z


def crossing(w: list[int], before: int, at: int, end: int) -> Iterator[Run]:
    """(start, stop, period) of runs with start <= ``at`` < stop <= ``end``, ``at`` being
    the start of a factor up to ``end`` and ``before`` that of the factor ahead of it.

    Such a run starts after ``before`` - period, or the factor ahead would be longer; so
    three periods are less than both factors, which bounds what is looked at. The right
    side has a word after ``end``, so a stop up to there is the run's own.
    """
    both = end - before
    most = (both - 1) // (TIMES - 1)
    if both + most <= LEAST:
        return
    right, left = w[at : end + 1], w[max(0, before - most) : at]
    back = left[::-1]
    ahead, behind = extensions(right), extensions(back)
    high, wide = min(most, end - at), min(most, len(left))
    # What lies left of ``at`` and of ``at`` + q; what lies right of ``at`` - q and of ``at``.
    down = extensions([*back, -1, *right[:high][::-1], *back])
    up = extensions([*right, -1, *left[len(left) - wide :], *right])
    for q in range(1, most + 1):
        found = []
        if q <= high:
            found.append((at - down[len(back) + 1 + high - q], at + q + (ahead[q] if q < len(right) else 0)))
        if q <= wide:
            found.append((at - q - (behind[q] if q < len(back) else 0), at + up[len(right) + 1 + wide - q]))
        for start, stop in found:
            if at < stop <= end and stop - start >= max(LEAST, TIMES * q):
                yield start, stop, q


def runs_in(w: list[int]) -> list[Run]:
    """(start, stop, period) of every run of ``w``, in order."""
    n = len(w)
    found: dict[int, dict[int, int]] = {}  # by start and stop
    before = 0
    for at, end, source in factors(w):
        if at:
            for start, stop, q in crossing(w, before, at, end):
                held = found.setdefault(start, {})
                held[stop] = min(q, held.get(stop, q))
        if source >= 0 and found:
            shift = at - source
            for start in range(source + 1, end - shift):
                for stop, q in list(found.get(start, {}).items()):
                    to = min(stop + shift, end)
                    if to - start - shift >= max(LEAST, TIMES * q) and not (to == end < n and w[end] == w[end - q]):
                        found.setdefault(start + shift, {})[to] = q
        before = at
    return sorted((start, stop, q) for start, held in found.items() for stop, q in held.items())


def stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """(start, stop) of the pieces of a text whose runs of ``_GRAM`` words all occur
    again in it; a run lies in one of them as a whole."""
    n = len(ids) - _GRAM + 1
    if n < LEAST - _GRAM + 1:
        return []
    h = ids[:n].astype(np.uint64)
    for k in range(1, _GRAM):
        h = mixed(h) + ids[k : n + k].astype(np.uint64)
    order = np.argsort(h)
    same = h[order[1:]] == h[order[:-1]]
    again = np.zeros(n + 2, np.int8)
    again[order[1:][same] + 1] = 1
    again[order[:-1][same] + 1] = 1
    edges = np.flatnonzero(np.diff(again))
    return [(a, b + _GRAM - 1) for a, b in edges.reshape(-1, 2).tolist() if b - a >= LEAST - _GRAM + 1]


def runs_of(words: list[bytes]) -> list[Run]:
    """(start, length, period) of the runs of a text, by start, then period."""
    if len(words) < LEAST:
        return []
    place = {w: i for i, w in enumerate(dict.fromkeys(words))}
    ids = np.fromiter(map(place.__getitem__, words), np.int64, len(words))
    found = [(a + start, stop - start, q) for a, b in stretches(ids) for start, stop, q in runs_in(ids[a:b].tolist())]
    return sorted(found, key=lambda r: (r[0], r[2]))


def strongest(runs: list[Run]) -> Run | None:
    """The run of greatest length over period, ties to the smallest start, then period."""
    best = None
    for r in runs:  # by start, then period
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    return best


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """``words`` without those that a run holds after its first period."""
    dropped = np.zeros(len(words) + 1, np.int64)
    for start, length, q in runs:
        dropped[start + q] += 1
        dropped[start + length] -= 1
    kept = np.flatnonzero(np.cumsum(dropped[:-1]) == 0)
    return [words[i] for i in kept.tolist()]


# ---- Spark ----------------------------------------------------------------------------


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """``words`` with a periodic tail in about one text of ten, by its doc_id's CRC."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    block, times = words[a : a + p], -(-(n - a) // p)
    return words[:a] + (block * times)[: n - a]


def scanned(docs: DataFrame, edit: Edit | None = None, texts: bool = True) -> DataFrame:
    """doc_id, n_runs, the strongest run (start, length, period, exponent_milli: all null
    without a run), runs_sha256 and collapsed_sha256 of every document; with ``texts``
    also ``runs``, all of them, and ``collapsed``, the words that are kept. ``edit``
    changes the words of a document first."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, held in rows_of(batches):
            out = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), held, strict=True):
                words = (text or b"").split()
                words = edit(doc_id, words) if edit else words
                runs = runs_of(words)
                best = strongest(runs)
                kept = b" ".join(collapsed(words, runs) if runs else words)
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
                row = [doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2]]
                row += [hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()]
                out.append((*row, [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs], kept.decode(errors="replace")) if texts else row)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [()] * len(kinds), kinds.values(), strict=True)], list(kinds))

    kinds = {c: pa.int64() for c in ("doc_id", "n_runs", "start", "length", "period", "exponent_milli")} | {c: pa.string() for c in ("runs_sha256", "collapsed_sha256")}
    schema = SCHEMA
    if texts:
        kinds |= {"runs": pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")])), "collapsed": pa.string()}
        schema += ", runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, schema)

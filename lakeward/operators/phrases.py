"""The first phrase of a large vocabulary in each text, by one automaton over all phrases.

Each task builds it once from a broadcast list, whose size is bounded; a text is read
once, and only as far as a phrase that starts first may still end.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.operators.texts import NOT_STATED

#: Characters of all phrases together. The automaton takes about 40 bytes for each.
MOST = 4_000_000


def automaton(phrases: Sequence[tuple[str, int]]) -> tuple[ahocorasick.Automaton, int]:
    """Of lower-case phrases and the places of their labels, and the longest length. Of
    two labels with one phrase the first counts."""
    held = ahocorasick.Automaton()
    for phrase, place in phrases:
        if place < held.get(phrase, (0, place + 1))[1]:
            held.add_word(phrase, (len(phrase), place))
    held.make_automaton()
    return held, max((len(p) for p, _ in phrases), default=0)


def _word(c: str) -> bool:
    return c.isalnum() or c == "_"


def first(text: str | None, held: ahocorasick.Automaton, longest: int, whole: bool) -> int | None:
    """The place of the label that stands first in a text, of those the longest phrase,
    then the first label; with ``whole`` where its ends are those of words."""
    if not text or not longest:
        return None
    low, best = text.lower(), None
    for end, (size, place) in held.iter(low):
        start = end - size + 1
        if best is not None and end >= best[0] + longest:
            break  # whatever ends here or later starts later
        if whole and ((start and _word(low[start]) == _word(low[start - 1])) or (end + 1 < len(low) and _word(low[end]) == _word(low[end + 1]))):
            continue
        key = (start, -size, place)
        if best is None or key < best:
            best = key
    return None if best is None else best[2]


def vocabulary(df: DataFrame, label: str, phrase: str, most: int = MOST) -> dict[str, list[str]]:
    """The phrases of each label of a table, labels in order, once their size is known to
    be at most ``most`` characters. Nulls are no phrases."""
    rows = df.where(F.col(label).isNotNull() & F.col(phrase).isNotNull()).select(label, phrase).distinct()
    size = rows.agg(F.coalesce(F.sum(F.char_length(phrase)), F.lit(0))).first()[0]
    if size > most:
        raise ValueError(f"phrases of {size} characters, of which a worker is to hold {most} at most")
    out: dict[str, list[str]] = {}
    for name, text in rows.orderBy(label, phrase).collect():
        out.setdefault(str(name), []).append(text)
    return out


def extracted(df: DataFrame, text: str, vocabulary: Mapping[str, Sequence[str]], name: str = "label", whole: bool = True, most: int = MOST) -> DataFrame:
    """``df`` with ``name``, the label one of whose phrases comes first in ``text``, in any
    case; NOT_STATED for none, as in a null text. Blank phrases match nothing. Phrases of
    more than ``most`` characters together are refused, as every worker holds them all."""
    labels = list(vocabulary)
    phrases = [(p.lower(), i) for i, label in enumerate(labels) for p in vocabulary[label] if p.strip()]
    if (size := sum(len(p) for p, _ in phrases)) > most:
        raise ValueError(f"phrases of {size} characters, of which a worker is to hold {most} at most")
    held = df.sparkSession.sparkContext.broadcast((labels, phrases))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, words = held.value
        built = automaton(words)
        for batch in batches:
            places = [first(t, *built, whole) for t in batch.column(text).to_pylist()]
            yield batch.append_column(name, pa.array([NOT_STATED if p is None else names[p] for p in places], pa.string()))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(extract, f"{kinds}, `{name}` string")

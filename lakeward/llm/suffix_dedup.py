"""Removal of byte strings that occur twice, by difference-cover suffix sorting.

Suffixes are sorted in shards. A shard holds whole keys of ``repeats``, under which
equal strings meet, so each shard can be sorted alone and its size is bounded by
cutting between keys. The contents of a key with more than ``LARGE_KEY`` are cut into
parts of few suffixes under keys of their own, which add the bytes those share; equal
parts are counted by their bytes, the others sorted in shards as before. Suffixes of
parts whose key is again beyond the limit are ordered over all tasks by ranges of their
prefix, and each is compared with its neighbour, across the ranges' edges too. So no
task holds more of a key than the limit, and every hit is one of equal bytes in suffix
order, whatever the size of its key.

Before that, contents that occur again as a whole are settled by counting, and keys
with one content are left out, which leaves the suffixes of open cells. Contents are
equal there by a 64-bit fingerprint under a 64-bit key, and no bytes are compared.

Nulls and ties: a null text is empty; rows that repeat a document are copies of each
other and lose every byte that a string of the given length covers; null doc_ids are
documents like others. A shorter document keeps all its bytes; a very long one is cut
into cells in pieces. An empty table gives no rows. Only doc_id and text are read, so
other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.llm import repeats, suffixes
from lakeward.llm.shared import stored

WIDTH = 400
BLOCK = 64
SHARD_BYTES = 1_000_000
#: Bytes of contents that a task is dealt, and the most tasks they are dealt over.
TASK_BYTES, MOST_TASKS = 4_000_000, 20_000
#: Windows of a range; Spark samples a hundred of each to find its edges.
RANGE_ROWS = 20_000
#: Contents of one key that one task may sort: with 400 to 736 bytes each, 0.4 MB.
LARGE_KEY = 512


Piece = tuple[int, int | None, int, bytes]
_RUNS = "row long, doc_id long, first long, last long"


def _batch(runs: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*runs, strict=True)], ["row", "doc_id", "first", "last"])


def _runs(pieces: list[Piece], width: int) -> list[tuple]:
    """Row, doc_id, first and last of the windows of a shard that occur twice in it."""
    length = np.array([len(p[3]) for p in pieces])
    base = np.concatenate([[0], np.cumsum(length)])
    text = np.frombuffer(b"".join(p[3] for p in pieces), np.uint8)
    windows = length - width + 1
    ahead = np.concatenate([[0], np.cumsum(windows)])
    owner = np.repeat(np.arange(len(pieces)), windows)
    within = np.arange(len(owner)) - ahead[owner]
    hit = suffixes.repeated(text, base[owner] + within, width)
    edge = np.zeros(len(hit) + 1, bool)
    edge[ahead] = True  # no run goes on from one piece into the next
    before, after = np.concatenate([[False], hit[:-1]]) & ~edge[:-1], np.concatenate([hit[1:], [False]]) & ~edge[1:]
    firsts, lasts = np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after)
    out = []
    for a, b in zip(firsts.tolist(), lasts.tolist(), strict=True):
        row, doc_id, start, _ = pieces[owner[a]]
        out.append((row, doc_id, start + int(within[a]), start + int(within[b])))
    return out


def _sorted(parts: DataFrame, width: int, shard_bytes: int) -> DataFrame:
    """Repeated windows of contents (key, row, doc_id, start, content) in shards."""

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: list[Piece] = []
        size, last = 0, None

        def give() -> Iterator[pa.RecordBatch]:
            if len(pieces) > 1 and (runs := _runs(pieces, width)):
                yield _batch(runs)

        for batch in batches:
            for key, *piece in zip(*(batch.column(c).to_pylist() for c in ("key", "row", "doc_id", "start", "content")), strict=True):
                if size >= shard_bytes and key != last:
                    yield from give()
                    pieces, size = [], 0
                pieces.append(tuple(piece))
                size, last = size + len(piece[3]), key
        yield from give()

    total = parts.agg(F.sum("n")).first()[0] or 0
    dealt = parts.select("key", "row", "doc_id", "start", "content").repartition(min(MOST_TASKS, 1 + total // TASK_BYTES), "key").sortWithinPartitions("key")
    return dealt.mapInArrow(sort, _RUNS)


def _neighbours(windows: DataFrame, ranges: int) -> DataFrame:
    """Windows (row, doc_id, start, content) whose content another one has, by order of
    contents over all tasks."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, again, first = None, False, True

        def told(window: tuple, repeated: bool, edge: bool) -> list[tuple]:
            return [(*window[:3], None, False)] * repeated + [(*window, True)] * edge

        def give(found: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.int64()] * 3 + [pa.binary(), pa.bool_()]
            columns = zip(*found, strict=True) if found else [()] * 5
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["row", "doc_id", "start", "content", "edge"])

        for batch in batches:
            out: list[tuple] = []
            for window in zip(*(batch.column(c).to_pylist() for c in ("row", "doc_id", "start", "content")), strict=True):
                same = last is not None and window[3] == last[3]
                if last is not None:
                    out += told(last, again or same, first)
                    first = False
                last, again = window, same
            yield give(out)
        if last is not None:
            yield give(told(last, again, True))

    order = ("content", "row", "doc_id", "start")
    found = stored(windows.repartitionByRange(ranges, *order).sortWithinPartitions(*order).mapInArrow(compare, "row long, doc_id long, start long, content binary, edge boolean"), "neighbours")
    edges = found.where("edge")  # two of each range at most
    met = edges.join(edges.groupBy(F.col("content").alias("c")).agg(F.count("*").alias("times")).where("times > 1"), F.col("content") == F.col("c"))
    both = found.where("not edge").select("row", "doc_id", "start").unionByName(met.select("row", "doc_id", "start"))
    return both.select("row", "doc_id", F.col("start").alias("first"), F.col("start").alias("last"))


def _crowded(parts: DataFrame, width: int, shard_bytes: int, large_key: int) -> DataFrame:
    """Repeated windows of the parts of crowded keys' contents."""
    last = F.col("start") + F.col("n") - width
    one = F.first(F.struct("row", "doc_id", "start", "n")).alias("one")
    kinds = parts.groupBy("key", "content").agg(F.count("*").alias("times"), one)
    again = kinds.where("times > 1").select(F.col("key").alias("k"), F.col("content").alias("c"))
    whole = parts.join(again, (F.col("key") == F.col("k")) & (F.col("content") == F.col("c")), "left_semi").select("row", "doc_id", F.col("start").alias("first"), last.alias("last"))
    sizes = kinds.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("kinds")).where("kinds > 1")
    open_ = stored(kinds.join(sizes, F.col("key") == F.col("k")).select("key", "content", "kinds", "one.*"), "open-parts")
    few = _sorted(open_.where(F.col("kinds") <= large_key), width, shard_bytes)
    place = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - width)).alias("at")
    many = open_.where(F.col("kinds") > large_key).select("row", "doc_id", "start", "content", place)
    windows = many.select("row", "doc_id", (F.col("start") + F.col("at")).alias("start"), F.expr(f"substring(content, cast(at as int) + 1, {width})").alias("content"))
    n = open_.where(F.col("kinds") > large_key).agg(F.sum(F.col("n") - width + 1)).first()[0] or 0
    return whole.unionByName(few).unionByName(_neighbours(windows, min(MOST_TASKS, 1 + n // RANGE_ROWS)))


def repeated(parts: DataFrame, rule: repeats.Rule, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """row, doc_id, first and last of the repeated windows of opened and crowded cells."""
    found, crowded = _sorted(parts.where("what = 2"), rule.width, shard_bytes), parts.where("what = 3")
    return found if crowded.isEmpty() else found.unionByName(_crowded(crowded, rule.width, shard_bytes, rule.large_key))


def deduplicated(docs: DataFrame, width: int = WIDTH, block: int = BLOCK, shard_bytes: int = SHARD_BYTES, large_key: int = LARGE_KEY, with_text: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (``with_text``) kept."""
    rule = repeats.Rule(width, block, earlier=False, words=False, large_key=large_key)
    out = repeats.removal(docs, rule, lambda parts: repeated(parts, rule, shard_bytes), with_text)
    text = ["kept"] if with_text else []
    return out.select("doc_id", F.col("n").alias("n_bytes"), F.col("removed").alias("n_removed"), F.col("spans").alias("n_spans"), F.col("sha").alias("kept_sha256"), *text)

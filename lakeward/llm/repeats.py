"""Stretches of ``width`` symbols that occur twice, over whole documents.

Every rolling stretch of ``block`` symbols is fingerprinted, and the least fingerprint
in a window of ``width`` symbols is its anchor: equal windows have equal anchors.
The windows behind one anchor, split by the side on which they hold more context, are
a cell; its key is the anchor with that context, so equal windows meet under one key.

1. Cells are counted by key and by whole content, a fingerprint of 64 bits each. A
   content that occurs again settles all of its windows at once, however many copies
   there are.
2. Where one key has different contents, a single copy of each is open, and only its
   windows are looked at one by one. Where only earlier copies count, every place that
   no earlier copy has settled is open. Contents of a crowded key leave as parts.
3. Texts are joined once with what was found about their cells, and documents with
   open cells a second time with the windows that turned out repeated.

Counts go through partial aggregates and joins that Spark may split, so neither a
passage nor a group of copies in a third of all rows gathers in one task. A document is
known by its doc_id and a 64-bit fingerprint of both doc_id and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from lakeward.llm import rolling
from lakeward.llm.shared import discard, stored


@dataclass(frozen=True)
class Rule:
    """What repeats: ``width`` symbols, found by anchors of ``block`` symbols.

    ``earlier``: only a copy in a document with a smaller doc_id counts; else any other
    place does. ``words``: symbols are words, else bytes. ``large_key``: contents of one
    key up to which they are looked at in one task; those of a crowded key leave in
    parts of at most ``fine`` windows, filed under all bytes that these share (bytes),
    or as fingerprints of their windows (words).
    """

    width: int
    block: int
    earlier: bool
    words: bool
    large_key: int = 0
    fine: int = 16
    piece: int = 1_000_000


def symbols(text: bytes | None, rule: Rule) -> np.ndarray:
    """A word's fingerprint (uint64) or a byte (uint8) each."""
    return rolling.word_hashes(text or b"") if rule.words else np.frombuffer(text or b"", np.uint8)


def wide(x: np.ndarray) -> np.ndarray:
    """Symbols as uint64, none of them zero for a byte."""
    return x if x.dtype == np.uint64 else x.astype(np.uint64) + np.uint64(1)


#: Symbols of short documents that are worked on together, and documents that are taken
#: out of an Arrow batch together.
TOGETHER = 100_000
AT_ONCE = 500

Cells = tuple[np.ndarray, ...]


def cells(xs: list[np.ndarray], rule: Rule) -> Cells:
    """Of each cell the document (its place in ``xs``), key, content fingerprint, and
    where the content starts and ends and the anchor stands in it; by document."""
    width, block = rule.width, rule.block
    bounds = np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64)
    x, n = wide(np.concatenate(xs)), int(bounds[-1])
    if n < width:
        return (np.empty(0, np.int64), *(np.empty(0, np.uint64),) * 2, *(np.empty(0, np.int64),) * 3)
    # Documents stand side by side; a window is valid if it ends in the one it starts in.
    owner = np.repeat(np.arange(len(xs)), np.diff(bounds))
    valid = owner[: n - width + 1] == owner[width - 1 :]
    h = rolling.windows(x, block)
    a, first, last = rolling.anchors(h, width - block + 1, valid)
    least, most = a - last, a - first  # how far before the anchor its windows start
    half = (width - block + 1) // 2
    right = width - block - half + 1

    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * rolling.powers(b, n)[0])]) for b in rolling.BASES]

    def digest(starts: np.ndarray, ends: np.ndarray, which: int) -> np.ndarray:
        down = rolling.powers(rolling.BASES[which], n + 1)[1]
        return rolling.mixed((sums[which][ends] - sums[which][starts]) * down[starts])

    out = []
    for side in (0, 1):
        lo, hi = (least, np.minimum(most, half - 1)) if side == 0 else (np.maximum(least, half), most)
        ok = lo <= hi
        at, lo, hi = a[ok], lo[ok], hi[ok]
        context = digest(at + block, at + block + right, 0) if side == 0 else digest(at - half, at, 0)
        key = rolling.mixed(h[at] + context * np.uint64(0x9E3779B97F4A7C15) + np.uint64(side))
        starts, ends = at - hi, at - lo + width
        content = rolling.mixed(digest(starts, ends, 1) + (ends - starts).astype(np.uint64))
        out.append((owner[starts], key, content, starts, ends, at))
    doc, key, content, starts, ends, at = (np.concatenate(c) for c in zip(*out, strict=True))
    order = np.argsort(doc, kind="stable")
    doc, starts, ends, at = doc[order], starts[order], ends[order], at[order]
    return doc, key[order], content[order], starts - bounds[doc], ends - bounds[doc], at - bounds[doc]


def long_cells(x: np.ndarray, rule: Rule) -> Cells:
    """``cells`` of one document, in pieces that share no window. A cell may be cut
    where pieces meet, which leaves it to be looked into."""
    out = []
    for base in range(0, len(x) - rule.width + 1, rule.piece):
        doc, key, content, *places = cells([x[base : base + rule.piece + rule.width - 1]], rule)
        out.append((doc, key, content, *(p + base for p in places)))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))


def together(texts: list[bytes | None], rule: Rule) -> Iterator[tuple[int, list[np.ndarray], Cells]]:
    """Runs of documents as their first place, their symbols and their cells."""
    base, xs, size = 0, [], 0
    for i, text in enumerate(texts):
        x = symbols(text, rule)
        if len(x) > rule.piece + rule.width:
            if xs:
                yield base, xs, cells(xs, rule)
            yield i, [x], long_cells(x, rule)
            base, xs, size = i + 1, [], 0
            continue
        xs.append(x)
        size += len(x)
        if size >= TOGETHER:
            yield base, xs, cells(xs, rule)
            base, xs, size = i + 1, [], 0
    if xs:
        yield base, xs, cells(xs, rule)


def sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few documents each, so that no worker holds thousands of texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, AT_ONCE):
            yield batch.slice(at, AT_ONCE)


def _kinds(key: np.ndarray, content: np.ndarray) -> np.ndarray:
    return rolling.mixed(key + rolling.mixed(content)).view(np.int64)


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and a row id that repeated rows share."""
    text = F.col("text").cast("binary")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.xxhash64(F.col("doc_id").cast("long"), text).alias("row"))


def _found(docs: DataFrame, rule: Rule) -> DataFrame:
    """row, doc_id, key, kind, n: the different cells of each document."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = batch.column("row").to_numpy()
            for base, _, (at, key, content, *_) in together(batch.column("text").to_pylist(), rule):
                kind = _kinds(key, content)
                order = np.lexsort((kind, at))
                at, kind, key = at[order], kind[order], key[order]
                first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (kind[1:] != kind[:-1])])) if len(at) else order
                count = np.diff(np.concatenate([first, [len(at)]])).astype(np.int32)
                place = pa.array(base + at[first])
                columns = [pa.array(rows[base + at[first]]), batch.column("doc_id").take(place), pa.array(key[first].view(np.int64)), pa.array(kind[first]), pa.array(count)]
                yield pa.RecordBatch.from_arrays(columns, ["row", "doc_id", "key", "kind", "n"])

    return _rows(docs).mapInArrow(scan, "row long, doc_id long, key long, kind long, n int")


def _told(docs: DataFrame, rule: Rule) -> DataFrame:
    """A document and three lists of kinds: settled (repeated as a whole), opened (to
    look into) and crowded (to look into, of a key with many contents)."""
    found = stored(_found(docs, rule), "cells")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("first")
    kinds = found.groupBy("key", "kind").agg(F.sum("n").alias("n"), F.count("*").alias("rows"), first)
    shared = kinds.groupBy(F.col("key").alias("k")).agg(F.count("*").alias("kinds"), F.sum("n").alias("all")).where("all > 1")
    marked = stored(kinds.join(shared, F.col("key") == F.col("k")).drop("k"), "kinds")
    again = marked.where("rows > 1" if rule.earlier else "n > 1").select(F.col("key").alias("k"), F.col("kind").alias("k2"), F.col("first.doc_id").alias("first_doc"), "kinds")
    copies = found.join(again, (F.col("key") == F.col("k")) & (F.col("kind") == F.col("k2")))
    state = F.when(F.col("kinds") > rule.large_key, "crowded").otherwise("opened")
    if rule.earlier:  # copies without an earlier one, of equal or no doc_id, are open in each row
        settled = F.coalesce(F.expr(_EARLIER), F.lit(False))
        copies = copies.where(settled | (F.col("kinds") > 1)).select("row", "doc_id", "kind", F.when(settled, "settled").otherwise(state).alias("state"))
        single = marked.where("kinds > 1 and rows = 1")
    else:
        copies, single = copies.select("row", "doc_id", "kind", F.lit("settled").alias("state")), marked.where("kinds > 1")
    both = copies.unionByName(single.select(F.col("first.row").alias("row"), F.col("first.doc_id").alias("doc_id"), "kind", state.alias("state")))
    lists = [F.collect_set(F.when(F.col("state") == s, F.col("kind"))).alias(s) for s in ("settled", "opened", "crowded")]
    told = stored(both.groupBy(*_told_of()).agg(*lists), "told")
    discard(docs.sparkSession, found, marked)
    return told


def _told_of() -> tuple[F.Column, F.Column]:
    return F.col("row").alias("told_row"), F.col("doc_id").alias("told_doc")


def _with_told(rows: DataFrame, told: DataFrame) -> DataFrame:
    same = (F.col("row") == F.col("told_row")) & F.col("doc_id").eqNullSafe(F.col("told_doc"))
    return rows.join(told, same, "left").drop("told_row", "told_doc")


_PARTS = "what int, row long, doc_id long, n long, removed long, spans long, sha string, kept binary, text binary, covered binary, key long, start long, content binary, w1 long, w2 long"
_EARLIER = "first_doc < doc_id or (first_doc is not null and doc_id is null)"
_DIGEST = ("doc_id", "n", "removed", "spans", "sha", "kept")


def _packed(text: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(text)


def _unpacked(text: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(text)


def _digest(text: bytes | None, covered: np.ndarray, rule: Rule, with_text: bool) -> tuple:
    """n, removed, spans, sha and, if asked for, what is kept."""
    if rule.words:
        words = (text or b"").split()
        kept = b" ".join(compress(words, (~covered).tolist()) if covered.any() else words)
    else:
        kept = np.frombuffer(text or b"", np.uint8)[~covered].tobytes()
    return len(covered), int(covered.sum()), len(rolling.runs(covered)[0]), hashlib.sha256(kept).hexdigest(), kept if with_text else None


def _windows(x: np.ndarray, starts: np.ndarray, ends: np.ndarray, rule: Rule) -> tuple[np.ndarray, ...]:
    """Places of the windows inside some contents, each once, and their fingerprints."""
    spans = list(zip(starts.tolist(), ends.tolist(), strict=True))
    places = [np.arange(a, b - rule.width + 1) for a, b in spans]
    if len(x) <= rule.piece:  # one pass over all of it is cheaper than one for each content
        rows = [(np.concatenate(places), 0, x)]
    else:
        rows = [(at, a, x[a:b]) for at, (a, b) in zip(places, spans, strict=True)]
    out = []
    for at, base, part in rows:
        part = wide(part)
        out.append((at, *(rolling.windows(part, rule.width, which).view(np.int64)[at - base] for which in (0, 1))))
    at, first, second = (np.concatenate(c) for c in zip(*out, strict=True))
    once = np.unique(at, return_index=True)[1]
    return at[once], first[once], second[once]


def _fine(text: bytes, key: bytes, start: int, end: int, anchor: int, rule: Rule) -> Iterator[dict]:
    """A content cut into parts of windows that are as far before the anchor, so equal
    windows stand in equal parts; the key of each adds the bytes all its windows share."""
    low, high = anchor + rule.width - end, anchor - start
    for part in range(low // rule.fine, high // rule.fine + 1):
        near, far = part * rule.fine, (part + 1) * rule.fine - 1
        first, last = anchor - min(far, high), anchor - max(near, low) + rule.width
        shared = hashlib.blake2b(text[anchor - near : anchor - far + rule.width], digest_size=8, salt=key, person=part.to_bytes(8, "little"))
        yield {"what": 3, "n": last - first, "key": int.from_bytes(shared.digest(), "little", signed=True), "start": first, "content": text[first:last]}


def _by_document(texts: list[bytes | None], rule: Rule) -> Iterator[tuple[np.ndarray, ...]]:
    """Symbols, keys, contents, starts and ends of one document after the other."""
    for _, xs, (doc, *columns) in together(texts, rule):
        edges = np.searchsorted(doc, np.arange(len(xs) + 1))
        for i, x in enumerate(xs):
            yield (x, *(c[edges[i] : edges[i + 1]] for c in columns))


def length(text: bytes | None, rule: Rule) -> int:
    return len((text or b"").split() if rule.words else text or b"")


def _second_look(docs: DataFrame, told: DataFrame, rule: Rule, with_text: bool) -> DataFrame:
    """Digests of documents that are settled (what 0), the texts of those that are not
    (1), of each opened cell its content (2) and of each crowded one its parts (3)."""
    arrow = to_arrow_schema(StructType.fromDDL(_PARTS))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out: list[dict] = []
            held = 0
            rows = batch.to_pylist()
            told = [any(r[c] for c in ("settled", "opened", "crowded")) for r in rows]
            found = _by_document([r["text"] for r, some in zip(rows, told, strict=True) if some], rule)
            for r, some in zip(rows, told, strict=True):
                settled, opened, crowded = (np.array(r[c] or (), np.int64) for c in ("settled", "opened", "crowded"))
                if some:
                    x, key, content, starts, ends, anchor = next(found)
                    kind = _kinds(key, content)
                    known = np.isin(kind, settled)
                    covered = rolling.painted(len(x), starts[known], ends[known])
                else:
                    covered = np.zeros(length(r["text"], rule), bool)
                base = {"row": r["row"], "doc_id": r["doc_id"]}
                if len(opened) + len(crowded):
                    runs = np.stack(rolling.runs(covered)).astype(np.int64)
                    out.append(base | {"what": 1, "text": _packed(r["text"]), "covered": runs.tobytes()})
                    unique, first = np.unique(kind, return_index=True)
                    whole = first[np.isin(unique, opened)]
                    single = np.flatnonzero(np.isin(kind, crowded)) if rule.earlier else first[np.isin(unique, crowded)]
                    out += [base | {"what": 2, "n": int(ends[i] - starts[i]), "key": int(key[i].view(np.int64)), "start": int(starts[i]), "content": r["text"][starts[i] : ends[i]]} for i in whole]
                    held += len(r["text"]) + int((ends[whole] - starts[whole]).sum())
                    if len(single) and not rule.words:
                        for i in single:
                            for part in _fine(r["text"], key[i].tobytes(), int(starts[i]), int(ends[i]), int(anchor[i]), rule):
                                out.append(base | part)
                                held += part["n"]
                    elif len(single):
                        places, first, second = _windows(x, starts[single], ends[single], rule)
                        out += [base | {"what": 3, "start": s, "w1": a, "w2": b} for s, a, b in zip(places.tolist(), first.tolist(), second.tolist(), strict=True)]
                else:
                    n, removed, spans, sha, kept = _digest(r["text"], covered, rule, with_text)
                    out.append(base | {"what": 0, "n": n, "removed": removed, "spans": spans, "sha": sha, "kept": kept})
                if held > 4_000_000 or len(out) > 20_000:
                    yield pa.RecordBatch.from_pylist(out, schema=arrow)
                    out, held = [], 0
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    parts = stored(_with_told(_rows(docs), told).mapInArrow(scan, _PARTS), "second-look")
    discard(docs.sparkSession, told)
    return parts


def compared(parts: DataFrame, rule: Rule) -> DataFrame:
    """row, doc_id, first and last: the single windows (3) that occur again."""
    windows = parts.where("what = 3").select("row", "doc_id", "start", "w1", "w2")
    times = windows.groupBy(F.col("w1").alias("v1"), F.col("w2").alias("v2")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("times"))
    again = windows.join(times.where("times > 1"), (F.col("w1") == F.col("v1")) & (F.col("w2") == F.col("v2")))
    return (again.where(_EARLIER) if rule.earlier else again).select("row", "doc_id", F.col("start").alias("first"), F.col("start").alias("last"))


def removal(docs: DataFrame, rule: Rule, repeated: Callable[[DataFrame], DataFrame], with_text: bool = False) -> DataFrame:
    """doc_id, n, removed, spans, sha and (``with_text``) kept for every document.

    ``repeated`` gives row, doc_id and the first and last of repeated windows that
    stand in a row, of opened and crowded cells.
    """
    parts = _second_look(docs, _told(docs, rule), rule, with_text)
    found = repeated(parts).groupBy(*_told_of()).agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    joined = _with_told(parts.where("what = 1").select("row", "doc_id", "text", "covered"), found)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            out = []
            for r in batch.to_pylist():
                text = _unpacked(r["text"])
                size = length(text, rule)
                runs = np.frombuffer(r["covered"], np.int64).reshape(2, -1)
                again = np.array([(a["first"], a["last"]) for a in r["runs"] or ()], np.int64).reshape(-1, 2)
                covered = rolling.painted(size, np.concatenate([runs[0], again[:, 0]]), np.concatenate([runs[1], again[:, 1] + rule.width]))
                out.append((r["doc_id"], *_digest(text, covered, rule, with_text)))
            kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], list(_DIGEST))

    rest = joined.mapInArrow(scan, "doc_id long, n long, removed long, spans long, sha string, kept binary")
    return parts.where("what = 0").select(*_DIGEST).unionByName(rest)

"""SimHash near-duplicates, compared in bit-sliced form.

A document's fingerprint holds a bit for each place where over half of its shingles'
XXH64 hashes (seed 42) have one. Equal fingerprints are one node. Nodes within
``radius`` bits agree in two of ``radius + 2`` equal parts of the fingerprint, so each
pair of parts is a bucket key and only nodes of a bucket are compared. A bucket above
``LARGE`` nodes is split again by pairs of quarters of the bits that are left, which
bounds it by 65,536 nodes for a radius of 2.

Inside a task, fingerprints are stored as vertical bit planes. The distances of all
lanes to the lane some places on grow together, plane by plane, in carry-save counters
with a plane that stays set above the radius; a block of lanes is abandoned once that
plane is full. Buckets give a spanning forest of their links, not all pairs.

Nulls and ties: a null text and a text without words have fingerprint zero, linked
like any other; the component of documents that all lack a doc_id is null; repeated
rows are one node and a row each. An empty table gives no rows. The words and hashes of
a text are held together while it is worked on, about twenty times its bytes. Other
columns may have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeward.llm.components import roots
from lakeward.llm.shared import stored
from lakeward.llm.words import rows_of

BITS = 64
LARGE = 1024
#: Lanes of a block, which is abandoned as soon as all are beyond the radius.
BLOCK = 4096
_LANES = np.uint64(0x0101010101010101)


def shingle_hashes(text: bytes | None, size: int) -> np.ndarray:
    """XXH64 of every ``size`` consecutive words, space-joined; of all if fewer."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    if len(words) < size:
        return np.array([xxhash.xxh64_intdigest(joined, 42)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    end = np.cumsum(length + 1) - 1
    digest = xxhash.xxh64_intdigest
    cuts = zip((end - length)[: len(words) - size + 1].tolist(), end[size - 1 :].tolist(), strict=True)
    return np.fromiter((digest(joined[a:b], 42) for a, b in cuts), np.uint64, len(words) - size + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of ``hashes``; zero for none."""
    n = len(hashes)
    if not n:
        return 0
    rows = -(-n // 255)  # a byte lane holds a count of 255
    padded = np.zeros(rows * 255, np.uint64)
    padded[:n] = hashes
    value = 0
    for j in range(8):
        lanes = ((padded >> np.uint64(j)) & _LANES).reshape(rows, 255).sum(axis=1)
        counts = lanes.astype("<u8").view(np.uint8).reshape(rows, 8).sum(axis=0, dtype=np.int64)
        for lane in np.flatnonzero(2 * counts > n).tolist():
            value |= 1 << (8 * lane + j)
    return value


def fingerprints(docs: DataFrame, shingle: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) and columns ``keep``."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            fp = np.array([fingerprint(shingle_hashes(t, shingle)) for t in texts], np.uint64).view(np.int64)
            at = batch.schema.get_field_index("text")
            yield batch.remove_column(at).append_column("fp", pa.array(fp))

    chosen = docs.select(F.col("doc_id").cast("long"), "text", *keep)
    kinds = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in chosen.select(*keep).schema) if keep else ""
    return chosen.mapInArrow(scan, f"doc_id long{kinds}, fp long")


def _slice(bits: np.ndarray) -> np.ndarray:
    """Bits of many lanes as 64-bit words."""
    packed = np.packbits(bits, bitorder="little")
    out = np.zeros(-(-len(packed) // 8) * 8, np.uint8)
    out[: len(packed)] = packed
    return out.view(np.uint64)


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """Row i holds bit i of every fingerprint."""
    octets = fps.astype("<u8").view(np.uint8).reshape(len(fps), 8)
    return np.ascontiguousarray(np.unpackbits(octets, axis=1, bitorder="little").T)


def close_lanes(planes: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, check: int = 8) -> np.ndarray:
    """For each lane, whether fingerprints ``a`` and ``b`` (places in ``planes``)
    differ in at most ``radius`` bits."""
    out = np.zeros(len(a), bool)
    for at in range(0, len(a), BLOCK):
        out[at : at + BLOCK] = _close_block(planes, a[at : at + BLOCK], b[at : at + BLOCK], radius, check)
    return out


def _close_block(planes: np.ndarray, a: np.ndarray, b: np.ndarray, radius: int, check: int) -> np.ndarray:
    """``close_lanes`` of one block, which is left when all of its lanes are beyond."""
    counters = [np.zeros(-(-len(a) // 64), np.uint64) for _ in range(max(1, radius.bit_length()))]
    beyond = ~_slice(np.ones(len(a), bool))
    for i in range(BITS):
        carry = _slice(planes[i][a] ^ planes[i][b])
        for j, c in enumerate(counters):
            counters[j], carry = c ^ carry, c & carry
        beyond |= carry
        # Counters hold at most 2**len - 1; lanes above the radius are marked now.
        over = np.zeros_like(beyond)
        equal = ~over
        for j in range(len(counters) - 1, -1, -1):
            if radius >> j & 1:
                equal &= counters[j]
            else:
                over |= equal & counters[j]
                equal &= ~counters[j]
        beyond |= over
        if i % check == check - 1 and bool((beyond == np.uint64(0xFFFFFFFFFFFFFFFF)).all()):
            break
    return ~np.unpackbits(beyond.view(np.uint8), bitorder="little")[: len(a)].astype(bool)


def bucket_links(keys: np.ndarray, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links inside the buckets of ``keys`` (sorted)."""
    label = np.arange(len(fps))
    step = 1
    live = np.flatnonzero(keys[step:] == keys[:-step])
    pairs = []
    planes = bit_planes(fps)
    while len(live):
        near = live[close_lanes(planes, live, live + step, radius)]
        pairs.append((near, near + step))
        step += 1
        live = live[live + step < len(keys)]
        live = live[keys[live + step] == keys[live]]
    if pairs:
        a, b = (np.concatenate(c) for c in zip(*pairs, strict=True))
        while True:
            low = np.minimum(label[a], label[b])
            was = label.copy()
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            np.minimum.at(label, was, label)
            label = label[label]
            if (label == was).all():
                break
    moved = np.flatnonzero(label != np.arange(len(fps)))
    return fps[moved], fps[label[moved]]


def _compared(buckets: DataFrame, radius: int) -> DataFrame:
    """Links of rows (part, key, fp) that share part and key."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.empty((2, 0), np.int64)
        for batch in batches:
            rows = np.stack([batch.column(c).to_numpy() for c in ("bucket", "fp")])
            held = np.concatenate([held, rows], axis=1)
            # The last bucket may go on in the next batch.
            done = int(np.searchsorted(held[0], held[0, -1])) if held.shape[1] else 0
            yield from give(held[:, :done])
            held = held[:, done:]
        yield from give(held)

    def give(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
        if rows.shape[1] > 1:
            u, v = bucket_links(rows[0], np.ascontiguousarray(rows[1]).view(np.uint64), radius)
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], ["u", "v"])

    dealt = buckets.select("bucket", "fp").repartition("bucket").sortWithinPartitions("bucket")
    return dealt.mapInArrow(compare, "u long, v long")


def _parts(width: int, count: int) -> list[tuple[int, int]]:
    """(shift, width) of ``count`` near equal parts of ``width`` bits."""
    edges = [width * i // count for i in range(count + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:], strict=False)]


def _gathered(fp: F.Column, places: list[tuple[int, int]]) -> F.Column:
    """The bits at ``places`` (shift, width) side by side."""
    out = F.lit(0).cast("long")
    for shift, width in places:
        out = F.shiftleft(out, width).bitwiseOR(F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1)))
    return out


def _keyed(nodes: DataFrame, places: list[tuple[int, int]], radius: int, *keys: str) -> DataFrame:
    """A row for each pair of ``radius + 2`` groups of bit places, with its bucket."""
    count = radius + 2
    groups = [places[i::count] for i in range(count)]
    options = [F.struct(F.lit(n).alias("part"), _gathered(F.col("fp"), [*groups[i], *groups[j]]).alias("bits")) for n, (i, j) in enumerate(combinations(range(count), 2))]
    rows = nodes.withColumn("o", F.explode(F.array(*options)))
    return rows.select(*keys, F.col("o.part").alias("part"), F.xxhash64(*keys, "o.part", "o.bits").alias("bucket"), "fp")


def links(nodes: DataFrame, radius: int = 2, large: int = LARGE) -> DataFrame:
    """Links (u, v) of distinct fingerprints ``fp`` that join each near group."""
    parts = _parts(BITS, 4 * (radius + 2))
    keyed = _keyed(nodes.select("fp"), parts, radius)
    sizes = keyed.groupBy(F.col("bucket").alias("b")).agg(F.count("*").alias("n")).where("n > 1")
    rows = stored(keyed.join(sizes, F.col("bucket") == F.col("b")).select("part", "bucket", "fp", "n"), "buckets")
    small = _compared(rows.where(F.col("n") <= large), radius)
    # A large bucket's nodes differ only in the other parts, so these are split again.
    again = None
    for n, (i, j) in enumerate(combinations(range(radius + 2), 2)):
        left = [p for k in range(radius + 2) if k not in (i, j) for p in parts[k :: radius + 2]]
        part = _keyed(rows.where((F.col("n") > large) & (F.col("part") == n)).select(F.col("bucket").alias("outer"), "fp"), left, radius, "outer")
        again = part if again is None else again.unionByName(part)
    return small.unionByName(_compared(again, radius)).distinct()


def near_duplicates(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id of every document."""
    marked = stored(fingerprints(docs, shingle), "fingerprints")
    return _components(marked, radius).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _components(marked: DataFrame, radius: int) -> DataFrame:
    return marked.join(_named(marked, radius), "fp")


def _named(marked: DataFrame, radius: int) -> DataFrame:
    """fp, component_id for every distinct fingerprint."""
    nodes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "nodes")
    root = roots(links(nodes, radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    rooted = nodes.join(root, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    return stored(rooted.join(least, "root").select("fp", "root", "component_id"), "components")


def deduplicated(docs: DataFrame, radius: int = 2, shingle: int = 3) -> DataFrame:
    """The document with the smallest doc_id of each near group, whole rows.

    Of a group's rows that repeat this doc_id the one with the least text hash stays;
    rows of one doc_id in several groups are judged apart. A group in which no document
    has a doc_id keeps one of its rows.
    """
    digest = F.xxhash64("text")
    marked = stored(fingerprints(docs.select("doc_id", "text", digest.alias("_digest")), shingle, ("_digest",)), "fingerprints")
    named = _named(marked, radius)
    own = marked.join(named, "fp").where("doc_id = component_id")
    ids = own.groupBy("root").agg(F.min("doc_id").alias("_kept"), F.min("_digest").alias("_least"))
    kept = docs.join(ids, (docs["doc_id"].cast("long") == ids["_kept"]) & (F.xxhash64(docs["text"]) == ids["_least"]), "left_semi")
    nameless = docs.where("doc_id is null").select("doc_id", "text", F.struct(*docs.columns).alias("_row"))
    groups = named.where("component_id is null").select("fp", "root")
    lone = fingerprints(nameless, shingle, ("_row",)).join(groups, "fp").groupBy("root").agg(F.min_by("_row", "fp").alias("_row"))
    first = Window.partitionBy("doc_id", digest).orderBy("text")
    at = "_place" + "_" * sum(c.startswith("_place") for c in docs.columns)
    single = kept.withColumn(at, F.row_number().over(first)).where(F.col(at) == 1).drop(at)
    return single.unionByName(lone.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns)))

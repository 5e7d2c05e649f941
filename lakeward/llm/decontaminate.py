"""Benchmark decontamination by word n-grams.

Every 13-word window of the benchmark items (a shorter item is one window) becomes a
fingerprint. The index holds them as a sorted array beside the items' words, and is
broadcast when a bound of its bytes, taken before it is built, is under
``max_index_bytes``; each task then slides the same windows over whole documents and
verifies a fingerprint hit word by word. Beyond that size the windows are joined
instead: all windows of the documents are shuffled by their words.

Nulls and ties: a null text has no words; an item with a null text or without words
has no window; items with equal windows all count; a null item_id counts as "". Rows
are judged one by one, so repeated rows each give a row. Empty tables give no
contaminated document. A very long text is worked on in pieces of ``PIECE`` words, as
arrays. Other columns of either table are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.llm import rolling
from lakeward.llm.words import folded, rows_of

WINDOW = 13
#: Bytes of the index up to which it is broadcast, in the driver and in each worker.
MAX_INDEX_BYTES = 100_000_000
#: Words of a document that are looked up together.
PIECE = 1_000_000

_PATTERN = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_REPORT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def _places(plain: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Where the words of a folded text start and end."""
    return rolling.runs(np.frombuffer(plain, np.uint8) != 0x20)


class NgramIndex:
    """Item windows by length and fingerprint, over the items' words side by side."""

    def __init__(self, items: list[tuple[str, bytes]], width: int) -> None:
        self.items = sorted({item for item, _ in items})
        place = {item: i for i, item in enumerate(self.items)}
        texts, at = [], 0
        words: list[np.ndarray] = []
        rows: dict[int, list[np.ndarray]] = {}
        for item, text in items:
            plain = b" ".join(folded(text).split())
            if not plain:
                continue
            starts, ends = _places(plain)
            size = min(width, len(starts))
            symbols = rolling.word_hashes(plain)
            words.append(symbols)
            n = len(starts) - size + 1
            columns = (rolling.windows(symbols, size), at + starts[:n], at + ends[size - 1 :], np.full(n, place[item]))
            rows.setdefault(size, []).append(np.stack([c.astype(np.uint64) for c in columns]))
            texts.append(plain)
            at += len(plain) + 1
        self.text = b" ".join(texts)
        self.words = np.unique(np.concatenate(words)) if words else np.empty(0, np.uint64)
        self.grams = {size: self._grams(np.concatenate(parts, axis=1)) for size, parts in rows.items()}

    def _grams(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each different window its fingerprint, start and end in ``text``; and where
        its items start in the last array. Equal fingerprints of other words stay apart."""
        order = np.lexsort((rows[3], rows[0]))
        prints, starts, ends, owners = (c[order] for c in rows)
        fresh = np.concatenate([[True], prints[1:] != prints[:-1]])
        for i in np.flatnonzero(~fresh).tolist():
            fresh[i] = self.text[int(starts[i]) : int(ends[i])] != self.text[int(starts[i - 1]) : int(ends[i - 1])]
        at = np.flatnonzero(fresh)
        return prints[at], starts[at].astype(np.int64), ends[at].astype(np.int32 if len(self.text) < 1 << 31 else np.int64), np.append(at, len(prints)).astype(np.int32), owners.astype(np.int32)

    def nbytes(self) -> int:
        return len(self.text) + self.words.nbytes + sum(a.nbytes for g in self.grams.values() for a in g) + sum(60 + len(i) for i in self.items)

    def scan(self, plain: bytes) -> tuple[np.ndarray, set[str]]:
        """Which words of a folded text an occurring window covers, and its items."""
        symbols = rolling.word_hashes(plain)
        hit = np.zeros(len(symbols), bool)
        owners: set[int] = set()
        places: tuple[np.ndarray, np.ndarray] | None = None
        for base in range(0, len(symbols) if len(self.words) else 0, PIECE):
            for size, (prints, starts, ends, first, items) in self.grams.items():
                part = symbols[base : base + PIECE + size - 1]
                if len(part) < size:
                    continue
                unknown = np.concatenate([[0], np.cumsum(~_among(self.words, part)[0])])
                possible = np.flatnonzero(unknown[size:] == unknown[:-size])
                if not len(possible):
                    continue
                there, at = _among(prints, rolling.windows(part, size)[possible])
                for start, gram in zip((base + possible[there]).tolist(), at[there].tolist(), strict=True):
                    places = places or _places(plain)
                    words = b" ".join(plain[places[0][start] : places[1][start + size - 1]].split())
                    value = prints[gram]
                    while gram < len(prints) and prints[gram] == value:
                        if self.text[starts[gram] : ends[gram]] == words:
                            hit[start : start + size] = True
                            owners.update(items[first[gram] : first[gram + 1]].tolist())
                        gram += 1
        return hit, {self.items[i] for i in owners}


def _among(held: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of ``wanted`` are in the sorted ``held``, and their first places there."""
    at = np.searchsorted(held, wanted)
    return held[np.minimum(at, len(held) - 1)] == wanted, at


def _report(n_words: int, n_hit: int, items: set[str]) -> tuple:
    digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
    return n_words, n_hit, len(items), digest, n_hit > 0 and 20 * n_hit >= n_words


def _benchmark(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), F.col("text").cast("binary").alias("text")).where("text is not null")


def _index(spark: SparkSession, benchmark: DataFrame, width: int, max_bytes: int) -> NgramIndex | None:
    """The index, or None where it may be larger than is broadcast."""
    items = _benchmark(benchmark)
    # Each word is one window at most: a fingerprint, a start and an end, a place in and
    # an entry of the items, and an entry of the words.
    words = F.regexp_count(F.col("text").cast("string"), F.lit(_PATTERN))
    size = items.agg(F.sum(F.length("text") + 40 * words + F.length("item") + 64)).first()[0] or 0
    return None if size > max_bytes else NgramIndex([(r.item, bytes(r.text)) for r in items.collect()], width)


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WINDOW, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """One row per document: words, hit words, matching items and the verdict."""
    spark = docs.sparkSession
    index = _index(spark, benchmark, width, max_index_bytes)
    if index is None:
        return _joined(docs, benchmark, width)
    held = spark.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            out = []
            for text in texts:
                hit, items = held.value.scan(folded(text))
                out.append(_report(len(hit), int(hit.sum()), items))
            n, hits, n_items, sha, bad = zip(*out, strict=True) if out else ([],) * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(hits, pa.int64()), pa.array(n_items, pa.int64()), pa.array(sha, pa.string()), pa.array(bad, pa.bool_())],
                ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scan, _REPORT)


def clean(docs: DataFrame, benchmark: DataFrame, mode: str = "document", width: int = WINDOW, max_index_bytes: int = MAX_INDEX_BYTES) -> DataFrame:
    """``docs`` without contaminated documents (``mode="document"``), or with the hit
    words of contaminated documents cut out of their texts (``mode="span"``)."""
    spark = docs.sparkSession
    index = _index(spark, benchmark, width, max_index_bytes)
    if index is None:
        return _joined_clean(docs, benchmark, width, mode)
    held = spark.sparkContext.broadcast(index)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            keep, new = [], []
            for text in texts:
                hit, items = held.value.scan(folded(text))
                bad = _report(len(hit), int(hit.sum()), items)[-1]
                keep.append(mode == "span" or not bad)
                new.append(_without(text, hit) if bad and mode == "span" else text)
            if mode == "span":
                at = batch.schema.get_field_index("text")
                batch = batch.set_column(at, "text", pa.array(new, pa.binary()).cast(pa.string()))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(scan, docs.schema)


def _without(text: bytes, hit: np.ndarray) -> bytes:
    """``text`` without the stretches from a run's first hit word to its last."""
    starts, ends = _places(folded(text))  # folding keeps every byte's place
    out, done = [], 0
    for first, last in zip(*rolling.runs(hit), strict=True):
        out.append(text[done : starts[first]])
        done = ends[last - 1]
    return b"".join([*out, text[done:]])


def _joined_clean(docs: DataFrame, benchmark: DataFrame, width: int, mode: str) -> DataFrame:
    """``clean`` where the benchmark is too large to broadcast: rows are joined by
    doc_id and words, which repeated rows share, to the words that are hit."""
    own = "_" * (1 + max(map(len, docs.columns)))  # no column has so long a name
    words, _, hits = _hits(docs, benchmark, width)
    n_hit = F.count("*").alias(f"{own}n")
    bad = hits.select("row", "doc_id", "at").distinct().groupBy(F.col("row").alias(f"{own}row"), F.col("doc_id").alias(f"{own}doc")).agg(F.sort_array(F.collect_list("at")).alias(f"{own}at"), n_hit)
    joined = docs.withColumn(f"{own}w", words).withColumn(f"{own}key", F.xxhash64(F.col("doc_id").cast("long"), f"{own}w"))
    joined = joined.join(bad, (F.col(f"{own}key") == F.col(f"{own}row")) & F.col("doc_id").cast("long").eqNullSafe(F.col(f"{own}doc")), "left")
    over = F.coalesce(20 * F.col(f"{own}n") >= F.size(f"{own}w"), F.lit(False))
    if mode == "document":
        return joined.where(~over).select(*docs.columns)

    columns, place = docs.columns, f"{own}at"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in rows_of(batches):
            new = []
            for text, at in zip(texts, batch.column(place).to_pylist(), strict=True):
                hit = np.zeros(1 + max(at or [0]), bool)
                hit[at or []] = True
                new.append(_without(text, hit) if at else text)
            column = batch.schema.get_field_index("text")
            yield batch.set_column(column, "text", pa.array(new, pa.binary()).cast(pa.string())).select(columns)

    marked = joined.withColumn(f"{own}at", F.when(over, F.col(f"{own}at"))).select(*docs.columns, f"{own}at")
    return marked.mapInArrow(cut, docs.schema)


def _hits(docs: DataFrame, benchmark: DataFrame, width: int) -> tuple[F.Column, DataFrame, DataFrame]:
    """A document's words as a column of ``text``; doc_id, row and words of the
    documents; row, doc_id, item and place (at) of every hit word.

    Word positions that hold an item's window are found by a join on the window's
    words; the join is split by Spark where one window is common.
    """
    low = F.translate(F.coalesce(F.col("text").cast("string"), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = F.regexp_extract_all(low, F.lit(_PATTERN), F.lit(0))
    keyed = docs.select(F.col("doc_id").cast("long"), words.alias("w")).withColumn("row", F.xxhash64("doc_id", "w"))
    items = _benchmark(benchmark).select("item", words.alias("w")).where(F.size("w") > 0)

    def grams(df: DataFrame, size: F.Column, *keep: str) -> DataFrame:
        starts = F.sequence(F.lit(0), F.size("w") - size)
        return df.where(F.size("w") >= size).select(*keep, size.alias("size"), F.posexplode(F.transform(starts, lambda i: F.array_join(F.slice("w", i + 1, size), " "))).alias("start", "gram"))

    wanted = grams(items, F.least(F.size("w"), F.lit(width)), "item").select("item", "size", "gram").distinct()
    found = None
    for (size,) in wanted.select("size").distinct().collect():  # at most ``width`` rows
        part = grams(keyed, F.lit(size), "row", "doc_id").join(wanted.where(F.col("size") == size).drop("size"), "gram")
        found = part if found is None else found.unionByName(part)
    if found is None:
        hits = keyed.select("row", "doc_id", F.lit("").alias("item"), F.lit(0).alias("at")).limit(0)
    else:
        hits = found.select("row", "doc_id", "item", F.explode(F.sequence("start", F.col("start") + F.col("size") - 1)).alias("at"))
    return words, keyed, hits


def _joined(docs: DataFrame, benchmark: DataFrame, width: int) -> DataFrame:
    """The same report where the benchmark is too large to broadcast."""
    _, keyed, hits = _hits(docs, benchmark, width)
    found = hits.groupBy(F.col("row").alias("hit_row"), F.col("doc_id").alias("hit_doc")).agg(F.sort_array(F.collect_set("item")).alias("items"), F.count_distinct("at").alias("n_hit"))
    joined = keyed.select("doc_id", "row", F.size("w").cast("long").alias("n_words"))
    joined = joined.join(found, (F.col("row") == F.col("hit_row")) & F.col("doc_id").eqNullSafe(F.col("hit_doc")), "left")
    hit, items = F.coalesce("n_hit", F.lit(0)), F.coalesce("items", F.array().cast("array<string>"))
    return joined.select(
        "doc_id", "n_words", hit.cast("long").alias("n_hit"), F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"),
    )

"""Sharding by sampled splitters, with DataFrame functions only.

Records are ordered by the digest of their text, so equal texts stand together. A
size-weighted sample of that key gives quantile boundaries, records are range
partitioned by them, and ranges that turn out overfull are sampled again and
subdivided. Exact byte totals of the ranges then place every record on the line of
all bytes, which is cut into shards of near equal bytes (law ``bytes``).

A group of equal texts stays in one shard unless it is larger than
``1 / OVERFULL`` of a shard's share; such a group is divided by document id first, which
is the law's one exception: rows that repeat both text and doc_id stay together.
The result does not depend on the sample, which only decides how the work is dealt.

Nulls and ties: a null text has size 1 and a null crc32, and null texts are one
group; a null doc_id is ordered first. Rows that agree in text and doc_id are
interchangeable: each gets a slot of its own. An empty table gives no rows. A very long
text is a group of its own size and may fill a shard. Columns that are not kept may have
any name.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.llm.shared import stored

SHARDS = 16
#: A group of equal texts above this part of a shard's share is divided.
OVERFULL = 64
#: Ranges at least and at most, and the rows that ask for one more.
RANGES, MOST_RANGES, RANGE_ROWS = 256, 4096, 1_000_000
SAMPLE_PER_RANGE = 32
ROUNDS = 3


def _unit_interval(*keys: Column) -> Column:
    """A number in [0, 1) that depends on the keys alone."""
    return F.pmod(F.xxhash64(*keys), F.lit(1 << 40)).cast("double") / float(1 << 40)


def _boundaries(rows: DataFrame, total: int, ranges: int) -> list[str]:
    """Quantiles of a size-weighted sample: at most ``ranges - 1`` keys."""
    want = ranges * SAMPLE_PER_RANGE
    drawn = rows.where(_unit_interval(F.col("unit"), F.col("doc_id")) < F.col("size") * (want / max(1, total)))
    order = Window.partitionBy(F.lit(1)).orderBy("unit", "doc_id")
    at = drawn.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1)))).withColumn("i", F.row_number().over(order))
    cut = F.floor(F.col("i") * ranges / F.col("n")) > F.floor((F.col("i") - 1) * ranges / F.col("n"))
    return sorted({r[0] for r in at.where(cut & (F.col("i") < F.col("n"))).select("unit").distinct().collect()})


def range_of(key: Column, boundaries: list[str], step: int | None = None) -> Column:
    """How many boundaries are below ``key``: first among every ``step``-th, then
    among the ``step`` from there on."""
    step = step or max(16, math.isqrt(len(boundaries)))

    def below(cuts: Column) -> Column:
        return F.size(F.filter(cuts, lambda b: b < key))

    if not boundaries:
        return F.lit(0)
    every, coarse = F.lit(boundaries), F.lit(boundaries[step - 1 :: step] or boundaries[-1:])
    at = below(coarse) * step
    return at + below(F.slice(every, at + 1, F.lit(step)))


def sampled_splitters(rows: DataFrame, total: int, ranges: int = RANGES, rounds: int = ROUNDS) -> list[str]:
    """Boundaries of ``unit`` under which no range holds over four times its share,
    as far as ``rounds`` of subdividing can reach."""
    cuts = _boundaries(rows, total, ranges)
    for _ in range(rounds):
        placed = rows.withColumn("range", range_of(F.col("unit"), cuts))
        full = placed.groupBy("range").agg(F.sum("size").alias("bytes"), F.count_distinct("unit").alias("units"))
        over = full.where((F.col("bytes") * ranges > 4 * total) & (F.col("units") > 1)).collect()  # at most ranges / 4
        more = set(cuts)
        for r in over:
            inside = placed.where(F.col("range") == r["range"])
            more |= set(_boundaries(inside, r["bytes"], 1 + r["bytes"] * ranges // max(1, total)))
        if len(more) == len(cuts):
            break
        cuts = sorted(more)
    return cuts


def shard(docs: DataFrame, shards: int = SHARDS, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard and columns ``keep``."""
    text = F.col("text")
    slim = docs.select(
        F.col("doc_id").cast("long"), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.coalesce(F.md5(text.cast("binary")), F.lit("")).alias("key"), *keep,
    )
    slim = stored(slim, "shard-rows")
    total, n = slim.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    limit = max(1, total // (shards * OVERFULL))
    # Groups above the limit are fewer than shards * OVERFULL + 1: a bounded broadcast.
    large = slim.groupBy("key").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > limit)
    large = large.select("key", F.ceil(F.col("bytes") / limit).alias("pieces"))
    digits = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 8), 16, 10).cast("long")
    rows = slim.join(F.broadcast(large), "key", "left")
    piece = F.coalesce(F.pmod(digits, F.col("pieces")), F.lit(0))
    rows = rows.withColumn("unit", F.concat("key", F.lpad(piece.cast("string"), 10, "0"))).drop("pieces", "key")
    cuts = sampled_splitters(rows, total, min(MOST_RANGES, max(RANGES, n // RANGE_ROWS)))
    rows = rows.withColumn("range", range_of(F.col("unit"), cuts))

    sums = rows.groupBy("range").agg(F.sum("size").alias("bytes"))
    ahead = Window.partitionBy(F.lit(1)).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("range", F.coalesce(F.sum("bytes").over(ahead), F.lit(0)).alias("start"))
    line = Window.partitionBy("range").orderBy("unit", "doc_id", "size")
    unit = Window.partitionBy("range", "unit")
    ended = F.sum("size").over(line.rowsBetween(Window.unboundedPreceding, 0))
    placed = rows.withColumn("ended", ended).withColumn("bytes", F.sum("size").over(unit)).withColumn("last", F.max("ended").over(unit))
    placed = placed.join(F.broadcast(starts), "range")
    # The shard of a unit is the one its middle byte is in.
    middle = 2 * (F.col("start") + F.col("last")) - F.col("bytes")
    placed = placed.withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle * shards / (2 * max(1, total)))).cast("int"))
    counts = placed.groupBy("range", "shard").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("shard").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("range", "shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("first"))
    inside = Window.partitionBy("range", "shard").orderBy("unit", "doc_id", "size")
    slot = F.row_number().over(inside) - 1
    # Ranges are bounded in number and a range spans few shards.
    return placed.withColumn("at", slot).join(F.broadcast(counts), ["range", "shard"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("first") + F.col("at")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *keep,
    )

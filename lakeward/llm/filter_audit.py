"""Interaction of five filters: what each removes, whichever order they run in.

Built-in expressions turn each text into a mask of the filters it fails, a count by text
gives the smallest doc_id of equal texts (filter E), and the masks are counted in 32
cells for each part. Every order of the filters is then worked out from the cells alone:
no text is looked at twice, and 120 orders cost 600 small rows for each part.

A text travels as its SHA-256. Equal rows are counted before anything is joined, the
smallest doc_id of a text is joined to that doc_id's rows alone, and rows without a
doc_id are dealt out by text, so no group of copies meets in one task.

Nulls and ties: a null text is empty, a null lang is the part ``''`` (as is an empty
one). A row without a doc_id has no smaller doc_id, so it never fails E, and no labels.
Rows that repeat a doc_id count each; those that repeat its text, too, are no copies of
one another. A doc_id with several labels has a mark if one of its rows has it. An empty
table has no parts and so no rows. The words of a text are held together while they are
counted, about sixty bytes a word. Other columns may have any name.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.llm.shared import discard, stored

FILTERS = "ABCDE"
COPY = 1 << FILTERS.index("E")
#: Lots that rows without a doc_id are dealt into.
_LOTS = 1024


def text_mask(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: under 100 words, few distinct words,
    many capitals, symbols."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.octet_length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = (n < 100, distinct.cast("long") * 100 < n.cast("long") * 80, capitals.cast("long") * 100 > F.char_length(text).cast("long") * 10, text.rlike(r"[#$%&*|]"))
    return sum((f.cast("int") * (1 << bit) for bit, f in enumerate(failed)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good and toxic: the documents of each part that fail exactly the
    filters of a mask, and how many of them are labelled."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.unhex(F.sha2(text, 256)).alias("digest"), text_mask(text).alias("mask")
    )
    counted = stored(rows.groupBy("doc_id", "digest", "part", "mask").agg(F.count("*").alias("n")), "audit-rows")
    first = counted.where("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("doc_id"))
    marks = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        *(F.coalesce(F.max((F.col(c) == 1).cast("long")), F.lit(0)).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic")))
    )
    lot = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("digest"), F.lit(_LOTS))).otherwise(0).alias("lot")
    known = marks.select("doc_id", F.lit(0).cast("long").alias("lot"), "good", "toxic")
    held = counted.select("*", lot).join(known, ["doc_id", "lot"], "left")
    held = held.join(first.select("doc_id", "digest", F.lit(True).alias("first")), ["doc_id", "digest"], "left")
    copied = F.col("doc_id").isNotNull() & F.col("first").isNull()
    marked = held.select("part", (F.col("mask") + copied.cast("int") * COPY).alias("mask"), "n", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("good", "toxic")))
    out = marked.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.col("n") * F.col(c)).alias(c) for c in ("good", "toxic")))
    out = stored(out, "audit-cells")
    discard(docs.sparkSession, counted)
    return out


def orders(cells: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step of it, from at most 32 cells a
    part."""
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    every = F.array(*(F.lit("".join(p)) for p in permutations(FILTERS)))
    steps = parts.select("part", "cells", F.explode(every).alias("filter_order")).select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bit(letter: Column) -> Column:
        return sum((F.when(letter == f, 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))

    ahead = F.transform(F.sequence(F.lit(1), F.lit(len(FILTERS))), lambda i: F.when(i < F.col("step"), bit(F.substring("filter_order", i, F.lit(1)))).otherwise(0))
    steps = steps.select("*", F.substring("filter_order", F.col("step"), F.lit(1)).alias("letter"), F.aggregate(ahead, F.lit(0), lambda a, b: a + b).alias("prior"))
    steps = steps.select("*", bit(F.col("letter")).alias("bit"))

    def total(what: str, condition) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda held, c: held + F.when(condition(c["mask"]), c[what]).otherwise(0))

    own, prior = F.col("bit"), F.col("prior")
    fails, passed = (lambda m: m.bitwiseAND(own) != 0), (lambda m: m.bitwiseAND(prior) == 0)
    now = lambda m: fails(m) & passed(m)
    out = steps.select(
        "part", "filter_order", "step", "letter", total("n", lambda m: ~fails(m) & passed(m)).alias("kept"), total("n", now).alias("removed"),
        total("n", lambda m: fails(m) & ~passed(m)).alias("redundant"), total("n", lambda m: m == own).alias("unique_fails"),
        total("good", now).alias("good_lost"), total("toxic", now).alias("toxic_lost"),
    )
    shapley = F.sum("removed").over(Window.partitionBy("part", "letter"))  # 120 rows
    return out.withColumn("shapley", shapley).drop("letter")


def audited(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost,
    toxic_lost and shapley for every part of ``docs``."""
    return orders(cells(docs, labels))

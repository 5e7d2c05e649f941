"""Keyword extraction from notes, the kinds of its errors, and its scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.functions import columns as C
from lakeward.operators import relational as R

NOT_STATED = "not stated"


def extracted(text: Column, patterns: Mapping[str, str]) -> Column:
    """The label whose pattern matches first; of equals the longest match, then the
    order of the labels. Patterns are few, and the text is read once for each."""
    options = []
    for place, (label, pattern) in enumerate(patterns.items()):
        found = F.regexp_instr(text, F.lit(f"(?i){pattern}"))
        size = F.length(F.regexp_extract(text, f"(?i)({pattern})", 1))
        options.append(F.when(found > 0, F.struct(found.alias("at"), (-size).alias("size"), F.lit(place).alias("place"), F.lit(label).alias("label"))))
    best = F.array_min(F.array_compact(F.array(*options)))
    return F.coalesce(best["label"], F.lit(NOT_STATED))


def error_kind(guess: Column, truth: Column, family: Mapping[str, str]) -> Column:
    """What is wrong with a guess; the first that applies."""
    families = F.create_map(*(F.lit(x) for pair in family.items() for x in pair))
    same = families[guess] == families[truth]
    return (
        F.when(guess.isNull() | (guess == "invalid"), "invalid").when(guess == truth, "correct").when(guess == NOT_STATED, "missed")
        .when(truth == NOT_STATED, "invented").when(same, "granularity").otherwise("wrong")
    )


def scored(rows: DataFrame, groups: Sequence[str], guess: str, truth: str, kind: str) -> DataFrame:
    """groups, n, accuracy, precision and recall among stated answers, errors by kind."""
    right = F.col(kind) == "correct"
    stated, there = F.col(guess) != NOT_STATED, F.col(truth) != NOT_STATED
    return rows.groupBy(*groups).agg(
        F.count("*").alias("n"), F.avg(right.cast("int")).alias("accuracy"), C.ratio(F.count_if(right & stated), F.count_if(stated)).alias("precision"),
        C.ratio(F.count_if(right & there), F.count_if(there)).alias("recall"), F.count_if(F.col(kind) == "missed").alias("missed"), F.count_if(F.col(kind) == "invented").alias("invented"),
    )


def one_per_text(notes: DataFrame, key: str, text: str, preferred: Column) -> DataFrame:
    """One note for each text, blanks aside: a preferred one, else the smallest key."""
    keyed = notes.withColumn("_text", C.text_key(F.col(text))).withColumn("_preferred", preferred)
    return R.latest(keyed, ["_text"], [F.desc("_preferred"), F.col(key)]).drop("_text", "_preferred")


def reply_field(reply: Column, name: str) -> Column:
    """A field of the first brace span of a reply; null where it does not parse."""
    return F.get_json_object(F.regexp_extract(reply, r"(?s)\{.*\}", 0), f"$.{name}")


def spend(log: DataFrame, group: str, order: str, cost: str, cap: float) -> DataFrame:
    """``log`` with the running cost of its group and whether it stays within the cap."""

    running = F.sum(cost).over(Window.partitionBy(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    return log.withColumn("running", running).withColumn("within", F.col("running") <= cap)

"""Labels that arrive after the predictions they are for, joined as two streams.

A prediction waits for labels of its key for a bounded time. With a watermark on both
streams Spark keeps a prediction until that time has passed for sure and then gives it
away unlabelled; a label is kept as long as a prediction that it could be for may still
come. State is bounded by what arrives within the wait and both delays, whatever the
length of the streams.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def awaited(predictions: DataFrame, labels: DataFrame, key: str, at: str, label_at: str, wait: str) -> DataFrame:
    """Predictions with the columns of each label of their key that comes no sooner than
    they and at most ``wait`` later, or with nulls once none can come any more.

    Both sides have watermarks on their times. A null key has no label. Two labels of one
    prediction give two rows: ``settled`` takes the first.
    """
    named = labels.withColumnRenamed(key, "_key")
    due = F.expr(f"{label_at} >= {at} AND {label_at} <= {at} + INTERVAL {wait}")
    return predictions.join(named, (F.col(key) == F.col("_key")) & due, "leftOuter").drop("_key")


def settled(joined: DataFrame, key: str, at: str, label_at: str, label: str, *ties: str) -> DataFrame:
    """A row for each prediction (key and time, as a batch) with its first label, ties by
    ``ties`` and then by the label."""
    first = F.min(F.when(F.col(label_at).isNotNull(), F.struct(label_at, *ties, label))).alias("_first")
    rest = [F.first(c).alias(c) for c in joined.columns if c not in (key, at, label_at, label, *ties)]
    return joined.groupBy(key, at).agg(first, *rest).select("*", f"_first.{label_at}", f"_first.{label}").drop("_first")


def late(run: StreamingQuery) -> int:
    """Rows of a run that came after the watermark and were left out."""
    return sum(s["numRowsDroppedByWatermark"] for p in run.recentProgress for s in p["stateOperators"])


def held(run: StreamingQuery) -> int:
    """Rows in the run's state after its last batch."""
    return sum(s["numRowsTotal"] for s in run.lastProgress["stateOperators"])


def delayed_accuracy(settled: DataFrame, month: str, right: str, least: int = 100) -> DataFrame:
    """month, n, labelled, unlabelled, accuracy, and whether there are labels enough to
    act on; a label without a verdict counts as unlabelled."""
    labelled = F.count(right)
    return settled.groupBy(month).agg(
        F.count("*").alias("n"), labelled.alias("labelled"), (F.count("*") - labelled).alias("unlabelled"), F.avg(F.col(right).cast("int")).alias("accuracy"), (labelled >= least).alias("enough")
    )

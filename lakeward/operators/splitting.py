"""Splits and samples by hash order, so that reruns and other engines agree."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _order(key: str, seed: int):
    return F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")))


def stratified(units: DataFrame, key: str, stratum: str, shares: Sequence[tuple[str, float]], seed: int = 0) -> DataFrame:
    """``units`` with ``split``: each stratum cut at the shares in hash order.

    A stratum's place needs one running count; it is found from the ranges of the hash
    (256 for each stratum) and inside them, so that no stratum is one task.
    """
    ordered = units.withColumn("_h", _order(key, seed)).withColumn("_b", F.substring("_h", 1, 2))
    sums = ordered.groupBy(F.col(stratum).alias("_s"), F.col("_b").alias("_sb")).agg(F.count("*").alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(Window.partitionBy("_s").orderBy("_sb").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = sums.withColumn("_ahead", ahead).withColumn("_all", F.sum("_n").over(Window.partitionBy("_s")))
    placed = ordered.join(starts, F.col(stratum).eqNullSafe(F.col("_s")) & (F.col("_b") == F.col("_sb")))
    place = F.col("_ahead") + F.row_number().over(Window.partitionBy(stratum, "_b").orderBy("_h", key))
    names = [name for name, _ in shares]
    label = F.when(F.lit(False), "")
    for name, bound in zip(names[:-1], accumulate(share for _, share in shares), strict=False):
        label = label.when(place <= F.floor(F.col("_all") * bound + 0.5), name)
    return placed.withColumn("split", label.otherwise(names[-1])).drop("_h", "_b", "_s", "_sb", "_n", "_ahead", "_all")


def frozen_split(units: DataFrame, frozen: DataFrame, key: str, stratum: str, shares: Sequence[tuple[str, float]], seed: int = 0) -> DataFrame:
    """Keys with a frozen split keep it, units without a stratum are ``unlabelled``, and
    the rest is split anew."""
    kept = units.join(frozen.select(F.col(key).alias("_k"), F.col("split")), F.col(key) == F.col("_k")).drop("_k")
    rest = units.join(frozen.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
    fresh = stratified(rest.where(F.col(stratum).isNotNull()), key, stratum, shares, seed)
    return kept.unionByName(fresh).unionByName(rest.where(F.col(stratum).isNull()).withColumn("split", F.lit("unlabelled")))


def halves(df: DataFrame, group: str, seed: int = 0) -> DataFrame:
    """Whole groups in one of two halves, by a bit of the group's hash."""
    return df.withColumn("half", F.conv(F.substring(_order(group, seed), 1, 1), 16, 10).cast("int") % 2)


def fixed_subset(df: DataFrame, key: str, n: int, seed: int = 0) -> DataFrame:
    """The first ``n`` rows in hash order."""
    return df.orderBy(_order(key, seed), key).limit(n)


def sampling_weights(df: DataFrame, label: str, group: str, most: float = 10.0) -> DataFrame:
    """One over the class and group counts, at most ``most`` times their median."""
    classes = df.groupBy(F.col(label).alias("_l")).agg(F.count("*").alias("_nl"))
    groups = df.groupBy(F.col(group).alias("_g")).agg(F.count("*").alias("_ng"))
    weighed = df.join(classes, F.col(label) == F.col("_l")).join(groups, F.col(group) == F.col("_g"))
    weighed = weighed.withColumn("weight", 1.0 / (F.col("_nl").cast("double") * F.col("_ng")))
    median = weighed.agg(F.percentile("weight", F.lit(0.5)).alias("_median"))
    return weighed.join(median, F.lit(True)).withColumn("weight", F.least("weight", F.col("_median") * most)).drop("_l", "_nl", "_g", "_ng", "_median")


def at_least_per_class(df: DataFrame, key: str, label: str, least: int, n: int, seed: int = 0) -> DataFrame:
    """``least`` rows of every class, filled up to ``n`` in hash order."""
    order = _order(key, seed)
    sure = df.withColumn("_r", F.row_number().over(Window.partitionBy(label).orderBy(order, key))).where(F.col("_r") <= least).drop("_r")
    first = sure.withColumn("_sure", F.lit(0)).unionByName(df.withColumn("_sure", F.lit(1)))
    once = first.groupBy(*df.columns).agg(F.min("_sure").alias("_sure"))
    return once.orderBy("_sure", order, key).limit(n).drop("_sure")

"""Gram detector: vectors whose feature correlations leave the range of their class.

A vector is cut into blocks, each a map of ``channels`` by positions. For each power p
the features of a block are the row sums of the Gram matrix of its p-th powers, brought
back to the scale of the map by the p-th root. Each class has a least and a greatest
value of every feature. A vector's deviation is how far its features lie outside, relative to
the bound, summed over a block; blocks are divided by their mean deviation on a part that
was not fitted on, and summed.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EPS = 1e-6


def features(cells: Column, channels: int, width: int, powers: Sequence[int]) -> Column:
    """The features of a map of ``channels`` rows of ``width`` cells: a value for each
    channel at each power. The row sum of a Gram matrix needs no matrix: it is a row times
    the sum of all rows."""
    exponents = F.array(*(F.lit(float(p)) for p in powers))

    def powered(channel: Column, s: Column, p: Column) -> Column:
        return F.pow(F.get(cells, channel * width + s).cast("double"), p)

    def added(n: int, term) -> Column:
        return F.aggregate(F.sequence(F.lit(0), F.lit(n - 1)), F.lit(0.0), lambda total, k: total + term(k))

    def feature(k: Column) -> Column:
        p, own = F.get(exponents, F.floor(k / channels).cast("int")), k % channels
        g = added(width, lambda s: powered(own, s, p) * added(channels, lambda c: powered(c, s, p)))
        return F.signum(g) * F.pow(F.abs(g), 1.0 / p)

    return F.transform(F.sequence(F.lit(0), F.lit(len(powers) * channels - 1)), lambda k: feature(k))


def blocks(df: DataFrame, key: str, label: str, vector: str, size: int, channels: int, count: int, powers: Sequence[int]) -> DataFrame:
    """key, label, block, i, x: every feature of every vector. Vectors that are null or too
    short for their blocks have none."""
    whole = df.where(F.size(vector) >= size * count)
    maps = F.array(*(F.slice(vector, b * size + 1, size) for b in range(count)))
    each = whole.select(key, label, F.posexplode(maps).alias("block", "_cells"))
    return each.select(key, label, "block", F.posexplode(features(F.col("_cells"), channels, size // channels, powers)).alias("i", "x"))


def limits(fitted: DataFrame, label: str) -> DataFrame:
    """label, block, i, low, high, and under a null label those of all classes together, for
    classes that were not fitted."""
    own = fitted.where(F.col(label).isNotNull()).groupBy(label, "block", "i").agg(F.min("x").alias("low"), F.max("x").alias("high"))
    every = own.groupBy("block", "i").agg(F.min("low").alias("low"), F.max("high").alias("high")).select(F.lit(None).cast(fitted.schema[label].dataType).alias(label), "block", "i", "low", "high")
    return own.unionByName(every)


def deviations(rows: DataFrame, held: DataFrame, key: str, label: str) -> DataFrame:
    """key, block, deviation of ``rows`` (of ``blocks``) against ``held`` (of ``limits``)."""
    known = held.where(F.col(label).isNotNull()).select(F.col(label).alias("_known")).distinct()
    placed = rows.join(known, F.col(label) == F.col("_known"), "left")
    named = held.select(F.col(label).alias("_label"), F.col("block").alias("_block"), F.col("i").alias("_i"), "low", "high")
    joined = placed.join(named, F.col("_known").eqNullSafe(F.col("_label")) & (F.col("block") == F.col("_block")) & (F.col("i") == F.col("_i")))
    below = F.greatest(F.col("low") - F.col("x"), F.lit(0.0)) / (F.abs("low") + EPS)
    above = F.greatest(F.col("x") - F.col("high"), F.lit(0.0)) / (F.abs("high") + EPS)
    return joined.groupBy(key, "block").agg(F.sum(below + above).alias("deviation"))


def scored(df: DataFrame, fit: Column, hold: Column, key: str, label: str, vector: str, size: int = 16, channels: int = 4, count: int = 4, powers: Sequence[int] = tuple(range(1, 11))) -> DataFrame:
    """key and score of every vector: bounds from the rows of ``fit``, each block's divisor
    from those of ``hold``. A block that never deviates there divides by next to nothing."""
    rows = blocks(df, key, label, vector, size, channels, count, powers)
    marks = df.select(F.col(key).alias("_key"), fit.alias("_fit"), hold.alias("_hold"))
    fitted = rows.join(marks.where("_fit"), F.col(key) == F.col("_key"), "left_semi")
    each = deviations(rows, limits(fitted, label), key, label)
    divisor = each.join(marks.where("_hold"), F.col(key) == F.col("_key"), "left_semi").groupBy(F.col("block").alias("_block")).agg((F.avg("deviation") + 1e-12).alias("_norm"))
    return each.join(divisor, F.col("block") == F.col("_block")).groupBy(key).agg(F.sum(F.col("deviation") / F.col("_norm")).alias("score"))

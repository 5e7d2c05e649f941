"""Running totals, ranks and exact quantiles over the values of a group, by ranges.

The counted values are put in one order of group and value once, dealt over tasks by
ranges, and written; a group that holds most of the values is many ranges. Totals of the
ranges give each its offset, and a window runs inside a range only. The source is read
once, whatever is then made of the totals. Where the ranges are cut decides how the work
is dealt and nothing else: totals and quantiles are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.operators.tables import written


def _joined(rows: DataFrame, more: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``rows`` with ``more``, whose keys have an underscore before their names."""
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return rows.join(more, same).drop(*(f"_{k}" for k in keys))


def ordered(counted: DataFrame, groups: Sequence[str], value: str, ranges: int | None = None) -> DataFrame:
    """``counted``, of which a value stands once in a group, written in ranges of group and
    value, with ``_range``. ``ranges`` is how many there are over all groups; Spark's
    number of shuffle partitions, where it is None."""
    dealt = counted.repartitionByRange(*([ranges] if ranges else []), *groups, value)
    return written(dealt.withColumn("_range", F.spark_partition_id()))


def totals(placed: DataFrame, groups: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """``placed`` (of ``ordered``) with ``<s>_before`` and ``<s>_all`` for each of ``sums``:
    its total over the smaller values of the group, and over the whole group. Null comes
    before all other values."""
    where = [*groups, "_range"]
    each = placed.groupBy(*(F.col(k).alias(f"_{k}") for k in where)).agg(*(F.sum(s).alias(f"_sum_{s}") for s in sums))
    group = Window.partitionBy(*(f"_{k}" for k in groups))  # a row for each range
    ahead = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = each.select(
        *(f"_{k}" for k in where), *(F.coalesce(F.sum(f"_sum_{s}").over(ahead), F.lit(0)).alias(f"_ahead_{s}") for s in sums),
        *(F.sum(f"_sum_{s}").over(group).alias(f"{s}_all") for s in sums),
    )
    inside = Window.partitionBy(*where).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    out = _joined(placed, offsets, where)
    for s in sums:
        out = out.withColumn(f"{s}_before", F.coalesce(F.sum(s).over(inside), F.lit(0)) + F.col(f"_ahead_{s}"))
    return out.drop("_range", *(f"_ahead_{s}" for s in sums))


def running(counted: DataFrame, groups: Sequence[str], value: str, sums: Sequence[str], ranges: int | None = None) -> DataFrame:
    """``totals`` over the values of ``counted``, which are put in order first."""
    return totals(ordered(counted, groups, value, ranges), groups, value, sums)


def cuts(shares: Sequence[float], value: str, n: str) -> tuple[list[Column], Column]:
    """Aggregates over ranked rows, and the exact quantiles of ``value``, each taken ``n``
    times, that they make. Between two values quantiles are interpolated."""
    before, every = F.col(f"{n}_before"), F.col(f"{n}_all")

    def at(place: Column) -> Column:
        return F.max(F.when((before <= place) & (place < before + F.col(n)), F.col(value).cast("double")))

    points = [(f"_{which}{i}", at(f(F.lit(float(q)) * (every - 1)))) for i, q in enumerate(shares) for which, f in (("low", F.floor), ("high", F.ceil))]
    held = [F.max(every).alias("_size"), *(c.alias(name) for name, c in points)]
    mixed = []
    for i, q in enumerate(shares):
        place = F.lit(float(q)) * (F.col("_size") - 1)
        between = (F.ceil(place) - place) * F.col(f"_low{i}") + (place - F.floor(place)) * F.col(f"_high{i}")
        mixed.append(F.when(F.ceil(place) == F.floor(place), F.col(f"_low{i}")).otherwise(between))
    return held, F.array(*mixed)


def quantiles(rows: DataFrame, groups: Sequence[str], value: str, shares: Sequence[float], name: str, ranges: int | None = None) -> DataFrame:
    """groups and ``name``: the exact quantiles of the non-null values at ``shares``, as
    an array."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(*groups, F.col(value).alias("_value")).agg(F.count("*").alias("_n"))
    held, found = cuts(shares, "_value", "_n")
    return running(counted, groups, "_value", ["_n"], ranges).groupBy(*groups).agg(*held).select(*groups, found.alias(name))


def quantile(rows: DataFrame, groups: Sequence[str], value: str, share: float, name: str) -> DataFrame:
    return quantiles(rows, groups, value, [share], name).withColumn(name, F.element_at(name, 1))


def nearest_rank(counted: DataFrame, groups: Sequence[str], value: str, n: str, shares: Sequence[tuple[str, float]]) -> DataFrame:
    """groups, a column for each of ``shares`` and ``n``: the least value at or below which
    at least that share of the group's rows lies."""
    ranked = running(counted, groups, value, [n])
    at = lambda q: F.min(F.when(F.col(f"{n}_before") + F.col(n) >= F.ceil(F.col(f"{n}_all") * q), F.col(value)))
    return ranked.groupBy(*groups).agg(*(at(q).alias(name) for name, q in shares), F.sum(n).alias(n))

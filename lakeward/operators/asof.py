"""As-of merge: each row with the interval of its key that holds its time.

Rows and intervals are put in one order of time for each key, and the last interval that
began is carried along, so a row meets one interval and there is no product of a key's
rows and intervals. A key of more than ``LARGE`` rows and intervals is cut into ranges of
time at approximate quantiles; what is carried over their edges is worked out from one
row for each range. The cuts decide how the work is dealt and nothing else.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LARGE, RANGES = 100_000, 256


def valid_at(df: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, start: str, end: str, large: int = LARGE) -> DataFrame:
    """``df`` with the columns of the interval that holds ``time``: start <= time < end, an
    open end being null; nulls where there is none.

    The intervals of a key follow one another (``overlapping`` finds those that do not). Of
    intervals with one start the last to end counts, an open one last, and one that has
    begun hides those before it. A null key, time or start matches nothing. Rows that
    repeat are kept, each with its interval.
    """
    taken = [c for c in intervals.columns if c not in keys]
    sides = [(f, [F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]) for f in (df, intervals.where(F.col(start).isNotNull()))]
    row, held = F.struct(*(F.col(c) for c in df.columns)), F.struct(*(F.col(c) for c in taken))
    rows = sides[0][0].select(*sides[0][1], F.col(time).alias("_at"), F.lit(1).alias("_side"), row.alias("_row"))
    spans = sides[1][0].select(*sides[1][1], F.col(start).alias("_at"), F.lit(0).alias("_side"), held.alias("_held"))
    names = [f"_k{i}" for i in range(len(keys))]
    known = F.lit(True)
    for k in names:
        known = known & F.col(k).isNotNull()
    matched = known & F.col("_at").isNotNull()
    both = rows.where(matched).unionByName(spans.where(matched), allowMissingColumns=True)

    cuts = F.percentile_approx("_at", F.array(*(F.lit(i / RANGES) for i in range(1, RANGES))), F.lit(10 * RANGES))
    sizes = both.groupBy(*(F.col(k).alias(f"_of{k}") for k in names)).agg(F.count("*").alias("_n"), F.array_distinct(cuts).alias("_cuts")).where(F.col("_n") > large)
    both = both.join(sizes, [F.col(k) == F.col(f"_of{k}") for k in names], "left")
    both = both.withColumn("_range", F.coalesce(F.size(F.filter("_cuts", lambda c: c <= F.col("_at"))), F.lit(0))).drop("_n", "_cuts", *(f"_of{k}" for k in names))

    last = F.struct(F.col(f"_held.{end}").isNull(), F.col(f"_held.{end}"))
    order = [F.col("_at"), F.col("_side"), last]
    inside = Window.partitionBy(*names, "_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    ranged = both.withColumn("_in", F.last("_held", ignorenulls=True).over(inside))
    newest = F.max_by("_held", F.struct("_at", last.alias("_last"))).alias("_newest")
    edges = both.where("_side = 0").groupBy(*names, "_range").agg(newest)
    # A row for each range that has an interval; a range looks for the nearest one before it.
    ends = both.groupBy(*names, "_range").agg(F.count("*").alias("_n")).join(edges, [*names, "_range"], "left")
    ahead = Window.partitionBy(*names).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.withColumn("_before", F.last("_newest", ignorenulls=True).over(ahead)).where("_range > 0").select(*names, "_range", "_before")
    found = ranged.where("_side = 1").join(carried, [*names, "_range"], "left").withColumn("_held", F.coalesce("_in", "_before"))
    valid = F.col(f"_held.{end}").isNull() | (F.col("_at") < F.col(f"_held.{end}"))
    found = found.withColumn("_held", F.when(valid, F.col("_held"))).select("_row", "_held")
    rest = rows.where(~F.coalesce(matched, F.lit(False))).select("_row").withColumn("_held", F.lit(None).cast(found.schema["_held"].dataType))
    return found.unionByName(rest).select("_row.*", *(F.col(f"_held.{c}").alias(c) for c in taken))


def overlapping(intervals: DataFrame, keys: Sequence[str], start: str, end: str) -> DataFrame:
    """Intervals that begin before the one ahead of them in their key has ended."""
    order = Window.partitionBy(*keys).orderBy(start, F.col(end).asc_nulls_last())
    before = F.lag(F.struct(F.col(end).alias("end"))).over(order)
    marked = intervals.withColumn("_ahead", before)
    return marked.where(F.col("_ahead").isNotNull() & (F.col("_ahead.end").isNull() | (F.col(start) < F.col("_ahead.end")))).drop("_ahead")

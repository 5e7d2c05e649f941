"""Monthly monitoring: class mix, confidence, targets, alerts, retraining, schedules."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.functions import columns as C
from lakeward.operators import relational as R
from lakeward.operators import statistics as S
from lakeward.operators.ranks import quantile

LEAST = 100


def class_mix(rows: DataFrame, groups: Sequence[str], guess: str, baseline: str, least_expected: float = 5.0) -> DataFrame:
    """groups, cells, statistic, tvd, unseen of the guessed classes against a baseline.

    Classes expected fewer than ``least_expected`` times are pooled. ``unseen`` is true
    where a class was guessed that the baseline never had.
    """
    labels = rows.select(F.col(guess).alias("_class")).distinct()
    now = rows.where(~F.col(baseline))
    grid = now.select(*groups).distinct().join(labels, F.lit(True))
    base = rows.where(baseline).groupBy(F.col(guess).alias("_class")).agg(F.count("*").alias("b"))
    seen = now.groupBy(*groups, F.col(guess).alias("_class")).agg(F.count("*").alias("o"))
    cells = grid.join(base, "_class", "left").join(seen, [*groups, "_class"], "left").na.fill(0, ["b", "o"])
    every = Window.partitionBy(*groups)
    cells = cells.withColumn("e", F.col("b") * F.sum("o").over(every) / F.sum("b").over(every))
    gap = F.sum(F.abs(C.ratio(F.col("o"), F.col("n_o")) - C.ratio(F.col("b"), F.col("n_b")))) / 2
    totals = cells.withColumns({"n_o": F.sum("o").over(every), "n_b": F.sum("b").over(every)})
    first = totals.groupBy(*groups).agg(gap.alias("tvd"), F.max((F.col("b") == 0) & (F.col("o") > 0)).alias("unseen"))
    pooled = cells.withColumn("_cell", F.when(F.col("e") < least_expected, F.lit("\x00pool")).otherwise(F.col("_class").cast("string")))
    pooled = pooled.groupBy(*groups, "_cell").agg(F.sum("o").alias("o"), F.sum("e").alias("e"))
    # A pool that is still small joins the smallest other cell.
    small = F.max(F.when((F.col("_cell") == "\x00pool") & (F.col("e") < least_expected), True).otherwise(False)).over(every)
    place = F.row_number().over(every.orderBy(F.col("_cell") == "\x00pool", "e", "_cell"))
    pooled = pooled.withColumns({"_small": small, "_place": place})
    merged = pooled.withColumn("_to", F.when(F.col("_small") & ((F.col("_cell") == "\x00pool") | (F.col("_place") == 1)), "\x00pool").otherwise(F.col("_cell")))
    merged = merged.groupBy(*groups, "_to").agg(F.sum("o").alias("o"), F.sum("e").alias("e"))
    statistic = F.sum((F.col("o") - F.col("e")) * C.ratio(F.col("o") - F.col("e"), F.col("e")))
    return merged.groupBy(*groups).agg(F.count("*").alias("cells"), statistic.alias("statistic")).join(first, list(groups))


def chi_square_tail(statistic: Column, freedom: Column, most: int = 40) -> Column:
    """The upper tail of the chi-square distribution for whole degrees of freedom.

    Closed sums: even degrees from exp(-x/2), odd ones from the normal tail.
    """
    half = F.greatest(statistic, F.lit(0.0)) / 2
    even, term = F.lit(0.0), F.exp(-half)
    root = F.sqrt(F.greatest(statistic, F.lit(0.0)))
    odd = 2 * normal_tail(root)
    odd_term = root * F.exp(-half) * math.sqrt(2 / math.pi)
    for k in range(most // 2):
        even = even + F.when(freedom > 2 * k, term).otherwise(0.0)
        term = term * half / (k + 1)
        if k:
            odd = odd + F.when(freedom > 2 * k, odd_term).otherwise(0.0)
            odd_term = odd_term * F.greatest(statistic, F.lit(0.0)) / (2 * k + 1)
    return F.when(freedom % 2 == 0, even).otherwise(odd)


def normal_tail(z: Column) -> Column:
    """The upper tail of the standard normal for z >= 0, to about 1e-7 (Abramowitz and
    Stegun, formula 26.2.17)."""
    t = 1 / (1 + 0.2316419 * z)
    poly = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    return F.exp(-z * z / 2) / math.sqrt(2 * math.pi) * poly


def mix_alert(mix: DataFrame, n: str, alert_p: float = 0.01, alert_tvd: float = 0.1) -> DataFrame:
    """``mix`` with p and alert; an unseen class, or a single cell, leaves the distance
    alone to decide, and under LEAST rows nothing alerts."""
    p = chi_square_tail(F.col("statistic"), F.col("cells") - 1)
    by_distance = F.col("unseen") | (F.col("cells") < 2)
    alert = (F.col(n) >= LEAST) & (F.col("tvd") >= alert_tvd) & (by_distance | (p < alert_p))
    return mix.withColumns({"p": F.when(~by_distance, p), "alert": alert})


def confidence_shift(rows: DataFrame, groups: Sequence[str], value: str, baseline: str, shift: float = 0.05, alert_p: float = 0.01) -> DataFrame:
    """groups, ks, median_change, alert."""
    ks = S.ecdf_distance(rows, groups, value, baseline)
    medians = quantile(rows, [*groups, baseline], value, 0.5, "median")
    median = lambda which: F.max(F.when(which, F.col("median")))
    change = medians.groupBy(*groups).agg((median(~F.col(baseline)) - median(F.col(baseline))).alias("median_change"))
    p = S.ks_p_value(F.col("ks"), F.col("n_base"), F.col("n_now"))
    return ks.join(change, list(groups)).withColumn("alert", (F.col("n_now") >= LEAST) & (p < alert_p) & (F.abs("median_change") >= shift))


def month_status(listed: Column, failed: Column) -> Column:
    return F.when(failed > 0, "failed").when(listed == 0, "no_new_data").otherwise("scored")


def target_status(months: DataFrame, groups: Sequence[str], month: str, hits: str, positives: str, target: float, least: int = LEAST) -> DataFrame:
    """groups, months, positives, hits, share, low, high, status over the trailing
    window: met, broken, or insufficient where it holds fewer than ``least``."""
    window = R.trailing_window(months, groups, month, positives, hits, least)
    summed = window.groupBy(*groups).agg(F.count("*").alias("months"), F.sum(positives).alias("positives"), F.sum(hits).alias("hits"))
    every = months.select(*groups).distinct().join(summed, list(groups), "left").na.fill(0, ["months", "positives", "hits"])
    enough = F.col("positives") >= least
    share = C.ratio(F.col("hits"), F.col("positives"))
    low, high = C.wilson(F.col("hits"), F.nullif(F.col("positives"), F.lit(0)))
    status = F.when(~enough, "insufficient").when(share >= target, "met").otherwise("broken")
    return every.withColumns({"share": share, "low": low, "high": high, "status": status})


def reasons(**conditions: Column) -> Column:
    """The names of the conditions that hold, in order, as one text."""
    return F.array_join(F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in conditions.items()))), ",")


def retrain_months(months: DataFrame, least: int = LEAST) -> DataFrame:
    """Months in alert whose delayed labels, reported by a later row, are enough.

    ``months``: month, alert, labelled_month, labelled.
    """
    ready = months.where(F.col("labelled") >= least).select(F.col("labelled_month").alias("month")).distinct()
    return months.where("alert").select("month").join(ready, "month", "left_semi")


def promoted(gain: Column, low: Column, change: Column, least_gain: float = 0.02, most_fall: float = 0.01) -> Column:
    return (gain >= least_gain) & (low > 0) & (change >= -most_fall)


def version_kept(pooled: Column, worst: Column, gain: float = 1.0, fall: float = 3.0) -> Column:
    """Both limits are inclusive, with 1e-9 to spare."""
    return (pooled >= gain - 1e-9) & (worst >= -fall - 1e-9)


def merged_changes(changes: DataFrame) -> DataFrame:
    """key, value, conflict of single configuration changes (key, value)."""
    sets = changes.groupBy("key").agg(F.collect_set("value").alias("s"))
    return sets.select("key", F.when(F.size("s") == 1, F.element_at("s", 1)).alias("value"), (F.size("s") > 1).alias("conflict"))


def missed_schedule(runs: DataFrame, months: DataFrame, time: str, hour: int = 6) -> DataFrame:
    """month, runs, missed: runs from the month's first day at ``hour`` to the next's."""
    shifted = F.date_format(F.col(time) - F.expr(f"INTERVAL {hour} HOURS"), "yyyy-MM-01")
    counts = runs.groupBy(shifted.alias("month")).agg(F.count("*").alias("runs"))
    return months.join(counts, "month", "left").na.fill(0, ["runs"]).withColumn("missed", F.col("runs") == 0)


def contract(text: Column, least: int, most: int, symbol_share: float = 0.3) -> tuple[Column, Column]:
    """Reasons to quarantine a text, and flags that are only reported.

    An unreadable text has that one reason; others add up.
    """
    size = F.length(text)
    letters = F.length(F.regexp_replace(text, "[^A-Za-z]", ""))
    blank = text.isNull() | (F.trim(text) == "")
    enforced = reasons(short=size < least, long=size > most)
    flags = reasons(few_letters=letters < size * (1 - symbol_share), no_sentence=~F.contains(text, F.lit(".")))
    return F.when(blank, "unreadable").otherwise(enforced), F.when(blank, "").otherwise(flags)

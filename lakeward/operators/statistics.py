"""Two-sample tests, ranks, calibration and confusion, as grouped plans.

Values are counted first and totals run over the ranges of ``ranks``, so no group is
one task, whatever its size. An empty group gives null, never an error.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeward.functions import columns as C
from lakeward.operators.ranks import cuts, ordered, quantile, quantiles, running, totals
from lakeward.operators.tables import written

EPS = 1e-6


def _counted(rows: DataFrame, groups: Sequence[str], value: str, baseline: str) -> DataFrame:
    """groups, value, b, c, q: rows of the baseline and of the other sample with a value,
    and of the baseline those whose value is not null."""
    counts = rows.groupBy(*groups, value).agg(F.count_if(F.col(baseline)).alias("b"), F.count_if(~F.col(baseline)).alias("c"))
    return counts.withColumn("q", F.when(F.col(value).isNotNull(), F.col("b")).otherwise(0))


def _ordered(rows: DataFrame, groups: Sequence[str], value: str, baseline: str) -> DataFrame:
    return ordered(_counted(rows, groups, value, baseline), groups, value)


def _compared(placed: DataFrame, groups: Sequence[str], value: str, bins: int) -> DataFrame:
    """groups, n_base, n_now, ks, edges of ``placed``."""
    ranked = totals(placed, groups, value, ["b", "c", "q"])
    upto = lambda c: C.ratio(F.col(f"{c}_before") + F.col(c), F.col(f"{c}_all"))
    held, edges = cuts([i / bins for i in range(1, bins)], value, "q")
    sums = ranked.groupBy(*groups).agg(F.sum("b").alias("n_base"), F.sum("c").alias("n_now"), F.max(F.abs(upto("b") - upto("c"))).alias("ks"), *held)
    return sums.select(*groups, "n_base", "n_now", "ks", edges.alias("edges"))


def ecdf_distance(rows: DataFrame, groups: Sequence[str], value: str, baseline: str) -> DataFrame:
    """groups, n_base, n_now, ks: the largest gap between two empirical distributions.

    ``baseline`` is the boolean column that tells the two samples apart.
    """
    return _compared(_ordered(rows, groups, value, baseline), groups, value, 1).drop("edges")


def ks_p_value(distance: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """The asymptotic two-sided p-value of a Kolmogorov-Smirnov distance.

    Small distances, where the series does not settle, have a p-value of 1. Exact
    small-sample values differ a little; the alert rule needs the PSI as well.
    """
    size = distance * F.sqrt(n.cast("double") * m.cast("double") / (n + m).cast("double"))
    tail = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda a, j: a + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * j.cast("double") * j.cast("double") * size * size),
    )
    return F.when(size < 0.2, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), tail)))


def inside_paths(h: int, n: int, m: int) -> float:
    """The share of all orders of ``n`` and ``m`` values under which the distributions' gap,
    times ``n`` and ``m``, stays below ``h`` throughout: lattice paths from corner to corner
    inside a band. Folded a diagonal at a time; each place holds the share of the paths to
    it, so nothing grows or vanishes with the samples."""
    held = np.zeros(n + 2)  # by i + 1, on the diagonal i + j
    held[1] = 1.0
    for d in range(1, n + m + 1):
        low, high = max(0, d - m, (d * n - h) // (n + m) + 1), min(n, d, -(-(d * n + h) // (n + m)) - 1)
        row = np.zeros(n + 2)
        if low <= high:
            i = np.arange(low, high + 1)
            row[low + 1 : high + 2] = (i * held[low : high + 1] + (d - i) * held[low + 1 : high + 2]) / d
        held = row
    return float(held[n + 1])


def ks_exact(distance: float | None, n: int, m: int) -> float | None:
    """The exact two-sided p-value of a Kolmogorov-Smirnov distance between samples of
    ``n`` and ``m`` values without ties; null for an empty sample."""
    if distance is None or not n or not m:
        return None
    h = round(distance * n * m)
    n, m = sorted((int(n), int(m)))
    return 1.0 if h <= 0 else min(1.0, max(0.0, 1.0 - inside_paths(h, n, m)))


def ks_probability(rows: DataFrame, distance: str, n: str, m: str, name: str = "p", most: int = 10_000) -> DataFrame:
    """``rows`` with a p-value: exact while neither sample is larger than ``most``, by the
    series beyond. Rows are one for each comparison, and a task holds one path row."""

    def exact(d: pd.Series, n: pd.Series, m: pd.Series) -> pd.Series:
        return pd.Series([None if pd.isna(x) or max(a, b) > most else ks_exact(x, a, b) for x, a, b in zip(d, n, m, strict=True)], dtype="float64")

    found = F.pandas_udf(exact, "double")(F.col(distance), F.col(n).cast("long"), F.col(m).cast("long"))
    small = F.greatest(n, m) <= most
    return rows.withColumn(name, F.when(small, found).otherwise(ks_p_value(F.col(distance), F.col(n), F.col(m))))


def _stable(placed: DataFrame, compared: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """``compared`` with psi over the bins between its edges."""
    keys = [F.col(g).alias(f"_{g}") for g in groups]
    same = [F.col(g).eqNullSafe(F.col(f"_{g}")) for g in groups] or [F.lit(True)]
    placed = placed.join(compared.select(*keys, "edges"), same).withColumn("bin", F.size(F.filter("edges", lambda e: e <= F.col(value))))
    binned = placed.groupBy(*groups, "bin").agg(F.sum("b").alias("b"), F.sum("c").alias("c"))
    every = Window.partitionBy(*groups)  # a row for each bin
    # Bins without a row in either sample have equal shares and no term.
    old, new = (C.ratio(F.col(c), F.sum(c).over(every)) + EPS for c in ("b", "c"))
    psi = binned.withColumn("term", (new - old) * F.ln(new / old)).groupBy(*keys).agg(F.sum("term").alias("psi"))
    return compared.join(psi, same).drop("edges", *(f"_{g}" for g in groups))


def population_stability(rows: DataFrame, groups: Sequence[str], value: str, baseline: str, bins: int = 10) -> DataFrame:
    """groups, psi over ``bins`` baseline quantiles, ends open, EPS added to each share.

    Bins are closed on the left. Equal edges leave bins without a value; both shares
    are then EPS, which adds nothing.
    """
    placed = _ordered(rows, groups, value, baseline)
    return _stable(placed, _compared(placed, groups, value, bins), groups, value).select(*groups, "psi")


def drift(rows: DataFrame, groups: Sequence[str], value: str, baseline: str, least: int = 100, alert_p: float = 0.01, alert_psi: float = 0.2, warn_psi: float = 0.1) -> DataFrame:
    """KS and PSI of each group with alert and warning; groups whose new sample has
    fewer than ``least`` rows never alert."""
    placed = _ordered(rows, groups, value, baseline)
    both = _stable(placed, _compared(placed, groups, value, 10), groups, value)
    enough = F.col("n_now") >= least
    p = ks_p_value(F.col("ks"), F.col("n_base"), F.col("n_now"))
    alert = enough & (p < alert_p) & (F.col("psi") >= alert_psi)
    return both.withColumns({"p": p, "alert": alert}).withColumn("warning", enough & ~F.col("alert") & (F.col("psi") >= warn_psi))


def drift_against(rows: DataFrame, groups: Sequence[str], value: str, baseline: DataFrame, bins: int = 10, least: int = 100, alert_p: float = 0.01, alert_psi: float = 0.2) -> DataFrame:
    """groups, n_base, n_now, ks, psi, p, alert of many samples against one baseline,
    whose values are ranked once and not copied to each group. ``rows`` are read once, and
    what is counted by group and value is written for the plans that follow.

    Between two values of a sample its distribution stands still, so the largest gap is at
    a value of the sample or just before one.
    """
    counts = written(rows.groupBy(*groups, value).agg(F.count("*").alias("c")))
    known = written(baseline.groupBy(F.col(value).alias("_v")).agg(F.count("*").alias("b")))
    held = known.unionByName(counts.select(F.col(value).alias("_v"), F.lit(0).cast("long").alias("b")))
    places = running(held.groupBy("_v").agg(F.sum("b").alias("b")), [], "_v", ["b"])
    counted = running(counts, groups, value, ["c"]).join(places, F.col(value).eqNullSafe(F.col("_v")))
    gap = lambda upto: F.abs(C.ratio(upto("b"), F.col("b_all")) - C.ratio(upto("c"), F.col("c_all")))
    before, after = gap(lambda s: F.col(f"{s}_before")), gap(lambda s: F.col(f"{s}_before") + F.col(s))
    ks = written(counted.groupBy(*groups).agg(F.max("b_all").alias("n_base"), F.sum("c").alias("n_now"), F.max(F.greatest(before, after)).alias("ks")))
    edges = quantiles(baseline, [], value, [i / bins for i in range(1, bins)], "edges")
    bin_of = lambda v: F.size(F.filter("edges", lambda e: e <= F.col(v))).alias("bin")
    old = known.join(edges, F.lit(True)).groupBy(bin_of("_v")).agg(F.sum("b").alias("b"))
    old = old.crossJoin(old.agg(F.sum("b").alias("b_all")))  # one row for each bin
    new = counts.join(edges, F.lit(True)).groupBy(*groups, bin_of(value)).agg(F.sum("c").alias("c"))
    grid = ks.select(*groups, "n_now").join(old, F.lit(True)).join(new, [*groups, "bin"], "full")
    total = lambda c: F.max(c).over(Window.partitionBy(*groups))  # a row for each bin
    a, b = (C.ratio(F.coalesce(F.col(x), F.lit(0)), total(every)) + EPS for x, every in (("b", "b_all"), ("c", "n_now")))
    psi = grid.withColumn("term", (b - a) * F.ln(b / a)).groupBy(*groups).agg(F.sum("term").alias("psi"))
    both = ks.join(psi, list(groups))
    p = ks_p_value(F.col("ks"), F.col("n_base"), F.col("n_now"))
    return both.withColumn("p", p).withColumn("alert", (F.col("n_now") >= least) & (F.col("p") < alert_p) & (F.col("psi") >= alert_psi))


def wrong_way(means: DataFrame, base: str, shifted: str) -> DataFrame:
    """``means`` with ``wrong_way``: the shifted mean, if it is a number, is below."""
    return means.withColumn("wrong_way", F.coalesce(~F.isnan(shifted) & (F.col(shifted) < F.col(base)), F.lit(False)))


def offset_ascent(rows: DataFrame, truth: str, logits: str, classes: int, grid: Sequence[float], passes: int = 3) -> list[float]:
    """An offset for each class that raises balanced accuracy, by coordinate ascent.

    Each step scores the whole grid for one class in one pass over ``rows``; of equal
    scores the offset nearest to zero is taken. It ends with a pass without a change.
    """
    offsets = [0.0] * classes
    present = {r[0] for r in rows.select(truth).distinct().collect()}  # classes
    for _ in range(passes):
        before = list(offsets)
        for c in (c for c in range(classes) if c in present):
            tried = rows.withColumn("_off", F.explode(F.array(*map(F.lit, grid))))
            moved = F.array(*(F.element_at(logits, i + 1) + (F.col("_off") if i == c else F.lit(offsets[i])) for i in range(classes)))
            scores = classification(tried.withColumn("_guess", C.argmax(moved) - 1), ["_off"], truth, "_guess").collect()  # a row for each value of the grid
            offsets[c] = min((-round(r["balanced_accuracy"], 9), abs(r["_off"]), r["_off"]) for r in scores)[2]
        if offsets == before:
            break
    return offsets


def mid_ranks(rows: DataFrame, groups: Sequence[str], value: str) -> DataFrame:
    """One row for each distinct value: how many rows it has and their average rank."""
    counted = rows.groupBy(*groups, value).agg(F.count("*").alias("n"))
    return running(counted, groups, value, ["n"]).withColumn("rank", F.col("n_before") + (F.col("n") + 1) / 2).drop("n_before", "n_all")


def auroc(rows: DataFrame, groups: Sequence[str], value: str, positive: str) -> DataFrame:
    """groups, n_pos, n_neg, auroc with average ranks for ties; null without both."""
    counted = rows.groupBy(*groups, value).agg(F.count_if(F.col(positive)).alias("p"), F.count_if(~F.col(positive)).alias("q"))
    wins = F.sum(F.col("p") * (F.col("q_before") + F.col("q") / 2))
    return running(counted, groups, value, ["q"]).groupBy(*groups).agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), wins.alias("wins")).withColumn("auroc", C.ratio(F.col("wins"), F.col("n_pos") * F.col("n_neg"))).drop("wins")


def false_positive_rate(rows: DataFrame, groups: Sequence[str], value: str, positive: str, tpr: float = 0.95) -> DataFrame:
    """groups, fpr: the share of positives at or below the ``tpr`` quantile of the rest."""
    cut = quantile(rows.where(~F.col(positive)), groups, value, tpr, "cut")
    return rows.where(positive).join(cut, list(groups)).groupBy(*groups).agg(F.avg((F.col(value) <= F.col("cut")).cast("int")).alias("fpr"))


def confusion(rows: DataFrame, truth: str, guess: str, classes: Sequence) -> DataFrame:
    """A row for each true class and a column for each guessed one, in a fixed order."""
    return rows.groupBy(truth).pivot(guess, list(classes)).agg(F.count(F.lit(1))).na.fill(0)


def recalls(rows: DataFrame, groups: Sequence[str], truth: str, guess: str) -> DataFrame:
    """groups, truth, support, recall."""
    hit = F.avg((F.col(truth) == F.col(guess)).cast("int"))
    return rows.where(F.col(truth).isNotNull()).groupBy(*groups, truth).agg(F.count("*").alias("support"), hit.alias("recall"))


def classification(rows: DataFrame, groups: Sequence[str], truth: str, guess: str) -> DataFrame:
    """groups, n, classes, accuracy, balanced accuracy over the classes there are."""
    per_class = recalls(rows, groups, truth, guess)
    right = F.sum(F.col("recall") * F.col("support")) / F.sum("support")
    return per_class.groupBy(*groups).agg(F.sum("support").alias("n"), F.count("*").alias("classes"), right.alias("accuracy"), F.avg("recall").alias("balanced_accuracy"))


def triage_threshold(rows: DataFrame, score: str, positive: str, target: float) -> DataFrame:
    """threshold: the k-th largest score of the positives, k = ceil(target * n)."""
    counted = rows.where(positive).where(F.col(score).isNotNull()).groupBy(F.col(score).alias("s")).agg(F.count("*").alias("n"))
    enough = F.col("n_all") - F.col("n_before") >= F.ceil(F.lit(target) * F.col("n_all"))
    return running(counted, [], "s", ["n"]).where(enough).agg(F.max("s").alias("threshold"))


def expected_calibration_error(rows: DataFrame, groups: Sequence[str], confidence: str, correct: str, bins: int = 15) -> DataFrame:
    """groups, ece over equal bins that are open on the left."""
    placed = rows.withColumn("bin", F.ceil(F.col(confidence) * bins))
    each = placed.groupBy(*groups, "bin").agg(F.count("*").alias("n"), F.avg(confidence).alias("c"), F.avg(F.col(correct).cast("int")).alias("a"))
    return each.groupBy(*groups).agg((F.sum(F.col("n") * F.abs(F.col("a") - F.col("c"))) / F.sum("n")).alias("ece"))


def poisson_weight(*keys: Column, most: int = 8) -> Column:
    """A Poisson(1) count from a hash of the keys: the times a unit is drawn."""
    u = C.hash_share(*keys)
    out, below = F.lit(0), 0.0
    for k in range(most):
        below += math.exp(-1) / math.factorial(k)
        out = out + (u >= below).cast("int")
    return out


def bootstrap_interval(units: DataFrame, groups: Sequence[str], unit: str, top: str, bottom: str, replicates: int) -> DataFrame:
    """groups, low, high, draws: the 95 % interval of sum(top) / sum(bottom) when whole
    units are drawn again. Weights come from a hash, so no row moves."""
    copies = units.withColumn("replicate", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))))
    weight = poisson_weight(F.col("replicate"), F.col(unit))
    weighed = copies.withColumn("w", weight).groupBy(*groups, "replicate").agg(C.ratio(F.sum(F.col("w") * F.col(top)), F.sum(F.col("w") * F.col(bottom))).alias("metric"))
    quantile = lambda q: F.percentile("metric", F.lit(q))
    return weighed.where("metric is not null").groupBy(*groups).agg(quantile(0.025).alias("low"), quantile(0.975).alias("high"), F.count("*").alias("draws"))

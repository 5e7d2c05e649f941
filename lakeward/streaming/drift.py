"""Drift of event-time windows against a fixed baseline, from mergeable sketches.

A window's state is a count and a KLL sketch of its values for each group, some tens of
kilobytes whatever the rate, merged as rows come in; a late row within the watermark
changes the windows that hold it and no other. The baseline is a sketch, too, beside
exact edges of its bins, so a score reads no row of either sample again.

KS and PSI come from ``GRID`` values of each sketch at even ranks. While a sample has
no more than ``K`` values both are exact. Beyond, a share is off by at most ``RANK_ERROR``
in 99 of 100 sketches: KS by twice that, each share of the PSI's bins likewise.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.operators import statistics as S
from lakeward.operators.ranks import quantiles

K = GRID = 1024
#: Of a sketch with ``K`` = 1024 (0.27 %), and of reading it at ``GRID`` ranks.
RANK_ERROR = 0.0027 + 1 / GRID


def _usable(rows: DataFrame, value: str) -> DataFrame:
    """Rows with a number, null and NaN having no rank."""
    return rows.withColumn(value, F.col(value).cast("double")).where(F.col(value).isNotNull() & ~F.isnan(value))


def _sketched(value: str) -> list[Column]:
    return [F.count("*").alias("n"), F.kll_sketch_agg_double(value, K).alias("sketch")]


def _grid(sketch: str) -> Column:
    return F.kll_sketch_get_quantile_double(sketch, F.array(*(F.lit(i / GRID) for i in range(1, GRID + 1))))


def summary(baseline: DataFrame, group: str, value: str, bins: int = 10) -> DataFrame:
    """group, n_base, base (values at even ranks) and edges (exact quantiles)."""
    rows = _usable(baseline, value)
    held = rows.groupBy(group).agg(*_sketched(value)).select(group, F.col("n").alias("n_base"), _grid("sketch").alias("base"))
    edges = quantiles(rows, [group], value, [i / bins for i in range(1, bins)], "edges").withColumnRenamed(group, "_group")
    return held.join(edges, F.col(group).eqNullSafe(F.col("_group"))).drop("_group")


def windows(stream: DataFrame, time: str, group: str, value: str, length: str, slide: str | None = None) -> DataFrame:
    """start, group, n and sketch of each window; of a stream with a watermark, once the
    watermark has passed it."""
    rows = _usable(stream, value).groupBy(F.window(time, length, slide), group).agg(*_sketched(value))
    return rows.select(F.col("window.start").alias("start"), group, "n", "sketch")


def upto(points: np.ndarray, grid: np.ndarray, n: int, side: str) -> np.ndarray:
    """How many of ``n`` values, of which ``grid`` holds those at even ranks, lie below
    each point (side left), or below or at it (right)."""
    return -(-np.searchsorted(grid, points, side).astype(np.int64) * n // len(grid))


def gaps(base: np.ndarray, n_base: int, now: np.ndarray, n_now: int, edges: np.ndarray) -> tuple[float | None, float | None]:
    """KS and PSI of two samples from their grids; null where there is no baseline."""
    if base is None or edges is None:
        return None, None
    points = np.concatenate([base, now])
    ks = np.abs(upto(points, base, n_base, "right") / n_base - upto(points, now, n_now, "right") / n_now).max()
    cuts = [np.diff(np.concatenate([[0], upto(edges, grid, n, "left"), [n]])) / n + S.EPS for grid, n in ((base, n_base), (now, n_now))]
    return float(ks), float(((cuts[1] - cuts[0]) * np.log(cuts[1] / cuts[0])).sum())


def _gaps(base: pd.Series, n_base: pd.Series, now: pd.Series, n_now: pd.Series, edges: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([gaps(*row) for row in zip(base, n_base, now, n_now, edges, strict=True)], columns=["ks", "psi"])


def scored(held: DataFrame, known: DataFrame, group: str, least: int = 100, alert_p: float = 0.01, alert_psi: float = 0.2, warn_psi: float = 0.1) -> DataFrame:
    """``held`` (of ``windows``) with n_base, n_now, ks, psi, p, alert and warning against
    ``known`` (of ``summary``). A group without a baseline has none of them; a window with
    fewer than ``least`` values never alerts."""
    known = known.withColumnRenamed(group, "_group")
    both = held.withColumnRenamed("n", "n_now").join(known, F.col(group) == F.col("_group"), "left").drop("_group")
    both = both.withColumn("_found", F.pandas_udf(_gaps, "ks double, psi double")("base", "n_base", _grid("sketch"), "n_now", "edges"))
    both = both.select("start", group, "n_base", "n_now", "_found.ks", "_found.psi")
    p = S.ks_p_value(F.col("ks"), F.col("n_base"), F.col("n_now"))
    enough = F.col("n_now") >= least
    alert = enough & (p < alert_p) & (F.col("psi") >= alert_psi)
    return both.withColumns({"p": p, "alert": alert}).withColumn("warning", enough & ~F.col("alert") & (F.col("psi") >= warn_psi))


def merged(held: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Windows put together, such as the days of a month, without their values."""
    return held.groupBy(*keys).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch").alias("sketch"))

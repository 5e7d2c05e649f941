"""The softmax temperature that makes logits likeliest, in one pass for the whole grid."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

GRID = tuple(math.exp(math.log(0.05) + i * (math.log(20.0) - math.log(0.05)) / 2000) for i in range(2001))
_ROWS = 256


def losses(z: np.ndarray, y: np.ndarray, grid: np.ndarray) -> np.ndarray:
    """The summed negative log-likelihood of the classes ``y`` under each temperature."""
    top = z.max(axis=1, keepdims=True)
    out = np.zeros(len(grid))
    for at in range(0, len(z), _ROWS):  # rows times temperatures times classes are never held at once
        part = (z - top)[at : at + _ROWS]
        scaled = part[:, None, :] / grid[None, :, None]
        own = np.take_along_axis(part, y[at : at + _ROWS, None], axis=1) / grid[None, :]
        out += (np.log(np.exp(scaled).sum(axis=2)) - own).sum(axis=0)
    return out


def summed(rows: DataFrame, logits: str, truth: str, grid: tuple[float, ...] = GRID) -> DataFrame:
    """temperature, n, nll: the mean loss under each temperature. A task adds up its rows and
    gives one value for each temperature. ``truth`` counts classes from 0; rows with a null
    or a class that the logits lack count for nothing."""
    held = np.array(grid)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(len(held)), 0
        for batch in batches:
            if batch.num_rows:
                z = np.array(batch.column("z").to_pylist(), np.float64)
                total += losses(z, batch.column("y").to_numpy(zero_copy_only=False).astype(np.int64), held)
                n += len(z)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(held), dtype=np.int32)), pa.array(np.full(len(held), n)), pa.array(total)], ["i", "n", "loss"])

    z = F.transform(logits, lambda x: x.cast("double"))
    usable = rows.select(z.alias("z"), F.col(truth).cast("int").alias("y")).where(F.col("y").between(0, F.size("z") - 1) & ~F.exists("z", lambda x: x.isNull() | F.isnan(x)))
    sums = usable.mapInArrow(add, "i int, n long, loss double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss"))
    temperature = F.element_at(F.array(*map(F.lit, grid)), F.col("i") + 1)
    return sums.select(temperature.alias("temperature"), "n", (F.col("loss") / F.col("n")).alias("nll"))


def fitted(rows: DataFrame, logits: str, truth: str, grid: tuple[float, ...] = GRID) -> DataFrame:
    """One row, temperature and nll: of the least mean loss, of equals the least temperature.
    No row where there is nothing to fit on."""
    best = summed(rows, logits, truth, grid).agg(F.min(F.struct("nll", "temperature")).alias("_best"))
    return best.where("_best is not null").select("_best.temperature", "_best.nll")

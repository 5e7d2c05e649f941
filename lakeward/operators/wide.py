"""Leading components of wide vectors, without a matrix of width by width anywhere.

A randomised range finder: a random basis of a few columns more than are wanted is
multiplied by the covariance, pass after pass, and made orthogonal in between. A task
multiplies its rows by the basis and back, so it holds a block of rows and two tables of width by
columns; Spark adds the tasks' tables up by coordinate, and only the sum, width by columns,
reaches the driver. The covariance in the last basis, columns by columns, then gives directions
and eigenvalues.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeward.operators import vectors as V

#: Columns beside those wanted, and passes over the vectors. With p passes a direction
#: is off by about (eigenvalue after the last column / own eigenvalue) ** p.
MORE, PASSES = 10, 6
_ROWS = 512


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> Iterator[np.ndarray]:
    """The vectors of a batch, some rows at a time."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    for at in range(0, len(values), _ROWS):
        yield values[at : at + _ROWS]


def _usable(df: DataFrame, vector: str) -> tuple[DataFrame, int]:
    """Vectors of the greatest width, and that width; null ones and those that hold a null or
    are shorter take no part."""
    rows = df.select(F.col(vector).cast("array<double>").alias("v"))
    width = rows.agg(F.max(F.size("v"))).first()[0] or 0
    return rows.where((F.size("v") == width) & ~F.exists("v", lambda x: x.isNull())), width


def centre(rows: DataFrame, width: int) -> tuple[int, np.ndarray, float]:
    """How many vectors there are, their mean and their variance over all coordinates."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, squares, n = np.zeros(width), np.zeros(width), 0
        for batch in batches:
            for x in _matrix(batch.column(0), width):
                total, squares, n = total + x.sum(axis=0), squares + (x * x).sum(axis=0), n + len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), pa.array(np.full(width, n)), pa.array(total), pa.array(squares)], ["i", "n", "s", "q"])

    sums = rows.mapInArrow(add, "i long, n long, s double, q double").groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).orderBy("i").toPandas()
    if sums.empty:
        return 0, np.zeros(width), 0.0
    n, mean = int(sums["n"].iloc[0]), (sums["s"] / sums["n"]).to_numpy()
    return n, mean, float((sums["q"] / n).sum() - mean @ mean)


def multiplied(rows: DataFrame, width: int, mean: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The sum of x (x' basis) over all centred vectors x: width by the basis's columns."""
    held = rows.sparkSession.sparkContext.broadcast((mean, basis))  # width by columns
    columns = basis.shape[1]

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mean, basis = held.value
        total = np.zeros((width, columns))
        for batch in batches:
            for x in _matrix(batch.column(0), width):
                x = x - mean
                total += x.T @ (x @ basis)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width)), *(pa.array(np.ascontiguousarray(total[:, c])) for c in range(columns))], ["i", *(f"c{c}" for c in range(columns))])

    parts = rows.mapInArrow(multiply, "i long, " + ", ".join(f"c{c} double" for c in range(columns)))
    sums = parts.groupBy("i").agg(*(F.sum(f"c{c}").alias(f"c{c}") for c in range(columns))).orderBy("i").toPandas()
    held.unpersist()
    return sums[[f"c{c}" for c in range(columns)]].to_numpy() if len(sums) else np.zeros((width, columns))


def components(df: DataFrame, vector: str, k: int, more: int = MORE, passes: int = PASSES, seed: int = 0) -> tuple[np.ndarray, np.ndarray, float]:
    """The ``k`` leading directions of the covariance (over n), their eigenvalues, and the
    variance in all. Signs are such that a direction's greatest entry is positive."""
    rows, width = _usable(df, vector)
    n, mean, variance = centre(rows, width)
    k, columns = min(k, width), min(width, k + more)
    if not n:
        return np.zeros((0, width)), np.zeros(0), 0.0
    basis, _ = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, columns)))
    for _ in range(passes):
        image = multiplied(rows, width, mean, basis) / n
        inner = basis.T @ image
        last, basis = basis, np.linalg.qr(image)[0]
    values, turned = np.linalg.eigh((inner + inner.T) / 2)
    order = np.argsort(values)[::-1][:k]
    directions = (last @ turned[:, order]).T
    signs = np.sign(directions[np.arange(len(directions)), np.abs(directions).argmax(axis=1)])
    return directions * signs[:, None], values[order], variance


def components_for(df: DataFrame, vector: str, share: float, most: int = 256) -> int | None:
    """How many leading components hold ``share`` of the variance, looked for with twice as
    many each time; None if ``most`` do not."""
    k = 8
    while True:
        _, values, variance = components(df, vector, min(k, most))
        held = np.cumsum(values) / variance if variance > 0 else np.ones(1)
        if len(held) and held[-1] >= share:
            return int(np.searchsorted(held, share) + 1)
        if k >= most or len(values) < k:
            return None
        k *= 2


def projected(df: DataFrame, vector: str, directions: np.ndarray, name: str, keep: bool = True) -> DataFrame:
    """``df`` with ``name``, the vector along each of ``directions``; null for a null vector.
    The directions are broadcast, as literals of a plan they would be too many. Without
    ``keep`` the vector itself is left out, so that it does not go back to Spark."""
    held = df.sparkSession.sparkContext.broadcast(directions)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                z = pa.array(_along(part.column(vector), held.value), pa.list_(pa.float64()))
                yield (part if keep else part.drop_columns([vector])).append_column(name, z)

    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in df.schema if keep or f.name != vector)
    return df.mapInArrow(project, f"{kinds}`{name}` array<double>")


def _along(column: pa.Array, directions: np.ndarray) -> list[list[float] | None]:
    """The vectors along the directions; null where one is null, holds a null or is of another
    width. The numbers are read as an array, not as objects."""
    width = directions.shape[1]
    lengths = np.asarray(pc.fill_null(pc.list_value_length(column), -1), np.int64)
    values = column.flatten()  # of vectors that are not null
    ends = np.cumsum(np.maximum(lengths, 0))
    numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
    nulls = np.concatenate([[0], np.cumsum(np.asarray(values.is_null()))]) if values.null_count else None
    out: list[list[float] | None] = [None] * len(lengths)
    for i in np.flatnonzero(lengths == width).tolist():
        start, end = ends[i] - width, ends[i]
        if nulls is None or nulls[start] == nulls[end]:
            out[i] = (directions @ numbers[start:end]).tolist()
    return out


def mahalanobis(df: DataFrame, train: DataFrame, key: str, label: str, vector: str, k: int) -> DataFrame:
    """key, score: as ``vectors.mahalanobis``, whose distance does not depend on how the
    ``k`` components are turned among themselves."""
    directions, _, _ = components(train, vector, k)
    z = lambda rows, *columns: projected(rows.select(*columns, vector), vector, directions, "_z", keep=False).where("_z is not null")
    return V.mahalanobis(z(df, key), z(train, label), key, label, "_z", len(directions))

"""Embeddings: centroids, cosine and Mahalanobis scores, components, bounds.

Sums over rows are Spark aggregates; only matrices of the vector's width reach the
driver, whose size does not grow with the rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.functions import columns as C


def centroids(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, centroid: the mean of each coordinate."""
    each = df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg("x").alias("m"))
    return each.groupBy(label).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("centroid"))


def nearest(df: DataFrame, centres: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """key, nearest, distance: the closest of a few centres, the first of equals.

    The centres, one a class, are gathered into a single row.
    """
    packed = centres.agg(F.sort_array(F.collect_list(F.struct(F.col(label).alias("label"), "centroid"))).alias("centres"))
    square = lambda c: C.total(F.zip_with(F.col(vector), c["centroid"], lambda x, m: (x.cast("double") - m) * (x.cast("double") - m)))
    options = F.transform("centres", lambda c: F.struct(square(c).alias("d"), c["label"].alias("label")))
    return df.join(packed, F.lit(True)).withColumn("best", F.array_min(options)).select(key, F.col("best.label").alias("nearest"), F.sqrt("best.d").alias("distance"))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(C.dot(a, b), C.norm(a) * C.norm(b))


def moments(df: DataFrame, vector: str) -> tuple[int, np.ndarray, np.ndarray]:
    """Rows, mean and covariance (over n) of the vectors that are there.

    Each task sums its rows' products with NumPy and gives one number for each pair of
    coordinates; Spark adds those up, so what reaches the driver is as wide as the
    vector, squared, however many rows there are.
    """
    width = df.agg(F.max(F.size(vector))).first()[0] or 0

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width + 1))
        for batch in batches:
            x = np.array([[1.0, *v] for v in batch.column(0).to_pylist()], np.float64).reshape(-1, width + 1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], ["at", "s"])

    parts = df.where(F.col(vector).isNotNull()).select(F.col(vector).cast("array<double>").alias("v")).mapInArrow(summed, "at long, s double")
    total = np.zeros((width + 1) ** 2)
    for r in parts.groupBy("at").agg(F.sum("s").alias("s")).collect():
        total[r["at"]] = r["s"]
    total = total.reshape(width + 1, width + 1)
    n = max(1.0, total[0, 0])
    mean = total[0, 1:] / n
    return int(total[0, 0]), mean, total[1:, 1:] / n - np.outer(mean, mean)


def components(df: DataFrame, vector: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` leading directions of the covariance and all of its eigenvalues."""
    _, _, covariance = moments(df, vector)
    values, vectors = np.linalg.eigh(covariance)
    order = np.argsort(values)[::-1]
    return vectors[:, order[:k]].T, values[order]


def components_for(eigenvalues: np.ndarray, share: float) -> int:
    """How many leading components hold ``share`` of the variance."""
    return int(np.searchsorted(np.cumsum(eigenvalues) / eigenvalues.sum(), share) + 1)


def projected(vector: Column, directions: np.ndarray) -> Column:
    return F.array(*(C.dot(vector, F.array(*map(F.lit, map(float, d)))) for d in directions))


def mahalanobis(df: DataFrame, train: DataFrame, key: str, label: str, vector: str, k: int) -> DataFrame:
    """key, score: the least squared distance to a class mean under the shared
    covariance, in ``k`` leading components fitted on ``train``."""
    directions, _ = components(train, vector, k)
    flat = train.select(label, projected(F.col(vector), directions).alias("z"))
    means = {r[label]: np.array(r["centroid"]) for r in centroids(flat, label, "z").collect()}
    centred = flat
    pick = F.lit(None).cast("array<double>")
    for name, m in means.items():
        pick = F.when(F.col(label) == name, F.zip_with("z", F.array(*map(F.lit, m.tolist())), lambda x, c: x - c)).otherwise(pick)
    _, mean, covariance = moments(centred.select(pick.alias("c")), "c")
    inverse = np.linalg.pinv(covariance + np.outer(mean, mean))
    root = np.linalg.cholesky(inverse + 1e-12 * np.eye(len(inverse))).T
    whitened = projected(F.col("z"), root)
    spots = [root @ m for m in means.values()]
    distances = F.array(*(C.total(F.zip_with("w", F.array(*map(F.lit, s.tolist())), lambda x, c: (x - c) * (x - c))) for s in spots))
    scored = df.select(key, projected(F.col(vector), directions).alias("z")).select(key, whitened.alias("w"))
    return scored.select(key, F.array_min(distances).alias("score"))


def bounds(df: DataFrame, label: str, vector: str) -> DataFrame:
    """label, i, low, high of each coordinate in each class."""
    return df.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.min("x").alias("low"), F.max("x").alias("high"))


def bound_excess(df: DataFrame, limits: DataFrame, key: str, label: str, vector: str, eps: float = 1e-6) -> DataFrame:
    """key, excess: how far coordinates leave their class's bounds, relative to them."""
    x, low, high = (F.col(c).cast("double") for c in ("x", "low", "high"))
    over = F.greatest(low - x, F.lit(0.0)) / (F.abs(low) + eps) + F.greatest(x - high, F.lit(0.0)) / (F.abs(high) + eps)
    rows = df.select(key, label, F.posexplode(vector).alias("i", "x"))
    return rows.join(limits, [label, "i"]).groupBy(key).agg(F.sum(over).alias("excess"))

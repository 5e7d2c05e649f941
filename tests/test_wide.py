"""Components of wide vectors against the eigenvectors of their covariance."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeward.operators import vectors as V
from lakeward.operators import wide


def sample(n=500, d=64, seed=1):
    rng = np.random.default_rng(seed)
    turn, _ = np.linalg.qr(rng.normal(size=(d, d)))
    return (rng.normal(size=(n, d)) * 3.0 / np.arange(1, d + 1)) @ turn + rng.normal(size=d)


def frame(spark, x):
    rows = [(i, i % 3, [float(v) for v in row]) for i, row in enumerate(x)]
    return spark.createDataFrame([*rows, (-1, 0, None), (-2, 0, [1.0])], "id long, label int, v array<double>").repartition(5)


def test_directions_and_values_are_those_of_the_covariance(spark):
    x = sample()
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    values, vectors = values[::-1], vectors[:, ::-1].T
    directions, found, variance = wide.components(frame(spark, x), "v", 6)
    assert found == pytest.approx(values[:6], rel=1e-6) and variance == pytest.approx(values.sum())
    assert all(abs(a @ b) > 1 - 1e-6 for a, b in zip(directions, vectors))
    again = wide.components(frame(spark, x), "v", 6)[0]
    assert np.allclose(directions, again, atol=1e-9)
    assert wide.components_for(frame(spark, x), "v", 0.95) == V.components_for(values, 0.95)
    assert wide.components_for(frame(spark, x), "v", 0.9999, most=8) is None


def test_scores_are_those_of_the_narrow_way(spark):
    df = frame(spark, sample(seed=2)).where("id >= 0")
    a = {r.id: r.score for r in V.mahalanobis(df, df, "id", "label", "v", 4).collect()}
    b = {r.id: r.score for r in wide.mahalanobis(df, df, "id", "label", "v", 4).collect()}
    assert a.keys() == b.keys() and all(b[i] == pytest.approx(a[i], rel=1e-4) for i in a)


def test_wide_vectors_leave_the_driver_small(spark):
    d = 4096
    x = spark.range(400).select(F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.sin(F.col("id") * 0.1 + i * 0.01) * 5 + F.cos(F.col("id") * i * 1e-3)).alias("v"))
    directions, values, variance = wide.components(x, "v", 3, passes=4)
    assert directions.shape == (3, d) and np.allclose(directions @ directions.T, np.eye(3), atol=1e-6)
    assert values[0] >= values[1] >= values[2] and values.sum() > 0.5 * variance


def test_no_vector_and_few_columns(spark):
    empty = spark.createDataFrame([], "id long, v array<double>")
    assert wide.components(empty, "v", 3)[1].size == 0
    two = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, None)], "id long, v array<double>")
    directions, values, _ = wide.components(two, "v", 9)
    assert directions.shape == (2, 2) and values[1] == pytest.approx(0, abs=1e-12)
    assert {r.id: r.z is None for r in wide.projected(two, "v", directions, "z").collect()} == {1: False, 2: False, 3: True}


def test_a_task_does_not_hold_vectors_as_objects(spark):
    import tracemalloc

    import pyarrow as pa

    d, n = 1024, 2000
    column = pa.array(list(np.random.default_rng(4).normal(size=(n, d))))
    directions = np.eye(d)[:3]
    tracemalloc.start()
    got = wide._along(column, directions)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(got) == n and peak < 8 * n * d  # objects take 32 bytes a number
    odd = pa.array([[1.0, 2.0], None, [], [3.0, None], [5.0, 6.0], [1.0]], pa.list_(pa.float64()))
    assert wide._along(odd, np.eye(2)) == [[1.0, 2.0], None, None, None, [5.0, 6.0], None]
    assert wide._along(odd.slice(3), np.eye(2)) == [None, [5.0, 6.0], None]


def test_scores_can_go_without_their_vectors(spark):
    df = frame(spark, sample(n=20))
    z = wide.projected(df, "v", np.eye(64)[:2], "z", keep=False)
    assert z.columns == ["id", "label", "z"]
    whole = {r.id: r.z for r in wide.projected(df, "v", np.eye(64)[:2], "z").collect()}
    assert {r.id: r.z for r in z.collect()} == whole and whole[-1] is None and whole[-2] is None

"""Exact KS, Gram features, temperature and whole landings against plain versions."""

import math
import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeward.operators import gram, temperature
from lakeward.operators import statistics as S
from lakeward.sources import files


def enumerated(h, n, m):
    """The share of all orders of n and m values whose gap reaches h / (n m)."""
    hits = total = 0
    for places in combinations(range(n + m), n):
        i = j = gap = 0
        held = set(places)
        for k in range(n + m):
            i, j = (i + 1, j) if k in held else (i, j + 1)
            gap = max(gap, abs(i * m - j * n))
        hits += gap >= h
        total += 1
    return hits / total


def test_exact_p_values_are_those_of_all_orders():
    for n in range(1, 9):
        for m in range(1, 9):
            if math.comb(n + m, n) > 4000 and (n + m) % 3:
                continue
            for h in {1, max(1, n * m // 3), n * m // 2 + 1, n * m}:
                assert S.ks_exact(h / (n * m), n, m) == pytest.approx(enumerated(h, n, m), abs=1e-12), (h, n, m)
    assert S.ks_exact(0.0, 5, 5) == 1.0 and S.ks_exact(None, 5, 5) is None and S.ks_exact(0.5, 0, 5) is None


def test_exact_and_series_agree_for_large_samples(spark):
    rows = spark.createDataFrame([(0.02, 10_000, 10_000), (0.03, 10_000, 9_000), (0.5, 8, 6), (0.01, 20_000, 10), (None, 5, 0)], "ks double, n long, m long")
    got = [r.p for r in S.ks_probability(rows, "ks", "n", "m").collect()]
    series = [r.p for r in rows.select(S.ks_p_value(F.col("ks"), F.col("n"), F.col("m")).alias("p")).collect()]
    assert got[0] == pytest.approx(series[0], abs=2e-3) and got[1] == pytest.approx(series[1], abs=2e-3)
    assert got[2] == pytest.approx(enumerated(24, 8, 6)) and abs(got[2] - series[2]) > 1e-3
    assert got[3] == series[3] and got[4] is None


# ---- Gram -----------------------------------------------------------------------------


def plain_gram(vectors, labels, fit, hold, size, channels, count, powers):
    def features(v):
        out = []
        for b in range(count):
            f = np.array(v[b * size : (b + 1) * size]).reshape(channels, -1)
            rows = []
            for p in powers:
                g = (f**p @ (f**p).T).sum(axis=1)
                rows.append(np.sign(g) * np.abs(g) ** (1 / p))
            out.append(np.concatenate(rows))
        return np.array(out)

    x = np.array([features(v) for v in vectors])
    dev = []
    for i, label in enumerate(labels):
        mine = [k for k in fit if labels[k] == label] or fit
        low, high = x[mine].min(axis=0), x[mine].max(axis=0)
        dev.append((np.maximum(low - x[i], 0) / (np.abs(low) + 1e-6) + np.maximum(x[i] - high, 0) / (np.abs(high) + 1e-6)).sum(axis=1))
    dev = np.array(dev)
    return (dev / (dev[hold].mean(axis=0) + 1e-12)).sum(axis=1)


def test_gram_scores_are_those_of_the_matrices(spark):
    rng = np.random.default_rng(3)
    vectors, labels = rng.normal(0, 1, (60, 12)), [i % 3 for i in range(60)]
    labels[0] = 7  # a class that was not fitted
    fit, hold = [i for i in range(60) if i % 2], [i for i in range(60) if i % 4 == 0]
    want = plain_gram(vectors, labels, fit, hold, 6, 2, 2, (1, 2, 3))
    rows = [(i, labels[i], [float(x) for x in v]) for i, v in enumerate(vectors)]
    df = spark.createDataFrame([*rows, (100, 1, None), (101, 1, [1.0])], "id long, label int, v array<double>")
    got = {r.id: r.score for r in gram.scored(df, F.col("id") % 2 == 1, F.col("id") % 4 == 0, "id", "label", "v", 6, 2, 2, (1, 2, 3)).collect()}
    assert got.keys() == set(range(60)) and all(got[i] == pytest.approx(want[i], rel=1e-6) for i in range(60))
    assert not gram.scored(df.limit(0), F.lit(True), F.lit(True), "id", "label", "v", 6, 2, 2, (1,)).count()


# ---- temperature ----------------------------------------------------------------------


def test_the_likeliest_temperature(spark):
    rng = np.random.default_rng(4)
    z = rng.normal(0, 3, (400, 4))
    p = np.exp(z / 2.5) / np.exp(z / 2.5).sum(axis=1, keepdims=True)
    y = [int(rng.choice(4, p=row)) for row in p]
    df = spark.createDataFrame([([float(v) for v in row], c) for row, c in zip(z, y)] + [(None, 1), ([1.0, None, 0.0, 0.0], 1), ([1.0, 2.0, 3.0, 4.0], None), ([1.0, 2.0], 5)], "z array<double>, y int")
    sums = {r.temperature: (r.n, r.nll) for r in temperature.summed(df.repartition(5), "z", "y").collect()}
    plain = [np.mean([np.log(np.exp(row / t).sum()) - row[c] / t for row, c in zip(z, y)]) for t in temperature.GRID]
    assert len(sums) == 2001 and {n for n, _ in sums.values()} == {400}
    assert all(sums[t][1] == pytest.approx(v, rel=1e-9) for t, v in zip(temperature.GRID, plain))
    best = temperature.fitted(df, "z", "y").first()
    assert best.temperature == temperature.GRID[int(np.argmin(plain))] and 1.5 < best.temperature < 4
    assert temperature.fitted(df.limit(0), "z", "y").count() == 0


# ---- landing --------------------------------------------------------------------------


def test_a_failure_leaves_nothing(spark, tmp_path):
    rng = random.Random(1)
    rows = [(i, f"v{rng.randrange(9)}", "broken" if i in (7, 300, 301) else None) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, v string, error string").repartition(6)
    with pytest.raises(files.LandingError, match="3 rows") as caught:
        files.landed_whole(df, "id", "error", f"{tmp_path}/out", shown=2)
    assert caught.value.failures == [("7", "broken"), ("300", "broken")] and caught.value.count == 3
    assert not list(tmp_path.iterdir())


def test_a_whole_landing_is_there_once(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i}", None) for i in range(50)], "id long, v string, error string")
    out = files.landed_whole(df, "id", "error", f"{tmp_path}/out")
    assert out.columns == ["id", "v"] and sorted(map(tuple, out.collect())) == [(i, f"v{i}") for i in range(50)]
    with pytest.raises(FileExistsError):
        files.landed_whole(df, "id", "error", f"{tmp_path}/out")
    assert [p.name for p in tmp_path.iterdir()] == ["out"]
    assert files.landed_whole(df.limit(0), "id", "error", f"{tmp_path}/none").count() == 0

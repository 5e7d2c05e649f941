"""Running totals and quantiles against plain ones, over few and over many ranges."""

import random

import pytest
from pyspark.sql import functions as F

from lakeward.operators import relational as R
from lakeward.operators import statistics as S
from lakeward.operators.ranks import nearest_rank, quantiles, running


def sample(seed, n=400):
    rng = random.Random(seed)
    kinds = {"hot": lambda: rng.gauss(0, 1), "ties": lambda: float(rng.randrange(5)), None: lambda: rng.choice([None, 1.5, -2.0])}
    return [(g, kinds[g](), rng.randrange(4)) for g in ["hot"] * n + ["ties"] * 60 + [None] * 20] + [("one", 7.0, 1)]


@pytest.mark.parametrize("ranges", [2, 40, 1024])
def test_totals_run_on_over_ranges(spark, ranges):
    rows = sample(1)
    df = spark.createDataFrame(rows, "g string, v double, n int").groupBy("g", "v").agg(F.sum("n").alias("n"))
    got = {(r["g"], r["v"]): (r["n_before"], r["n_all"]) for r in running(df, ["g"], "v", ["n"], ranges).collect()}
    low = lambda v: float("-inf") if v is None else v
    for (g, v), (before, every) in got.items():
        mine = [r for r in rows if r[0] == g]
        assert every == sum(r[2] for r in mine) and before == sum(r[2] for r in mine if low(r[1]) < low(v))
    assert len(got) == len({r[:2] for r in rows})
    assert running(df.limit(0), [], "v", ["n"], ranges).count() == 0


@pytest.mark.parametrize("ranges", [3, 1024])
def test_quantiles_are_those_of_all_rows(spark, ranges):
    df = spark.createDataFrame(sample(2), "g string, v double, n int")
    shares = [0.0, 0.1, 0.5, 0.95, 1.0]
    want = {r["g"]: r["q"] for r in df.where("v is not null").groupBy("g").agg(F.percentile("v", F.array(*map(F.lit, shares))).alias("q")).collect()}
    got = {r["g"]: r["q"] for r in quantiles(df, ["g"], "v", shares, "q", ranges).collect()}
    assert got.keys() == want.keys() and all(g == pytest.approx(want[k]) for k, g in got.items())
    assert quantiles(df, [], "v", [0.5], "q", ranges).first()["q"] == pytest.approx(df.agg(F.percentile("v", F.array(F.lit(0.5)))).first()[0])


def test_no_window_runs_over_a_whole_group(spark):
    df = spark.createDataFrame(sample(3), "g string, v double, n int").withColumn("b", F.col("n") > 1)
    for plan in (S.ecdf_distance(df, ["g"], "v", "b"), S.auroc(df, ["g"], "v", "b"), S.mid_ranks(df, ["g"], "v"), S.population_stability(df, ["g"], "v", "b")):
        text = plan._jdf.queryExecution().optimizedPlan().toString()
        assert " percentile(" not in text and "_range" in text


def test_the_source_is_read_once(spark, tmp_path):
    spark.createDataFrame(sample(4), "g string, v double, n int").withColumn("b", F.col("n") > 1).write.parquet(f"{tmp_path}/source")
    df = spark.read.parquet(f"{tmp_path}/source")
    read = []
    for made in (S.drift(df, ["g"], "v", "b"), S.auroc(df, ["g"], "v", "b"), quantiles(df, ["g"], "v", [0.5], "q"), S.population_stability(df, ["g"], "v", "b")):
        read.append(len({f for f in made.inputFiles() if "source" in f}))  # what is left to read is the ordered table
    assert read == [0] * 4


@pytest.mark.parametrize("ranges", [1, 7])
def test_nearest_rank_is_a_value_of_the_group(spark, ranges):
    rows = [r for r in sample(5) if r[1] is not None and r[2]]
    df = spark.createDataFrame(rows, "g string, v double, n int").groupBy("g", "v").agg(F.sum("n").alias("n"))
    for r in nearest_rank(df, ["g"], "v", "n", [("low", 0.5), ("high", 0.95)]).collect():
        every = sorted(v for g, v, n in rows if g == r["g"] for _ in range(n))
        assert r["n"] == len(every) and [r["low"], r["high"]] == [every[-(-len(every) * q // 100) - 1] for q in (50, 95)]


def test_faults_of_a_long_chain_are_found_across_ranges(spark):
    entries = spark.createDataFrame([(u, i, f"e{i}") for u in (None, "a", "b") for i in range(60)], "u string, i long, kind string")
    log = R.chained(entries, ["u"], ["i"], F.col("kind")).collect()
    broken = [r for r in log if (r.u, r.seq) not in {("a", 17), ("b", 0)}]
    rows = [(r.u, r.seq, r.prev, "edited" if (r.u, r.seq) == (None, 30) else r.body, r.hash) for r in broken]
    df = spark.createDataFrame([*rows, rows[-1]], "u string, seq int, prev string, body string, hash string")
    got = R.chain_faults(df, ["u"]).collect()
    assert len(got) == len(rows) + 1
    assert {(r.u, r.seq) for r in got if r.edited} == {(None, 30)}
    assert {(r.u, r.seq) for r in got if r.broken} >= {("a", 18), ("b", 1)} and not [r for r in got if r.broken and r.u is None]
    assert {(r.u, r.seq) for r in got if r.gap} >= {("a", i) for i in range(18, 60)} | {("b", i) for i in range(1, 59)}
    whole = R.chain_faults(spark.createDataFrame(log), ["u"])
    assert whole.where("gap OR broken OR edited").count() == 0 and whole.count() == 180


def test_a_group_too_large_for_a_fingerprint_is_refused(spark):
    df = spark.createDataFrame([("a", i) for i in range(9)] + [("b", 1)], "g string, v int")
    assert R.fingerprints(df, ["g"], "v").count() == 2 and R.fingerprints(df.limit(0), ["g"], "v").count() == 0
    with pytest.raises(ValueError, match="9 rows"):
        R.fingerprints(df, ["g"], "v", most=8)

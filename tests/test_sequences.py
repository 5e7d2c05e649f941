"""Named gates by single faults, drift against one baseline, fitted parts by NumPy."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeward import registry
from lakeward.operators import cdm
from lakeward.operators import gates as G
from lakeward.operators import statistics as S
from lakeward.operators import vectors as V
from lakeward.plans.sequences import named_gates

COLUMNS = ["image_id", "source", "role", "client", "split", "patient", "label", "mapped", "diagnosis"]
CLEAN = [(i, "main", "client", f"c{i % 2}", ("train", "val", "test")[i // 2 % 3], f"p{i // 2 % 3}", "nv", "nv", "known") for i in range(12)]
CLEAN += [(20, "site", "held_out", None, "score", None, None, None, "indeterminate"), (21, "site", "held_out", None, "score", None, "nv", None, "known")]


def changed(i, **values):
    return [tuple(values.get(c, v) for c, v in zip(COLUMNS, r)) if r[0] == i else r for r in CLEAN]


#: What is changed, and the gates that must fail: these and no others.
FAULTS = {
    "none": (CLEAN, set()),
    "mapping": (changed(3, mapped="mel"), {"diagnosis_mapping_matches"}),
    "both null": (changed(3, mapped=None, label=None), {"diagnosis_mapping_matches"}),
    "rule": (changed(20, label="nv"), {"site_label_rule_applied"}),
    "no client": (changed(3, client=None), {"every_client_image_has_a_client"}),
    "trained on": (changed(21, split="train"), {"held_out_is_only_scored"}),
    "unsplit": (changed(21, split=None), {"held_out_is_only_scored"}),
    "two splits": (changed(3, patient="p0"), {"patients_in_one_split"}),
    "documented": (changed(3, patient="p9"), set()),
    "lacks a split": ([r for r in CLEAN if not (r[3] == "c0" and r[4] == "val")], {"every_client_has_all_splits", "split_matches_its_fingerprint"}),
    "another split": (changed(3, split="test", patient="q"), {"split_matches_its_fingerprint"}),
}


@pytest.mark.parametrize("fault", FAULTS)
def test_a_fault_fails_its_own_gate(spark, fault):
    schema = "image_id long, source string, role string, client string, split string, patient string, label string, mapped string, diagnosis string"
    frozen = G.fingerprint(spark.createDataFrame(CLEAN, schema).where("source = 'main'"), ["image_id", "split"]).first()[0]
    rows, expected = FAULTS[fault]
    documented = spark.createDataFrame([("p9",)], "patient string")
    gates = named_gates(spark.createDataFrame(list(reversed(rows)), schema), documented, frozen)
    assert {r["name"] for r in gates.where("not passed").collect()} == expected


def test_concepts_are_held_against_the_vocabulary(spark):
    mapping = spark.createDataFrame([("sex", "m", 1, "Gender"), ("sex", "f", 2, "Gender"), ("site", "arm", 3, "Gender"), ("site", "leg", 4, "Site"), ("site", "x", 0, "Site"), ("site", "toe", 9, "Site")], "field string, value string, concept_id long, expected_domain string")
    concepts = spark.createDataFrame([(1, "S", None, "Gender"), (2, None, None, "Gender"), (3, "S", None, "Site"), (4, "S", "D", "Site")], "concept_id long, standard_concept string, invalid_reason string, domain_id string")
    assert {r["name"]: r["violations"] for r in cdm.vocabulary_gates(mapping, concepts).collect()} == {"missing": 1, "not_standard": 1, "invalid": 1, "other_domain": 1}


def test_one_baseline_serves_all_groups(spark):
    rng = np.random.default_rng(3)
    base = [(float(x),) for x in np.round(rng.normal(0, 1, 500), 2)]
    rows = [(g, float(x)) for g, shift in (("a", 0), ("b", 0.7), ("c", 9)) for x in np.round(rng.normal(shift, 1, 150), 2)]
    baseline, now = spark.createDataFrame(base, "v double"), spark.createDataFrame(rows, "g string, v double")
    copies = now.withColumn("base", F.lit(False)).unionByName(now.select("g").distinct().crossJoin(baseline).withColumn("base", F.lit(True)))
    want = {r["g"]: r for r in S.drift(copies, ["g"], "v", "base").collect()}
    got = {r["g"]: r for r in S.drift_against(now, ["g"], "v", baseline).collect()}
    assert got.keys() == want.keys()
    for g, r in got.items():
        assert all(r[c] == pytest.approx(want[g][c], abs=1e-12) for c in ("n_base", "n_now", "ks", "psi", "p", "alert"))


def test_offsets_are_those_of_a_plain_ascent(spark):
    rng = np.random.default_rng(7)
    z, y = rng.normal(0, 1, (200, 3)), rng.integers(0, 3, 200)
    z[np.arange(200), y] += 0.4
    grid = [-1.0, -0.5, 0.0, 0.5, 1.0]

    def score(offsets):
        guess = (z + offsets).argmax(1)
        return round(float(np.mean([(guess[y == c] == c).mean() for c in range(3)])), 9)

    plain = [0.0] * 3
    for _ in range(3):
        for c in range(3):
            tried = [[v if i == c else plain[i] for i in range(3)] for v in grid]
            plain = min(tried, key=lambda o: (-score(o), abs(o[c]), o[c]))
    rows = spark.createDataFrame([(int(a), [float(v) for v in b]) for a, b in zip(y, z)], "y int, z array<double>")
    assert S.offset_ascent(rows, "y", "z", 3, grid) == plain
    assert S.offset_ascent(rows.limit(0), "y", "z", 3, grid) == [0.0] * 3


def points(rng, n=300):
    labels = rng.integers(0, 3, n)
    x = rng.normal(0, 1, (n, 6)) @ rng.normal(0, 1, (6, 6)) + labels[:, None] * 2.0
    return labels, x


def test_distances_and_sizes_are_those_of_numpy(spark):
    labels, x = points(np.random.default_rng(11))
    df = spark.createDataFrame([(i, int(a), [float(v) for v in b]) for i, (a, b) in enumerate(zip(labels, x))], "id int, label int, v array<double>")
    centred = x - x.mean(0)
    values, vectors = np.linalg.eigh(centred.T @ centred / len(x))
    order = np.argsort(values)[::-1]
    for k in (2, 4):
        z = x @ vectors[:, order[:k]]
        means = np.array([z[labels == c].mean(0) for c in range(3)])
        within = z - means[labels]
        inverse = np.linalg.inv(within.T @ within / len(z))
        plain = [min(float((p - m) @ inverse @ (p - m)) for m in means) for p in z]
        got = {r["id"]: r["score"] for r in V.mahalanobis(df, df, "id", "label", "v", k).collect()}
        assert np.allclose([got[i] for i in range(len(x))], plain, rtol=1e-6)
    share = np.cumsum(values[order]) / values.sum()
    assert V.components_for(V.components(df, "v", 1)[1], 0.95) == next(i + 1 for i, s in enumerate(share) if s >= 0.95)


def test_embedding_drift_is_that_of_numpy(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (400, 8)) * np.arange(8, 0, -1)
    x[1::2, 0] += 8
    spark.createDataFrame([(i, [float(v) for v in r], 0) for i, r in enumerate(x)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r["component"]: r for r in registry.queries()["d04_embedding_drift"](spark, str(tmp_path)).collect()}
    base = x[::2]
    values, vectors = np.linalg.eigh(np.cov(base.T, bias=True))
    for component in range(5):
        z = x @ vectors[:, np.argsort(values)[::-1][component]]
        a, b = np.sort(z[::2]), np.sort(z[1::2])
        both = np.concatenate([a, b])
        gap = np.abs(np.searchsorted(a, both, "right") / len(a) - np.searchsorted(b, both, "right") / len(b)).max()
        assert got[component]["ks"] == pytest.approx(gap, abs=0.011)  # the sign of a direction may turn ties
    assert got[0]["alert"] and not got[4]["alert"]


def test_a_probe_tells_classes_apart_on_held_out_rows(spark, tmp_path):
    rng = np.random.default_rng(4)
    rows = [(i, [float(v) for v in rng.normal(0, 1, 4) + 2.5 * np.eye(4)[i % 3]], i % 3) for i in range(400)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = registry.queries()["v12_probe"](spark, str(tmp_path)).collect()
    assert sum(r["n"] for r in got) == 100 and min(r["recall"] for r in got) > 0.8


def test_differing_counts_two_nulls(spark):
    rows = spark.createDataFrame(list(itertools.product(["a", "b", None], repeat=2)), "x string, y string")
    assert rows.where(G.differing(F.col("x"), F.col("y"))).count() == 7


def test_samples_are_read_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    now = spark.range(3000).selectExpr("id % 3 as g", "cast(id % 50 as double) as v").mapInArrow(seen, "g long, v double")
    got = S.drift_against(now, ["g"], "v", spark.range(500).selectExpr("cast(id % 60 as double) as v")).collect()
    assert len(got) == 3 and {(r.n_base, r.n_now) for r in got} == {(500, 1000)} and read.value == 3000

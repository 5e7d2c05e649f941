"""Operators on tiny frames: one breakage one gate, nulls, known values, brute force."""

import hashlib
import itertools
import math
import uuid
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeward.functions import columns as C
from lakeward.operators import cdm, cohort, evidence, monitoring, splitting, texts, vectors
from lakeward.operators import gates as G
from lakeward.operators import relational as R
from lakeward.operators import statistics as S

# ---- gates ----------------------------------------------------------------------------

CLEAN = [(i, f"f{i}", "train" if i % 4 else "test", "a" if i % 2 else "b", "CC-0", f"hash{i}") for i in range(12)]
SCHEMA = "id long, lesion string, split string, label string, license string, sha string"
BREAKAGES = {
    "key": lambda r: [*r, r[3][:1] + ("x", "train", "a", "CC-0", "other")],
    "one_split": lambda r: [*r, (99, r[0][1], "val", "a", "CC-0", "other")],
    "labelled": lambda r: [(99, "n", "train", None, "CC-0", "other"), *r],
    "licensed": lambda r: [(99, "n", "train", "a", None, "other"), *r],
    "file_once": lambda r: [*r, (99, "n", "train", "a", "CC-0", r[0][5])],
    "split_known": lambda r: [*r, (99, "n", "later", "a", "CC-0", "other")],
}


def all_gates(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    known = spark.createDataFrame([("train",), ("val",), ("test",)], "name string")
    return G.all_gates(
        G.row_gates(df, {"labelled": F.col("label").isNull(), "licensed": ~G.allowed(F.col("license"), ["CC-0"])}), G.unique_gate(df, "key", ["id"]),
        G.group_gate(df, "one_split", ["lesion"], F.count_distinct("split") > 1), G.unique_gate(df, "file_once", ["sha"]), G.reference_gate(df, "split_known", "split", known, "name"),
    )


def test_clean_rows_pass_all_gates(spark):
    gates = all_gates(spark, CLEAN)
    assert not gates.where("not passed").count()
    G.enforce(gates)


@pytest.mark.parametrize("name", BREAKAGES)
def test_one_breakage_fails_one_gate(spark, name):
    gates = all_gates(spark, BREAKAGES[name](CLEAN))
    assert [r["name"] for r in gates.where("not passed").collect()] == [name]
    with pytest.raises(ValueError, match=name):
        G.enforce(gates)


def test_examples_are_five_and_more(spark):
    df = spark.range(20)
    row = G.violations(df, F.col("id") >= 12, "id", "late").first()
    assert (row["violations"], row["detail"]) == (8, "12, 13, 14, 15, 16 (+3 more)")
    assert G.violations(df, F.col("id") > 99, "id").first()["detail"] == ""
    assert G.violations(df, F.col("id") == 3, "id").first()["detail"] == "3"


def test_profile_counts_nulls(spark):
    rows = {r["column_name"]: (r["row_count"], r["nulls"]) for r in G.profile(spark.createDataFrame([(1, None), (2, "x")], "a int, b string")).collect()}
    assert rows == {"a": (2, 0), "b": (2, 1)}


# ---- relational -----------------------------------------------------------------------


def test_lookup_prefers_the_own_scope(spark):
    mapping = spark.createDataFrame([("all", "a", 1), ("s", "a", 2), ("all", "b", 0)], "scope string, value string, c long")
    df = spark.createDataFrame([("s", "a"), ("t", "a"), ("s", "b"), ("s", "z"), ("s", None)], "sc string, v string")
    assert [r["c"] for r in R.looked_up(df, mapping, "sc", "v", "c").orderBy("sc", F.col("v").asc_nulls_last()).collect()] == [2, 0, None, None, 1]


def test_mode_ties(spark):
    df = spark.createDataFrame([(1, "Nevus NOS"), (1, "Zebra"), (2, "b"), (2, "a"), (3, None), (4, "x NOS"), (4, "x NOS"), (4, "y")], "k int, v string")
    assert {r["k"]: r["v"] for r in R.modes(df, ["k"], "v").collect()} == {1: "Zebra", 2: "a", 4: "x NOS"}


def test_validity_keeps_unpriced_rows(spark):
    usage = spark.createDataFrame([("a", 0), ("a", 5), ("a", 9), ("b", 1)], "k string, t int")
    prices = spark.createDataFrame([("a", 3, 6, 1.0), ("a", 6, None, 2.0)], "k string, f int, u int, p double")
    got = R.valid_at(usage, prices, ["k"], "t", "f", "u").select("k", "t", "p").orderBy("k", "t").collect()
    assert [tuple(r) for r in got] == [("a", 0, None), ("a", 5, 1.0), ("a", 9, 2.0), ("b", 1, None)]


def test_trailing_window_stops_at_enough_or_a_gap(spark):
    rows = [("g", m, n, h) for m, n, h in [(1, 90, 1), (2, 60, 1), (3, 60, 1), (4, 30, 1)]] + [("h", 1, 500, 1), ("h", 2, 50, None), ("h", 3, 20, 1)]
    df = spark.createDataFrame(rows, "g string, m int, n int, h int")
    assert sorted((r["g"], r["m"]) for r in R.trailing_window(df, ["g"], "m", "n", "h", 100).collect()) == [("g", 2), ("g", 3), ("g", 4), ("h", 3)]


def test_islands_and_whole_groups(spark):
    df = spark.createDataFrame([("g", n) for n in (1, 2, 3, 5, 7, 8, 8)], "g string, n int")
    assert sorted((r["first"], r["last"]) for r in R.islands(df, ["g"], "n").collect()) == [(1, 3), (5, 5), (7, 8)]
    units = spark.createDataFrame([(g, i) for g, k in (("a", 3), ("b", 4), ("c", 1)) for i in range(k)], "g string, i int")
    assert {r["g"] for r in R.whole_groups(units, "g", F.col("g"), 6).collect()} == {"a"}


def test_chain_faults_tell_what_is_wrong(spark):
    events = spark.createDataFrame([("u", i, f"body{i}") for i in range(5)], "u string, i int, b string")
    log = R.chained(events, ["u"], ["i"], F.col("b"), 5)
    faults = lambda df: {r["seq"]: (r["gap"], r["broken"], r["edited"]) for r in R.chain_faults(df, ["u"]).where("gap or broken or edited").collect()}
    assert faults(log) == {}
    assert faults(log.withColumn("body", F.when(F.col("seq") == 2, "new").otherwise(F.col("body")))) == {2: (False, False, True)}
    assert faults(log.where("seq <> 2")) == {3: (True, True, False), 4: (True, False, False)}


def test_chains_hold_whole_groups_over_batches(spark):
    rows = [(u, i, None if i == 7 else f"body{i * i % 11}") for u, n in (("hot", 300), (None, 3), ("v", 90)) for i in range(n)]
    setting = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, 32)
    try:
        events = spark.createDataFrame(rows[::-1], "u string, i int, b string")
        got = R.chained(events, ["u"], ["i"], F.col("b")).collect()
        assert R.chain_faults(R.chained(events, ["u"], ["i"], F.col("b")), ["u"]).where("gap or broken or edited").count() == 0
        assert R.chained(events, [], ["u", "i"], F.col("b")).agg(F.max("seq")).first()[0] == len(rows) - 1
        assert R.chained(events, ["u"], ["i"], F.col("b"), 5).count() == 13
    finally:
        spark.conf.set(setting, before)
    wanted, last = set(), {}
    for u, i, b in rows:
        prev = last.get(u, "")
        last[u] = hashlib.sha256("|".join([str(i), prev, *([b] if b is not None else [])]).encode()).hexdigest()
        wanted.add((u, i, prev, b, last[u]))
    assert {tuple(r) for r in got} == wanted and len(got) == len(rows)


def test_multisets_and_history(spark):
    a, b = (spark.createDataFrame([(x,) for x in rows], "x int") for rows in ([1, 1, 2], [1, 2, 3]))
    assert sorted((r["side"], r["x"]) for r in R.multiset_difference(a, b).collect()) == [("left", 1), ("right", 3)]
    kept = spark.createDataFrame([(1, None), (2, 5)], "m int, hits int")
    more = spark.createDataFrame([(1, 7), (2, 9), (3, 4)], "m int, hits int")
    assert {r["m"]: r["hits"] for r in R.history_merged(kept, more, "m", "hits").collect()} == {1: 7, 2: 5, 3: 4}


def test_conformed_order_and_defaults(spark):
    schema = T.StructType([T.StructField("b", T.LongType(), False), T.StructField("a", T.StringType()), T.StructField("c", T.LongType())])
    row = R.conformed(spark.createDataFrame([("x", None)], "a string, b int"), schema).first()
    assert row.asDict() == {"b": 0, "a": "x", "c": None}


# ---- columns --------------------------------------------------------------------------


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_known_values(spark):
    import hashlib

    assert one(spark, C.stable_id(F.lit("img"), F.lit("x"))) == int(hashlib.sha256(b"img|x").hexdigest()[:15], 16)
    low, high = (one(spark, c) for c in C.wilson(F.lit(81), F.lit(100)))
    assert abs(low - 0.7222) < 1e-4 and abs(high - 0.8749) < 1e-4
    assert one(spark, C.band(F.lit(30), [0, 30], ["young", "old"])) == "old" and one(spark, C.band(F.lit(None).cast("int"), [0], ["x"])) == "unknown"
    assert one(spark, C.argmax(F.array(F.lit(1), F.lit(3), F.lit(3)))) == 2
    assert abs(one(spark, C.log_sum_exp(F.array(F.lit(1000.0), F.lit(1000.0)))) - (1000 + math.log(2))) < 1e-9
    assert one(spark, C.cell_text(F.lit("=1+1"))) == "'=1+1" and one(spark, C.ratio(F.lit(1), F.lit(0))) is None
    with pytest.raises(Exception, match="below"):
        one(spark, C.band(F.lit(-1), [0], ["x"]))


# ---- statistics -----------------------------------------------------------------------


def sample(spark, base, now, group="g"):
    return spark.createDataFrame([(group, float(v), True) for v in base] + [(group, float(v), False) for v in now], "g string, v double, base boolean")


def test_equal_samples_do_not_drift(spark):
    row = S.drift(sample(spark, range(200), range(200)), ["g"], "v", "base").first()
    assert row["ks"] == 0 and abs(row["psi"]) < 1e-9 and not row["alert"] and not row["warning"]


def test_a_shift_alerts_but_not_in_a_small_group(spark):
    rows = sample(spark, range(200), range(150, 350)).unionByName(sample(spark, range(200), range(150, 240), "small"))
    got = {r["g"]: r for r in S.drift(rows, ["g"], "v", "base").collect()}
    assert got["g"]["alert"] and not got["small"]["alert"] and not got["small"]["warning"]
    assert abs(got["g"]["ks"] - 0.75) < 1e-12


def test_auroc_counts_ties_by_half(spark):
    rows = spark.createDataFrame([("g", 1.0, False), ("g", 2.0, False), ("g", 2.0, True), ("g", 3.0, True), ("h", 1.0, True)], "g string, v double, p boolean")
    assert {r["g"]: r["auroc"] for r in S.auroc(rows, ["g"], "v", "p").collect()} == {"g": 0.875, "h": None}


def test_chi_square_tail_against_known_points(spark):
    for statistic, freedom, expected in ((3.841459, 1, 0.05), (5.991465, 2, 0.05), (11.07050, 5, 0.05), (16.81189, 6, 0.01), (18.47531, 7, 0.01), (0.0, 3, 1.0)):
        assert abs(one(spark, monitoring.chi_square_tail(F.lit(statistic), F.lit(freedom))) - expected) < 2e-6


def test_class_mix_pools_and_flags_unseen(spark):
    rows = [("m", k, True) for k, n in (("a", 60), ("b", 39), ("c", 1)) for _ in range(n)] + [("m", k, False) for k, n in (("a", 50), ("b", 40), ("d", 10)) for _ in range(n)]
    df = spark.createDataFrame(rows, "m string, k string, base boolean")
    row = monitoring.mix_alert(monitoring.class_mix(df, ["m"], "k", "base").withColumn("n", F.lit(100)), "n").first()
    assert row["unseen"] and row["p"] is None and row["alert"] and abs(row["tvd"] - 0.11) < 1e-9
    # c and d are pooled, and their pool, still small, takes the smallest other cell.
    assert row["cells"] == 2


def test_targets_are_met_broken_or_insufficient(spark):
    rows = [("met", 1, 120, 110), ("broken", 1, 120, 60), ("few", 1, 50, 50), ("gap", 2, 200, None), ("gap", 1, 200, 190)]
    df = spark.createDataFrame(rows, "g string, m int, n int, h int")
    got = {r["g"]: r["status"] for r in monitoring.target_status(df, ["g"], "m", "h", "n", 0.9).collect()}
    assert got == {"met": "met", "broken": "broken", "few": "insufficient", "gap": "insufficient"}


def test_poisson_weights_have_mean_one(spark):
    row = spark.range(4000).select(S.poisson_weight(F.lit(1), F.col("id")).alias("w")).agg(F.avg("w"), F.var_pop("w")).first()
    assert abs(row[0] - 1) < 0.06 and abs(row[1] - 1) < 0.15


def test_splits_keep_shares_and_frozen_keys(spark):
    units = spark.range(1000).select(F.col("id").alias("k"), F.when(F.col("id") % 10 == 0, F.lit(None)).otherwise(F.col("id") % 2).alias("s"))
    frozen = spark.createDataFrame([(1, "test"), (2, "val")], "k long, split string")
    shares = [("train", 0.7), ("val", 0.15), ("test", 0.15)]
    got = {r["k"]: r["split"] for r in splitting.frozen_split(units, frozen, "k", "s", shares).collect()}
    assert got[1] == "test" and got[2] == "val" and got[10] == "unlabelled" and len(got) == 1000
    assert abs(sum(v == "train" for v in got.values()) - 0.7 * 898) < 3
    assert got == {r["k"]: r["split"] for r in splitting.frozen_split(units, frozen, "k", "s", shares).collect()}


def test_components_of_a_line(spark):
    df = spark.createDataFrame([(i, i % 2, [float(i), 2.0 * i, 0.0]) for i in range(50)], "id int, label int, v array<double>")
    directions, values = vectors.components(df, "v", 1)
    assert abs(abs(directions[0] @ [1, 2, 0]) - math.sqrt(5)) < 1e-9 and vectors.components_for(values, 0.95) == 1
    got = vectors.mahalanobis(df, df, "id", "label", "v", 1).collect()
    assert len(got) == 50 and min(r["score"] for r in got) < 0.02


def test_keywords_earliest_then_longest(spark):
    patterns = {"scar": "scar", "scar tissue": "scar tissue", "arm": r"\barm\b"}
    df = spark.createDataFrame([("Scar tissue on the arm",), ("arm and scar",), ("alarm",), (None,)], "t string")
    assert [r["x"] for r in df.select(texts.extracted(F.col("t"), patterns).alias("x")).collect()] == ["scar tissue", "arm", "not stated", "not stated"]


# ---- common data model ----------------------------------------------------------------

RECORDS = "image_id string, source string, lesion_id string, patient_id string, sex string, age double, site_local string, site_1 string, site_2 string, label string, diagnosis string, confirm string"


def test_build_rules_on_a_few_rows(spark):
    rows = [
        ("i1", "main", "L1", None, "male", 40.0, "back", "x", "y", "nv", None, "histo"), ("i2", "main", "L1", "P1", "male", 38.0, None, "x", "y", "nv", None, None),
        ("i3", "site", "L1", None, None, None, "back", "torso", "chest", None, None, "none"),
    ]
    mapping = spark.createDataFrame([("sex", "all", "male", 1, ""), ("site_local", "main", "back", 2, ""), ("site_2", "all", "chest", 3, ""), ("label", "all", "nv", 4, ""), ("confirm", "all", "histo", 5, "")], "field string, scope string, value string, concept_id long, note string")
    built = cdm.build(spark.createDataFrame(rows, RECORDS), mapping, "main")
    t = {k: df.collect() for k, df in built.tables.items()}
    people = {r["person_source_value"]: r for r in t["person"]}
    assert set(people) == {"main:patient:P1", "site:lesion:L1"}
    assert people["main:patient:P1"]["year_of_birth"] == 1962 and people["site:lesion:L1"]["gender_concept_id"] == 0
    assert [r["condition_concept_id"] for r in t["condition_occurrence"]] == [4]
    assert sorted(r["procedure_concept_id"] for r in t["procedure_occurrence"]) == [5] + [cdm.IMAGING_CONCEPT] * 3
    assert sorted((r["site_concept_id"], r["site_field"] or "") for r in t["image_occurrence"]) == [(0, ""), (2, "site_local"), (3, "site_2")]
    assert sum(r["condition_id"] is not None for r in t["image_occurrence"]) == 2
    missing = {tuple(r) for r in cdm.unmapped(built.prepared, built.lesions, mapping).collect()}
    assert missing == {("confirm", "sites", "none")}
    concepts = spark.createDataFrame([(c,) for c in (1, 2, 3, 4, 5, cdm.IMAGING_CONCEPT)], "concept_id long")
    failed = [r["name"] for r in cdm.concept_gates(built, mapping, concepts).where("not passed").collect()]
    assert failed == ["every_value_mapped"]


# ---- cohorts --------------------------------------------------------------------------

RAW = {"name": "c", "version": 1, "title": "t", "index": {"condition_concept_ids": [3, 1, 1]}, "include": [{"procedure_concept_ids": [7]}]}


def test_definitions_are_allowlisted():
    d = cohort.defined(RAW)
    assert d.conditions == (1, 3) and d.digest == cohort.defined({**RAW, "index": {"condition_concept_ids": [1, 3]}}).digest
    assert d.digest != cohort.defined({**RAW, "title": "other"}).digest
    bad = [
        {**RAW, "sql": "drop"}, {**RAW, "version": 0}, {**RAW, "version": True}, {**RAW, "index": {"condition_concept_ids": ["1; drop"]}}, {**RAW, "index": {"condition_concept_ids": []}},
        {**RAW, "index": {"condition_concept_ids": [1], "age_min": 60, "age_max": 20}}, {**RAW, "index": {"condition_concept_ids": [1], "age_min": 121}}, {**RAW, "include": [{"drug_ids": [1]}]},
        {**RAW, "include": [{"procedure_concept_ids": [1], "condition_concept_ids": [1]}]}, {**RAW, "breakdown": ["postcode"]}, {k: v for k, v in RAW.items() if k != "title"},
    ]
    for raw in bad:
        with pytest.raises(cohort.DefinitionError):
            cohort.defined(raw)
    assert cohort.library({"c/v1": RAW})["c/v1"].digest == d.digest
    with pytest.raises(cohort.DefinitionError):
        cohort.library({"c/v2": RAW})


def shown_steps(spark, values):
    steps = spark.createDataFrame([(i, n) for i, n in enumerate(values)], "step int, persons long")
    return [r["shown"] for r in cohort.suppressed_steps(steps).orderBy("step").collect()]


def test_attrition_hides_small_steps_and_drops(spark):
    assert shown_steps(spark, [100, 95, 60, 5, 0]) == ["100", "<11", "60", "<11", "0"]
    assert shown_steps(spark, [100, 92, 85]) == ["100", "<11", "85"]
    assert shown_steps(spark, [10, 10]) == ["<11", "<11"]


def test_breakdowns_never_show_a_small_cell(spark):
    for values in itertools.product([0, 4, 11, 30], repeat=2):
        cells = spark.createDataFrame([(i, n) for i, n in enumerate(values)], "k int, persons long")
        shown, total = cohort.suppressed_breakdown(cells, sum(values), True)
        texts_shown = [r["shown"] for r in shown.orderBy("k").collect()]
        assert not any(t.isdigit() and 1 <= int(t) <= 10 for t in texts_shown)
        if total and "<11" in texts_shown:
            # With the total known, every hidden cell may still be above ten.
            assert sum(values) >= 10 + texts_shown.count("<11")
            assert all(t in ("<11", "0") for t in texts_shown)


def cohort_tables(spark, n=40):
    person = spark.createDataFrame([(i, 1 + i % 2, 1950 + i) for i in range(n)], "person_id long, gender_concept_id long, year_of_birth int")
    at = datetime(2000, 1, 1)
    condition = spark.createDataFrame([(i, 1, at) for i in range(n)] + [(0, 3, datetime(1990, 1, 1))], "person_id long, condition_concept_id int, start_date timestamp")
    procedure = spark.createDataFrame([(i, 7) for i in range(0, n, 2)], "person_id long, procedure_concept_id int")
    return {"person": person, "condition_occurrence": condition, "procedure_occurrence": procedure}


def test_attrition_counts_what_the_tables_hold(spark):
    tables = cohort_tables(spark)
    got = [tuple(r) for r in cohort.attrition(tables, cohort.defined(RAW)).orderBy("step").collect()]
    assert got == [(0, "index", 40), (1, "include procedure_concept_ids 7", 20)]
    young = cohort.defined({**RAW, "index": {"condition_concept_ids": [1], "age_max": 20}})
    assert cohort.attrition(tables, young).where("step = 0").first()["persons"] == 10
    assert cohort.index_people(tables, cohort.defined(RAW)).where("person_id = 0").first()["age"] == 40


def test_service_needs_approval_and_keeps_its_log(spark):
    service = cohort.Service(spark, cohort_tables(spark), most=1)
    with pytest.raises(cohort.Refused):
        service.run(RAW, "someone")
    d = cohort.defined(RAW)
    service.decide(d, "approve", "r", "fine")
    service.decide(d, "escalate", "r", "ask")
    assert [r["shown"] for r in service.run(RAW, "someone").orderBy("release").collect()] == ["40", "20"]
    service.decide(cohort.defined({**RAW, "name": "d"}), "approve", "r", "fine")
    with pytest.raises(cohort.Refused):
        service.run({**RAW, "name": "d"}, "someone")
    assert service.audit.faults() == [] and [e["event"] for e in service.audit.entries].count("refused") == 2
    service.audit.entries[1]["reason"] = "changed"
    assert service.audit.faults() == ["1: edited"]


def test_service_counts_earlier_releases_again_in_grown_tables(spark):
    wide, narrow = {**RAW, "include": []}, {**RAW, "name": "n", "include": [], "exclude": [{"procedure_concept_ids": [8]}]}

    def final(n, first):
        service = cohort.Service(spark, cohort_tables(spark))
        for raw in (wide, narrow):
            service.decide(cohort.defined(raw), "approve", "r", "fine")
        if first:
            service.run(wide, "someone")
        with pytest.raises(cohort.DefinitionError):
            service.run({**wide, "sql": "drop"}, "someone")
        with pytest.raises(cohort.Refused):
            service.run({**wide, "title": "never approved"}, "someone")
        at = datetime(2000, 1, 1)
        tables = cohort_tables(spark, n)
        tables["procedure_occurrence"] = spark.createDataFrame([(i, 8, at) for i in range(n - 34)], "person_id long, procedure_concept_id int, start_date timestamp")
        service.tables = tables
        return [r["shown"] for r in service.run(narrow, "someone").orderBy("release").collect()]

    # 6 of 40 people are left out, a small difference; of 60 people 26 are.
    assert final(40, True) == ["40", "<11"] and final(60, True) == ["60", "34"]


# ---- evidence -------------------------------------------------------------------------


def test_leaves_stale_files_and_manifests(spark):
    documents = [(1, '{"a": {"b": [1, true, {"c": 2.5}]}, "d": "3", "e": null}'), (2, "[7, [8]]"), (3, "5"), (4, "no json"), (5, None), (6, "{}")]
    found = evidence.leaves(spark.createDataFrame(documents, "k int, doc string"), "k", "doc").collect()
    assert sorted(map(tuple, found)) == [(1, "a.b[0]", 1.0), (1, "a.b[2].c", 2.5), (2, "[0]", 7.0), (2, "[1][0]", 8.0), (3, "", 5.0)]
    files = spark.createDataFrame([("a", b"x"), ("b", b"y")], "name string, content binary")
    index = files.select("name", F.sha2("content", 256).alias("sha256"))
    assert all(r["passed"] for r in evidence.manifest_gates(index, files).collect())
    worse = index.unionByName(spark.createDataFrame([("../c", "0"), ("a", "0")], "name string, sha256 string"))
    assert {r["name"]: r["violations"] for r in evidence.manifest_gates(worse, files).collect()} == {"plain_name": 1, "listed_once": 1, "as_hashed": 2}
    assert sorted(tuple(r) for r in evidence.stale(files, worse).collect()) == [("../c", "missing"), ("a", "changed")]


def test_identifiers_are_stable(spark):
    rows = evidence.with_uid(spark.createDataFrame([("k",), ("k",), (None,)], "key string"), "key").collect()
    assert rows[0]["uid"] == rows[1]["uid"] == f"2.25.{uuid.uuid5(evidence.NAMESPACE, 'k').int}" and rows[0]["uid"].startswith("2.25.") and rows[2]["uid"] is None


def test_largest_of_a_key_goes_to_all_of_its_rows(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "c"), (None, "b"), (None, None), (2, None)], "k int, v string")
    got = R.with_largest(rows, "k", "v", "top")
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", "c"), (1, "c", "c"), (None, "b", "b"), (None, None, "b"), (2, None, None)], key=str)
    assert "Window" not in got._jdf.queryExecution().optimizedPlan().toString()

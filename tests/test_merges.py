"""As-of merge, containment and phrases against plain versions, and their plans."""

import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from lakeward.operators import asof, containment, phrases


def plan(df):
    return df._jdf.queryExecution().explainString(df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


# ---- as-of ----------------------------------------------------------------------------

ROWS, SPANS = "id long, k string, g long, t long", "k string, g long, since long, until long, price double"


def spans(rng, key, n, most=200):
    cuts = sorted(rng.sample(range(most), 2 * n))
    if rng.random() < 0.5:  # each ends where the next begins
        out = [(*key, a, b, float(a)) for a, b in zip(cuts, [*cuts[1:], None], strict=True)]
    else:
        out = [(*key, a, b, float(a)) for a, b in zip(cuts[::2], cuts[1::2], strict=True)]
    return out


@pytest.mark.parametrize("large", [3, 10, 10**6])
def test_each_row_meets_the_interval_that_holds_it(spark, large):
    rng = random.Random(large)
    keys = [("a", 1), ("a", 2), ("b", 1), ("c", 3)]
    held = [s for k in keys[:3] for s in spans(rng, k, rng.randint(1, 30))]
    rows = [(i, *rng.choice(keys), rng.randrange(-5, 210)) for i in range(800)] + [(900, None, 1, 5), (901, "a", 1, None), (902, "a", 1, 5), (902, "a", 1, 5)]
    odd = [(None, 1, 0, None, 1.0), ("c", 3, None, 9, 1.0)]
    got = asof.valid_at(spark.createDataFrame(rows, ROWS), spark.createDataFrame(held + odd, SPANS), ["k", "g"], "t", "since", "until", large)
    assert got.columns == ["id", "k", "g", "t", "since", "until", "price"]

    def valid(k, g, t):
        found = [s for s in held if s[:2] == (k, g) and t is not None and s[2] <= t and (s[3] is None or t < s[3])]
        return found[0][2:] if found else (None,) * 3

    assert Counter(map(tuple, got.collect())) == Counter((i, k, g, t, *valid(k, g, t)) for i, k, g, t in rows)


def test_no_interval_and_no_row(spark):
    rows, none = spark.createDataFrame([(1, "a", 1, 5)], ROWS), spark.createDataFrame([], SPANS)
    assert [tuple(r)[4:] for r in asof.valid_at(rows, none, ["k", "g"], "t", "since", "until").collect()] == [(None, None, None)]
    assert not asof.valid_at(rows.limit(0), none, ["k", "g"], "t", "since", "until").count()
    held = spark.createDataFrame([("a", 1, 0, 5, 1.0), ("a", 1, 4, 9, 2.0), ("a", 1, 9, None, 3.0), ("b", 1, 0, None, 1.0), ("b", 1, 2, 3, 1.0)], SPANS)
    assert sorted((r.k, r.since) for r in asof.overlapping(held, ["k", "g"], "since", "until").collect()) == [("a", 4), ("b", 2)]


def test_a_hot_key_is_many_tasks_and_no_product(spark):
    n, m = 1_000_000, 10_000
    rows = spark.range(n).select("id", F.lit("a").alias("k"), F.lit(1).cast("long").alias("g"), F.pmod(F.xxhash64("id"), F.lit(10 * m)).alias("t"))
    held = spark.range(m).select(F.lit("a").alias("k"), F.lit(1).cast("long").alias("g"), (F.col("id") * 10).alias("since"), (F.col("id") * 10 + 7).alias("until"), F.col("id").cast("double").alias("price"))
    got = asof.valid_at(rows, held, ["k", "g"], "t", "since", "until")
    text = plan(got)
    assert "Cartesian" not in text and "NestedLoop" not in text
    assert all(line.strip().endswith("None") for line in re.findall(r"Join condition:.*", text))
    right = got.agg(F.count("*"), F.count_if(F.coalesce(F.col("price") == F.floor(F.col("t") / 10), F.lit(False)) == (F.col("t") % 10 < 7))).first()
    assert tuple(right) == (n, n)


# ---- containment ----------------------------------------------------------------------


def test_every_contained_pair_is_found(spark):
    rng = random.Random(4)
    sets = {f"s{i}": frozenset(rng.sample(range(12), rng.randint(1, 9))) for i in range(60)}
    small = {f"q{i}": frozenset(rng.sample(range(14), rng.randint(1, 3))) for i in range(40)}
    flat = lambda held: [(n, e) for n, s in held.items() for e in s]
    inner = spark.createDataFrame([*flat(small), ("q0", min(small["q0"])), (None, 1), ("empty", None)], "q string, e long")
    outer = spark.createDataFrame([*flat(sets), ("s0", min(sets["s0"])), (None, 2)], "s string, e long")
    got = containment.contained(inner, outer, "q", "s", "e")
    want = Counter((q, s, len(b) - len(a)) for q, a in small.items() for s, b in sets.items() if a <= b)
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100
    assert "NestedLoop" not in plan(got) and "Cartesian" not in plan(got)
    assert not containment.contained(inner.limit(0), outer, "q", "s", "e").count()


def test_candidates_are_those_of_the_rarest_element(spark):
    outer = spark.createDataFrame([(f"s{i}", e) for i in range(200) for e in ([0, 1] if i < 3 else [0])], "_outer string, _element long")
    inner = spark.createDataFrame([("q", 0), ("q", 1), ("none", 0), ("none", 7)], "_inner string, _element long")
    got = containment.candidates(inner, outer).collect()
    assert sorted((r._inner, r._outer) for r in got) == [("q", "s0"), ("q", "s1"), ("q", "s2")]


def test_sets_without_the_other_elements_are_left_out_where_they_are_looked_up(spark):
    outer = spark.createDataFrame([(s, e) for s in range(4000) for e in (s % 100, 100 + s // 100)], "_outer long, _element long")
    inner = spark.createDataFrame([(s, e) for s in range(0, 4000, 7) for e in (s % 100, 100 + s // 100)], "_inner long, _element long")
    got = {(r._inner, r._outer) for r in containment.candidates(inner, outer).collect()}
    assert {(s, s) for s in range(0, 4000, 7)} <= got and len(got) < 0.6 * 40 * 572  # 40 sets hold the rarest element of each
    pairs = containment.contained(inner.toDF("a", "e"), outer.toDF("b", "e"), "a", "b", "e").collect()
    assert sorted(map(tuple, pairs)) == [(s, s, 0) for s in range(0, 4000, 7)]
    assert not containment.contained(inner.toDF("a", "e"), outer.toDF("b", "e"), "a", "b", "e", least=3).count()


# ---- phrases --------------------------------------------------------------------------


def plain_first(text, vocabulary, whole):
    hits = []
    for place, (label, words) in enumerate(vocabulary.items()):
        for w in words:
            edge = r"\b" if whole else ""
            found = re.search(edge + re.escape(w) + edge, text or "", re.I)
            if found and w.strip():
                hits.append((found.start(), -len(found.group(0)), place, label))
    return min(hits)[3] if hits else phrases.NOT_STATED


@pytest.mark.parametrize("whole", [True, False])
def test_the_earliest_then_longest_then_first_label(spark, whole):
    rng = random.Random(6)
    words = ["ab", "aba", "b", "ba b", "cab", "c", "b c", "über", "a"]
    vocabulary = {f"l{i}": rng.sample(words, 2) for i in range(7)} | {"blank": [" ", ""]}
    texts = [" ".join(rng.choice(["ab", "aba", "B", "ba", "c", "Cab", "Über", "x", "_b", "b2", "é"]) for _ in range(rng.randint(0, 6))) for _ in range(400)] + [None, "", " "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = {r.id: r.label for r in phrases.extracted(df, "t", vocabulary, whole=whole).collect()}
    assert got == {i: plain_first(t, vocabulary, whole) for i, t in enumerate(texts)}
    assert {r.label for r in phrases.extracted(df, "t", {}).collect()} == {phrases.NOT_STATED}


def test_a_hundred_thousand_phrases_are_one_pass(spark):
    vocabulary = {f"l{i}": [f"word{i} next{i % 7}"] for i in range(100_000)}
    texts = spark.range(2000).select("id", F.concat(F.repeat(F.lit("some other words "), 200), F.lit("word"), F.col("id") * 37, F.lit(" next"), F.col("id") * 37 % 7).alias("t"))
    began = time.time()
    rows = phrases.extracted(texts, "t", vocabulary).collect()
    assert all(r.label == f"l{r.id * 37}" for r in rows if r.id * 37 < 100_000) and time.time() - began < 60
    with pytest.raises(ValueError, match="at most"):
        phrases.extracted(texts, "t", {"a": ["long phrase"]}, most=5)
    with pytest.raises(ValueError, match="at most"):
        phrases.vocabulary(spark.createDataFrame([("a", "long phrase")], "l string, p string"), "l", "p", 5)
    assert phrases.vocabulary(spark.createDataFrame([("b", "y"), ("a", "x"), ("a", "x"), (None, "z")], "l string, p string"), "l", "p") == {"a": ["x"], "b": ["y"]}

"""Mixing, sharding, top-k and the pipeline against plain versions."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import DOCS, corpus, frame, prose
from pyspark.sql import functions as F

from lakeward.llm import decontaminate, mixing, sharding, simhash, topk

corpus_pipeline = pytest.importorskip("corpus_pipeline")


# ---- mixing ---------------------------------------------------------------------------


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def plain_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = float(sum(sizes.values())), set(names), {}
    while free:
        share = left / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * share > most * sizes[s]}
        if not over:
            return target | {s: weight[s] * share for s in free}
        for s in over:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= over
    return target


def test_mix_meets_its_targets(spark):
    docs = corpus()[:-1]
    rows = mixing.mix(frame(spark, docs)).collect()
    sizes = defaultdict(int)
    for _, t, _, s, _ in docs:
        sizes[s] += size_of(t)
    target = plain_targets(dict(sizes))
    assert len(rows) == len(docs)
    by_id = {}
    taken = defaultdict(int)
    for r in rows:
        assert r.taken <= 3 * r.size and (r.size == 0 or r.taken % r.size == 0)
        by_id[r.doc_id] = r
    for d, t, _, s, _ in docs:
        r = by_id[d]
        assert r.size == size_of(t) and r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
        taken[s] += r.taken
    longest = max(size_of(t) for _, t, *_ in docs)
    assert all(abs(taken[s] - target[s]) <= 2 * longest for s in sizes)
    assert sum(taken.values()) <= sum(sizes.values())
    assert Counter(map(tuple, rows)) == Counter(map(tuple, mixing.mix(frame(spark, docs)).collect()))


def test_mixed_repeats_rows_as_taken(spark):
    docs = frame(spark, corpus()[:-1])
    taken = Counter()
    for r in mixing.mix(docs).collect():
        taken[r.doc_id] += r.taken // r.size if r.size else 0
    out = mixing.mixed(docs)
    assert out.columns == docs.columns
    assert Counter(r.doc_id for r in out.collect()) == +taken
    assert not mixing.mixed(frame(spark, [])).count() and not mixing.mix(frame(spark, [])).count()


def test_capped_sources_give_their_excess_away(spark):
    rows = [(i, prose(i, 50), "en", "a" if i < 2 else "b" if i < 10 else "c", 1) for i in range(60)]
    got = {r.doc_id: r for r in mixing.mix(frame(spark, rows)).collect()}
    assert got[0].target == 3 * 100 and got[5].target == 3 * 400
    assert abs(got[20].target - (3000 - 300 - 1200)) < 1e-6


def test_a_key_of_many_rows_is_many_buckets(spark, monkeypatch):
    rng = np.random.default_rng(5)
    docs = [(int(i) if i % 3 else None, " ".join(["w"] * int(rng.integers(0, 9))), "en", f"s{i % 2}", 1) for i in range(600)]
    docs += [(77, " ".join(["w"] * int(rng.integers(1, 5))), "en", "s0", 1) for _ in range(200)]
    df = frame(spark, docs).repartition(5)
    plain = Counter(map(tuple, mixing.mix(df).collect()))
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    assert Counter(map(tuple, mixing.mix(df).collect())) == plain
    rows = df.select("doc_id", "source", mixing.word_count(F.col("text")).alias("size"), F.spark_partition_id().alias("_lot"))
    rows = rows.withColumn("_key", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")))
    held = mixing.bucketed(rows, 3, 20).groupBy("source", *mixing.BUCKET).count()
    assert held.agg(F.max("count")).first()[0] <= 20  # and not the 200 rows without an id
    order = [F.col(c) for c in mixing.BUCKET]
    by_bucket = [(r["_key"], r["size"]) for r in mixing.bucketed(rows, 1, 20).orderBy(*order, "_key", "size").collect()]
    assert by_bucket == sorted(by_bucket)


# ---- sharding -------------------------------------------------------------------------


def test_shards_are_even_whole_and_gapless(spark):
    docs = corpus(n=200)[:-1] + [(1000 + i, "the same text " * 30, "en", "s", 1) for i in range(60)]
    rows = sharding.shard(frame(spark, docs)).collect()
    assert len(rows) == len(docs)
    sizes, slots = Counter(), defaultdict(list)
    for r in rows:
        sizes[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert set(sizes) <= set(range(16)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    mean = sum(sizes.values()) / 16
    largest = max(r.size for r in rows)
    assert all(abs(sizes[k] - mean) <= 2 * largest for k in range(16))
    texts = {d: t for d, t, *_ in docs}
    for r in rows:
        data = (texts[r.doc_id] or "").encode()
        assert r.size == len(data) + 1 and r.grown_shard is None and r.law == "bytes"
        assert r.text_crc32 == (None if texts[r.doc_id] is None else zlib.crc32(data))
    assert Counter(map(tuple, rows)) == Counter(map(tuple, sharding.shard(frame(spark, docs)).collect()))
    assert not sharding.shard(frame(spark, [])).count()


def test_small_groups_of_equal_texts_stay_together(spark):
    docs = [(i, prose(i // 2, 20), "en", "s", 1) for i in range(4000)]
    rows = sharding.shard(frame(spark, docs)).collect()
    where = defaultdict(set)
    for r in rows:
        where[r.doc_id // 2].add(r.shard)
    assert all(len(s) == 1 for s in where.values())


def test_a_group_is_divided_beyond_the_limit_and_not_before(spark):
    def shards(copies):
        docs = [(i, prose(i, 20), "en", "s", 1) for i in range(3000)] + [(10_000 + i, "ten bytes.", "en", "s", 1) for i in range(copies)]
        total = sum(len(t) + 1 for _, t, *_ in docs)
        rows = sharding.shard(frame(spark, docs)).where("doc_id >= 10000").collect()
        return 11 * copies <= total // (16 * 64), {r.shard for r in rows}

    within, one = shards(10)
    beyond, many = shards(4000)
    assert within and len(one) == 1 and not beyond and len(many) > 1


def test_range_of_counts_boundaries(spark):
    cuts = [f"{i:03d}" for i in range(3, 300, 7)]
    rows = spark.range(310).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("k"))
    got = rows.select("k", sharding.range_of(F.col("k"), cuts).alias("r")).orderBy("k").collect()
    places = [r.r for r in got]
    assert places == sorted(places)
    for a, b in zip(got, got[1:]):
        assert (a.r == b.r) == (sum(c < a.k for c in cuts) == sum(c < b.k for c in cuts))
    for step in (2, 5, 40):
        small = rows.select("k", sharding.range_of(F.col("k"), cuts, step).alias("r")).orderBy("k").collect()
        assert [r.r for r in small] == places


# ---- top-k ----------------------------------------------------------------------------


def plain_top(vectors, k=5):
    whole = {}
    rows = []
    for vec, v in vectors:
        if vec is None or v is None or any(x is None or not np.isfinite(x) for x in v):
            continue
        rows.append((vec, [int(np.floor(256 * float(np.float32(x)))) for x in v]))
    for q, a in rows:
        if q % 50 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b)), c) for c, b in rows if c != q)
            whole[q] = [(c, -s) for s, c in scored[:k]]
    return whole


def test_top_k_of_brute_force(spark):
    rng = np.random.default_rng(2)
    vectors = [(i, rng.normal(size=8).astype("float32").tolist()) for i in range(400)]
    vectors += [(i, vectors[7][1]) for i in range(400, 460)]  # copies: ties go to the smaller id
    vectors += [(500, None), (550, [1.0, None] + [0.0] * 6), (600, [float("nan")] * 8), (650, [float("inf")] + [0.0] * 7), (None, [0.5] * 8)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>").selectExpr("*", "1 AS shard", "'x' AS block")
    expected = plain_top(vectors)
    for shard_rows, block_rows in ((10_000, 10_000), (60, 3)):
        got = defaultdict(list)
        for r in topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=shard_rows, block_rows=block_rows).orderBy("query_id", "rank").collect():
            assert r.rank == len(got[r.query_id]) + 1
            got[r.query_id].append((r.vec_id, r.score))
        assert dict(got) == expected
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert not topk.top_k(empty, F.col("vec_id") % 50 == 0).count()


def test_shards_whose_balls_are_too_far_are_not_asked(spark, monkeypatch):
    rng = np.random.default_rng(5)
    centres = np.eye(8) * 3
    vectors = [(i, (centres[i % 8] + rng.normal(0, 0.02, 8)).astype("float32").tolist()) for i in range(1600)]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<float>")
    asked, searched = [], topk._searched
    monkeypatch.setattr(topk, "_searched", lambda trees, pairs, *rest: asked.append(pairs.count()) or searched(trees, pairs, *rest))
    got = defaultdict(list)
    for r in topk.top_k(df, F.col("vec_id") % 50 == 0, shard_rows=100, rounds=(1, 2)).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    assert dict(got) == plain_top(vectors)
    # 32 queries and at least 16 shards; all but those of a query's own cluster are left out.
    assert asked[0] == 32 and sum(asked) <= 32 * 5


def test_large_components_are_exact(spark):
    vectors = [(0, [1e7, 1.0]), (1, [1e7, 0.5]), (2, [1e7, 0.25]), (3, [-1e7, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    got = [(r.vec_id, r.score) for r in topk.top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()]
    q = [[int(np.floor(256 * x)) for x in v] for _, v in vectors]
    assert got == sorted([(c, sum(a * b for a, b in zip(q[0], q[c]))) for c in (1, 2, 3)], key=lambda p: -p[1])


# ---- pipeline -------------------------------------------------------------------------


def test_stages_keep_their_contracts(spark, tmp_path):
    junk = [(2000 + i, "### $$$ " * 40, "en", "s0", 1) for i in range(20)]
    rows = [(i, prose(i, 120), "en", f"s{i % 3}", 1) for i in range(200)] + junk
    rows += [(300, rows[4][1], "en", "s1", 1), (301, prose(999, 40) + " tail", "en", "s1", 1)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 200, 2)] + [(2000 + i, 0, 0) for i in range(20)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(999, 40))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "shards":
            assert out.columns == docs.columns
            out.write.parquet(f"{tmp_path}/{name}")
            docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen.append(Counter(r.doc_id for r in out.collect()))
    quality, near, clean, mix, shards = seen
    assert not any(d >= 2000 for d in quality) and len(quality) > 190
    assert 300 not in near and 4 in near and len(near) == len(quality) - (300 in quality)
    assert 301 not in clean and len(clean) == len(near) - (301 in near)
    assert set(mix) <= set(clean) and max(mix.values()) <= 3 and shards == mix
    ran = corpus_pipeline.run(spark, str(tmp_path))
    assert Counter(r.doc_id for r in ran.collect()) == shards


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name, schema in (("documents", DOCS), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert not corpus_pipeline.run(spark, str(tmp_path)).count()
    assert simhash and decontaminate

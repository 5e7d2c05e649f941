"""Files, REST pages, versions and streams."""

import json
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from lakeward.operators.views import AggregateView
from lakeward.sources import files, rest
from lakeward.streaming import events as E


def pages(address):
    """What a server would answer: three pages of a collection."""
    n = int(address.rsplit("=", 1)[1])
    return {"results": [{"id": n * 10 + i} for i in range(2)], "next": f"https://host/a?page={n + 1}" if n < 3 else None}


def stray(address):
    return {"results": [], "next": "https://elsewhere/a?page=2"}


def test_rest_pages_follow_only_their_own_host(spark):
    spark.dataSource.register(rest.RestCollection)
    read = lambda name: spark.read.format("rest_collection").options(start="https://host/a?page=1", pages=f"test_sources:{name}").load()
    assert sorted(json.loads(r["record"])["id"] for r in read("pages").collect()) == [10, 11, 20, 21, 30, 31]
    with pytest.raises(Exception, match="another host"):
        read("stray").collect()
    assert not rest.same_host("https://host/a", "http://host/b")


def test_versions_are_kept_checked_and_restored(spark, tmp_path):
    t = files.VersionedTable(spark, str(tmp_path / "t"))
    t.create(spark.range(3))
    with pytest.raises(ValueError):
        t.create(spark.range(1))
    t.write(t.read().where("id > 0"))

    def refuse(df):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        t.write(spark.range(9), check=refuse)
    assert t.versions() == [1, 2] and t.read().count() == 2 and t.read(1).count() == 3
    t.restore(1)
    assert t.read().count() == 3
    t.append(spark.range(2, 6), "id", parent=spark.range(10).withColumnRenamed("id", "p"), parent_key="p")
    assert sorted(r["id"] for r in t.read().collect()) == [0, 1, 2, 3, 4, 5]
    with pytest.raises(ValueError):
        t.append(spark.range(50, 51), "id", parent=spark.range(10).withColumnRenamed("id", "p"), parent_key="p")


def test_binary_and_json_streams(spark, tmp_path):
    (tmp_path / "in/site1").mkdir(parents=True)
    (tmp_path / "in/site1/img7.jpg").write_bytes(b"abc")
    out = files.binary_stream(spark, str(tmp_path / "in")).drop("content").writeStream.format("memory").queryName("bin").trigger(availableNow=True).start()
    out.awaitTermination()
    row = spark.table("bin").first()
    assert (row["source"], row["key"], row["bytes"]) == ("site1", "img7", 3) and row["sha256"].startswith("ba7816bf")
    (tmp_path / "j").mkdir()
    for name, state in (("a.json", "old"), ("b.json", "new")):
        (tmp_path / "j" / name).write_text(json.dumps({"id": 1, "state": state}) + "\n")
    rows = files.json_lines(spark, str(tmp_path / "j"), "id long, state string", stream=False)
    assert files.last_per_key(rows, "id").first()["state"] == "new"
    good, bad = files.quarantined(rows.withColumn("error", F.when(F.col("state") == "old", "stale")), "error")
    assert good.count() == bad.count() == 1


def test_rate_limit_over_a_stream(spark, tmp_path):
    start = datetime(2024, 1, 1)
    rows = [(i, 7 if i < 6 else 8, start + timedelta(seconds=20 * i)) for i in range(8)]
    spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp").write.parquet(str(tmp_path / "e"))
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = E.event_stream(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema)
        run = E.rate_limited(stream, "user_id", 2, 60).writeStream.format("memory").queryName("limit").outputMode("append").trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.set(key, before)
    got = {r["event_id"]: r["passed"] for r in spark.table("limit").collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True, 5: False, 6: True, 7: True}


def test_duplicates_within_the_watermark_are_dropped(spark, tmp_path):
    at = datetime(2024, 1, 1)
    spark.createDataFrame([(1, at, 1.0), (1, at, 1.0), (2, at, 2.0)], "event_id long, ts timestamp, value double").write.parquet(str(tmp_path / "e"))
    stream = E.distinct_events(E.event_stream(spark, str(tmp_path / "e"), spark.read.parquet(str(tmp_path / "e")).schema), "event_id")
    run = stream.writeStream.format("memory").queryName("distinct_e").trigger(availableNow=True).start()
    run.awaitTermination()
    assert spark.table("distinct_e").count() == 2


def test_a_view_is_refreshed_from_new_rows_alone(spark, tmp_path):
    schema = "k string, v long"
    parts = [[("a", 1), ("a", 2), (None, 5)], [("b", 7), ("a", None)], []]
    view = AggregateView(spark, f"{tmp_path}/view", ["k"], ["v"])
    versions = [view.fill(spark.createDataFrame(parts[0], schema))]
    versions += [view.refresh(spark.createDataFrame(p, schema)) for p in parts[1:]]
    held = [{r.k: (r.n, r.v) for r in view.read(v).collect()} for v in versions]
    assert held == [{"a": (2, 3), None: (1, 5)}, {"a": (3, 3), None: (1, 5), "b": (1, 7)}, {"a": (3, 3), None: (1, 5), "b": (1, 7)}]
    with pytest.raises(ValueError, match="already"):
        view.fill(spark.createDataFrame(parts[0], schema))
    with pytest.raises(Exception):  # noqa: B017
        view.refresh(spark.createDataFrame([("c", 1)], schema).select("k", F.raise_error(F.lit("broken")).cast("long").alias("v")))
    assert view.held.versions() == versions

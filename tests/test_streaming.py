"""Streams against the same operators over all rows at once, with late rows and bounds."""

import datetime
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakeward.operators import statistics as S
from lakeward.streaming import drift, labels, limits

EVENTS = "ts timestamp, kind string, value double"
START = datetime.datetime(2024, 3, 1)


def at(hours):
    return START + datetime.timedelta(hours=hours)


def fed(spark, folder, schema, batches, time, delay, name):
    """A stream that reads each batch as one micro-batch, in order."""
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}/{i:03}")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{folder}/{name}")
    return stream.withWatermark(time, delay)


def run(stream, folder):
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start(f"{folder}/out")
    query.awaitTermination()
    return query, stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out")


# ---- drift ----------------------------------------------------------------------------


def sample(rng, hours, n, shift=0.0, kind="a"):
    return [(at(hours + rng.random() * 24), kind, rng.gauss(shift, 1)) for _ in range(n)]


def scores(df):
    return {(r.start, r.kind): (r.n_now, round(r.ks, 9), round(r.psi, 6), r.alert, r.warning) for r in df.collect()}


def test_late_rows_move_their_own_window_only(spark, tmp_path):
    rng = random.Random(1)
    base = spark.createDataFrame(sample(rng, 0, 300), EVENTS)
    known = drift.summary(base, "kind", "value")
    day = [sample(rng, 24 * d, 150, 0.8 * (d == 3)) for d in range(1, 6)]
    late = [(at(50 + i / 10), "a", 9.0) for i in range(40)]
    gone = [(at(25), "a", 9.0)] * 60
    closing = [(at(24 * 30), "a", None), (at(24 * 30), "a", float("nan")), (at(24 * 30), "a", 0.0)]

    def streamed(name, batches):
        held = drift.windows(fed(spark, tmp_path / name, EVENTS, batches, "ts", "30 hours", "in"), "ts", "kind", "value", "1 day")
        return run(drift.scored(held, known, "kind"), tmp_path / name)

    # Once day 3 has been read the watermark has passed day 1; rows are measured by that of the batch before.
    query, out = streamed("late", [[*day[0], *day[1]], day[2], [*day[3], *late], [*day[4], *gone], closing])
    _, plain = streamed("plain", [[*day[0], *day[1]], day[2], day[3], day[4], closing])
    got, without = scores(out), scores(plain)
    everything = spark.createDataFrame([x for d in day for x in d] + late, EVENTS)
    batch = scores(drift.scored(drift.windows(everything, "ts", "kind", "value", "1 day"), known, "kind"))
    assert got == batch and len(got) == 5
    moved = {k for k in got if got[k] != without[k]}
    assert moved == {(at(48), "a")} and got[at(48), "a"][0] == without[at(48), "a"][0] + 40
    assert got[at(72), "a"][3] and not without[at(48), "a"][3]
    assert sum(s["numRowsDroppedByWatermark"] for p in query.recentProgress for s in p["stateOperators"]) > 0


def test_sketches_are_exact_while_they_hold_all_values(spark):
    rng = random.Random(2)
    base, now = ([(at(1), "a", round(rng.gauss(m, 1), 1)) for _ in range(n)] for m, n in ((0, 700), (0.3, 400)))
    held = drift.windows(spark.createDataFrame(now, EVENTS), "ts", "kind", "value", "1 day")
    got = drift.scored(held, drift.summary(spark.createDataFrame(base, EVENTS), "kind", "value"), "kind").first()
    rows = spark.createDataFrame([(*r, True) for r in base] + [(*r, False) for r in now], f"{EVENTS}, base boolean")
    want = S.drift(rows, ["kind"], "value", "base").first()
    assert got.ks == pytest.approx(want.ks, abs=1e-12) and got.psi == pytest.approx(want.psi, abs=1e-9) and got.p == pytest.approx(want.p, abs=1e-9)


@pytest.mark.parametrize("shift", [0.0, 0.05, 0.5])
def test_large_windows_stay_within_the_stated_error(spark, shift):
    n = 200_000
    rows = spark.range(2 * n).select(F.lit(at(1)).alias("ts"), F.lit("a").alias("kind"), (F.randn(5) + F.when(F.col("id") < n, 0.0).otherwise(shift)).alias("value"), (F.col("id") < n).alias("base")).cache()
    held = drift.windows(rows.where("not base"), "ts", "kind", "value", "1 day")
    assert held.select(F.max(F.length("sketch"))).first()[0] < 60_000
    got = drift.scored(held, drift.summary(rows.where("base"), "kind", "value"), "kind").first()
    want = S.drift(rows, ["kind"], "value", "base").first()
    assert abs(got.ks - want.ks) <= 2 * drift.RANK_ERROR
    shares = np.full(10, 0.1)
    slack = float((4 * drift.RANK_ERROR * (np.abs(np.log(shares / (shares - 2 * drift.RANK_ERROR))) + 1)).sum()) * max(0.05, want.psi)
    assert abs(got.psi - want.psi) <= slack
    rows.unpersist()


def test_days_merge_to_the_sketch_of_their_month(spark):
    rng = random.Random(3)
    rows = spark.createDataFrame([x for d in range(4) for x in sample(rng, 24 * d, 100, kind="ab"[d % 2])], EVENTS)
    days = drift.windows(rows, "ts", "kind", "value", "1 day").withColumn("month", F.date_format("start", "yyyy-MM"))
    month = drift.merged(days, ["month", "kind"]).select(F.col("month").alias("start"), "kind", "n", "sketch")
    known = drift.summary(rows.withColumn("value", F.col("value") + 0.3), "kind", "value")
    whole = drift.windows(rows, "ts", "kind", "value", "3650 days")
    by_kind = lambda df: {r.kind: (r.n_now, r.ks, r.psi) for r in df.collect()}
    assert by_kind(drift.scored(month, known, "kind")) == by_kind(drift.scored(whole, known, "kind"))


def test_a_group_without_a_baseline_has_no_score(spark):
    rows = spark.createDataFrame([(at(1), "new", 1.0), (at(1), None, 2.0)], EVENTS)
    known = drift.summary(spark.createDataFrame([(at(0), "a", 1.0)], EVENTS), "kind", "value")
    got = drift.scored(drift.windows(rows, "ts", "kind", "value", "1 day"), known, "kind").collect()
    assert [(r.n_now, r.ks, r.psi, r.alert) for r in got] == [(1, None, None, False)] * 2
    assert not drift.scored(drift.windows(rows.where("false"), "ts", "kind", "value", "1 day"), known, "kind").count()


# ---- labels ---------------------------------------------------------------------------


def test_predictions_wait_for_their_labels_and_then_leave(spark, tmp_path):
    predictions = [[(1, at(0)), (2, at(1)), (3, at(2)), (None, at(2))], [(4, at(30)), (5, at(31))], [(9, at(60))], [(6, at(200))], [(7, at(900))]]
    marks = [[(1, at(5), "x")], [(2, at(20), "y"), (4, at(40), "z"), (1, at(6), "second")], [(9, at(61), "v")], [(3, at(3), "too late"), (6, at(201), "w"), (6, at(199), "early")], [(8, at(900), "none")]]
    stream = fed(spark, tmp_path, "id long, at timestamp", predictions, "at", "2 hours", "p")
    other = fed(spark, tmp_path, "id long, label_at timestamp, label string", marks, "label_at", "2 hours", "l")
    query, out = run(labels.awaited(stream, other, "id", "at", "label_at", "24 HOURS"), tmp_path)
    got = sorted(((r.id, r.label) for r in out.collect()), key=str)
    assert got == sorted([(1, "x"), (1, "second"), (2, "y"), (3, None), (None, None), (4, "z"), (5, None), (9, "v"), (6, "w")], key=str)
    assert labels.late(query) >= 1  # "too late" lies within its wait, but came after the watermark
    assert labels.held(query) <= 2  # the last of either stream, which nothing has closed
    first = {r.id: r.label for r in labels.settled(out, "id", "at", "label_at", "label").collect()}
    assert first == {1: "x", 2: "y", 3: None, None: None, 4: "z", 5: None, 9: "v", 6: "w"}


def test_state_is_bounded_by_the_wait(spark, tmp_path):
    predictions = [[(i, at(10 * b)) for i in range(50 * b, 50 * b + 50)] for b in range(12)]
    marks = [[(i, at(10 * b + 1), "x") for i in range(50 * b, 50 * b + 50, 2)] for b in range(12)]
    stream = fed(spark, tmp_path, "id long, at timestamp", predictions, "at", "1 hour", "p")
    other = fed(spark, tmp_path, "id long, label_at timestamp, label string", marks, "label_at", "1 hour", "l")
    query, out = run(labels.awaited(stream, other, "id", "at", "label_at", "20 HOURS"), tmp_path)
    most = max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"])
    assert most <= 75 * 5  # two waits, a delay and the batch that comes in
    assert out.where("label = 'x'").count() == 300


def test_accuracy_counts_what_has_come(spark):
    rows = spark.createDataFrame([("a", True), ("a", False), ("a", None), ("b", None)], "month string, right boolean")
    got = {r.month: tuple(r)[1:] for r in labels.delayed_accuracy(rows, "month", "right", 2).collect()}
    assert got == {"a": (3, 2, 1, 0.5, True), "b": (1, 0, 1, None, False)}


# ---- limits ---------------------------------------------------------------------------

REQUESTS = "client long, event_id long, ts timestamp"


def plain_limits(rows, per_client, total, seconds):
    out, mine, everyone = {}, {}, []
    for client, event_id, ts in sorted(rows, key=lambda r: (r[2], r[1])):
        recent = [t for t in mine.get(client, []) if (ts - t).total_seconds() < seconds]
        everyone = [t for t in everyone if (ts - t).total_seconds() < seconds]
        if len(recent) >= per_client:
            out[event_id] = "client"
        else:
            recent.append(ts)
            out[event_id] = "total" if len(everyone) >= total else "passed"
            everyone += [ts] * (len(everyone) < total)
        mine[client] = recent
    return out


def test_requests_are_judged_in_the_order_of_their_times(spark, tmp_path):
    rng = random.Random(9)
    rows = [(rng.randrange(6) or None, i, START + datetime.timedelta(seconds=rng.randrange(3000))) for i in range(300)]
    rows.sort(key=lambda r: r[2].timestamp() + rng.random() * 200)  # out of order, within the delay
    batches = [rows[i : i + 100] for i in range(0, 300, 100)] + [[(99, 1000, START + datetime.timedelta(days=2))]]
    with limits.kept_in_rocksdb(spark):
        query, out = run(limits.limited(fed(spark, tmp_path, REQUESTS, batches, "ts", "10 minutes", "in"), "client", "event_id", "ts", 4, 11, 300), tmp_path)
    got = {r.event_id: r.verdict for r in out.collect()}
    assert got == plain_limits(rows, 4, 11, 300) and set(got.values()) == {"passed", "client", "total"}


def test_state_holds_the_clients_of_one_window_and_delay(spark, tmp_path):
    clients, batches = 1000, 6
    rows = [[(b * clients + c, b * clients + c, START + datetime.timedelta(seconds=600 * b + c % 500)) for c in range(clients)] for b in range(batches)]
    with limits.kept_in_rocksdb(spark):
        query, out = run(limits.limited(fed(spark, tmp_path, REQUESTS, [*rows, [(0, -1, at(24 * 9))]], "ts", "1 minute", "in"), "client", "event_id", "ts", 2, 10**6, 60), tmp_path)
    assert out.count() == clients * batches
    each = [p["stateOperators"][0] for p in query.recentProgress]
    sizes = [max(s["numRowsTotal"] for s in p["stateOperators"]) for p in query.recentProgress]
    per_client = 4  # a waiting request or a time it passed, and its timer in two orders
    assert each and max(sizes) <= 3 * clients * per_client  # not clients * batches of them
    assert sizes[-1] <= 2 * per_client


def test_state_is_packed_by_lots_of_clients(spark, tmp_path):
    n, far = 8 * limits.LOTS, 2**60  # ids that a double does not hold, beside a client without one
    rows = [(None if i % 9 == 0 else far + i // 2, far + i, at(i % 3)) for i in range(n)]
    with limits.kept_in_rocksdb(spark):
        query, out = run(limits.limited(fed(spark, tmp_path, REQUESTS, [rows, [(1, -1, at(99))]], "ts", "1 hour", "in"), "client", "event_id", "ts", 1, 50, 3600), tmp_path)
    got = out.collect()
    assert {r.event_id: r.verdict for r in got} == plain_limits(rows, 1, 50, 3600) and {(r.client, r.event_id) for r in got} == {r[:2] for r in rows}
    assert max(s["numRowsTotal"] for p in query.recentProgress for s in p["stateOperators"]) <= 6 * limits.LOTS  # not some for each client


def test_the_next_to_pass_is_looked_up():
    rng = random.Random(11)
    for most in (0, 1, 3):
        times = sorted(rng.randrange(400) for _ in range(200))
        kept, want = [-5, -3][:most], []
        held = list(kept)
        for t in times:
            held = [x for x in held if x > t - 20]
            want.append(len(held) < most)
            held += [t] * want[-1]
        assert limits.passing(np.array(times), most, 20, kept)[0].tolist() == want

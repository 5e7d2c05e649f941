"""Queries over aggregates, windows, orders and projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeward.functions import columns as C
from lakeward.operators import relational as R
from lakeward.operators.ranks import quantile, quantiles, running
from lakeward.registry import query, table

def by_day() -> Column:
    return F.date_format("ts", "yyyy-MM-dd").alias("day")


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS orders, min(l_quantity) AS least, max(l_quantity) AS most FROM lineitem GROUP BY ALL")
def a01_group_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts, distinct counts, extremes."""
    return table(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most")
    )


@query("""
SELECT event_type, count(*) FILTER (value > 50) AS high, sum(CASE WHEN value > 50 THEN 1 ELSE 0 END)::BIGINT AS high_sum, max_by(event_id, struct_pack(v := ts, i := event_id)) AS last_event FROM events GROUP BY 1
""")
def a03_conditional_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Conditional counts and the value at the largest of another."""
    return table(spark, sf, "events").groupBy("event_type").agg(
        F.count_if(F.col("value") > 50).alias("high"), F.sum(F.when(F.col("value") > 50, 1).otherwise(0)).alias("high_sum"),
        F.max_by("event_id", F.struct("ts", "event_id")).alias("last_event"),
    )


@query("""
WITH n AS (SELECT o_custkey, o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderpriority IS NOT NULL GROUP BY ALL)
SELECT o_custkey, v AS o_orderpriority FROM n QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY n DESC, CASE WHEN v LIKE '%SPECIFIED' THEN 1 ELSE 0 END, v) = 1
""")
def a07_mode(spark: SparkSession, sf: str) -> DataFrame:
    return R.modes(table(spark, sf, "orders"), ["o_custkey"], "o_orderpriority", last="SPECIFIED")


@query("SELECT l_returnflag, l_shipdate >= TIMESTAMP '1998-01-01' AS late, count(*) AS n FROM lineitem GROUP BY ALL")
def a08_group_by_all(spark: SparkSession, sf: str) -> DataFrame:
    table(spark, sf, "lineitem").createOrReplaceTempView("lineitem_a08")
    return spark.sql("SELECT l_returnflag, l_shipdate >= TIMESTAMP_NTZ '1998-01-01' AS late, count(*) AS n FROM lineitem_a08 GROUP BY ALL")


@query("""
SELECT lang, source, round(avg(n_chars), 6) AS mean, max(n_chars) AS most FROM documents GROUP BY GROUPING SETS ((lang), (lang, source))
""")
def a09_two_levels(spark: SparkSession, sf: str) -> DataFrame:
    """A group and its subgroups in one pass."""
    docs = table(spark, sf, "documents")
    return docs.groupingSets([["lang"], ["lang", "source"]], "lang", "source").agg(F.round(F.avg("n_chars"), 6).alias("mean"), F.max("n_chars").alias("most"))


@query("SELECT user_id, min_by(event_type, event_id) AS first_type, min(event_id) AS first_event FROM events GROUP BY 1")
def a10_first_per_group(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy("user_id").agg(F.min_by("event_type", "event_id").alias("first_type"), F.min("event_id").alias("first_event"))


@query("SELECT l_partkey, count(DISTINCT l_returnflag) AS kinds, array_to_string(list_sort(list(DISTINCT l_returnflag)), ',') AS vals FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def a11_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    sets = table(spark, sf, "lineitem").groupBy("l_partkey").agg(F.collect_set("l_returnflag").alias("s"))
    return sets.where(F.size("s") > 1).select("l_partkey", F.size("s").cast("long").alias("kinds"), F.array_join(F.sort_array("s"), ",").alias("vals"))


@query("""
WITH e(event_type, expected) AS (VALUES ('click', 2000), ('purchase', 2000), ('refund', 1)), a AS (SELECT event_type, count(*) AS actual FROM events GROUP BY 1)
SELECT event_type, expected, actual, expected IS DISTINCT FROM actual AS differs FROM e FULL JOIN a USING (event_type)
""")
def a12_expected_counts(spark: SparkSession, sf: str) -> DataFrame:
    expected = spark.createDataFrame([("click", 2000), ("purchase", 2000), ("refund", 1)], "event_type string, expected int")
    actual = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("actual"))
    return expected.join(actual, "event_type", "full").withColumn("differs", ~F.col("expected").eqNullSafe(F.col("actual")))


@query("""
SELECT event_type, q, round(CASE q WHEN 0.1 THEN quantile_cont(value, 0.1) WHEN 0.5 THEN quantile_cont(value, 0.5) ELSE quantile_cont(value, 0.9) END, 6) AS v
FROM events, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) AS t(q) GROUP BY event_type, q
""")
def a13_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    qs = [0.1, 0.5, 0.9]
    grouped = quantiles(table(spark, sf, "events"), ["event_type"], "value", qs, "v")
    pairs = F.explode(F.arrays_zip(F.array(*map(F.lit, qs)).alias("q"), "v"))
    return grouped.select("event_type", pairs.alias("p")).select("event_type", F.col("p.q").alias("q"), F.round("p.v", 6).alias("v"))


@query("""
SELECT row_number() OVER (ORDER BY a.n DESC, a.event_type) AS place, a.event_type, a.n FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1) a
""")
def l01_total_order(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    return counts.select(F.row_number().over(Window.orderBy(F.desc("n"), "event_type")).cast("long").alias("place"), "event_type", "n")


@query("""
WITH p AS (SELECT c_mktsegment, c_acctbal, c_custkey FROM customer), e AS (SELECT c_custkey FROM p WHERE c_acctbal < 0 ORDER BY c_custkey LIMIT 5)
SELECT count(*) FILTER (c_acctbal < 0) AS violations, (SELECT array_to_string(list(c_custkey ORDER BY c_custkey), ', ') FROM e) || ' (+' || (count(*) FILTER (c_acctbal < 0) - 5) || ' more)' AS detail FROM p
""")
def l04_examples(spark: SparkSession, sf: str) -> DataFrame:
    """A count and its first five examples; only five rows meet in one task."""
    from lakeward.operators.gates import violations

    return violations(table(spark, sf, "customer"), F.col("c_acctbal") < 0, "c_custkey").select("violations", "detail")


@query("SELECT user_id, event_id, ts FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def w01_latest(spark: SparkSession, sf: str) -> DataFrame:
    events = table(spark, sf, "events").select("user_id", "event_id", "ts")
    return R.latest(events, ["user_id"], [F.desc("ts"), F.desc("event_id")])


@query("SELECT o_orderkey, max(CASE WHEN o_totalprice > 300000 THEN 'patient:' || o_orderstatus ELSE 'lesion:' || o_orderpriority END) OVER (PARTITION BY o_custkey) AS person FROM orders")
def w03_group_value(spark: SparkSession, sf: str) -> DataFrame:
    """One person key for all rows of a group: the largest of their keys."""
    key = F.when(F.col("o_totalprice") > 300000, F.concat(F.lit("patient:"), "o_orderstatus")).otherwise(F.concat(F.lit("lesion:"), "o_orderpriority"))
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", key.alias("own"))
    return R.with_largest(rows, "o_custkey", "own", "person").select("o_orderkey", "person")


@query("""
WITH m AS (SELECT event_type, ts::DATE::VARCHAR AS day, count(*) FILTER (value > 40) AS hits, CASE WHEN day(ts::DATE) = 5 THEN NULL ELSE count(*) END AS labelled FROM events GROUP BY event_type, ts::DATE),
w AS (SELECT *, coalesce(sum(hits) OVER (PARTITION BY event_type ORDER BY day DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
  sum((labelled IS NULL)::INT) OVER (PARTITION BY event_type ORDER BY day DESC ROWS UNBOUNDED PRECEDING) AS gaps FROM m)
SELECT event_type, day, hits FROM w WHERE before < 100 AND gaps = 0
""")
def w04_trailing_window(spark: SparkSession, sf: str) -> DataFrame:
    day = table(spark, sf, "events").groupBy("event_type", by_day()).agg(F.count_if(F.col("value") > 40).alias("hits"), F.count("*").alias("n"))
    day = day.withColumn("labelled", F.when(~F.col("day").endswith("-05"), F.col("n")))
    return R.trailing_window(day, ["event_type"], "day", "hits", "labelled", 100).select("event_type", "day", "hits")


@query("SELECT day, n, n - lag(n) OVER (ORDER BY day) AS delta FROM (SELECT ts::DATE::VARCHAR AS day, count(*) AS n FROM events GROUP BY 1)")
def w05_delta(spark: SparkSession, sf: str) -> DataFrame:
    """The change from the row before, over one row a day."""
    days = table(spark, sf, "events").groupBy(by_day()).agg(F.count("*").alias("n"))
    return days.withColumn("delta", F.col("n") - F.lag("n").over(Window.orderBy("day")))


@query("""
WITH g AS (SELECT p_brand, p_partkey, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS r, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS a FROM part)
SELECT p_partkey, concat_ws(',', CASE WHEN r <= 2 THEN 'brand' END, CASE WHEN a <= 10 THEN 'overall' END) AS reasons FROM g WHERE r <= 2 OR a <= 10
""")
def w07_top_with_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """The top of each group and of all rows, with the reasons merged."""
    part = table(spark, sf, "part").select("p_brand", "p_partkey", "p_retailprice")
    order = [F.desc("p_retailprice"), F.col("p_partkey")]
    by_brand = R.top_per_group(part, ["p_brand"], order, 2).select("p_partkey", F.lit("brand").alias("reason"))
    overall = part.orderBy(*order).limit(10).select("p_partkey", F.lit("overall").alias("reason"))
    return by_brand.unionByName(overall).groupBy("p_partkey").agg(F.array_join(F.sort_array(F.collect_set("reason")), ",").alias("reasons"))


@query("SELECT doc_id, n FROM (SELECT doc_id, count(*) OVER (PARTITION BY md5(text)) AS n FROM documents) WHERE n > 1")
def w08_duplicate_members(spark: SparkSession, sf: str) -> DataFrame:
    """Members of groups of equal texts, joined to the groups' counts."""
    docs = table(spark, sf, "documents").select("doc_id", F.md5("text").alias("digest"))
    groups = docs.groupBy("digest").agg(F.count("*").alias("n")).where("n > 1")
    return docs.join(groups, "digest").select("doc_id", "n")


@query("""
WITH s AS (SELECT event_type, value, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS r, user_id % 4 = 0 AS pos FROM events)
SELECT event_type, round((sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)), 9)::DOUBLE AS auroc FROM s GROUP BY 1
""")
def w10_auroc(spark: SparkSession, sf: str) -> DataFrame:
    from lakeward.operators.statistics import auroc

    rows = table(spark, sf, "events").select("event_type", "value", (F.col("user_id") % 4 == 0).alias("positive"))
    return auroc(rows, ["event_type"], "value", "positive").select("event_type", F.round("auroc", 9).alias("auroc"))


@query("""
WITH e AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events),
c AS (WITH RECURSIVE r AS (SELECT user_id, seq, sha256('0||' || event_type) AS hash FROM e WHERE seq = 0
  UNION ALL SELECT e.user_id, e.seq, sha256(e.seq || '|' || r.hash || '|' || e.event_type) FROM r JOIN e ON e.user_id = r.user_id AND e.seq = r.seq + 1) SELECT * FROM r)
SELECT user_id, seq::INT AS seq, hash, false AS gap, false AS broken, seq = 2 AND user_id % 3 = 0 AS edited FROM c
""")
def w11_chain(spark: SparkSession, sf: str) -> DataFrame:
    """A hash-chained log of each user's events, with every third user's third entry
    edited, and what the check finds (W11)."""
    logs = R.chained(table(spark, sf, "events"), ["user_id"], ["event_id"], F.col("event_type"))
    edited = logs.withColumn("body", F.when((F.col("seq") == 2) & (F.col("user_id") % 3 == 0), F.lit("edited")).otherwise(F.col("body")))
    return R.chain_faults(edited, ["user_id"]).select("user_id", "seq", "hash", "gap", "broken", "edited")


@query("""
WITH g AS (SELECT o_custkey, count(*) AS n, md5(o_custkey::VARCHAR) AS k FROM orders GROUP BY 1), r AS (SELECT *, sum(n) OVER (ORDER BY k, o_custkey ROWS UNBOUNDED PRECEDING) AS running FROM g)
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT o_custkey FROM r WHERE running <= 500)
""")
def w14_whole_groups(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    return R.whole_groups(orders, "o_custkey", F.md5(F.col("o_custkey").cast("string")), 500).select("o_orderkey", "o_custkey")


@query("""
WITH p AS (SELECT p_partkey, row_number() OVER (ORDER BY md5(p_partkey::VARCHAR), p_partkey) AS r FROM part), s(month, n) AS (VALUES (1, 30), (2, 50), (3, 20)),
c AS (SELECT month, sum(n) OVER (ORDER BY month) - n AS lo, sum(n) OVER (ORDER BY month) AS hi FROM s)
SELECT month, p_partkey FROM p JOIN c ON r > lo AND r <= hi
""")
def w15_schedule(spark: SparkSession, sf: str) -> DataFrame:
    """Consecutive slices of one shuffled pool, one for each month of the schedule."""
    plan, at = [], 0
    for month, n in ((1, 30), (2, 50), (3, 20)):
        plan.append((month, at, at + n))
        at += n
    key = F.md5(F.col("p_partkey").cast("string"))
    pool = table(spark, sf, "part").select("p_partkey").orderBy(key, "p_partkey").limit(at)
    placed = pool.withColumn("r", F.row_number().over(Window.orderBy(key, "p_partkey")))
    months = spark.createDataFrame(plan, "month int, lo int, hi int")
    return placed.join(months, (F.col("r") > F.col("lo")) & (F.col("r") <= F.col("hi"))).select("month", "p_partkey")


@query("""
SELECT doc_id, CASE WHEN row_number() OVER (PARTITION BY lang ORDER BY doc_id) <= greatest(1, (count(*) OVER (PARTITION BY lang) * 0.1 + 0.5)::DOUBLE // 1) THEN 'dev' ELSE 'scoring' END AS part FROM documents
""")
def w16_dev_split(spark: SparkSession, sf: str) -> DataFrame:
    """The first tenth of each stratum is for development."""
    one = table(spark, sf, "documents").select("doc_id", "lang").withColumn("c", F.lit(1))
    share = F.greatest(F.lit(1.0), F.floor(F.col("c_all") * 0.1 + 0.5).cast("double"))
    part = F.when(F.col("c_before") + 1 <= share, "dev").otherwise("scoring")
    return running(one, ["lang"], "doc_id", ["c"]).select("doc_id", part.alias("part"))


@query("SELECT event_id, (epoch_us(ts) - epoch_us(min(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING))) // 1000000 AS seconds FROM events")
def w17_since_first(spark: SparkSession, sf: str) -> DataFrame:
    first = F.min("ts").over(Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0))
    seconds = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(first.cast("timestamp"))
    return table(spark, sf, "events").select("event_id", F.floor(seconds / 1_000_000).cast("long").alias("seconds"))


@query("SELECT event_type, min(CASE WHEN value > 120 THEN day(ts) END) AS first_alert, min(CASE WHEN value > 120 AND day(ts) >= 5 THEN day(ts) - 5 END) AS days_to_detect FROM events GROUP BY 1")
def w18_time_to_detect(spark: SparkSession, sf: str) -> DataFrame:
    day, alert = F.day("ts").cast("long"), F.col("value") > 120
    return table(spark, sf, "events").groupBy("event_type").agg(F.min(F.when(alert, day)).alias("first_alert"), F.min(F.when(alert & (day >= 5), day - 5)).alias("days_to_detect"))


@query("""
WITH d AS (SELECT DISTINCT user_id, day(ts) AS d FROM events), i AS (SELECT user_id, d, d - row_number() OVER (PARTITION BY user_id ORDER BY d) AS k FROM d)
SELECT user_id, min(d)::INT AS first, max(d)::INT AS last FROM i GROUP BY user_id, k
""")
def w19_islands(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").select("user_id", F.day("ts").alias("d"))
    return R.islands(days, ["user_id"], "d")


@query("""
WITH m AS (SELECT date_trunc('month', o_orderdate)::DATE::VARCHAR AS month, count(*) AS n, count(*) FILTER (o_orderstatus = 'F') AS done FROM orders GROUP BY 1)
SELECT month, coalesce(sum(n) OVER w, 0)::BIGINT AS known, coalesce(sum(done) OVER w, 0)::BIGINT AS known_done FROM m WINDOW w AS (ORDER BY month ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
""")
def w20_history(spark: SparkSession, sf: str) -> DataFrame:
    """What was known before each month, over one row a month."""
    months = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-01").alias("month")).agg(F.count("*").alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("done"))
    before = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, -1)
    return months.select("month", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("known"), F.coalesce(F.sum("done").over(before), F.lit(0)).alias("known_done"))


@query("""
SELECT n_name, substr(sha256(array_to_string(list_sort(list(DISTINCT s_name || ',' || (s_suppkey % 3)::VARCHAR)), chr(10))), 1, 16) AS fingerprint FROM supplier JOIN nation ON n_nationkey = s_nationkey GROUP BY 1
""")
def a24_fingerprint(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("part", F.col("s_suppkey") % 3)
    return R.fingerprints(rows, ["n_name"], "s_name", "part")


@query("SELECT l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def a25_duplicate_keys(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n")).where("n > 1")


@query("""
SELECT o_custkey, array_to_string(list_sort(list(DISTINCT o_orderstatus)), ',') AS statuses FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderstatus) > 1
""")
def a23_sets_over_one(spark: SparkSession, sf: str) -> DataFrame:
    sets = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderstatus")).alias("s"))
    return sets.where(F.size("s") > 1).select("o_custkey", F.array_join("s", ",").alias("statuses"))


@query("""
WITH r AS (SELECT l_orderkey, count(*) AS lines, sum(l_extendedprice) AS billed, max(l_quantity) AS minutes FROM lineitem GROUP BY 1)
SELECT o_orderpriority, count(*) AS runs, sum(minutes)::DOUBLE AS minutes, round(sum(billed), 2) AS billed FROM orders JOIN r ON l_orderkey = o_orderkey GROUP BY 1
""")
def a26_cost_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Costs over runs, with each run's minutes counted once."""
    runs = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("billed"), F.max("l_quantity").alias("minutes"))
    joined = table(spark, sf, "orders").select("o_orderkey", "o_orderpriority").join(runs, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.count("*").alias("runs"), F.sum("minutes").alias("minutes"), F.round(F.sum("billed"), 2).alias("billed"))


@query("""
SELECT *, round(n::DOUBLE / sum(n) OVER (PARTITION BY c_mktsegment), 9) AS share FROM (SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY ALL)
""")
def a35_shares(spark: SparkSession, sf: str) -> DataFrame:
    counts = table(spark, sf, "customer").groupBy("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("c_mktsegment")), 9))


@query("""
SELECT source, label, n FROM (SELECT source, quality AS label, count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY ALL)
""")
def a18_null_kept_as_group(spark: SparkSession, sf: str) -> DataFrame:
    joined = table(spark, sf, "documents").select("doc_id", "source").join(table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id", "left")
    return joined.groupBy("source", "label").agg(F.count("*").alias("n"))


@query("""
SELECT c AS column_name, count(*) AS row_count, count(*) FILTER (v IS NULL) AS nulls FROM (
SELECT unnest(['doc_id', 'lang', 'quality', 'toxic']) AS c, unnest([d.doc_id::VARCHAR, lang, quality::VARCHAR, toxic::VARCHAR]) AS v FROM documents d LEFT JOIN labels l USING (doc_id)) GROUP BY 1
""")
def a19_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and nulls of every column in one aggregate."""
    from lakeward.operators.gates import profile

    return profile(table(spark, sf, "documents").select("doc_id", "lang").join(table(spark, sf, "labels"), "doc_id", "left"))


@query("""
SELECT s_nationkey, count(*) AS n, count(DISTINCT l_partkey) AS parts, array_to_string(list_sort(list(DISTINCT l_returnflag || '=' || f.n)), ';') AS flags FROM lineitem
JOIN supplier ON s_suppkey = l_suppkey JOIN (SELECT s_nationkey AS k, l_returnflag AS fl, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey GROUP BY ALL) f ON f.k = s_nationkey AND fl = l_returnflag GROUP BY 1
""")
def a33_source_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and a map of value counts for each source."""
    lines = table(spark, sf, "lineitem").join(table(spark, sf, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    flags = lines.groupBy("s_nationkey", "l_returnflag").agg(F.count("*").alias("n")).groupBy("s_nationkey").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "n"))).alias("m"))
    text = F.array_join(F.sort_array(F.transform(F.map_entries("m"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    base = lines.groupBy("s_nationkey").agg(F.count("*").alias("n"), F.count_distinct("l_partkey").alias("parts"))
    return base.join(flags, "s_nationkey").select("s_nationkey", "n", "parts", text.alias("flags"))


@query("""
SELECT event_type, round(quantile_cont(gap, 0.5), 3) AS median_s, max(gap) AS longest_s FROM
(SELECT event_type, epoch(ts)::BIGINT - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))::BIGINT AS gap FROM events) WHERE gap IS NOT NULL GROUP BY 1
""")
def a21_turnaround(spark: SparkSession, sf: str) -> DataFrame:
    seconds = F.unix_seconds(F.round(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("timestamp"))
    events = table(spark, sf, "events").select("event_type", "user_id", "event_id", "ts", seconds.alias("s"))
    gap = F.col("s") - F.lag("s").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    gaps = events.withColumn("gap", gap).where("gap is not null")
    medians = quantile(gaps, ["event_type"], "gap", 0.5, "median_s").withColumn("median_s", F.round("median_s", 3))
    return gaps.groupBy("event_type").agg(F.max("gap").alias("longest_s")).join(medians, "event_type").select("event_type", "median_s", "longest_s")


@query("""
WITH t AS (SELECT unnest(['pooled', 'flag ' || l_returnflag, CASE WHEN l_discount >= 0.05 THEN 'discounted' END]) AS tag, l_quantity, l_linestatus FROM lineitem)
SELECT tag, count(*) AS n, round(avg(l_quantity), 6) AS quantity, round(avg((l_linestatus = 'O')::INT), 9) AS open_share FROM t WHERE tag IS NOT NULL GROUP BY 1
""")
def a16_overlapping_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Metrics over groups that overlap: every row is given all of its tags."""
    tags = F.array_compact(F.array(F.lit("pooled"), F.concat(F.lit("flag "), "l_returnflag"), F.when(F.col("l_discount") >= 0.05, "discounted")))
    rows = table(spark, sf, "lineitem").select(F.explode(tags).alias("tag"), "l_quantity", "l_linestatus")
    return rows.groupBy("tag").agg(F.count("*").alias("n"), F.round(F.avg("l_quantity"), 6).alias("quantity"), F.round(F.avg((F.col("l_linestatus") == "O").cast("int")), 9).alias("open_share"))


@query("""
WITH k AS (SELECT s, f FROM (SELECT DISTINCT o_orderstatus AS s FROM orders), (SELECT DISTINCT o_orderpriority AS f FROM orders)), n AS (SELECT o_orderstatus AS s, o_orderpriority AS f, count(*) AS n FROM orders GROUP BY ALL)
SELECT k.s AS status, k.f AS priority, coalesce(n, 0) AS support, coalesce(n, 0) < 20 AS small FROM k LEFT JOIN n USING (s, f)
""")
def a17_support(spark: SparkSession, sf: str) -> DataFrame:
    """Support of every class in every split, zeros included; both sides are labels."""
    orders = table(spark, sf, "orders")
    grid = orders.select(F.col("o_orderstatus").alias("status")).distinct().join(orders.select(F.col("o_orderpriority").alias("priority")).distinct(), F.lit(True))
    counts = orders.groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(F.count("*").alias("n"))
    n = F.coalesce("n", F.lit(0))
    return grid.join(counts, ["status", "priority"], "left").select("status", "priority", n.alias("support"), (n < 20).alias("small"))


@query("""
SELECT p_partkey, coalesce(CASE WHEN p_size > 40 THEN p_type END, CASE WHEN p_size > 20 THEN p_brand END, p_name) AS site,
CASE WHEN p_size > 40 THEN 'type' WHEN p_size > 20 THEN 'brand' ELSE 'name' END AS field, CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS size_band,
(floor(p_size / 10) * 10)::INT AS decade, CASE WHEN p_brand = 'Brand#11' THEN NULL ELSE p_brand END AS label, ('0x' || substr(sha256('img|' || p_partkey), 1, 15))::BIGINT AS id FROM part
""")
def p06_projection_rules(spark: SparkSession, sf: str) -> DataFrame:
    """P05-P07, P11 and ids: coalesce with the field kept, nulling, bands, keys."""
    size = F.col("p_size")
    site, field = C.first_present(type=F.when(size > 40, F.col("p_type")), brand=F.when(size > 20, F.col("p_brand")), name=F.col("p_name"))
    return table(spark, sf, "part").select(
        "p_partkey", site.alias("site"), field.alias("field"), C.band(size, [0, 10, 30], ["small", "medium", "large"]).alias("size_band"), C.decade(size).alias("decade"),
        F.when(F.col("p_brand") != "Brand#11", F.col("p_brand")).alias("label"), C.stable_id(F.lit("img"), F.col("p_partkey")).alias("id"),
    )


@query("SELECT c_custkey AS id, coalesce(c_nationkey, 0)::BIGINT AS nation_id, 0::INT AS age, NULL::VARCHAR AS note FROM customer")
def p08_conformed(spark: SparkSession, sf: str) -> DataFrame:
    schema = T.StructType([T.StructField("id", T.LongType(), False), T.StructField("nation_id", T.LongType(), False), T.StructField("age", T.IntegerType(), False), T.StructField("note", T.StringType())])
    return R.conformed(table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("nation_id")), schema)


@query("""
SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'filled' WHEN 'O' THEN 'open' WHEN 'P' THEN 'part' END AS status, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice BETWEEN 1000 AND 200000 THEN 'fast' ELSE 'slow' END AS lane FROM orders WHERE o_orderkey IS NOT NULL
""")
def p09_code_map(spark: SparkSession, sf: str) -> DataFrame:
    """Literal maps, membership, ranges."""
    codes = F.create_map(*(F.lit(x) for x in ("F", "filled", "O", "open", "P", "part")))
    fast = F.col("o_orderpriority").isin("1-URGENT", "2-HIGH") & F.col("o_totalprice").between(1000, 200000)
    return table(spark, sf, "orders").where("o_orderkey is not null").select("o_orderkey", F.element_at(codes, F.col("o_orderstatus")).alias("status"), F.when(fast, "fast").otherwise("slow").alias("lane"))


@query("""
SELECT turn, role, CASE WHEN regexp_matches(t, '^[=+@\\t\\r-]') THEN '''' || t ELSE t END AS cell FROM (SELECT turn, role, CASE turn % 4 WHEN 0 THEN '=' WHEN 1 THEN '-' WHEN 2 THEN '@' ELSE '' END || text AS t FROM conversations)
""")
def p18_cell_guard(spark: SparkSession, sf: str) -> DataFrame:
    mark = F.element_at(F.array(*map(F.lit, ("=", "-", "@", ""))), (F.col("turn") % 4 + 1).cast("int"))
    return table(spark, sf, "conversations").select("turn", "role", C.cell_text(F.concat(mark, "text")).alias("cell"))


@query("SELECT event_id, 'user:' || coalesce(CASE WHEN user_id % 3 = 0 THEN user_id END, event_id) AS unit FROM events")
def p17_unit_key(spark: SparkSession, sf: str) -> DataFrame:
    unit = F.coalesce(F.when(F.col("user_id") % 3 == 0, F.col("user_id")), F.col("event_id"))
    return table(spark, sf, "events").select("event_id", F.concat(F.lit("user:"), unit.cast("string")).alias("unit"))


@query("""
SELECT event_id, (props::JSON ->> '$.k')::INT AS k, event_type LIKE 'p%' AS starts, ts::DATE AS day, year(ts)::INT AS year, split_part(event_type, 'c', 1) AS head, upper(event_type) AS big FROM events
""")
def f01_scalars(spark: SparkSession, sf: str) -> DataFrame:
    """JSON, pattern, date and string functions (2.9, S06)."""
    return table(spark, sf, "events").select(
        "event_id", F.from_json("props", "k int")["k"].alias("k"), F.col("event_type").like("p%").alias("starts"), F.to_date("ts").alias("day"), F.year("ts").alias("year"),
        F.split_part("event_type", F.lit("c"), F.lit(1)).alias("head"), F.upper("event_type").alias("big"),
    )


@query(r"""
SELECT doc_id, sha256(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS key, regexp_matches(text, '(?i)\blicen[cs]e\b') AS licensed, length(regexp_extract(text, '[A-Z][a-z]+')) AS first_word, n_chars % 97 AS m FROM documents
""")
def f02_text_keys(spark: SparkSession, sf: str) -> DataFrame:
    text = F.col("text")
    return table(spark, sf, "documents").select(
        "doc_id", C.text_key(text).alias("key"), text.rlike(r"(?i)\blicen[cs]e\b").alias("licensed"), F.length(F.regexp_extract(text, "[A-Z][a-z]+", 0)).cast("long").alias("first_word"), (F.col("n_chars") % 97).alias("m")
    )

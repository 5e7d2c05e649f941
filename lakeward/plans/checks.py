"""Queries over scans as they are shaped, and checks of whole tables in one row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.operators.ranks import nearest_rank
from lakeward.registry import query, table


@query("SELECT o_orderkey AS record_id, o_orderdate AS recorded FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def s03_pruned_scan(spark: SparkSession, sf: str) -> DataFrame:
    """Two columns under new names; the predicate reaches the scan."""
    kept = table(spark, sf, "orders").where((F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000))
    return kept.select(F.col("o_orderkey").alias("record_id"), F.col("o_orderdate").alias("recorded"))


@query("SELECT n_name, count(*) AS customers FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY 1")
def s10_named_views(spark: SparkSession, sf: str) -> DataFrame:
    """Frames under names that one statement reads, passed in and not registered."""
    return spark.sql(
        "SELECT n_name, count(*) AS customers FROM {people} JOIN {nations} ON n_nationkey = c_nationkey WHERE c_acctbal > 0 GROUP BY n_name",
        people=table(spark, sf, "customer"), nations=table(spark, sf, "nation"),
    )


@query("""
WITH u AS (SELECT l_partkey AS sku, count(*) AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1),
j AS (SELECT u.*, p_retailprice AS price, p_partkey FROM u LEFT JOIN part ON p_partkey = sku)
SELECT (SELECT count(*) FROM lineitem) AS usage_rows, sum(n)::BIGINT AS joined_rows, coalesce(sum(n) FILTER (price IS NULL), 0)::BIGINT AS unpriced, sum(q::BIGINT * round(price * 100)::BIGINT)::BIGINT AS cost_cents,
  (SELECT count(*) FROM lineitem) = sum(n) AND count(*) FILTER (price IS NULL) = 0 AS passed FROM j
""")
def s12_priced_usage(spark: SparkSession, sf: str) -> DataFrame:
    """Usage is priced without a row dropped, doubled or left without price.

    Usage is summed by sku before it meets the prices, so no hot sku is shuffled whole.
    """
    lines = table(spark, sf, "lineitem")
    used = lines.groupBy(F.col("l_partkey").alias("sku")).agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    priced = used.join(table(spark, sf, "part"), F.col("p_partkey") == F.col("sku"), "left")
    bare = F.col("p_retailprice").isNull()
    sums = priced.agg(F.sum("n").alias("joined_rows"), F.coalesce(F.sum(F.when(bare, F.col("n"))), F.lit(0)).alias("unpriced"), F.sum(F.col("q").cast("long") * F.round(F.col("p_retailprice") * 100).cast("long")).alias("cost_cents"))
    both = lines.agg(F.count("*").alias("usage_rows")).join(sums)  # one row each
    return both.withColumn("passed", (F.col("usage_rows") == F.col("joined_rows")) & (F.col("unpriced") == 0))


@query("SELECT event_type, count(*) AS n, count(props::JSON ->> '$.k') AS with_metric, max((props::JSON ->> '$.k')::INT) AS largest, max(ts) AS last FROM events GROUP BY 1")
def s13_event_log(spark: SparkSession, sf: str) -> DataFrame:
    """An event log's JSON metrics by kind of event."""
    k = F.get_json_object("props", "$.k")
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_metric"), F.max(k.cast("int")).alias("largest"), F.max("ts").alias("last"))


@query("""
SELECT vec_id, len(embedding)::INT AS width, md5(array_to_string(list_transform(embedding, lambda x: floor(256.0::DOUBLE * x::DOUBLE)::BIGINT::VARCHAR), ',')) AS digest,
  len(embedding) = 64 AS whole FROM embeddings
""")
def s15_vector_archive(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors with the digest of their quantised components and a check of the width."""
    whole = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("string"))
    width = F.size("embedding")
    return table(spark, sf, "embeddings").select("vec_id", width.alias("width"), F.md5(F.array_join(whole, ",")).alias("digest"), (width == 64).alias("whole"))


_SPLIT = "CASE user_id % 10 WHEN 0 THEN 'test' WHEN 1 THEN 'dev' WHEN 2 THEN 'other' ELSE 'train' END"


@query(f"""
WITH s AS (SELECT event_id, user_id, {_SPLIT} AS split FROM events)
SELECT split, count(*) AS n, split IN ('train', 'dev', 'test') AS allowed, count(*) FILTER (split NOT IN ('train', 'dev', 'test') AND user_id <> 12) AS unexplained FROM s GROUP BY 1
""")
def s18_split_values(spark: SparkSession, sf: str) -> DataFrame:
    """Split labels against the closed list, with a documented exception."""
    rows = table(spark, sf, "events").select("user_id", F.expr(_SPLIT).alias("split"))
    allowed = F.col("split").isin("train", "dev", "test")
    return rows.groupBy("split").agg(F.count("*").alias("n"), F.max(allowed).alias("allowed"), F.count_if(~allowed & (F.col("user_id") != 12)).alias("unexplained"))


@query("""
WITH d AS (SELECT d.doc_id, quality FROM documents d LEFT JOIN labels USING (doc_id))
SELECT count(*) AS scanned, count(quality) AS found, count(*) FILTER (quality IS NULL) AS missing, min(doc_id) FILTER (quality IS NULL) AS first_missing FROM d
""")
def s20_label_lookup(spark: SparkSession, sf: str) -> DataFrame:
    """Labels looked up while scanning, and what the lookup misses."""
    labels = table(spark, sf, "labels").select("doc_id", "quality")
    joined = table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left")
    lost = F.col("quality").isNull()
    return joined.agg(F.count("*").alias("scanned"), F.count("quality").alias("found"), F.count_if(lost).alias("missing"), F.min(F.when(lost, F.col("doc_id"))).alias("first_missing"))


_GROUP = "CASE WHEN event_id % 3 <> 0 THEN concat('L', cast(user_id AS STRING)) END"


@query(f"SELECT concat('e', event_id::VARCHAR) AS record_id, coalesce({_GROUP}, concat('e', event_id::VARCHAR)) AS group_id, {_GROUP} IS NULL AS own_group FROM events")
def s22_own_group(spark: SparkSession, sf: str) -> DataFrame:
    """Records without a group stand as a group of their own."""
    record, group = F.concat(F.lit("e"), F.col("event_id").cast("string")), F.expr(_GROUP)
    return table(spark, sf, "events").select(record.alias("record_id"), F.coalesce(group, record).alias("group_id"), group.isNull().alias("own_group"))


@query("SELECT ts AS version_time, event_type AS operation FROM events ORDER BY ts DESC, event_id DESC LIMIT 1")
def l03_last_entry(spark: SparkSession, sf: str) -> DataFrame:
    """The last entry of a history: a top-1, which keeps one row a task."""
    last = table(spark, sf, "events").orderBy(F.desc("ts"), F.desc("event_id")).limit(1)
    return last.select(F.col("ts").alias("version_time"), F.col("event_type").alias("operation"))


@query("""
WITH g AS (SELECT l_orderkey, count(*) AS n, count(DISTINCT l_returnflag) AS classes, count(*) FILTER (l_returnflag NOT IN ('A', 'N', 'R')) AS unknown FROM lineitem GROUP BY 1)
SELECT sum(n)::BIGINT AS n, count(*) AS groups, sum(unknown)::BIGINT AS unknown_class, count(*) FILTER (classes > 1) AS mixed_groups FROM g
""")
def g27_metadata_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Rows, groups, unknown classes and groups of mixed class, in two levels."""
    known = F.col("l_returnflag").isin("A", "N", "R")
    groups = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"), F.count_distinct("l_returnflag").alias("classes"), F.count_if(~known).alias("unknown"))
    return groups.agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum("unknown").alias("unknown_class"), F.count_if(F.col("classes") > 1).alias("mixed_groups"))


@query("""
WITH c AS (SELECT count(*) > 0 AS has_rows, count(*) = count(DISTINCT o_orderkey) AS keys_unique, count(*) FILTER (o_custkey IS NULL) = 0 AS owners_known, min(o_totalprice) >= 0 AS prices_valid FROM orders)
SELECT *, has_rows AND keys_unique AND owners_known AND prices_valid AS passed FROM c
""")
def g30_layer_checks(spark: SparkSession, sf: str) -> DataFrame:
    """Named checks of a layer in one row, and whether all hold."""
    n = F.count("*")
    checks = {"has_rows": n > 0, "keys_unique": n == F.count_distinct("o_orderkey"), "owners_known": F.count_if(F.col("o_custkey").isNull()) == 0, "prices_valid": F.min("o_totalprice") >= 0}
    row = table(spark, sf, "orders").agg(*(c.alias(name) for name, c in checks.items()))
    return row.withColumn("passed", F.expr(" AND ".join(checks)))


@query("""
WITH a AS (SELECT o_orderpriority AS site, avg((o_orderstatus = CASE WHEN o_totalprice > 100000 THEN 'O' ELSE 'F' END)::INT) AS accuracy, count(*) AS n FROM orders GROUP BY 1),
f AS (SELECT * FROM (VALUES ('1-URGENT', 0.3), ('2-HIGH', 0.9)) AS t(site, least))
SELECT site, n, round(accuracy, 9) AS accuracy, least::DOUBLE AS floor, accuracy >= least AS passed FROM f JOIN a USING (site)
""")
def g31_accuracy_floors(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracies against a short table of floors."""
    guess = F.when(F.col("o_totalprice") > 100000, "O").otherwise("F")
    right = (F.col("o_orderstatus") == guess).cast("int")
    found = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("site")).agg(F.avg(right).alias("a"), F.count("*").alias("n"))
    floors = spark.createDataFrame([("1-URGENT", 0.3), ("2-HIGH", 0.9)], "site string, floor double")
    return floors.join(found, "site").select("site", "n", F.round("a", 9).alias("accuracy"), "floor", (F.col("a") >= F.col("floor")).alias("passed"))


@query("""
WITH g AS (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1), t AS (SELECT count(*) AS total FROM lineitem)
SELECT any_value(total) AS total, sum(n)::BIGINT AS summed, any_value(total) = sum(n) AS passed FROM g, t
""")
def g32_groups_sum_to_total(spark: SparkSession, sf: str) -> DataFrame:
    """Group counts and the total from one pass of a rollup."""
    levels = table(spark, sf, "lineitem").rollup("l_returnflag").agg(F.count("*").alias("n"), F.grouping("l_returnflag").alias("all"))
    total, summed = F.sum(F.when(F.col("all") == 1, F.col("n"))), F.sum(F.when(F.col("all") == 0, F.col("n")))
    return levels.agg(total.alias("total"), summed.alias("summed"), (total == summed).alias("passed"))


@query("""
WITH m AS (SELECT month(ts)::INT * 100 + day(ts)::INT AS period, count(*) FILTER (event_type = 'purchase') AS scored, count(*) FILTER (event_type = 'error') AS failed FROM events GROUP BY 1)
SELECT period, scored, failed, CASE WHEN failed > scored THEN 'failed' WHEN scored = 0 THEN 'no_new_data' ELSE 'scored' END AS status FROM m
""")
def d08_period_status(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a period failed, had no new data or was scored."""
    period = F.month("ts") * 100 + F.dayofmonth("ts")
    counts = table(spark, sf, "events").groupBy(period.alias("period")).agg(F.count_if(F.col("event_type") == "purchase").alias("scored"), F.count_if(F.col("event_type") == "error").alias("failed"))
    status = F.when(F.col("failed") > F.col("scored"), "failed").when(F.col("scored") == 0, "no_new_data").otherwise("scored")
    return counts.withColumn("status", status)


@query("SELECT event_id, value AS score, CASE WHEN value > 50 THEN NULL ELSE user_id % 7 END AS shown, value > 50 AS abstained FROM events")
def i08_abstained(spark: SparkSession, sf: str) -> DataFrame:
    """An answer is shown unless the score is above the threshold."""
    over = F.col("value") > 50
    return table(spark, sf, "events").select("event_id", F.col("value").alias("score"), F.when(~over, F.col("user_id") % 7).alias("shown"), over.alias("abstained"))


@query("""
SELECT vec_id, len(embedding) >= 8 AS whole,
  round(list_sum(list_transform(range(1, 9), lambda i: i * (embedding[i]::DOUBLE + embedding[9 - i]::DOUBLE) / 2)), 6) AS weighed FROM embeddings
""")
def v20_flip_mean(spark: SparkSession, sf: str) -> DataFrame:
    """The mean of eight logits and those of the flipped view, component by component."""
    view = F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))
    mean = F.zip_with(view, F.reverse(view), lambda a, b: (a + b) / 2)
    weighed = F.aggregate(F.transform(mean, lambda x, i: (i + 1) * x), F.lit(0.0), lambda s, x: s + x)
    return table(spark, sf, "embeddings").select("vec_id", (F.size("embedding") >= 8).alias("whole"), F.round(weighed, 6).alias("weighed"))


@query("""
WITH v AS (SELECT event_type AS model, event_id AS version, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS r FROM events),
b AS (SELECT event_type AS model, max(value) AS best FROM events GROUP BY 1)
SELECT model, a.version AS champion, c.version AS previous, a.value >= b.best AS is_best FROM v a JOIN v c USING (model) JOIN b USING (model) WHERE a.r = 1 AND c.r = 2
""")
def b05_alias_moves(spark: SparkSession, sf: str) -> DataFrame:
    """Where the aliases of each model go: the newest version and the one before it.

    The two newest and the best come from partial aggregates, not from an ordered group.
    """
    events = table(spark, sf, "events")
    newest = events.groupBy(F.col("event_type").alias("model")).agg(F.max_by("value", "event_id").alias("value"), F.max("event_id").alias("champion"), F.max("value").alias("best"))
    older = events.select("event_type", "event_id").join(newest, (F.col("event_type") == F.col("model")) & (F.col("event_id") < F.col("champion")))
    return older.groupBy("model", "champion", "value", "best").agg(F.max("event_id").alias("previous")).select("model", "champion", "previous", (F.col("value") >= F.col("best")).alias("is_best"))


@query("SELECT level, quantile_disc(ms, 0.5) AS p50, quantile_disc(ms, 0.95) AS p95, count(*) AS n FROM (SELECT user_id % 3 AS level, floor(value)::BIGINT AS ms FROM events) GROUP BY 1")
def a32_latency(spark: SparkSession, sf: str) -> DataFrame:
    """Latency percentiles by load, over counts of whole milliseconds."""
    counts = table(spark, sf, "events").groupBy((F.col("user_id") % 3).alias("level"), F.floor("value").alias("ms")).agg(F.count("*").alias("n"))
    return nearest_rank(counts, ["level"], "ms", "n", [("p50", 0.5), ("p95", 0.95)])

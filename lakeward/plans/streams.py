"""Queries that run a stream over the event file to its end and read what it wrote."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.operators.tables import folder
from lakeward.plans.monitoring import _KS
from lakeward.registry import query, table
from lakeward.sources import files
from lakeward.streaming import drift as D
from lakeward.streaming import events as E
from lakeward.streaming import labels as L
from lakeward.streaming import limits


def _stream(spark: SparkSession, sf: str, delay: str = "60 days") -> DataFrame:
    schema = table(spark, sf, "events").schema
    return E.event_stream(spark, sf, schema, delay, pathGlobFilter="events.parquet")


def _finished(stream: DataFrame, path: str) -> DataFrame:
    """The stream's rows once all there is has been read."""
    writer = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}/log").trigger(availableNow=True)
    run = writer.start(f"{path}/out")
    run.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")


@query("SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS distinct_n FROM events GROUP BY 1")
def t01_distinct_ingest(spark: SparkSession, sf: str) -> DataFrame:
    """A file stream with keys delivered once."""
    out = _finished(E.distinct_events(_stream(spark, sf), "event_id"), folder(spark))
    return out.groupBy("event_type").agg(F.count("*").alias("n"), F.count_distinct("event_id").alias("distinct_n"))


@query("""
WITH d AS (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, sum(value) AS total FROM events GROUP BY 1, 2), m AS (SELECT max(ts) - INTERVAL 2 DAYS AS mark FROM events)
SELECT strftime(start, '%Y-%m-%d') AS day, event_type, n, round(total, 4) AS total FROM d, m WHERE start + INTERVAL 1 DAY <= mark
""")
def t02_closed_windows(spark: SparkSession, sf: str) -> DataFrame:
    """Daily windows that the watermark has closed."""
    out = _finished(E.windowed(_stream(spark, sf, "2 days"), "1 day", "event_type"), folder(spark))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 4).alias("total"))


@query(_KS + """, p AS (SELECT event_type, n_now, ks, psi, ks * sqrt(n_base::DOUBLE * n_now / (n_base + n_now)) AS x FROM k JOIN psi USING (event_type)),
r AS (SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * j * j * x * x))) END < 0.01 AND psi >= 0.2 AND n_now >= 100 AS alert FROM p)
SELECT event_type, round(ks, 9) AS ks, round(psi, 6) AS psi, alert, n_now >= 100 AND NOT alert AND psi >= 0.1 AS warning FROM r""")
def t02_batch_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Each micro-batch against a static baseline."""
    path = folder(spark)
    baseline = table(spark, sf, "events").where(F.day("ts") <= 10)
    writer = _stream(spark, sf).where(F.day("ts") > 10).writeStream.foreachBatch(E.drift_writer(baseline, "event_type", "value", f"{path}/out"))
    run = writer.option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{path}/out").select("event_type", F.round("ks", 9).alias("ks"), F.round("psi", 6).alias("psi"), "alert", "warning")


@query("""
WITH m AS (SELECT max(ts) - INTERVAL 2 DAYS AS mark FROM events WHERE day(ts) > 10), b AS (SELECT event_type, value FROM events WHERE day(ts) <= 10),
n AS (SELECT time_bucket(INTERVAL 5 DAYS, ts, TIMESTAMP '1970-01-01') AS start, event_type, value FROM events WHERE day(ts) > 10),
w AS (SELECT * FROM n, m WHERE start + INTERVAL 5 DAYS <= mark), k AS (SELECT DISTINCT start, event_type FROM w),
e AS (SELECT start, event_type, value, false AS base FROM w UNION ALL SELECT start, event_type, value, true FROM k JOIN b USING (event_type)),
c AS (SELECT start, event_type, value, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS n FROM e GROUP BY 1, 2, 3),
g AS (SELECT start, event_type, b, n, abs(sum(b) OVER w / sum(b) OVER a - sum(n) OVER w / sum(n) OVER a) AS gap FROM c WINDOW a AS (PARTITION BY start, event_type), w AS (PARTITION BY start, event_type ORDER BY value ROWS UNBOUNDED PRECEDING)),
ks AS (SELECT start, event_type, sum(b)::BIGINT AS n_base, sum(n)::BIGINT AS n_now, max(gap) AS ks FROM g GROUP BY 1, 2),
q AS (SELECT event_type, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM b GROUP BY 1),
h AS (SELECT start, e.event_type, len(list_filter(edges, lambda x: x <= value)) AS bin, count(*) FILTER (base) AS b, count(*) FILTER (NOT base) AS n FROM e JOIN q USING (event_type) GROUP BY ALL),
s AS (SELECT start, event_type, b / sum(b) OVER a + 1e-6 AS o, n / sum(n) OVER a + 1e-6 AS c FROM h WINDOW a AS (PARTITION BY start, event_type)), psi AS (SELECT start, event_type, sum((c - o) * ln(c / o)) AS psi FROM s GROUP BY 1, 2),
x AS (SELECT *, ks * sqrt(n_base::DOUBLE * n_now / (n_base + n_now)) AS x FROM ks JOIN psi USING (start, event_type)),
p AS (SELECT *, CASE WHEN x < 0.2 THEN 1.0 ELSE greatest(0, least(1, list_sum(list_transform(range(1, 101), lambda j: (CASE WHEN j % 2 = 1 THEN 2.0 ELSE -2.0 END) * exp(-2.0 * j * j * x * x))))) END AS p FROM x)
SELECT strftime(start, '%Y-%m-%d') AS day, event_type, n_base, n_now, round(ks, 9) AS ks, round(psi, 6) AS psi, n_now >= 100 AND p < 0.01 AND psi >= 0.2 AS alert, n_now >= 100 AND NOT (p < 0.01 AND psi >= 0.2) AND psi >= 0.1 AS warning FROM p
""")
def t02_window_drift(spark: SparkSession, sf: str) -> DataFrame:
    """Five-day windows against the first ten days, scored once the watermark has closed
    them; state is a sketch for each window and type (T02, D02)."""
    path = folder(spark)
    D.summary(table(spark, sf, "events").where(F.day("ts") <= 10), "event_type", "value").write.parquet(f"{path}/baseline")
    held = D.windows(_stream(spark, sf, "2 days").where(F.day("ts") > 10), "ts", "event_type", "value", "5 days")
    out = _finished(D.scored(held, spark.read.parquet(f"{path}/baseline"), "event_type"), path)
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n_base", "n_now", F.round("ks", 9).alias("ks"), F.round("psi", 6).alias("psi"), "alert", "warning")


@query("""
WITH m AS (SELECT least((SELECT max(o_orderdate) FROM orders), (SELECT max(l_shipdate) FROM lineitem)) - INTERVAL 30 DAYS AS mark),
j AS (SELECT o_orderkey, o_orderdate, o_orderpriority, l_shipdate, l_returnflag FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey AND l_shipdate >= o_orderdate AND l_shipdate <= o_orderdate + INTERVAL 365 DAYS
      QUALIFY row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_linenumber, l_returnflag) = 1),
r AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, (l_returnflag = 'R') = (o_orderpriority < '3') AS verdict FROM j, m WHERE l_returnflag IS NOT NULL OR o_orderdate + INTERVAL 365 DAYS < mark)
SELECT month, count(*) AS n, count(verdict) AS labelled, count(*) - count(verdict) AS unlabelled, round(avg(verdict::INT), 9) AS accuracy, count(verdict) >= 100 AS enough FROM r GROUP BY 1
""")
def a31_late_labels(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as predictions, returns of their lines within a year as labels that arrive
    later, joined as streams; months by what has come (A31, D17, J20)."""

    def stream(name: str, time: str) -> DataFrame:
        rows = spark.readStream.schema(table(spark, sf, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(sf)
        return rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, "30 days")

    orders = stream("orders", "o_orderdate").select("o_orderkey", "o_orderdate", "o_orderpriority")
    lines = stream("lineitem", "l_shipdate").select(F.col("l_orderkey").alias("o_orderkey"), "l_shipdate", "l_linenumber", "l_returnflag")
    joined = _finished(L.awaited(orders, lines, "o_orderkey", "o_orderdate", "l_shipdate", "365 days"), folder(spark))
    rows = L.settled(joined, "o_orderkey", "o_orderdate", "l_shipdate", "l_returnflag", "l_linenumber")
    right = (F.col("l_returnflag") == "R") == (F.col("o_orderpriority") < "3")
    rows = rows.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), right.alias("right"))
    return L.delayed_accuracy(rows, "month", "right").withColumn("accuracy", F.round("accuracy", 9))


@query("""
WITH r AS (SELECT user_id, event_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
t AS (WITH RECURSIVE s AS (SELECT user_id, i, event_id, ts AS a, NULL::TIMESTAMP AS b, true AS passed FROM r WHERE i = 1
  UNION ALL SELECT r.user_id, r.i, r.event_id, CASE WHEN s.b IS NOT NULL AND s.b > r.ts - INTERVAL 2 DAYS THEN s.a ELSE r.ts END,
  CASE WHEN s.b IS NOT NULL AND s.b > r.ts - INTERVAL 2 DAYS THEN s.b ELSE s.a END, NOT (s.b IS NOT NULL AND s.b > r.ts - INTERVAL 2 DAYS) FROM s JOIN r ON r.user_id = s.user_id AND r.i = s.i + 1) SELECT * FROM s)
SELECT user_id AS key, event_id, passed FROM t
""")
def t03_rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    """At most two requests of a client in two days, as keyed stream state."""
    with limits.kept_in_rocksdb(spark):
        return _finished(E.rate_limited(_stream(spark, sf), "user_id", 2, 2 * 86_400), folder(spark))


@query("""
WITH RECURSIVE o AS (SELECT user_id, event_id, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
c AS (SELECT user_id, event_id, us, i, [us] AS held, true AS ok FROM o WHERE i = 1
  UNION ALL SELECT o.user_id, o.event_id, o.us, o.i, CASE WHEN len(list_filter(held, lambda t: t > o.us - 172800000000)) < 3 THEN list_append(list_filter(held, lambda t: t > o.us - 172800000000), o.us) ELSE list_filter(held, lambda t: t > o.us - 172800000000) END,
  len(list_filter(held, lambda t: t > o.us - 172800000000)) < 3 FROM c JOIN o ON o.user_id = c.user_id AND o.i = c.i + 1),
p AS MATERIALIZED (SELECT event_id, us, row_number() OVER (ORDER BY us, event_id) AS i FROM c WHERE ok),
t AS (SELECT event_id, us, i, [us] AS held, true AS ok FROM p WHERE i = 1
  UNION ALL SELECT p.event_id, p.us, p.i, CASE WHEN len(list_filter(held, lambda t: t > p.us - 172800000000)) < 150 THEN list_append(list_filter(held, lambda t: t > p.us - 172800000000), p.us) ELSE list_filter(held, lambda t: t > p.us - 172800000000) END,
  len(list_filter(held, lambda t: t > p.us - 172800000000)) < 150 FROM t JOIN p ON p.i = t.i + 1),
m AS (SELECT epoch_us(max(ts)) - 3600000000 AS mark FROM events)
SELECT c.user_id AS client, c.event_id, CASE WHEN NOT c.ok THEN 'client' WHEN NOT t.ok THEN 'total' ELSE 'passed' END AS verdict FROM c LEFT JOIN t ON c.event_id = t.event_id, m WHERE c.us <= mark
""")
def b01_total_limit(spark: SparkSession, sf: str) -> DataFrame:
    """At most three requests of a client and 150 of all in two days, judged in the order
    of their times once the watermark has passed them (B01, T03)."""
    with limits.kept_in_rocksdb(spark):
        out = _finished(limits.limited(_stream(spark, sf, "1 hour"), "user_id", "event_id", "ts", 3, 150, 2 * 86_400), folder(spark))
    return out.select("client", "event_id", "verdict")


@query("""
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 12 HOURS THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, count(*) AS sessions, max(n) AS longest FROM (SELECT user_id, k, count(*) AS n FROM s GROUP BY 1, 2) GROUP BY 1
""")
def t04_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions by gap, over the same plan as a batch."""
    rows = table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return E.sessions(rows, "12 hours", "user_id").groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


@query("SELECT 1 AS version, count(*) AS n FROM region UNION ALL SELECT 2, count(*) - 1 FROM region UNION ALL SELECT 3, count(*) FROM region")
def s11_versions(spark: SparkSession, sf: str) -> DataFrame:
    """A table rewritten from itself, restored, and read by version."""
    held = files.VersionedTable(spark, folder(spark))
    held.create(table(spark, sf, "region"))
    held.write(held.read().where("r_regionkey <> 0"))
    held.restore(1)
    out = None
    for v in held.versions():
        part = held.read(v).agg(F.count("*").alias("n")).select(F.lit(v).alias("version"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT c_custkey, c_name, '' AS note FROM customer")
def s07_text_csv(spark: SparkSession, sf: str) -> DataFrame:
    """CSV written and read back as text, empty fields kept."""
    path = folder(spark)
    rows = table(spark, sf, "customer").select(F.col("c_custkey").cast("string"), "c_name", F.lit("").alias("note"))
    rows.write.option("header", True).option("emptyValue", '""').csv(path)
    return files.text_csv(spark, path, rows.columns).withColumn("c_custkey", F.col("c_custkey").cast("long"))


@query("SELECT user_id AS id, max(event_type) AS state FROM events GROUP BY 1")
def s08_last_delivery(spark: SparkSession, sf: str) -> DataFrame:
    """JSON lines delivered in several files, the last file of an id wins."""
    path = folder(spark)
    rows = table(spark, sf, "events").select(F.col("user_id").alias("id"), F.col("event_type").alias("state"))
    rows.distinct().withColumn("file", F.col("state")).write.partitionBy("file").json(path)
    read = files.json_lines(spark, f"{path}/*", "id long, state string", stream=False)
    return files.last_per_key(read, "id").select("id", "state")


@query("SELECT p_partkey FROM part WHERE p_partkey % 4 <> 0")
def k11_to_land(spark: SparkSession, sf: str) -> DataFrame:
    part = table(spark, sf, "part").select("p_partkey")
    return files.landed(part, part.where("p_partkey % 4 = 0"), "p_partkey")


@query("SELECT page_id, url, octet_length(encode(html))::BIGINT AS bytes, sha256(html) AS sha256 FROM pages")
def k12_landed_whole(spark: SparkSession, sf: str) -> DataFrame:
    """Pages landed with size and hash, all or none: one without a text or an address would
    leave nothing and be listed (K12)."""
    html = F.col("html")
    wrong = F.when(html.isNull(), "no text").when(F.coalesce(F.col("url"), F.lit("")) == "", "no address")
    pages = table(spark, sf, "pages").select("page_id", "url", F.octet_length(html).cast("long").alias("bytes"), F.sha2(html.cast("binary"), 256).alias("sha256"), wrong.alias("error"))
    return files.landed_whole(pages, "page_id", "error", folder(spark))


@query("SELECT page_id, CASE WHEN length(html) < 4000 THEN 'short' END AS error FROM pages WHERE length(html) < 4000")
def k15_quarantine(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", F.when(F.length("html") < 4000, "short").alias("error"))
    return files.quarantined(pages, "error")[1]


@query("""SELECT c_nationkey, to_json({'n': count(*), 'top': max(c_custkey)})::VARCHAR AS record FROM customer GROUP BY 1""")
def k18_json_record(spark: SparkSession, sf: str) -> DataFrame:
    """Whole records as JSON text."""
    record = F.to_json(F.struct(F.count("*").alias("n"), F.max("c_custkey").alias("top")))
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(record.alias("record"))

"""Queries over evidence, further evaluation, and rules on small tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeward.functions import columns as C
from lakeward.operators import evidence as E
from lakeward.operators import gates as G
from lakeward.operators import monitoring as M
from lakeward.operators import relational as R
from lakeward.operators import statistics as S
from lakeward.operators import views
from lakeward.operators.ranks import quantile
from lakeward.operators.tables import folder
from lakeward.registry import query, table


@query("SELECT event_id AS key, 'k' AS path, (props::JSON ->> '$.k')::DOUBLE AS value FROM events")
def k16_numeric_leaves(spark: SparkSession, sf: str) -> DataFrame:
    """Numbers of JSON documents as path-keyed metrics."""
    return E.leaves(table(spark, sf, "events"), "event_id", "props")


_INDEX = "i AS (SELECT page_id::VARCHAR AS name, CASE WHEN page_id % 6 = 0 THEN 'old' ELSE sha256(html) END AS sha256 FROM pages UNION ALL SELECT 'gone', 'x'), f AS (SELECT page_id::VARCHAR AS name, sha256(html) AS now FROM pages)"


@query(f"WITH {_INDEX} SELECT name, CASE WHEN now IS NULL THEN 'missing' ELSE 'changed' END AS reason FROM i LEFT JOIN f USING (name) WHERE now IS DISTINCT FROM sha256")
def k17_stale(spark: SparkSession, sf: str) -> DataFrame:
    files, index = _pages(spark, sf)
    return E.stale(files, index)


def _pages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    pages = table(spark, sf, "pages")
    files = pages.select(F.col("page_id").cast("string").alias("name"), F.col("html").alias("content"))
    digest = F.when(F.col("page_id") % 6 == 0, "old").otherwise(F.sha2("html", 256))
    index = pages.select(F.col("page_id").cast("string").alias("name"), digest.alias("sha256"))
    return files, index.unionByName(spark.createDataFrame([("gone", "x")], "name string, sha256 string"))


@query(f"""WITH {_INDEX}, s AS (SELECT count(*) AS n FROM i LEFT JOIN f USING (name) WHERE now IS DISTINCT FROM sha256)
SELECT 'plain_name' AS name, count(*) FILTER (NOT regexp_full_match(name, '[A-Za-z0-9_][A-Za-z0-9_.-]*')) AS violations, count(*) FILTER (NOT regexp_full_match(name, '[A-Za-z0-9_][A-Za-z0-9_.-]*')) = 0 AS passed FROM i UNION ALL SELECT 'listed_once', 0, true UNION ALL SELECT 'as_hashed', n, n = 0 FROM s""")
def b03_manifest(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest's names and hashes against the files."""
    files, index = _pages(spark, sf)
    return E.manifest_gates(index, files)


@query("""
WITH k AS (SELECT 'part|' || p_partkey AS key, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode('part|' || p_partkey)) AS h FROM part),
u AS (SELECT key, ('0x' || substr(h, 1, 12) || '5' || substr(h, 14, 3))::UBIGINT::UHUGEINT AS hi, (('0x' || substr(h, 17, 16))::UBIGINT & 4611686018427387903::UBIGINT | 9223372036854775808::UBIGINT)::UHUGEINT AS lo FROM k)
SELECT key, '2.25.' || (hi * 18446744073709551616::UHUGEINT + lo) AS uid FROM u
""")
def o10_uid(spark: SparkSession, sf: str) -> DataFrame:
    """UUID-derived identifiers of keys."""
    return E.with_uid(table(spark, sf, "part").select(F.concat(F.lit("part|"), F.col("p_partkey").cast("string")).alias("key")), "key")


@query("""
WITH u AS (SELECT p_partkey, p_brand, p_size FROM part), e AS (SELECT p_partkey, CASE WHEN p_partkey % 17 = 0 THEN p_brand || '-moved' ELSE p_brand END AS brand, CASE WHEN p_partkey <> (SELECT min(p_partkey) FROM u) THEN p_size END AS size FROM u),
f AS (SELECT * FROM e UNION ALL SELECT * FROM e WHERE p_partkey = (SELECT max(p_partkey) FROM u))
SELECT 'labelled' AS name, count(*) FILTER (size IS NULL) AS violations, count(*) FILTER (size IS NULL) = 0 AS passed FROM f UNION ALL SELECT 'key', count(*), count(*) = 0 FROM (SELECT 1 FROM f GROUP BY p_partkey HAVING count(*) > 1)
UNION ALL SELECT 'brand_known', count(*), count(*) = 0 FROM f WHERE brand NOT IN (SELECT p_brand FROM u)
""")
def s24_planted_faults(spark: SparkSession, sf: str) -> DataFrame:
    """Planted faults, and the gates that find exactly them."""
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("brand"), F.col("p_size").alias("size"))
    bad = E.faulty(part, "p_partkey", F.col("p_partkey") % 17 == 0, "size", "brand")
    return G.all_gates(G.row_gates(bad, {"labelled": F.col("size").isNull()}), G.unique_gate(bad, "key", ["p_partkey"]), G.reference_gate(bad, "brand_known", "brand", part.select("brand").distinct(), "brand"))


@query("SELECT n_nationkey AS concept_id, n_name AS concept_name FROM nation WHERE n_nationkey % 3 = 0")
def s25_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """A tab-separated vocabulary, delivered twice, kept for the wanted ids once."""
    path = folder(spark)
    nation = table(spark, sf, "nation").select(F.col("n_nationkey").alias("concept_id"), F.col("n_name").alias("concept_name"))
    for part in ("a", "b"):
        nation.write.option("sep", "\t").option("header", True).csv(f"{path}/{part}")
    read = spark.read.schema("concept_id int, concept_name string").option("sep", "\t").option("header", True).csv(f"{path}/*")
    return read.join(nation.where("concept_id % 3 = 0").select("concept_id"), "concept_id", "left_semi").dropDuplicates(["concept_id"])


@query("SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'asked' WHEN regexp_matches(text, '(?i)\\bthe\\b') THEN 'english' ELSE 'other' END AS stratum FROM conversations WHERE regexp_matches(text, '[a-z]')")
def s16_notes(spark: SparkSession, sf: str) -> DataFrame:
    """Notes that pass a pattern, with their stratum."""
    notes = table(spark, sf, "conversations").where(F.col("text").rlike("[a-z]"))
    stratum = F.when(F.col("role") == "user", "asked").when(F.col("text").rlike(r"(?i)\bthe\b"), "english").otherwise("other")
    return notes.select("conv_id", "turn", stratum.alias("stratum"))


@query("""
SELECT p_partkey, CASE WHEN p_size >= 45 THEN 'override' WHEN p_brand IN ('Brand#1', 'Brand#2', 'Brand#3') THEN 'low' WHEN p_brand = 'Brand#4' THEN 'mid' END AS class, coalesce(nullif(p_size % 7, 0)::VARCHAR, 'unknown') AS grp,
CASE WHEN p_size % 5 = 0 THEN 'invalid' ELSE (p_size % 5)::VARCHAR END AS answer FROM part WHERE p_partkey NOT IN (SELECT p_partkey FROM part WHERE p_partkey % 13 = 0)
""")
def p10_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Class mapping, group keys, exclusion lists, scored answers."""
    part = table(spark, sf, "part")
    kinds = F.create_map(*(F.lit(x) for x in ("Brand#1", "low", "Brand#2", "low", "Brand#3", "low", "Brand#4", "mid")))
    documented = part.where("p_partkey % 13 = 0").select("p_partkey")
    return part.join(documented, "p_partkey", "left_anti").select(
        "p_partkey", F.when(F.col("p_size") >= 45, "override").otherwise(kinds[F.col("p_brand")]).alias("class"), C.known_key(F.col("p_size") % 7).alias("grp"),
        F.when(F.col("p_size") % 5 == 0, "invalid").otherwise((F.col("p_size") % 5).cast("string")).alias("answer"),
    )


@query("SELECT o_orderpriority, CASE o_orderpriority WHEN '1-URGENT' THEN 'gpu' WHEN '2-HIGH' THEN 'gpu' ELSE 'cpu' END AS kind, count(*) AS n FROM orders GROUP BY ALL")
def p19_closed_list(spark: SparkSession, sf: str) -> DataFrame:
    """A closed list; a value outside it stops the query."""
    known = F.col("o_orderpriority")
    kind = F.when(known.isin("1-URGENT", "2-HIGH"), "gpu").when(known.isin("3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"), "cpu").otherwise(F.raise_error(F.concat(F.lit("unknown value "), known)))
    return table(spark, sf, "orders").groupBy("o_orderpriority", kind.alias("kind")).agg(F.count("*").alias("n"))


@query("""
WITH s AS (SELECT label, vec_id % 3 AS seed, avg((embedding[1] > 0)::INT) AS metric FROM embeddings GROUP BY 1, 2) SELECT label, round(avg(metric), 9) AS mean, round(min(metric), 9) AS least, round(max(metric), 9) AS most FROM s GROUP BY 1
""")
def a20_over_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Mean and range of a metric over seeds."""
    each = table(spark, sf, "embeddings").groupBy("label", (F.col("vec_id") % 3).alias("seed")).agg(F.avg((F.element_at("embedding", 1) > 0).cast("int")).alias("metric"))
    return each.groupBy("label").agg(*(F.round(f("metric"), 9).alias(n) for f, n in ((F.avg, "mean"), (F.min, "least"), (F.max, "most"))))


@query("""
SELECT user_id % 20 AS definition, count(*) FILTER (event_type = 'purchase') AS runs, count(*) FILTER (event_type LIKE 'e%') AS refusals,
round((epoch_us(min(ts) FILTER (event_type = 'purchase')) - epoch_us(min(ts))) / 3600e6, 6) AS hours FROM events GROUP BY 1
""")
def a22_log_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Runs, refusals and hours from the first event to approval."""
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    bought = F.col("event_type") == "purchase"
    hours = (F.min(F.when(bought, at)) - F.min(at)) / 3600e6
    return table(spark, sf, "events").groupBy((F.col("user_id") % 20).alias("definition")).agg(F.count_if(bought).alias("runs"), F.count_if(F.col("event_type").startswith("e")).alias("refusals"), F.round(hours, 6).alias("hours"))


@query("""
WITH c AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'), o AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'O')
SELECT n_name, count(*) AS customers, count(c.o_custkey) AS filled, count(o.o_custkey) AS open, count(*) FILTER (c.o_custkey IS NOT NULL AND o.o_custkey IS NOT NULL) AS both_kinds FROM customer
JOIN nation ON n_nationkey = c_nationkey LEFT JOIN c ON c.o_custkey = c_custkey LEFT JOIN o ON o.o_custkey = c_custkey GROUP BY 1
""")
def a29_overlap(spark: SparkSession, sf: str) -> DataFrame:
    """How far two sets of keys overlap in each group."""
    seen = table(spark, sf, "orders").groupBy("o_custkey").agg(F.max(F.col("o_orderstatus") == "F").alias("f"), F.max(F.col("o_orderstatus") == "O").alias("o"))
    people = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(seen, F.col("c_custkey") == F.col("o_custkey"), "left")
    f, o = F.coalesce("f", F.lit(False)), F.coalesce("o", F.lit(False))
    return people.groupBy("n_name").agg(F.count("*").alias("customers"), F.count_if(f).alias("filled"), F.count_if(o).alias("open"), F.count_if(f & o).alias("both_kinds"))


@query("""
WITH g AS (SELECT label, unnest([0, 1, 2]) AS c, embedding FROM embeddings), s AS (SELECT c, embedding[c + 1]::DOUBLE AS x, label % 3 = c AS pos FROM g),
r AS (SELECT c, pos, rank() OVER (PARTITION BY c ORDER BY x) + (count(*) OVER (PARTITION BY c, x) - 1) / 2.0::DOUBLE AS r FROM s),
a AS (SELECT c, (sum(r) FILTER (pos) - count(*) FILTER (pos) * (count(*) FILTER (pos) + 1) / 2.0::DOUBLE) / (count(*) FILTER (pos) * count(*) FILTER (NOT pos)) AS auroc FROM r GROUP BY 1)
SELECT count(*) AS classes, round(avg(auroc), 9) AS macro_auroc FROM a
""")
def v01_macro_auroc(spark: SparkSession, sf: str) -> DataFrame:
    """One class against the rest, averaged over classes that have both signs."""
    scores = F.posexplode(F.transform(F.slice("embedding", 1, 3), lambda x: x.cast("double"))).alias("c", "x")
    rows = table(spark, sf, "embeddings").select("label", scores).select("c", "x", (F.col("label") % 3 == F.col("c")).alias("positive"))
    return S.auroc(rows, ["c"], "x", "positive").where("auroc is not null").agg(F.count("*").alias("classes"), F.round(F.avg("auroc"), 9).alias("macro_auroc"))


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id), 6) AS mean FROM events")
def v04_group_mean(spark: SparkSession, sf: str) -> DataFrame:
    """Each row with the mean over its group, joined back."""
    events = table(spark, sf, "events").select("event_id", "user_id", "value")
    return events.join(events.groupBy("user_id").agg(F.round(F.avg("value"), 6).alias("mean")), "user_id").select("event_id", "mean")


@query("""
SELECT vec_id, len(v) AS width, round(list_sum(v), 5) AS total FROM (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) || [label::DOUBLE, 1.0] AS v FROM embeddings)
""")
def v21_assembled(spark: SparkSession, sf: str) -> DataFrame:
    """Arrays put together, with a check of the length."""
    whole = F.concat(F.col("embedding").cast("array<double>"), F.array(F.col("label").cast("double"), F.lit(1.0)))
    rows = table(spark, sf, "embeddings").select("vec_id", whole.alias("v"))
    checked = F.when(F.size("v") == 66, F.col("v")).otherwise(F.raise_error(F.lit("a vector has another width")))
    return rows.select("vec_id", F.size(checked).cast("long").alias("width"), F.round(C.total(checked), 5).alias("total"))


@query("""
WITH a AS (SELECT label, avg(embedding[1]::DOUBLE) AS x FROM embeddings GROUP BY 1), b AS (SELECT label, avg(embedding[1]::DOUBLE) + CASE WHEN label = 3 THEN 1e-3 ELSE 1e-12 END AS y FROM embeddings GROUP BY 1)
SELECT label, abs(x - y) <= 1e-9 AS same FROM a JOIN b USING (label)
""")
def v17_tolerance(spark: SparkSession, sf: str) -> DataFrame:
    """A rebuilt metric equals the committed one within a tolerance."""
    a = table(spark, sf, "embeddings").groupBy("label").agg(F.avg(F.element_at("embedding", 1).cast("double")).alias("x"))
    b = a.select(F.col("label").alias("l"), (F.col("x") + F.when(F.col("label") == 3, 1e-3).otherwise(1e-12)).alias("y"))
    return a.join(b, F.col("label") == F.col("l")).select("label", (F.abs(F.col("x") - F.col("y")) <= 1e-9).alias("same"))


@query("""
WITH s AS (SELECT user_id, event_type = 'error' AS changed, min(CASE WHEN value > 100 THEN day(ts) END) AS first FROM events GROUP BY 1, 2), t AS (SELECT changed, count(*) AS n, count(first) AS hits, quantile_cont(first, 0.5) AS median_day FROM s GROUP BY 1)
SELECT changed, n, hits, median_day, round(greatest(0, (hits / n + 3.841458820694124 / (2 * n)) / (1 + 3.841458820694124 / n) - 1.959963984540054 * sqrt((hits / n) * (1 - hits / n) / n + 3.841458820694124 / (4 * n * n)) / (1 + 3.841458820694124 / n)), 6) AS low FROM t
""")
def d21_detection(spark: SparkSession, sf: str) -> DataFrame:
    """How often and how soon sequences are detected, with Wilson rates."""
    first = F.min(F.when(F.col("value") > 100, F.day("ts")))
    runs = table(spark, sf, "events").groupBy("user_id", (F.col("event_type") == "error").alias("changed")).agg(first.alias("first"))
    out = runs.groupBy("changed").agg(F.count("*").alias("n"), F.count("first").alias("hits")).join(quantile(runs, ["changed"], "first", 0.5, "median_day"), "changed", "left")
    return out.withColumn("low", F.round(C.wilson(F.col("hits"), F.col("n"))[0], 6))


@query("""
WITH m AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS positives, count(*) FILTER (o_orderstatus <> 'F') AS hits FROM orders GROUP BY 1),
p AS (SELECT a.month AS as_of, b.* FROM m a JOIN m b ON b.month <= a.month), w AS (SELECT *, coalesce(sum(positives) OVER (PARTITION BY as_of ORDER BY month DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p),
s AS (SELECT as_of, count(*) AS months, sum(positives)::BIGINT AS positives, sum(hits)::BIGINT AS hits FROM w WHERE before < 300 GROUP BY 1)
SELECT as_of, months, positives, hits, CASE WHEN positives < 300 THEN 'insufficient' WHEN hits / positives >= 0.5 THEN 'met' ELSE 'broken' END AS status FROM s
""")
def d28_replay(spark: SparkSession, sf: str) -> DataFrame:
    """The target as it stood after each month, over one row a month."""
    months = table(spark, sf, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM").alias("month")).agg(F.count("*").alias("positives"), F.count_if(F.col("o_orderstatus") != "F").alias("hits"))
    known = months.select(F.col("month").alias("as_of")).join(months, F.col("month") <= F.col("as_of"))
    return M.target_status(known, ["as_of"], "month", "hits", "positives", 0.5, least=300).select("as_of", "months", "positives", "hits", "status")


@query("SELECT label, vec_id FROM embeddings QUALIFY row_number() OVER (PARTITION BY label ORDER BY round(embedding[1]::DOUBLE, 1) DESC, vec_id) = 1")
def l06_argmax(spark: SparkSession, sf: str) -> DataFrame:
    """The best row of each class, the earlier of equals."""
    score = F.round(F.element_at("embedding", 1).cast("double"), 1)
    return table(spark, sf, "embeddings").groupBy("label").agg(F.max_by("vec_id", F.struct(score, -F.col("vec_id"))).alias("vec_id"))


@query("""
WITH k AS (SELECT n_regionkey, array_to_string(list_sort(list(DISTINCT n_nationkey)), ',') AS ids, sha256(array_to_string(list_sort(list(DISTINCT n_name)), chr(10))) AS digest, count(*) AS n FROM nation GROUP BY 1) SELECT * FROM k
""")
def x05_selection(spark: SparkSession, sf: str) -> DataFrame:
    """A selection's size, ids and the hash that names it."""
    ids = F.array_join(F.transform(F.sort_array(F.collect_set("n_nationkey")), lambda x: x.cast("string")), ",")
    digest = F.sha2(F.array_join(F.sort_array(F.collect_set("n_name")), "\n"), 256)
    return table(spark, sf, "nation").groupBy("n_regionkey").agg(ids.alias("ids"), digest.alias("digest"), F.count("*").alias("n"))


@query("""
SELECT o_orderkey, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) AS days, date_trunc('month', o_orderdate)::DATE AS month, (date_trunc('month', o_orderdate) + INTERVAL 1 MONTH)::DATE AS next_month, round(ln(o_totalprice + 1), 9) AS log_price,
sign(o_totalprice - 100000)::INT AS side, ceil(sqrt(o_totalprice))::BIGINT AS root, bit_count((o_orderkey & 255)::BIGINT)::INT AS bits, md5(o_orderstatus) AS digest FROM orders
""")
def f03_dates_and_maths(spark: SparkSession, sf: str) -> DataFrame:
    """Dates, logarithms, roots, bits and digests (2.9)."""
    date, price = F.to_date("o_orderdate"), F.col("o_totalprice")
    month = F.trunc(date, "month")
    return table(spark, sf, "orders").select(
        "o_orderkey", F.datediff(date, F.lit("1995-01-01").cast("date")).cast("long").alias("days"), month.alias("month"), F.add_months(month, 1).alias("next_month"), F.round(F.ln(price + 1), 9).alias("log_price"),
        F.signum(price - 100000).cast("int").alias("side"), F.ceil(F.sqrt(price)).alias("root"), F.bit_count(F.col("o_orderkey").bitwiseAND(F.lit(255))).alias("bits"), F.md5("o_orderstatus").alias("digest"),
    )


@query("""SELECT s.s_suppkey, s.s_name, n.n_name FROM supplier s JOIN nation n ON n_nationkey = s_nationkey QUALIFY row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey DESC) = 1""")
def w02_latest_name(spark: SparkSession, sf: str) -> DataFrame:
    """The latest name of each group."""
    joined = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return R.latest(joined, ["s_nationkey"], [F.desc("s_suppkey")]).select("s_suppkey", "s_name", "n_name")


def _stored_table(spark: SparkSession, rows: DataFrame, comment: str) -> str:
    """The name of a table made of ``rows`` by one CREATE TABLE AS statement."""
    name, view = (f"{kind}_{uuid.uuid4().hex}" for kind in ("made", "rows"))
    rows.createOrReplaceTempView(view)
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{folder(spark)}' COMMENT '{comment}' AS SELECT * FROM {view}")
    spark.catalog.dropTempView(view)
    return name


@query("SELECT s_nationkey, count(*) AS suppliers, max(s_acctbal) AS top, 'cost by nation' AS comment FROM supplier GROUP BY 1")
def k07_commented_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table made by CREATE TABLE AS with a comment, read back with it."""
    totals = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.count("*").alias("suppliers"), F.max("s_acctbal").alias("top"))
    name = _stored_table(spark, totals, "cost by nation")
    return spark.table(name).withColumn("comment", F.lit(spark.catalog.getTable(name).description))


@query("SELECT c_custkey, c_acctbal, NULL::BOOLEAN AS in_credit FROM customer UNION ALL SELECT s_suppkey, s_acctbal, s_acctbal >= 0 FROM supplier")
def k08_added_column(spark: SparkSession, sf: str) -> DataFrame:
    """A table that is given a column and then rows that have it; its older rows read
    as null there (K08)."""
    name = _stored_table(spark, table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "customers")
    spark.sql(f"ALTER TABLE {name} ADD COLUMNS (in_credit BOOLEAN)")
    table(spark, sf, "supplier").select("s_suppkey", "s_acctbal", F.col("s_acctbal") >= 0).write.insertInto(name)
    return spark.table(name)


@query("SELECT 'nation' AS name, count(*) AS n, sum(hash_ok::INT)::BIGINT AS same FROM (SELECT true AS hash_ok FROM nation) UNION ALL SELECT 'region', count(*), count(*) FROM region UNION ALL SELECT 'supplier', count(*), count(*) FROM supplier")
def k02_generated_views(spark: SparkSession, sf: str) -> DataFrame:
    """A materialised table for each source in a loop: declared as a statement, filled,
    and read by its name (K02)."""
    out = None
    for name in ("nation", "region", "supplier"):
        rows = table(spark, sf, name)
        made = spark.table(_stored_table(spark, rows, name))
        same = made.join(rows, rows.columns, "left_semi").agg(F.count("*").alias("same"))
        part = made.agg(F.count("*").alias("n")).join(same, F.lit(True)).select(F.lit(name).alias("name"), "n", "same")
        out = part if out is None else out.unionByName(part)
    return out


@query("""
WITH v AS (SELECT o_custkey, count(*) FILTER (year(o_orderdate) < 1998) AS first_n, count(*) FILTER (year(o_orderdate) < 2000) AS second_n, count(*) AS n, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS cents FROM orders GROUP BY 1)
SELECT o_custkey, n, cents, nullif(first_n, 0) AS first_n, nullif(second_n, 0) AS second_n FROM v
""")
def k02_refreshed_view(spark: SparkSession, sf: str) -> DataFrame:
    """A view of orders by customer, filled, grown twice by new orders alone, and read as
    it was after each (K02)."""
    orders = table(spark, sf, "orders").select("o_custkey", F.round(F.col("o_totalprice") * 100).cast("long").alias("cents"), F.year("o_orderdate").alias("year"))
    view = views.AggregateView(spark, folder(spark), ["o_custkey"], ["cents"])
    first = view.fill(orders.where("year < 1998"))
    second = view.refresh(orders.where("year >= 1998 and year < 2000"))
    view.refresh(orders.where("year >= 2000"))
    then = lambda version, name: view.read(version).select("o_custkey", F.col("n").alias(name))
    return view.read().join(then(first, "first_n"), "o_custkey", "left").join(then(second, "second_n"), "o_custkey", "left")


@query("""SELECT user_id, count(*) AS n, max(running)::BIGINT AS peak FROM (SELECT user_id, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE -1 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS running FROM events) GROUP BY 1""")
def w21_running_peak(spark: SparkSession, sf: str) -> DataFrame:
    """The high-water mark of a running sum (X09, W-family)."""
    step = F.when(F.col("event_type") == "purchase", 1).otherwise(-1)
    running = F.sum(step).over(Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0))
    return table(spark, sf, "events").select("user_id", running.alias("running")).groupBy("user_id").agg(F.count("*").alias("n"), F.max("running").alias("peak"))

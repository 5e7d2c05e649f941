"""Queries over joins, lookups and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lakeward.functions import columns as C
from lakeward.operators import asof, containment
from lakeward.operators import relational as R
from lakeward.registry import query, table

MAPPING = [("all", "1-URGENT", 101), ("all", "2-HIGH", 102), ("all", "3-MEDIUM", 103), ("F", "1-URGENT", 201), ("all", "4-NOT SPECIFIED", 0)]
MAPPING_SQL = "(VALUES " + ", ".join(f"('{s}', '{v}', {r}::BIGINT)" for s, v, r in MAPPING) + ") AS m(scope, value, concept_id)"


def mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAPPING, "scope string, value string, concept_id long")


@query("""
WITH l AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate DESC, l_linenumber DESC, l_partkey, l_suppkey) = 1)
SELECT o_orderkey, l_linenumber, p_brand, s_name FROM orders LEFT JOIN l ON l_orderkey = o_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
""")
def j01_latest_joined(spark: SparkSession, sf: str) -> DataFrame:
    """Each order with its latest line and that line's part and supplier."""
    lines = R.latest(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"), ["l_orderkey"], [F.desc("l_shipdate"), F.desc("l_linenumber"), "l_partkey", "l_suppkey"])
    joined = table(spark, sf, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    joined = joined.join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey"), "left").join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"), "left")
    return joined.select("o_orderkey", "l_linenumber", "p_brand", "s_name")


@query("SELECT o_orderkey, o_orderstatus, c_mktsegment, c_nationkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F'")
def j02_inner(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").where("o_orderstatus = 'F'")
    return orders.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_orderstatus", "c_mktsegment", "c_nationkey")


@query("""
SELECT l_orderkey, l_linenumber, c_custkey, n_name, r_name FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN customer ON c_custkey = o_custkey
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey WHERE l_returnflag = 'R'
""")
def j03_left_chain(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem").where("l_returnflag = 'R'").select("l_orderkey", "l_linenumber")
    chain = lines.join(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    chain = chain.join(table(spark, sf, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"), "left")
    chain = chain.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return chain.select("l_orderkey", "l_linenumber", "c_custkey", "n_name", "r_name")


@query("""
SELECT k AS nationkey, count(*) FILTER (t = 'c') AS customers, count(*) FILTER (t = 's') AS suppliers, count(*) FILTER (t = 'n') AS nations
FROM (SELECT c_nationkey AS k, 'c' AS t FROM customer UNION ALL SELECT s_nationkey, 's' FROM supplier UNION ALL SELECT n_nationkey, 'n' FROM nation) GROUP BY k
""")
def j04_layer_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of several layers side by side, as one aggregate over their union."""
    layers = (("customer", "c_nationkey", "customers"), ("supplier", "s_nationkey", "suppliers"), ("nation", "n_nationkey", "nations"))
    parts = [table(spark, sf, t).select(F.col(k).alias("nationkey"), F.lit(n).alias("layer")) for t, k, n in layers]
    both = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return both.groupBy("nationkey").agg(*(F.count_if(F.col("layer") == n).alias(n) for _, _, n in layers))


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def j05_semi(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_mktsegment")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def j06_anti(spark: SparkSession, sf: str) -> DataFrame:
    urgent = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'")
    return table(spark, sf, "customer").join(urgent, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey", "c_mktsegment")


@query("SELECT (SELECT count(*) FROM events) AS events, (SELECT count(*) FROM orders) AS orders, (SELECT count(DISTINCT user_id) FROM events) AS users")
def j07_one_row_counts(spark: SparkSession, sf: str) -> DataFrame:
    """One-row aggregates side by side; each side is a single row."""
    counts = table(spark, sf, "events").agg(F.count("*").alias("events"), F.count_distinct("user_id").alias("users"))
    return counts.join(table(spark, sf, "orders").agg(F.count("*").alias("orders")), F.lit(True))


@query("""
WITH p AS (SELECT l_partkey, d AS valid_from, lead(d) OVER (PARTITION BY l_partkey ORDER BY d) AS valid_to, price FROM
  (SELECT l_partkey, date_trunc('year', l_shipdate)::TIMESTAMP AS d, round(sum(l_extendedprice) / sum(l_quantity), 6) AS price FROM lineitem GROUP BY 1, 2))
SELECT l_orderkey, l_linenumber, price, price IS NOT NULL AS priced FROM lineitem a LEFT JOIN p ON a.l_partkey = p.l_partkey AND l_shipdate >= valid_from AND (valid_to IS NULL OR l_shipdate < valid_to)
WHERE l_linenumber = 1
""")
def j08_valid_price(spark: SparkSession, sf: str) -> DataFrame:
    """Each first line with the price of its part that was valid when it shipped."""
    lines = table(spark, sf, "lineitem")
    yearly = lines.groupBy("l_partkey", F.date_trunc("year", F.col("l_shipdate").cast("timestamp")).cast("timestamp_ntz").alias("valid_from")).agg(F.round(F.sum("l_extendedprice") / F.sum("l_quantity"), 6).alias("price"))
    prices = yearly.withColumn("valid_to", F.lead("valid_from").over(Window.partitionBy("l_partkey").orderBy("valid_from")))
    usage = lines.where("l_linenumber = 1").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return asof.valid_at(usage, prices, ["l_partkey"], "l_shipdate", "valid_from", "valid_to").select("l_orderkey", "l_linenumber", "price", F.col("price").isNotNull().alias("priced"))


@query(f"""
WITH m AS (SELECT * FROM {MAPPING_SQL})
SELECT o_orderkey, coalesce(a.concept_id, b.concept_id) AS concept_id FROM orders LEFT JOIN m a ON a.scope = o_orderstatus AND a.value = o_orderpriority
LEFT JOIN m b ON b.scope = 'all' AND b.value = o_orderpriority
""")
def j09_lookup(spark: SparkSession, sf: str) -> DataFrame:
    return R.looked_up(table(spark, sf, "orders"), mapping(spark), "o_orderstatus", "o_orderpriority", "concept_id").select("o_orderkey", "concept_id")


@query("""
WITH s AS (SELECT o_custkey, count(DISTINCT o_orderstatus) AS kinds FROM orders GROUP BY 1 HAVING kinds > 1)
SELECT o_custkey, kinds FROM s WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 5 = 0)
""")
def j10_undocumented(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in several statuses that are not on the documented list."""
    crossing = table(spark, sf, "orders").groupBy("o_custkey").agg(F.count_distinct("o_orderstatus").alias("kinds")).where("kinds > 1")
    documented = table(spark, sf, "customer").where("c_custkey % 5 = 0")
    return crossing.join(documented, F.col("o_custkey") == F.col("c_custkey"), "left_anti")


@query("""SELECT (SELECT count(*) FROM lineitem) AS rows, count(*) AS joined, (SELECT count(*) FROM lineitem) = count(*) AS whole FROM lineitem JOIN (SELECT o_orderkey FROM orders) ON l_orderkey = o_orderkey""")
def j11_joined_whole(spark: SparkSession, sf: str) -> DataFrame:
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"))
    return R.joined_whole(table(spark, sf, "lineitem").select("l_orderkey"), orders, ["l_orderkey"])


@query("SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_suppkey IS NOT NULL AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_suppkey % 7 <> 0) GROUP BY 1")
def j12_orphans(spark: SparkSession, sf: str) -> DataFrame:
    parents = table(spark, sf, "supplier").where("s_suppkey % 7 <> 0")
    return table(spark, sf, "lineitem").where("l_suppkey is not null").join(parents, F.col("l_suppkey") == F.col("s_suppkey"), "left_anti").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("SELECT k, r_name, count(*) AS n FROM (SELECT (props::JSON ->> '$.k')::INT AS k FROM events) LEFT JOIN region ON k = r_regionkey GROUP BY ALL")
def j13_json_key(spark: SparkSession, sf: str) -> DataFrame:
    keyed = table(spark, sf, "events").select(F.get_json_object("props", "$.k").cast("int").alias("k"))
    return keyed.join(table(spark, sf, "region"), F.col("k") == F.col("r_regionkey"), "left").groupBy("k", "r_name").agg(F.count("*").alias("n"))


@query("""
SELECT count(*) FILTER (a.l_orderkey IS NULL) AS only_orders, count(*) FILTER (o_orderkey IS NULL) AS only_lines, count(*) AS total
FROM (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 2) a FULL JOIN orders ON l_orderkey = o_orderkey
""")
def j14_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Whether two frames list the same keys: counts of the keys on one side only."""
    lines = table(spark, sf, "lineitem").where("l_linenumber = 2").select("l_orderkey").distinct()
    both = lines.join(table(spark, sf, "orders").select("o_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "full")
    return both.agg(F.count_if(F.col("l_orderkey").isNull()).alias("only_orders"), F.count_if(F.col("o_orderkey").isNull()).alias("only_lines"), F.count("*").alias("total"))


@query("SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def j15_unseen(spark: SparkSession, sf: str) -> DataFrame:
    known = table(spark, sf, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("user_id"))
    return R.unseen(table(spark, sf, "events").where("event_type = 'purchase'"), known, "user_id")


@query("""
WITH n AS (SELECT n_regionkey, list(n_nationkey) AS k, count(*) AS n FROM nation WHERE n_nationkey % 2 = 0 GROUP BY 1), r AS (SELECT n_regionkey, list(n_nationkey) AS k, count(*) AS n FROM nation GROUP BY 1)
SELECT a.n_regionkey AS inner_scope, b.n_regionkey AS outer_scope, b.n - a.n AS difference FROM n a JOIN r b ON len(list_filter(a.k, lambda x: NOT list_contains(b.k, x))) = 0
""")
def j16_nested_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Scopes whose keys lie inside another scope's keys."""
    nation = table(spark, sf, "nation")
    inner = nation.where("n_nationkey % 2 = 0").select(F.col("n_regionkey").alias("inner_scope"), "n_nationkey")
    outer = nation.select(F.col("n_regionkey").alias("outer_scope"), "n_nationkey")
    return containment.contained(inner, outer, "inner_scope", "outer_scope", "n_nationkey")


@query("""
WITH i AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IS NOT NULL), o AS (SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
p AS (SELECT l_orderkey, o_custkey, count(*) AS shared FROM i JOIN o USING (l_partkey) GROUP BY 1, 2), n AS (SELECT l_orderkey, count(*) AS n FROM i GROUP BY 1), m AS (SELECT o_custkey, count(*) AS m FROM o GROUP BY 1)
SELECT l_orderkey, o_custkey, m - n AS difference FROM p JOIN n USING (l_orderkey) JOIN m USING (o_custkey) WHERE shared = n AND n > 1
""")
def j16_part_scopes(spark: SparkSession, sf: str) -> DataFrame:
    """Orders of several parts and the customers whose parts hold all of theirs: a scope
    for each order and customer, found by the order's rarest part (J16)."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    bought = lines.join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("o_custkey", "l_partkey")
    return containment.contained(lines, bought, "l_orderkey", "o_custkey", "l_partkey", least=2)


@query("""
WITH h AS (SELECT p_partkey, ('0x' || substr(md5(p_brand || p_type), 1, 8))::BIGINT & 65535 AS h FROM part), d AS (SELECT h, count(*) AS parts, min(p_partkey) AS first FROM h GROUP BY 1),
n AS (SELECT a.h, count(*) AS links, list_sort(list(b.first)) AS near FROM d a JOIN d b ON bit_count(xor(a.h, b.h)) = 1 GROUP BY 1)
SELECT p_partkey, first AS same_as, coalesce(links, 0) AS links, coalesce(array_to_string(near, ','), '') AS near FROM h JOIN d USING (h) LEFT JOIN n USING (h)
""")
def j17_near_hashes(spark: SparkSession, sf: str) -> DataFrame:
    """16-bit hashes that differ in one bit: parts of one hash are one node, named by its
    least part, and links are between nodes. One of two halves of linked hashes is equal,
    so the join is on (half, bits) and the distance is checked after it (J17)."""
    h = F.conv(F.substring(F.md5(F.concat("p_brand", "p_type")), 1, 8), 16, 10).cast("long").bitwiseAND(F.lit(65535))
    hashes = table(spark, sf, "part").select("p_partkey", h.alias("h"))
    nodes = hashes.groupBy("h").agg(F.min("p_partkey").alias("same_as"))
    halves = F.explode(F.array(F.struct(F.lit(0).alias("half"), F.shiftright("h", 8).alias("bits")), F.struct(F.lit(1).alias("half"), F.col("h").bitwiseAND(F.lit(255)).alias("bits"))))
    keyed = nodes.withColumn("key", halves).select("h", "same_as", "key.half", "key.bits")
    other = keyed.select(F.col("h").alias("g"), F.col("same_as").alias("other"), "half", "bits")
    linked = keyed.join(other, ["half", "bits"]).where(C.hamming(F.col("h"), F.col("g")) == 1).groupBy("h").agg(F.sort_array(F.collect_set("other")).alias("near"))  # 16 at most
    named = nodes.join(linked, "h", "left").select("h", "same_as", F.coalesce(F.size("near"), F.lit(0)).cast("long").alias("links"), F.coalesce(F.array_join("near", ","), F.lit("")).alias("near"))
    return hashes.join(named, "h").select("p_partkey", "same_as", "links", "near")


@query("""
SELECT count(*) AS held_out, count(DISTINCT o_custkey) AS people FROM orders WHERE o_orderkey % 10 = 3
AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderkey % 10 < 3)
""")
def j18_leak_free(spark: SparkSession, sf: str) -> DataFrame:
    """Held-out orders whose customer has none among the training orders."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    trained = orders.where("o_orderkey % 10 < 3").select("o_custkey")
    return orders.where("o_orderkey % 10 = 3").join(trained, "o_custkey", "left_anti").agg(F.count("*").alias("held_out"), F.count_distinct("o_custkey").alias("people"))


@query("""
SELECT lang, count(*) AS docs, sum(CASE WHEN l.doc_id IS NULL THEN 1 ELSE 0 END)::BIGINT AS unlabelled, sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END)::BIGINT AS good
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY 1
""")
def j19_left_case_sums(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality", F.lit(1).alias("labelled"))
    joined = table(spark, sf, "documents").select("doc_id", "lang").join(labels, "doc_id", "left")
    return joined.groupBy("lang").agg(F.count("*").alias("docs"), F.count_if(F.col("labelled").isNull()).alias("unlabelled"), F.count_if(F.col("quality") == 1).alias("good"))


@query("""
SELECT d.doc_id, coalesce(quality, -1) AS quality, CASE WHEN l.doc_id IS NULL THEN 'no label' WHEN quality = 0 THEN 'low quality' END AS reason FROM documents d LEFT JOIN labels l USING (doc_id)
""")
def j21_reason_when_absent(spark: SparkSession, sf: str) -> DataFrame:
    labels = table(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("there"))
    reason = F.when(F.col("there").isNull(), "no label").when(F.col("quality") == 0, "low quality")
    return table(spark, sf, "documents").select("doc_id").join(labels, "doc_id", "left").select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), reason.alias("reason"))


@query("""
SELECT a.conv_id, a.turn, a.text = b.text AS same FROM conversations a FULL JOIN (SELECT conv_id, turn, CASE WHEN conv_id % 9 = 0 THEN upper(text) ELSE text END AS text FROM conversations WHERE turn < 4) b
ON a.conv_id = b.conv_id AND a.turn = b.turn WHERE a.text IS DISTINCT FROM b.text
""")
def j22_sheet_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of a sheet that, merged back by id, are missing or were changed."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "text")
    sheet = turns.where("turn < 4").withColumn("text", F.when(F.col("conv_id") % 9 == 0, F.upper("text")).otherwise(F.col("text"))).select("conv_id", "turn", F.col("text").alias("sheet_text"))
    return turns.join(sheet, ["conv_id", "turn"], "full").where("not (text <=> sheet_text)").select("conv_id", "turn", (F.col("text") == F.col("sheet_text")).alias("same"))


@query("SELECT 'customers' AS step, count(*) AS n FROM customer UNION ALL SELECT 'orders', count(*) FROM orders UNION ALL SELECT 'lines', count(*) FROM lineitem")
def u01_union_of_counts(spark: SparkSession, sf: str) -> DataFrame:
    parts = [table(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(name).alias("step"), "n") for t, name in (("customer", "customers"), ("orders", "orders"), ("lineitem", "lines"))]
    return parts[0].unionAll(parts[1]).unionAll(parts[2])


@query("""
WITH a AS (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 0), b AS (SELECT l_returnflag, l_linestatus, l_linenumber FROM lineitem WHERE l_orderkey % 2 = 1)
SELECT side, l_returnflag, l_linestatus, l_linenumber, count(*) AS n FROM (SELECT 'left' AS side, * FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'right', * FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) GROUP BY ALL
""")
def u02_multiset_difference(spark: SparkSession, sf: str) -> DataFrame:
    lines = table(spark, sf, "lineitem")
    a, b = (lines.where(f"l_orderkey % 2 = {k}").select("l_returnflag", "l_linestatus", "l_linenumber") for k in (0, 1))
    return R.multiset_difference(a, b).groupBy("side", "l_returnflag", "l_linestatus", "l_linenumber").agg(F.count("*").alias("n"))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS segment, 'customer' AS kind FROM customer UNION ALL SELECT s_suppkey, s_name, NULL, 'supplier' FROM supplier")
def u03_union_by_name(spark: SparkSession, sf: str) -> DataFrame:
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("kind"))
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.lit("supplier").alias("kind"))
    return customers.unionByName(suppliers, allowMissingColumns=True)


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def u04_distinct(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_partkey", "l_suppkey").distinct()


@query("""
SELECT o_custkey, list_sort(list_filter(list(DISTINCT o_orderpriority), lambda x: x NOT IN ('1-URGENT', '2-HIGH'))) AS others FROM orders GROUP BY 1
HAVING len(list_filter(list(DISTINCT o_orderpriority), lambda x: x NOT IN ('1-URGENT', '2-HIGH'))) > 2
""".replace("AS others", ", ',') AS others").replace("SELECT o_custkey, list_sort", "SELECT o_custkey, array_to_string(list_sort"))
def u05_array_difference(spark: SparkSession, sf: str) -> DataFrame:
    used = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("used"))
    others = F.array_except("used", F.array(F.lit("1-URGENT"), F.lit("2-HIGH")))
    return used.where(F.size(others) > 2).select("o_custkey", F.array_join(F.sort_array(others), ",").alias("others"))


@query("""
SELECT id, min(rank) AS source_rank FROM (SELECT o_custkey AS id, 0 AS rank FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT o_custkey, 1 FROM orders WHERE o_orderstatus = 'F' UNION ALL SELECT c_custkey, 2 FROM customer) GROUP BY 1
""")
def s21_first_source_wins(spark: SparkSession, sf: str) -> DataFrame:
    """A union over sources with one row an id, from the first source that has it."""
    orders = table(spark, sf, "orders")
    frames = [
        orders.where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("id"), F.lit(0).alias("source_rank")).distinct(),
        orders.where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("id"), F.lit(1).alias("source_rank")).distinct(),
        table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.lit(2).alias("source_rank")),
    ]
    return R.first_wins(frames, "id")

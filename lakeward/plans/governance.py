"""Governed counts, definitions, guarded writes and the vocabulary, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.operators import cdm, cohort, containment
from lakeward.plans.clinical import _DERIVED, derived_mapping
from lakeward.operators.tables import folder
from lakeward.registry import query, table
from lakeward.sources import files


@query("""
WITH c AS (SELECT c_nationkey AS cohort, c_mktsegment || CASE WHEN c_acctbal < 0 THEN ' -' ELSE ' +' END AS cell, count(*) AS persons FROM customer GROUP BY 1, 2),
t AS (SELECT *, max((persons BETWEEN 1 AND 10)::INT) OVER w = 1 AS hide, sum(persons) OVER w AS total, count(*) FILTER (persons > 0) OVER w AS k FROM c WINDOW w AS (PARTITION BY cohort))
SELECT cohort, cell, CASE WHEN hide THEN '<11' ELSE persons::VARCHAR END AS shown, CASE WHEN total BETWEEN 1 AND 10 OR hide AND total < k + 10 THEN '<11' ELSE total::BIGINT::VARCHAR END AS total_shown FROM t
""")
def c06_hidden_totals(spark: SparkSession, sf: str) -> DataFrame:
    """Breakdowns of many cohorts, all of whose cells are hidden with a small one, and
    their totals, hidden too where they would give the cells away (C06)."""
    cell = F.concat("c_mktsegment", F.when(F.col("c_acctbal") < 0, " -").otherwise(" +")).alias("cell")
    cells = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("cohort"), cell).agg(F.count("*").alias("persons"))
    return cohort.suppressed_breakdowns(cells, ["cohort"], "persons").select("cohort", "cell", "shown", "total_shown")


@query("""
WITH c AS (SELECT c_custkey, c_name, c_nationkey AS version, c_mktsegment AS title, c_custkey % 70 AS low, 20 + c_custkey % 50 AS high, c_custkey % 11 = 0 AS odd FROM customer),
d AS (SELECT c_custkey, version > 0 AND low <= high AND NOT odd AS allowed, '{"author":"","breakdown":[],"exclude":[],"include":[],"index":{"age_max":' || high || ',"age_min":' || low || ',"condition_concept_ids":[' || c_custkey || ']},"name":"' || c_name || '","purpose":"","title":"' || title || '","version":' || version || '}' AS document FROM c)
SELECT c_custkey, allowed, CASE WHEN allowed THEN sha256(document) END AS digest FROM d
""")
def c01_definitions(spark: SparkSession, sf: str) -> DataFrame:
    """A definition for each customer, as text, held against the allowlist, and the hash
    of those it allows (C01, P13)."""
    low, high = (F.col("c_custkey") % 70).alias("age_min"), (20 + F.col("c_custkey") % 50).alias("age_max")
    index = F.struct(F.array("c_custkey").alias("condition_concept_ids"), low, high)
    raw = F.to_json(F.struct(F.col("c_name").alias("name"), F.col("c_nationkey").alias("version"), F.col("c_mktsegment").alias("title"), index.alias("index"), F.when(F.col("c_custkey") % 11 == 0, "select 1").alias("sql")))
    digest = F.udf(cohort.digest_of, "string")(raw)
    return table(spark, sf, "customer").select("c_custkey", digest.alias("digest")).select("c_custkey", F.col("digest").isNotNull().alias("allowed"), "digest")


@query("""
WITH o AS (SELECT o_custkey, list_sort(list(DISTINCT o_orderpriority)) AS c, list_sort(list(DISTINCT o_orderstatus)) AS d, floor(min(o_totalprice) / 100000)::INT AS low, floor(max(o_totalprice) / 100000)::INT AS high FROM orders GROUP BY 1),
s AS (SELECT DISTINCT array_to_string(c, ',') || '|' || array_to_string(d, ',') || '|' || low || '|' || high AS id, c, d, low, high FROM o)
SELECT a.id AS inner_id, b.id AS outer_id FROM s a JOIN s b ON a.id <> b.id AND list_has_all(b.c, a.c) AND list_has_all(a.d, b.d) AND a.low >= b.low AND a.high <= b.high
""")
def u06_scopes_inside(spark: SparkSession, sf: str) -> DataFrame:
    """Which of the customers' scopes lies inside which: fewer priorities, a narrower
    range of prices, more demands, here states of orders (U06, C08). Every pair comes out
    of two containments, of what a scope takes in and, the other way, of what it demands."""
    price = F.floor(F.col("o_totalprice") / 100_000).cast("int")
    held = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_set("o_orderpriority")).alias("c"), F.sort_array(F.collect_set("o_orderstatus")).alias("d"), F.min(price).alias("low"), F.max(price).alias("high"))
    name = F.concat_ws("|", F.array_join("c", ","), F.array_join("d", ","), "low", "high").alias("id")
    scopes = held.select(name, "c", "d", "low", "high").distinct()
    facts = F.concat("c", F.transform(F.sequence("low", "high"), lambda x: x.cast("string")))
    takes, demands = scopes.select("id", F.explode(facts).alias("fact")), scopes.select("id", F.explode("d").alias("demand"))
    named = lambda df, to: df.withColumnRenamed("id", to)
    wider = containment.contained(named(takes, "inner_id"), named(takes, "outer_id"), "inner_id", "outer_id", "fact")
    stricter = containment.contained(named(demands, "outer_id"), named(demands, "inner_id"), "outer_id", "inner_id", "demand")
    return wider.join(stricter, ["inner_id", "outer_id"]).where("inner_id <> outer_id").select("inner_id", "outer_id")


@query("SELECT 'created' AS step, 1 AS version, count(*) AS n FROM nation WHERE n_regionkey < 3 UNION ALL SELECT 'appended', 2, count(*) FROM nation UNION ALL SELECT 'overwritten', 3, count(*) FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'ASIA' UNION ALL SELECT 'refused', 3, 2")
def k03_guarded_writes(spark: SparkSession, sf: str) -> DataFrame:
    """A table created once, appended to if every row has a parent, and rewritten from
    itself through a join; what is refused leaves it as it was (K03, K05, K06)."""
    nation, region = table(spark, sf, "nation"), table(spark, sf, "region")
    held = files.VersionedTable(spark, folder(spark))
    guard = ("n_nationkey", region, "r_regionkey", "n_regionkey")
    rows, refused = [("created", held.create(nation.where("n_regionkey < 3")))], 0
    for write in (lambda: held.create(nation), lambda: held.append(nation.withColumn("n_regionkey", F.lit(99)), *guard)):
        try:
            write()
        except ValueError:  # there already; no parent
            refused += 1
            continue
    rows.append(("appended", held.append(nation, *guard)))
    kept = held.read().join(region.where("r_name <> 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey")).select(*nation.columns)
    rows.append(("overwritten", held.write(kept)))
    out = None
    for step, version in rows:
        part = held.read(version).agg(F.count("*").alias("n")).select(F.lit(step).alias("step"), F.lit(version).alias("version"), "n")
        out = part if out is None else out.unionByName(part)
    last = spark.createDataFrame([("refused", held.versions()[-1], refused)], "step string, version int, n long")
    return out.unionByName(last)


@query(f"""
WITH m AS (SELECT * FROM {_DERIVED} WHERE concept_id <> 0), v AS (SELECT * FROM m WHERE concept_id % 10 <> 3),
c AS (SELECT DISTINCT concept_id, CASE WHEN concept_id % 4 = 0 THEN NULL ELSE 'S' END AS standard, CASE WHEN concept_id % 5 = 1 THEN 'D' END AS invalid, CASE WHEN concept_id % 7 = 0 THEN 'other' ELSE field END AS domain FROM v),
j AS (SELECT m.field, c.* FROM m LEFT JOIN c USING (concept_id)), g AS (SELECT 'missing' AS name, count(*) FILTER (concept_id IS NULL OR domain IS NULL) AS violations FROM j
UNION ALL SELECT 'not_standard', count(*) FILTER (domain IS NOT NULL AND standard IS DISTINCT FROM 'S') FROM j UNION ALL SELECT 'invalid', count(*) FILTER (domain IS NOT NULL AND invalid IS NOT NULL) FROM j
UNION ALL SELECT 'other_domain', count(*) FILTER (domain IS NOT NULL AND domain <> field) FROM j) SELECT name, violations, violations = 0 AS passed FROM g
""")
def g25_vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    """Mapped concepts held against a vocabulary with gaps."""
    mapped = derived_mapping(spark, sf).withColumn("expected_domain", F.col("field"))
    c = F.col("concept_id")
    concepts = mapped.where((c != 0) & (c % 10 != 3)).select(
        "concept_id", F.when(c % 4 != 0, "S").alias("standard_concept"), F.when(c % 5 == 1, "D").alias("invalid_reason"), F.when(c % 7 == 0, "other").otherwise(F.col("field")).alias("domain_id")
    )
    return cdm.vocabulary_gates(mapped, concepts.distinct())

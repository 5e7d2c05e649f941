"""Queries over the common-data-model build, its gates and cohorts.

Events stand in for image records; customers, orders and lines for persons, conditions
and procedures of the cohort queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.operators import cdm, cohort
from lakeward.operators import gates as G
from lakeward.registry import query, sql_of, table

#: Expressions that Spark and DuckDB read alike.
RECORD = {
    "image_id": "concat('e', cast(event_id AS STRING))",
    "source": "event_type",
    "lesion_id": "concat('L', cast(user_id * 3 + event_id % 3 AS STRING))",
    "patient_id": "CASE WHEN user_id % 4 <> 0 THEN concat('P', cast(user_id AS STRING)) END",
    "sex": "CASE user_id % 3 WHEN 0 THEN 'male' WHEN 1 THEN 'female' END",
    "age": "CASE WHEN user_id % 11 <> 0 THEN cast(20 + (user_id + event_id) % 60 AS DOUBLE) END",
    "site_local": "CASE WHEN event_id % 2 = 0 THEN concat('place', cast(event_id % 6 AS STRING)) END",
    "site_1": "CASE WHEN event_id % 9 <> 0 THEN concat('area', cast(event_id % 4 AS STRING)) END",
    "site_2": "CASE WHEN event_id % 5 = 0 THEN concat('part', cast(event_id % 3 AS STRING)) END",
    "label": "CASE WHEN event_id % 7 <> 0 THEN concat('dx', cast(user_id % 4 AS STRING)) END",
    "diagnosis": "CASE WHEN event_id % 3 = 0 THEN CASE WHEN user_id % 2 = 0 THEN 'Nevus NOS' ELSE 'Melanoma' END END",
    "confirm": "CASE event_id % 4 WHEN 0 THEN 'histo' WHEN 1 THEN 'follow' END",
}
MAIN = "click"
#: field, scope, value, concept_id, note of the stand-in mapping.
MAPPING = [
    ("sex", "all", "male", 8507, ""), ("sex", "all", "female", 8532, ""),
    *(("site_local", "click", f"place{i}", 4000 + i, "") for i in (0, 2)),
    *(("site_1", "all", f"area{i}", 5000 + i, "") for i in range(4)), ("site_1", "sites", "area1", 5101, ""),
    *(("site_2", "all", f"part{i}", 6000 + i, "") for i in range(2)),
    *(("label", "all", f"dx{i}", 7000 + i, "") for i in range(3)), ("label", "all", "dx3", 0, "no concept"),
    ("diagnosis", "all", "Melanoma", 7100, ""), ("diagnosis", "all", "Nevus NOS", 7101, ""), ("confirm", "all", "histo", 9001, ""), ("confirm", "all", "follow", 0, ""),
]
_VALUES = ", ".join(f"('{f}', '{s}', '{v}', {c}::BIGINT, '{n}')" for f, s, v, c, n in MAPPING)

_WITH = f"""
WITH m AS (SELECT * FROM (VALUES {_VALUES}) AS t(field, scope, value, concept_id, note)),
rec AS (SELECT {', '.join(f'{e} AS {n}' for n, e in RECORD.items())} FROM events),
pre AS (SELECT *, source || ':' || lesion_id AS lesion_key, CASE WHEN patient_id IS NOT NULL THEN source || ':patient:' || patient_id ELSE source || ':lesion:' || lesion_id END AS own,
  CASE WHEN source = '{MAIN}' THEN '{MAIN}' ELSE 'sites' END AS scope, CASE WHEN source = '{MAIN}' THEN site_local ELSE coalesce(site_2, site_1) END AS site,
  CASE WHEN source = '{MAIN}' THEN CASE WHEN site_local IS NOT NULL THEN 'site_local' END WHEN site_2 IS NOT NULL THEN 'site_2' WHEN site_1 IS NOT NULL THEN 'site_1' END AS site_field FROM rec),
p AS (SELECT *, max(own) OVER (PARTITION BY lesion_key) AS person_key FROM pre),
diag AS (SELECT lesion_key, diagnosis AS v FROM p WHERE diagnosis IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lesion_key ORDER BY count(*) DESC, v LIKE '%NOS', v) = 1),
lab AS (SELECT lesion_key, label AS v FROM p WHERE label IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lesion_key ORDER BY count(*) DESC, v LIKE '%NOS', v) = 1),
con AS (SELECT lesion_key, confirm AS v FROM p WHERE confirm IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY lesion_key ORDER BY count(*) DESC, v LIKE '%NOS', v) = 1),
sx AS (SELECT person_key, sex AS v FROM p WHERE sex IS NOT NULL GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY person_key ORDER BY count(*) DESC, v LIKE '%NOS', v) = 1),
les AS (SELECT lesion_key, min(person_key) AS person_key, min(scope) AS scope, any_value(diag.v) AS diagnosis, any_value(lab.v) AS label, any_value(con.v) AS confirm
  FROM p LEFT JOIN diag USING (lesion_key) LEFT JOIN lab USING (lesion_key) LEFT JOIN con USING (lesion_key) GROUP BY lesion_key),
pid AS (SELECT person_key, ('0x' || substr(sha256(person_key), 1, 15))::BIGINT AS person_id, min(age) AS age FROM p GROUP BY 1)
"""


def _id(*parts: str) -> str:
    return f"('0x' || substr(sha256({' || '.join(parts)}), 1, 15))::BIGINT"


def records(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(*(F.expr(e).alias(n) for n, e in RECORD.items()))


def mapping(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MAPPING, "field string, scope string, value string, concept_id long, note string")


#: A mapping that grows with its tables: parts by type and supplier sites by nation.
_DERIVED = """(SELECT 'part' AS field, CASE WHEN p_size % 3 = 0 THEN 'all' ELSE p_brand END AS scope, p_type AS value, CASE WHEN p_size % 7 = 0 THEN 0 ELSE p_partkey END AS concept_id, CASE WHEN p_size % 14 = 0 THEN 'none fits' ELSE '' END AS note FROM part
UNION ALL SELECT 'site', CASE WHEN s_nationkey % 2 = 0 THEN 'all' ELSE s_nationkey::VARCHAR END, s_name, s_suppkey, '' FROM supplier)"""


def derived_mapping(spark: SparkSession, sf: str) -> DataFrame:
    size = F.col("p_size")
    parts = table(spark, sf, "part").select(
        F.lit("part").alias("field"), F.when(size % 3 == 0, "all").otherwise(F.col("p_brand")).alias("scope"), F.col("p_type").alias("value"),
        F.when(size % 7 == 0, F.lit(0).cast("long")).otherwise(F.col("p_partkey")).alias("concept_id"), F.when(size % 14 == 0, "none fits").otherwise("").alias("note"),
    )
    nation = F.col("s_nationkey")
    sites = table(spark, sf, "supplier").select(F.lit("site").alias("field"), F.when(nation % 2 == 0, "all").otherwise(nation.cast("string")).alias("scope"), F.col("s_name").alias("value"), F.col("s_suppkey").alias("concept_id"), F.lit("").alias("note"))
    return parts.unionByName(sites)


def built(spark: SparkSession, sf: str) -> cdm.Build:
    return cdm.build(records(spark, sf), mapping(spark), MAIN)


@query(_WITH + "SELECT person_id, coalesce(concept_id, 0)::BIGINT AS gender_concept_id, (2000 - trunc(age)::INT)::INT AS year_of_birth, person_key AS person_source_value FROM pid LEFT JOIN sx USING (person_key) LEFT JOIN m ON field = 'sex' AND value = sx.v")
def o01_person(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf).tables["person"]


@query(_WITH + f"SELECT {_id(chr(39) + 'op|' + chr(39), 'person_key')} AS observation_period_id, person_id, DATE '2000-01-01' AS start_date, DATE '2000-01-01' AS end_date FROM pid")
def o02_observation_period(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf).tables["observation_period"]


@query(_WITH + f"""SELECT {_id('lesion_key')} AS condition_id, person_id, coalesce(concept_id, 0)::BIGINT AS condition_concept_id, DATE '2000-01-01' AS start_date, coalesce(diagnosis, label) AS condition_source_value
FROM les JOIN pid USING (person_key) LEFT JOIN m ON field = CASE WHEN diagnosis IS NOT NULL THEN 'diagnosis' ELSE 'label' END AND value = coalesce(diagnosis, label) WHERE coalesce(diagnosis, label) IS NOT NULL""")
def o03_condition_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf).tables["condition_occurrence"]


@query(_WITH + f"""SELECT {_id(chr(39) + 'img|' + chr(39), 'image_id')} AS procedure_id, person_id, 4013636::BIGINT AS procedure_concept_id, DATE '2000-01-01' AS start_date, 'image' AS procedure_source_value FROM p JOIN pid USING (person_key)
UNION ALL SELECT {_id(chr(39) + 'confirm|' + chr(39), 'lesion_key')}, person_id, concept_id, DATE '2000-01-01', confirm FROM les JOIN pid USING (person_key) JOIN m ON field = 'confirm' AND value = confirm WHERE concept_id <> 0""")
def o04_procedure_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf).tables["procedure_occurrence"]


@query(_WITH + f"""SELECT {_id(chr(39) + 'image|' + chr(39), 'image_id')} AS image_occurrence_id, person_id, coalesce(a.concept_id, b.concept_id, 0)::BIGINT AS site_concept_id,
CASE WHEN coalesce(les.diagnosis, les.label) IS NOT NULL THEN {_id('p.lesion_key')} END AS condition_id, site_field
FROM p JOIN pid ON pid.person_key = p.person_key JOIN les ON les.lesion_key = p.lesion_key LEFT JOIN m a ON a.field = site_field AND a.scope = p.scope AND a.value = site LEFT JOIN m b ON b.field = site_field AND b.scope = 'all' AND b.value = site""")
def o05_image_occurrence(spark: SparkSession, sf: str) -> DataFrame:
    return built(spark, sf).tables["image_occurrence"]


@query("SELECT 'lakeward' AS source_name, 'v5.4' AS cdm_version, DATE '2000-01-01' AS anchor, min(o_orderdate)::DATE AS first_record, max(o_orderdate)::DATE AS last_record, count(*) AS records FROM orders")
def o06_source(spark: SparkSession, sf: str) -> DataFrame:
    """The build's one row, with the span of the records it is made from."""
    span = table(spark, sf, "orders").agg(F.to_date(F.min("o_orderdate")).alias("first_record"), F.to_date(F.max("o_orderdate")).alias("last_record"), F.count("*").alias("records"))
    return span.join(cdm.source_row(spark, "lakeward", "v5.4"), F.lit(True))  # one row each


@query(f"SELECT concept_id, min(field) AS domain, CAST(strptime('20000101', '%Y%m%d') AS DATE) AS valid_from FROM {_DERIVED} WHERE concept_id <> 0 GROUP BY 1")
def o08_concept_extract(spark: SparkSession, sf: str) -> DataFrame:
    """The mapped concepts once each, with typed dates."""
    used = derived_mapping(spark, sf).where("concept_id <> 0").groupBy("concept_id").agg(F.min("field").alias("domain"))
    return used.withColumn("valid_from", F.to_date(F.lit("20000101"), "yyyyMMdd"))


@query(_WITH + """, v AS (SELECT 'sex' AS field, scope, sex AS value FROM p UNION SELECT site_field, scope, site FROM p UNION SELECT 'diagnosis', scope, diagnosis FROM les UNION SELECT 'label', scope, label FROM les UNION SELECT 'confirm', scope, confirm FROM les)
SELECT field, scope, value FROM v WHERE trim(value) <> '' AND NOT EXISTS (SELECT 1 FROM m WHERE m.field = v.field AND m.value = v.value AND (m.scope = 'all' OR m.scope = v.scope))""")
def g19_unmapped(spark: SparkSession, sf: str) -> DataFrame:
    b = built(spark, sf)
    return cdm.unmapped(b.prepared, b.lesions, mapping(spark))


_MADE = {"person": "o01_person", "observation_period": "o02_observation_period", "condition_occurrence": "o03_condition_occurrence", "procedure_occurrence": "o04_procedure_occurrence", "image_occurrence": "o05_image_occurrence"}


def _gates_sql() -> str:
    """The build's gates over the SQL of its tables."""
    tables = ", ".join(f"{name} AS ({sql_of(q)})" for name, q in _MADE.items())
    keys = {name: schema.fieldNames()[0] for name, schema in cdm.TABLES.items()}
    parts = [f"SELECT '{t}_key' AS name, count(*) AS violations FROM (SELECT 1 FROM {t} GROUP BY {k} HAVING count(*) > 1)" for t, k in keys.items()]
    parts += [f"SELECT '{t}_person', count(*) FROM {t} WHERE person_id NOT IN (SELECT person_id FROM person)" for t in keys if t != "person"]
    parts += ["SELECT 'image_condition', count(*) FROM image_occurrence WHERE condition_id NOT IN (SELECT condition_id FROM condition_occurrence)"]
    parts += [f"SELECT '{t}_required', count(*) FILTER ({' OR '.join(f'{f.name} IS NULL' for f in schema if not f.nullable)}) FROM {t}" for t, schema in cdm.TABLES.items()]
    size = lambda t: f"(SELECT count(*) FROM {t})"
    parts += [
        f"SELECT 'row_counts', ({size('events')} <> {size('image_occurrence')})::BIGINT + ({size('person')} <> {size('observation_period')})::BIGINT", f"SELECT 'every_value_mapped', count(*) FROM ({sql_of('g19_unmapped')})",
        f"SELECT 'one_diagnosis_per_lesion', count(*) FROM (SELECT 1 FROM ({_WITH} SELECT lesion_key, diagnosis FROM p) GROUP BY lesion_key HAVING count(DISTINCT diagnosis) > 1)",
        "SELECT 'concepts_resolve', count(*) FROM (SELECT gender_concept_id AS c FROM person UNION SELECT condition_concept_id FROM condition_occurrence UNION SELECT procedure_concept_id FROM procedure_occurrence UNION SELECT site_concept_id FROM image_occurrence) "
        f"WHERE c <> 0 AND c <> {cdm.IMAGING_CONCEPT} AND c NOT IN (SELECT concept_id FROM (VALUES {_VALUES}) AS t(field, scope, value, concept_id, note))",
    ]
    return f"WITH {tables}, g AS ({' UNION ALL '.join(parts)}) SELECT name, violations::BIGINT AS violations, violations = 0 AS passed FROM g"


@query(_gates_sql())
def g17_build_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Every gate of the build."""
    concepts = mapping(spark).where("concept_id <> 0").select("concept_id").distinct().unionByName(spark.createDataFrame([(cdm.IMAGING_CONCEPT,)], "concept_id long"))
    return cdm.concept_gates(built(spark, sf), mapping(spark), concepts)


@query(f"""WITH m AS {_DERIVED}
SELECT 'negative_concept' AS name, count(*) FILTER (concept_id < 0) AS violations, count(*) FILTER (concept_id < 0) = 0 AS passed FROM m UNION ALL SELECT 'blank_value', count(*) FILTER (trim(value) = ''), count(*) FILTER (trim(value) = '') = 0 FROM m
UNION ALL SELECT 'zero_without_note', count(*) FILTER (concept_id = 0 AND note = ''), count(*) FILTER (concept_id = 0 AND note = '') = 0 FROM m
UNION ALL SELECT 'duplicate_rows', count(*), count(*) = 0 FROM (SELECT 1 FROM m GROUP BY field, scope, value HAVING count(*) > 1)""")
def g24_mapping_shape(spark: SparkSession, sf: str) -> DataFrame:
    return cdm.mapping_shape_gates(derived_mapping(spark, sf))


@query("""
WITH n AS (SELECT count(*) FILTER (l_quantity <= 0) AS a, count(*) FILTER (l_discount > 0.09) AS b, count(*) FILTER (l_returnflag IS NULL OR l_returnflag NOT IN ('A', 'N')) AS c, count(*) FILTER (l_shipdate IS NULL) AS d FROM lineitem),
g AS (SELECT 'quantity_positive' AS name, a AS violations FROM n UNION ALL SELECT 'discount_bounded', b FROM n UNION ALL SELECT 'flag_allowed', c FROM n UNION ALL SELECT 'shipped', d FROM n
UNION ALL SELECT 'one_status_an_order', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_linestatus) > 1)
UNION ALL SELECT 'line_key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1) UNION ALL SELECT 'part_known', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 2)
UNION ALL SELECT 'flag_counts', count(*) FROM (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) a FULL JOIN (VALUES ('A', 10), ('X', 1)) AS e(f, x) ON f = l_returnflag WHERE n IS DISTINCT FROM x)
SELECT name, violations, violations = 0 AS passed FROM g
""")
def g01_gates(spark: SparkSession, sf: str) -> DataFrame:
    """Row gates in one pass, group gates, references and expected counts (G01, G02,
    G04-G07, G09, G10)."""
    lines = table(spark, sf, "lineitem")
    rows = G.row_gates(lines, {
        "quantity_positive": F.col("l_quantity") <= 0, "discount_bounded": F.col("l_discount") > 0.09,
        "flag_allowed": ~G.allowed(F.col("l_returnflag"), ["A", "N"]), "shipped": F.col("l_shipdate").isNull(),
    })
    expected = spark.createDataFrame([("A", 10), ("X", 1)], "l_returnflag string, expected long")
    return G.all_gates(
        rows, G.group_gate(lines, "one_status_an_order", ["l_orderkey"], F.count_distinct("l_linestatus") > 1), G.unique_gate(lines, "line_key", ["l_orderkey", "l_linenumber"]),
        G.reference_gate(lines, "part_known", "l_partkey", table(spark, sf, "part").where("p_size > 2"), "p_partkey"), G.count_gate(lines, expected, "flag_counts", "l_returnflag"),
    )


@query("""
WITH f AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 2 = 0 THEN 'train' ELSE 'test' END AS split FROM customer WHERE c_custkey % 3 = 0), n AS (SELECT o_custkey AS k, array_to_string(list_sort(list(DISTINCT CASE WHEN o_orderkey % 40 = 0 THEN 'val' WHEN o_custkey % 2 = 0 THEN 'train' ELSE 'test' END)), ',') AS splits FROM orders GROUP BY 1)
SELECT f.k, f.split, n.splits FROM f LEFT JOIN n USING (k) WHERE n.splits IS DISTINCT FROM f.split
""")
def g15_frozen_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Frozen keys that are missing now, or whose set of splits is not the frozen one."""
    own = F.when(F.col("c_custkey") % 2 == 0, "train").otherwise("test")
    frozen = table(spark, sf, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("k"), own.alias("split"))
    now = F.when(F.col("o_orderkey") % 40 == 0, "val").when(F.col("o_custkey") % 2 == 0, "train").otherwise("test")
    splits = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.array_join(F.sort_array(F.collect_set(now)), ",").alias("splits"))
    return frozen.join(splits, "k", "left").where("not (splits <=> split)")


@query("""
SELECT doc_id, name FROM documents, (VALUES ('gnu general public license'), ('creative commons')) AS v(name) WHERE contains(lower(text), name)
""")
def g26_quoted_names(spark: SparkSession, sf: str) -> DataFrame:
    """Texts that quote one of a few names: a check of each name, without a join."""
    names = F.array(F.lit("gnu general public license"), F.lit("creative commons"))
    found = F.filter(names, lambda n: F.contains(F.lower("text"), n))
    return table(spark, sf, "documents").select("doc_id", F.explode(found).alias("name"))


DEFINITION = {
    "name": "filled_orders", "version": 1, "title": "Adults with a qualifying order", "index": {"condition_concept_ids": [1, 2, 3], "age_min": 18, "age_max": 70},
    "include": [{"procedure_concept_ids": [11]}, {"condition_concept_ids": [4, 5]}], "exclude": [{"procedure_concept_ids": [13]}], "breakdown": ["gender", "age_band"],
}
_COHORT = """
WITH person AS (SELECT c_custkey AS person_id, CASE WHEN c_custkey % 10 <> 0 THEN (1920 + c_custkey % 75)::INT END AS year_of_birth, c_nationkey % 2 AS gender FROM customer),
cond AS (SELECT o_custkey AS person_id, substr(o_orderpriority, 1, 1)::INT AS c, year(o_orderdate) AS y FROM orders),
proc AS (SELECT o_custkey AS person_id, CASE l_returnflag WHEN 'A' THEN 11 WHEN 'N' THEN 12 ELSE 13 END AS c FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_linenumber = 1),
idx AS (SELECT person_id, min(y - year_of_birth)::INT AS age, min(gender) AS gender FROM cond JOIN person USING (person_id) WHERE c IN (1, 2, 3) AND y - year_of_birth BETWEEN 18 AND 70 GROUP BY 1),
s1 AS (SELECT * FROM idx WHERE person_id IN (SELECT person_id FROM proc WHERE c = 11)), s2 AS (SELECT * FROM s1 WHERE person_id IN (SELECT person_id FROM cond WHERE c IN (4, 5))), s3 AS (SELECT * FROM s2 WHERE person_id NOT IN (SELECT person_id FROM proc WHERE c = 13)),
steps AS (SELECT 0 AS step, 'index' AS label, count(*) AS persons FROM idx UNION ALL SELECT 1, 'include procedure_concept_ids 11', count(*) FROM s1 UNION ALL SELECT 2, 'include condition_concept_ids 4,5', count(*) FROM s2 UNION ALL SELECT 3, 'exclude procedure_concept_ids 13', count(*) FROM s3)
"""


def cohort_tables(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    person = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("person_id"), F.when(F.col("c_custkey") % 10 != 0, (1920 + F.col("c_custkey") % 75).cast("int")).alias("year_of_birth"), (F.col("c_nationkey") % 2).alias("gender_concept_id")
    )
    orders = table(spark, sf, "orders")
    condition = orders.select(F.col("o_custkey").alias("person_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("condition_concept_id"), F.col("o_orderdate").alias("start_date"))
    code = F.when(F.col("l_returnflag") == "A", 11).when(F.col("l_returnflag") == "N", 12).otherwise(13)
    lines = table(spark, sf, "lineitem").where("l_linenumber = 1").join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return {"person": person, "condition_occurrence": condition, "procedure_occurrence": lines.select(F.col("o_custkey").alias("person_id"), code.alias("procedure_concept_id"))}


_STEPS = """, shown AS (SELECT step, label, persons, CASE WHEN persons BETWEEN 1 AND 10 OR before - persons BETWEEN 1 AND 10 THEN '<11' ELSE persons::VARCHAR END AS shown FROM (SELECT *, (WITH RECURSIVE r AS (
SELECT 0 AS step, persons AS last, persons FROM steps WHERE step = 0 UNION ALL SELECT s.step, CASE WHEN s.persons BETWEEN 1 AND 10 OR r.last - s.persons BETWEEN 1 AND 10 THEN r.last ELSE s.persons END, s.persons FROM r JOIN steps s ON s.step = r.step + 1)
SELECT max(last) FROM r WHERE r.step = o.step - 1) AS before FROM steps o))"""


@query(_COHORT + _STEPS + "SELECT * FROM shown")
def c02_attrition(spark: SparkSession, sf: str) -> DataFrame:
    """Attrition of a cohort definition with small steps hidden."""
    return cohort.suppressed_steps(cohort.attrition(cohort_tables(spark, sf), cohort.defined(DEFINITION)))


@query(_COHORT + """, b AS (SELECT gender, (floor(age / 10) * 10)::INT AS age_band, count(*) AS persons FROM s3 GROUP BY ALL)
SELECT *, CASE WHEN persons > 0 AND (SELECT count(*) FROM b WHERE persons BETWEEN 1 AND 10) > 0 THEN '<11' ELSE persons::VARCHAR END AS shown FROM b""")
def c03_breakdown(spark: SparkSession, sf: str) -> DataFrame:
    """The final cohort by gender and age, all hidden if a cell is small."""
    d = cohort.defined(DEFINITION)
    cells = cohort.breakdown(cohort_tables(spark, sf), d, d.breakdown)
    return cohort.suppressed_cells(cells, "persons", total_shown=True)


@query("""
WITH d AS (SELECT event_id AS seq, 'd' || (user_id % 50) AS digest, CASE event_type WHEN 'purchase' THEN 'approve' WHEN 'click' THEN 'escalate' ELSE 'reject' END AS decision FROM events)
SELECT digest, max_by(decision, seq) AS decision FROM d WHERE decision <> 'escalate' GROUP BY 1
""")
def c10_approval(spark: SparkSession, sf: str) -> DataFrame:
    decision = F.when(F.col("event_type") == "purchase", "approve").when(F.col("event_type") == "click", "escalate").otherwise("reject")
    rows = table(spark, sf, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("d"), (F.col("user_id") % 50).cast("string")).alias("digest"), decision.alias("decision"))
    return cohort.approval(rows)


@query(_COHORT + _STEPS + """, b AS (SELECT gender, (floor(age / 10) * 10)::INT AS age_band, count(*) AS persons FROM s3 GROUP BY ALL),
t AS (SELECT count(*) FILTER (persons BETWEEN 1 AND 10) > 0 AS low, count(*) AS k, coalesce(sum(persons), 0) AS persons FROM b),
f AS (SELECT low OR shown.shown = '<11' AS hide, shown.shown = '<11' OR low AND (t.k = 1 OR t.persons < t.k + 10) AS total FROM shown, t WHERE step = 3)
SELECT step AS release, '[]' AS cell, CASE WHEN step = 3 AND total THEN '<11' ELSE shown END AS shown FROM shown, f
UNION ALL SELECT 4, '[' || gender || ', ' || age_band || ']', CASE WHEN hide OR total THEN '<11' ELSE persons::VARCHAR END FROM b, f""")
def c12_service(spark: SparkSession, sf: str) -> DataFrame:
    """A definition approved, run and released through the guard."""
    service = cohort.Service(spark, cohort_tables(spark, sf))
    wider = DEFINITION | {"name": "wider", "exclude": [], "breakdown": []}
    for raw in (wider, DEFINITION):
        service.decide(cohort.defined(raw), "approve", "reviewer", "stand-in")
    service.run(wider, "analyst")
    return service.run(DEFINITION, "analyst")

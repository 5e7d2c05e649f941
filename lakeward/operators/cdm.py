"""A common-data-model build as relational algebra.

Input records (one an image): image_id, source, lesion_id, patient_id, sex, age,
site_local, site_1, site_2, label, diagnosis, confirm. Keys hash source keys, so a
rebuild gives the same ids. Dates are a placeholder: the records have none.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeward.functions import columns as C
from lakeward.operators import gates as G
from lakeward.operators import relational as R

ANCHOR = "2000-01-01"
ANCHOR_YEAR = 2000
#: Concept of the imaging procedure that every image stands for.
IMAGING_CONCEPT = 4013636

_L, _S, _I, _D = T.LongType(), T.StringType(), T.IntegerType(), T.DateType()


def _table(*fields: tuple) -> T.StructType:
    return T.StructType([T.StructField(name, kind, not required) for name, kind, required in fields])


TABLES = {
    "person": _table(("person_id", _L, True), ("gender_concept_id", _L, True), ("year_of_birth", _I, False), ("person_source_value", _S, False)),
    "observation_period": _table(("observation_period_id", _L, True), ("person_id", _L, True), ("start_date", _D, True), ("end_date", _D, True)),
    "condition_occurrence": _table(("condition_id", _L, True), ("person_id", _L, True), ("condition_concept_id", _L, True), ("start_date", _D, True), ("condition_source_value", _S, False)),
    "procedure_occurrence": _table(("procedure_id", _L, True), ("person_id", _L, True), ("procedure_concept_id", _L, True), ("start_date", _D, True), ("procedure_source_value", _S, False)),
    "image_occurrence": _table(("image_occurrence_id", _L, True), ("person_id", _L, True), ("site_concept_id", _L, True), ("condition_id", _L, False), ("site_field", _S, False)),
}


@dataclass(frozen=True)
class Build:
    """The prepared records and the tables made of them."""

    prepared: DataFrame
    lesions: DataFrame
    tables: dict[str, DataFrame]


def prepared(records: DataFrame, main: str) -> DataFrame:
    """Records with lesion key, person key, ids, mapping scope and body site.

    A lesion has one person: the greatest of its rows' keys, by which a patient key
    beats a lesion key. The site is the local one at the main source, else the finer
    of the two standard fields; the field it is from is kept for the lookup.
    """
    lesion = F.concat_ws(":", "source", "lesion_id")
    own = F.when(F.col("patient_id").isNotNull(), F.concat_ws(":", "source", F.lit("patient"), "patient_id")).otherwise(F.concat_ws(":", "source", F.lit("lesion"), "lesion_id"))
    at_main = F.col("source") == main
    site, field = C.first_present(
        site_local=F.when(at_main, F.col("site_local")), site_2=F.when(~at_main, F.col("site_2")), site_1=F.when(~at_main, F.col("site_1"))
    )
    out = records.withColumns({"lesion_key": lesion, "own_key": own, "scope": F.when(at_main, F.lit(main)).otherwise("sites"), "site": site, "site_field": field})
    out = out.withColumn("person_key", F.max("own_key").over(Window.partitionBy("lesion_key"))).drop("own_key")
    return out.withColumns({"person_id": C.stable_id(F.col("person_key")), "condition_id": C.stable_id(F.col("lesion_key"))})


def lesions(rows: DataFrame) -> DataFrame:
    """One row a lesion: person, scope and the modes of diagnosis, label and confirm."""
    base = rows.groupBy("lesion_key").agg(*(F.min(c).alias(c) for c in ("person_key", "person_id", "condition_id", "scope")))
    for column in ("diagnosis", "label", "confirm"):
        base = base.join(R.modes(rows, ["lesion_key"], column), "lesion_key", "left")
    return base


def mapped(rows: DataFrame, mapping: DataFrame, field: str, value: str, result: str) -> DataFrame:
    """``rows`` with ``result`` looked up for the values of one source field."""
    one = mapping.where(F.col("field") == field).select("scope", "value", F.col("concept_id").alias(result))
    return R.looked_up(rows, one, "scope", value, result)


def _sited(rows: DataFrame, mapping: DataFrame) -> DataFrame:
    """Looked up by the field that the site is from, which differs between rows."""
    keyed = rows.withColumn("_site", F.concat_ws("=", "site_field", "site"))
    one = mapping.where(F.col("field").startswith("site_")).select("scope", F.concat_ws("=", "field", "value").alias("value"), F.col("concept_id").alias("site_concept_id"))
    return R.looked_up(keyed, one, "scope", "_site", "site_concept_id").drop("_site")


def build(records: DataFrame, mapping: DataFrame, main: str) -> Build:
    """All tables from one preparation. ``mapping``: field, scope, value, concept_id."""
    rows = prepared(records, main)
    each = lesions(rows)
    date = F.to_date(F.lit(ANCHOR))
    sexes = R.modes(rows, ["person_key"], "sex")
    people = rows.groupBy("person_key").agg(F.min("person_id").alias("person_id"), F.min("age").alias("age"), F.min("scope").alias("scope")).join(sexes, "person_key", "left")
    people = mapped(people, mapping, "sex", "sex", "gender_concept_id")
    diagnosed = each.withColumn("condition_source_value", F.coalesce("diagnosis", "label")).where("condition_source_value is not null")
    fine = mapped(mapped(diagnosed, mapping, "diagnosis", "diagnosis", "fine_id"), mapping, "label", "label", "coarse_id")
    concept = F.when(F.col("diagnosis").isNotNull(), F.col("fine_id")).otherwise(F.col("coarse_id"))
    imaging = rows.select(C.stable_id(F.lit("img"), F.col("image_id")).alias("procedure_id"), "person_id", F.lit(IMAGING_CONCEPT).alias("procedure_concept_id"), F.lit("image").alias("procedure_source_value"))
    confirmed = mapped(each, mapping, "confirm", "confirm", "procedure_concept_id").where("procedure_concept_id <> 0")
    confirmed = confirmed.select(C.stable_id(F.lit("confirm"), F.col("lesion_key")).alias("procedure_id"), "person_id", "procedure_concept_id", F.col("confirm").alias("procedure_source_value"))
    with_condition = diagnosed.select(F.col("lesion_key").alias("_lesion"), F.col("condition_id").alias("_condition"))
    images = _sited(rows, mapping).drop("condition_id").join(with_condition, F.col("lesion_key") == F.col("_lesion"), "left")
    tables = {
        "person": people.withColumns({"year_of_birth": (ANCHOR_YEAR - F.col("age").cast("int")), "person_source_value": F.col("person_key")}),
        "observation_period": people.withColumns({"observation_period_id": C.stable_id(F.lit("op"), F.col("person_key")), "start_date": date, "end_date": date}),
        "condition_occurrence": fine.withColumns({"condition_concept_id": concept, "start_date": date}),
        "procedure_occurrence": imaging.unionByName(confirmed).withColumn("start_date", date),
        "image_occurrence": images.withColumns({"image_occurrence_id": C.stable_id(F.lit("image"), F.col("image_id")), "condition_id": F.col("_condition")}),
    }
    return Build(rows, each, {name: R.conformed(df, TABLES[name]) for name, df in tables.items()})


def source_row(spark, name: str, version: str) -> DataFrame:
    """The one row that says what the build is."""
    return spark.createDataFrame([(name, version, ANCHOR)], "source_name string, cdm_version string, anchor string").withColumn("anchor", F.to_date("anchor"))


def unmapped(rows: DataFrame, each: DataFrame, mapping: DataFrame) -> DataFrame:
    """Distinct recorded values (field, scope, value) that the mapping lacks."""
    parts = [rows.select(F.lit("sex").alias("field"), "scope", F.col("sex").alias("value")), rows.select(F.col("site_field").alias("field"), "scope", F.col("site").alias("value"))]
    parts += [each.select(F.lit(c).alias("field"), "scope", F.col(c).alias("value")) for c in ("diagnosis", "label", "confirm")]
    values = parts[0]
    for p in parts[1:]:
        values = values.unionByName(p)
    values = values.where("trim(value) <> ''").distinct()
    known = mapping.select(F.col("field").alias("f"), F.col("scope").alias("s"), F.col("value").alias("v"))
    same = (F.col("field") == F.col("f")) & (F.col("value") == F.col("v")) & ((F.col("s") == "all") | (F.col("scope") == F.col("s")))
    return values.join(known, same, "left_anti")


def concept_gates(built: Build, mapping: DataFrame, concepts: DataFrame) -> DataFrame:
    """Keys, references, mapped values, required columns and row counts of a build."""
    t = built.tables
    keys = {name: schema.fieldNames()[0] for name, schema in TABLES.items()}
    gates = [G.unique_gate(t[name], f"{name}_key", [key]) for name, key in keys.items()]
    gates += [G.reference_gate(t[name], f"{name}_person", "person_id", t["person"], "person_id") for name in keys if name != "person"]
    gates += [G.reference_gate(t["image_occurrence"], "image_condition", "condition_id", t["condition_occurrence"], "condition_id")]
    gates += [G.required_gate(t[name], f"{name}_required", [f.name for f in schema if not f.nullable]) for name, schema in TABLES.items()]
    gates += [built_counts(built), mapping_gate(built, mapping), one_diagnosis(built)]
    used = None
    for name, column in (("person", "gender_concept_id"), ("condition_occurrence", "condition_concept_id"), ("procedure_occurrence", "procedure_concept_id"), ("image_occurrence", "site_concept_id")):
        part = t[name].select(F.col(column).alias("concept"))
        used = part if used is None else used.unionByName(part)
    gates.append(G.reference_gate(used.where("concept <> 0").distinct(), "concepts_resolve", "concept", concepts, "concept_id"))
    return G.all_gates(*gates)


def built_counts(built: Build) -> DataFrame:
    """One image row a record and one period a person."""
    counts = [
        (built.prepared, built.tables["image_occurrence"]),
        (built.tables["person"], built.tables["observation_period"]),
    ]
    gaps = None
    for a, b in counts:
        one = a.agg(F.count("*").alias("a")).join(b.agg(F.count("*").alias("b")), F.lit(True)).select((F.col("a") != F.col("b")).cast("long").alias("v"))
        gaps = one if gaps is None else gaps.unionByName(one)
    return gaps.agg(F.sum("v").alias("violations")).select(F.lit("row_counts").alias("name"), "violations")


def mapping_gate(built: Build, mapping: DataFrame) -> DataFrame:
    return unmapped(built.prepared, built.lesions, mapping).agg(F.count("*").alias("violations")).select(F.lit("every_value_mapped").alias("name"), "violations")


def one_diagnosis(built: Build) -> DataFrame:
    return G.group_gate(built.prepared, "one_diagnosis_per_lesion", ["lesion_key"], F.count_distinct("diagnosis") > 1)


def mapping_shape_gates(mapping: DataFrame) -> DataFrame:
    """Checks of a mapping's own rows: digits, duplicates, a note for every zero."""
    row = G.row_gates(mapping, {"negative_concept": F.col("concept_id") < 0, "blank_value": F.coalesce(F.trim("value"), F.lit("")) == "", "zero_without_note": (F.col("concept_id") == 0) & (F.coalesce("note", F.lit("")) == "")})
    return G.all_gates(row, G.unique_gate(mapping, "duplicate_rows", ["field", "scope", "value"]))


def vocabulary_gates(mapping: DataFrame, concepts: DataFrame) -> DataFrame:
    """Mapped concepts that are missing, not standard, not valid or of another domain."""
    joined = mapping.where("concept_id <> 0").join(concepts.withColumnRenamed("concept_id", "c"), F.col("concept_id") == F.col("c"), "left")
    known = F.col("c").isNotNull()
    return G.all_gates(G.row_gates(joined, {
        "missing": ~known, "not_standard": known & ~F.col("standard_concept").eqNullSafe(F.lit("S")), "invalid": known & F.col("invalid_reason").isNotNull(),
        "other_domain": known & ~F.col("domain_id").eqNullSafe(F.col("expected_domain")),
    }))

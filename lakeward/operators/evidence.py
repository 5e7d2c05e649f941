"""Evidence about results: leaves of documents, stale files, manifests, identifiers."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeward.operators import gates as G

#: Namespace of the identifiers made from keys; any fixed UUID would do.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")


def leaves(df: DataFrame, key: str, document: str) -> DataFrame:
    """key, path, value of the numbers in each row's JSON document; lists count from 0.

    Each level of nesting is exploded once, as long as any document goes deeper. What is
    no JSON has no leaves.
    """
    rows = df.select(F.col(key).alias("key"), F.lit("").alias("path"), F.try_parse_json(document).alias("v"))
    tvf, out, kind = df.sparkSession.tvf, [], F.schema_of_variant("v")
    while True:
        value = F.when(kind.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)"), F.try_variant_get("v", "$", "double"))
        out.append(rows.select("key", "path", value.alias("value")).where("value is not null"))
        inner = rows.where(kind.rlike("^(OBJECT|ARRAY)")).select("key", "path", F.col("v").alias("whole"))
        if inner.isEmpty():
            return reduce(DataFrame.unionByName, out)
        parts = inner.lateralJoin(tvf.variant_explode(F.col("whole").outer()).toDF("place", "name", "v"))
        named = F.concat(F.when(F.col("path") != "", F.concat("path", F.lit("."))).otherwise(""), "name")
        at = F.when(F.col("name").isNull(), F.concat("path", F.lit("["), F.col("place").cast("string"), F.lit("]"))).otherwise(named)
        rows = parts.select("key", at.alias("path"), "v")


def stale(files: DataFrame, index: DataFrame) -> DataFrame:
    """name, reason of indexed files (name, sha256) that are gone or have changed."""
    now = files.select(F.col("name"), F.sha2("content", 256).alias("now"))
    reason = F.when(F.col("now").isNull(), "missing").when(F.col("now") != F.col("sha256"), "changed")
    return index.join(now, "name", "left").withColumn("reason", reason).where("reason is not null").select("name", "reason")


def manifest_gates(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Plain names, each once, and every file there with the hash it should have."""
    return G.all_gates(
        G.row_gates(manifest, {"plain_name": ~F.coalesce(F.col("name").rlike(r"^[A-Za-z0-9_][A-Za-z0-9_.-]*$"), F.lit(False))}), G.unique_gate(manifest, "listed_once", ["name"]),
        stale(files, manifest).agg(F.count("*").alias("violations")).select(F.lit("as_hashed").alias("name"), "violations"),
    )


def with_uid(df: DataFrame, key: str, name: str = "uid") -> DataFrame:
    """``df`` with an identifier of the UUID-derived "2.25." form for each key.

    The 128 bits, a name-based UUID of version 5, are divided by 10**9 four times, in
    parts of 32 bits, as they fit no decimal.
    """
    digest = F.sha1(F.concat(F.lit(NAMESPACE.bytes), F.col(key).cast("binary")))
    bits = F.concat(F.substring(digest, 1, 12), F.lit("5"), F.substring(digest, 14, 3), F.lower(F.hex(F.conv(F.substring(digest, 17, 1), 16, 10).cast("long").bitwiseAND(F.lit(3)).bitwiseOR(F.lit(8)))), F.substring(digest, 18, 15))
    parts = F.array(*(F.conv(F.substring(bits, at, 8), 16, 10).cast("long") for at in (1, 9, 17, 25)))
    billion = F.lit(10**9).cast("long")

    def divide(state: Column, part: Column) -> Column:
        value = state["rest"] * (1 << 32) + part
        return F.struct((value % billion).alias("rest"), F.concat(state["quotient"], F.array(F.call_function("div", value, billion))).alias("quotient"))

    start = F.struct(F.lit(0).cast("long").alias("rest"), F.array().cast("array<bigint>").alias("quotient"))
    out = df.withColumn("_quotient", parts)
    for i in range(4):
        out = out.withColumn("_divided", F.aggregate("_quotient", start, divide)).withColumns({f"_digits{i}": F.lpad(F.col("_divided.rest").cast("string"), 9, "0"), "_quotient": F.col("_divided.quotient")})
    digits = F.concat(F.element_at("_quotient", -1).cast("string"), *(f"_digits{i}" for i in (3, 2, 1, 0)))
    return out.withColumn(name, F.concat(F.lit("2.25."), F.ltrim(digits, F.lit("0")))).drop("_quotient", "_divided", *(f"_digits{i}" for i in range(4)))


def faulty(rows: DataFrame, key: str, moved: Column, label: str, group: str) -> DataFrame:
    """A copy with known faults: the group of ``moved`` rows is another's, one label is
    dropped and one row is there twice. Each must fail its own gate."""
    first = rows.agg(F.min(key).alias("_first"), F.max(key).alias("_last"))
    out = rows.join(first, F.lit(True)).withColumn(group, F.when(moved, F.concat(F.col(group), F.lit("-moved"))).otherwise(F.col(group)))
    out = out.withColumn(label, F.when(F.col(key) != F.col("_first"), F.col(label)))
    twice = out.where(F.col(key) == F.col("_last"))
    return out.unionByName(twice).drop("_first", "_last")

"""Data-quality gates as set-based plans.

A gate is a row (name, violations, detail). Row gates of one frame are counted in a
single pass; examples come from a sort that keeps five rows. Nulls are decided gate by
gate: a predicate that is null is a violation only where it says so.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EXAMPLES = 5


def _detail(shown: Column, count: Column, k: int = EXAMPLES) -> Column:
    more = F.concat(F.lit(" (+"), (count - k).cast("string"), F.lit(" more)"))
    return F.concat(F.array_join(shown, ", "), F.when(count > k, more).otherwise(""))


def violations(df: DataFrame, predicate: Column, key: str, name: str = "", k: int = EXAMPLES) -> DataFrame:
    """One row: how many rows the predicate holds for, and the first keys of them."""
    bad = df.where(predicate)
    count = bad.agg(F.count("*").alias("violations"))
    shown = bad.select(F.col(key).alias("k")).orderBy("k").limit(k).agg(F.transform(F.sort_array(F.collect_list("k")), lambda x: x.cast("string")).alias("shown"))
    return count.join(shown, F.lit(True)).select(F.lit(name).alias("name"), "violations", _detail(F.col("shown"), F.col("violations"), k).alias("detail"))


def row_gates(df: DataFrame, gates: Mapping[str, Column]) -> DataFrame:
    """name, violations of many row predicates in one pass over ``df``."""
    counts = df.agg(*(F.count_if(p).alias(n) for n, p in gates.items()))
    pairs = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(n).alias("violations")) for n in gates)))
    return counts.select(pairs.alias("g")).select("g.name", "g.violations")


def group_gate(df: DataFrame, name: str, keys: Sequence[str], bad: Column) -> DataFrame:
    """name, violations: groups for which an aggregate condition holds."""
    groups = df.groupBy(*keys).agg(bad.alias("bad"))
    return groups.agg(F.count_if("bad").alias("violations")).select(F.lit(name).alias("name"), "violations")


def unique_gate(df: DataFrame, name: str, keys: Sequence[str]) -> DataFrame:
    return group_gate(df, name, keys, F.count("*") > 1)


def reference_gate(df: DataFrame, name: str, column: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose value, if they have one, is no key of the parent."""
    orphans = df.where(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias("_parent")), F.col(column) == F.col("_parent"), "left_anti")
    return orphans.agg(F.count("*").alias("violations")).select(F.lit(name).alias("name"), "violations")


def required_gate(df: DataFrame, name: str, columns: Sequence[str]) -> DataFrame:
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in columns))
    return df.agg(F.count_if(missing).alias("violations")).select(F.lit(name).alias("name"), "violations")


def count_gate(actual: DataFrame, expected: DataFrame, name: str, key: str) -> DataFrame:
    """Keys whose count differs, or that only one side has."""
    both = actual.groupBy(key).agg(F.count("*").alias("actual")).join(expected, key, "full")
    return both.agg(F.count_if(~F.col("actual").eqNullSafe(F.col("expected"))).alias("violations")).select(F.lit(name).alias("name"), "violations")


def allowed(column: Column, values: Sequence[str]) -> Column:
    """False for a null, unlike SQL's IN."""
    return F.coalesce(column.isin(*values), F.lit(False))


def differing(a: Column, b: Column) -> Column:
    """True where two values differ or either is null, two nulls included."""
    return F.coalesce(a != b, F.lit(True))


def lacking_gate(df: DataFrame, name: str, keys: Sequence[str], column: str, wanted: Sequence[str]) -> DataFrame:
    """Groups that lack one of the ``wanted`` values."""
    return group_gate(df, name, keys, F.count_distinct(F.when(F.col(column).isin(*wanted), F.col(column))) < len(wanted))


def fingerprint(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row: a digest of the multiset of rows, whatever their order: the sums of two
    halves of each row's hash."""
    digest = F.sha2(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in columns)), 256)
    halves = (F.sum(F.conv(F.substring(digest, at, 12), 16, 10).cast("decimal(38,0)")) for at in (1, 13))
    return df.agg(F.sha2(F.concat_ws("|", F.count("*"), *halves), 256).alias("fingerprint"))


def fingerprint_gate(df: DataFrame, name: str, columns: Sequence[str], expected: str) -> DataFrame:
    wrong = differing(F.col("fingerprint"), F.lit(expected)).cast("long")
    return fingerprint(df, columns).select(F.lit(name).alias("name"), wrong.alias("violations"))


def all_gates(*gates: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, gates).withColumn("passed", F.col("violations") == 0)


def enforce(gates: DataFrame) -> None:
    """Raise with the names of the gates that failed."""
    failed = [f"{r['name']}: {r['violations']}" for r in gates.where("violations > 0").orderBy("name").collect()]
    if failed:
        raise ValueError("gates failed: " + ", ".join(failed))


def profile(df: DataFrame) -> DataFrame:
    """column_name, row_count, nulls of every column in one aggregate."""
    nulls = df.agg(F.count("*").alias("n"), *(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in df.columns))
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"null_{c}").alias("nulls")) for c in df.columns)))
    return nulls.select("n", pairs.alias("p")).select("p.column_name", F.col("n").alias("row_count"), "p.nulls")

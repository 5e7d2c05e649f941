"""Relational building blocks: latest rows, lookups, modes, validity, windows, chains."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lakeward.operators.ranks import running


def latest(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key in ``order``, which should end in a tie-breaker."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_place", place).where("_place = 1").drop("_place")


def top_per_group(df: DataFrame, groups: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their rank."""
    place = F.row_number().over(Window.partitionBy(*groups).orderBy(*order))
    return df.withColumn("rank", place).where(F.col("rank") <= k)


def looked_up(df: DataFrame, mapping: DataFrame, scope: str, value: str, result: str, every: str = "all") -> DataFrame:
    """``df`` with ``result`` from ``mapping`` (scope, value, result).

    A row of the own scope beats one of the scope ``every``; no row leaves a null, so
    an unmapped value differs from one mapped to zero. The mapping is a small table.
    """
    own = mapping.where(F.col("scope") != every).select(F.col("scope").alias("_scope"), F.col("value").alias("_value"), F.col(result).alias("_own"))
    any_scope = mapping.where(F.col("scope") == every).select(F.col("value").alias("_any_value"), F.col(result).alias("_any"))
    joined = df.join(own, (F.col(scope) == F.col("_scope")) & (F.col(value) == F.col("_value")), "left")
    joined = joined.join(any_scope, F.col(value) == F.col("_any_value"), "left")
    return joined.withColumn(result, F.coalesce("_own", "_any")).drop("_scope", "_value", "_own", "_any_value", "_any")


def modes(df: DataFrame, keys: Sequence[str], value: str, last: str = "NOS") -> DataFrame:
    """The commonest value of each key; of equals one not ending in ``last``, then the
    first in order. Nulls do not count, and a key without a value is absent."""
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("_n"))
    order = F.struct(-F.col("_n"), F.col(value).endswith(last), F.col(value))
    return counted.groupBy(*keys).agg(F.min_by(value, order).alias(value))


def with_largest(df: DataFrame, key: str, value: str, name: str) -> DataFrame:
    """``df`` with the largest ``value`` of each row's key: aggregated and joined back, so
    that a key of many rows is a join that Spark may split, and no window in one task. A
    null key is a key."""
    most = df.groupBy(F.col(key).alias("_key")).agg(F.max(value).alias(name))
    return df.join(most, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def valid_at(df: DataFrame, intervals: DataFrame, keys: Sequence[str], time: str, start: str, end: str) -> DataFrame:
    """Left join to the interval that holds ``time``: start <= time < end, an open end
    being null. An equality join on the keys, so that only their intervals meet."""
    named = intervals.select([F.col(k).alias(f"_{k}") for k in keys] + [F.col(c) for c in intervals.columns if c not in keys])
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    inside = (F.col(time) >= F.col(start)) & (F.col(end).isNull() | (F.col(time) < F.col(end)))
    return df.join(named, [*same, inside], "left").drop(*(f"_{k}" for k in keys))


def fingerprint(df: DataFrame, *columns: str) -> Column:
    """SHA-256 over the sorted distinct lines of the columns, its first 16 digits.

    For sets of the size of a split list: the lines of a group meet in one row.
    """
    lines = F.sort_array(F.collect_set(F.struct(*columns)))
    joined = F.array_join(F.transform(lines, lambda s: F.concat_ws(",", *(s[c].cast("string") for c in columns))), "\n")
    return F.substring(F.sha2(joined, 256), 1, 16)


def fingerprints(df: DataFrame, groups: Sequence[str], *columns: str, most: int = 1_000_000) -> DataFrame:
    """groups and fingerprint, once no group is known to have more than ``most`` rows; for
    larger ones ``gates.fingerprint`` sums over a group in any order."""
    largest = df.groupBy(*groups).count().agg(F.max("count")).first()[0]
    if largest and largest > most:
        raise ValueError(f"a group of {largest} rows, of which a fingerprint holds {most} at most")
    return df.groupBy(*groups).agg(fingerprint(df, *columns).alias("fingerprint"))


def whole_groups(df: DataFrame, group: str, order: Column, cap: int) -> DataFrame:
    """Groups in ``order`` while their running row count stays at or below ``cap``; the
    first that would pass it ends the draw. A group has a row at least, so no more than
    ``cap`` + 1 of them are put in order."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n")).withColumn("_order", order)
    sizes = sizes.orderBy("_order", group).limit(cap + 1)
    running = F.sum("_n").over(Window.orderBy("_order", group).rowsBetween(Window.unboundedPreceding, 0))
    fitting = sizes.withColumn("_running", running).where(F.col("_running") <= cap)
    return df.join(fitting.select(group), group, "left_semi")


def trailing_window(df: DataFrame, groups: Sequence[str], order: str, amount: str, gap: str, least: int) -> DataFrame:
    """Rows from the latest back until ``amount`` sums to ``least``; a row whose ``gap``
    column is null ends the window before it."""
    back = Window.partitionBy(*groups).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*groups).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, 0)
    marked = df.withColumn("_before", F.coalesce(F.sum(amount).over(back), F.lit(0))).withColumn("_gaps", F.sum(F.col(gap).isNull().cast("int")).over(upto))
    return marked.where((F.col("_before") < least) & (F.col("_gaps") == 0)).drop("_before", "_gaps")


def islands(df: DataFrame, groups: Sequence[str], number: str) -> DataFrame:
    """Runs of consecutive whole numbers: groups, first, last."""
    distinct = df.select(*groups, number).distinct()
    key = F.col(number) - F.row_number().over(Window.partitionBy(*groups).orderBy(number))
    return distinct.withColumn("_island", key).groupBy(*groups, "_island").agg(F.min(number).alias("first"), F.max(number).alias("last")).drop("_island")


def chain_faults(log: DataFrame, groups: Sequence[str] = ()) -> DataFrame:
    """Each entry of a hash-chained log (seq, prev, hash, body) with what is wrong:
    a gap in seq, a broken link to the entry before, or an edited body.

    Entries are numbered over ranges of seq and each is joined to the one before it, so a
    long chain is many tasks; no hash needs another one to be checked.
    """
    keys = [f"_{g}" for g in groups]
    one = log.withColumns({"_entry": F.struct("seq", "hash", "prev", "body"), "_c": F.lit(1)})
    placed = running(one, groups, "_entry", ["_c"])
    before = placed.select(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)), (F.col("_c_before") + 1).alias("_next"), F.col("hash").alias("_last"))
    same = [F.col(g).eqNullSafe(F.col(k)) for g, k in zip(groups, keys, strict=True)]
    linked = placed.join(before, [*same, F.col("_c_before") == F.col("_next")], "left")
    again = F.sha2(F.concat_ws("|", "seq", "prev", "body"), 256)
    faults = {"gap": F.col("seq") != F.col("_c_before"), "broken": F.col("prev") != F.coalesce("_last", F.lit("")), "edited": F.col("hash") != again}
    return linked.withColumns(faults).select(*log.columns, *faults)


def chained(df: DataFrame, groups: Sequence[str], order: Sequence[str], body: Column, depth: int | None = None) -> DataFrame:
    """A hash-chained log of each group's entries in order, or of the first ``depth``.

    Each entry needs the hash before it, so a group's entries pass one task in order,
    which holds a batch of them and the last hash.
    """
    keys = [f"_g{i}" for i in range(len(groups))]
    rows = df.select(*(F.col(g).alias(k) for g, k in zip(groups, keys, strict=True)), *(F.col(o).alias(f"_o{i}") for i, o in enumerate(order)), body.cast("string").alias("body"))
    dealt = rows.repartition(*keys) if keys else rows.repartition(1)
    dealt = dealt.sortWithinPartitions(*keys, *(f"_o{i}" for i in range(len(order))), "body").select(*keys, "body")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seq, last = None, 0, ""
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                held = repr([row[k] for k in keys])  # a group of NaN equals itself
                if held != group:
                    group, seq, last = held, 0, ""
                parts = [str(seq), last, *([] if row["body"] is None else [row["body"]])]
                digest = hashlib.sha256("|".join(parts).encode()).hexdigest()
                out.append((seq, last, digest))
                seq, last = seq + 1, digest
            columns = [pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 3, (pa.int32(), pa.string(), pa.string()), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), columns[0], columns[1], batch.column("body"), columns[2]], [*keys, "seq", "prev", "body", "hash"])

    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in dealt.select(*keys).schema) if keys else ""
    log = dealt.mapInArrow(link, f"{kinds}seq int, prev string, body string, hash string")
    log = log if depth is None else log.where(F.col("seq") < depth)
    return log.select(*(F.col(k).alias(g) for g, k in zip(groups, keys, strict=True)), "seq", "prev", "body", "hash")


def multiset_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one side has more often than the other, with the side they are on."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def first_wins(frames: Sequence[DataFrame], key: str) -> DataFrame:
    """The union of frames with one row a key, from the first frame that has it."""
    marked = [f.withColumn("_rank", F.lit(i)) for i, f in enumerate(frames)]
    both = marked[0]
    for f in marked[1:]:
        both = both.unionByName(f, allowMissingColumns=True)
    return latest(both, [key], [F.col("_rank"), F.hash(*[c for c in both.columns if c != "_rank"])]).drop("_rank")


def unseen(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Distinct keys of ``df`` that ``known`` lacks."""
    return df.select(key).where(F.col(key).isNotNull()).distinct().join(known.select(key), key, "left_anti")


def conformed(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns in the order and types of ``schema``; a required number that is missing
    becomes 0, anything else null."""
    out = []
    for f in schema:
        value = F.col(f.name) if f.name in df.columns else F.lit(None)
        value = value.cast(f.dataType)
        numeric = f.dataType.typeName() in ("integer", "long", "double")
        out.append((F.coalesce(value, F.lit(0).cast(f.dataType)) if not f.nullable and numeric else value).alias(f.name))
    return df.select(*out)


def joined_whole(df: DataFrame, other: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: how many rows an inner join keeps, and whether that is every row once."""
    kept = df.join(other, list(keys)).agg(F.count("*").alias("joined"))
    return df.agg(F.count("*").alias("rows")).join(kept, F.lit(True)).withColumn("whole", F.col("rows") == F.col("joined"))


def history_merged(kept: DataFrame, backfill: DataFrame, key: str, counted: str) -> DataFrame:
    """``kept`` with rows of ``backfill`` for keys it lacks or whose count is missing."""
    fields = [c for c in kept.columns if c != key]
    old = kept.select(key, F.struct(*fields).alias("_kept"))
    new = backfill.select(key, F.struct(*fields).alias("_new"))
    lacking = F.col("_kept").isNull() | (F.col(f"_kept.{counted}").isNull() & F.col("_new").isNotNull())
    row = F.when(lacking, F.col("_new")).otherwise(F.col("_kept"))
    return old.join(new, key, "full").select(key, row.alias("_row")).select(key, "_row.*")

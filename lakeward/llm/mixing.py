"""Mixing sources to target weights by weighted fair queueing.

Every copy of a document gets a virtual finish time: the words its source has sent up
to and including it, in shuffled order, divided by the source's target. Copies are
ranged by that time over all sources and the mix is cut where the total budget is
spent. Running totals go over many tasks: rows are dealt into buckets of their sort
key, bucket totals are summed first, and each bucket then runs on from its offset, so
a source with a third of all rows is no single task; nor is a doc_id, or the lack of one,
that many rows share, whose rows are buckets by size and by the task that read them. Buckets of the shuffle are as many
as the rows ask for; virtual time is cut into slices and the slice in which the budget
ends into slices again. Sources are weighed in one task, a row for each source.

Nulls and ties: a null text has size 0, as has one without words, and a very long text
is counted like any other; a null source is a source of its own and the last in order; a
null doc_id sorts before all others; rows that agree in source, doc_id and size are
interchangeable. An empty table gives an empty mix. Other columns are not looked at,
whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lakeward.llm.shared import discard, stored

WEIGHTS = (5, 2, 1)
#: No source is taken more often than this, and so no document.
MAX_PASSES = 3
#: Rows of a bucket of the shuffle, on average, for a source that has all of them.
BUCKET_ROWS = 100_000
BUCKET = ["_bucket", "_part", "_at", "_of"]
#: Slices of virtual time from 0 to 1, and of one of them.
SLICES = 4096


def word_count(text: Column) -> Column:
    """Runs of anything but the space and the characters 9 to 13; 0 for a null."""
    return F.coalesce(F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """One row per source: source, source_size, target.

    Water filling: sources in the order of cap over weight stop at their cap as long
    as an even share by weight of what is left would pass it.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.partitionBy(F.lit(1)).orderBy(F.col("source").asc_nulls_last())
    place = (F.row_number().over(order) - 1) % len(weights)
    weighed = by_source.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (place + 1).cast("int")))
    weighed = weighed.withColumn("cap", F.lit(max_passes) * F.col("source_size"))
    every = Window.partitionBy(F.lit(1))
    by_ratio = every.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    onward = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    capped = weighed.withColumn("capped", left * F.col("weight") > F.col("cap") * F.sum("weight").over(onward))
    free = F.sum("source_size").over(every) - F.sum(F.when(F.col("capped"), F.col("cap")).otherwise(0)).over(every)
    weight = F.sum(F.when(F.col("capped"), 0).otherwise(F.col("weight"))).over(every)
    share = F.col("weight") * (free.cast("double") / F.nullif(weight, F.lit(0)).cast("double"))
    target = F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.coalesce(share, F.lit(0.0)))
    return capped.select("source", "source_size", target.alias("target"))


def running_total(df: DataFrame, bucket: list[str], key: list[Column], group: list[str], value: str, name: str) -> DataFrame:
    """``name``: the sum of ``value`` in ``group`` up to and including the row, in the
    order of ``bucket`` and, inside a bucket, of ``key``."""
    where = [*group, *bucket]
    totals = df.groupBy(*(F.col(c).alias(f"t_{c}") for c in where)).agg(F.sum(value).alias("_total"))
    ahead = Window.partitionBy(*(f"t_{c}" for c in group)).orderBy(*(f"t_{c}" for c in bucket)).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(*(f"t_{c}" for c in where), F.coalesce(F.sum("_total").over(ahead), F.lit(0)).alias("_offset"))
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in where]
    inside = Window.partitionBy(*where).orderBy(*key).rowsBetween(Window.unboundedPreceding, 0)
    joined = df.join(offsets, same, "left")
    return joined.withColumn(name, F.sum(value).over(inside) + F.col("_offset")).drop("_offset", *(f"t_{c}" for c in where))


def bucketed(rows: DataFrame, digits: int, most: int) -> DataFrame:
    """``rows`` with the columns of ``BUCKET``, which together are in the order of key, size
    and lot.

    A bucket is the keys with the same first ``digits``. A key with more than ``most`` rows,
    such as that of rows without a doc_id, would make a bucket too large: its rows are
    buckets of their own by size and by the lot they were written in, and so are the keys
    before and after it. Such keys are fewer than rows / ``most``, a bounded broadcast.
    """
    prefix = F.substring("_key", 1, digits)
    hot = rows.groupBy("_key").count().where(F.col("count") > most)
    hot = hot.groupBy(prefix.alias("_prefix")).agg(F.collect_set("_key").alias("_hot"))
    placed = rows.withColumn("_bucket", prefix).join(F.broadcast(hot), F.col("_bucket") == F.col("_prefix"), "left")
    own = F.coalesce(F.array_contains("_hot", F.col("_key")), F.lit(False))
    ahead = F.coalesce(F.size(F.filter("_hot", lambda k: k < F.col("_key"))), F.lit(0))
    columns = {"_part": 2 * ahead + own.cast("int"), "_at": F.when(own, F.col("size")).otherwise(0), "_of": F.when(own, F.col("_lot")).otherwise(0)}
    return placed.withColumns(columns).drop("_prefix", "_hot")


def _cut(sliced: DataFrame, budget: int, spent: int) -> Row | None:
    """The slice that the budget ends in, and the words spent before it."""
    words = sliced.groupBy("_slice").agg(F.sum("size").alias("_words"))
    until = Window.partitionBy(F.lit(1)).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)  # a row for each slice
    placed = words.withColumn("_before", F.coalesce(F.sum("_words").over(until), F.lit(0)) + F.lit(spent))
    ends = placed.where((F.col("_before") <= budget) & (F.col("_before") + F.col("_words") > budget))
    return ends.agg(F.max(F.struct("_slice", "_before"))).first()[0]


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``keep`` of every document with size, source_size, target and taken.

    ``taken`` counts the words the mix takes of the document, repeats included.
    """
    names = [c for c in keep if c not in ("doc_id", "source")]
    # Texts are read and counted once; all that follows goes over these short rows.
    sized = stored(docs.select(F.col("doc_id").cast("long"), "source", *names, word_count(F.col("text")).alias("size"), F.spark_partition_id().alias("_lot")), "sizes")
    shuffled = sized.withColumn("_key", F.coalesce(F.md5(F.col("doc_id").cast("string")), F.lit("")))
    rows, budget = sized.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0))).first()
    digits = next((d for d in range(3, 12) if 16**d * BUCKET_ROWS >= rows), 12)  # hex digits that name a bucket
    shuffled = stored(bucketed(shuffled, digits, BUCKET_ROWS), "shuffled")
    discard(docs.sparkSession, sized)
    targets = source_targets(shuffled, weights, max_passes)
    sent = running_total(shuffled, BUCKET, [F.col("_key"), F.col("size")], ["source"], "size", "_sent")
    targets = targets.withColumnRenamed("source", "t_source")
    timed = sent.join(targets, F.col("source").eqNullSafe(F.col("t_source"))).drop("t_source")
    passes = F.explode(F.sequence(F.lit(0), F.lit(max_passes - 1)))
    copies = timed.where("size > 0 and target > 0").select("source", "doc_id", "size", "source_size", "target", "_key", "_sent", passes.alias("pass"))
    # A source's copies end at max_passes / target of its size, 1 for a source at its cap
    # and later for the others: the mix is spent about when virtual time is 1.
    finish = (F.col("pass") * F.col("source_size") + F.col("_sent")).cast("double") / F.col("target")
    copies = copies.withColumn("_finish", finish)
    order = [F.col("_finish"), F.col("source").asc_nulls_last(), F.col("_key"), F.col("pass"), F.col("size")]
    # Whole slices before the cut are in, later ones out; only the slice of a slice that
    # the budget ends in is put in order.
    whole, left, spent = [], copies, 0
    for scale in (SLICES, SLICES**2):
        sliced = left.withColumn("_slice", F.least(F.floor(F.col("_finish") * scale), F.lit(2 * scale)))
        cut = _cut(sliced, budget, spent)
        if cut is None:
            whole.append(left)
            break
        whole.append(sliced.where(F.col("_slice") < cut["_slice"]).drop("_slice"))
        left, spent = sliced.where(F.col("_slice") == cut["_slice"]).drop("_slice"), cut["_before"]
    else:
        line = Window.partitionBy(F.lit(1)).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        whole.append(left.withColumn("_ended", F.sum("size").over(line) + F.lit(spent)).where(F.col("_ended") <= budget).drop("_ended"))
    taken = reduce(DataFrame.unionByName, whole)
    # Copies of a document are counted by its place in the shuffle, which tells rows
    # of the same doc_id apart.
    place = ("source", "_key", "_sent", "size")
    counted = taken.groupBy(*(F.col(c).alias(f"t_{c}") for c in place)).agg(F.count("*").alias("_times"))
    same = [F.col(c).eqNullSafe(F.col(f"t_{c}")) for c in place]
    words = F.col("size") * F.coalesce("_times", F.lit(0))
    return timed.join(counted, same, "left").select(*keep, "size", "source_size", "target", words.cast("long").alias("taken"))


def mixed(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_passes: int = MAX_PASSES) -> DataFrame:
    """``docs`` as mixed: a document is there as often as the mix takes it.

    The mix is made of short rows and joined to the texts once. Rows that agree in
    source, doc_id and text are interchangeable: one of them, of least hash, stands for
    all copies that the mix takes of them.
    """
    digest, pair = F.xxhash64("text").alias("_digest"), ("source", "doc_id", "_digest")
    counted = mix(docs.select("doc_id", "source", "text", digest), weights, max_passes, keep=pair)
    times = counted.groupBy(*(F.col(c).alias(f"t_{c}") for c in pair)).agg(F.sum(F.coalesce(F.col("taken") / F.nullif("size", F.lit(0)), F.lit(0))).cast("int").alias("t_copies"), F.count("*").alias("t_rows"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("source").alias("_source"), digest, F.struct(*docs.columns).alias("_row"))
    same = F.col("_id").eqNullSafe(F.col("t_doc_id")) & (F.col("_digest") == F.col("t__digest")) & F.col("_source").eqNullSafe(F.col("t_source"))
    joined = rows.join(times.where("t_copies > 0"), same)
    single = joined.where("t_rows = 1").select("_row", "t_copies")
    plain = [f"_row.`{f.name}`" for f in docs.schema if f.dataType.typeName() not in ("map", "variant")]
    repeated = joined.where("t_rows > 1").groupBy("t_source", "t_doc_id", "t__digest", "t_copies").agg(F.min_by("_row", F.xxhash64(*plain)).alias("_row"))
    every = single.unionByName(repeated.select("_row", "t_copies")).withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("t_copies"))))
    return every.select(*(F.col(f"_row.`{c}`").alias(c) for c in docs.columns))

"""Which sets lie inside which others, by an inverted index on rare elements.

A set can lie only inside sets that hold its rarest element. So each inner set is looked
up by that one element, and no two sets without a common element ever meet. Each element
has a signature, one bit of ``BITS`` for each outer set that holds it; a set that holds all
elements of an inner one has its bit in all of their signatures, so most of the others are
left out where they are looked up, before anything is dealt by pairs. The rest is checked by
counting the elements they share.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of an element's signature, in longs.
BITS = 128


def _members(sets: DataFrame, name: str, element: str, side: str) -> DataFrame:
    usable = sets.where(F.col(name).isNotNull() & F.col(element).isNotNull())
    return usable.select(F.col(name).alias(f"_{side}"), F.col(element).alias("_element")).distinct()


def _bits(column: str) -> list[Column]:
    """The bit of a set, in as many longs as a signature has."""
    h = F.xxhash64(column)
    bit = F.expr(f"shiftleft(1L, cast(pmod(xxhash64({column}), 64) as int))")
    return [F.when(F.pmod(F.shiftright(h, 6), F.lit(BITS // 64)) == i, bit).otherwise(F.lit(0).cast("long")) for i in range(BITS // 64)]


def candidates(inner: DataFrame, outer: DataFrame, least: int = 1) -> DataFrame:
    """_inner, _size, _outer: outer sets that hold the rarest element of an inner one of
    ``least`` elements, and whose bit is in the signatures of all its elements."""
    names = [f"_bits{i}" for i in range(BITS // 64)]
    often = outer.groupBy("_element").agg(F.count("*").alias("_often"), *(F.bit_or(bit).alias(n) for n, bit in zip(names, _bits("_outer"), strict=True)))
    # An element that no outer set has makes an inner set fall out here: rarest of all.
    rated = inner.join(often, "_element", "left").withColumn("_often", F.coalesce("_often", F.lit(0)))
    rarest = rated.groupBy("_inner").agg(F.count("*").alias("_size"), F.min(F.struct("_often", "_element")).alias("_rarest"), *(F.bit_and(n).alias(n) for n in names))
    probes = rarest.where((F.col("_rarest._often") > 0) & (F.col("_size") >= least)).select("_inner", "_size", F.col("_rarest._element").alias("_element"), *names)
    held = reduce(or_, (F.col(n).bitwiseAND(bit) != 0 for n, bit in zip(names, _bits("_outer"), strict=True)))
    return probes.join(outer, "_element").where(held).select("_inner", "_size", "_outer")


def contained(inner: DataFrame, outer: DataFrame, inner_set: str, outer_set: str, element: str, least: int = 1) -> DataFrame:
    """inner set, outer set, difference: every pair whose inner set lies inside the outer
    one, and how many elements the outer set has beside it; inner sets of fewer than
    ``least`` elements take no part.

    Rows are (set, element) pairs; repeated ones count once, and rows with a null in
    either are none. A set without an element does not show up, so it is in no pair.
    """
    a, b = _members(inner, inner_set, element, "inner"), _members(outer, outer_set, element, "outer")
    shared = candidates(a, b, least).join(a, "_inner").join(b, ["_outer", "_element"])
    whole = shared.groupBy("_inner", "_outer").agg(F.count("*").alias("_shared"), F.first("_size").alias("_size")).where("_shared = _size")
    sized = whole.join(b.groupBy("_outer").agg(F.count("*").alias("_outer_size")), "_outer")
    return sized.select(F.col("_inner").alias(inner_set), F.col("_outer").alias(outer_set), (F.col("_outer_size") - F.col("_size")).alias("difference"))

"""An aggregate kept as a table and refreshed from the rows that came since."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.sources.files import VersionedTable


class AggregateView:
    """Row counts and sums by ``keys``, as of the last refresh.

    A refresh reads the new rows and the view, never the rows before them: counts and sums
    of both are added. Each refresh is a version, and one that fails leaves the last one.
    Sums are of whole numbers or decimals, so that their order does not matter; nulls in a
    key are a group of their own.
    """

    def __init__(self, spark: SparkSession, root: str, keys: Sequence[str], sums: Sequence[str]) -> None:
        self.held, self.keys, self.sums = VersionedTable(spark, root), list(keys), list(sums)

    def _added(self, rows: DataFrame, n: str | None) -> DataFrame:
        count = F.count("*") if n is None else F.sum(n)
        return rows.groupBy(*self.keys).agg(count.alias("n"), *(F.sum(c).alias(c) for c in self.sums))

    def fill(self, rows: DataFrame) -> int:
        """The first version, of ``rows``; an error if there is one."""
        return self.held.create(self._added(rows, None))

    def refresh(self, fresh: DataFrame) -> int:
        """A version with ``fresh`` added, which no earlier one may hold."""
        return self.held.write(self._added(self.held.read().unionByName(self._added(fresh, None)), "n"))

    def read(self, version: int | None = None) -> DataFrame:
        return self.held.read(version)

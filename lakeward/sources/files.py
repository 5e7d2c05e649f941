"""File sources and sinks: streams of files, JSON lines, versioned tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeward.operators import relational as R


def binary_stream(spark: SparkSession, folder: str, pattern: str = r"([^/]+)/([^/]+)\.[^./]+$") -> DataFrame:
    """New files as rows: source and key from the path, SHA-256, time and bytes."""
    columns = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(columns).option("recursiveFileLookup", "true").load(folder)
    return files.select(
        F.regexp_extract("path", pattern, 1).alias("source"), F.regexp_extract("path", pattern, 2).alias("key"),
        F.sha2("content", 256).alias("sha256"), F.col("modificationTime").alias("modified"), F.col("length").alias("bytes"), "content",
    )


def json_lines(spark: SparkSession, folder: str, schema: str, stream: bool = True) -> DataFrame:
    """JSON lines with a declared schema and the file each row is from."""
    reader = (spark.readStream if stream else spark.read).schema(schema)
    return reader.json(folder).withColumn("source_file", F.col("_metadata.file_path"))


def text_csv(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """CSV with every column as text and an empty field kept as an empty text."""
    schema = ", ".join(f"`{c}` string" for c in columns)
    return spark.read.schema(schema).option("header", True).option("nullValue", "\x00").option("emptyValue", "").csv(path)


def last_per_key(rows: DataFrame, key: str, file: str = "source_file") -> DataFrame:
    """Of rows delivered again, the one from the last file in name order."""
    return R.latest(rows, [key], [F.desc(file), F.hash(*rows.columns)])


def landed(listed: DataFrame, manifest: DataFrame, key: str) -> DataFrame:
    """What is still to be fetched: listed keys that the manifest lacks."""
    return listed.join(manifest.select(key), key, "left_anti")


class LandingError(ValueError):
    """Rows that failed, none of which, nor any other, has been landed."""

    def __init__(self, failures: list[tuple[str, str]], count: int) -> None:
        self.failures, self.count = failures, count
        listed = ", ".join(f"{key}: {error}" for key, error in failures)
        super().__init__(f"{count} rows failed to land: {listed}" + (", ..." if count > len(failures) else ""))


def landed_whole(rows: DataFrame, key: str, error: str, path: str, shown: int = 100) -> DataFrame:
    """``rows`` at ``path``, all or none, each with the size of the whole landing.

    They are written beside ``path`` by all tasks; failures, rows whose ``error`` is not
    null, are written with them. Where there is one, all that was written is deleted and
    the first ``shown`` failures are raised together; else the folder is renamed, which is
    the one step that makes it be there. A run that dies leaves ``path`` as it was.
    """
    spark = rows.sparkSession
    made = f"{path.rstrip('/')}-landing-{uuid.uuid4().hex}"
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = to_path(made).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if files.exists(to_path(path)):
        raise FileExistsError(path)
    try:
        rows.withColumn("_failed", F.col(error).isNotNull()).write.partitionBy("_failed").parquet(made)
        written = spark.read.schema(rows.schema).parquet(made)
        failed = written.where(F.col(error).isNotNull())
        count = failed.count()
        if count:
            first = failed.orderBy(key).limit(shown).select(F.col(key).cast("string"), F.col(error).cast("string")).collect()
            raise LandingError([tuple(r) for r in first], count)
        good = to_path(f"{made}/_failed=false")
        if not files.exists(good):  # nothing to land
            rows.limit(0).write.parquet(path)
        elif not files.rename(good, to_path(path)):
            raise FileExistsError(path)
    finally:
        files.delete(to_path(made), True)
    return spark.read.schema(rows.schema).parquet(path).drop(error)


def quarantined(rows: DataFrame, error: str) -> tuple[DataFrame, DataFrame]:
    """Rows without an error, and those with one, which are kept and not dropped."""
    return rows.where(F.col(error).isNull()).drop(error), rows.where(F.col(error).isNotNull())


class VersionedTable:
    """A Parquet table with a column ``version``; every write adds a partition of it.

    A version is read by its number and never changed, so a table may be rewritten from
    itself; one that fails its check never gets its name.
    """

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        held = self._files.globStatus(self._path(f"{self.root}/version=*")) or []
        return sorted(int(f.getPath().getName().removeprefix("version=")) for f in held)

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/version={version or self.versions()[-1]}")

    def write(self, df: DataFrame, check: Callable[[DataFrame], None] | None = None) -> int:
        """Write a new version; ``check`` gets it as written and raises to refuse it."""
        version, made = max(self.versions(), default=0) + 1, f"{self.root}/_made-{uuid.uuid4().hex}"
        df.write.parquet(made)
        if check:
            check(self.spark.read.parquet(made))
        if not self._files.rename(self._path(made), self._path(f"{self.root}/version={version}")):
            raise ValueError(f"version {version} was written by another")
        return version

    def create(self, df: DataFrame) -> int:
        """The first version; an error if there is one."""
        if self.versions():
            raise ValueError(f"{self.root} is there already")
        return self.write(df)

    def append(self, df: DataFrame, key: str, parent: DataFrame | None = None, parent_key: str | None = None, link: str | None = None) -> int:
        """Add rows whose key is new. With a parent, every row must have one, named by
        ``link``, else by its key."""
        if parent is not None:
            lost = df.join(parent.select(F.col(parent_key).alias("_p")), F.col(link or key) == F.col("_p"), "left_anti").count()
            if lost:
                raise ValueError(f"{lost} rows have no parent")
        held = self.read() if self.versions() else None
        return self.write(df if held is None else held.unionByName(df.join(held.select(key), key, "left_anti")))

    def restore(self, version: int) -> int:
        """Make an earlier version the latest again."""
        return self.write(self.read(version))

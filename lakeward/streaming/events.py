"""Event streams: deduplicated ingest, windowed drift, a sliding rate limit."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StructField, StructType

from lakeward.operators import statistics as S


def event_stream(spark: SparkSession, folder: str, schema: StructType, delay: str = "1 hour", **options: str) -> DataFrame:
    """Parquet files as an event-time stream. Time without a zone is read as UTC."""
    stream = spark.readStream.schema(schema).options(**options).parquet(folder)
    return stream.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)


def distinct_events(stream: DataFrame, key: str) -> DataFrame:
    """Each key once, however often it is delivered within the watermark."""
    return stream.dropDuplicatesWithinWatermark([key])


def windowed(stream: DataFrame, length: str, *keys: str) -> DataFrame:
    """Counts and sums by event-time window and keys."""
    return stream.groupBy(F.window("ts", length), *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), *keys, "n", "total")


def sessions(stream: DataFrame, gap: str, key: str) -> DataFrame:
    """Runs of a key's events with no gap as long as ``gap``."""
    return stream.groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def drift_writer(baseline: DataFrame, group: str, value: str, sink: str):
    """For ``foreachBatch``: each batch against the baseline, written by batch id, so a
    batch that runs again replaces itself."""

    def write(batch: DataFrame, batch_id: int) -> None:
        rows = baseline.select(group, value, F.lit(True).alias("base")).unionByName(batch.select(group, value, F.lit(False).alias("base")))
        S.drift(rows, [group], value, "base").withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return write


class SlidingLimit(StatefulProcessor):
    """Lets a key pass at most ``most`` times in ``seconds``; others are refused."""

    def __init__(self, most: int, seconds: int) -> None:
        self.most, self.seconds = most, seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.passed = handle.getListState("passed", StructType([StructField("at", LongType())]))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timer: Any) -> Iterator[pd.DataFrame]:
        recent = [r[0] for r in self.passed.get()]
        frame = pd.concat(list(rows)).sort_values(["at", "event_id"])
        verdicts = []
        for at in frame["at"]:
            recent = [t for t in recent if t > at - self.seconds * 1_000_000]
            verdicts.append(len(recent) < self.most)
            if verdicts[-1]:
                recent.append(at)
        self.passed.put([(int(t),) for t in recent])
        yield pd.DataFrame({"key": [key[0]] * len(frame), "event_id": frame["event_id"], "passed": verdicts})

    def close(self) -> None:
        pass


def rate_limited(stream: DataFrame, key: str, most: int, seconds: int) -> DataFrame:
    """key, event_id, passed for every event, with state that holds at most ``most``
    times a key."""
    rows = stream.select(F.col(key).alias("key"), "event_id", F.unix_micros("ts").alias("at"))
    return rows.groupBy("key").transformWithStateInPandas(SlidingLimit(most, seconds), "key long, event_id long, passed boolean", "Append", "None")

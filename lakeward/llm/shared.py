"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``. Where it is unset, as in tests, a temporary folder, in
    local mode only: on a cluster executors would each write to a disk of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        held = context._jsc.sc().getCheckpointDir()
        if held.isDefined():
            return held.get().rstrip("/")
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
        folder = tempfile.mkdtemp(prefix="lakeward-")
        context.setCheckpointDir(folder)
        return context._jsc.sc().getCheckpointDir().get().rstrip("/")
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to the shared folder and read again.

    Cuts the lineage, so a lost executor costs only the tasks after this point, and
    a frame that is used twice is computed once.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *frames: DataFrame) -> None:
    """Delete tables made by ``stored`` that no later read needs."""
    jvm = spark.sparkContext._jvm
    for frame in frames:
        folders = {f.rsplit("/", 1)[0] for f in frame.inputFiles()}
        for folder in folders:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

"""Tables that a plan reads more than once, in the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """A fresh folder that driver and executors share: in ``spark.checkpoint.dir``, which
    must be set on a cluster; in local mode a temporary folder will do."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir names no folder that the executors share")
    root = root or tempfile.mkdtemp(prefix="lakeward-")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """``df`` written to a fresh folder and read again, so that what is read from it more
    than once is computed once."""
    path = folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

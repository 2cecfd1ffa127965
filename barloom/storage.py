"""Tables in the shared folder, which cut a plan's lineage and outlive lost executors."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_CHECKPOINTS = "file:///tmp/checkpoints/barloom"
#: Rows of a table that is broadcast at most; larger ones are joined by a shuffle.
BROADCAST_ROWS = 500_000


def workspace(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared checkpoint folder; it goes when the session's file systems close.

    Without ``spark.checkpoint.dir`` only a local master has a folder that all tasks see.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = LOCAL_CHECKPOINTS
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder."""
    path = workspace(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small(table: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``table``, a written one, marked for broadcast if it has at most ``rows`` rows."""
    return F.broadcast(table) if table.limit(rows + 1).count() <= rows else table


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes for the size of ``df``; no job runs."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))

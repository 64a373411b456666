"""Tables that outlive executors, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_LOCAL: dict[str, str] = {}


def scratch(spark: SparkSession, label: str) -> str:
    """A new path in the folder that driver and executors share, dropped when the application ends; a temporary one only where all is local."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        if context.applicationId not in _LOCAL:  # one folder an application
            _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="kinograph-")
        base = _LOCAL[context.applicationId]
    path = f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back, so that what follows plans from a plain table."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

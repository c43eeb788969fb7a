"""Tables that jobs write for themselves, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, made once; views over cells read it, however often they do."""
    path = f"{shared(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which all executors share; a temporary one in local sessions without it, kept in the session's settings."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.pulsegrid.shared", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="pulsegrid-")
        spark.conf.set("spark.pulsegrid.shared", base)
    return f"{base.rstrip('/')}/pulsegrid-{spark.sparkContext.applicationId}"


#: Spark's setting for it.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession):
    """Within, a query's shuffle files go when it has ended; else they stay until the driver happens to collect its garbage, those of all steps of a job beside each other."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def clear(spark: SparkSession) -> None:
    """Remove the folder of this application, once the results that read from it are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)

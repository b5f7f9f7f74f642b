"""Intermediate tables in the folder named by ``spark.checkpoint.dir``, which the driver and all executors share.

Writing a table there cuts the lineage of an iteration: a lost executor costs a re-read and not a re-computation.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables; a session on one machine without one gets a temporary folder."""
    context = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if context.master.startswith("local-cluster") or not context.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = own = tempfile.mkdtemp(prefix="tidewell-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{_LOCAL[context.applicationId]}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that is not there yet."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def until_exit(spark: SparkSession, path: str) -> None:
    """Has the files at path, which must be there, go when the session ends."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(target)


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Writes df as Parquet into the shared folder and returns a DataFrame that reads it."""
    spark = df.sparkSession
    path = fresh_path(spark, name)
    df.write.parquet(path)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)

"""Helpers that every operator of this subpackage uses: the shared folder and column expressions.

Intermediate tables go to the folder named by ``spark.checkpoint.dir``, which the driver and all
executors share, so that a lost executor costs a re-read and not a re-computation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import fresh_path, until_exit

#: The separators of words, and a run of other characters.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
BATCH_ROWS = 1000


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df as Parquet into the shared folder and returns a DataFrame that reads it.

    This cuts the lineage; the files go when the session ends.
    """
    spark = df.sparkSession
    path = fresh_path(spark, name)
    # Workers get batches of bounded rows; long texts make the usual 10 000 too large.
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, min(int(before), BATCH_ROWS) if int(before) > 0 else BATCH_ROWS)
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(key, before)
    until_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body) -> Column:
    """Binds value to a lambda variable, so that body may use it often but it is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text: runs of characters other than the six ASCII separators; null has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), f"{SPACE}+"), "")


def nonnull_text(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

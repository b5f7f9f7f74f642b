"""A versioned Parquet store: each write is a new directory, and a small file names the current one.

Readers keep the version they opened. The current version is found through Spark's own file system, so the
store may lie wherever Spark can read and write.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..operators import store

SCHEMAS: dict[str, T.StructType] = {"feeds": store.FEEDS, "articles": store.ARTICLES, "tags": store.TAGS, "article_tags": store.ARTICLE_TAGS, "article_links": store.LINKS}


class VersionedStore:
    def __init__(self, spark: SparkSession, path: str, schemas: dict[str, T.StructType] | None = None) -> None:
        self.spark, self.path, self.schemas = spark, path.rstrip("/"), schemas or SCHEMAS

    def _fs(self):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def versions(self) -> list[int]:
        """Complete versions: those whose marker was written after their tables."""
        hadoop, fs = self.spark._jvm.org.apache.hadoop.fs, self._fs()
        if not fs.exists(hadoop.Path(self.path)):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(hadoop.Path(self.path))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".done"))

    def open(self, version: int | None = None) -> dict[str, DataFrame]:
        """The tables of a version, the newest by default; empty tables where none was written."""
        known = self.versions()
        if not known:
            return {k: self.spark.createDataFrame([], s) for k, s in self.schemas.items()}
        at = known[-1] if version is None else version
        return {k: self.spark.read.schema(s).parquet(f"{self.path}/v{at}/{k}") for k, s in self.schemas.items()}

    def commit(self, state: dict[str, DataFrame]) -> int:
        """Writes all tables as the next version; readers see it once its marker exists."""
        at = (self.versions() or [0])[-1] + 1
        for k in self.schemas:
            state[k].write.mode("overwrite").parquet(f"{self.path}/v{at}/{k}")
        self._fs().create(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/v{at}.done")).close()
        return at

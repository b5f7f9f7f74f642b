"""Structured Streaming forms: a folder of responses or pages as a stream, and poll counters as streaming state."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..sources.feeds import RESPONSES, fetch_all
from ..sources.versions import VersionedStore

PAGES = "page_id long, url string, html string"


def responses_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(RESPONSES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def pages_stream(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def ingest(stream: DataFrame, store: VersionedStore, checkpoint: str, as_of: Callable[[], str], trigger: dict | None = None) -> StreamingQuery:
    """Every micro-batch of responses is one round of fetching, committed as a new version.

    A batch that is replayed after a failure finds its articles there already, so nothing is inserted twice.
    """

    def round_(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        latest = batch.groupBy("feed_id").agg(F.max_by(F.struct(*batch.columns), F.struct("status", "body")).alias("r")).select("r.*")
        state, _, _ = fetch_all(store.open(), latest, as_of())
        store.commit(state)

    return stream.writeStream.foreachBatch(round_).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def distinct_entries(entries: DataFrame, delay: str = "1 day") -> DataFrame:
    """entries(url, seen_at, ...): the first of each URL within the watermark; later ones within it are dropped."""
    return entries.withWatermark("seen_at", delay).dropDuplicatesWithinWatermark(["url"])


def poll_rate(log: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Polls and failures in each window of time and feed; rows later than ``late`` are left out."""
    windowed = log.withWatermark("ts", late).groupBy(F.window("ts", width), "feed_id")
    return windowed.agg(F.count("*").alias("polls"), F.count_if(~F.col("success")).alias("failures")).select("window.start", "window.end", "feed_id", "polls", "failures")


def failure_counters(log: DataFrame) -> DataFrame:
    """log(feed_id, ts, event_id, success) as a stream: per feed the failures in a row after its last success.

    The state is one pair (time and id of the last success, failures after it with their times), so batches may
    bring events of a feed out of order within a batch; between batches the order of arrival counts.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count = state.get[0] if state.exists else 0
        rows = pd.concat(list(frames)).sort_values(["ts", "event_id"])
        for ok in rows["success"]:
            count = 0 if ok else count + 1
        state.update((count,))
        yield pd.DataFrame({"feed_id": [key[0]], "error_count": [count]})

    return log.groupBy("feed_id").applyInPandasWithState(update, "feed_id long, error_count long", "error_count long", "update", GroupStateTimeout.NoTimeout)

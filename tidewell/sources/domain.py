"""The relational tables as views of the driver's test tables, so that every operator runs on real rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import content_hash, count_words


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def minutes_after(column: str):
    """2024-01-01 plus so many minutes, as a stored time."""
    return F.date_format(F.expr(f"timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, cast({column} as int), 0)"), "yyyy-MM-dd HH:mm:ss")


def articles(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents").select("doc_id", "text", "source")
    stamp = minutes_after("doc_id")
    return d.select(
        F.col("doc_id").alias("id"),
        F.substring("source", 4, 10).cast("long").alias("feed_id"),
        F.concat(F.lit("g"), F.col("doc_id")).alias("guid"),
        F.concat(F.lit("https://feed/"), F.col("source"), F.lit("/"), F.col("doc_id")).alias("url"),
        F.substring(F.substring_index("text", "\n", 1), 1, 80).alias("title"),
        F.lit(None).cast("string").alias("author"),
        stamp.alias("published_at"),
        F.lit(None).cast("string").alias("summary"),
        F.col("text").alias("content"),
        content_hash(F.col("text")).alias("content_hash"),
        count_words(F.col("text")).alias("word_count"),
        F.when(F.col("doc_id") % 3 != 0, 1).otherwise(0).alias("content_extracted"),
        F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0).alias("embedding_generated"),
        F.lit(0).alias("tags_generated"),
        stamp.alias("created_at"),
        stamp.alias("updated_at"),
    )


def feeds(spark: SparkSession, folder: str) -> DataFrame:
    names = table(spark, folder, "documents").select("source").distinct()
    number = F.substring("source", 4, 10).cast("long")
    return names.select(
        number.alias("id"), F.concat(F.lit("https://feed/"), F.col("source")).alias("url"), F.concat(F.lit("Feed "), F.col("source")).alias("title"), F.lit(30).cast("long").alias("poll_interval_minutes"), F.when(number % 4 != 3, 1).otherwise(0).alias("active")
    )


def tags(spark: SparkSession, folder: str) -> DataFrame:
    """Languages as tags 1.. by name, then quality (101) and toxic (102)."""
    from pyspark.sql import Window

    langs = table(spark, folder, "documents").select(F.col("lang").alias("name")).distinct()
    numbered = langs.select(F.row_number().over(Window.orderBy("name")).cast("long").alias("id"), "name")  # a row for each language
    return numbered.unionByName(spark.createDataFrame([(101, "quality"), (102, "toxic")], "id long, name string"))


def article_tags(spark: SparkSession, folder: str) -> DataFrame:
    t = tags(spark, folder)
    own = table(spark, folder, "documents").select(F.col("doc_id").alias("article_id"), F.col("lang").alias("name"))
    lang = own.join(t, "name").select("article_id", F.col("id").alias("tag_id"), F.lit(1.0).alias("confidence"))
    labels = table(spark, folder, "labels")
    marked = lambda c, n, v: labels.filter(F.col(c) == 1).select(F.col("doc_id").alias("article_id"), F.lit(n).cast("long").alias("tag_id"), F.lit(v).alias("confidence"))
    return lang.unionByName(marked("quality", 101, 0.9)).unionByName(marked("toxic", 102, 0.8))


def article_links(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id to (7 doc_id + 3) mod the number of documents."""
    d = table(spark, folder, "documents").select("doc_id")
    total = d.count()
    return d.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("source_article_id"), ((F.col("doc_id") * 7 + 3) % total).alias("target_article_id"), F.lit("related").alias("relationship"), F.lit(1.0).alias("strength"))


def poll_log(spark: SparkSession, folder: str) -> DataFrame:
    """Events as polls: the user is the feed, an error a failure."""
    return table(spark, folder, "events").select(F.col("user_id").alias("feed_id"), "ts", "event_id", (F.col("event_type") != "error").alias("success"))

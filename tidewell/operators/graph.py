"""Bounded breadth-first traversal of the link graph, one join a hop, and components of links in a time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import materialize

MAX_NODES = 10_000


def both_ways(links: DataFrame) -> DataFrame:
    """Edges (a, b) in both directions; a self-link once."""
    s, t = F.col("source_article_id"), F.col("target_article_id")
    back = links.filter(s != t).select(t.alias("a"), s.alias("b"))
    return links.select(s.alias("a"), t.alias("b")).unionByName(back)


def link_graph(links: DataFrame, start: int, depth: int, max_nodes: int = MAX_NODES, checkpoint=materialize) -> DataFrame:
    """article_id, level and linked_article_ids of what is reached in ``depth`` hops, nearest first.

    The start is there even without links; nodes at the last level are listed with their neighbours but not
    expanded; a neighbour linked twice is listed twice. Only the frontier is joined, never a path.
    """
    edges = both_ways(links)
    spark = links.sparkSession
    visited = frontier = spark.createDataFrame([(start, 0)], "article_id long, level int")
    for hop in range(1, depth + 1):
        reached = edges.join(frontier.select(F.col("article_id").alias("a")), "a").select(F.col("b").alias("article_id")).distinct()
        frontier = checkpoint(reached.join(visited.select("article_id"), "article_id", "left_anti").withColumn("level", F.lit(hop)))
        visited = visited.unionByName(frontier)
        if frontier.isEmpty():
            break
    nodes = visited.orderBy("level", "article_id").limit(max_nodes)
    near = edges.join(nodes.select(F.col("article_id").alias("a")), "a").groupBy(F.col("a").alias("article_id")).agg(F.sort_array(F.collect_list("b")).alias("linked_article_ids"))
    listed = nodes.join(near, "article_id", "left")
    return listed.select("article_id", "level", F.coalesce("linked_article_ids", F.array().cast("array<bigint>")).alias("linked_article_ids")).orderBy("level", "article_id")


def components(edges: DataFrame, checkpoint=materialize, rounds: int = 60) -> DataFrame:
    """node and component (the smallest node reachable) for the nodes of edges(a, b), which lie in both directions.

    Each round takes the least label of neighbours' labels to a node and to the node that it is labelled with
    (hooking), and labels to their own labels (jumping), so rounds grow as the logarithm of the longest path.
    """
    edges = checkpoint(edges)
    labels, before = checkpoint(edges.select(F.col("a").alias("node")).distinct().withColumn("component", F.col("node"))), None
    for _ in range(rounds):
        jump = labels.select(F.col("node").alias("component"), F.col("component").alias("next"))
        jumped = labels.join(jump, "component")
        near = edges.join(jumped.select(F.col("node").alias("b"), "next"), "b").groupBy(F.col("a").alias("node")).agg(F.min("next").alias("m"))
        told = jumped.join(near, "node").select(F.explode(F.array(F.struct(F.col("node"), F.least("next", "m").alias("to")), F.struct(F.col("component").alias("node"), F.col("m").alias("to")))).alias("x"))
        labels = checkpoint(told.groupBy("x.node").agg(F.min("x.to").alias("component")))
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return labels
        before = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")


def event_clusters(articles: DataFrame, links: DataFrame, window_seconds: int, rounds: int = 60, checkpoint=materialize) -> DataFrame:
    """article_id and cluster (the smallest id): components over links whose articles are close in time.

    articles(id, published_ts); an article without such a link is a cluster of its own.
    """
    ts = articles.select("id", F.unix_timestamp("published_ts").alias("t"))
    edge = both_ways(links).join(ts.select(F.col("id").alias("a"), F.col("t").alias("ta")), "a").join(ts.select(F.col("id").alias("b"), F.col("t").alias("tb")), "b")
    found = components(edge.filter(F.abs(F.col("ta") - F.col("tb")) <= window_seconds).select("a", "b").distinct(), checkpoint, rounds)
    labelled = articles.select("id").join(found.withColumnRenamed("node", "id"), "id", "left")
    return labelled.select(F.col("id").alias("article_id"), F.coalesce("component", "id").alias("cluster"))


def co_occurrence(pairs: DataFrame, at_least: int = 1) -> DataFrame:
    """pairs(article_id, entity): unordered entity pairs with the number of articles that hold both."""
    own = pairs.distinct()
    left, right = own.select("article_id", F.col("entity").alias("a")), own.select("article_id", F.col("entity").alias("b"))
    joined = left.join(right, "article_id").filter("a < b")
    return joined.groupBy("a", "b").agg(F.count("*").alias("articles")).filter(F.col("articles") >= at_least)


def causal_chains(clusters: DataFrame, articles: DataFrame) -> DataFrame:
    """Within each cluster an article's predecessor in time: cluster, article_id, follows (null for the first)."""
    joined = clusters.join(articles.select(F.col("id").alias("article_id"), "published_ts"), "article_id")
    order = Window.partitionBy("cluster").orderBy("published_ts", "article_id")
    return joined.select("cluster", "article_id", F.lag("article_id").over(order).alias("follows"))

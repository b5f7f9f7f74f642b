"""The relational store: schemas, read operators and state transitions.

A table is a DataFrame; a transition is a function from the state and a delta to the new state. Uniqueness,
foreign keys and cascades are joins. Single-row interfaces raise, bulk ones are plain transforms. What a
transition returns is lazy, so a chain of them is one plan; ``tidewell.sources.versions`` writes the result.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import DuplicateEntry, ForeignKeyError, NotFound
from ..functions.text import count_words
from ..lineage import materialize
from .graph import components

_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


FEEDS = _schema(id=_L, url=_S, title=_S, description=_S, site_url=_S, poll_interval_minutes=_L, last_polled_at=_S, last_error=_S, error_count=_L, active=_I, etag=_S, last_modified=_S, created_at=_S, updated_at=_S)
ARTICLES = _schema(
    id=_L, feed_id=_L, guid=_S, url=_S, title=_S, author=_S, published_at=_S, summary=_S, content=_S, content_hash=_S, word_count=_L, content_extracted=_I, embedding_generated=_I, tags_generated=_I, created_at=_S, updated_at=_S
)
TAGS = _schema(id=_L, name=_S, created_at=_S)
ARTICLE_TAGS = _schema(article_id=_L, tag_id=_L, confidence=_D, created_at=_S)
LINKS = _schema(id=_L, source_article_id=_L, target_article_id=_L, relationship=_S, strength=_D, created_at=_S)
DEFAULTS = {
    "feeds": {"poll_interval_minutes": 30, "error_count": 0, "active": 1},
    "articles": {"content_extracted": 0, "embedding_generated": 0, "tags_generated": 0},
    "article_tags": {"confidence": 1.0},
    "article_links": {"relationship": "related", "strength": 1.0},
}


def shaped(delta: DataFrame, schema: T.StructType, table: str, as_of: str) -> DataFrame:
    """A delta with all columns of the schema: missing ones are null, defaults and time stamps filled in."""
    defaults = DEFAULTS.get(table, {}) | {"created_at": as_of, "updated_at": as_of}
    have = set(delta.columns)

    def column(f: T.StructField) -> Column:
        c = F.col(f.name).cast(f.dataType) if f.name in have else F.lit(None).cast(f.dataType)
        return (F.coalesce(c, F.lit(defaults[f.name]).cast(f.dataType)) if f.name in defaults else c).alias(f.name)

    return delta.select(*[column(f) for f in schema.fields])


def high_water(state: DataFrame) -> DataFrame:
    """One row: the largest id (0 for an empty table)."""
    return state.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))


def with_ids(state: DataFrame, delta: DataFrame, *order: str) -> DataFrame:
    """New ids after the largest of the state, in the given order: counted per range and summed, not in one task.

    The numbered ranges are written once, so a task that runs again can't number its rows otherwise.
    """
    parts = delta.drop("id").repartitionByRange(*[F.col(c) for c in order]).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_n", F.monotonically_increasing_id())
    parts = materialize(parts, "numbered")
    sizes = parts.groupBy("_p").agg(F.count("*").alias("_size"), F.min("_n").alias("_first"))
    before = sizes.withColumn("_before", F.sum("_size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))).drop("_size")  # a row for each partition
    top = state.agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
    numbered = parts.join(F.broadcast(before), "_p")
    return numbered.withColumn("id", F.lit(top) + F.coalesce("_before", F.lit(0)) + F.col("_n") - F.col("_first") + 1).drop("_p", "_n", "_first", "_before")


def must_have(rows: DataFrame, what: str) -> DataFrame:
    if rows.isEmpty():
        raise NotFound(what)
    return rows


# ------------------------------------------------------------------ reads


def list_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.orderBy("id")


def list_active_feeds(feeds: DataFrame) -> DataFrame:
    return feeds.filter("active = 1").orderBy("id")


def get_by_id(table: DataFrame, key: int) -> DataFrame:
    """The row with that id; raises NotFound without one."""
    return must_have(table.filter(F.col("id") == key), f"id {key}")


def due_feeds(feeds: DataFrame, as_of: str) -> DataFrame:
    """Active feeds never polled, or not since their interval began."""
    last = F.try_to_timestamp("last_polled_at", F.lit("yyyy-MM-dd HH:mm:ss"))
    since = F.unix_timestamp(F.to_timestamp(F.lit(as_of), "yyyy-MM-dd HH:mm:ss")) - F.unix_timestamp(last)
    return feeds.filter((F.col("active") == 1) & (last.isNull() | (since >= F.col("poll_interval_minutes") * 60))).orderBy("id")


def articles_by_feed(articles: DataFrame, feed_id: int) -> DataFrame:
    return articles.filter(F.col("feed_id") == feed_id).orderBy(F.col("published_at").desc(), "id")


def article_exists(articles: DataFrame, url: str) -> bool:
    return not articles.filter(F.col("url") == url).limit(1).isEmpty()


def existing_urls(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    return candidates.join(articles.select("url"), "url", "left_semi")


def unknown_urls(candidates: DataFrame, articles: DataFrame) -> DataFrame:
    return candidates.join(articles.select("url"), "url", "left_anti")


def count_by_url(articles: DataFrame, url: str) -> DataFrame:
    return articles.filter(F.col("url") == url).agg(F.count("*").alias("n"))


def articles_in_date_range(articles: DataFrame, start: str, end: str) -> DataFrame:
    """Both ends inclusive; times are compared as strings, so ``2025-01-01T10`` is after ``2025-01-01``."""
    p = F.col("published_at")
    return articles.filter((p >= start) & (p <= end)).orderBy(p.desc(), "id")


def articles_in_time_range(articles: DataFrame, start: Column, end: Column, parse) -> DataFrame:
    """The typed variant: times are parsed, and rows without a time left out."""
    ts = parse(F.col("published_at"))
    return articles.filter((ts >= start) & (ts <= end)).orderBy(ts.desc(), "id")


def recent_articles(articles: DataFrame, limit: int) -> DataFrame:
    """Newest by creation; a negative limit is none."""
    ordered = articles.orderBy(F.col("created_at").desc(), F.col("id").desc())
    return ordered if limit < 0 else ordered.limit(limit)


def links_from(links: DataFrame, article_id: int) -> DataFrame:
    return links.filter(F.col("source_article_id") == article_id)


def links_touching(links: DataFrame, article_id: int) -> DataFrame:
    """Links in either direction; a self-link once."""
    return links.filter((F.col("source_article_id") == article_id) | (F.col("target_article_id") == article_id))


def pending_extraction(articles: DataFrame) -> DataFrame:
    return articles.filter("content_extracted = 0").select("id", "url").orderBy("id")


def pending_embedding(articles: DataFrame, limit: int = 1000) -> DataFrame:
    return articles.filter("content_extracted = 1 AND embedding_generated = 0").select("id", "title", "content").orderBy("id").limit(limit)


def extracted_articles(articles: DataFrame) -> DataFrame:
    return articles.filter("content_extracted = 1").orderBy("id")


# ------------------------------------------------------------------ feeds


def add_feed(feeds: DataFrame, url: str, title: str | None, as_of: str) -> DataFrame:
    if not feeds.filter(F.col("url") == url).isEmpty():
        raise DuplicateEntry(url)
    delta = feeds.sparkSession.createDataFrame([(url, title)], "url string, title string")
    return feeds.unionByName(with_ids(feeds, shaped(delta, FEEDS, "feeds", as_of), "url").select(*FEEDS.names))


def update_feed(feeds: DataFrame, delta: DataFrame, as_of: str) -> DataFrame:
    """delta(id, title, description, site_url, poll_interval_minutes): a null keeps the old value."""
    names = ["title", "description", "site_url", "poll_interval_minutes"]
    if not delta.join(feeds, "id", "left_anti").isEmpty():
        raise NotFound("feed")
    new = delta.select("id", *[F.col(n).alias(f"_{n}") for n in names if n in delta.columns], F.lit(1).alias("_hit"))
    joined = feeds.join(new, "id", "left")
    swap = {n: F.coalesce(f"_{n}", n) for n in names if n in delta.columns} | {"updated_at": F.when(F.col("_hit") == 1, F.lit(as_of)).otherwise(F.col("updated_at"))}
    return joined.select(*[swap.get(c, F.col(c)).alias(c) for c in feeds.columns])


def update_poll_status(feeds: DataFrame, outcomes: DataFrame, as_of: str) -> DataFrame:
    """outcomes(id, success, message), one row for each feed; unknown ids do nothing."""
    joined = feeds.join(outcomes.select("id", F.col("success").alias("_ok"), F.col("message").alias("_message")), "id", "left")
    ok, failed = F.col("_ok") == F.lit(True), F.col("_ok") == F.lit(False)
    swap = {
        "last_polled_at": F.when(ok, F.lit(as_of)).otherwise(F.col("last_polled_at")),
        "last_error": F.when(ok, F.lit(None)).when(failed, F.col("_message")).otherwise(F.col("last_error")),
        "error_count": F.when(ok, F.lit(0)).when(failed, F.col("error_count") + 1).otherwise(F.col("error_count")).cast("long"),
    }
    return joined.select(*[swap.get(c, F.col(c)).alias(c) for c in feeds.columns])


def consecutive_failures(log: DataFrame) -> DataFrame:
    """log(feed_id, ts, event_id, success): per feed the failures after its last success, with the time of that success.

    Two aggregates over the feed, pre-aggregated before the shuffle: a feed with very many events is no hot spot.
    """
    at = F.struct("ts", "event_id")
    last = log.groupBy("feed_id").agg(F.max(F.when(F.col("success"), at)).alias("last"))
    failed = log.filter(~F.col("success")).join(last, "feed_id")
    after = failed.filter(F.col("last").isNull() | (at > F.col("last"))).groupBy("feed_id").agg(F.count("*").alias("error_count"))
    return last.join(after, "feed_id", "left").select("feed_id", F.coalesce("error_count", F.lit(0)).alias("error_count"), F.col("last.ts").alias("last_polled_at"))


def update_http_cache(feeds: DataFrame, delta: DataFrame) -> DataFrame:
    """delta(id, etag, last_modified) overwrites, nulls too."""
    joined = feeds.join(delta.select("id", F.col("etag").alias("_e"), F.col("last_modified").alias("_m"), F.lit(1).alias("_hit")), "id", "left")
    swap = {c: F.when(F.col("_hit") == 1, F.col(n)).otherwise(F.col(c)) for c, n in (("etag", "_e"), ("last_modified", "_m"))}
    return joined.select(*[swap.get(c, F.col(c)).alias(c) for c in feeds.columns])


def update_feed_url(feeds: DataFrame, delta: DataFrame) -> DataFrame:
    """delta(id, url); raises DuplicateEntry when two feeds would have one URL."""
    joined = feeds.join(delta.select("id", F.col("url").alias("_url")), "id", "left")
    out = joined.select(*[(F.coalesce("_url", "url") if c == "url" else F.col(c)).alias(c) for c in feeds.columns])
    if not out.groupBy("url").count().filter("count > 1").isEmpty():
        raise DuplicateEntry("url")
    return out


def remove_feeds(state: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """The tables without the feeds in gone(id) and all that hangs on them; tags stay."""
    articles = state["articles"].join(gone.select(F.col("id").alias("feed_id")), "feed_id", "left_anti").select(*state["articles"].columns)
    lost = state["articles"].join(gone.select(F.col("id").alias("feed_id")), "feed_id", "left_semi").select("id")
    drop = lambda t, c: t.join(lost.withColumnRenamed("id", c), c, "left_anti").select(*t.columns)
    return state | {
        "feeds": state["feeds"].join(gone.select("id"), "id", "left_anti"),
        "articles": articles,
        "article_tags": drop(state["article_tags"], "article_id"),
        "article_links": drop(drop(state["article_links"], "source_article_id"), "target_article_id"),
    }


def remove_feed(state: dict[str, DataFrame], feed_id: int) -> dict[str, DataFrame]:
    get_by_id(state["feeds"], feed_id)
    return remove_feeds(state, state["feeds"].sparkSession.createDataFrame([(feed_id,)], "id long"))


# ------------------------------------------------------------------ articles


def first_of_keys(rows: DataFrame, order: list[str], keys: list[list[str]], checkpoint=materialize, rounds: int = 3) -> DataFrame:
    """The rows that inserting one after another would keep: a row is kept if no kept row before it shares a key.

    A key with a null part is no key. Rows first in all their groups are kept, what clashes with them is dropped,
    and this repeats on the rest: the result is that of the sequence. What is left after ``rounds`` rounds are chains
    of rows that clash by one key and another; each chain is gone through in order. ``checkpoint`` cuts the lineage.
    """
    whole = [reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in key]) for key in keys]
    left, kept = checkpoint(rows.withColumn("_o", F.struct(*order))), None
    for _ in range(rounds):
        if left.isEmpty():
            break
        marked = left
        for n, key in enumerate(keys):
            firsts = left.filter(whole[n]).groupBy(*key).agg(F.min("_o").alias(f"_f{n}"))
            marked = marked.join(firsts, key, "left")
        first = reduce(lambda a, b: a & b, [~w | (F.col("_o") == F.col(f"_f{n}")) for n, w in enumerate(whole)])
        now = checkpoint(marked.filter(first).select(*left.columns))
        kept = now if kept is None else kept.unionByName(now)
        rest = left.join(now.select("_o"), "_o", "left_anti")
        for key in keys:
            rest = rest.join(now.select(*key), key, "left_anti")
        left = checkpoint(rest.select(*left.columns))
    if not left.isEmpty():
        left = _chains_in_order(left, keys, whole, checkpoint)
    out = left if kept is None else kept.unionByName(left)
    return out.drop("_o").select(*rows.columns)


def _chains_in_order(rows: DataFrame, keys: list[list[str]], whole: list[Column], checkpoint) -> DataFrame:
    """first_of_keys of chains: rows joined by keys are one group, and a group is gone through by ``_o``."""
    texts = [F.when(w, F.to_json(F.struct(*key))).alias(f"_k{n}") for n, (w, key) in enumerate(zip(whole, keys, strict=True))]
    named = checkpoint(rows.withColumn("_id", F.monotonically_increasing_id()).select("*", *texts))
    each = named.select("_id", F.explode(F.array(*[F.struct(F.lit(n).alias("n"), F.col(f"_k{n}").alias("k")) for n in range(len(keys))])).alias("x")).filter("x.k IS NOT NULL").select("_id", "x")
    links = each.join(each.groupBy("x").agg(F.min("_id").alias("b")), "x").select(F.col("_id").alias("a"), "b").filter("a <> b")
    chains = components(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), checkpoint=checkpoint)
    numbered = named.join(chains.select(F.col("node").alias("_id"), "component"), "_id", "left").withColumn("_c", F.coalesce("component", "_id"))
    numbered = numbered.select("_c", "_id", F.row_number().over(Window.partitionBy("_c").orderBy("_o")).alias("_n"), *[f"_k{n}" for n in range(len(keys))])

    def run(chain: pd.DataFrame) -> pd.DataFrame:
        taken, out = set(), []
        for row in chain.sort_values("_n").itertuples(index=False):
            own = [(n, k) for n, k in enumerate(row[3:]) if k is not None]
            if taken.isdisjoint(own):
                taken.update(own)
                out.append(row[1])
        return pd.DataFrame({"_id": pd.Series(out, dtype="int64")})

    kept = numbered.groupBy("_c").applyInPandas(run, "_id long")
    return checkpoint(named.join(kept, "_id", "left_semi").select(*rows.columns))


ARTICLE_KEYS = [["url"], ["feed_id", "guid"]]


def insert_articles(articles: DataFrame, delta: DataFrame, as_of: str, order: str = "ordinal", checkpoint=materialize) -> DataFrame:
    """Appends the rows of delta(ordinal, feed_id, guid, url, title, ...) that clash with nothing; the rest is ignored."""
    fresh = delta
    for key in ARTICLE_KEYS:
        fresh = fresh.join(articles.select(*key), key, "left_anti")
    kept = first_of_keys(fresh.select(*delta.columns), [order], ARTICLE_KEYS, checkpoint)
    numbered = with_ids(articles, kept.withColumnRenamed(order, "_ordinal"), "_ordinal")
    return articles.unionByName(shaped(numbered, ARTICLES, "articles", as_of))


def insert_article(state: dict[str, DataFrame], delta: DataFrame, as_of: str) -> DataFrame:
    """The articles with the one row of delta; raises on a taken key or a missing feed."""
    if not delta.join(state["feeds"].select(F.col("id").alias("feed_id")), "feed_id", "left_anti").isEmpty():
        raise ForeignKeyError("feed_id")
    for key in ARTICLE_KEYS:
        if not delta.join(state["articles"].select(*key), key, "left_semi").isEmpty():
            raise DuplicateEntry(", ".join(key))
    return insert_articles(state["articles"], delta.withColumn("ordinal", F.lit(0)), as_of)


def update_content(articles: DataFrame, delta: DataFrame, as_of: str, strict: bool = True) -> DataFrame:
    """delta(id, content, content_hash, title?, author?, published_at?): metadata keeps old values where null."""
    if strict and not delta.join(articles, "id", "left_anti").isEmpty():
        raise NotFound("article")
    optional = [c for c in ("title", "author", "published_at") if c in delta.columns]
    new = delta.select("id", F.col("content").alias("_content"), F.col("content_hash").alias("_hash"), *[F.col(c).alias(f"_{c}") for c in optional], F.lit(1).alias("_hit"))
    joined, hit = articles.join(new, "id", "left"), F.col("_hit") == 1
    swap = {c: F.coalesce(f"_{c}", c) for c in optional} | {
        "content": F.when(hit, F.col("_content")).otherwise(F.col("content")),
        "content_hash": F.when(hit, F.col("_hash")).otherwise(F.col("content_hash")),
        "word_count": F.when(hit, count_words(F.col("_content"))).otherwise(F.col("word_count")),
        "content_extracted": F.when(hit, F.lit(1)).otherwise(F.col("content_extracted")),
        "updated_at": F.when(hit, F.lit(as_of)).otherwise(F.col("updated_at")),
    }
    return joined.select(*[swap.get(c, F.col(c)).alias(c) for c in articles.columns])


def mark(articles: DataFrame, ids: DataFrame, flag: str, strict: bool = True) -> DataFrame:
    """Sets embedding_generated or tags_generated for ids(id)."""
    if strict and not ids.join(articles, "id", "left_anti").isEmpty():
        raise NotFound("article")
    joined = articles.join(ids.select("id").distinct().withColumn("_hit", F.lit(1)), "id", "left")
    return joined.select(*[(F.when(F.col("_hit") == 1, F.lit(1)).otherwise(F.col(c)) if c == flag else F.col(c)).alias(c) for c in articles.columns])


# ------------------------------------------------------------------ tags and links


def get_or_create_tags(tags: DataFrame, names: DataFrame, as_of: str) -> DataFrame:
    """The tags with those of names(name), in lower case, that are new."""
    new = names.select(F.lower("name").alias("name")).distinct().join(tags.select("name"), "name", "left_anti")
    return tags.unionByName(with_ids(tags, shaped(new, TAGS, "tags", as_of), "name").select(*TAGS.names))


def add_tags(state: dict[str, DataFrame], delta: DataFrame, as_of: str) -> dict[str, DataFrame]:
    """delta(article_id, pos, name, confidence): the first confidence of a pair wins, also over later calls."""
    tags = get_or_create_tags(state["tags"], delta, as_of)
    first = delta.withColumn("name", F.lower("name")).groupBy("article_id", "name").agg(F.min_by("confidence", "pos").alias("confidence"))
    pairs = first.join(tags.select("name", F.col("id").alias("tag_id")), "name")
    new = pairs.join(state["article_tags"].select("article_id", "tag_id"), ["article_id", "tag_id"], "left_anti")
    return state | {"tags": tags, "article_tags": state["article_tags"].unionByName(shaped(new, ARTICLE_TAGS, "article_tags", as_of))}


def tag_counts(tags: DataFrame, article_tags: DataFrame) -> DataFrame:
    """Tags with article_count, which is derived and never stored."""
    counts = article_tags.groupBy(F.col("tag_id").alias("id")).agg(F.count("*").alias("article_count"))
    return tags.join(counts, "id", "left").withColumn("article_count", F.coalesce("article_count", F.lit(0)))


def list_all_tags(tags: DataFrame, article_tags: DataFrame) -> DataFrame:
    return tag_counts(tags, article_tags).orderBy(F.col("article_count").desc(), "name")


def top_tags(tags: DataFrame, article_tags: DataFrame, limit: int) -> DataFrame:
    return list_all_tags(tags, article_tags).limit(limit)


def tags_for_article(tags: DataFrame, article_tags: DataFrame, article_id: int) -> DataFrame:
    own = article_tags.filter(F.col("article_id") == article_id).select(F.col("tag_id").alias("id"), "confidence")
    return own.join(tags, "id").orderBy(F.col("confidence").desc(), "name")


def articles_by_tag(tags: DataFrame, article_tags: DataFrame, name: str) -> DataFrame:
    named = tags.filter(F.col("name") == name.lower()).select(F.col("id").alias("tag_id"))
    return article_tags.join(named, "tag_id").select("article_id")


def tag_lists(tags: DataFrame, article_tags: DataFrame) -> DataFrame:
    """Per article its tag names, sorted, and joined by spaces."""
    named = article_tags.join(tags.select(F.col("id").alias("tag_id"), "name"), "tag_id")
    return named.groupBy("article_id").agg(F.array_join(F.sort_array(F.collect_list("name")), " ").alias("tag_text"))


def add_links(state: dict[str, DataFrame], delta: DataFrame, as_of: str) -> DataFrame:
    """The links with those of delta(source_article_id, target_article_id, relationship?, strength?); raises on clashes."""
    pair = ["source_article_id", "target_article_id"]
    ids = state["articles"].select("id")
    for c in pair:
        if not delta.join(ids.withColumnRenamed("id", c), c, "left_anti").isEmpty():
            raise ForeignKeyError(c)
    if not delta.join(state["article_links"].select(*pair), pair, "left_semi").isEmpty() or not delta.groupBy(*pair).count().filter("count > 1").isEmpty():
        raise DuplicateEntry("link")
    new = with_ids(state["article_links"], shaped(delta, LINKS, "article_links", as_of), *pair)
    return state["article_links"].unionByName(new.select(*LINKS.names))

"""Feeds as tables: fetch outcomes, RSS 2.0 and Atom entries, and what a round of fetching changes.

A table of responses stands for HTTP: feed_id, request_url, final_url, status, headers (lower-case keys), body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_page_date, rfc3339
from ..functions.text import header, strip_html_tags
from ..lineage import materialize
from ..operators import store

RESPONSES = "feed_id long, request_url string, final_url string, status int, headers map<string,string>, body string"
RETRY_AFTER, WARN_FAILURES = 60, 10
_RSS = "channel struct<title:string,description:string,link:array<struct<_VALUE:string,_href:string,_rel:string>>,item:array<struct<title:string,link:string,guid:string,author:string,creator:string,pubDate:string,description:string>>>"
_ATOM = "title string, subtitle string, link array<struct<_href:string,_rel:string>>, entry array<struct<id:string,title:string,link:array<struct<_href:string,_rel:string>>,author:array<struct<name:string>>,published:string,updated:string,summary:string>>"
_XML = {"mode": "PERMISSIVE", "ignoreNamespace": "true", "attributePrefix": "_", "valueTag": "_VALUE"}


def outcomes(responses: DataFrame) -> DataFrame:
    """Adds outcome (not_modified, rate_limited, http_error, ok), retry_after, new_url and the cache headers.

    Any other final URL counts as a move, whatever the status; cache headers are kept before the body is parsed.
    """
    s, h = F.col("status"), F.col("headers")
    outcome = F.when(s == 304, "not_modified").when(s.isin(429, 503), "rate_limited").when(~s.between(200, 299), "http_error").otherwise("ok")
    moved = ~outcome.isin("not_modified", "rate_limited") & F.col("final_url").isNotNull() & (F.col("final_url") != F.col("request_url"))
    return responses.withColumns(
        {
            "outcome": outcome,
            "retry_after": F.when(outcome == "rate_limited", F.coalesce(header(h, "retry-after").try_cast("int"), F.lit(RETRY_AFTER))),
            "new_url": F.when(moved, F.col("final_url")),
            "etag": F.when(outcome == "ok", header(h, "etag")),
            "last_modified": F.when(outcome == "ok", header(h, "last-modified")),
        }
    )


def parse_feeds(responses: DataFrame) -> DataFrame:
    """Adds ``parsed``: struct<title,description,site_url,entries>, null where the body is neither RSS nor Atom."""
    is_rss, is_atom = F.col("body").rlike(r"(?s)<(rss|rdf:RDF)[\s>]"), F.col("body").rlike(r"(?s)<feed[\s>]")
    both = responses.withColumn("_rss", F.when(is_rss, F.from_xml("body", _RSS, _XML))).withColumn("_atom", F.when(is_atom & ~is_rss, F.from_xml("body", _ATOM, _XML)))
    nonempty = lambda c: F.when(F.trim(c) != "", F.trim(c))
    site = lambda links, value: F.get(F.filter(F.transform(F.filter(links, lambda x: ~x["_rel"].eqNullSafe("self")), value), lambda x: x.isNotNull()), F.lit(0))
    rss_entry = lambda e: F.struct(
        e["title"].alias("title"), nonempty(e["link"]).alias("link"), nonempty(e["guid"]).alias("id"), F.coalesce(e["author"], e["creator"]).alias("author"), e["pubDate"].alias("published"), F.lit(None).cast("string").alias("updated"), e["description"].alias("summary")
    )
    atom_entry = lambda e: F.struct(
        e["title"].alias("title"), F.get(e["link"], F.lit(0))["_href"].alias("link"), nonempty(e["id"]).alias("id"), F.get(e["author"], F.lit(0))["name"].alias("author"), e["published"].alias("published"), e["updated"].alias("updated"), e["summary"].alias("summary")
    )
    entries = lambda c, f: F.coalesce(F.transform(c, f), F.array().cast("array<struct<title:string,link:string,id:string,author:string,published:string,updated:string,summary:string>>"))
    r, a = F.col("_rss.channel"), F.col("_atom")
    rss = F.struct(r["title"].alias("title"), r["description"].alias("description"), site(r["link"], lambda x: F.coalesce(nonempty(x["_VALUE"]), x["_href"])).alias("site_url"), entries(r["item"], rss_entry).alias("entries"))
    atom = F.struct(a["title"].alias("title"), a["subtitle"].alias("description"), site(a["link"], lambda x: x["_href"]).alias("site_url"), entries(a["entry"], atom_entry).alias("entries"))
    parsed = F.when(F.col("_rss.channel").isNotNull(), rss).when(F.col("_atom").isNotNull(), atom)
    return both.withColumn("parsed", parsed).drop("_rss", "_atom")


def entry_articles(parsed: DataFrame) -> DataFrame:
    """One article row per entry: ordinal, feed_id, guid, url, title, author, published_at, summary; content is null."""
    rows = parsed.filter("parsed IS NOT NULL").select("feed_id", F.posexplode("parsed.entries").alias("pos", "e"))
    guid: Column = F.coalesce("e.id", F.when(F.col("e.link").isNotNull(), F.sha2("e.link", 256)))
    when = parse_page_date(F.coalesce("e.published", "e.updated"))
    made = rows.select(
        F.struct("feed_id", "pos").alias("ordinal"),
        "feed_id",
        guid.alias("guid"),
        F.coalesce("e.link", "e.id").alias("url"),
        F.coalesce("e.title", F.lit("(untitled)")).alias("title"),
        "e.author",
        rfc3339(when).alias("published_at"),
        F.trim(strip_html_tags(F.col("e.summary"))).alias("summary"),
        F.lit(None).cast("string").alias("content"),
    )
    return made.filter("url IS NOT NULL")


def fetch_all(state: dict[str, DataFrame], responses: DataFrame, as_of: str, checkpoint=materialize) -> tuple[dict[str, DataFrame], DataFrame, DataFrame]:
    """One round over the active feeds: the new state, a one-row summary, and the errors (feed_id, kind, message).

    A move to a URL that another feed has, or that one of a smaller id moves to, fails that feed alone.
    """
    active = responses.join(state["feeds"].filter("active = 1").select(F.col("id").alias("feed_id")), "feed_id", "left_semi")
    done = parse_feeds(outcomes(active))
    taken = state["feeds"].select(F.col("id").alias("_owner"), F.col("url").alias("_url")).unionByName(done.filter("new_url IS NOT NULL").select(F.col("feed_id").alias("_owner"), F.col("new_url").alias("_url")))
    first = taken.groupBy("_url").agg(F.min("_owner").alias("_first"), F.max("_owner").alias("_last"))
    had = state["feeds"].select(F.col("url").alias("_url"), F.col("id").alias("_has"))
    done = done.join(first.join(had, "_url", "left"), F.col("new_url") == F.col("_url"), "left")
    clash = F.col("_url").isNotNull() & F.when(F.col("_has").isNotNull(), F.col("_has") != F.col("feed_id")).otherwise(F.col("_first") != F.col("feed_id"))
    kind = F.when(clash, "duplicate_url").when((F.col("outcome") == "ok") & F.col("parsed").isNull(), "parse_error").otherwise(F.col("outcome"))
    done = checkpoint(done.withColumn("kind", kind).withColumn("new_url", F.when(~clash, F.col("new_url"))).drop("_url", "_first", "_last", "_has"))
    failed = F.col("kind").isin("rate_limited", "http_error", "parse_error", "duplicate_url")
    message = F.when(F.col("kind") == "rate_limited", F.concat(F.lit("rate limited, retry after "), F.col("retry_after"), F.lit(" s"))).when(F.col("kind") == "http_error", F.concat(F.lit("HTTP "), F.col("status"))).when(F.col("kind") == "parse_error", F.lit("not a feed")).when(F.col("kind") == "duplicate_url", F.concat(F.lit("another feed has the URL "), F.col("final_url")))
    feeds = store.update_feed_url(state["feeds"], done.filter("new_url IS NOT NULL").select(F.col("feed_id").alias("id"), F.col("new_url").alias("url")))
    feeds = store.update_http_cache(feeds, done.filter("outcome = 'ok' AND kind <> 'duplicate_url'").select(F.col("feed_id").alias("id"), "etag", "last_modified"))
    feeds = store.update_feed(feeds, done.filter("kind = 'ok'").select(F.col("feed_id").alias("id"), "parsed.title", "parsed.description", "parsed.site_url"), as_of)
    feeds = store.update_poll_status(feeds, done.select(F.col("feed_id").alias("id"), (~failed).alias("success"), message.alias("message")), as_of)
    articles = store.insert_articles(state["articles"], entry_articles(done.filter("kind = 'ok'")), as_of, checkpoint=checkpoint)
    new = articles.join(state["articles"].select("id"), "id", "left_anti")
    summary = done.agg(F.count_if(F.col("kind") == "ok").alias("feeds_fetched"), F.count_if(F.col("kind") == "not_modified").alias("feeds_not_modified"), F.count_if(failed).alias("feeds_errored")).join(F.broadcast(new.agg(F.count("*").alias("new_articles"))))
    errors = done.filter(failed).select("feed_id", "kind", message.alias("message"))
    return state | {"feeds": feeds, "articles": articles}, summary, errors


def failing_feeds(feeds: DataFrame) -> DataFrame:
    """Feeds with so many failures in a row that a warning is due."""
    return feeds.filter(F.col("error_count") >= WARN_FAILURES).select("id", "url", "error_count", "last_error")

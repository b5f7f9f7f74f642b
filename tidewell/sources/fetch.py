"""Fetching with a pluggable client: conditional requests for feeds, spacing by domain, robots files kept for a day.

Requests are dealt out by domain, so one task has all requests of a domain and keeps them apart in time; the
domains of a task go in turn. A client is a function from (url, headers) to a Reply; it runs in the workers.
"""

from __future__ import annotations

import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.web import ROBOTS_MAX_BYTES, domain_key, url_error

#: Seconds between two requests to one domain, of life of a robots file, and of waiting for a reply.
SPACING, ROBOTS_LIFE, TIMEOUT = 1.0, 24 * 3600, 30.0
MAX_BODY = 5 * 1024 * 1024
REPLIES = "final_url string, status int, headers map<string,string>, body string, error string, fetched_at double"


@dataclass
class Reply:
    status: int
    body: str
    final_url: str
    headers: dict[str, str] = field(default_factory=dict)


Client = Callable[[str, dict[str, str]], Reply]


def http_client(timeout: float = TIMEOUT, max_body: int = MAX_BODY) -> Client:
    """GET over the network; statuses are replies, and what is no reply raises OSError."""

    def get(url: str, headers: dict[str, str]) -> Reply:
        try:
            reply = urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout)
        except urllib.error.HTTPError as e:
            reply = e
        with reply:
            return Reply(reply.status, reply.read(max_body).decode(errors="replace"), reply.url, {k.lower(): v for k, v in reply.headers.items()})

    return get


def feed_requests(feeds: DataFrame, user_agent: str) -> DataFrame:
    """feed_id, url and headers of the active feeds; what the last reply named is asked for only if it changed."""
    pairs = [("User-Agent", F.lit(user_agent)), ("If-None-Match", F.col("etag")), ("If-Modified-Since", F.col("last_modified"))]
    entries = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in pairs]), lambda e: e["value"].isNotNull())
    return feeds.filter("active = 1").select(F.col("id").alias("feed_id"), "url", F.map_from_entries(entries).alias("headers"))


def fetch(requests: DataFrame, client: Client, spacing: float = SPACING, strict: bool = True, clock: Callable[[], float] = time.time, pause: Callable[[float], None] = time.sleep) -> DataFrame:
    """requests(url, headers, ...) with the replies: ``error`` is set where there is none.

    With ``strict`` private hosts are not asked. Requests of a domain keep their order by URL.
    """
    own = requests.columns
    dealt = requests.withColumn("_domain", F.coalesce(domain_key(F.col("url")), F.lit(""))).withColumn("_bad", url_error(F.col("url")) if strict else F.lit(None).cast("string"))
    dealt = dealt.repartition("_domain").sortWithinPartitions("_domain", "url")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last: dict[str, float] = {}
        for frame in frames:
            rows = []
            for url, headers, domain, bad in zip(frame["url"], frame["headers"], frame["_domain"], frame["_bad"], strict=True):
                if bad is not None:
                    rows.append((None, None, None, None, bad, clock()))
                    continue
                if (wait := last.get(domain, -spacing) + spacing - clock()) > 0:
                    pause(wait)
                last[domain] = clock()
                try:
                    r = client(url, dict(headers or {}))
                    rows.append((r.final_url, r.status, r.headers, r.body, None, clock()))
                except OSError as e:
                    rows.append((None, None, None, None, str(e) or type(e).__name__, clock()))
            replies = pd.DataFrame(rows, columns=["final_url", "status", "headers", "body", "error", "fetched_at"])
            replies["status"] = replies["status"].astype("Int32")
            yield pd.concat([frame[own].drop(columns="headers").reset_index(drop=True), replies], axis=1)

    kept = ", ".join(f"`{n}` {t}" for n, t in requests.dtypes if n != "headers")
    return dealt.mapInPandas(run, f"{kept}, {REPLIES}")


def as_responses(replies: DataFrame) -> DataFrame:
    """Replies to feed_requests as responses for a round of fetching; requests without a reply are left out."""
    return replies.filter("error IS NULL").select("feed_id", F.col("url").alias("request_url"), "final_url", "status", "headers", "body")


def robots_due(cache: DataFrame, urls: DataFrame, now: float, life: float = ROBOTS_LIFE) -> DataFrame:
    """domain and url of the robots files that pages(url) need and that cache(domain, body, fetched_at) has not, or no longer."""
    fresh = cache.filter(F.col("fetched_at") > now - life).select("domain")
    needed = urls.select(domain_key(F.col("url")).alias("domain")).filter("domain IS NOT NULL").distinct()
    return needed.join(fresh, "domain", "left_anti").withColumn("url", F.concat("domain", F.lit("/robots.txt")))


def refresh_robots(cache: DataFrame, urls: DataFrame, client: Client, user_agent: str, now: float, **options) -> DataFrame:
    """The cache with the files that were due; a missing or unreachable file allows everything."""
    due = robots_due(cache, urls, now).withColumn("headers", F.create_map(F.lit("User-Agent"), F.lit(user_agent)))
    got = fetch(due, client, **options)
    body = F.when(F.col("status").between(200, 299), F.substring("body", 1, ROBOTS_MAX_BYTES)).otherwise(F.lit(""))
    new = got.select("domain", F.coalesce(body, F.lit("")).alias("body"), F.lit(now).alias("fetched_at"))
    return cache.join(new.select("domain"), "domain", "left_anti").select("domain", "body", "fetched_at").unionByName(new)

"""The fetcher with a client of the tests, and inverted lists against exact search."""

import os
import random
import time

import pytest
from pyspark.sql import functions as F

from tidewell.operators import search, store, vectors
from tidewell.sources import fetch as fx
from tidewell.sources.feeds import fetch_all
from tidewell.sources.pages import extraction_counts, process_pending

NOW = "2024-06-01 00:00:00"


def replying(url, headers):
    if "broken" in url:
        raise OSError("no route")
    if headers.get("If-None-Match") == "e1":
        return fx.Reply(304, "", url)
    if url.endswith("/robots.txt"):
        return fx.Reply(404 if "open" in url else 200, "User-agent: *\nDisallow: /x", url)
    return fx.Reply(200, f"<rss><channel><title>t</title><item><title>a</title><link>{url}/1</link></item></channel></rss>", url, {"etag": "e9", "ua": headers.get("User-Agent", "")})


def test_conditional_requests_feed_a_round(spark):
    rows = [(1, "http://a.example/1", "e1", "m1", 1), (2, "http://b.example/2", None, None, 1), (3, "http://broken.example/", None, None, 1), (4, "http://c.example/", None, None, 0), (5, "http://127.1/", None, None, 1)]
    feeds = store.shaped(spark.createDataFrame(rows, "id long, url string, etag string, last_modified string, active int"), store.FEEDS, "feeds", NOW)
    asked = {r.feed_id: r.headers for r in fx.feed_requests(feeds, "agent/1").collect()}
    assert asked[1] == {"User-Agent": "agent/1", "If-None-Match": "e1", "If-Modified-Since": "m1"} and asked[2] == {"User-Agent": "agent/1"} and 4 not in asked
    replies = fx.fetch(fx.feed_requests(feeds, "agent/1"), replying)
    got = {r.feed_id: r for r in replies.collect()}
    assert got[1].status == 304 and got[2].headers["ua"] == "agent/1" and got[3].error == "no route" and "private" in got[5].error
    state = {"feeds": feeds, "articles": store.shaped(spark.createDataFrame([], "id long"), store.ARTICLES, "articles", NOW)}
    new, summary, _ = fetch_all(state, fx.as_responses(replies), NOW)
    assert [r.url for r in new["articles"].collect()] == ["http://b.example/2/1"] and summary.first().feeds_not_modified == 1
    assert {r.id: r.etag for r in new["feeds"].collect()}[2] == "e9"


def test_requests_of_a_domain_are_kept_apart(spark):
    urls = [f"http://one.example/{i}" for i in range(4)] + [f"http://d{i}.example/" for i in range(6)]
    df = spark.createDataFrame([(u,) for u in urls], "url string").withColumn("headers", F.create_map().cast("map<string,string>"))
    rows = fx.fetch(df, replying, spacing=0.3).collect()
    times = sorted(r.fetched_at for r in rows if "one.example" in r.url)
    assert len(rows) == 10 and all(b - a >= 0.27 for a, b in zip(times, times[1:], strict=False))


def test_robots_files_live_a_day(spark):
    now = time.time()
    cache = spark.createDataFrame([("http://new.example", "new", now - 3600), ("http://old.example", "old", now - 25 * 3600)], "domain string, body string, fetched_at double")
    pages = spark.createDataFrame([(f"http://{d}.example/p{i}",) for d in ("new", "old", "open", "broken") for i in range(3)], "url string")
    assert {r.domain for r in fx.robots_due(cache, pages, now).collect()} == {"http://old.example", "http://open.example", "http://broken.example"}
    got = {r.domain: r.body for r in fx.refresh_robots(cache, pages, replying, "a", now, spacing=0.0).collect()}
    assert got == {"http://new.example": "new", "http://old.example": "User-agent: *\nDisallow: /x", "http://open.example": "", "http://broken.example": ""}


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="no tables")
def test_recall_of_probed_lists(spark, tmp_path):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    q = v.filter("vec_id % 20 = 0")
    pairs = lambda df: {(r.query_id, r.vec_id) for r in df.collect()}
    want, index = pairs(vectors.neighbours(v, q, 5)), vectors.build_lists(v, lists=24, sample=1000)
    found = pairs(vectors.near_neighbours(index, q, 5, probes=18))
    print("recall", len(found & want) / len(want))
    assert len(found & want) >= 0.9 * len(want)
    assert index.rows.count() == v.count()
    index.write(f"{tmp_path}/lists")
    again = vectors.InvertedLists.read(spark, f"{tmp_path}/lists")
    assert pairs(vectors.near_neighbours(again, q, 5, probes=18)) == found


def test_lists_of_few_vectors(spark):
    rng = random.Random(8)
    df = spark.createDataFrame([(i, [rng.random() for _ in range(3)]) for i in range(3)], "vec_id long, embedding array<float>")
    assert vectors.near_neighbours(vectors.build_lists(df), df, 2, probes=9).count() == 6
    none = df.limit(0)
    assert vectors.near_neighbours(vectors.build_lists(none), none, 2, probes=3).count() == 0


def test_extraction_counts(spark):
    rows = [(i, f"http://p.example/{i}", 0 if i < 5 else 1) for i in range(7)]
    articles = store.shaped(spark.createDataFrame(rows, "id long, url string, content_extracted int"), store.ARTICLES, "articles", NOW)
    page = "<html><body><article><p>Some words</p></article></body></html>"
    replies = [(f"http://p.example/{i}", status, "text/html", page) for i, status in ((0, 200), (1, 404), (2, 200))]
    robots = spark.createDataFrame([("http://p.example", "User-agent: *\nDisallow: /2")], "domain string, body string")
    before = {"articles": articles}
    after, errors = process_pending(before, spark.createDataFrame(replies, "url string, status int, content_type string, body string"), robots, "agent/1", NOW)
    assert tuple(extraction_counts(before, after, errors).first()) == (1, 2, 4)


def test_schema_fields(spark):
    docs = spark.createDataFrame([(1, "t", "a")], "doc_id long, title string, author string")
    assert search.schema_fields(search.build_index(docs)) == [("title", "stemmed"), ("author", "plain")]
    assert search.schema_fields(search.build_index(docs, stemming=False)) == [("title", "words"), ("author", "plain")]

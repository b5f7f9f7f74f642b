import random
from collections import defaultdict, deque

import pytest
from pyspark.sql import functions as F

from tidewell.cli import main
from tidewell.config import Config, template
from tidewell.errors import ConfigError, EmbeddingError
from tidewell.operators import embed, graph, store, vectors
from tidewell.sources import feeds as fs
from tidewell.sources.versions import VersionedStore
from tidewell.streaming import ingest

NOW = "2024-05-01 00:00:00"
RSS = """<?xml version="1.0"?><rss version="2.0" xmlns:atom="http://www.w3.org/2005/Atom"><channel><title>Chan</title><link>http://site/</link><atom:link href="http://f/1" rel="self"/><description>About</description>
<item><title>One</title><link>http://a/1</link><guid>g1</guid><pubDate>Mon, 06 May 2024 07:08:09 GMT</pubDate><description><![CDATA[<p>Hello</p> there]]></description></item>
<item><title>Two</title><link>http://a/2</link><pubDate>bad date</pubDate></item><item><link>http://a/3</link><guid>g3</guid></item><item><title>Dup</title><link>http://a/1</link><guid>g9</guid></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom</title><link href="http://f/2" rel="self"/><link href="http://home/" rel="alternate"/>
<entry><id>urn:1</id><title>E1</title><link href="http://b/1"/><updated>2024-05-06T07:08:09Z</updated><summary>S</summary><author><name>Ann</name></author></entry></feed>"""


@pytest.fixture
def state(spark):
    rows = [(i, f"http://f/{i}", 1 if i < 9 else 0) for i in range(1, 10)]
    tables = {k: spark.createDataFrame([], s) for k, s in (("articles", store.ARTICLES), ("tags", store.TAGS), ("article_tags", store.ARTICLE_TAGS), ("article_links", store.LINKS))}
    return tables | {"feeds": store.shaped(spark.createDataFrame(rows, "id long, url string, active int"), store.FEEDS, "feeds", NOW)}


def replies(spark):
    r = lambda i, status, body=None, final=None, **h: (i, f"http://f/{i}", final or f"http://f/{i}", status, {k.replace("_", "-"): v for k, v in h.items()}, body)
    rows = [r(1, 200, RSS, etag="e1", last_modified="lm"), r(2, 200, ATOM, "http://new/2"), r(3, 304), r(4, 429, retry_after="7"), r(5, 503), r(6, 404, None, "http://moved/6"), r(7, 500), r(8, 200, "no feed"), r(9, 200, RSS)]
    return spark.createDataFrame(rows, fs.RESPONSES)


def test_round(spark, state):
    new, summary, errors = fs.fetch_all(state, replies(spark), NOW)
    a = {r.url: r for r in new["articles"].collect()}
    assert set(a) == {"http://a/1", "http://a/2", "http://a/3", "http://b/1"}
    assert a["http://a/1"].summary == "Hello there" and a["http://a/1"].published_at == "2024-05-06T07:08:09+00:00" and a["http://a/1"].title == "One"
    assert a["http://a/2"].published_at is None and a["http://a/3"].title == "(untitled)" and a["http://b/1"].author == "Ann"
    s = summary.first()
    assert (s.feeds_fetched, s.feeds_not_modified, s.feeds_errored, s.new_articles) == (2, 1, 5, 4)
    f = {r.id: r for r in new["feeds"].collect()}
    assert (f[1].title, f[1].site_url, f[1].etag, f[1].last_polled_at) == ("Chan", "http://site/", "e1", NOW)
    assert (f[2].url, f[2].site_url) == ("http://new/2", "http://home/") and f[3].last_polled_at == NOW
    assert f[6].url == "http://moved/6" and f[6].last_error == "HTTP 404" and f[4].error_count == 1 and f[9].last_polled_at is None
    assert {r.feed_id: r.kind for r in errors.collect()} == {4: "rate_limited", 5: "rate_limited", 6: "http_error", 7: "http_error", 8: "parse_error"}
    again, summary, _ = fs.fetch_all(new, replies(spark), NOW)
    assert summary.first().new_articles == 0


def test_stream(spark, state, tmp_path):
    box = VersionedStore(spark, f"file://{tmp_path}/kb")
    box.commit(state)
    replies(spark).write.parquet(f"{tmp_path}/in")
    for _ in range(2):
        ingest.ingest(ingest.responses_stream(spark, f"{tmp_path}/in"), box, f"{tmp_path}/cp", lambda: NOW).awaitTermination()
    assert box.versions() == [1, 2] and box.open()["articles"].count() == 4


def test_failure_stream(spark, tmp_path):
    rows = [(1, 1, False), (1, 2, False), (2, 3, False), (1, 4, True), (1, 5, False), (2, 6, False)]
    spark.createDataFrame(rows, "feed_id long, event_id long, success boolean").withColumn("ts", F.timestamp_seconds("event_id")).write.parquet(f"{tmp_path}/log")
    stream = spark.readStream.schema("feed_id long, event_id long, success boolean, ts timestamp").parquet(f"{tmp_path}/log")
    q = ingest.failure_counters(stream).writeStream.format("memory").queryName("fails").outputMode("update").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r.feed_id: r.error_count for r in spark.table("fails").collect()} == {1: 1, 2: 2}
    batch = store.consecutive_failures(spark.read.parquet(f"{tmp_path}/log"))
    assert {r.feed_id: r.error_count for r in batch.collect()} == {1: 1, 2: 2}
    rate = ingest.poll_rate(stream).writeStream.format("memory").queryName("rate").outputMode("complete").trigger(availableNow=True).start()
    rate.awaitTermination()
    assert {r.feed_id: (r.polls, r.failures) for r in spark.table("rate").collect()} == {1: (4, 3), 2: (2, 2)}


def test_due(spark, state):
    polled = store.update_poll_status(state["feeds"], spark.createDataFrame([(1, True, None)], "id long, success boolean, message string"), NOW)
    assert 1 not in [r.id for r in store.due_feeds(polled, "2024-05-01 00:29:59").collect()]
    assert 1 in [r.id for r in store.due_feeds(polled, "2024-05-01 00:30:00").collect()]


@pytest.mark.parametrize("seed", [0, 1])
def test_walk(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randrange(12), rng.randrange(12)) for _ in range(14)] + [(3, 3)]
    df = spark.createDataFrame(edges, "source_article_id long, target_article_id long")
    near = defaultdict(list)
    for a, b in edges:
        near[a].append(b)
        if a != b:
            near[b].append(a)
    level, queue = {3: 0}, deque([3])
    while queue:
        x = queue.popleft()
        for y in near[x] if level[x] < 2 else ():
            if y not in level:
                level[y] = level[x] + 1
                queue.append(y)
    got = {r.article_id: (r.level, r.linked_article_ids) for r in graph.link_graph(df, 3, 2).collect()}
    assert got == {x: (n, sorted(near[x])) for x, n in level.items()}
    assert graph.link_graph(df, 99, 3).collect()[0].linked_article_ids == []


def test_clusters_and_pairs(spark):
    a = spark.createDataFrame([(i, i * 1000) for i in range(1, 6)], "id long, t long").select("id", F.timestamp_seconds("t").alias("published_ts"))
    links = spark.createDataFrame([(1, 2), (2, 3), (1, 5)], "source_article_id long, target_article_id long")
    c = graph.event_clusters(a, links, 1500)
    assert {r.article_id: r.cluster for r in c.collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    assert {r.article_id: r.follows for r in graph.causal_chains(c, a).collect()} == {1: None, 2: 1, 3: 2, 4: None, 5: None}
    pairs = spark.createDataFrame([(1, "x"), (1, "y"), (2, "x"), (2, "y"), (2, "y"), (3, "x")], "article_id long, entity string")
    assert [tuple(r) for r in graph.co_occurrence(pairs).collect()] == [("x", "y", 2)]


def test_embedding(spark):
    calls = []

    def flaky(texts):
        if len(texts) > 1:
            raise EmbeddingError("too many")
        if "bad" in texts[0]:
            raise EmbeddingError("no")
        return [[1.0, 2.0]]

    assert embed.embed_batch(flaky, ["a", "b"], 2) == [[1.0, 2.0]] * 2 and embed.embed_batch(flaky, [], 2) == []
    with pytest.raises(EmbeddingError):
        embed.embed_text(flaky, "a", 3)
    with pytest.raises(EmbeddingError):
        embed.embed_text(lambda t: [], "a", 3)
    a = store.shaped(spark.createDataFrame([(1, "bad", "", 1), (2, "good", "text", 1), (3, "x", "", 0)], "id long, title string, content string, content_extracted int"), store.ARTICLES, "articles", NOW)
    done = embed.embed_pending(a, flaky, 2)
    flagged, vecs, summary = embed.store_embeddings(a, done)
    assert {r.id: r.embedding_generated for r in flagged.collect()} == {1: 0, 2: 1, 3: 0}
    assert tuple(summary.first()) == (1, 1) and vecs.first().article_id == 2
    h = embed.hashing_embedder(16)
    assert h(["a b"]) == h(["a b"]) and abs(sum(x * x for x in h(["a b c"])[0]) - 1) < 1e-9
    tries = embed.http_embedder("http://127.0.0.1:9", "m", 0.2, calls.append)
    with pytest.raises(EmbeddingError):
        tries(["x"])
    assert calls == [0.5, 1.0, 2.0]


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    assert [r.vec_id for r in vectors.top_k(v, [1.0, 0.0], 2).collect()] == [1, 2]
    n = vectors.neighbours(v, v.filter("vec_id = 3"), 2)
    assert [(r.vec_id, r.rank) for r in n.orderBy("rank").collect()] == [(2, 1), (1, 2)]
    assert vectors.similar_links(n, 0.05).count() == 1


def test_config(tmp_path, capsys):
    path = tmp_path / "c.toml"
    path.write_text('[polling]\ndefault_interval_minutes = 5\n[llm]\ntemperature = 1\n[other]\nx = 1\n')
    env = {"TIDEWELL_POLLING_MAX_CONCURRENT_FETCHES": "8", "TIDEWELL_LLM_MAX_TOKENS": "many", "TIDEWELL_MCP_SSE_ENABLED": "true"}
    c = Config.load(path, env.get)
    assert (c.polling.default_interval_minutes, c.polling.max_concurrent_fetches, c.llm.temperature, c.llm.max_tokens, c.mcp.sse_enabled) == (5, 8, 1.0, 2048, True)
    for bad in ("[polling]\ndefault_interval_minutes = 0", "[llm]\ntemperature = 2.5", "[service]\nlog_level = 'loud'", "[llm]\napi_base_url = 'x'", "[extraction]\nmax_article_size_bytes = 10", "[mcp]\nsse_host = ''", "[llm]\nembedding_dimensions = 0", "not toml", "[polling]\ndefault_interval_minutes = 'x'"):
        path.write_text(bad)
        with pytest.raises(ConfigError):
            Config.load(path, {}.get)
    with pytest.raises(ConfigError):
        Config.load(tmp_path / "none.toml", {}.get)
    path.write_text(template())
    assert Config.load(path, {}.get) == Config()
    assert main(["config", "--generate"]) == 0 and main(["serve", "--config", str(path)]) == 0 and main(["config", "--file", str(tmp_path / "no")]) == 1

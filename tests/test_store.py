import random

import pytest

from tidewell.errors import DuplicateEntry, ForeignKeyError, NotFound
from tidewell.operators import store
from tidewell.sources.versions import VersionedStore

NOW = "2024-05-01 00:00:00"


def make(spark, rows, kind, schema, table):
    return store.shaped(spark.createDataFrame(rows, kind), schema, table, NOW)


@pytest.fixture
def state(spark):
    feeds = make(spark, [(1, "http://f/1", "One"), (2, "http://f/2", None)], "id long, url string, title string", store.FEEDS, "feeds")
    articles = make(spark, [(1, 1, "g1", "u1", "a"), (2, 1, None, "u2", "b"), (3, 2, "g1", "u3", "c")], "id long, feed_id long, guid string, url string, title string", store.ARTICLES, "articles")
    tags = make(spark, [(1, "news"), (2, "机器学习")], "id long, name string", store.TAGS, "tags")
    pairs = make(spark, [(1, 1, 0.5), (2, 1, 0.7), (3, 2, 0.9)], "article_id long, tag_id long, confidence double", store.ARTICLE_TAGS, "article_tags")
    links = make(spark, [(1, 1, 2), (2, 3, 1)], "id long, source_article_id long, target_article_id long", store.LINKS, "article_links")
    return {"feeds": feeds, "articles": articles, "tags": tags, "article_tags": pairs, "article_links": links}


def test_defaults_and_reads(state):
    f = store.get_by_id(state["feeds"], 2).first()
    assert (f.poll_interval_minutes, f.error_count, f.active, f.title) == (30, 0, 1, None)
    with pytest.raises(NotFound):
        store.get_by_id(state["feeds"], 9)
    assert store.article_exists(state["articles"], "u2") and not store.article_exists(state["articles"], "nope")
    assert store.recent_articles(state["articles"], 0).count() == 0 and store.recent_articles(state["articles"], -1).count() == 3


def test_add_and_update_feed(spark, state):
    more = store.add_feed(state["feeds"], "http://f/3", "Three", NOW)
    assert {r.id for r in more.collect()} == {1, 2, 3}
    with pytest.raises(DuplicateEntry):
        store.add_feed(state["feeds"], "http://f/1", None, NOW)
    delta = spark.createDataFrame([(1, None, "about")], "id long, title string, description string")
    f = store.get_by_id(store.update_feed(state["feeds"], delta, NOW), 1).first()
    assert (f.title, f.description) == ("One", "about")
    with pytest.raises(NotFound):
        store.update_feed(state["feeds"], spark.createDataFrame([(9, "x")], "id long, title string"), NOW)
    with pytest.raises(DuplicateEntry):
        store.update_feed_url(state["feeds"], spark.createDataFrame([(1, "http://f/2")], "id long, url string"))


def test_poll_status(spark, state):
    out = lambda rows: spark.createDataFrame(rows, "id long, success boolean, message string")
    once = store.update_poll_status(state["feeds"], out([(1, False, "boom"), (7, False, "?")]), NOW)
    twice = store.update_poll_status(once, out([(1, False, "again")]), NOW)
    f = store.get_by_id(twice, 1).first()
    assert (f.error_count, f.last_error, f.last_polled_at) == (2, "again", None)
    f = store.get_by_id(store.update_poll_status(twice, out([(1, True, None)]), NOW), 1).first()
    assert (f.error_count, f.last_error, f.last_polled_at) == (0, None, NOW)
    cached = store.update_http_cache(state["feeds"], spark.createDataFrame([(1, "e", None)], "id long, etag string, last_modified string"))
    assert store.get_by_id(cached, 1).first().etag == "e"


def test_cascade(state):
    left = store.remove_feed(state, 1)
    assert [r.id for r in left["articles"].collect()] == [3]
    assert [r.article_id for r in left["article_tags"].collect()] == [3]
    assert left["article_links"].count() == 0
    counts = {r.name: r.article_count for r in store.tag_counts(left["tags"], left["article_tags"]).collect()}
    assert counts == {"news": 0, "机器学习": 1}
    with pytest.raises(NotFound):
        store.remove_feed(state, 42)


def test_insert_article(spark, state):
    row = lambda feed, guid, url: spark.createDataFrame([(feed, guid, url, "t")], "feed_id long, guid string, url string, title string")
    assert store.insert_article(state, row(1, "g9", "u9"), NOW).count() == 4
    for bad in (row(1, "g1", "u9"), row(2, "g9", "u1")):
        with pytest.raises(DuplicateEntry):
            store.insert_article(state, bad, NOW)
    with pytest.raises(ForeignKeyError):
        store.insert_article(state, row(8, "g9", "u9"), NOW)


@pytest.mark.parametrize("seed", [1, 2])
def test_batch_insert_is_sequential(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(3), rng.choice([None, *"abcdefghij"]), f"u{rng.randrange(60)}") for i in range(150)]
    urls, keys, want = set(), set(), []
    for i, feed, guid, url in rows:
        if url not in urls and (guid is None or (feed, guid) not in keys):
            urls.add(url)
            keys.add((feed, guid))
            want.append(i)
    df = spark.createDataFrame(rows, "ordinal long, feed_id long, guid string, url string")
    got = store.first_of_keys(df, ["ordinal"], store.ARTICLE_KEYS)
    assert sorted(r.ordinal for r in got.collect()) == want


def test_content_and_flags(spark, state):
    delta = spark.createDataFrame([(1, "two words", "h", None, "2024-01-01")], "id long, content string, content_hash string, title string, published_at string")
    a = store.get_by_id(store.update_content(state["articles"], delta, NOW), 1).first()
    assert (a.word_count, a.title, a.published_at, a.content_extracted) == (2, "a", "2024-01-01", 1)
    marked = store.mark(state["articles"], spark.createDataFrame([(2,)], "id long"), "tags_generated")
    assert {r.id: r.tags_generated for r in marked.collect()} == {1: 0, 2: 1, 3: 0}
    with pytest.raises(NotFound):
        store.mark(state["articles"], spark.createDataFrame([(99,)], "id long"), "tags_generated")


def test_tags(spark, state):
    delta = spark.createDataFrame([(1, 0, "News", 0.1), (1, 1, "AI", 0.2), (1, 2, "ai", 0.3)], "article_id long, pos int, name string, confidence double")
    out = store.add_tags(state, delta, NOW)
    found = [(r.name, r.confidence) for r in store.tags_for_article(out["tags"], out["article_tags"], 1).collect()]
    assert found == [("news", 0.5), ("ai", 0.2)]
    assert [r.name for r in store.top_tags(out["tags"], out["article_tags"], 2).collect()] == ["news", "ai"]
    assert sorted(r.article_id for r in store.articles_by_tag(out["tags"], out["article_tags"], "NEWS").collect()) == [1, 2]


def test_links(spark, state):
    pair = lambda a, b: spark.createDataFrame([(a, b)], "source_article_id long, target_article_id long")
    more = store.add_links(state, pair(2, 1), NOW)
    assert more.count() == 3 and store.get_by_id(more, 3).first().relationship == "related"
    assert store.add_links(state, pair(2, 2), NOW).count() == 3
    with pytest.raises(DuplicateEntry):
        store.add_links(state, pair(1, 2), NOW)
    with pytest.raises(ForeignKeyError):
        store.add_links(state, pair(1, 77), NOW)


def test_date_range_is_by_string(spark):
    a = make(spark, [(1, "2025-01-01T10:00:00+00:00"), (2, "2025-01-01"), (3, None)], "id long, published_at string", store.ARTICLES, "articles")
    assert [r.id for r in store.articles_in_date_range(a, "2024-12-31", "2025-01-01").collect()] == [2]


def test_versions(spark, state, tmp_path):
    box = VersionedStore(spark, f"file://{tmp_path}/kb")
    assert box.open()["feeds"].count() == 0
    assert box.commit(state) == 1
    old = box.open()
    box.commit(store.remove_feed(old, 1))
    assert box.versions() == [1, 2] and old["feeds"].count() == 2 and box.open()["feeds"].count() == 1

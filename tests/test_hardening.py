"""Long chains of clashes, deep pages, numeric hosts, moves of feeds that clash, and query sets beyond a block."""

import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import html
from tidewell.functions.web import ipv4, url_error
from tidewell.operators import graph, store, vectors
from tidewell.sources.feeds import RESPONSES, fetch_all

NOW = "2024-06-01 00:00:00"


def in_sequence(rows):
    urls, keys, out = set(), set(), []
    for i, feed, guid, url in rows:
        if (url is None or url not in urls) and (guid is None or (feed, guid) not in keys):
            urls.add(url)
            keys.add((feed, guid))
            out.append(i)
    return out


def test_a_chain_of_clashes(spark):
    """Each row shares its URL with the one before or its guid with the one after, so every second is kept."""
    rows = [(i, 1, f"g{(i + 1) // 2}", f"u{i // 2}") for i in range(1000)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "ordinal long, feed_id long, guid string, url string")
    got = store.first_of_keys(df, ["ordinal"], store.ARTICLE_KEYS)
    assert sorted(r.ordinal for r in got.collect()) == in_sequence(sorted(rows)) == list(range(0, 1000, 2))


@pytest.mark.parametrize("seed", [3, 4])
def test_chains_and_groups(spark, seed):
    rng = random.Random(seed)
    rows = [(i, rng.randrange(2), rng.choice([None, *"abcdefghijklmnop"]), f"u{rng.randrange(40)}") for i in range(300)]
    df = spark.createDataFrame(rows, "ordinal long, feed_id long, guid string, url string")
    for rounds in (0, 1, 3):
        assert sorted(r.ordinal for r in store.first_of_keys(df, ["ordinal"], store.ARTICLE_KEYS, rounds=rounds).collect()) == in_sequence(rows)


def test_components(spark):
    edges = [(i, i + 1) for i in range(1000)] + [(2000, 2001)]
    both = spark.createDataFrame(edges + [(b, a) for a, b in edges], "a long, b long")
    got = {r.node: r.component for r in graph.components(both).collect()}
    assert got == {i: 0 for i in range(1001)} | {2000: 2000, 2001: 2000}
    assert graph.components(both.limit(0)).count() == 0


def test_ids_have_no_gaps(spark):
    state = spark.createDataFrame([(7, "x")], "id long, name string")
    delta = spark.createDataFrame([(f"n{i:04}",) for i in range(500)], "name string")
    rows = store.with_ids(state, delta, "name").collect()
    assert sorted((r.id, r.name) for r in rows) == [(8 + i, f"n{i:04}") for i in range(500)]


HOSTS = {
    "http://127.1/": True, "http://2130706433/": True, "http://0x7f000001/": True, "http://0177.0.0.1/": True, "http://10.1/": True, "http://127.0.0.1./": True, "http://%31%32%37.0.0.1/": True,
    "http://172.31.255.255/": True, "http://172.32.0.1/": False, "http://192.168.1.1:8080/x": True, "http://169.254.169.254/": True, "http://0/": True, "http://0x0/": True, "http://255.255.255.255/": True,
    "http://[::1]/": True, "http://[0:0:0:0:0:0:0:1]/": True, "http://[::]/": True, "http://[2001:db8::1]/": False, "http://8.8.8.8/": False, "http://134744072/": False, "http://1.2.3.4.5/": True, "http://256.256.256.256/": True, "http://0x/": True,
    "http://localhost./": True, "http://LOCALHOST/": True, "http://a.local/": True, "http://b.internal/": True, "http://local.example.com/": False, "https://example.com/127.0.0.1": False, "http://7up.example.com/": False, "ftp://example.com/": True, "nothing": True,
}


def test_hosts(spark):
    df = spark.createDataFrame([(u,) for u in HOSTS], "url string").select("url", url_error(F.col("url")).isNotNull().alias("bad"))
    assert {r.url: r.bad for r in df.collect()} == HOSTS
    numbers = {"1.2.3.4": 16909060, "0x10.1": 268435457, "010.0.0.1": 134217729, "1.2.65535": 16973823, "08.1": None, "1..2": None, "": None, "1.2.3.256": None}
    got = spark.createDataFrame([(h,) for h in numbers], "h string").select("h", ipv4(F.col("h")).alias("n"))
    assert {r.h: r.n for r in got.collect()} == numbers


def test_deep_pages():
    deep = "<div>" * 5000 + "deep words" + "</div>" * 5000
    assert html.extract(f"<body>{deep}</body>")[0] == "deep words"
    assert html.extract(f"<body><nav>{deep}</nav><article>{'<div class=content>' * 3000}<p>inner text</p></article></body>")[0] == "inner text"


def test_sizes_of_texts():
    tree = html.parse("<body> <article> one <b>two</b>\n<i> </i></article><p>é 漢</p> <div>  </div></body>")
    sizes = html.text_sizes(tree)
    for e in [tree, *tree.walk()]:
        assert sizes[id(e)] == len(" ".join(e.texts()).strip().encode())


def test_moves_that_clash_fail_alone(spark):
    feeds = store.shaped(spark.createDataFrame([(i, f"http://f{i}") for i in range(1, 7)], "id long, url string"), store.FEEDS, "feeds", NOW)
    body = "<rss><channel><title>t</title><item><title>x</title><link>http://x/{0}</link><guid>g{0}</guid></item></channel></rss>"
    moved = {1: "http://f2", 2: "http://f2", 3: "http://new", 4: "http://new", 5: "http://five", 6: "http://f1"}
    rows = [(i, f"http://f{i}", to, 200, {}, body.format(i)) for i, to in moved.items()]
    state = {"feeds": feeds, "articles": store.shaped(spark.createDataFrame([], "id long"), store.ARTICLES, "articles", NOW)}
    new, summary, errors = fetch_all(state, spark.createDataFrame(rows, RESPONSES), NOW)
    assert {(r.feed_id, r.kind) for r in errors.collect()} == {(1, "duplicate_url"), (4, "duplicate_url"), (6, "duplicate_url")}
    assert {r.id: r.url for r in new["feeds"].collect()} == {1: "http://f1", 2: "http://f2", 3: "http://new", 4: "http://f4", 5: "http://five", 6: "http://f6"}
    assert {r.feed_id for r in new["articles"].collect()} == {2, 3, 5}
    one = summary.first()
    assert (one.feeds_fetched, one.feeds_errored, one.new_articles) == (3, 3, 3)
    assert {r.id: r.error_count for r in new["feeds"].collect()} == {1: 1, 2: 0, 3: 0, 4: 1, 5: 0, 6: 1}


def test_neighbours_in_blocks(spark, monkeypatch):
    rng = random.Random(5)
    df = spark.createDataFrame([(i, [rng.random() for _ in range(4)]) for i in range(60)], "vec_id long, embedding array<float>")
    rows = lambda: sorted(tuple(r) for r in vectors.neighbours(df, df.filter("vec_id % 3 = 0"), 4).collect())
    whole = rows()
    monkeypatch.setattr(vectors, "MAX_QUERIES", 6)
    assert rows() == whole and len(whole) == 80

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.functions.html import extract
from tidewell.operators import store
from tidewell.plans.queries import ORACLE_SQL, QUERIES
from tidewell.sources.pages import blocked, extract_pages, process_pending

NEWS = """<html><head><title>Site</title><meta name="pubdate" content="never"></head><body><nav><li>Home</li></nav>
<div class="ad-box"><p>Buy now</p></div><article><h1>Big &amp; small</h1><span class="byline">By Ann Lee</span><time datetime="2024-03-04T05:06:07Z">x</time>
<h2>Part</h2><p>First <b>line<br>two</b><p>Second<ul><li><p>Item</p></li></ul><script>var t="</p>";</script><table><tr><td>cell</td></tr></table></article>
<section class="comments"><p>Me too</p></section><footer><p>End</p></footer></body></html>"""
BLOG = '<body><header><h1>Blog</h1></header><main><article class="post"><h2>Entry</h2><p>Text here</p><p>Text here</p><aside class="sidebar"><p>Other</p></aside></article></main></body>'
PAY = "<body><article><h1>Deal</h1><p>Premium Content. Subscribe now</p></article></body>"


def test_news():
    text, blocks, title, author, dates = extract(NEWS)
    assert blocks == ["# Big & small", "## Part", "First line two", "Second", "- Item", "Item"]
    assert "Buy now" not in text and "Me too" not in text and "cell" not in text
    assert (title, author) == ("Big & small", "Ann Lee")
    assert dates[:2] == ["never", "2024-03-04T05:06:07Z"]


def test_blog_and_fallback():
    text, blocks, title, _, _ = extract(BLOG)
    assert (blocks, title) == (["## Entry", "Text here"], "Entry")
    assert extract("<body><div>bare <i>words</i></div></body>")[0] == "bare words"
    assert extract("<p>minimal")[0] == "minimal"
    assert extract("")[0] == ""


def test_extract_pages(spark):
    rows = [(1, NEWS), (2, PAY), (3, "just  text"), (4, ""), (5, None)]
    got = {r.page_id: r for r in extract_pages(spark.createDataFrame(rows, "page_id long, html string")).collect()}
    assert got[1].published_at == "2024-03-04T05:06:07+00:00" and got[1].title == "Big & small"
    assert got[2].potentially_incomplete and not got[1].potentially_incomplete
    assert (got[3].text, got[3].word_count, got[3].title) == ("just text", 2, None)
    assert got[4].word_count == 0 and got[5].text is None
    cut = extract_pages(spark.createDataFrame([(1, "é" * 30)], "page_id long, html string"), max_bytes=21).first()
    assert cut.text == "é" * 10


def test_blocked_and_pending(spark):
    pages = spark.createDataFrame([("http://a.org/private/x",), ("http://a.org/ok",), ("http://10.0.0.1/",), ("http://b.org/private",)], "url string")
    robots = spark.createDataFrame([("http://a.org", "User-agent: *\nDisallow: /private")], "domain string, body string")
    errors = {r.url: r.error for r in blocked(pages, robots, "me/1").collect()}
    assert errors["http://a.org/private/x"] == "denied by robots.txt" and errors["http://a.org/ok"] is None and errors["http://b.org/private"] is None
    assert errors["http://10.0.0.1/"].startswith("private")
    articles = store.shaped(spark.createDataFrame([(1, 1, "http://a.org/ok", "t"), (2, 1, "http://a.org/gone", "u")], "id long, feed_id long, url string, title string"), store.ARTICLES, "articles", "2024-01-01 00:00:00")
    replies = spark.createDataFrame([("http://a.org/ok", 200, "text/html", NEWS), ("http://a.org/gone", 404, "text/html", "")], "url string, status int, content_type string, body string")
    state, failed = process_pending({"articles": articles}, replies, robots, "me/1", "2024-01-02 00:00:00")
    done = {r.id: r for r in state["articles"].collect()}
    assert done[1].content_extracted == 1 and done[1].title == "Big & small" and done[1].word_count > 5
    assert done[2].content_extracted == 0 and failed.select("error").first()[0] == "HTTP 404"
    assert state["articles"].select(F.sum("content_extracted")).first()[0] == 1


def test_unclosed_references():
    page = "<article><h1>a &amp; b&amp</h1><p>x&lt y &#65; &#65 & &am&amp<b>z</b></p><script>'&amp'</script></article>"
    assert extract(page)[1:3] == (["# a & b&", "x< y A A & &am& z"], "a & b&")
    assert extract(page, closed=True)[1:3] == (["# a & b&amp", "x&lt y A &#65 & &am&amp z"], "a & b&amp")
    script = "<article><p>t<script>'&amp' < &</script>&amp<!-- & <script> -->&lt</p></article>"
    assert extract(script, closed=True)[1] == ["t '&amp' < & &amp &lt"]


@pytest.mark.parametrize("name", ["page_extract", "page_metadata"])
def test_cut_references_against_sql(spark, tmp_path, name):
    titles = ["and&&amp", "and&&am", "and&", "x &lt", "x &quot", "a &gt; b &amp;", "&amp;amp", ""]
    rows = [(i, "http://a.org/1", f"<html><body><article><h1>{t}</h1><p>{t} some text</p></article></body></html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
        want = c.execute(ORACLE_SQL[name])
        columns = [x[0] for x in want.description]
        assert sorted(want.fetchall()) == sorted(tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect())

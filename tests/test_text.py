import hashlib
import re
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import dates
from tidewell.functions import text as X
from tidewell.functions.stemmer import stem
from tidewell.functions.web import domain_key, looks_like_html, robots_allow, robots_rules, url_error, url_path

SPACES = "\t\n\x0b\x0c\r \x85\xa0         　"


def one(spark, value, expression, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(expression(F.col("x")).alias("y")).first()[0]


def model_space(s):
    return re.sub(f"[{SPACES}]+", " ", s).strip(" ")


def model_cut(s, n):
    return s.encode()[:n].decode(errors="ignore")


def model_strip(s):
    out, inside = [], False
    for c in s:
        if c == "<":
            inside = True
        elif c == ">":
            inside = False
        elif not inside:
            out.append(c)
    return "".join(out)


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(st.sampled_from(list("ab<>é漢😀\x00\x1c\x7f") + list(SPACES)), max_size=30), min_size=20, max_size=20))
def test_against_models(spark, texts):
    t = F.col("x")
    df = spark.createDataFrame([(s,) for s in texts], "x string")
    rows = df.select(t, X.normalize_whitespace(t), X.count_words(t), X.content_hash(t), X.truncate_utf8(t, 7), X.strip_html_tags(t), X.sanitize(t)).collect()
    for s, norm, n, h, cut, bare, clean in rows:
        want = model_space(s)
        assert norm == want
        assert n == (len(want.split(" ")) if want else 0)
        assert h == hashlib.sha256(want.encode()).hexdigest()
        assert cut == model_cut(s, 7)
        assert bare == model_strip(s)
        assert clean == "".join(c for c in s if unicodedata.category(c) != "Cc" or c in "\n\t\r")


def test_article_text(spark):
    df = spark.createDataFrame([("T", "body"), ("T", ""), ("T\x00", None)], "t string, c string")
    assert [r[0] for r in df.select(X.prepare_article_text(F.col("t"), F.coalesce("c", F.lit("")))).collect()] == ["T\n\nbody", "T", "T"]


@pytest.mark.parametrize(("raw", "want"), [("By Jane Roe", "Jane Roe"), ("by Jane", "Jane"), (" By By Jane ", "Jane"), ("Byron", "Byron")])
def test_byline(spark, raw, want):
    assert one(spark, raw, X.strip_by_prefix) == want


def test_incomplete(spark):
    df = spark.createDataFrame([("<p>Subscribe NOW</p>", 10), ("<p>Subscribe now</p>", 300), ("<p>free</p>", 10)], "h string, n long")
    assert [r[0] for r in df.select(X.potentially_incomplete(F.col("h"), F.col("n"))).collect()] == [True, False, False]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("2024-05-06T07:08:09Z", "2024-05-06 07:08:09"),
        ("2024-05-06T07:08:09.123+02:00", "2024-05-06 05:08:09"),
        ("Mon, 06 May 2024 07:08:09 +0000", "2024-05-06 07:08:09"),
        ("Mon, 06 May 2024 07:08:09 GMT", "2024-05-06 07:08:09"),
        ("2024-05-06 07:08:09", "2024-05-06 07:08:09"),
        ("2024-05-06T07:08:09", "2024-05-06 07:08:09"),
        ("2024-05-06 07:08", "2024-05-06 07:08:00"),
        ("2024-05-06", "2024-05-06 00:00:00"),
        ("May 6, 2024", "2024-05-06 00:00:00"),
        ("September 16, 2024", "2024-09-16 00:00:00"),
        ("2024", None),
        ("soon", None),
        (None, None),
    ],
)
def test_page_dates(spark, raw, want):
    assert one(spark, raw, lambda c: dates.stored(dates.parse_page_date(c))) == want


def test_index_dates(spark):
    for raw, want in (("2024-01-02T03:04:05+00:00", "2024-01-02T03:04:05+00:00"), ("2024-01-02 03:04:05", "2024-01-02T03:04:05+00:00"), ("2024-01-02", "2024-01-02T00:00:00+00:00"), ("x", None)):
        assert one(spark, raw, lambda c: dates.rfc3339(dates.parse_index_date(c))) == want


@pytest.mark.parametrize(
    ("word", "want"),
    [("running", "run"), ("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("generalization", "general"), ("happily", "happili"), ("skies", "sky"), ("cats", "cat"), ("agreed", "agre"), ("national", "nation"), ("the", "the"), ("consistency", "consist"), ("knightly", "knight"), ("licenses", "licens"), ("license", "licens")],
)
def test_stems(word, want):
    assert stem(word) == want


BAD = ["http://127.0.0.1/", "http://10.1.2.3/", "http://192.168.0.1/", "http://172.20.0.1/x", "http://169.254.1.1/", "http://0.0.0.0/", "http://[::1]/", "http://localhost/", "http://a.local/", "http://b.internal/x", "ftp://a.org/", "file:///etc/passwd", None]
GOOD = ["http://example.com/", "https://8.8.8.8/x", "https://172.32.0.1/", "https://a.example.org:8443/p?q"]


def test_urls(spark):
    df = spark.createDataFrame([(u,) for u in BAD + GOOD], "x string").select(url_error(F.col("x")).isNull().alias("ok")).collect()
    assert [r[0] for r in df] == [False] * len(BAD) + [True] * len(GOOD)
    keys = {"HTTP://User@Example.com:80/a": "http://example.com", "https://e.org:8443/x?y": "https://e.org:8443", "https://e.org:443": "https://e.org", "nothing": None}
    for url, want in keys.items():
        assert one(spark, url, domain_key) == want
    assert one(spark, "https://e.org?q", url_path) == "/"
    assert one(spark, "https://e.org/a/b?q", url_path) == "/a/b"


def test_sniff(spark):
    df = spark.createDataFrame([("text/html", "x"), (None, "<html>"), ("text/plain", "<HTML>"), (None, "plain")], "t string, b string")
    assert [r[0] for r in df.select(looks_like_html(F.col("t"), F.col("b"))).collect()] == [True, True, False, False]


@pytest.mark.parametrize(
    ("body", "path", "want"),
    [
        ("User-agent: *\nDisallow:", "/x", True),
        ("User-agent: *\nDisallow: /private", "/private/a", False),
        ("User-agent: *\nDisallow: /a\nAllow: /a/b", "/a/b/c", True),
        ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", True),
        ("User-agent: *\nDisallow: /\nUser-agent: bot\nDisallow: /x # no", "/y", True),
        ("User-agent: bot*\r\nDisallow: /x\r\n", "/x", False),
        ("User-agent: bot\nDisallow:\nUser-agent: *\nDisallow: /", "/y", False),
        ("Disallow: /", "/y", True),
        ("", "/y", True),
        (None, "/y", True),
    ],
)
def test_robots(spark, body, path, want):
    df = spark.createDataFrame([(body, path)], "b string, p string")
    assert df.select(robots_allow(robots_rules(F.col("b"), "Bot/1.0"), F.col("p"))).first()[0] is want


def test_robots_groups(spark):
    body = "User-agent: bot\nDisallow:\nUser-agent: *\nDisallow: /"
    df = spark.createDataFrame([(body,)], "b string")
    for reset, want in ((False, False), (True, True)):
        assert df.select(robots_allow(robots_rules(F.col("b"), "bot/2", reset), F.lit("/y"))).first()[0] is want

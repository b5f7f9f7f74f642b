import pytest

from tidewell.errors import QuerySyntaxError
from tidewell.operators import search as S

DOCS = [
    (1, "Rust release", "The systems language announces a new release of the compiler today", "", "Ann", "Tech", "rust", "2024-05-01T00:00:00+00:00"),
    (2, "Cooking", "A release of steam; language of food. Systems vary", "rust removal", "Bob", "Food", "", "2024-04-01 00:00:00"),
    (3, "Old news", "rust rust rust everywhere", "", "Ann", "Tech", "history", "2020-01-01"),
    (4, "Nothing", "no match here", "", "", "Food", "", None),
]


@pytest.fixture(scope="module")
def index(spark):
    from pyspark.sql import functions as F

    from tidewell.functions.dates import parse_index_date

    df = spark.createDataFrame(DOCS, "doc_id long, title string, content string, summary string, author string, feed_title string, tags string, d string")
    return S.build_index(df.withColumn("published_at", parse_index_date(F.col("d"))).drop("d"))


def ids(df):
    return [r.doc_id for r in df.orderBy(df["score"].desc(), "doc_id").collect()]


def test_terms_and_boosts(index):
    assert ids(S.match(index, "rust"))[0] == 1  # title counts double, the tag too
    assert set(ids(S.match(index, "rust"))) == {1, 2, 3}
    assert ids(S.match(index, "releases")) == [1, 2]  # stems agree
    assert ids(S.match(index, "absent")) == [] and ids(S.match(index, "   ")) == []


def test_boolean(index):
    assert ids(S.match(index, "release AND food")) == [2]
    assert set(ids(S.match(index, "release OR everywhere"))) == {1, 2, 3}
    assert ids(S.match(index, "release -food")) == [1] and ids(S.match(index, "release NOT food")) == [1]
    assert ids(S.match(index, "+rust +everywhere")) == [3]
    assert ids(S.match(index, "NOT rust")) == []
    assert ids(S.match(index, "release AND (steam OR nothing)")) == [2]
    assert set(ids(S.match(index, "author:ann"))) == {1, 3} and ids(S.match(index, "feed_title:food AND steam")) == [2]
    assert ids(S.match(index, "title:(cooking OR old)^3 steam"))[0] in (2, 3)


def test_phrase(index):
    assert ids(S.match(index, '"systems language"')) == [1]
    assert ids(S.match(index, '"language systems"')) == []


@pytest.mark.parametrize("bad", ["(a", "a)", "a AND", "AND a", "nofield:x", "+"])
def test_syntax(bad):
    with pytest.raises(QuerySyntaxError):
        S.parse_query(bad)


def test_filters_paging_dates(index):
    page = lambda **o: [r.article_id for r in S.search(index, "rust release", S.SearchOptions(**o)).collect()]
    everything = page()
    assert len(everything) == 3 and page(limit=1, offset=1) == everything[1:2] and page(offset=9) == [] and page(limit=0) == []
    assert page(date_from="2024-04-15 00:00:00") == [1] and set(page(date_to="2024-04-15 00:00:00")) == {2, 3}
    assert set(page(feed_filter=["Tech"])) == {1, 3} and page(feed_filter=["tech"]) == [] and page(feed_filter=[]) == []
    assert page(sort_by="date") == [1, 2, 3]
    assert page(limit=1, feed_filter=["Food"]) == [2]


def test_recency(index):
    plain = {r.article_id: r.score for r in S.search(index, "rust").collect()}
    fresh = {r.article_id: r.score for r in S.search(index, "rust", S.SearchOptions(recency_boost=True, as_of="2024-05-01 00:00:00")).collect()}
    assert abs(fresh[1] / plain[1] - 2) < 1e-3 and abs(fresh[3] / plain[3] - 1) < 1e-3


def test_upsert_and_delete(spark, index, tmp_path):
    new = index.docs.filter("doc_id = 4").selectExpr("doc_id", "'Rust at last' AS title", "content", "summary", "author", "feed_title", "tags", "published_at")
    more = index.upsert(new)
    assert 4 in ids(S.match(more, "rust")) and more.docs.count() == 4
    less = index.delete(spark.createDataFrame([(1,)], "doc_id long"))
    assert 1 not in ids(S.match(less, "rust"))
    index.write(f"{tmp_path}/ix")
    assert ids(S.match(S.Index.read(spark, f"{tmp_path}/ix"), "rust")) == ids(S.match(index, "rust"))
    plan = S.Index.read(spark, f"{tmp_path}/ix").postings.filter("field = 'content' AND term = 'rust'")._jdf.queryExecution().toString()
    assert "PartitionFilters" in plan and "EqualTo(term,rust)" in plan


def test_empty_index(spark, index):
    empty = S.build_index(index.docs.limit(0))
    assert ids(S.match(empty, "rust")) == []


def model_snippet(text, terms):
    head = text[:2000].lower()
    hits = [p for t in terms if (p := head.find(t)) >= 0]
    hit = min(hits) if hits else 0
    start = 0
    if hit > 40:
        space = text.rfind(" ", 0, hit)
        start = space + 1 if space >= 0 else hit - 40
    end = start + 200
    if end >= len(text):
        end = len(text)
    else:
        space = text.find(" ", end)
        end = space if space >= 0 else len(text)
    return ("..." if start else "") + text[start:end] + ("..." if end < len(text) else "")


def test_snippet(spark):
    from pyspark.sql import functions as F

    texts = ["short", "x" * 300, "word " * 100 + "needle in hay " + "tail " * 100, "a" * 100 + "needle", "é " * 150 + "needle", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(S.snippet(F.col("t"), ["needle"])).collect()]
    assert got == [model_snippet(t, ["needle"]) for t in texts]
    assert S.snippet_terms('"Big Deal" AND not x') == ["big", "deal", "x"]

"""Ranges, sets, slop, beginnings of words and the query for every document."""

import random

import pytest

from tidewell.errors import QuerySyntaxError
from tidewell.operators import search as S
from tidewell.operators.search import Parser

WORDS = [a + b for a in ("ab", "ba", "ca", "da") for b in ("", "le", "re", "ss")]


@pytest.fixture(scope="module")
def box(spark):
    rng = random.Random(7)
    rows = [(i, " ".join(rng.choice(WORDS) for _ in range(12)), " ".join(rng.sample(WORDS, 2))) for i in range(60)] + [(60, "", "")]
    df = spark.createDataFrame(rows, "doc_id long, content string, title string")
    return {i: (c.split(), t.split()) for i, c, t in rows}, S.build_index(df, stemming=False)


def found(box, query):
    return {r.doc_id: r.score for r in S.match(box[1], query, {"content": 1.0, "title": 2.0}).collect()}


@pytest.mark.parametrize(
    ("query", "test"),
    [
        ("content:[bale TO cass]", lambda w: "bale" <= w <= "cass"),
        ("content:{bale TO cass}", lambda w: "bale" < w < "cass"),
        ("content:[bale TO cass}", lambda w: "bale" <= w < "cass"),
        ("content:[* TO abre]", lambda w: w <= "abre"),
        ("content:{dale TO *]", lambda w: w > "dale"),
        ("content:>dale", lambda w: w > "dale"),
        ("content:<=Able", lambda w: w <= "able"),
        ("content:IN [dale  Nowhere caress]", lambda w: w in ("dale", "caress")),
        ("content: IN [ab]", lambda w: w == "ab"),
        ('content:"dal"*', lambda w: w.startswith("dal")),
    ],
)
def test_terms(box, query, test):
    want = {i for i, (c, _) in box[0].items() if any(map(test, c))}
    got = found(box, query)
    assert set(got) == want and set(got.values()) <= {1.0}
    assert set(found(box, query + "^3").values()) <= {3.0}
    assert set(found(box, f"* -{query}")) == set(box[0]) - want


def test_every_document(box):
    assert found(box, "*") == {i: 1.0 for i in box[0]}
    both = found(box, "* AND content:abre")
    assert set(both) == {i for i, (c, _) in box[0].items() if "abre" in c} and all(v > 1 for v in both.values())


@pytest.mark.parametrize("slop", [0, 1, 2, 4])
def test_slop(box, slop):
    query = f'content:"ab dare"~{slop}' if slop else 'content:"ab dare"'
    want = {i for i, (c, _) in box[0].items() if any(abs(b - 1 - a) <= slop for a, x in enumerate(c) if x == "ab" for b, y in enumerate(c) if y == "dare")}
    assert set(found(box, query)) == want
    three = {i for i, (c, _) in box[0].items() if any(abs(b - 1 - a) + abs(d - 1 - b) <= slop for a, x in enumerate(c) if x == "ab" for b, y in enumerate(c) if y == "dare" for d, z in enumerate(c) if z == "ca")}
    assert set(found(box, f'content:"ab dare ca"~{slop}' if slop else 'content:"ab dare ca"')) == three


def test_beginnings(box):
    want = {i for i, (c, _) in box[0].items() if any(x == "ab" and y.startswith("da") for x, y in zip(c, c[1:], strict=False))}
    assert set(found(box, 'content:"ab da"*')) == want
    assert set(found(box, '"ab da"*')) == want | {i for i, (_, t) in box[0].items() if t[:1] == ["ab"] and t[1].startswith("da")}


@pytest.mark.parametrize("query", ["title:[a TO", "title:[a b]", "title:[a-b TO c]", "rust {a TO b", "title:> ", "title:IN [a"])
def test_bad_ranges(query):
    with pytest.raises(QuerySyntaxError):
        Parser(query, ["title"], ["title", "published_date"]).parse()


def test_brackets_elsewhere_are_words():
    Parser('a[1] "[a TO b]" IN', ["title"], ["title"]).parse()


def test_filters_reach_the_scan(spark, box, tmp_path):
    box[1].write(f"{tmp_path}/index")
    index = S.Index.read(spark, f"{tmp_path}/index", stemming=False)
    plan = lambda q: S.match(index, q, {"content": 1.0})._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(term, [ab,dare])]" in plan('"ab dare"') or "PushedFilters: [Or(" in plan('"ab dare"') or "In(term" in plan('"ab dare"')
    assert "PartitionFilters: [" in plan("ab") and "(field" in plan("ab").split("PartitionFilters: [")[1][:40]
    assert "GreaterThanOrEqual(term,bale)" in plan("content:[bale TO cass]")
    assert found((None, index), "ab dare") == found(box, "ab dare")

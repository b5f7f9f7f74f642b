"""Ranked full-text search: index tables, a query language, BM25, post-filters and snippets.

An index is three tables: ``docs`` (stored fields), ``postings`` (doc_id, field, term, tf, positions, len) and
``stats`` (field, n_docs, avg_len). A query is parsed on the driver into a tree over leaves; the leaves'
postings are picked by a filter on (field, term) that reaches the Parquet scan, scored, and brought together
in one aggregate over doc_id, where the tree is a column expression. Lengths are exact, not quantised.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import QuerySyntaxError
from ..functions.dates import parse_index_date, rfc3339
from ..functions.stemmer import stem, stem_all

K1, B = 1.2, 0.75
#: Tokens of this many bytes or more are dropped.
LONGEST_TOKEN = 40
SPLIT = r"[^\p{IsAlphabetic}\p{N}]+"
STEMMED = ("title", "content", "summary", "tags")
PLAIN = ("author", "feed_title")
BOOSTS = {"title": 2.0, "content": 1.0, "summary": 1.5, "tags": 1.0}
SNIPPET, SNIPPET_HEAD, SNIPPET_SCAN = 200, 40, 2000
OVERFETCH = 3
HALF_LIFE_DAYS, DECAY = 30.0, 0.693


# ------------------------------------------------------------------ index


def analyze(text: Column) -> Column:
    """array<struct<pos,term>>: lower-cased runs of letters and digits with their places."""
    tokens = F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda t: t != "")
    placed = F.transform(tokens, lambda t, i: F.struct(i.alias("pos"), F.lower(t).alias("term")))
    return F.filter(placed, lambda x: F.octet_length(x["term"]) < LONGEST_TOKEN)


def _stemmed(tokens: Column) -> Column:
    stems = stem_all(F.transform(tokens, lambda x: x["term"]))
    return F.transform(F.arrays_zip(tokens.alias("t"), stems.alias("s")), lambda x: F.struct(x["t"]["pos"].alias("pos"), x["s"].alias("term")))


def build_documents(articles: DataFrame, feeds: DataFrame, tags: DataFrame) -> DataFrame:
    """Extracted articles with feed title and tag text; tags(article_id, tag_text) and feeds(id, title)."""
    named = feeds.select(F.col("id").alias("feed_id"), F.col("title").alias("feed_title"))
    joined = articles.filter("content_extracted = 1").join(named, "feed_id", "left").join(tags.withColumnRenamed("article_id", "id"), "id", "left")
    text = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return joined.select(F.col("id").alias("doc_id"), text("title"), text("content"), text("summary"), text("author"), text("feed_title"), F.coalesce("tag_text", F.lit("")).alias("tags"), parse_index_date(F.col("published_at")).alias("published_at"))


@dataclass
class Index:
    docs: DataFrame
    postings: DataFrame
    stats: DataFrame
    stemming: bool = True

    def write(self, path: str) -> None:
        """A new directory; readers of an older one keep what they read. Postings lie by field, sorted by term."""
        self.docs.write.parquet(f"{path}/docs")
        self.postings.repartitionByRange("field", "term").sortWithinPartitions("field", "term").write.partitionBy("field").parquet(f"{path}/postings")
        self.stats.write.parquet(f"{path}/stats")

    @classmethod
    def read(cls, spark, path: str, stemming: bool = True) -> Index:
        return cls(spark.read.parquet(f"{path}/docs"), spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats"), stemming)

    def delete(self, ids: DataFrame) -> Index:
        gone = ids.select("doc_id")
        docs, postings = self.docs.join(gone, "doc_id", "left_anti"), self.postings.join(gone, "doc_id", "left_anti")
        return Index(docs, postings, field_stats(postings, docs), self.stemming)

    def upsert(self, documents: DataFrame) -> Index:
        """Replaces documents by id and adds new ones."""
        kept, new = self.delete(documents), build_index(documents, self.stemming)
        docs, postings = kept.docs.unionByName(new.docs), kept.postings.unionByName(new.postings)
        return Index(docs, postings, field_stats(postings, docs), self.stemming)


def build_index(documents: DataFrame, stemming: bool = True) -> Index:
    fields = [f for f in (*STEMMED, *PLAIN) if f in documents.columns]
    parts = []
    for f in fields:
        tokens = analyze(F.col(f))
        parts.append(F.struct(F.lit(f).alias("field"), (_stemmed(tokens) if stemming and f in STEMMED else tokens).alias("tokens")))
    each = documents.select("doc_id", F.explode(F.array(*parts)).alias("p")).select("doc_id", "p.field", F.size("p.tokens").alias("len"), F.explode("p.tokens").alias("t"))
    postings = each.groupBy("doc_id", "field", "len", F.col("t.term").alias("term")).agg(F.count("*").alias("tf"), F.sort_array(F.collect_list("t.pos")).alias("positions"))
    basic = F.col("field").isin(*PLAIN)  # these keep neither frequencies nor places
    postings = postings.select("doc_id", "field", "term", F.when(basic, 1).otherwise(F.col("tf")).alias("tf"), F.when(~basic, F.col("positions")).alias("positions"), F.col("len").cast("long").alias("len"))
    return Index(documents, postings, field_stats(postings, documents), stemming)


def schema_fields(index: Index) -> list[tuple[str, str]]:
    """The searchable fields of an index and how each is analysed: stemmed, or as plain words without places."""
    return [(f, "stemmed" if index.stemming else "words") if f in STEMMED else (f, "plain") for f in (*STEMMED, *PLAIN) if f in index.docs.columns]


def field_stats(postings: DataFrame, docs: DataFrame) -> DataFrame:
    """field, n_docs (of the whole index) and avg_len over all documents, those without a token in the field too."""
    total = docs.agg(F.count("*").alias("n_docs"))
    return postings.groupBy("field").agg(F.sum("tf").alias("tokens")).join(F.broadcast(total)).select("field", "n_docs", (F.col("tokens") / F.col("n_docs")).alias("avg_len"))


# ------------------------------------------------------------------ query language


@dataclass
class Leaf:
    """A term or, with several words, a phrase, in some fields; or a range or set of terms, or every document.

    ``slop`` is how far apart the words of a phrase may be moved in all; with ``prefix`` its last word is a beginning.
    """

    fields: list[str]
    words: list[str]
    boost: float = 1.0
    kind: str = "words"
    low: str | None = None
    high: str | None = None
    closed: tuple[bool, bool] = (True, True)
    slop: int = 0
    prefix: bool = False

    def __bool__(self) -> bool:
        return bool(self.words) or self.kind in ("range", "all")


@dataclass
class Node:
    """must, should and must_not parts of a boolean query."""

    must: list = field(default_factory=list)
    should: list = field(default_factory=list)
    must_not: list = field(default_factory=list)
    boost: float = 1.0


_TOKEN = re.compile(
    r"""\s*(?:
      (?P<op>AND|OR|NOT)(?=[\s()]|$)
    | (?P<sign>[+-])(?=\S)
    | (?P<paren>[()])
    | (?:(?P<field>\w+):\s*)?(?:
          (?P<open>[\[{])\s*(?P<low>[^\s\]}]+)\s+TO\s+(?P<high>[^\s\]}]+)\s*(?P<close>[\]}])
        | IN\s*\[(?P<set>[^\]]*)\]
        | (?P<compare>[<>]=?)(?P<bound>[^\s()^]+)
        | "(?P<phrase>[^"]*)"(?:~(?P<slop>\d+)|(?P<prefix>\*))?
        | (?P<word>[^\s()"^]+))
    | (?P<group>\w+):(?=\()
    )(?:\^(?P<boost>\d+(?:\.\d+)?))?""",
    re.VERBOSE,
)


def query_words(text: str) -> list[str]:
    return [w.lower() for w in re.split(r"[\W_]+", text) if w and len(w.encode()) < LONGEST_TOKEN]


class Parser:
    """Recursive descent: OR of ANDs of signed or negated clauses; clauses side by side are optional."""

    def __init__(self, text: str, default: list[str], known: list[str]) -> None:
        self.default, self.known, self.tokens, at = default, known, [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m or m.end() == at:
                raise QuerySyntaxError(f"at {text[at : at + 20]!r}")
            if (m["word"] or "").startswith(("[", "{")):
                raise QuerySyntaxError(f"a range or set is not closed: {text[at : at + 20]!r}")
            self.tokens.append(m)
            at = m.end()
        self.at = 0

    def peek(self, kind: str, value: str | None = None) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][kind] is not None and value in (None, self.tokens[self.at][kind])

    def parse(self) -> Node:
        out = self.either(None)
        if self.at < len(self.tokens):
            raise QuerySyntaxError("unbalanced parenthesis")
        return out

    def either(self, fields: list[str] | None) -> Node:
        """Clauses up to the end of the group."""
        node, chain, joined = Node(), [], False

        def flush() -> None:
            if len(chain) > 1:
                node.should.append(Node(must=[c for s, c in chain if s != "-"], must_not=[c for s, c in chain if s == "-"]))
            elif chain:
                {"+": node.must, "-": node.must_not}.get(chain[0][0], node.should).append(chain[0][1])
            chain.clear()

        while self.at < len(self.tokens) and not self.peek("paren", ")"):
            if self.peek("op", "AND") or self.peek("op", "OR"):
                joined = self.tokens[self.at]["op"] == "AND"
                if not chain:
                    raise QuerySyntaxError("an operator needs a clause before it")
                self.at += 1
                if self.at == len(self.tokens) or self.peek("paren", ")"):
                    raise QuerySyntaxError("an operator needs a clause after it")
                if not joined:
                    flush()
                continue
            if chain and not joined:
                flush()
            chain.append(self.clause(fields))
            joined = False
        flush()
        return node

    def clause(self, fields: list[str] | None) -> tuple[str, Node | Leaf]:
        sign = ""
        if self.peek("op", "NOT"):
            sign, self.at = "-", self.at + 1
        elif self.peek("sign"):
            sign, self.at = self.tokens[self.at]["sign"], self.at + 1
        if self.at == len(self.tokens):
            raise QuerySyntaxError("a sign needs a clause")
        m = self.tokens[self.at]
        self.at += 1
        if m["group"] or m["paren"] == "(":
            if m["group"]:
                fields, self.at = self.named(m["group"]), self.at + 1
            inner = self.either(fields)
            if not self.peek("paren", ")"):
                raise QuerySyntaxError("unbalanced parenthesis")
            inner.boost = float(self.tokens[self.at]["boost"] or 1)
            self.at += 1
            return sign, inner
        own = self.named(m["field"]) if m["field"] else (fields or self.default)
        boost = float(m["boost"] or 1)
        if m["open"]:
            low, high = (None if x == "*" else self.bound(x) for x in (m["low"], m["high"]))
            return sign, Leaf(own, [], boost, "range", low, high, (m["open"] == "[", m["close"] == "]"))
        if m["compare"]:
            above, equal = m["compare"][0] == ">", m["compare"].endswith("=")
            value = self.bound(m["bound"])
            return sign, Leaf(own, [], boost, "range", value if above else None, None if above else value, (equal, equal))
        if m["set"] is not None:
            return sign, Leaf(own, [w for x in m["set"].split() for w in query_words(x)], boost, "set")
        if m["word"] == "*" and not m["field"]:
            return sign, Leaf(own, [], boost, "all")
        if m["phrase"] is None and m["word"] in (None, "+", "-", "<", ">", "<=", ">="):
            raise QuerySyntaxError("a clause is missing")
        words = query_words(m["phrase"] if m["phrase"] is not None else m["word"])
        return sign, Leaf(own, words, boost, slop=int(m["slop"] or 0), prefix=bool(m["prefix"]))

    def bound(self, text: str) -> str:
        words = query_words(text)
        if len(words) != 1:
            raise QuerySyntaxError(f"a bound is one word: {text!r}")
        return words[0]

    def named(self, name: str) -> list[str]:
        if name not in self.known:
            raise QuerySyntaxError(f"no field {name}")
        return [name]


def parse_query(text: str, fields: list[str] | None = None, known: list[str] | None = None) -> Node:
    return Parser(text, fields or list(BOOSTS), known or [*STEMMED, *PLAIN]).parse()


def leaves(node: Node | Leaf) -> list[Leaf]:
    return [node] if isinstance(node, Leaf) else [x for part in (node.must, node.should, node.must_not) for c in part for x in leaves(c)]


# ------------------------------------------------------------------ ranking


def _bm25(tf: Column, length: Column, average: Column, idf: Column) -> Column:
    return idf * (K1 + 1) * tf / (tf + K1 * (1 - B + B * length / average))


def match(index: Index, query: str | Node, boosts: dict[str, float] | None = None) -> DataFrame:
    """doc_id and score (double) of all documents that match."""
    boosts = boosts or BOOSTS
    tree = parse_query(query, list(boosts)) if isinstance(query, str) else query
    every = [x for x in leaves(tree) if x]
    spark = index.docs.sparkSession
    if not every:
        return spark.createDataFrame([], "doc_id long, score double")
    shape = lambda w, f: stem(w) if index.stemming and f in STEMMED else w

    def exact(x: Leaf) -> list[str]:
        """The words that are looked up as terms; the last of a prefix phrase is not."""
        return x.words[:-1] if x.prefix else x.words

    def within(x: Leaf, f: str) -> Column:
        """Whether a posting's term lies in a range, or begins as the last word of a prefix phrase."""
        if x.prefix:
            return (F.col("field") == f) & F.col("term").startswith(x.words[-1])
        low, high = (F.col("term") >= shape(x.low, f) if x.closed[0] else F.col("term") > shape(x.low, f)) if x.low else F.lit(True), (F.col("term") <= shape(x.high, f) if x.closed[1] else F.col("term") < shape(x.high, f)) if x.high else F.lit(True)
        return (F.col("field") == f) & low & high

    wanted = sorted({(f, shape(w, f)) for x in every for f in x.fields for w in exact(x)})
    spread = [within(x, f) for x in every if x.kind == "range" or x.prefix for f in x.fields]
    either = lambda conditions: reduce(lambda a, b: a | b, conditions)
    # Postings of given terms get weights; those of ranges and beginnings, whose terms may be many, need none.
    parts = []
    if wanted:
        picked = index.postings.filter(either([(F.col("field") == f) & F.col("term").isin([t for g, t in wanted if g == f]) for f in sorted({f for f, _ in wanted})]))
        df = picked.groupBy("field", "term").agg(F.count("*").alias("df"))  # a row for each term of the query
        hits = picked.join(F.broadcast(df), ["field", "term"]).join(F.broadcast(index.stats), "field")
        idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
        length = F.when(F.col("field").isin(*PLAIN), F.col("avg_len")).otherwise(F.col("len"))
        hits = hits.withColumn("idf", idf).withColumn("w", _bm25(F.col("tf"), length, F.col("avg_len"), F.col("idf")))
        parts.append(hits.select("doc_id", "field", "term", "positions", "len", "avg_len", "idf", "w"))
    none = F.lit(None).cast("double")
    if spread:
        parts.append(index.postings.filter(either(spread)).select("doc_id", "field", "term", "positions", "len", none.alias("avg_len"), none.alias("idf"), none.alias("w")))
    if any(x.kind == "all" for x in every):
        text = F.lit(None).cast("string")
        parts.append(index.docs.select("doc_id", text.alias("field"), text.alias("term"), F.lit(None).cast("array<int>").alias("positions"), F.lit(None).cast("long").alias("len"), none.alias("avg_len"), none.alias("idf"), none.alias("w")))
    hits = reduce(DataFrame.unionByName, parts)

    columns: list[Column] = []
    scores: dict[int, Column] = {}
    for n, leaf in enumerate(every):
        terms = []
        if leaf.kind == "all":
            columns.append(F.max(F.lit(leaf.boost)).alias(f"s{n}"))
            terms.append(F.col(f"s{n}"))
        for f in leaf.fields if leaf.kind != "all" else []:
            boost = leaf.boost * boosts.get(f, 1.0)
            words = [shape(w, f) for w in exact(leaf)]
            at = lambda w, f=f: (F.col("field") == f) & (F.col("term") == w)
            if leaf.kind != "words" or (leaf.prefix and not words):  # these do not rank: they score as their boost
                found = within(leaf, f) if leaf.kind != "set" else (F.col("field") == f) & F.col("term").isin(words)
                columns.append(F.max(F.when(found, F.lit(leaf.boost))).alias(f"s{n}_{f}"))
                terms.append(F.col(f"s{n}_{f}"))
                continue
            if len(words) == 1 and not leaf.prefix:
                columns.append(F.sum(F.when(at(words[0]), F.col("w") * boost)).alias(f"s{n}_{f}"))
                terms.append(F.col(f"s{n}_{f}"))
                continue
            if f in PLAIN:
                continue  # no places are kept there
            for k, w in enumerate(words):
                moved = F.transform("positions", _minus(k))
                columns.append(F.max(F.when(at(w), F.struct(moved.alias("p"), F.col("idf").alias("idf"), F.col("len").alias("len"), F.col("avg_len").alias("avg")))).alias(f"p{n}_{f}_{k}"))
            sides = [F.col(f"p{n}_{f}_{k}") for k in range(len(words))]
            places = [p["p"] for p in sides]
            if leaf.prefix:
                columns.append(F.flatten(F.collect_list(F.when(within(leaf, f), F.transform("positions", _minus(len(words)))))).alias(f"q{n}_{f}"))
                places.append(F.col(f"q{n}_{f}"))
            tf = _close(places, leaf.slop) if leaf.slop else F.size(reduce(F.array_intersect, places))
            total = reduce(lambda a, b: a + b, [p["idf"] for p in sides])
            terms.append(F.when(tf > 0, _bm25(tf, sides[0]["len"], sides[0]["avg"], total) * boost))
        scores[id(leaf)] = (F.greatest(*terms) if len(terms) > 1 else terms[0] if terms else none) if leaf.kind != "words" or (leaf.prefix and len(leaf.words) == 1) else _total(terms)

    def evaluate(node: Node | Leaf) -> Column:
        """Score of a node, null where it does not match."""
        if isinstance(node, Leaf):
            return scores.get(id(node), F.lit(None).cast("double"))
        must, should, never = ([evaluate(c) for c in part] for part in (node.must, node.should, node.must_not))
        total = _total(should) if should else F.lit(None).cast("double")
        if must:
            every = reduce(lambda a, b: a + b, must)
            total = every + F.coalesce(total, F.lit(0.0)) if should else every
        for c in never:
            total = F.when(c.isNull(), total)
        return total * node.boost

    score = F.round(evaluate(tree), 9).alias("score")  # so that the order of sums does not decide ties
    return hits.groupBy("doc_id").agg(*columns).select("doc_id", score).filter("score IS NOT NULL")


def _minus(k: int):
    return lambda p: p - k


def _close(places: list[Column], slop: int) -> Column:
    """How many places of the first word go on through all words with moves of at most ``slop`` in all."""
    moved = lambda a, p: a["cost"] + F.abs(a["p"] - p)
    cheapest = lambda paths: lambda p: F.struct(p.alias("p"), F.array_min(F.transform(paths, lambda a: moved(a, p))).alias("cost"))
    paths = F.transform(places[-1], lambda p: F.struct(p.alias("p"), F.lit(0).alias("cost")))
    for here in reversed(places[:-1]):
        paths = F.filter(F.transform(here, cheapest(paths)), lambda a: a["cost"] <= slop)
    return F.coalesce(F.size(F.filter(paths, lambda a: a["cost"] <= slop)), F.lit(0))


def _total(parts: list[Column]) -> Column:
    """The sum of what is not null; null where nothing is."""
    if not parts:
        return F.lit(None).cast("double")
    some = reduce(lambda a, b: a | b, [p.isNotNull() for p in parts])
    return F.when(some, reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) for p in parts]))


# ------------------------------------------------------------------ snippets and the search itself


def snippet_terms(query: str) -> list[str]:
    """Words of the query in lower case without and, or, not and quotes; field names and signs stay."""
    return [t for w in query.lower().split() if w not in ("and", "or", "not") and (t := w.strip('"'))]


def snippet(content: Column, terms: list[str]) -> Column:
    """About SNIPPET characters from the earliest hit in the first SNIPPET_SCAN, at word borders, with dots where cut."""
    head = F.lower(F.substring(content, 1, SNIPPET_SCAN))
    found = [F.nullif(F.locate(t, head), F.lit(0)) for t in terms]
    hit = (F.least(*found) if len(found) > 1 else found[0] if found else F.lit(None).cast("int")) - 1
    hit = F.coalesce(hit, F.lit(0))
    before = F.locate(" ", F.reverse(F.substring(content, F.lit(1), hit)))
    start = F.when(hit > SNIPPET_HEAD, F.when(before > 0, hit - before + 1).otherwise(hit - SNIPPET_HEAD)).otherwise(F.lit(0))
    rest = F.substring(content, start + SNIPPET + 1, F.length(content))
    space = F.locate(" ", rest)
    end = F.when(start + SNIPPET >= F.length(content), F.length(content)).when(space > 0, start + SNIPPET + space - 1).otherwise(F.length(content))
    body = F.substring(content, start + 1, end - start)
    return F.concat(F.when(start > 0, F.lit("...")).otherwise(F.lit("")), body, F.when(end < F.length(content), F.lit("...")).otherwise(F.lit("")))


@dataclass
class SearchOptions:
    limit: int = 20
    offset: int = 0
    date_from: str | None = None
    date_to: str | None = None
    feed_filter: list[str] | None = None
    sort_by: str = "relevance"
    recency_boost: bool = False
    as_of: str | None = None
    overfetch: bool = False


def search(index: Index, query: str, options: SearchOptions | None = None, boosts: dict[str, float] | None = None) -> DataFrame:
    """article_id, score, title, snippet, published_at (RFC 3339) and feed_title of one page of hits.

    Filters come before offset and limit, unless ``overfetch`` asks for the parity mode: then only the best
    OVERFETCH pages are filtered. Recency boost and date order apply to the page that was selected.
    """
    o = options or SearchOptions()
    hits, docs = match(index, query, boosts), index.docs
    filtered = o.date_from is not None or o.date_to is not None or o.feed_filter is not None
    ranked = lambda df: df.orderBy(F.col("score").desc(), "doc_id")
    if o.overfetch and filtered:
        hits = ranked(hits).limit((o.offset + o.limit) * OVERFETCH)
    stored = docs.select("doc_id", "title", "content", "published_at", "feed_title") if filtered else None
    if stored is not None:
        hits = hits.join(docs.select("doc_id", "published_at", "feed_title"), "doc_id")
        for bound, keep in ((o.date_from, lambda c, b: c >= b), (o.date_to, lambda c, b: c <= b)):
            if bound is not None:
                hits = hits.filter(keep(F.col("published_at"), F.to_timestamp(F.lit(bound))))
        if o.feed_filter is not None:
            hits = hits.filter(F.col("feed_title").isin(*o.feed_filter) if o.feed_filter else F.lit(False))
        hits = hits.select("doc_id", "score")
    page = ranked(hits).offset(o.offset).limit(o.limit) if o.offset else ranked(hits).limit(o.limit)
    joined = docs.join(F.broadcast(page), "doc_id")  # at most limit rows
    score = F.col("score")
    if o.recency_boost:
        now = F.to_timestamp(F.lit(o.as_of)) if o.as_of else F.current_timestamp()
        age = F.greatest(F.lit(0.0), (F.unix_timestamp(now) - F.unix_timestamp("published_at")) / 86400.0)
        score = F.coalesce(score * (1 + F.exp(-age / HALF_LIFE_DAYS * DECAY)), score)
    out = joined.select(
        F.col("doc_id").alias("article_id"), score.cast("float").alias("score"), "title", snippet(F.col("content"), snippet_terms(query)).alias("snippet"), rfc3339(F.col("published_at")).alias("published_at"), "feed_title"
    )
    if o.sort_by == "date":
        return out.orderBy(F.col("published_at").desc_nulls_last(), "article_id")
    return out.orderBy(F.col("score").desc(), "article_id")

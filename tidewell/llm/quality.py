"""Quality rules: thresholds that adapt to each language and source, from mergeable quantile sketches.

Every document gets integer metrics. Each (language, source) group keeps one sketch a metric: counts
in logarithmic buckets (the layout of DDSketch: relative error GAMMA - 1), which merge by addition, so
partial sketches are summed before the shuffle and a hot source costs no more than a cold one. A
group with fewer than ``min_docs`` documents uses the merged sketch of its language, and that of all
documents below that. The fences of a metric lie a multiple of the spread of its middle half beyond that half;
documents beyond any fence are rejected. No cutoff is fixed: where a group's documents are all alike, its fences
are narrow, and a spread below a FLAT-th of the value counts as that. Of what most texts lack (marks, repeated
lines, words said twice) the first RARE in a text and one in a hundred words are not counted, nor are the first FEW
short words, as a spread of nothing says little.

Defined results: a null text has no words and fails the base rule; null languages and sources are
groups of their own; repeated rows are judged alike; an empty table gives an empty result; further
input columns are passed through ``filter_quality`` untouched, whatever their names.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import SPACE, let, materialize, nonnull_text, words_of

GAMMA = 1.01
FLAT, RARE, FEW = 20, 4, 2
#: Groups up to which the table of fences goes to every executor (some 100 bytes each).
BROADCAST_GROUPS = 20_000
#: Fixed values of the base rule.
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = "[#*$%&|<>]"


@dataclass(frozen=True)
class Rule:
    """Reject a metric above q(high) + above * spread, or below q(low) - below * spread, where given."""

    metric: str
    above: int
    below: int | None = None
    low: int = 25
    high: int = 75


#: Metrics are in hundredths, or, with _bp, in hundredths of a percent.
RULES = (
    Rule("marks_bp", 3),
    Rule("dup_lines_bp", 3),
    Rule("stutter_bp", 6),
    Rule("caps_bp", 6),
    Rule("word_chars_avg", 3, 3),
    Rule("short_bp", 3, 3),
    Rule("line_words_avg", 6),
)
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Words inside windows that occur twice or more in the text, the first occurrence included."""

    def windows(h: Column) -> Column:
        hashed = F.transform(h, lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, window)]))
        return F.slice(hashed, F.lit(1), F.size(h) - (window - 1))

    def covered(w: Column) -> Column:
        placed = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def positions(s: Column) -> Column:
            same = lambda x, j: F.coalesce(x["h"] == F.get(s, j)["h"], F.lit(False))
            return F.sort_array(F.transform(F.filter(s, lambda x, i: same(x, i - 1) | same(x, i + 1)), lambda x: x["i"]))

        start = F.struct(F.lit(0).alias("end"), F.lit(0).alias("total"))
        step = lambda a, p: F.struct((p + window).alias("end"), (a["total"] + p + window - F.greatest(a["end"], p)).alias("total"))
        return F.aggregate(let(placed, positions), start, step, lambda a: a["total"])

    found = let(
        F.transform(words, lambda w: F.xxhash64(w)),
        lambda h: let(windows(h), lambda w: F.when(F.size(F.array_distinct(w)) < F.size(w), covered(w)).otherwise(F.lit(0))),
    )
    return F.when(F.size(words) <= window, F.lit(0)).otherwise(found).cast("long")


def measure(text: Column) -> Column:
    """The struct of counts and metrics of a whole text, as one expression that computes each part once."""
    chars = lambda t, pattern: (F.length(t) - F.length(F.regexp_replace(t, f"{pattern}+", ""))).cast("long")

    def counts(t: Column, words: Column, lines: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
            chars(t, SYMBOLS).alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeated_words(words).alias("n_repeat_words"),
            F.size(lines).cast("long").alias("n_lines"),
            F.size(F.filter(words, lambda w: F.length(w) <= 3)).cast("long").alias("n_short"),
            F.size(F.filter(words, lambda w, i: w == F.get(words, i - 1))).cast("long").alias("n_stutters"),
            chars(t, r"\p{Lu}").alias("n_caps"),
            chars(t, r"[!?#*$%&|<>=~^_{}\[\]\\]").alias("n_marks"),
        )

    def shares(c: Column) -> Column:
        share = lambda part, whole, times: F.floor(part * times / F.greatest(c[whole], F.lit(1))).cast("long")
        beyond = lambda part: F.greatest(c[part] - RARE - F.floor(c["n_words"] / 100), F.lit(0))
        return F.struct(
            *[c[name].alias(name) for name in METRICS],
            share(beyond("n_marks"), "word_chars", 10000).alias("marks_bp"),
            share(beyond("n_dup_lines"), "n_lines", 10000).alias("dup_lines_bp"),
            share(beyond("n_stutters"), "n_words", 10000).alias("stutter_bp"),
            share(c["n_caps"], "word_chars", 10000).alias("caps_bp"),
            share(c["word_chars"], "n_words", 100).alias("word_chars_avg"),
            share(F.greatest(c["n_short"] - FEW, F.lit(0)), "n_words", 10000).alias("short_bp"),
            share(c["n_words"], "n_lines", 100).alias("line_words_avg"),
        )

    lines = lambda t: F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    return let(nonnull_text(text), lambda t: let(words_of(t), lambda w: let(lines(t), lambda n: let(counts(t, w, n), shares))))


def metrics(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds a struct column ``m`` with the counts and metrics of each whole text."""
    return docs.withColumn("m", measure(F.col(text)))


def bucket(value: Column) -> Column:
    """The sketch's bucket of a whole number: 0 for 0, else 1 + floor(log_GAMMA value)."""
    return F.when(value <= 0, F.lit(0)).otherwise(F.floor(F.log(value.cast("double")) / F.lit(math.log(GAMMA))).cast("int") + 1)


def upper_value(b: Column) -> Column:
    """The largest value of a bucket."""
    return F.when(b <= 0, F.lit(0.0)).otherwise(F.pow(F.lit(GAMMA), b.cast("double")))


def buckets_of(m: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<metric,bucket>> of a struct of metrics; null for a text without words."""
    pairs = F.array(*[F.struct(F.lit(r.metric).alias("metric"), bucket(m[r.metric]).alias("bucket")) for r in rules])
    return F.when(m["n_words"] > 0, pairs)


def sketches(rows: DataFrame, buckets: Column) -> DataFrame:
    """One row for each group, metric and bucket with the count of documents that have words."""
    each = rows.select("lang", "source", F.explode(buckets).alias("p"))
    return each.groupBy("lang", "source", "p.metric", "p.bucket").agg(F.count("*").alias("n"))


def merge_sketches(sketch: DataFrame, *keys: str) -> DataFrame:
    return sketch.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))


def _fences(sketch: DataFrame, keys: list[str], rules: tuple[Rule, ...]) -> DataFrame:
    """Per key: the count of documents and a fence for each metric, as columns."""
    w = Window.partitionBy(*keys, "metric")
    summed = sketch.withColumn("upto", F.sum("n").over(w.orderBy("bucket"))).withColumn("total", F.sum("n").over(w))
    at = lambda q: F.min(F.when(F.col("upto") * 100 >= F.col("total") * q, F.col("bucket")))
    of_metric = {r.metric: r for r in rules}
    pick = lambda what: F.create_map(*[x for m, r in of_metric.items() for x in (F.lit(m), F.lit(getattr(r, what)).cast("int"))])[F.col("metric")]
    quantiles = summed.groupBy(*keys, "metric").agg(F.max("total").alias("total"), at(pick("low")).alias("lo"), at(pick("high")).alias("hi"))
    lo, hi = upper_value(F.col("lo")), upper_value(F.col("hi"))
    spread = F.greatest(hi - lo, hi / FLAT)
    limits = quantiles.withColumn("fence", F.struct((hi + pick("above") * spread).alias("above"), (lo - pick("below") * spread).alias("below")))
    return limits.groupBy(*keys).agg(F.max("total").alias("total"), *[F.max(F.when(F.col("metric") == m, F.col("fence"))).alias(m) for m in of_metric])


def thresholds(sketch: DataFrame, rules: tuple[Rule, ...] = RULES, min_docs: int = 100) -> DataFrame:
    """One row for each (lang, source): its fences, from the smallest merged sketch of enough documents."""
    names = [r.metric for r in rules]
    key = lambda level: F.struct(F.lit(level).alias("level"), *[F.when(F.lit(level) <= k, F.col(c)).alias(c) for k, c in ((1, "lang"), (0, "source"))])
    every = sketch.select(F.explode(F.array(*[key(level) for level in range(3)])).alias("key"), "metric", "bucket", "n")
    fences = _fences(merge_sketches(every, "key"), ["key"], rules).filter((F.col("total") >= min_docs) | (F.col("key.level") == 2))
    groups = sketch.select("lang", "source").distinct().withColumn("key", F.explode(F.array(*[key(level) for level in range(3)])))
    joined = groups.join(fences, "key")
    chosen = F.min_by(F.struct(*names), F.col("key.level")).alias("f")
    return joined.groupBy(F.col("lang").alias("_lang"), F.col("source").alias("_source")).agg(chosen)


def verdict(m: Column, fences: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """struct<base_failed,reasons,kept> of a struct of metrics; reasons are the metrics beyond a fence, with + above and - below."""
    base = (m["n_words"] < MIN_WORDS) | (m["n_repeat_words"] * 100 > m["n_words"] * MAX_REPEAT_PERCENT)
    beyond = F.array_compact(F.array(*[F.when(m[r.metric] > fences[r.metric]["above"], F.lit(f"+{r.metric}")).when(m[r.metric] < fences[r.metric]["below"], F.lit(f"-{r.metric}")) for r in rules]))
    return F.struct(base.alias("base_failed"), beyond.alias("reasons"), (~base & (F.size(beyond) == 0)).alias("kept"))


def with_fences(rows: DataFrame, sketch: DataFrame, rules: tuple[Rule, ...] = RULES, min_docs: int = 100) -> DataFrame:
    """Adds the struct ``f`` of the fences of a row's lang and source."""
    limits = materialize(thresholds(sketch, rules, min_docs), "limits")
    if limits.limit(BROADCAST_GROUPS + 1).count() <= BROADCAST_GROUPS:
        limits = F.broadcast(limits)  # else the rows are shuffled by group, and Spark splits a hot one
    return rows.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left").drop("_lang", "_source")


def score_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_docs: int = 100) -> DataFrame:
    """doc_id, lang, source, m, base_failed, reasons and kept for each row of docs."""
    measured = materialize(metrics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    judged = with_fences(measured, sketches(measured, buckets_of(F.col("m"), rules)), rules, min_docs).withColumn("v", verdict(F.col("m"), F.col("f"), rules))
    return judged.select("doc_id", "lang", "source", "m", "v.*")


def filter_quality(docs: DataFrame, rules: tuple[Rule, ...] = RULES, min_docs: int = 100) -> DataFrame:
    """The rows of docs that the rules keep, with the columns of docs.

    Metrics are computed once and written with the rows, which are read again for the verdicts.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = materialize(docs.select(row, "lang", "source", measure(F.col("text")).alias("m")), "measured")
    judged = with_fences(rows, sketches(rows, buckets_of(F.col("m"), rules)), rules, min_docs)
    return judged.filter(verdict(F.col("m"), F.col("f"), rules)["kept"]).select("row.*")


def op8_quality(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score_quality(docs).select("doc_id", *[f"m.{c}" for c in METRICS], "base_failed", "kept", F.concat_ws(",", "reasons").alias("reasons"))

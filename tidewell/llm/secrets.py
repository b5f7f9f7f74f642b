"""Secret scans: patterns, and sliding-window Shannon entropy per character class over candidates.

Three patterns give the base spans. The entropy method adds spans: candidate strings (runs of at least
``window`` characters of the base64 and hex alphabets that hold a letter and a digit) are put in a
character class, and a window slides over each while counts of its characters are kept up incrementally
(one character in, one out, and the sum of c * log2 c with them). Where the entropy of some window
reaches the threshold of the class, the stretch from the first to the last such window is a span.
An allow-list suppresses candidates that are identifiers by form, and cuts examples and fillers out of candidates,
so that what stands beside them is judged by itself; base spans stay always.

Everything is native: expressions over one row, no shuffle, so a plan is one scan with a projection.

Defined results: a null or empty text has no spans; offsets are code points, the end exclusive; equal
rows get equal results; an empty table gives an empty result; further columns pass through ``redact``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, nonnull_text

#: Fixed values of the base patterns; of the keyword, letters match in either case.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 12, 18, 16

WINDOW = 20
CANDIDATE = r"[A-Za-z0-9+/_=-]{%d,}"
#: Class of a candidate: its name, the pattern of the whole candidate, alphabet, bits that a window must reach.
CLASSES = (
    ("entropy_hex", r"^[0-9a-fA-F]+$", "0123456789abcdefABCDEF", 2.9),
    ("entropy_alnum", r"^[0-9A-Za-z]+$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 3.7),
    ("entropy_base64", r"^.*$", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-", 3.7),
)
#: Forms of harmless candidates (UUIDs, dates, plain snake or kebab words, paths). Java matches repeated
#: groups by recursion unless they are possessive, and candidates may be very long.
ALLOWED = (
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
    r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[0-9T_-]*$",
    r"^/?(?:[A-Za-z]+[0-9]{0,4}[/_=-])*+[A-Za-z]*[0-9]{0,4}$",
)
#: Examples and fillers, whose characters are no candidate; letters match in either case. By length.
HARMLESS = {5: "dummy|your[_-]", 6: "sample", 7: "example", 8: "changeme|abcdefgh", 10: "0123456789", 11: "placeholder"}
#: A run of one character that counts as a filler.
FILLER = 6


def matches(text: Column, pattern: str, guard: str, keep=None) -> Column:
    """array<struct<start,end>> of the leftmost non-overlapping matches; guard is a cheap necessary pattern."""
    span = "array<struct<start:int,end:int>>"

    def placed(pieces: Column, found: Column, kept: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            start = a["at"] + F.length(F.get(pieces, i))
            end = start + F.length(F.get(found, i))
            one = F.when(F.get(kept, i), F.array(F.struct(start.alias("start"), end.alias("end")))).otherwise(F.array().cast(span))
            return F.struct(end.alias("at"), F.concat(a["spans"], one).alias("spans"))

        zero = F.struct(F.lit(0).alias("at"), F.array().cast(span).alias("spans"))
        return F.when(F.size(found) > 0, F.aggregate(F.sequence(F.lit(0), F.size(found) - 1), zero, step, lambda a: a["spans"])).otherwise(F.array().cast(span))

    every = lambda group: F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    kept = keep(every) if keep else F.transform(every(0), lambda x: F.lit(True))
    whole = let(F.split(text, pattern, -1), lambda p: let(every(0), lambda f: let(kept, lambda k: placed(p, f, k))))
    return F.when(text.rlike(guard), whole).otherwise(F.array().cast(span))


def base_spans(text: Column) -> dict[str, Column]:
    """The spans of the three base patterns, by kind."""
    return {
        "assign": matches(text, ASSIGN, r"(?i:passw|secret|token|api_?key)", lambda every: F.transform(every(2), lambda x: F.length(x) >= MIN_ASSIGN)),
        "access": matches(text, r"AKIA[A-Z0-9]{%d,}" % (MIN_ACCESS - 4), "AKIA[A-Z0-9]{14}"),
        "hex": matches(text, r"[0-9a-f]{%d,}" % MIN_HEX, "[0-9a-f]{16}"),
    }


def hot_stretch(candidate: Column, alphabet: str, bits: float, window: int = WINDOW) -> Column:
    """struct<start,end> within a candidate from the first to the last window of enough entropy, or null."""
    weight = [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    #: H = log2 window - sum / window >= bits; the slack takes up the rounding of sums.
    most = (math.log2(window) - bits) * window + 1e-9
    table = F.array(*[F.lit(w) for w in weight])

    def over(codes: Column) -> Column:
        def step(a: Column, i: Column) -> Column:
            into, out = F.get(codes, i), F.get(codes, i - window)
            had = F.get(a["counts"], into)
            lost = F.get(a["counts"], out) + F.when(into == out, 1).otherwise(0)
            total = a["total"] - F.get(table, had) + F.get(table, had + 1)
            total = total + F.when(out.isNotNull(), F.get(table, lost - 1) - F.get(table, lost)).otherwise(F.lit(0.0))
            counts = F.transform(a["counts"], lambda c, k: c + F.when(k == into, 1).otherwise(0) - F.when(k == out, 1).otherwise(0))
            return let(
                F.struct(total.alias("total"), counts.alias("counts")),
                lambda n: F.struct(
                    n["counts"].alias("counts"),
                    n["total"].alias("total"),
                    F.when((i + 1 >= window) & (n["total"] <= most), F.coalesce(a["first"], i + 1 - window)).otherwise(a["first"]).alias("first"),
                    F.when((i + 1 >= window) & (n["total"] <= most), i + 1).otherwise(a["last"]).alias("last"),
                ),
            )

        zero = F.struct(F.array_repeat(F.lit(0), len(alphabet)).alias("counts"), F.lit(0.0).alias("total"), F.lit(None).cast("int").alias("first"), F.lit(None).cast("int").alias("last"))
        end = lambda a: F.when(a["first"].isNotNull(), F.struct(a["first"].alias("start"), a["last"].alias("end")))
        return F.aggregate(F.sequence(F.lit(0), F.size(codes) - 1), zero, step, end)

    codes = F.transform(F.split(candidate, ""), lambda c: F.instr(F.lit(alphabet), c) - 1)
    return let(F.filter(codes, lambda c: c >= 0), over)


def without_harmless(text: Column) -> Column:
    """The text with spaces in place of examples and fillers, so that all places stay."""
    out, run = text, r"([A-Za-z0-9+/_=-])\1{%d}" % (FILLER - 1)
    for length, form in HARMLESS.items():
        out = F.regexp_replace(out, f"(?i:{form})", " " * length)
    out = F.regexp_replace(out, run, " " * FILLER)
    return F.when(text.rlike(f"(?i:{'|'.join(HARMLESS.values())})|{run}"), out).otherwise(text)


def entropy_spans(text: Column, window: int = WINDOW, classes=CLASSES, allowed=ALLOWED) -> Column:
    """array<struct<start,kind,end>> that the entropy method adds; kinds are numbered after the base kinds."""
    guard = f"[A-Za-z0-9+/_=-]{{{window}}}"
    test = lambda every: F.transform(every(0), plausible(allowed))
    spans = F.when(text.rlike(guard), let(without_harmless(text), lambda t: matches(t, CANDIDATE % window, guard, test))).otherwise(F.array().cast("array<struct<start:int,end:int>>"))

    def judged(s: Column) -> Column:
        def body(c: Column) -> Column:
            out = F.lit(None).cast("struct<start:int,kind:int,end:int>")
            for n, (_, form, alphabet, bits) in reversed(list(enumerate(classes))):
                hot = let(hot_stretch(c, alphabet, bits, window), of_kind(3 + n, s["start"]))
                out = F.when(c.rlike(form), hot).otherwise(out)
            return out

        return let(F.substring(text, s["start"] + 1, s["end"] - s["start"]), body)

    return F.filter(F.transform(spans, judged), lambda x: x.isNotNull())


def plausible(allowed):
    """A test for candidates: a letter and a digit, and no form of the allow-list."""

    def test(c: Column) -> Column:
        ok = c.rlike("[A-Za-z]") & c.rlike("[0-9]")
        for form in allowed:
            ok = ok & ~c.rlike(form)
        return ok

    return test


KINDS = ("assign", "access", "hex", *[c[0] for c in CLASSES])


def of_kind(kind: int, offset: Column | int = 0):
    """Makes a span of that kind, moved by offset, of a struct with start and end; null stays null."""
    return lambda x: F.when(x.isNotNull(), F.struct((x["start"] + offset).alias("start"), F.lit(kind).alias("kind"), (x["end"] + offset).alias("end")))


def scan(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base_found`` and ``found``: array<struct<start,kind,end>> in order, kind an index of KINDS."""
    t = nonnull_text(F.col(text))
    base = base_spans(t)
    numbered = [F.transform(s, of_kind(k)) for k, s in enumerate(base.values())]
    out = docs.withColumn("base_found", F.sort_array(F.concat(*numbered)))
    return out.withColumn("found", F.sort_array(F.concat("base_found", entropy_spans(t))))


def as_text(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with every stretch that spans cover, overlapping ones merged, replaced by a mark."""

    def step(a: Column, s: Column) -> Column:
        fresh = s["start"] >= a["at"]
        out = F.when(fresh, F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mark))).otherwise(a["out"])
        return F.struct(F.greatest(a["at"], s["end"]).alias("at"), out.alias("out"))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    whole = F.aggregate(spans, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) > 0, whole).otherwise(text)


def redact(docs: DataFrame) -> DataFrame:
    """The rows and columns of docs with secrets in text replaced; n_chars, where there is one, follows."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    found = scan(docs.select(row, F.col("text")))
    clean = F.when(F.size("found") > 0, redacted(nonnull_text(F.col("text")), F.col("found"))).otherwise(F.col("text"))
    out = found.withColumn("clean", clean)
    kind = dict(docs.dtypes).get("n_chars")
    swap = {"text": F.col("clean")} | ({"n_chars": F.when(F.size("found") > 0, F.length("clean").cast(kind)).otherwise(F.col("row.n_chars"))} if kind else {})
    return out.select(*[swap.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op5_secrets(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    count = lambda k: F.size(F.filter("base_found", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return scan(docs).select("doc_id", count(0), count(1), count(2), F.sha2(as_text(F.col("base_found")), 256).alias("base_sha256"), as_text(F.col("found")).alias("spans"))

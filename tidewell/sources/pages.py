"""Raw pages to articles: URL check, robots, sniffing, extraction, size cap, hash and counts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_page_date, rfc3339
from ..functions.html import extract_html
from ..functions.text import content_hash, count_words, normalize_whitespace, potentially_incomplete, truncate_utf8
from ..functions.web import domain_key, looks_like_html, robots_allow, robots_rules, url_error, url_path

MAX_ARTICLE_BYTES = 5 * 1024 * 1024


def blocked(pages: DataFrame, robots: DataFrame, agent: str) -> DataFrame:
    """pages(url, ...) with ``error``: a refused URL or a robots rule, else null.

    robots(domain, body) holds one row for each domain; domains without a row, or with too large a body, allow all.
    """
    rules = robots.filter(F.octet_length("body") <= 512 * 1024).select(F.col("domain").alias("_domain"), robots_rules(F.col("body"), agent).alias("_rules"))
    joined = pages.withColumn("_key", domain_key(F.col("url"))).join(rules, F.col("_key") == F.col("_domain"), "left")
    denied = F.when(~robots_allow(F.col("_rules"), url_path(F.col("url"))), F.lit("denied by robots.txt"))
    return joined.withColumn("error", F.coalesce(url_error(F.col("url")), denied)).drop("_key", "_domain", "_rules")


def extract_pages(pages: DataFrame, body: str = "html", content_type: str | None = None, max_bytes: int = MAX_ARTICLE_BYTES, closed: bool = False) -> DataFrame:
    """Adds text, blocks, title, author, published_at, word_count, content_hash and potentially_incomplete.

    Only rows that look like HTML go through the Python worker; other bodies are text with their white space normalised.
    HTML5 reads ``&amp`` without a semicolon as an ampersand; with ``closed`` it stays as it stands.
    """
    raw = truncate_utf8(F.col(body), max_bytes)
    typed = F.col(content_type) if content_type else F.lit(None).cast("string")
    marked = pages.withColumn("_raw", raw).withColumn("_html", F.when(looks_like_html(typed, raw), raw))
    got = marked.withColumn("_x", extract_html(F.col("_html"), closed))
    text = F.when(F.col("_html").isNotNull(), normalize_whitespace(F.col("_x.text"))).otherwise(normalize_whitespace(F.col("_raw")))
    got = got.withColumn("text", truncate_utf8(text, max_bytes))
    date = F.get(F.filter(F.transform("_x.dates", parse_page_date), lambda d: d.isNotNull()), F.lit(0))
    out = got.withColumns(
        {
            "blocks": F.col("_x.blocks"),
            "title": F.col("_x.title"),
            "author": F.col("_x.author"),
            "published_at": rfc3339(date),
            "word_count": count_words(F.col("text")),
            "content_hash": content_hash(F.col("text")),
        }
    )
    return out.withColumn("potentially_incomplete", F.coalesce(potentially_incomplete(F.col("_html"), F.col("word_count")), F.lit(False))).drop("_raw", "_html", "_x")


def process_pending(state: dict[str, DataFrame], responses: DataFrame, robots: DataFrame, agent: str, as_of: str) -> tuple[dict[str, DataFrame], DataFrame]:
    """Extracts pending articles from responses(url, status, content_type, body); the rest stays pending, with an error."""
    from ..operators.store import pending_extraction, update_content

    waiting = pending_extraction(state["articles"]).join(responses, "url")
    checked = blocked(waiting, robots, agent)
    checked = checked.withColumn("error", F.coalesce("error", F.when(~F.col("status").between(200, 299), F.concat(F.lit("HTTP "), F.col("status")))))
    done = extract_pages(checked.filter("error IS NULL"), "body", "content_type")
    delta = done.select("id", F.col("text").alias("content"), "content_hash", "title", "author", "published_at")
    return state | {"articles": update_content(state["articles"], delta, as_of, strict=False)}, checked.filter("error IS NOT NULL").select("id", "url", "error")


def extraction_counts(before: dict[str, DataFrame], after: dict[str, DataFrame], errors: DataFrame) -> DataFrame:
    """One row: how many articles a run of process_pending extracted, failed on, and left waiting."""
    was = before["articles"].agg(F.count_if(F.col("content_extracted") == 0).alias("was"))
    left = after["articles"].agg(F.count_if(F.col("content_extracted") == 0).alias("waiting"))
    failed = errors.agg(F.count("*").alias("failed"))
    return was.join(left).join(failed).select((F.col("was") - F.col("waiting")).alias("extracted"), "failed", "waiting")  # one row each

"""Text functions as column expressions; all of them stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes that an embedding input may have: 8192 tokens of 4 bytes.
MAX_INPUT_BYTES = 8192 * 4
#: Phrases that mark a page as behind a paywall.
PAYWALL = ("subscriber only", "premium content", "subscribe now", "subscribe to continue", "sign in to continue", "paywall")
INCOMPLETE_WORDS = 250


def normalize_whitespace(text: Column) -> Column:
    """Trims and collapses runs of Unicode white space to one space."""
    return F.regexp_replace(F.regexp_replace(text, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " ")


def count_words(text: Column) -> Column:
    """Tokens between white space; an empty text has none."""
    n = normalize_whitespace(text)
    return F.when(n == "", F.lit(0)).otherwise(F.size(F.split(n, " "))).cast("long")


def content_hash(text: Column) -> Column:
    """SHA-256, in lowercase hex, of the text with its white space normalised."""
    return F.sha2(normalize_whitespace(text), 256)


def truncate_utf8(text: Column, limit: int) -> Column:
    """At most ``limit`` bytes of the text, cut between characters."""
    data = F.encode(text, "UTF-8")
    code = lambda at: F.conv(F.hex(F.substring(data, at, 1)), 16, 10).cast("int")
    # The byte after the cut tells whether a character would be split; a character has at most 3 more bytes.
    inside = [code(limit + 1 - back).between(128, 191) for back in range(3)]
    cut = F.when(~inside[0], limit).when(~inside[1], limit - 1).when(~inside[2], limit - 2).otherwise(limit - 3)
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.substring(data, F.lit(1), F.greatest(cut, F.lit(0))).cast("string"))


def strip_html_tags(text: Column) -> Column:
    """Drops tags, an unclosed tail and stray closing brackets; text of scripts stays."""
    return F.regexp_replace(text, r"<[^>]*>?|>", "")


def sanitize(text: Column) -> Column:
    """Drops control characters other than line feed, tab and carriage return."""
    return F.regexp_replace(text, r"[\p{Cc}&&[^\n\t\r]]", "")


def prepare_article_text(title: Column, content: Column) -> Column:
    """Title, blank line, content where there is any; control characters dropped."""
    whole = F.when(F.length(content) > 0, F.concat(title, F.lit("\n\n"), content)).otherwise(title)
    return sanitize(whole)


def prepare_input(text: Column, limit: int = MAX_INPUT_BYTES) -> Column:
    return truncate_utf8(text, limit)


def strip_by_prefix(author: Column) -> Column:
    """A byline without its leading ``By``."""
    trim = lambda c: F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return trim(F.regexp_replace(trim(author), r"^(By )*(by )*", ""))


def potentially_incomplete(html: Column, words: Column) -> Column:
    """Few words and a paywall phrase somewhere in the raw page."""
    return (words < INCOMPLETE_WORDS) & html.rlike("(?i)" + "|".join(PAYWALL))


def valid_dimensions(embedding: Column, width: int) -> Column:
    return F.coalesce(F.size(embedding) == width, F.lit(False))


def header(headers: Column, name: str) -> Column:
    """A header by its name, in lower case; null where absent."""
    return F.try_element_at(headers, F.lit(name.lower()))

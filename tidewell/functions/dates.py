"""Date parsing with explicit formats only, and the two string formats of stored times (UTC)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _first(text: Column, formats: tuple[str, ...]) -> Column:
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)) for f in formats])


def _rfc3339(text: Column) -> Column:
    shaped = F.when(text.rlike(r"^\d{4}-\d\d-\d\d[Tt ]\d\d:\d\d:\d\d(\.\d+)?([Zz]|[+-]\d\d:\d\d)$"), F.upper(text))
    plain = F.regexp_replace(F.regexp_replace(shaped, r"\.\d+", ""), " ", "T")
    return F.try_to_timestamp(plain, F.lit("yyyy-MM-dd'T'HH:mm:ssXXX"))


def parse_index_date(text: Column) -> Column:
    """RFC 3339, date and time, or a date; null otherwise."""
    return F.coalesce(_rfc3339(text), _first(text, ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd")))


def parse_page_date(text: Column) -> Column:
    """What pages say: RFC 3339, RFC 2822, three naive times, three forms of dates."""
    t = F.trim(text)
    mail = F.regexp_replace(F.regexp_replace(t, r"^\w{3},\s+", ""), r"\s+(GMT|UT|UTC|Z)$", " +0000")
    rfc2822 = F.coalesce(*[F.try_to_timestamp(mail, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss xx", "d MMM yyyy HH:mm xx")])
    naive = _first(t, ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy"))
    return F.coalesce(_rfc3339(t), rfc2822, naive)


def rfc3339(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ssxxx")


def stored(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")

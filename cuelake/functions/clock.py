"""Time formatting and parsing. Inputs are milliseconds unless the name says seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _pad(c: Column, width: int = 2) -> Column:
    text = c.cast("string")
    return F.lpad(text, F.greatest(F.length(text), F.lit(width)), F.lit("0"))


def _whole(c: Column) -> Column:
    return F.greatest(F.lit(0), c).cast("bigint")


def format_timestamp(ms: Column) -> Column:
    """m:ss, or h:mm:ss from one hour on."""
    s = _whole(F.floor(ms / 1000))
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    long = F.concat(h.cast("string"), F.lit(":"), _pad(m), F.lit(":"), _pad(sec))
    return F.when(h > 0, long).otherwise(F.concat(m.cast("string"), F.lit(":"), _pad(sec)))


def format_inline_timestamp(ms: Column) -> Column:
    return F.concat(F.lit("["), format_timestamp(ms), F.lit("]"))


def format_duration_clock(ms: Column) -> Column:
    s = _whole(F.round(ms / 1000))
    h, m, sec = F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60
    return (
        F.when(h > 0, F.concat(h.cast("string"), F.lit("h "), _pad(m), F.lit("m")))
        .when(m > 0, F.concat(m.cast("string"), F.lit("m "), _pad(sec), F.lit("s")))
        .otherwise(F.concat(sec.cast("string"), F.lit("s")))
    )


def format_clock_ms(ms: Column, separator: str = ",") -> Column:
    """HH:MM:SS,mmm as subtitles print it; slides use a dot."""
    t = _whole(F.round(ms))
    return F.concat(
        _pad(F.floor(t / 3_600_000)), F.lit(":"), _pad(F.floor(t % 3_600_000 / 60_000)), F.lit(":"),
        _pad(F.floor(t % 60_000 / 1000)), F.lit(separator), _pad(t % 1000, 3),
    )


def parse_duration(text: Column) -> Column:
    """h:m:s, m:s or s to seconds; anything unparsable is 0."""
    parts = F.transform(F.split(F.trim(text), ":"), lambda p: F.when(p == "", 0.0).otherwise(p.try_cast("double")))
    good = F.forall(parts, lambda p: p.isNotNull())
    n = F.size(parts)
    g = lambda i: F.get(parts, F.lit(i))
    return (
        F.when(~good, 0.0)
        .when(n == 3, g(0) * 3600 + g(1) * 60 + g(2))
        .when(n == 2, g(0) * 60 + g(1))
        .otherwise(g(0))
    )


TIMESTAMP_TOKEN = "^\\[(?:(\\d{1,2}):)?(\\d{1,2}):(\\d{2})\\]$"


def parse_timestamp_token(token: Column) -> Column:
    """[m:ss] or [h:mm:ss] to seconds, null when it is neither."""
    part = lambda i: F.coalesce(
        F.regexp_extract(token, TIMESTAMP_TOKEN, i).try_cast("bigint"), F.lit(0)
    )
    return F.when(
        F.regexp_like(token, F.lit(TIMESTAMP_TOKEN)), part(1) * 3600 + part(2) * 60 + part(3)
    )


def relative_age(created_ms: Column, as_of_ms: Column) -> Column:
    minutes = F.round(F.greatest(F.lit(0), as_of_ms - created_ms) / 60_000)
    hours = F.round(minutes / 60)
    days = F.round(hours / 24)
    text = lambda n, unit: F.concat(n.cast("bigint").cast("string"), F.lit(unit))
    return (
        F.when(minutes < 1, "just now")
        .when(minutes < 60, text(minutes, "m ago"))
        .when(hours < 24, text(hours, "h ago"))
        .otherwise(text(days, "d ago"))
    )


def read_minutes(words: Column, language: Column, has_hangul: Column) -> Column:
    per_minute = F.when(
        F.startswith(F.lower(language), F.lit("ko")) | has_hangul, 380
    ).otherwise(220)
    return F.greatest(F.lit(1), F.round(words / per_minute)).cast("bigint")

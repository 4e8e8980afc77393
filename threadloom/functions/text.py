"""Text functions as native Column expressions. Java regex classes are spelled out to match Unicode as intended."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import values as V

#: Unicode white space, and a word character.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"
URL = "(?i)" + V.URL.replace(r"\S", r"[^\s\x1c-\x1f\x85\p{Z}]")
MENTION = f"@{WORD}+"
# What counts as an address, a phone number and a long number.
# The local part only starts where a run of its characters starts, so long runs cost linear time.
EMAIL = r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"
PHONE = r"(?<!\d)(?:\+?\d[\d\s().\-]{8,}\d)(?!\d)"
NUMBER = r"(?<!@)\b\d{5,}\b"
KINDS = ["url", "email", "phone", "number"]


def any_of(words: list[str]) -> str:
    return "|".join(re.escape(w).replace("\\ ", " ").replace("\\'", "'") for w in words)


def text(c: Column | str) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def normalize(c: Column | str) -> Column:
    """White space collapsed and stripped; null becomes empty."""
    return F.trim(F.regexp_replace(text(c), SPACE + "+", " "))


def urls(c: Column | str) -> Column:
    return F.regexp_extract_all(text(c), F.lit(URL), F.lit(0))


def clean(c: Column | str) -> Column:
    """Without URLs and mentions, collapsed, stripped, lower-case."""
    bare = F.regexp_replace(F.regexp_replace(text(c), URL, " "), MENTION, " ")
    return F.lower(F.trim(F.regexp_replace(bare, SPACE + "+", " ")))


def has_content(cleaned: Column) -> Column:
    return cleaned.rlike(WORD)


def words(cleaned: Column) -> Column:
    """Words of a cleaned text."""
    return F.when(cleaned == "", F.lit(0)).otherwise(F.size(F.split(cleaned, " "))).cast("long")


def contains_any(cleaned: Column, phrases: list[str]) -> Column:
    out = F.lit(False)
    for p in phrases:
        out = out | cleaned.contains(p)
    return out


def reply_signals(raw: Column | str, cleaned: Column | str) -> Column:
    """struct(valid, n_words, has_url, has_redirect, has_actionable, is_short, signals, is_generic)."""
    t = text(raw)
    c = F.col(cleaned) if isinstance(cleaned, str) else cleaned
    n, url, redirect = words(c), t.rlike(URL), c.rlike(any_of(V.REDIRECT_PHRASES))
    act = url | c.rlike(r"\d") | c.rlike(rf"\b(?:{any_of(V.ACTIONABLE_TERMS)})\b")
    short = n <= V.SHORT_REPLY_WORDS
    signals = redirect.cast("long") + short.cast("long") + (~act).cast("long")
    return F.struct(
        (c != "").alias("valid"), n.alias("n_words"), url.alias("has_url"), redirect.alias("has_redirect"), act.alias("has_actionable"),
        short.alias("is_short"), signals.alias("signals"), ((c != "") & (signals >= 2)).alias("is_generic"),
    )


def redact(c: Column | str) -> Column:
    """struct(text, url, email, phone, number): the normalized text with each kind masked in turn, and how often."""
    s, counts = normalize(c), []
    for kind, pattern, mask in zip(KINDS, (URL, EMAIL, PHONE, NUMBER), ("[URL]", "[EMAIL]", "[PHONE]", "[NUM]")):
        counts.append(F.regexp_count(s, F.lit(pattern)).cast("long").alias(kind))
        s = F.regexp_replace(s, pattern, mask)
    return F.struct(s.alias("text"), *counts)


def tokens(cleaned: Column) -> Column:
    """Runs of two or more of a-z and apostrophe."""
    return F.regexp_extract_all(cleaned, F.lit("[a-z']{2,}"), F.lit(0))


def index_tokens(c: Column | str) -> Column:
    """Lower-case runs of at least two word characters."""
    return F.regexp_extract_all(F.lower(text(c)), F.lit(WORD + "{2,}"), F.lit(0))


def capped(s: Column, most: int, keep: int) -> Column:
    """Beyond ``most`` characters the first ``keep``, without white space at the end, and an ellipsis."""
    cut = F.regexp_replace(F.substring(s, 1, keep), SPACE + "+$", "")
    return F.when(F.length(s) > most, F.concat(cut, F.lit("…"))).otherwise(s)


def example_text(c: Column | str) -> Column:
    """A prompt example: without mentions, collapsed, at most 240 characters."""
    s = F.trim(F.regexp_replace(F.regexp_replace(text(c), MENTION, " "), SPACE + "+", " "))
    return capped(s, V.MAX_EXAMPLE, V.MAX_EXAMPLE - 1)


def display_text(c: Column | str, most: int = 160) -> Column:
    s = F.trim(F.regexp_replace(text(c), r"[\r\n]", " "))
    return F.when(F.length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def created(c: Column | str) -> Column:
    """The timestamp of "Mon Jan 01 00:00:07 +0000 2024"; null if it isn't one. The session's time zone must be UTC."""
    s = F.col(c) if isinstance(c, str) else c
    day = s.rlike("^(Mon|Tue|Wed|Thu|Fri|Sat|Sun) ")
    return F.when(day, F.try_to_timestamp(F.substring(s, 5, 40), F.lit("MMM dd HH:mm:ss Z yyyy")))


def iso(ts: Column) -> Column:
    """ISO text in UTC; null becomes empty."""
    return F.coalesce(F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")), F.lit(""))


def rounded(c: Column | str, digits: int) -> Column:
    """Half up. The small addend makes decimal ties such as 0.59525 round up whatever their binary form; values are not negative."""
    return F.round(F.lit(1e-9) + (F.col(c) if isinstance(c, str) else c), digits)


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, rounded(100.0 * part / whole, digits)).otherwise(F.lit(0.0))


def ratio(part: Column, whole: Column, digits: int = 4) -> Column:
    return F.when(whole > 0, rounded(part / whole, digits)).otherwise(F.lit(0.0))

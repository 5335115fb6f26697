"""Lenient parsing and cleaning of raw text columns.

Everything is a native expression: no Python runs per row.  Bad input becomes
null instead of failing the job, also with ANSI mode on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Formats, patterns and word lists that decide results.
TIMESTAMP_FORMATS = ("yyyy-MM-dd HH:mm:ss",)
NUMBER_PATTERN = r"(?i)^\s*[+-]?(inf|infinity|([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)\s*$"
# All characters that Unicode text processing takes as white space.
BLANK_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
NULL_LIKE_REGIONS = ("", "nan", "unknown", "none", "nat")
CLOSED_STATUSES = ("resolved", "closed_no_action")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def to_id(c: Column | str, null_key: str | None = None) -> Column:
    """Id as text.  Nulls stay null, or become ``null_key`` where the caller wants them to match."""
    text = _col(c).cast("string")
    return text if null_key is None else F.coalesce(text, F.lit(null_key))


def to_time(c: Column | str, formats: Sequence[str] = TIMESTAMP_FORMATS) -> Column:
    """Timestamp without zone from the first format that fits, else null."""
    text = _col(c).cast("string")
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(f)).cast("timestamp_ntz") for f in formats])


def to_number(c: Column | str) -> Column:
    """Double from plain or scientific notation, outer blanks allowed; anything else is null."""
    text = _col(c).cast("string")
    return F.when(text.rlike(NUMBER_PATTERN), text.try_cast("double"))


def to_score(c: Column | str) -> Column:
    """Whole score; missing, unreadable and infinite values count as 0 (no survey)."""
    number = to_number(c)
    finite = F.abs(number) < F.lit(float("inf"))
    return F.when(finite, number).otherwise(F.lit(0.0)).cast("long")


def to_flag(c: Column | str) -> Column:
    """1 for a number above zero or a true literal, else 0."""
    text = _col(c).cast("string")
    return F.when((to_number(text) > 0) | (F.lower(text) == "true"), 1).otherwise(0)


def strip(c: Column | str) -> Column:
    """Text without outer white space of any kind; null stays null."""
    return F.trim(_col(c), F.lit(BLANK_CHARS))


def to_text(c: Column | str) -> Column:
    """Text with null as the empty string and outer white space removed."""
    return strip(F.coalesce(_col(c), F.lit("")))


def responded(score: Column | str) -> Column:
    """1 when a survey score above zero was given, else 0."""
    return F.when(F.coalesce(_col(score), F.lit(0)) > 0, 1).otherwise(0)


def needs_fill(c: Column | str, tokens: Sequence[str] = NULL_LIKE_REGIONS) -> Column:
    """True for null and for words that stand for a missing value."""
    return _col(c).isNull() | F.lower(strip(c)).isin(list(tokens))


def closed_without_text(
    status: Column | str, text: Column | str, closed: Sequence[str] = CLOSED_STATUSES
) -> Column:
    """True for a closed ticket whose text is missing or blank."""
    blank = _col(text).isNull() | (strip(text) == "")
    return F.coalesce(F.lower(_col(status)).isin(list(closed)), F.lit(False)) & blank


def longer_than(c: Column | str, chars: int) -> Column:
    """True when the raw text has more than ``chars`` characters; null is not longer."""
    return F.length(_col(c)) > chars

"""Calendar expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text formats of the date parts and the bucket of an unknown month.
MONTH_FORMAT = "yyyy-MM"
DAY_NAME_FORMAT = "EEEE"
UNKNOWN_MONTH = "NaT"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def date_key(c: Column | str) -> Column:
    """Date as the integer yyyymmdd, null for null."""
    day = _col(c)
    return (F.year(day) * 10000 + F.month(day) * 100 + F.dayofmonth(day)).cast("int")


def calendar_parts(c: Column | str) -> list[Column]:
    """Key, year, month, day and English day name of a date."""
    day = _col(c)
    return [
        date_key(day).alias("date_key"),
        F.year(day).alias("year"),
        F.month(day).alias("month"),
        F.dayofmonth(day).alias("day"),
        F.date_format(day, DAY_NAME_FORMAT).alias("day_of_week"),
    ]


def month_bucket(c: Column | str) -> Column:
    """Month as text; rows without a time form a bucket of their own."""
    return F.coalesce(F.date_format(_col(c), MONTH_FORMAT), F.lit(UNKNOWN_MONTH))

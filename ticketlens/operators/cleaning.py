"""Typed cleaning of raw tickets and customers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions import parse
from ticketlens.operators.dedupe import drop_exact, keep_first

# The cleaning rule of each ticket column.
ID_COLUMNS = ("ticket_id", "customer_id")
TIME_COLUMNS = ("created_at",)
NUMBER_COLUMNS = ("resolution_time_hours",)
SCORE_COLUMNS = ("csat_score",)
FLAG_COLUMNS = ("reopened", "has_attachment")
TEXT_COLUMNS = ("initial_message", "agent_first_reply", "resolution_summary")
# Texts so long that rows with one are not moved to be compared.
LONG_COLUMNS = ("initial_message", "agent_first_reply")


def update(df: DataFrame, changes: dict[str, Column]) -> DataFrame:
    """Replaces the columns that exist in one projection, keeping their order."""
    return df.withColumns({c: e for c, e in changes.items() if c in df.columns})


def clean_tickets(raw: DataFrame, null_key: str | None = None) -> DataFrame:
    """Typed tickets without exact copies.

    Copies are dropped after ids and times are typed and before the other
    columns are, so rows that differ only in unreadable time text are copies
    and rows that differ only in outer blanks are not.  With long texts the raw
    table is read several times and must give the same rows each time.
    """
    keyed = update(
        raw,
        {
            **{c: parse.to_id(c, null_key) for c in ID_COLUMNS},
            **{c: parse.to_time(c) for c in TIME_COLUMNS},
        },
    )
    return update(
        drop_exact(keyed, long_rows=any(c in raw.columns for c in LONG_COLUMNS)),
        {
            **{c: parse.to_number(c) for c in NUMBER_COLUMNS},
            **{c: parse.to_score(c) for c in SCORE_COLUMNS},
            **{c: parse.to_flag(c) for c in FLAG_COLUMNS},
            **{c: parse.to_text(c) for c in TEXT_COLUMNS},
        },
    )


def clean_customers(
    raw: DataFrame, order: Column | str, key: str = "customer_id", null_key: str | None = None
) -> DataFrame:
    """One row per customer id: the first by ``order``."""
    return keep_first(raw.withColumn(key, parse.to_id(key, null_key)), key, order)


def with_response(df: DataFrame, score: str = "csat_score", into: str = "csat_response") -> DataFrame:
    """Adds the 0/1 flag of a survey answer."""
    return df.withColumn(into, parse.responded(F.col(score)))

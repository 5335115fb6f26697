"""Star schema: fact projection and dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.functions.calendar import calendar_parts, date_key
from ticketlens.session import settle

# The fact columns in order.
FACT_COLUMNS = [
    "ticket_id", "customer_id", "date_key", "priority", "status", "sla_plan", "channel", "product_area",
    "issue_type", "resolution_time_hours", "reopened", "customer_sentiment", "csat_score",
    "has_attachment", "platform", "region",
]

_ROWS_PER_PARTITION = 1 << 33  # monotonically_increasing_id: partition id above, row position below


def present(df: DataFrame, wanted: list[str]) -> list[str]:
    """The wanted columns that the table has, in the wanted order."""
    return [c for c in wanted if c in df.columns]


def fact_tickets(tickets: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Fact rows with a date key; wanted columns the table lacks are left out."""
    keyed = tickets.withColumn("date_key", date_key("created_at"))
    return keyed.select(*present(keyed, columns or FACT_COLUMNS))


def dimension(df: DataFrame, column: str, name: str) -> DataFrame:
    """Distinct non-null values in order with a key 1..n: columns ``<name>_key`` and ``<name>_name``.

    Only distinct values are sorted, by range over all partitions.  The sorted
    values are settled, so their partitions stay as they are; the key is the
    position in the partition plus the row counts of the partitions before it.
    """
    values = df.select(F.col(column).alias("_v")).filter(F.col("_v").isNotNull()).distinct()
    placed = settle(values.orderBy("_v")).withColumn("_id", F.monotonically_increasing_id())
    placed = placed.select(
        "_v",
        F.floor(F.col("_id") / _ROWS_PER_PARTITION).alias("_part"),
        (F.col("_id") % _ROWS_PER_PARTITION).alias("_row"),
    )
    # One row per partition of the sort: bounded by the shuffle partition count.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset")
    )
    keyed = placed.join(F.broadcast(offsets), "_part")
    return keyed.select(
        (F.col("_offset") + F.col("_row") + 1).cast("int").alias(f"{name}_key"),
        F.col("_v").alias(f"{name}_name"),
    )


def label_list(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null labels in order."""
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def date_range(df: DataFrame, column: str) -> DataFrame:
    """First and last day of a time column, as one row."""
    day = F.to_date(column)
    return df.agg(F.min(day).alias("min_date"), F.max(day).alias("max_date"))


def calendar(df: DataFrame, column: str) -> DataFrame:
    """One row for each day from the first to the last; no rows where there is no time at all."""
    days = F.sequence("min_date", "max_date", F.expr("interval 1 day"))
    dates = date_range(df, column).select(F.explode(days).alias("date"))
    return dates.select("date", *calendar_parts("date"))

"""Group counts, cross-tabs, service levels and histograms."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Service-level limits in hours by plan and for any other plan.
SLA_HOURS = {"standard": 48, "premium": 24, "gold": 24, "platinum": 8}
DEFAULT_SLA_HOURS = 48


def have(df: DataFrame, *columns: str) -> DataFrame:
    """Rows with a value in each of the columns."""
    for c in columns:
        df = df.filter(F.col(c).isNotNull())
    return df


def respondents(df: DataFrame, flag: str = "csat_response", score: str = "csat_score") -> DataFrame:
    """Rows with a survey answer: by the flag where the table has it, else by the score."""
    return df.filter(F.col(flag) == 1) if flag in df.columns else df.filter(F.col(score) > 0)


def group_sizes(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Row count of each combination of non-null keys."""
    return have(df, *keys).groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def cross_tab(df: DataFrame, row: str, column: str, values: Sequence[str] | None = None, rest: str = "other") -> DataFrame:
    """Row counts with one column per value; empty cells are 0.

    Without ``values`` each value of the data has a column, in order.  With them, rows with any other value count
    in the column ``rest``.  Rows without a row key or without a value count nowhere.
    """
    counts = group_sizes(df, [row, column]).withColumn(column, F.col(column).cast("string"))
    if values is None:
        names = [r[0] for r in counts.select(column).distinct().orderBy(column).collect()]
    else:
        names = [*values, rest]
        counts = counts.withColumn(column, F.when(F.col(column).isin(list(values)), F.col(column)).otherwise(rest))
    table = counts.groupBy(row).pivot(column, names).agg(F.sum("n"))
    return table.fillna(0, names)


def cells(counts: DataFrame, row: str, column: str, n: str = "n", into: str = "cells") -> DataFrame:
    """One row per row key with a map from column values to counts, in the order of the values.

    The long form of a cross-tab brought together without a list of its values on the driver.  A row holds as
    many entries as its key has values; ``group_sizes`` is the form for keys with more of them than a row can hold.
    """
    entry = F.struct(F.col(column).cast("string").alias("key"), F.col(n).alias("value"))
    entries = F.array_sort(F.collect_list(entry))
    return counts.groupBy(row).agg(F.map_from_entries(entries).alias(into))


def cross_tab_cells(df: DataFrame, row: str, column: str) -> DataFrame:
    """Row counts as one map per row key; values that a row key does not have are absent.

    Counts are combined on the map side, and nothing comes to the driver.
    """
    return cells(group_sizes(df, [row, column]), row, column)


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Row count of each non-null value, largest first, then by value."""
    return group_sizes(df, [column]).orderBy(F.desc("n"), column)


def top_k(df: DataFrame, k: int, score: str, *ties: str) -> DataFrame:
    """The ``k`` rows with the highest score; ties in the order of the given columns."""
    return df.orderBy(F.desc(score), *ties).limit(k)


def sla_limit(
    plan: Column | str, limits: Mapping[str, float] = SLA_HOURS, default: float = DEFAULT_SLA_HOURS
) -> Column:
    """Hours allowed by the plan, matched by exact case; any other or no plan gets the default."""
    table = F.create_map(*[F.lit(x) for pair in limits.items() for x in pair])
    name = F.col(plan) if isinstance(plan, str) else plan
    return F.coalesce(F.try_element_at(table, name), F.lit(default))


def with_sla(
    df: DataFrame, hours: str = "resolution_time_hours", plan: str = "sla_plan", **limits
) -> DataFrame:
    """Solved tickets with their limit and whether it was met; open tickets are left out."""
    solved = have(df, hours).withColumn("sla_limit", sla_limit(plan, **limits))
    return solved.withColumn("sla_met", F.col(hours) <= F.col("sla_limit"))


def sla_rate(df: DataFrame, segment: str = "customer_segment", **options) -> DataFrame:
    """Share of solved tickets within their limit, per segment."""
    met = have(with_sla(df, **options), segment)
    return met.groupBy(segment).agg(F.avg(F.col("sla_met").cast("double")).alias("sla_rate"))


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts in ``bins`` equal bins from minimum to maximum, the last one closed; empty bins are 0.

    A column of one value gets a range of half a unit to both sides.
    """
    rows = have(df, value).select(F.col(value).cast("double").alias("_v"))
    low, high = F.min("_v"), F.max("_v")
    flat = low == high
    # One scalar subquery: the bounds reach the scan as constants.
    bounds = rows.agg(
        F.struct(
            F.when(flat, low - 0.5).otherwise(low).alias("lo"),
            F.when(flat, high + 0.5).otherwise(high).alias("hi"),
        ).alias("b")
    ).scalar()
    lo, hi = bounds["lo"], bounds["hi"]
    slot = F.least(F.floor((F.col("_v") - lo) / (hi - lo) * bins), F.lit(bins - 1))
    counts = rows.groupBy(slot.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    width = (hi - lo) / bins
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select(
        "bin",
        (lo + F.col("bin") * width).alias("bin_start"),
        (lo + (F.col("bin") + 1) * width).alias("bin_end"),
        F.coalesce("n", F.lit(0)).alias("n"),
    )

"""Rule-based repair of missing values, with counters."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.parse import closed_without_text, needs_fill
from ticketlens.operators.join import lookup_filling, map_values

# Country names and their sales regions, and the fill words.
COUNTRY_REGIONS = {
    "germany": "EU", "austria": "EU", "switzerland": "EU", "france": "EU", "italy": "EU",
    "spain": "EU", "netherlands": "EU", "belgium": "EU", "sweden": "EU", "poland": "EU",
    "united kingdom": "EU", "uk": "EU",
    "brazil": "LATAM", "argentina": "LATAM", "chile": "LATAM", "mexico": "LATAM", "colombia": "LATAM",
    "india": "APAC", "japan": "APAC", "china": "APAC", "singapore": "APAC", "australia": "APAC",
    "south korea": "APAC",
    "uae": "MEA", "united arab emirates": "MEA", "saudi arabia": "MEA", "south africa": "MEA", "egypt": "MEA",
    "usa": "NA", "united states": "NA", "canada": "NA",
}
UNKNOWN = "Unknown"
NO_SUMMARY = "No summary provided"


def region_of_country(
    df: DataFrame, column: str = "country", into: str = "region",
    mapping: Mapping[str, str] | DataFrame = COUNTRY_REGIONS, default: str = UNKNOWN,
) -> DataFrame:
    """Adds the region of a country name; unmapped and missing countries get the default."""
    return map_values(df, column, mapping, default, into)


def mark_regions(
    df: DataFrame,
    lookup: DataFrame,
    key: str = "customer_id",
    region: str = "region",
    country: str = "country",
    mapping: Mapping[str, str] | DataFrame = COUNTRY_REGIONS,
) -> DataFrame:
    """Fills missing regions from the customer's country and marks what was done to each row.

    ``_missing``: the region needed a value; ``_imputed``: the country gave one;
    the rest became Unknown.  ``lookup`` has one row per key.
    """
    had_country = country in df.columns
    found = lookup_filling(df, lookup, key, country)
    mapped = region_of_country(found, country, "_mapped", mapping)
    missing = needs_fill(region)
    imputed = missing & (F.col("_mapped") != UNKNOWN)
    marked = mapped.withColumns({"_missing": missing, "_imputed": imputed})
    filled = marked.withColumn(
        region,
        F.when(F.col("_imputed"), F.col("_mapped")).when(F.col("_missing"), UNKNOWN).otherwise(F.col(region)),
    )
    order = [*df.columns, "_missing", "_imputed"]
    return filled.select(*[c for c in order if c != country or had_country])


def region_counts(region: str = "region") -> list[Column]:
    """Aggregates over a marked table: missing before, imputed, set to Unknown, missing after."""
    still = F.col("_missing") & ~F.col("_imputed")
    return [
        F.count_if("_missing").alias("missing_before"),
        F.count_if("_imputed").alias("imputed_from_country"),
        F.count_if(still).alias("set_unknown"),
        F.count_if(needs_fill(region)).alias("missing_after"),
    ]


def region_counters(marked: DataFrame, region: str = "region") -> DataFrame:
    """The counters of a marked table, as one row."""
    return marked.agg(*region_counts(region))


def impute_regions(df: DataFrame, lookup: DataFrame, **options) -> tuple[DataFrame, DataFrame]:
    """The repaired table and its one-row counters."""
    marked = mark_regions(df, lookup, **options)
    region = options.get("region", "region")
    return marked.drop("_missing", "_imputed"), region_counters(marked, region)


def fill_summaries(
    df: DataFrame, status: str = "status", text: str = "resolution_summary", fill: str = NO_SUMMARY
) -> DataFrame:
    """Puts a standard text into blank summaries of closed tickets."""
    return df.withColumn(text, F.when(closed_without_text(status, text), F.lit(fill)).otherwise(F.col(text)))


def summary_count(status: str = "status", text: str = "resolution_summary") -> Column:
    """Aggregate: how many summaries the fill sets."""
    return F.count_if(closed_without_text(status, text)).alias("resolution_summary_filled")


def summary_gaps(df: DataFrame, status: str = "status", text: str = "resolution_summary") -> DataFrame:
    """How many summaries the fill would set, as one row."""
    return df.agg(summary_count(status, text))


def response_counts(flag: str = "csat_response") -> list[Column]:
    """Aggregates: survey answers, rows without one and the answer rate."""
    return [
        F.coalesce(F.sum(flag), F.lit(0)).alias("responded"),
        F.count_if(F.col(flag) == 0).alias("not_responded"),
        F.avg(F.col(flag).cast("double")).alias("response_rate"),
    ]


def response_rate(df: DataFrame, flag: str = "csat_response") -> DataFrame:
    """Survey answers, rows without one and the answer rate, as one row."""
    return df.agg(*response_counts(flag))

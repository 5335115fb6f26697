"""Left joins to tables with one row per key, and key coverage."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.parse import strip
from ticketlens.operators.dedupe import keep_first


def one_per_key(df: DataFrame, key: str) -> DataFrame:
    """One row for each key that is not null; of several the smallest."""
    rest = [c for c in df.columns if c != key]
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(F.lit(0).alias("_"), *rest)).alias("_row"))
    return first.select(key, *[F.col("_row")[c].alias(c) for c in rest])


def left_lookup(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left equi join to one row per key of ``right``: the row count never grows, and null keys match nothing.

    The right side is reduced and joined in one plan, so it runs once.  Its size at run time decides whether it is
    broadcast, and adaptive execution splits the left rows of a hot key or of null keys over several tasks.
    """
    return left.join(one_per_key(right, key), key, "left")


def enrich(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Left join that adds only the right columns the left does not have yet."""
    return left_lookup(left, right.select(key, *new_columns(left, right, key)), key)


def new_columns(left: DataFrame, right: DataFrame, key: str) -> list[str]:
    """Right columns that the join adds."""
    return [c for c in right.columns if c != key and c not in left.columns]


def shared_columns(left: DataFrame, right: DataFrame, key: str) -> list[str]:
    """Right columns left out of the join because the left has them."""
    return [c for c in right.columns if c != key and c in left.columns]


def lookup_filling(df: DataFrame, lookup: DataFrame, key: str, column: str) -> DataFrame:
    """Left lookup of one column; where ``df`` has the column, its own value wins over the lookup's."""
    found = lookup.select(key, F.col(column).alias("_found"))
    joined = left_lookup(df, found, key)
    own = [F.col(column)] if column in df.columns else []
    return joined.withColumn(column, F.coalesce(*own, F.col("_found"))).drop("_found")


def lookup_first(df: DataFrame, other: DataFrame, key: str, columns: list[str], order: Column | str) -> DataFrame:
    """Left join to the first row per key of ``other``, keeping those of ``columns`` it has."""
    present = [c for c in columns if c in other.columns and c != key]
    position = F.col(order) if isinstance(order, str) else order
    ordered = other.select(key, *present, position.alias("_order"))
    first = keep_first(ordered.filter(F.col(key).isNotNull()), key, "_order", drop_order=True)
    return df.join(first.select(key, *new_columns(df, first, key)), key, "left")


def mapping_table(df: DataFrame, mapping: Mapping[str, object], key: str, value: str) -> DataFrame:
    """Two-column table from a dictionary of fixed values."""
    return df.sparkSession.createDataFrame(list(mapping.items()), [key, value])


def map_values(
    df: DataFrame, column: str, mapping: Mapping[str, object] | DataFrame, default: object, into: str,
    normalise: bool = True,
) -> DataFrame:
    """Adds ``into``: the mapped value of ``column``, or ``default`` where there is none.

    ``mapping`` is a dictionary, whose few fixed values are broadcast, or a
    two-column table (key, value) of any size.  Keys are stripped and
    lower-cased before the lookup unless ``normalise`` is off.
    """
    key = F.lower(strip(column)) if normalise else F.col(column)
    keyed = df.withColumn("_map_key", key)
    if isinstance(mapping, DataFrame):
        joined = left_lookup(keyed, mapping.toDF("_map_key", "_map_value"), "_map_key")
    else:
        fixed = mapping_table(df, mapping, "_map_key", "_map_value")
        joined = keyed.join(F.broadcast(fixed), "_map_key", "left")
    return joined.withColumn(into, F.coalesce("_map_value", F.lit(default))).select(
        *[c for c in df.columns if c != into], into
    )


def key_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct left keys, how many the right side has, and how many it lacks, as one row."""
    ids = left.select(key).filter(F.col(key).isNotNull()).distinct()
    known = right.select(key).distinct().withColumn("_known", F.lit(True))
    return ids.join(known, key, "left").agg(
        F.count(F.lit(1)).alias("distinct_keys"),
        F.count("_known").alias("matched_keys"),
        F.count_if(F.col("_known").isNull()).alias("orphan_keys"),
    )


def orphans(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct left keys without a row on the right."""
    ids = left.select(key).filter(F.col(key).isNotNull()).distinct()
    return ids.join(right.select(key), key, "left_anti")

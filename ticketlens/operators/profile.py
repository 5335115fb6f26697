"""Data-quality profiles: missing values and descriptive statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.parse import strip
from ticketlens.operators.quantile import quantiles

# The quartile levels and the decimals of the missing share.
QUARTILES = {"25%": 0.25, "50%": 0.5, "75%": 0.75}
SHARE_DECIMALS = 4
NUMERIC_TYPES = ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")


def _hole(c: str, kind: str, blank_as_missing: bool) -> Column:
    hole = F.col(c).isNull()
    return hole | (strip(c) == "") if blank_as_missing and kind == "string" else hole


def marked(df: DataFrame, keep: Sequence[str] = (), blank_as_missing: bool = False) -> DataFrame:
    """The table with a mark in place of each text that is not missing, but for the columns in ``keep``.

    Its profile is that of the table, and joins on the way to it move no texts.
    """
    texts = [c for c, kind in df.dtypes if kind == "string" and c not in keep]
    return df.withColumns({c: F.when(~_hole(c, "string", blank_as_missing), F.lit("x")) for c in texts})


def missing_profile(
    df: DataFrame, columns: Sequence[str] | None = None, blank_as_missing: bool = False
) -> DataFrame:
    """Missing count and percentage of each column, most missing first, then in column order.

    With ``blank_as_missing`` blank text counts as missing too.  One pass over
    the table, whatever the number of columns.
    """
    columns = list(columns or df.columns)
    types = dict(df.dtypes)
    holes = [F.count_if(_hole(c, types[c], blank_as_missing)).alias(c) for c in columns]
    # The row count rides along with each hole count through the unpivot.
    counts = df.agg(*holes, F.count(F.lit(1)).alias("_rows"))
    long = counts.select(
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("ordinal"), F.lit(c).alias("column"), F.col(f"`{c}`").alias("missing_count")
                    )
                    for i, c in enumerate(columns)
                ]
            )
        ).alias("_c"),
        "_rows",
    )
    percent = F.when(
        F.col("_rows") > 0,
        F.round(F.col("_c.missing_count") / F.col("_rows") * 100, SHARE_DECIMALS),
    ).otherwise(0.0)
    return (
        long.select("_c.column", "_c.missing_count", percent.alias("missing_percentage"), "_c.ordinal")
        .orderBy(F.desc("missing_count"), "ordinal")
        .drop("ordinal")
    )


def numeric_columns(df: DataFrame) -> list[str]:
    """Columns of a numeric type."""
    return [name for name, kind in df.dtypes if kind.split("(")[0] in NUMERIC_TYPES]


def describe(
    df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True
) -> DataFrame:
    """Count, mean, sample deviation, minimum, quartiles and maximum of each numeric column."""
    columns = list(columns or numeric_columns(df))
    long = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).unpivot(
        [], columns, "column", "value"
    )
    basics = {
        "count": F.count("_v").cast("double"), "mean": F.avg("_v"), "std": F.stddev_samp("_v"), "min": F.min("_v"), "max": F.max("_v"),
    }
    return quantiles(long, "value", QUARTILES, ["column"], exact, also=basics).select(
        "column", "count", "mean", "std", "min", *[F.col(f"`{q}`") for q in QUARTILES], "max"
    )

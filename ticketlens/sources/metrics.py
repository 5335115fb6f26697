"""Metrics as long rows (stage, metric, grp, value), one folder per stage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "metric string, grp string, value double"


def metric_rows(df: DataFrame, stage: str, group: str | None = None) -> DataFrame:
    """Long rows from wide metrics: each numeric column a metric, ``group`` names the row."""
    names = [c for c in df.columns if c != group]
    typed = df.select(
        F.lit(stage).alias("stage"),
        (F.col(group).cast("string") if group else F.lit(None).cast("string")).alias("grp"),
        *[F.col(f"`{c}`").cast("double").alias(c) for c in names],
    )
    return typed.unpivot(["stage", "grp"], names, "metric", "value").select("stage", "metric", "grp", "value")


def all_metrics(*tables: DataFrame) -> DataFrame:
    """Metric rows of several tables together."""
    return reduce(DataFrame.unionByName, tables)


def write_metrics(rows: DataFrame, folder: str, stage: str) -> None:
    """Replaces the metrics of one stage."""
    rows.select("metric", "grp", "value").write.mode("overwrite").json(f"{folder}/stage={stage}")


def read_metrics(spark: SparkSession, folder: str) -> DataFrame:
    """The metrics of all stages."""
    return spark.read.schema(SCHEMA).json(folder).select("stage", "metric", "grp", "value")


def metrics_by_stage(rows: DataFrame, stages: list[str]) -> DataFrame:
    """One row per metric and group, ungrouped metrics with a null group, and one column per stage."""
    return rows.groupBy("metric", "grp").pivot("stage", stages).agg(F.first("value"))

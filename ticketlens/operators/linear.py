"""Fitted linear classifiers as rows: coefficients, scores by joins, and the gradient that tells whether they are optimal."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.ml.feature import IndexToString
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.session import small_side, stage_table

# The position of the intercept, which every row has with value 1.
INTERCEPT = -1


def coefficient_rows(model: PipelineModel, df: DataFrame) -> DataFrame:
    """class, position (-1: the intercept) and weight of a pipeline with a multinomial classifier; written.

    The coefficients are model parameters on the driver, one for each class and feature.
    """
    fitted = next(s for s in model.stages if isinstance(s, LogisticRegressionModel))
    labels = next(s for s in model.stages if isinstance(s, IndexToString)).getLabels()
    matrix, shift = fitted.coefficientMatrix.toArray(), fitted.interceptVector.toArray()
    rows = [(label, n, float(w)) for label, own in zip(labels, matrix) for n, w in enumerate(own) if w]
    rows += [(label, INTERCEPT, float(b)) for label, b in zip(labels, shift)]
    return stage_table(df.sparkSession.createDataFrame(rows, "class string, position int, weight double"))


def cells(features: str) -> Column:
    """The cells of a vector that are stored, and the intercept's, as an array of (position, value)."""
    held = F.unwrap_udt(features)
    sparse = F.arrays_zip(held["indices"].alias("position"), held["values"].alias("value"))
    dense = F.transform(held["values"], lambda v, i: F.struct(i.alias("position"), v.alias("value")))
    own = F.when(held["type"] == 0, sparse).otherwise(dense)
    return F.concat(F.array(F.struct(F.lit(INTERCEPT).alias("position"), F.lit(1.0).alias("value"))), own)


def margins(rows: DataFrame, key: str, features: str, coefficients: DataFrame) -> DataFrame:
    """key, class and margin of each row and class: a join of cells and coefficients on the position, and a sum."""
    own = rows.select(key, F.inline(cells(features)))
    met = own.join(small_side(coefficients), "position")
    return met.groupBy(key, "class").agg(F.sum(F.col("value") * F.col("weight")).alias("margin"))


def score_rows(rows: DataFrame, key: str, features: str, coefficients: DataFrame) -> DataFrame:
    """key (unique) and predicted: the class of the largest margin, the last in order among equals."""
    best = F.max(F.struct("margin", "class")).alias("_best")
    return margins(rows, key, features, coefficients).groupBy(key).agg(best).select(key, F.col("_best.class").alias("predicted"))


def gradient(rows: DataFrame, key: str, features: str, label: str, weight: str, coefficients: DataFrame, penalty: float) -> DataFrame:
    """class, position and slope of the mean weighted log-loss plus penalty / 2 times the squared coefficients.

    At the optimum all slopes are 0. The penalty makes the loss strongly convex in the coefficients, so that they are no
    further from the optimum than the length of the gradient over the penalty.
    """
    rows = stage_table(rows.select(key, features, label, weight))
    told = margins(rows, key, features, coefficients)
    # One row for each class of the row's key.
    every = Window.partitionBy(key)
    top = F.exp(F.col("margin") - F.max("margin").over(every))
    share = told.withColumn("_e", top).withColumn("share", F.col("_e") / F.sum("_e").over(every)).select(key, "class", "share")
    off = rows.select(key, label, weight).join(share, key)
    off = off.select(key, "class", ((F.col("share") - (F.col(label) == F.col("class")).cast("int")) * F.col(weight)).alias("_off"))
    whole = rows.agg(F.sum(weight)).scalar()
    sums = rows.select(key, F.inline(cells(features))).join(off, key).groupBy("class", "position").agg((F.sum(F.col("value") * F.col("_off")) / whole).alias("slope"))
    both = sums.join(coefficients, ["class", "position"], "full")
    pull = F.when(F.col("position") == INTERCEPT, 0.0).otherwise(F.coalesce("weight", F.lit(0.0)) * penalty)
    return both.select("class", "position", (F.coalesce("slope", F.lit(0.0)) + pull).alias("slope"))

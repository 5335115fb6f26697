"""Group statistics, box statistics, densities and one-way analysis of variance."""

from __future__ import annotations

from collections.abc import Sequence
from math import exp, factorial, sqrt

from numpy.polynomial.hermite import herm2poly
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.functions.distribution import f_p_value
from ticketlens.operators.aggregate import have
from ticketlens.operators.quantile import quantiles
from ticketlens.session import attach, settle, small_side

# Thresholds and grid sizes that decide results.
MIN_GROUP_ROWS = 10
SIGNIFICANCE = 0.05
WHISKER = 1.5
DENSITY_GRID = 200
VIOLIN_GRID = 100
HISTOGRAM_BINS = 40
# Boxes of a density, in bandwidths: half their width, and how far from its centre a box counts.
BOX_RADIUS, BOX_REACH = 0.25, 9.0
# Moments of a box; ``kernel_error`` says what the rest amounts to.
BOX_MOMENTS = 14


def by_factor(df: DataFrame, factors: Sequence[str], value: str) -> DataFrame:
    """Long form (factor, level, value) of the factors the table has, without nulls.

    All factors then share one scan and one shuffle.
    """
    factors = [f for f in factors if f in df.columns]
    long = have(df, value).select(F.col(value).cast("double").alias("value"), *factors)
    return have(long.unpivot(["value"], factors, "factor", "level"), "level").select("factor", "level", "value")


def level_summary(long: DataFrame, exact: bool = True) -> DataFrame:
    """Mean, median, sample deviation and count of each level of each factor."""
    keys = ["factor", "level"]
    basics = {"mean": F.avg("_v"), "std": F.stddev_samp("_v"), "count": F.count("_v")}
    return quantiles(long, "value", {"median": 0.5}, keys, exact, also=basics).select(*keys, "mean", "median", "std", "count")


def overall_summary(df: DataFrame, value: str, exact: bool = True) -> DataFrame:
    """Count, mean and median of a column, as one row."""
    basics = {"n": F.count("_v"), "mean": F.avg("_v")}
    return quantiles(df, value, {"median": 0.5}, exact=exact, also=basics).select("n", "mean", "median")


def box_stats(long: DataFrame, exact: bool = True) -> DataFrame:
    """Quartiles, whisker ends within 1.5 box heights and outlier count per level, by median."""
    keys = ["factor", "level"]
    box = quantiles(long, "value", {"q1": 0.25, "median": 0.5, "q3": 0.75}, keys, exact)
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    fences = box.withColumns({"_low": F.col("q1") - reach, "_high": F.col("q3") + reach})
    inside = (F.col("value") >= F.col("_low")) & (F.col("value") <= F.col("_high"))
    ends = (
        long.join(small_side(fences), keys)
        .groupBy(*keys, "q1", "median", "q3")
        .agg(
            F.min(F.when(inside, F.col("value"))).alias("_min"),
            F.max(F.when(inside, F.col("value"))).alias("_max"),
            F.count_if(~inside).alias("outliers"),
            F.count(F.lit(1)).alias("count"),
        )
    )
    return ends.select(
        *keys, "count", "q1", "median", "q3",
        F.least("_min", "q1").alias("whisker_low"),
        F.greatest("_max", "q3").alias("whisker_high"),
        "outliers",
    ).orderBy("factor", "median", "level")


def eligible_levels(long: DataFrame, min_rows: int = MIN_GROUP_ROWS) -> DataFrame:
    """Levels with enough rows to take part in an analysis of variance."""
    sizes = long.groupBy("factor", "level").agg(F.count(F.lit(1)).alias("count"))
    return sizes.filter(F.col("count") >= min_rows)


def anova(long: DataFrame, min_rows: int = MIN_GROUP_ROWS, alpha: float = SIGNIFICANCE) -> DataFrame:
    """One-way analysis of variance per factor over levels with at least ``min_rows`` rows.

    A factor with fewer than two such levels is reported as skipped.  Each
    level enters as count, mean and variance, so no group is gathered.
    """
    levels = long.groupBy("factor", "level").agg(
        F.count(F.lit(1)).alias("n"), F.avg("value").alias("m"), F.var_samp("value").alias("v")
    )
    counts = levels.select(
        "factor",
        F.when(F.col("n") >= min_rows, F.col("n").cast("double")).alias("n"),
        "m",
        "v",
    )
    grand = counts.groupBy("factor").agg(F.try_divide(F.sum(F.col("n") * F.col("m")), F.sum("n")).alias("g"))
    sums = (
        counts.join(grand, "factor")
        .groupBy("factor")
        .agg(
            F.count("n").alias("groups"),
            F.sum("n").alias("total"),
            F.sum(F.col("n") * (F.col("m") - F.col("g")) * (F.col("m") - F.col("g"))).alias("between"),
            F.sum((F.col("n") - 1) * F.col("v")).alias("within"),
        )
    )
    skipped = F.col("groups") < 2
    df_between = F.when(~skipped, (F.col("groups") - 1).cast("double"))
    df_within = F.when(~skipped, F.col("total") - F.col("groups"))
    ratio = F.when(F.col("within") > 0, (F.col("between") / df_between) / (F.col("within") / df_within)).when(
        F.col("between") > 0, F.lit(float("inf"))
    )
    tested = sums.select(
        "factor",
        F.when(~skipped, ratio).alias("f"),
        df_between.alias("df_between"),
        df_within.alias("df_within"),
        skipped.alias("skipped"),
    )
    scored = tested.withColumn("p_value", f_p_value("f", "df_between", "df_within"))
    return scored.select(
        "factor", "f", "df_between", "df_within", "p_value",
        (F.col("p_value") < alpha).alias("significant_05"), "skipped",
    )


def kernel_error(radius: float = BOX_RADIUS, moments: int = BOX_MOMENTS, reach: float = BOX_REACH) -> float:
    """Most by which one value's kernel, 1 at its peak, is misjudged when its box stands for it.

    The kernel is a series of Hermite functions in the value's distance from the centre; by Cramer's inequality its n-th
    term is at most 1.09 radius^n / sqrt(n!).  A point beyond the reach loses what the kernel has there.
    """
    tail = sum(1.09 * radius**n / sqrt(factorial(n)) for n in range(moments, moments + 40))
    beyond = exp(-((reach - radius) ** 2) / 2)
    return tail + beyond


def _from_moments(moments: Sequence[str], at: Column) -> Column:
    """The sum of a box's kernels at a point: the Hermite series, ordered by powers of the distance."""
    series = [herm2poly([0] * n + [1]) for n in range(len(moments))]
    total = F.lit(0.0)
    for power in reversed(range(len(moments))):
        terms = [F.lit(float(c[power])) * F.col(m) for m, c in zip(moments, series) if len(c) > power and c[power]]
        coefficient = terms[0]
        for term in terms[1:]:
            coefficient = coefficient + term
        total = total * at + coefficient
    return total * F.exp(-at * at)


def density(
    df: DataFrame, value: str, keys: Sequence[str] = (), grid: int = DENSITY_GRID,
    bins: int | None = None,
) -> DataFrame:
    """Gaussian kernel density per group on a grid from minimum to maximum.

    The bandwidth is the sample deviation times n to the power -1/5.  With
    ``bins`` the density is scaled to the counts of a histogram of so many
    bins.  Values are gathered in boxes of half a bandwidth (a fast Gauss
    transform): each adds to a few moments of its box before the shuffle, and
    only boxes meet the grid points.  A kernel is off by less than
    ``kernel_error()``, about 1e-14 of its peak, and no density is negative.
    A group without spread has no density: its grid is one value, with null.
    """
    keys = list(keys)
    rows = have(df, value, *keys).select(*keys, F.col(value).cast("double").alias("_v"))
    shape = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).cast("double").alias("_n"),
        F.stddev_samp("_v").alias("_std"),
        F.min("_v").alias("_lo"),
        F.max("_v").alias("_hi"),
    )
    shape = settle(shape.filter("_n > 0").select(
        *keys, "_n", "_lo", "_hi",
        F.when(F.col("_std") > 0, F.col("_std") * F.pow("_n", F.lit(-0.2))).alias("_bw"),
        ((F.col("_hi") - F.col("_lo")) / (grid - 1)).alias("_step"),
    ))

    width, unit = 2 * BOX_RADIUS * F.col("_bw"), sqrt(2) * F.col("_bw")
    centre = F.col("_lo") + (F.col("_box") + 0.5) * width
    placed = attach(rows, shape, keys).filter("_bw is not null")
    placed = placed.withColumn("_box", F.floor((F.col("_v") - F.col("_lo")) / width))
    placed = placed.withColumn("_s", (F.col("_v") - centre) / unit)
    moments, power = [f"_m{n}" for n in range(BOX_MOMENTS)], F.lit(1.0)
    sums = []
    for n, name in enumerate(moments):
        sums.append((F.sum(power) / float(factorial(n))).alias(name))
        power = power * F.col("_s")
    boxes = placed.groupBy(*keys, "_lo", "_bw", "_step", "_box").agg(*sums).withColumn("_centre", centre)

    reach = BOX_REACH * F.col("_bw")
    first = F.greatest(F.floor((F.col("_centre") - reach - F.col("_lo")) / F.col("_step")), F.lit(0))
    last = F.least(F.ceil((F.col("_centre") + reach - F.col("_lo")) / F.col("_step")), F.lit(grid - 1))
    met = boxes.withColumn("point", F.explode(F.sequence(first, last)))
    met = met.withColumn("_t", (F.col("_lo") + F.col("point") * F.col("_step") - F.col("_centre")) / unit)
    sums = met.groupBy(*keys, "point").agg(F.sum(_from_moments(moments, F.col("_t"))).alias("_sum"))
    # Every group has every grid point, also where no kernel reaches.
    points = shape.withColumn("point", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(grid - 1).cast("long"))))
    scale = F.lit(1.0) if bins is None else F.col("_n") * (F.col("_hi") - F.col("_lo")) / bins
    norm = F.col("_n") * F.col("_bw") * F.sqrt(2 * F.pi())
    total = F.greatest(F.coalesce("_sum", F.lit(0.0)), F.lit(0.0))
    return points.join(sums, [*keys, "point"], "left").select(
        *keys,
        "point",
        (F.col("_lo") + F.col("point") * F.col("_step")).alias("x"),
        (total / norm * scale).alias("density"),
    )

"""Exact order statistics per group without gathering a group in one task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.session import attach, settle, small_side

ACCURACY = 10_000
# Distinct values of a band that one task orders, and parts that a larger band is cut into.
BAND_ROWS = 200_000
FANOUT = 200


def quantiles(
    df: DataFrame,
    value: str,
    probs: Mapping[str, float],
    keys: Sequence[str] = (),
    exact: bool = True,
    accuracy: int = ACCURACY,
    band_rows: int = BAND_ROWS,
    also: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Quantiles with linear interpolation per group: the keys and one column per named level.

    Null values and null keys are left out.  ``exact=False`` gives the sketch
    estimate.  The exact form reads the rows twice.  A sketch cuts each group
    into bands, tight around the wanted ranks; its rank error is bounded, so
    those ranks lie in the tight bands.  The second pass counts the bands, and
    the distinct values of the tight ones.  A band of more than ``band_rows``
    distinct values is cut again, so no task orders a share of the table.  If a
    wanted rank lay outside the tight bands, the rows of its band would be read
    once more: a poor sketch cannot change the result.

    ``also`` names further aggregates of ``_v``, the value, that the first pass
    makes; groups without any value are then in the result, without quantiles.
    """
    keys = list(keys)
    known = [F.col(c).isNotNull() for c in [*keys, *([] if also else [value])]]
    rows = df.filter(reduce(lambda a, b: a & b, known, F.lit(True))).select(*keys, F.col(value).cast("double").alias("_v"))
    more = [a.alias(name) for name, a in (also or {}).items()]
    if not exact:
        levels = F.array(*[F.lit(float(p)) for p in probs.values()])
        picks = F.percentile_approx("_v", levels, accuracy).alias("_q")
        return rows.groupBy(*keys).agg(picks, *more).select(
            *keys, *(also or {}), *[F.get("_q", F.lit(i)).alias(name) for i, name in enumerate(probs)]
        )

    levels = _cut_levels(list(probs.values()), 3.0 / accuracy)
    first = settle(
        rows.groupBy(*keys)
        .agg(F.percentile_approx("_v", F.array(*[F.lit(x) for x in levels]), accuracy).alias("_c"), *more)
        .select(*keys, *(also or {}), *[F.get("_c", F.lit(i)).alias(f"_c{i}") for i in range(len(levels))])
    )
    cuts = first.select(*keys, *[f"_c{i}" for i in range(len(levels))])
    above = [F.when(F.col("_v") > F.col(f"_c{i}"), 1).otherwise(0) for i in range(len(levels))]
    rows = rows.filter(F.col("_v").isNotNull())
    # A wanted rank's value is at one of its two cuts or between them. Of a band, such values are the largest: they are a
    # band of their own, with an odd number.
    margin = 3.0 / accuracy
    ends = [(levels.index(max(0.0, p - margin)), levels.index(min(1.0, p + margin))) for p in probs.values()]
    tight = reduce(lambda a, b: a | b, [(F.col("_v") >= F.col(f"_c{i}")) & (F.col("_v") <= F.col(f"_c{j}")) for i, j in ends])
    band = 2 * reduce(lambda a, b: a + b, above) + tight.cast("int")
    banded = attach(rows, cuts, keys).select(*keys, "_v", band.alias("_band"))

    own = F.when(F.col("_band") % 2 == 1, F.col("_v"))
    counts = settle(banded.groupBy(*keys, "_band", own.alias("_v")).agg(F.count(F.lit(1)).alias("_n")))
    bands = _with_ranks(counts.groupBy(*keys, "_band").agg(F.sum("_n").alias("_n")), keys, probs)
    ranks = [f"_r{i}_{end}" for i in range(len(probs)) for end in ("lo", "hi")]
    wanted = reduce(lambda a, b: a | b, [_holds(r) for r in ranks])
    bands = bands.filter(wanted)

    # Bands are cut again until one task can order the distinct values of any.
    if bands.filter(F.col("_band") % 2 == 0).isEmpty():
        told = counts.filter(F.col("_v").isNotNull()).join(small_side(bands.drop("_n")), [*keys, "_band"])
        counted = settle(told.select(*keys, "_band", "_v", "_n", F.col("_before").alias("_start"), "_total", *ranks))
    else:
        counted = _distinct(banded.join(small_side(bands.drop("_n")), [*keys, "_band"]), keys, ranks)
    while True:
        largest = counted.groupBy(*keys, "_band").agg(F.count(F.lit(1)).alias("_m")).agg(F.max("_m")).first()[0] or 0
        if largest <= band_rows:
            break
        counted = _cut_again(counted, keys, ranks)

    within = Window.partitionBy(*keys, "_band").orderBy("_v")
    before = F.coalesce(F.sum("_n").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = counted.withColumn("_before", F.col("_start") + before)
    picked = placed.groupBy(*keys).agg(
        F.first("_total").alias("_total"),
        *[F.max(F.when(_holds(r), F.col("_v"))).alias(r) for r in ranks],
    )
    picked = picked.select(
        *keys,
        *[
            (F.col(f"_r{i}_lo") + (F.col(f"_r{i}_hi") - F.col(f"_r{i}_lo")) * _fraction(p)).alias(name)
            for i, (name, p) in enumerate(probs.items())
        ],
    )
    if not also:
        return picked
    first = first.select(*keys, *also)
    if keys:
        return first.join(picked, keys, "left")
    row = picked.select(F.struct(*probs).alias("row")).scalar()
    return first.withColumns({name: row[name] for name in probs})


def _distinct(inside: DataFrame, keys: Sequence[str], ranks: Sequence[str]) -> DataFrame:
    """Distinct values of the bands with their row counts and what is known of the band; settled."""
    known = [F.first("_before").alias("_start"), F.first("_total").alias("_total"), *[F.first(r).alias(r) for r in ranks]]
    return settle(inside.groupBy(*keys, "_band", "_v").agg(F.count(F.lit(1)).alias("_n"), *known))


def _cut_again(counted: DataFrame, keys: Sequence[str], ranks: Sequence[str]) -> DataFrame:
    """The same rows in narrower bands: each band is cut by a sketch of its distinct values, the parts are counted,
    and only parts that hold a wanted rank stay."""
    own = [*keys, "_band"]
    levels = [k / FANOUT for k in range(1, FANOUT)]
    cuts = counted.groupBy(*own).agg(F.percentile_approx("_v", F.array(*map(F.lit, levels)), 10 * FANOUT).alias("_c"))
    part = F.size(F.filter("_c", lambda c: F.col("_v") > c))
    parts = settle(counted.join(small_side(cuts), own).withColumn("_part", part).drop("_c"))
    sizes = parts.groupBy(*own, "_part").agg(F.sum("_n").alias("_n"), *[F.first(c).alias(c) for c in ("_start", *ranks)])
    running = Window.partitionBy(*own).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_before", F.col("_start") + F.coalesce(F.sum("_n").over(running), F.lit(0)))
    kept = sizes.filter(reduce(lambda a, b: a | b, [_holds(r) for r in ranks])).select(*own, "_part", "_before")
    inner = parts.drop("_start").join(small_side(kept), [*own, "_part"])
    # A part becomes a band of its own.
    band = F.xxhash64("_band", "_part")
    return settle(inner.select(*keys, band.alias("_band"), "_v", "_n", F.col("_before").alias("_start"), "_total", *ranks))


def _cut_levels(probs: Sequence[float], margin: float) -> list[float]:
    """Quantile levels just below and just above each wanted one."""
    around = {min(1.0, max(0.0, p + side)) for p in probs for side in (-margin, margin)}
    return sorted(around)


def _position(p: float) -> Column:
    return F.lit(float(p)) * (F.col("_total") - 1)


def _fraction(p: float) -> Column:
    return _position(p) - F.floor(_position(p))


def _holds(rank: str) -> Column:
    """True when the zero-based rank falls into this run of ``_n`` rows after ``_before`` rows."""
    return (F.col("_before") <= F.col(rank)) & (F.col(rank) < F.col("_before") + F.col("_n"))


def _with_ranks(bands: DataFrame, keys: list[str], probs: Mapping[str, float]) -> DataFrame:
    """Adds the rows before each band, the group total and the wanted ranks.

    A group has at most two bands more than twice its cut levels, so these windows are short.
    """
    per_group = Window.partitionBy(*keys)
    running = per_group.orderBy("_band").rowsBetween(Window.unboundedPreceding, -1)
    bands = bands.withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
    bands = bands.withColumn("_total", F.sum("_n").over(per_group))
    return bands.select(
        "*",
        *[F.floor(_position(p)).alias(f"_r{i}_lo") for i, p in enumerate(probs.values())],
        *[F.ceil(_position(p)).alias(f"_r{i}_hi") for i, p in enumerate(probs.values())],
    )

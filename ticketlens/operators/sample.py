"""Seeded samples and train/test splits that do not depend on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.session import settle, small_side, stage_table

TEST_SHARE = 0.2
_BUCKET_DIGITS = 4  # leading hex digits of the hash: 65,536 buckets


def seeded_hash(key: str, seed: int) -> Column:
    """Hash text of a row id and a seed: a fixed random order."""
    return F.md5(F.concat(F.coalesce(F.col(key).cast("string"), F.lit("")), F.lit(f":{seed}")))


def _cut_keys(df: DataFrame, key: str, seed: int, groups: list[str], size: Column) -> DataFrame:
    """The hash and id of the last row to take in each group, when ``size`` rows are taken.

    ``size`` may use ``_total``, the rows of the group.  Rows are first counted
    by leading hash digits; only the bucket where the count is reached is
    ordered, so no group is sorted as a whole.
    """
    hashed = df.select(*groups, F.col(key).cast("string").alias("_id"), seeded_hash(key, seed).alias("_hash"))
    hashed = hashed.withColumn("_bucket", F.substring("_hash", 1, _BUCKET_DIGITS))
    per_group = Window.partitionBy(*groups)
    running = per_group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    # At most 65,536 buckets per group go through this window.
    counts = hashed.groupBy(*groups, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    buckets = (
        counts.withColumn("_total", F.sum("_n").over(per_group))
        .withColumn("_before", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .withColumn("_size", size)
        .filter((F.col("_before") < F.col("_size")) & (F.col("_size") <= F.col("_before") + F.col("_n")))
        .select(*groups, "_bucket", (F.col("_size") - F.col("_before")).alias("_rank"))
    )
    inside = hashed.join(small_side(buckets), [*groups, "_bucket"])
    order = Window.partitionBy(*groups, "_bucket").orderBy("_hash", "_id")
    ranked = inside.withColumn("_row", F.row_number().over(order))
    # Rows of the last id up to the last one to take.
    same = Window.partitionBy(*groups, "_bucket", "_hash", "_id")
    ranked = ranked.withColumn("_take", F.row_number().over(same.orderBy("_row"))).withColumn("_tied", F.count("*").over(same))
    return ranked.filter(F.col("_row") == F.col("_rank")).select(
        *groups, F.struct("_hash", "_id").alias("_cut"), "_take", "_tied"
    )


def sample_exact(df: DataFrame, n: int, key: str, seed: int) -> DataFrame:
    """``n`` rows chosen by seeded hash of an id, or all rows if there are no more.

    Only hashes and ids are compared, and the ids are stored to be; the chosen rows stay where they are.  Of rows that share the last id, as many as
    are needed are taken in the order of a hash of the row.
    """
    last = _cut_keys(stage_table(df.select(key)), key, seed, [], F.least(F.col("_total"), F.lit(n))).select("_cut.*", "_take", "_tied").first()
    if last is None:
        return df.limit(0)
    mine = F.struct(seeded_hash(key, seed).alias("_hash"), F.col(key).cast("string").alias("_id"))
    cut = F.struct(F.lit(last["_hash"]).alias("_hash"), F.lit(last["_id"]).cast("string").alias("_id"))
    if last["_take"] == last["_tied"]:
        return df.filter(mine <= cut)
    tied = df.filter(mine.eqNullSafe(cut)).orderBy(F.xxhash64(*df.columns)).limit(last["_take"])
    return df.filter(mine < cut).unionByName(tied)


def split_hash(df: DataFrame, key: str, seed: int, share: float = TEST_SHARE) -> DataFrame:
    """Adds ``is_test`` for about ``share`` of the rows, without any shuffle."""
    leading = F.conv(F.substring(seeded_hash(key, seed), 1, 8), 16, 10).cast("long")
    return df.withColumn("is_test", leading < F.lit(int(share * 2**32)))


def split_exact(
    df: DataFrame, key: str, seed: int, share: float = TEST_SHARE, by: str | None = None
) -> DataFrame:
    """Adds ``is_test`` for exactly the rounded-up share of the rows, or of each class ``by``.

    Rows without a class form a class of their own.
    """
    size = F.ceil(F.col("_total") * F.lit(share))
    mine = F.struct(seeded_hash(key, seed).alias("_hash"), F.col(key).cast("string").alias("_id"))
    if by is None:
        cut = settle(_cut_keys(df, key, seed, [], size)).select("_cut").scalar()
        return df.withColumn("is_test", F.coalesce(mine <= cut, F.lit(False)))
    groups = ["_known", "_class"]
    flagged = df.withColumns(
        {"_known": F.col(by).isNotNull(), "_class": F.coalesce(F.col(by).cast("string"), F.lit(""))}
    )
    cuts = small_side(_cut_keys(flagged, key, seed, groups, size).drop("_take", "_tied"))
    chosen = F.coalesce(mine <= F.col("_cut"), F.lit(False))
    return flagged.join(cuts, groups, "left").withColumn("is_test", chosen).select(*df.columns, "is_test")

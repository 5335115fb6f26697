"""Samples and splits."""

import hashlib
import math

from pyspark.sql import functions as F

from ticketlens.operators import sample


def ids(spark, n=2000, parts=4):
    classes = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, "rare").otherwise(F.lit(None))
    return spark.range(0, n, 1, parts).select(F.col("id").cast("string").alias("id"), classes.alias("c"))


def order(values, seed=42):
    return sorted(values, key=lambda v: (hashlib.md5(f"{v}:{seed}".encode()).hexdigest(), v))


def test_sample_is_the_first_by_hash(spark):
    expected = set(order([str(i) for i in range(2000)])[:137])
    for parts in (1, 7):
        got = [r.id for r in sample.sample_exact(ids(spark, parts=parts), 137, "id", 42).collect()]
        assert len(got) == 137 and set(got) == expected


def test_sample_of_fewer_rows_keeps_all(spark):
    assert sample.sample_exact(ids(spark, 50), 100, "id", 42).count() == 50
    assert sample.sample_exact(ids(spark, 50).filter("id = 'none'"), 100, "id", 42).count() == 0


def test_sample_of_repeated_ids_has_the_size(spark):
    for n in (1, 7, 40):
        rows = spark.range(60).select(F.lit("same").alias("id"), (F.col("id") % 30).alias("v"))
        assert sample.sample_exact(rows, n, "id", 42).count() == n


def test_hash_split_is_complete_and_fixed(spark):
    split = sample.split_hash(ids(spark), "id", 42)
    again = sample.split_hash(ids(spark, parts=9), "id", 42)
    test = {r.id for r in split.filter("is_test").collect()}
    assert split.count() == 2000 and test == {r.id for r in again.filter("is_test").collect()}
    assert 300 < len(test) < 500


def test_exact_split(spark):
    split = sample.split_exact(ids(spark, 1001), "id", 42)
    assert split.filter("is_test").count() == math.ceil(0.2 * 1001)
    assert split.count() == 1001


def test_stratified_split(spark):
    split = sample.split_exact(ids(spark), "id", 42, by="c")
    rows = split.groupBy("c").agg(F.count("*").alias("n"), F.count_if("is_test").alias("t")).collect()
    assert all(r.t == math.ceil(r.n * 0.2) for r in rows) and {r.c for r in rows} == {"hot", "rare", None}

"""Joins, dedupes and dimensions, with hot and null keys."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ticketlens import session
from ticketlens.operators import dedupe, dimension, join, repair


def rows_of(df):
    columns = sorted(df.columns)
    return sorted(map(str, (tuple(r) for r in df.select(*columns).collect())))


def skewed(spark):
    """A third of the rows have one key, a third no key, the rest spread keys, some unknown."""
    key = F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 3 == 1, F.lit(None)).otherwise(
        (F.col("id") % 700).cast("string")
    )
    left = spark.range(6000).select("id", key.alias("key"), (F.col("id") % 5).alias("own"))
    names = spark.range(500).select(F.col("id").cast("string").alias("key"), (F.col("id") * 2).alias("value"))
    right = names.unionByName(spark.createDataFrame([("hot", 7)], "key string, value long"))
    return left, right


def shuffled(spark):
    """Joins by shuffle, with any partition above the median counted as skewed."""
    for name, value in {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
                        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
                        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.2"}.items():
        spark.conf.set(name, value)


@pytest.fixture
def by_shuffle(spark):
    names = ["spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
             "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.skewJoin.skewedPartitionFactor"]
    shuffled(spark)
    yield
    for name in names:
        spark.conf.unset(name)


def test_skewed_lookup(spark, by_shuffle):
    left, right = skewed(spark)
    found = join.left_lookup(left, right, "key")
    assert found.columns == ["key", "id", "own", "value"] and found.count() == 6000
    assert found.filter("key = 'hot' and value = 7").count() == 2000
    assert rows_of(found) == rows_of(left.join(right, "key", "left"))


def test_lookup_never_adds_rows(spark):
    left, right = skewed(spark)
    twice = right.unionByName(right.withColumn("value", F.col("value") + 1))
    assert rows_of(join.left_lookup(left, twice, "key")) == rows_of(join.left_lookup(left, right, "key"))


def test_small_side_is_measured(spark, monkeypatch):
    wide = spark.range(20).select("id", F.repeat(F.lit("x"), 100).alias("text"))
    assert "ResolvedHint" in session.small_side(wide)._jdf.queryExecution().analyzed().toString()
    monkeypatch.setattr(session, "BROADCAST_BYTES", 1000)
    assert "ResolvedHint" not in session.small_side(wide)._jdf.queryExecution().analyzed().toString()


def test_scratch_is_cleared(spark):
    path = session.scratch_path(spark, "gone")
    spark.range(3).write.parquet(path)
    folder = Path(path.removeprefix("file:"))
    assert folder.exists()
    session.clear_scratch()
    assert not folder.exists()


def test_hot_key_without_right_row(spark):
    left, right = skewed(spark)
    joined = join.left_lookup(left, right.filter("key <> 'hot'"), "key")
    assert joined.count() == 6000 and joined.filter("key = 'hot' and value is not null").count() == 0


def test_first_rows_without_order(spark):
    rows = [("t1", None, "smb"), ("t2", None, "b"), ("t2", 5, "c"), ("t2", 7, None), ("t3", 2, None)]
    df = spark.createDataFrame(rows, "k string, pos int, segment string")
    got = {r.k: (r.pos, r.segment) for r in dedupe.keep_first(df, "k", "pos").collect()}
    assert got == {"t1": (None, "smb"), "t2": (5, "c"), "t3": (2, None)}
    keys = spark.createDataFrame([("t1",), ("t2",), ("t9",)], "k string")
    found = {r.k: r.segment for r in join.lookup_first(keys, df, "k", ["segment"], "pos").collect()}
    assert found == {"t1": "smb", "t2": "c", "t9": None}


def test_enrich_drops_shared_columns(spark):
    left = spark.createDataFrame([("1", "EU")], "customer_id string, region string")
    right = spark.createDataFrame([("1", "X", "US")], "customer_id string, region string, country string")
    wide = join.enrich(left, right, "customer_id")
    assert wide.columns == ["customer_id", "region", "country"] and wide.first().region == "EU"
    assert join.shared_columns(left, right, "customer_id") == ["region"]


def test_own_country_wins(spark):
    lookup = spark.createDataFrame([("1", "Japan"), ("2", "Egypt")], "customer_id string, country string")
    df = spark.createDataFrame([("1", "France"), ("2", None), ("3", None)], "customer_id string, country string")
    found = join.lookup_filling(df, lookup, "customer_id", "country").orderBy("customer_id").collect()
    assert [r.country for r in found] == ["France", "Egypt", None]
    bare = join.lookup_filling(df.select("customer_id"), lookup, "customer_id", "country")
    assert {r.customer_id: r.country for r in bare.collect()} == {"1": "Japan", "2": "Egypt", "3": None}


def test_impute_regions(spark):
    lookup = spark.createDataFrame([("1", "Japan"), ("2", "Atlantis")], "customer_id string, country string")
    rows = [("1", None), ("1", "EU"), ("2", " Unknown "), ("3", ""), (None, "NA")]
    df = spark.createDataFrame(rows, "customer_id string, region string")
    fixed, counters = repair.impute_regions(df, lookup)
    assert fixed.columns == ["customer_id", "region"]
    assert sorted(r.region for r in fixed.collect()) == ["APAC", "EU", "NA", "Unknown", "Unknown"]
    counts = counters.first().asDict()
    assert counts == {"missing_before": 3, "imputed_from_country": 1, "set_unknown": 2, "missing_after": 2}


def test_mapping_as_table(spark):
    df = spark.createDataFrame([(" A ",), ("b",), (None,)], "v string")
    table = spark.createDataFrame([("a", "first")], "k string, v string")
    mapped = join.map_values(df, "v", table, "other", "w")
    assert sorted(r.w for r in mapped.collect()) == ["first", "other", "other"]


def test_exact_copies_with_nulls(spark):
    df = spark.createDataFrame([("a", None), ("a", None), (None, None), ("a", "b")], "x string, y string")
    assert dedupe.drop_exact(df).count() == 3
    assert dedupe.exact_copies(df).first().asDict() == {"rows_before": 4, "rows_after": 3, "rows_dropped": 1}
    empty = dedupe.exact_copies(df.limit(0)).first().asDict()
    assert empty == {"rows_before": 0, "rows_after": 0, "rows_dropped": 0}


def test_keep_first_any_partitioning(spark):
    df = spark.range(3000).select((F.col("id") % 7).alias("key"), F.col("id").alias("pos"), (-F.col("id")).alias("v"))
    expected = [(k, k, -k) for k in range(7)]
    for parts in (1, 5, 13):
        first = dedupe.keep_first(df.repartition(parts), "key", "pos").orderBy("key")
        assert [tuple(r) for r in first.collect()] == expected
    assert dedupe.keep_first(df, "key", "pos", drop_order=True).columns == ["key", "v"]


def test_duplicate_reports(spark):
    df = spark.createDataFrame([("a",), ("a",), ("a",), ("b",)], "k string")
    assert [tuple(r) for r in dedupe.duplicate_keys(df, "k").collect()] == [("a", 3, 2)]
    assert tuple(dedupe.duplicate_summary(df, "k").first()) == (4, 2, 2, 1)


def test_dimension_keys_over_many_partitions(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(5000).select(F.format_string("v%05d", (F.col("id") * 7) % 4000).alias("v"))
        rows = dimension.dimension(df, "v", "v").orderBy("v_key").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert [r.v_key for r in rows] == list(range(1, 4001))
    assert [r.v_name for r in rows] == [f"v{i:05d}" for i in range(4000)]


def test_product_area_dimension(spark):
    names = ["billing", "api_integration", "mobile_app", "login_auth", None, "notifications", "data_export",
             "analytics_dashboard", "billing"]
    df = spark.createDataFrame([(n,) for n in names], "product_area string")
    rows = dimension.dimension(df, "product_area", "product_area").orderBy("product_area_key").collect()
    assert [tuple(r) for r in rows] == list(enumerate(sorted({n for n in names if n}), 1))


def test_key_coverage(spark):
    left = spark.createDataFrame([("1",), ("1",), ("2",), ("9",), (None,)], "k string")
    right = spark.createDataFrame([("1",), ("2",), ("2",), (None,)], "k string")
    assert tuple(join.key_coverage(left, right, "k").first()) == (3, 2, 1)
    assert [r.k for r in join.orphans(left, right, "k").collect()] == ["9"]


ODD_ROWS = [("a", 1, 0.0), ("a", 1, -0.0), (None, 1, None), (None, 1, None), ("", None, float("nan")), ("", None, float("nan")),
            ("long " * 20_000, 2, 1.0), ("long " * 20_000, 2, 1.0), ("once", 3, 2.0)]


@pytest.mark.parametrize("bits", [16, 1])
def test_rows_that_repeat_are_dropped_in_place(spark, bits):
    """Few bits force false positives: most rows are then compared whole, and the result stays."""
    rows = ODD_ROWS + [(f"t{k}", k, k / 7) for k in range(3000)] + [(f"t{k}", k, k / 7) for k in range(0, 3000, 3)] * 2
    df = spark.createDataFrame(rows, "text string, n long, v double").repartition(7)
    got = dedupe.drop_exact_in_place(df, filter_bits=bits)
    assert got.columns == df.columns and got.count() == df.distinct().count() == 3005
    assert got.exceptAll(df.distinct()).isEmpty() and df.distinct().exceptAll(got).isEmpty()


def test_drop_in_place_edges(spark):
    empty = spark.createDataFrame([], "a string")
    assert dedupe.drop_exact_in_place(empty).isEmpty()
    df = spark.range(2000).selectExpr("id % 1000 AS id", "'x' AS `odd name`")
    # A filter with too few bytes for the repeated rows: all rows are compared.
    assert dedupe.drop_exact_in_place(df, filter_bytes=8).count() == 1000
    assert dedupe.drop_exact_in_place(df.distinct()).count() == 1000


def test_rows_that_occur_once_are_in_no_exchange(spark, capsys):
    """One side of the union is only a filter of the table; the exchange is on the other."""
    df = spark.createDataFrame([(f"row {k}",) for k in range(5000)] + [("twice",)] * 2, "text string")
    got = dedupe.drop_exact_in_place(df)
    got.explain()
    plan = capsys.readouterr().out.split("== Initial Plan ==")[-1]
    assert "Union" in plan and plan.count("Exchange hashpartitioning(text") == 1
    once, inside = plan.split("Union", 1)[1].split("HashAggregate", 1)
    assert "Exchange" not in once and "Filter (" in once and "Exchange hashpartitioning(text" in inside
    assert got.count() == 5001

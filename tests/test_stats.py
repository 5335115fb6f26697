"""Quantiles, densities, histograms and variance analysis against numpy and brute force."""

import math
import os
import subprocess
import sys
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ticketlens.functions.distribution import f_upper_tail
from ticketlens.operators import aggregate, profile, stats
from ticketlens.operators.quantile import quantiles

PROBS = {"a": 0.0, "q1": 0.25, "m": 0.5, "q3": 0.75, "z": 1.0}


def frame(spark, values, groups=None):
    data = pd.DataFrame({"v": values})
    data["g"] = groups if groups is not None else "x"
    return spark.createDataFrame(data)


def check(spark, df, data, accuracy=10_000):
    got = {r.g: r for r in quantiles(df, "v", PROBS, ["g"], accuracy=accuracy).collect()}
    for g, part in data.dropna().groupby("g"):
        expected = np.quantile(part["v"], list(PROBS.values()))
        assert [got[g][p] for p in PROBS] == pytest.approx(list(expected), abs=1e-9)


@pytest.mark.parametrize("accuracy", [10_000, 20])
def test_quantiles_of_skewed_groups(spark, accuracy):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.exponential(30, 20_000), np.full(15_000, 7.0), rng.normal(size=11), [5.0]])
    groups = np.array(["a"] * 20_000 + ["a"] * 15_000 + ["b"] * 11 + ["c"])
    data = pd.DataFrame({"v": values, "g": groups})
    # A coarse sketch makes the bands wide but must not change the result.
    check(spark, frame(spark, values, groups).repartition(6), data, accuracy)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=40))
def test_quantiles_of_any_list(spark, values):
    row = quantiles(frame(spark, values), "v", PROBS).first()
    assert [row[p] for p in PROBS] == pytest.approx(list(np.quantile(values, list(PROBS.values()))), abs=1e-6)


def test_quantile_fixture_and_nulls(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (3.0,), (4.0,), (None,)], "v double")
    row = profile.describe(df).first()
    assert (row["25%"], row["50%"], row["75%"], row["count"]) == (1.75, 2.5, 3.25, 4.0)
    assert row["std"] == pytest.approx(1.2909944487)
    # Without keys there is always one row, as in any aggregate.
    assert [tuple(r) for r in quantiles(df.filter("v > 9"), "v", PROBS).collect()] == [(None,) * 5]
    assert stats.overall_summary(df.filter("v > 9"), "v").first().asDict() == {"n": 0, "mean": None, "median": None}


def test_approximate_form(spark):
    df = frame(spark, np.arange(1001.0))
    assert quantiles(df, "v", {"m": 0.5}, ["g"], exact=False).first().m == pytest.approx(500, abs=1)


def test_histogram_equals_numpy(spark):
    rng = np.random.default_rng(5)
    values = np.round(rng.exponential(30, 5000), 2)
    counts, edges = np.histogram(values, bins=40)
    rows = aggregate.histogram(frame(spark, values), "v", 40).orderBy("bin").collect()
    assert abs(np.array([r.n for r in rows]) - counts).sum() <= 2  # values on an edge may round to either side
    assert sum(r.n for r in rows) == 5000
    assert [r.bin_start for r in rows] == pytest.approx(list(edges[:-1]))


def test_histogram_of_one_value(spark):
    rows = aggregate.histogram(frame(spark, [3.0, 3.0]), "v", 4).orderBy("bin").collect()
    assert (rows[0].bin_start, rows[-1].bin_end, sum(r.n for r in rows)) == (2.5, 3.5, 2)


def brute_density(values, grid):
    n, width = len(values), values.std(ddof=1) * len(values) ** -0.2
    x = np.linspace(values.min(), values.max(), grid)
    return np.exp(-(((x[:, None] - values[None, :]) / width) ** 2) / 2).sum(axis=1) / (n * width * math.sqrt(2 * math.pi))


def test_density_equals_brute_force(spark):
    rng = np.random.default_rng(6)
    values = np.concatenate([rng.exponential(30, 700), [2000.0]])
    groups = np.array(["a"] * 500 + ["b"] * 201)
    got = stats.density(frame(spark, values, groups), "v", ["g"], 100).toPandas().sort_values(["g", "point"])
    for g in ("a", "b"):
        assert got[got.g == g].density.to_numpy() == pytest.approx(brute_density(values[groups == g], 100), abs=1e-12)
    scaled = stats.density(frame(spark, values), "v", bins=40).toPandas().sort_values("point")
    factor = len(values) * (values.max() - values.min()) / 40
    assert scaled.density.to_numpy() == pytest.approx(brute_density(values, 200) * factor, abs=1e-9)


def test_density_error_is_within_its_bound(spark):
    """Values at the edges and centres of boxes, far out and repeated: no point is off by more than the bound."""
    assert stats.kernel_error() < 1e-13
    rng = np.random.default_rng(16)
    values = np.concatenate([rng.normal(0, 1, 4000), np.repeat(rng.normal(0, 1, 5), 200), [-30.0, 45.0]])
    width = values.std(ddof=1) * len(values) ** -0.2
    values = np.concatenate([values, values.min() + width / 2 * np.arange(40), values.min() + width / 4 * np.arange(40)])
    width = values.std(ddof=1) * len(values) ** -0.2
    got = stats.density(frame(spark, values), "v").toPandas().sort_values("point").density.to_numpy()
    peak = 1 / (width * math.sqrt(2 * math.pi))
    assert np.abs(got - brute_density(values, 200)).max() < 1e-9 * peak and (got >= 0).all()


def test_density_makes_no_row_per_value_and_point(spark, capsys):
    """Values are summed into boxes first: the only rows made are those of boxes and of the grid."""
    stats.density(frame(spark, [float(x) for x in range(50)], ["a", "b"] * 25), "v", ["g"]).explain()
    plan = capsys.readouterr().out
    boxes = next(k for k, line in enumerate(plan.splitlines()) if "Generate explode(sequence(greatest" in line)
    below = plan.splitlines()[boxes + 1:]
    assert any("HashAggregate" in line and "_box" in line for line in below)


def test_density_of_one_value_is_null(spark):
    assert stats.density(frame(spark, [1.0, 1.0]), "v").filter("x = 1 and density is null").count() == 200


def test_f_tail_values():
    assert f_upper_tail(2.17, 4, 60108) == pytest.approx(0.0696, abs=5e-5)
    assert f_upper_tail(0.82, 2, 60110) == pytest.approx(0.4404, abs=5e-5)
    assert f_upper_tail(848.02, 3, 60109) < 1e-300
    assert f_upper_tail(0.0, 3, 10) == 1.0 and f_upper_tail(float("inf"), 3, 10) == 0.0
    assert math.isnan(f_upper_tail(float("nan"), 3, 10))
    # One and any degrees of freedom: t distribution; two and many: exponential tail.
    assert f_upper_tail(1.0, 1, 1) == pytest.approx(0.5)
    assert f_upper_tail(3.0, 2, 1e11) == pytest.approx(math.exp(-3.0), rel=1e-4)
    assert f_upper_tail(161.4476, 1, 1) == pytest.approx(0.05, rel=1e-5)
    assert f_upper_tail(3.4780496, 4, 10) == pytest.approx(0.05, rel=1e-5)


def test_anova_against_formula_and_jvm_class(spark):
    rng = np.random.default_rng(7)
    groups = np.array(["a"] * 50 + ["b"] * 70 + ["c"] * 30 + ["d"] * 9)
    values = rng.normal(size=len(groups)) + (groups == "b") * 0.5 + (groups == "d") * 50
    df = frame(spark, values, groups).withColumn("one", F.lit("same"))
    rows = {r.factor: r for r in stats.anova(stats.by_factor(df, ("g", "one", "absent"), "v")).collect()}
    parts = [values[groups == g] for g in "abc"]  # d has fewer than ten rows
    all_values = np.concatenate(parts)
    between = sum(len(p) * (p.mean() - all_values.mean()) ** 2 for p in parts) / 2
    within = sum(((p - p.mean()) ** 2).sum() for p in parts) / (len(all_values) - 3)
    assert rows["g"].f == pytest.approx(between / within)
    assert (rows["g"].df_between, rows["g"].df_within, rows["g"].skipped) == (2.0, 147.0, False)
    assert rows["g"].significant_05 == (rows["g"].p_value < 0.05)
    assert rows["one"].skipped and rows["one"].f is None and rows["one"].p_value is None
    assert set(rows) == {"g", "one"}


def test_anova_without_spread(spark):
    df = frame(spark, [1.0] * 10 + [2.0] * 10, ["a"] * 10 + ["b"] * 10)
    row = stats.anova(stats.by_factor(df, ("g",), "v")).first()
    assert row.f == float("inf") and row.p_value == 0.0 and row.significant_05


def test_boxes(spark):
    values = np.array([1.0, 2.0, 3.0, 4.0, 100.0])
    row = stats.box_stats(stats.by_factor(frame(spark, values), ("g",), "v")).first()
    assert (row.q1, row.median, row.q3) == (2.0, 3.0, 4.0)
    assert (row.whisker_low, row.whisker_high, row.outliers) == (1.0, 4.0, 1)


def test_level_summary_covers_small_levels(spark):
    df = frame(spark, [1.0, 2.0, 5.0], ["a", "a", "b"])
    rows = {r.level: r for r in stats.level_summary(stats.by_factor(df, ("g",), "v")).collect()}
    assert (rows["b"]["count"], rows["b"]["median"], rows["b"]["std"]) == (1, 5.0, None)
    assert rows["a"]["mean"] == 1.5


def test_profile(spark):
    df = spark.createDataFrame([("a", None, 1), (" ", None, 2)], "x string, y string, z int")
    plain = [tuple(r) for r in profile.missing_profile(df).collect()]
    assert plain == [("y", 2, 100.0), ("x", 0, 0.0), ("z", 0, 0.0)]
    blank = [tuple(r) for r in profile.missing_profile(df, blank_as_missing=True).collect()]
    assert blank == [("y", 2, 100.0), ("x", 1, 50.0), ("z", 0, 0.0)]
    assert profile.numeric_columns(df) == ["z"]


def test_cross_tab_sums_to_group_sizes(spark):
    df = spark.range(1000).select((F.col("id") % 4).cast("string").alias("r"), (F.col("id") % 3).cast("string").alias("c"))
    some = df.withColumn("c", F.when(F.col("r") != "0", F.col("c")))
    sizes = aggregate.group_sizes(df.filter("r <> '0'"), ["r", "c"])
    for values, columns in ((None, ["r", "0", "1", "2"]), (["1", "9"], ["r", "1", "9", "other"])):
        tab = aggregate.cross_tab(some, "r", "c", values)
        assert tab.columns == columns
        assert sum(sum(r[1:]) for r in tab.collect()) == sizes.agg(F.sum("n")).first()[0]
    odd = spark.createDataFrame([("m", "critical"), ("x", "critical")], "r string, c string")
    assert sorted(map(tuple, aggregate.cross_tab(odd, "r", "c", ["urgent"]).collect())) == [("m", 0, 1), ("x", 0, 1)]


@pytest.mark.parametrize("band_rows", [1, 300])
def test_large_bands_are_cut_again(spark, band_rows):
    """A poor sketch makes one band of nearly all rows; it is cut until a task orders few of them."""
    rng = np.random.default_rng(9)
    data = pd.DataFrame({"v": np.concatenate([rng.normal(size=8000).round(3), np.full(3000, 0.5)]), "g": ["a", "b"] * 5500})
    got = {r.g: r for r in quantiles(spark.createDataFrame(data), "v", PROBS, ["g"], accuracy=5, band_rows=band_rows).collect()}
    for g, part in data.groupby("g"):
        assert [got[g][p] for p in PROBS] == pytest.approx(list(np.quantile(part["v"], list(PROBS.values()))), abs=1e-9)


def test_density_of_equal_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("b", 1.0), ("b", 2.0)], "g string, v double")
    curve = stats.density(df, "v", ["g"], 10)
    assert curve.filter("g = 'a'").count() == 10 == curve.filter("g = 'a' and x = 1 and density is null").count()
    assert curve.filter("g = 'b' and density > 0").count() == 10


def test_anova_from_another_folder(tmp_path):
    """Workers that cannot import the package get its functions by value."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark.sql import SparkSession
from ticketlens.operators import stats
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
long = spark.range(100).selectExpr("'f' AS factor", "CAST(id % 2 AS string) AS level", "CAST(id % 7 AS double) AS value")
print("p =", stats.anova(long).first().p_value)
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=200)
    assert "p = 0." in done.stdout, done.stderr[-2000:]


def test_summaries_read_their_table_twice(spark):
    """One pass for moments and sketch, one for the counts; ties and a group without values included."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = [(f, k % 3, None if f == "none" else float((k * 37) % 101 // 2)) for f in ("a", "none") for k in range(600)]
    df = spark.createDataFrame(rows, "factor string, level int, value double")
    read = df.mapInArrow(counted, df.schema)
    out = {(r["factor"], r["level"]): r for r in stats.level_summary(read).collect()}
    assert seen.value == 2 * len(rows)
    for level in range(3):
        own = sorted(v for f, n, v in rows if (f, n) == ("a", level))
        assert out["a", level]["median"] == (own[99] + own[100]) / 2 and out["a", level]["count"] == 200

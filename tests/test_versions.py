"""Tables replaced in one step, and cross-tabs as maps."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ticketlens.operators import aggregate, evaluate
from ticketlens.sources import versions


def folders(path):
    return sorted(p.name for p in Path(path).iterdir() if p.name.startswith("data-"))


def test_replacements_and_what_stays(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.versions(spark, path, 5) == []
    with pytest.raises(ValueError, match="has 0 versions"):
        versions.read_current(spark, path)
    for n in (3, 5, 7):
        versions.replace_table(spark.range(n).withColumn("b", F.lit("x")), path)
    assert versions.read_current(spark, path).count() == 7 and versions.read_current(spark, path, back=1).count() == 5
    assert versions.read_current(spark, path, ["id"]).columns == ["id"]
    assert len(folders(path)) == 2 and [v.version for v in versions.versions(spark, path, 9)] == [3, 2, 1]


def test_table_replaced_by_what_it_holds(spark, tmp_path):
    path = str(tmp_path / "t")
    old = versions.replace_table(spark.range(10), path)
    new = versions.replace_table(old.filter("id < 4"), path, keep=1)
    assert new.count() == 4 and len(folders(path)) == 1


def test_a_run_stopped_before_the_switch_leaves_the_old_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    versions.replace_table(spark.range(10), path)

    def stopped(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as broken:
        broken.setattr(versions, "_switch", stopped)
        with pytest.raises(KeyboardInterrupt):
            versions.replace_table(spark.range(99), path)
    assert len(folders(path)) == 2 and versions.read_current(spark, path).count() == 10
    # A job that fails while it writes is never seen either.
    bad = spark.range(5).select(F.when(F.col("id") < 3, F.col("id")).otherwise(F.raise_error(F.lit("no")).cast("long")).alias("id"))
    with pytest.raises(Exception, match="no"):
        versions.replace_table(bad, path)
    assert versions.read_current(spark, path).count() == 10
    assert versions.replace_table(spark.range(2), path).count() == 2 == versions.read_current(spark, path).count()


def test_a_reader_that_began_before_the_switch_ends(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace_table(spark.range(10), path)
    reader = versions.read_current(spark, path)
    versions.replace_table(spark.range(3), path)
    assert reader.count() == 10


def test_cells_hold_any_number_of_values(spark):
    df = spark.range(60_000).selectExpr("cast(id % 3 AS string) AS r", "id % 20000 AS c")
    df = df.unionByName(spark.createDataFrame([(None, 1), ("0", None)], "r string, c long"))
    found = {x.r: x.cells for x in aggregate.cross_tab_cells(df, "r", "c").collect()}
    assert set(found) == {"0", "1", "2"} and all(sum(m.values()) == 20_000 for m in found.values())
    keys = aggregate.cross_tab_cells(df, "r", "c").select(F.map_keys("cells").alias("k")).filter("k <> array_sort(k)")
    assert keys.isEmpty()
    assert aggregate.cross_tab_cells(df.limit(0), "r", "c").isEmpty()


def test_confusion_cells_equal_the_matrix(spark):
    df = spark.range(500).selectExpr("concat('c', id % 4) AS y", "if(id % 50 = 0, null, concat('c', id % 3)) AS p")
    wide = {r.label: r.asDict() for r in evaluate.confusion_matrix(df, "y", "p").collect()}
    for r in evaluate.confusion_cells(df, "y", "p").collect():
        assert all(wide[r.label][c] == r.cells.get(c, 0) for c in ("c0", "c1", "c2", "c3"))

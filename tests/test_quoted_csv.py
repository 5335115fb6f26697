"""Quoted CSV in parallel: ranges that begin anywhere give the records of the whole file."""

import random

import pytest
from pyspark.sql import functions as F

from ticketlens.sources import quoted, tables

PARTS = ["plain", "", 'say ""hi""', "two\nlines", "a,b", "\n\n", "x" * 40, "é中\r\nend", '""', " blank "]


def written(tmp_path, seed, n=60, name="a.csv", ending="\n"):
    """A file of random fields, some quoted with breaks, and its rows."""
    r = random.Random(seed)
    rows, text = [], "id,v,w" + ending
    for k in range(n):
        fields = [r.choice(PARTS) for _ in range(2)]
        text += ",".join([str(k), *(f'"{f}"' if r.random() < 0.5 or any(c in f for c in ',"\n') else f for f in fields)]) + ending
        rows.append((str(k), *(f.replace('""', '"') or None for f in fields)))
    (tmp_path / name).write_bytes(text.encode())
    return rows, len(text.encode())


def test_breaks_at_every_boundary(spark, tmp_path):
    """Blocks of a few bytes up to the whole file: they begin in fields, at quotes and at breaks."""
    rows, size = written(tmp_path, 1, n=12)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        for step in (7, 12, 31, 97, size + 1):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(step))
            spark.conf.set("spark.sql.files.minPartitionNum", "1")
            frame = tables.read_csv(spark, str(tmp_path), position=True)
            got = frame.orderBy(tables.POSITION).drop(tables.POSITION).collect()
            assert [tuple(x) for x in got] == rows, step
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])
        spark.conf.unset("spark.sql.files.minPartitionNum")


@pytest.mark.parametrize("ending", ["\n", "\r\n"])
def test_one_file_is_read_by_several_tasks(spark, tmp_path, ending):
    rows, size = written(tmp_path, 2, n=400, ending=ending)
    more, _ = written(tmp_path, 3, n=30, name="b.csv", ending=ending)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
        read = quoted.lines(spark, str(tmp_path / "a.csv"))
        assert read.select("block").distinct().count() > 3 and quoted.blocks(read).filter("inside").count() > 0
        assert sorted(map(tuple, tables.read_csv(spark, str(tmp_path)).collect()), key=str) == sorted(rows + more, key=str)
        if ending == "\r\n":
            return  # Spark's own reader turns such breaks inside fields into line feeds; here fields stay as they are
        plain = spark.read.options(header=True, **quoted.OPTIONS).csv(str(tmp_path))
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(rows + more, key=str)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_odd_files(spark, tmp_path):
    (tmp_path / "head.csv").write_text("a,b\n")
    assert tables.read_csv(spark, str(tmp_path / "head.csv")).count() == 0
    (tmp_path / "mark.csv").write_bytes(b'\xef\xbb\xbfa,b\n1,"x\n\ny"\n\n2\n3,4,5\n"6","open\nend')
    got = tables.read_csv(spark, str(tmp_path / "mark.csv"), position=True).orderBy(tables.POSITION)
    assert got.columns[1:] == ["b", tables.POSITION]
    assert [tuple(r)[:2] for r in got.collect()] == [("1", "x\n\ny"), ("2", None), ("3", "4"), ("6", "open\nend")]
    assert got.agg(F.count("*")).first()[0] == 4

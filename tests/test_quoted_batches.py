"""Quoted CSV: records that span several Arrow batches, and each record parsed once."""

import random

from pyspark.sql import functions as F

from ticketlens.sources import quoted, tables


def test_records_over_many_batches(spark, tmp_path):
    """Batches of two lines: fields begin, go on and end in different ones, and the file ends inside one."""
    rows = [(str(k), "\n".join(["x", '""q""', ""][: 1 + k % 3] * (1 + k % 5))) for k in range(40)]
    body = "".join(f'{k},"{v}"\n' for k, v in rows)
    (tmp_path / "a.csv").write_bytes(quoted.MARK + b"k,v\n" + body.encode() + b'40,"open\nend\n')
    old = {c: spark.conf.get(c) for c in ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.files.maxPartitionBytes")}
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
        for size in ("64", "300", "100000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            got = tables.read_csv(spark, str(tmp_path), position=True).orderBy(tables.POSITION).drop(tables.POSITION)
            assert got.columns == ["k", "v"]
            want = [(k, v.replace('""', '"')) for k, v in rows]
            assert [(r["k"], r["v"]) for r in got.collect()][:40] == want
            assert got.count() == 41
    finally:
        for c, v in old.items():
            spark.conf.set(c, v)


def test_a_record_is_parsed_once(spark, tmp_path):
    """Not again for the other columns or for the records put together from parts."""
    (tmp_path / "a.csv").write_text('a,b,c\n1,"x\ny",2\n')
    plan = tables.read_csv(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.lower().count("from_csv(") == 1


def many(n):
    """Rows of texts with breaks and quotes."""
    r = random.Random(5)
    return [(str(k), "\n".join(r.choice(["plain words", 'a "quote"', "", "x,y"]) for _ in range(r.randrange(1, 9)))) for k in range(n)]


def test_whole_records_are_not_written(spark, tmp_path, monkeypatch):
    """Only what blocks leave open is, and blocks stay those that were counted when the session's settings change."""
    rows = many(600)
    (tmp_path / "a.csv").write_text("k,v\n" + "".join('{},"{}"\n'.format(k, v.replace('"', '""')) for k, v in rows))
    written = []
    monkeypatch.setattr(quoted, "stage_table", lambda df, stage=quoted.stage_table: written.append(stage(df)) or written[-1])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
        blocks = quoted.lines(spark, str(tmp_path)).select("block").distinct().count()
        read = tables.read_csv(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
        assert sorted(map(tuple, read.collect())) == sorted((k, v or None) for k, v in rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert blocks > 20 and 0 < sum(w.count() for w in written) <= 2 * blocks < len(rows)


def test_packed_files(spark, tmp_path, monkeypatch):
    """They give the same rows, take less disk, and none has more rows than it may."""
    rows = many(900)
    frame = spark.createDataFrame(rows, "k string, v string").repartition(2)
    monkeypatch.setattr(tables, "PACKED_ROWS", 200)
    tables.write_csv(frame, str(tmp_path / "plain"))
    tables.write_csv(frame, str(tmp_path / "packed"), packed=True)
    size = {n: sum(f.stat().st_size for f in (tmp_path / n).glob("part-*")) for n in ("plain", "packed")}
    assert size["packed"] < size["plain"] / 2 and len(list((tmp_path / "packed").glob("*.csv.gz"))) >= 5
    got = tables.read_csv(spark, str(tmp_path / "packed"), position=True)
    assert sorted(map(tuple, got.drop(tables.POSITION).collect())) == sorted((k, v or None) for k, v in rows)
    assert got.groupBy(F.col(tables.POSITION)["file_path"]).count().agg(F.max("count")).first()[0] <= 200

"""CSV with line breaks inside quoted fields, read by several tasks.

Spark's text reader cuts files into blocks and gives every line to the block it begins in. A line break ends a record if an
even number of quotes stands before it in the file; doubled quotes inside a field count twice and change nothing. A first
pass counts the quotes of each block, and a running sum over the blocks says which of them begin or end inside a field. What
such a block leaves open at its end is joined to the beginnings of the following blocks: one row for each block, which are
written. The whole records of each block are put together from its lines when they are read, and never written. All passes
read the same blocks. Whole records are parsed by ``from_csv``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.session import stage_table

# Kinds of what a block gives: records, the open end of one, a middle part (the block has no end of a record), a last part.
WHOLE, OPEN, MIDDLE, LAST = range(4)
MARK = b"\xef\xbb\xbf"
# The column that orders rows as in the files.
PLACE = "_place"
OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true"}


def pinned(df: DataFrame) -> DataFrame:
    """The table as it is planned now: every pass reads the same partitions, whatever becomes of the session's settings."""
    spark = df.sparkSession
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(df._jdf.queryExecution().toRdd(), df._jdf.schema(), False), spark)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, block (its first byte) and line of all files, in order within a block."""
    read = spark.read.option("lineSep", "\n").text(path)
    return pinned(read.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("line")))


def blocks(read: DataFrame) -> DataFrame:
    """file, block, inside and open: whether the block begins and ends inside a quoted field. Nothing but counts is shuffled."""
    quotes = F.octet_length("line") - F.octet_length(F.replace(F.col("line").cast("string"), F.lit('"'), F.lit("")))
    counts = read.groupBy("file", "block").agg(F.sum(quotes).alias("quotes"))
    upto = F.sum("quotes").over(Window.partitionBy("file").orderBy("block"))
    return counts.select("file", "block", ((upto - F.col("quotes")) % 2 == 1).alias("inside"), (upto % 2 == 1).alias("open"))


def joined(lines: pa.Array, edges: np.ndarray) -> pa.Array:
    """The lines between each two edges as one text; none before the first edge."""
    listed = pa.LargeListArray.from_arrays(pa.array(edges, pa.int64()), lines.slice(0, edges[-1]))
    return pc.binary_join(listed, pa.scalar(b"\n", pa.large_binary()))


def pieces(read: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of all whole records, and of all parts of records (written): file, block, n (place in the block), kind and record.

    Which blocks begin or end inside a field, one entry for each, is sent to all tasks.
    """
    found = [(r["file"], r["block"], r["inside"]) for r in blocks(read).filter("inside or open").collect()]
    shared = read.sparkSession.sparkContext.broadcast({(file, block) for file, block, inside in found if inside})
    # Other blocks have no parts.
    marked = read.sparkSession.createDataFrame([f[:2] for f in found], "file string, block long")
    parts = stage_table(_pieces(read.join(F.broadcast(marked), ["file", "block"], "left_semi"), shared, True))
    return _pieces(read, shared, False), parts


def _pieces(read: DataFrame, shared: Broadcast, parts: bool) -> DataFrame:
    """The parts of records, or the whole ones."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at: tuple = ()
        # Of the block: records so far, whether the last line ends inside a field, kind of the next record, lines without an end.
        n, opened, kind, held = 0, False, WHOLE, []

        def told(n: int, kind: int, texts: pa.Array) -> pa.RecordBatch:
            file, block, kind = (pa.array([v], t).take(pa.array(np.zeros(len(texts), np.int32))) for v, t in zip((*at, kind), (pa.string(), pa.int64(), pa.int32()), strict=True))
            columns = [file, block, pa.array(np.arange(n, n + len(texts)), pa.int64()), kind, texts.cast(pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["file", "block", "n", "kind", "record"])

        def left() -> Iterator[pa.RecordBatch]:
            """What stays of a block: the open end of a record, or a part of one that neither begins nor ends here."""
            if held and parts:
                every = pa.concat_arrays(held)
                yield told(n, MIDDLE if kind == LAST else OPEN, joined(every, np.array([0, len(every)])))

        for batch in batches:
            files, starts = batch.column("file").dictionary_encode().indices.to_numpy(), batch.column("block").to_numpy()
            edges = np.flatnonzero((files[1:] != files[:-1]) | (starts[1:] != starts[:-1])) + 1
            # Stretches of one block each.
            for i, j in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                lines = batch.column("line").slice(i, j - i).cast(pa.large_binary())
                if not len(lines):
                    continue
                if (key := (batch.column("file")[i].as_py(), int(starts[i]))) != at:
                    yield from left()
                    at, n, held = key, 0, []
                    opened = at in shared.value
                    kind = LAST if opened else WHOLE
                    first = lines[0].as_py()
                    if at[1] == 0 and first.startswith(MARK):
                        lines = pa.concat_arrays([pa.array([first.removeprefix(MARK)], pa.large_binary()), lines.slice(1)])
                inside = (np.cumsum(pc.count_substring(lines, b'"').to_numpy()) + opened) % 2
                opened = bool(inside[-1])
                ends = np.flatnonzero(inside == 0) + 1
                if not ends.size:
                    held.append(lines)
                    continue
                ends += sum(map(len, held))
                every = pa.concat_arrays([*held, lines])
                edges = np.append(0, ends)
                if parts and kind == LAST:
                    yield told(n, LAST, joined(every, edges[:2]))
                elif not parts and ends.size > (kind == LAST):
                    yield told(n + (kind == LAST), WHOLE, joined(every, edges[int(kind == LAST):]))
                n, kind = n + ends.size, WHOLE
                held = [every.slice(ends[-1])] if ends[-1] < len(every) else []
        yield from left()

    return read.mapInArrow(cut, "file string, block long, n long, kind int, record binary")


def records(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """file, block, n and record (text): the whole ones, and those put together from the parts of several blocks."""
    # At most two rows of each block.
    order = Window.partitionBy("file").orderBy("block", "n")
    chained = parts.withColumn("_chain", F.sum((F.col("kind") == OPEN).cast("int")).over(order))
    listed = F.array_sort(F.collect_list(F.struct("block", "n", "record")))
    chained = chained.groupBy("file", "_chain").agg(listed.alias("_parts"))
    text = F.array_join(F.transform("_parts", lambda p: p["record"].cast("string")), "\n")
    chained = chained.select("file", F.col("_parts")[0]["block"].alias("block"), F.col("_parts")[0]["n"].alias("n"), text.alias("record"))
    whole = whole.select("file", "block", "n", F.col("record").cast("string").alias("record"))
    found = whole.unionByName(chained)
    return found.withColumn("record", F.when(F.endswith("record", F.lit("\r")), F.regexp_replace("record", "\r$", "")).otherwise(F.col("record")))


def read_quoted(spark: SparkSession, path: str) -> DataFrame:
    """The rows of headered CSV files as text columns, with ``_place`` (file_path, file_block_start, row), which orders them.

    Records end with a line feed, or carriage return and line feed. Each file's first record is its header; the columns are
    those of the first file. Empty lines are no records. An open quote at the end of a file ends there.
    """
    names = spark.read.options(header=True, **OPTIONS).csv(path).columns
    rows = records(*pieces(lines(spark, path))).filter("not (block = 0 and n = 0) and record != ''")
    schema = T.StructType([T.StructField(f"c{k}", T.StringType()) for k in range(len(names))])
    # As the only row of a list, so that a record is parsed once and not for each of its columns.
    row = F.from_csv("record", schema.simpleString()[7:-1].replace(":", " "), OPTIONS)
    parsed = rows.select("file", "block", "n", F.explode(F.array(row)).alias("_row"))
    place = F.struct(F.col("file").alias("file_path"), F.col("block").alias("file_block_start"), F.col("n").alias("row"))
    return parsed.select(*[F.col(f"_row.c{k}").alias(n) for k, n in enumerate(names)], place.alias(PLACE))

"""Session helpers shared by the operators: checkpoints and size-checked broadcasts."""

from __future__ import annotations

import sys
import tempfile
import uuid
from threading import get_ident

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Most bytes of a settled side that is broadcast, measured on its rows.
BROADCAST_BYTES = 8 << 20
# Most empty rows that come to the driver to be counted there.
COUNTED_ROWS = 10_000

# Paths of the tables written next to the checkpoints, and the threads that wrote them, for clear_scratch.
_written: dict[str, int] = {}


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder in ``spark.checkpoint.dir``; make one only on a local master."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        context.setCheckpointDir(shared)
    elif context.master.startswith("local"):
        context.setCheckpointDir(tempfile.mkdtemp(prefix="ticketlens-checkpoint-"))
    else:
        raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path next to the checkpoints, on the shared folder."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
    _written[path] = get_ident()
    return path


def scratch_tables() -> frozenset[str]:
    """The scratch tables there are."""
    return frozenset(_written)


def clear_scratch(before: frozenset[str] | None = None, keep: DataFrame | None = None) -> None:
    """Deletes the scratch tables of this process.  For when all results that read them are written.

    With ``before``, only those that this thread has written since ``scratch_tables()`` gave it, but for ``keep``.
    """
    spared = (before or frozenset()) | {getattr(keep, "scratch", "")}
    for path in [p for p, thread in list(_written.items()) if p not in spared and (before is None or thread == get_ident())]:
        del _written[path]
        delete_folder(path)


def delete_folder(path: str) -> None:
    """Deletes a folder if there is one; a store that cannot be reached keeps it."""
    try:
        if "://" in path:
            system, folder = fs.FileSystem.from_uri(path)
        else:
            system, folder = fs.LocalFileSystem(), path.removeprefix("file:")
        if system.get_file_info(folder).type == fs.FileType.Directory:
            system.delete_dir(folder)
    except (ValueError, NotImplementedError, OSError) as error:
        print(f"{path} stays: {error}", file=sys.stderr)


def settle(df: DataFrame) -> DataFrame:
    """Checkpoint ``df`` so that every later pass reads the same rows, also after a lost executor."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def stage_table(df: DataFrame, compression: str | None = None) -> DataFrame:
    """Writes ``df`` as Parquet on the shared folder and reads it back.

    For wide tables that several passes read: later reads prune columns, and
    nothing is computed again, also not after a lost executor.  Without a
    ``compression`` the session's is used.
    """
    path = scratch_path(df.sparkSession, "stage")
    (df.write.option("compression", compression) if compression else df.write).parquet(path)
    made = df.sparkSession.read.schema(df.schema).parquet(path)
    made.scratch = path
    return made


def fits(df: DataFrame, max_rows: int) -> bool:
    """True when ``df`` has at most ``max_rows`` rows.

    Rows come without columns and partition by partition, so a large table is
    left after its first partitions and the driver sees a bounded number of ones.
    Beyond that bound they are counted on Spark, and only the number comes here.
    """
    if max_rows >= COUNTED_ROWS:
        return df.count() <= max_rows
    return len(df.select(F.lit(1)).take(max_rows + 1)) <= max_rows


def small_side(df: DataFrame) -> DataFrame:
    """Settle a per-group table and mark it for broadcast only if its rows are measured to be small.

    Beyond the bound the join stays a shuffle join, where adaptive execution splits hot keys.
    """
    table = settle(df)
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in table.columns])))
    return F.broadcast(table) if (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else table


def attach(df: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    """Adds the columns of a per-group table to each row; without keys the table is one row.

    The one row enters as a scalar subquery, so there is no join at all.
    """
    if keys:
        return df.join(small_side(table), keys)
    columns = table.columns
    row = settle(table).select(F.struct(*columns).alias("row")).scalar()
    return df.withColumns({c: row[c] for c in columns})


def spread(df: DataFrame) -> DataFrame:
    """Gives a table read in fewer parts than there are cores one part per core.

    For costly work on small files; a table of many files stays as it is read.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)

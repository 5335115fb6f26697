"""Tables that are replaced in one step: a folder for each version, and a log that says which is current.

``<path>/data-...`` holds the Parquet files of one version, ``<path>/versions`` one line for each replacement.  The line is
written last, by Spark's own commit of one file, so readers see the old table or the new one on any store that Spark can
write to, also when a job dies in between.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ticketlens.session import delete_folder
from ticketlens.sources.tables import read_table

LOG = "version long, folder string"
# Versions that stay: the current one, and one for readers that have begun with it.
KEPT_VERSIONS = 2


def replace_table(df: DataFrame, path: str, keep: int = KEPT_VERSIONS) -> DataFrame:
    """Makes ``df`` the current version of the table at ``path`` and returns it as read back.

    ``df`` may read the table it replaces.  All versions but the last ``keep``
    are deleted after the switch; a write that stopped before it leaves a
    folder that no reader sees.  Of two writers at a time both versions are
    kept whole, and that with the higher number, then folder name, is current.
    """
    if keep < 1:
        raise ValueError("at least the current version is kept")
    spark = df.sparkSession
    folder = f"data-{uuid.uuid4().hex}"
    df.write.parquet(f"{path}/{folder}")
    before = versions(spark, path, keep + 1)
    _switch(spark, path, before[0].version + 1 if before else 1, folder)
    for old in versions(spark, path, keep + 1)[keep:]:
        delete_folder(f"{path}/{old.folder}")
    return read_table(spark, f"{path}/{folder}")


def _switch(spark: SparkSession, path: str, version: int, folder: str) -> None:
    """Adds the line that makes a folder the current version."""
    line = spark.createDataFrame([(version, folder)], LOG).coalesce(1)
    line.write.mode("append").json(f"{path}/versions")


def versions(spark: SparkSession, path: str, most: int) -> list[Row]:
    """The last versions and their folders, the current one first; none if the table was never written."""
    try:
        log = spark.read.schema(LOG).json(f"{path}/versions")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return log.orderBy(F.desc("version"), F.desc("folder")).limit(most).collect()


def read_current(spark: SparkSession, path: str, columns: Sequence[str] | None = None, back: int = 0) -> DataFrame:
    """The current version of a table, or one that is ``back`` replacements older and still kept."""
    found = versions(spark, path, back + 1)
    if len(found) <= back:
        raise ValueError(f"{path} has {len(found)} versions, not {back + 1}")
    return read_table(spark, f"{path}/{found[back].folder}", columns)

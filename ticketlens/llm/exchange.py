"""Finding hashes that occur more than once, with few rows in the shuffle.

A task packs the hashes of one slice of documents by bucket: one row carries a whole array of them. Within a
slice each hash goes out once, whatever the number of its occurrences, so that a hash shared by a third of all
documents costs a bucket one entry per slice. A bucket is one group of a grouped map.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of text for each bucket.
BUCKET_TEXT = 24 << 20


def bucket_count(docs: DataFrame, text: str) -> int:
    """Enough buckets that one of them stays small, at any size of the table."""
    total = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)).alias("n")).first()["n"]
    return max(8, math.ceil(total / BUCKET_TEXT))


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket by the upper half of the hash."""
    return ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def packed(bucket: np.ndarray, buckets: int, owner: np.ndarray, keys: list[np.ndarray], columns: list[np.ndarray]) -> pa.RecordBatch:
    """One row for each bucket that has entries, with each column's entries as bytes.

    Entries come in the order of their owners. The owners' keys are written once for each run of one owner's entries
    in a bucket, after the lengths of the runs.
    """
    order = np.argsort(bucket.astype(np.uint16) if buckets < 1 << 16 else bucket, kind="stable")
    bucket, owner = bucket[order], owner[order]
    new = np.ones(bucket.size, bool)
    new[1:] = (bucket[1:] != bucket[:-1]) | (owner[1:] != owner[:-1])
    first = np.flatnonzero(new)
    # Only buckets that occur: the work does not grow with their number.
    full, begin = np.unique(bucket, return_index=True)
    edges = np.append(begin, bucket.size)
    runs = np.append(np.searchsorted(first, begin), first.size)
    lengths = np.diff(np.append(first, bucket.size)).astype(np.int32)
    arrays = [pa.array(full, pa.int64())]
    for c, at in [(lengths, runs), *((k[owner[first]], runs) for k in keys), *((c[order], edges) for c in columns)]:
        c = np.ascontiguousarray(c)
        arrays.append(pa.array([c[i:j].tobytes() for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", *[f"c{i}" for i in range(len(arrays) - 1)]])


def unpacked(group: pa.Table, keys: list[str], columns: list[str]) -> list[np.ndarray]:
    """The owners' keys, one for each entry, and the entries' columns; a column without bytes is empty."""
    parts = [np.frombuffer(b"".join(group.column(f"c{i}").to_pylist()), kind) for i, kind in enumerate(["<i4", *keys, *columns])]
    return [np.repeat(k, parts[0]) for k in parts[1 : 1 + len(keys)]] + parts[1 + len(keys) :]


def owned(group: pa.Table, keys: list[str], column: str) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """The place of each entry's owner among the runs, the runs' keys, and the entries of the only column."""
    parts = [np.frombuffer(b"".join(group.column(f"c{i}").to_pylist()), kind) for i, kind in enumerate(["<i4", *keys, column])]
    return np.repeat(np.arange(parts[0].size, dtype=np.int32), parts[0]), parts[1:-1], parts[-1]


def packed_schema(parts: int) -> str:
    """For that many keys and columns."""
    return "bucket long, " + ", ".join(f"c{i} binary" for i in range(parts + 1))

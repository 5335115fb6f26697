"""Vectorised helpers on Arrow string batches: UTF-8 views, words, hashes of words and of word windows."""

from __future__ import annotations

import ctypes
import gc
import pickle
import sys
from collections.abc import Callable, Iterator
from types import ModuleType
from typing import Any

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = (0x20, *range(0x09, 0x0E))
LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32
# Bytes of texts that one step of a task handles: its arrays take some twenty times as much memory. Rows of a batch that
# goes to a Python worker: long texts make Spark's own number of rows tens of megabytes, held several times.
SLICE_BYTES = 1 << 20
BATCH_ROWS = 1000

_ODD = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = (np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_SEEDS = (np.uint64(0x165667B19E3779F9), np.uint64(0x27D4EB2F165667C5))
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)


def kept(name: str, make: Callable[[], Any]) -> Any:
    """A value made once in a worker process, such as a tokenizer, whatever the number of its tasks."""
    cache = sys.modules.setdefault("_worker_cache", ModuleType("_worker_cache")).__dict__
    if name not in cache:
        cache[name] = make()
    return cache[name]


def short_batches(spark: SparkSession) -> None:
    """Bounds the rows of a batch for Python workers in this session; a smaller bound stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def drop_large(own: str = "") -> None:
    """Forgets tokenizers and tries that an earlier stage left in this worker, but for those whose name begins with own; who
    needs one makes it again."""
    cache = sys.modules.get("_worker_cache")
    names = [n for n in vars(cache or ModuleType("none")) if n.startswith(("codec ", "trie ")) and not (own and n.startswith(own))]
    for name in names:
        delattr(cache, name)
    if names:
        gc.collect()
        release()


class Shared:
    """A broadcast value of this package's classes, pickled by value."""

    def __init__(self, spark: SparkSession, value: Any) -> None:
        self.packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self) -> Any:
        return pickle.loads(self.packed.value)


def byte_table(outside: Iterator[int] | tuple[int, ...]) -> np.ndarray:
    """True for every byte that belongs to a word."""
    table = np.ones(256, dtype=bool)
    table[list(outside)] = False
    return table


NOT_BLANK = byte_table(BLANKS)


def slices(batch: pa.RecordBatch, column: str, limit: int | None = None) -> Iterator[pa.RecordBatch]:
    """The batch in consecutive parts of about that many bytes of text; a longer text is a part of its own."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total = np.cumsum(sizes + 1)
    limit = limit or SLICE_BYTES
    at = 0
    while at < batch.num_rows:
        before = total[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(total, before + limit, side="right")))
        yield batch.slice(at, to - at)
        at = to
    release()


def release() -> None:
    """Gives memory of arrays that are gone back to the system, where the C library can: workers live on."""
    pa.default_memory_pool().release_unused()
    trim = kept("malloc_trim", lambda: getattr(ctypes.CDLL(None), "malloc_trim", None))
    if trim:
        trim(0)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of the texts, and where each begins and the last ends. Nulls are empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words(raw: np.ndarray, offsets: np.ndarray, table: np.ndarray = NOT_BLANK) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the range of words of each text as offsets."""
    n = raw.size
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(offsets.size, np.int64)
    inside = table[raw]
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    new = np.empty(n, dtype=bool)
    new[0] = True
    np.logical_not(inside[:-1], out=new[1:])
    new |= edge[:n]
    starts = np.flatnonzero(inside & new)
    last = np.empty(n, dtype=bool)
    last[-1] = True
    np.logical_not(inside[1:], out=last[:-1])
    last |= edge[1:]
    ends = np.flatnonzero(inside & last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray, which: int = 0) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLIERS[which]
    x = (x ^ (x >> np.uint64(29))) * _ODD
    return x ^ (x >> np.uint64(32))


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, which: int = 0) -> np.ndarray:
    """A 64-bit hash of each word; which = 0 and 1 together make 128 bits."""
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    lanes = np.ndarray((raw.size + 1,), "<u8", padded, strides=(1,))
    length = ends - starts
    out = _SEEDS[which] ^ (length.astype(np.uint64) * _ODD)
    part = np.arange(starts.size)
    done = 0
    while part.size:
        left = length[part] - done
        lane = lanes[starts[part] + done] & _KEEP[np.minimum(left, 8)]
        out[part] = mix(out[part] ^ lane, which)
        part = part[left > 8]
        done += 8
    return out


def joined(a: np.ndarray, b: np.ndarray, which: int = 0) -> np.ndarray:
    """The hash of a sequence from those of its two parts."""
    return mix(a * _MULTIPLIERS[1 - which] + b, which)


def window_hashes(h: np.ndarray, length: int, which: int = 0) -> np.ndarray:
    """The hash of the length items from each place on, by doubling; texts' ends are for the caller to mind."""
    n = h.size
    if n < length:
        return h[:0]
    out, taken, step, size = None, 0, h, 1
    while True:
        if length & size:
            if out is None:
                out = step
            else:
                m = n - taken - size + 1
                out = joined(out[:m], step[taken : taken + m], which)
            taken += size
        if size * 2 > length:
            return out[: n - length + 1]
        step = joined(step[:-size], step[size:], which)
        size *= 2


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, ... within each group of the given sizes."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if ends.size else 0) - np.repeat(ends - counts, counts)


def gather(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, blank_after: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of these words one after the other, each followed by a blank, and where each begins."""
    length = ends - starts + blank_after
    at = np.cumsum(length) - length
    index = np.repeat(starts - at, length) + np.arange(int(length.sum()))
    if not blank_after:
        return raw[index], at
    out = np.append(raw, np.uint8(32))[np.minimum(index, raw.size)]
    out[at + length - 1] = 32
    return out, at


def stretches(flags: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of true flags as (first, last + 1)."""
    edges = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))


def carried(docs: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, list[str]]:
    """The text as the column text and the kept columns under names of their own, and those names; the text of a kept
    text column is there once."""
    short_batches(docs.sparkSession)
    names = ["text" if c == text else f"k{i}" for i, c in enumerate(keep)]
    kept = [F.col(c).alias(n) for c, n in zip(keep, names, strict=True) if n != "text"]
    return docs.select(*kept, F.col(text).cast("string").alias("text")), names


def restored(out: DataFrame, keep: tuple[str, ...], names: list[str], *made: str) -> DataFrame:
    """The kept columns under their own names again, and the columns that were made."""
    return out.select(*[F.col(n).alias(c) for c, n in zip(keep, names, strict=True)], *made)


def schema_of(rows: DataFrame, names: list[str], made: str) -> T.StructType:
    return T.StructType([*(rows.schema[n] for n in names), *T._parse_datatype_string(made).fields])

"""Exact top-k search by inner product with a pivot table.

The index holds, for blocks of vectors, the vectors and their distances to all pivots. For a query q and a vector x,
every pivot p gives |d(q, p) - d(x, p)| <= d(q, x), and the largest of these bounds limits the inner product:
2 q.x = |q|^2 + |x|^2 - d(q, x)^2. Vectors are evaluated in the order of their limits until the k-th best score
found exceeds the next limit, so the result is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm import textops as tx
from ticketlens.session import scratch_path, stage_table

K = 5
PIVOTS = 32
# Vectors that pivots are chosen among, vectors of an index block, and queries that go to all blocks at once.
PIVOT_SAMPLE = 2048
BLOCK = 4096
QUERY_BLOCK = 8192
SCALE = 256
# Limits are widened by so much for rounding; scores are integers. Sums of so many terms are off by as many units of
# rounding at most, each taken four times here.
SLACK = 0.25
ROUNDING = 4 * 2.0**-53
# Integers from here on are not exact as products in double precision; extended precision holds all of a long.
EXACT = 2.0**53


def quantised(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """Ids and vectors of integers; rows without id, without vector or with a component that is no number are out.

    An empty vector stays. Integers beyond the range of a long become its ends. Repeated rows stay, an empty table stays empty.
    """
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    own = rows.filter(F.col(ident).isNotNull() & F.col(vector).isNotNull() & finite)
    return own.select(F.col(ident).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE)).alias("v"))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Vectors as rows; shorter ones are filled with zeros, and what a query has beyond all vectors meets only zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    size = np.diff(column.offsets.to_numpy()) if len(column) else np.zeros(0, int)
    out = np.zeros((len(column), width))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row, place = np.repeat(np.arange(size.size), size), tx.spread(size)
    out[row[place < width], place[place < width]] = flat[place < width]
    return out


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """From differences, so that each is right but for a share of ROUNDING times (components + 2) of itself, whatever the
    lengths of the vectors."""
    out = np.empty((x.shape[0], pivots.shape[0]))
    for k, p in enumerate(pivots):
        apart = x - p
        out[:, k] = np.sqrt((apart * apart).sum(axis=1))
    return out


def spread_out(sample: np.ndarray, count: int) -> np.ndarray:
    """Pivots far from each other: each next one is the vector farthest from those before."""
    chosen = [0] if sample.shape[0] else []
    far = distances(sample, sample[chosen])[:, 0] if chosen else np.zeros(0)
    while len(chosen) < min(count, sample.shape[0]) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


@dataclass
class Index:
    """Blocks as a settled table (ids, vectors and pivot distances as bytes), the pivots and the vectors' width."""

    blocks: DataFrame
    pivots: np.ndarray
    width: int


def build(rows: DataFrame, pivots: int = PIVOTS) -> Index:
    """The index of all quantised rows (id, v).

    Shorter vectors are filled with zeros. Rows that repeat an id or a vector are vectors of their own. An empty table gives
    an index without blocks, in which a search finds nothing.
    """
    width = rows.agg(F.max(F.size("v")).alias("w")).first()["w"] or 0
    sample = rows.select("id", "v").orderBy(F.xxhash64("id", "v"), "id").limit(PIVOT_SAMPLE).toArrow()
    chosen = spread_out(matrix(sample.column("v"), width), pivots)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = matrix(batch.column("v"), width)
                parts = [batch.column("id").to_numpy(), x, distances(x, chosen)]
                yield pa.RecordBatch.from_arrays([pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts], ["ids", "x", "d"])

    return Index(stage_table(rows.mapInArrow(run, "ids binary, x binary, d binary")), chosen, width)


def as_long(scores: np.ndarray) -> np.ndarray:
    """Scores as longs; beyond their range its ends."""
    ends = np.iinfo(np.int64)
    inside = np.abs(scores) < 2.0**63
    out = np.where(scores > 0, ends.max, ends.min)
    out[inside] = scores[inside].astype(np.int64)
    return out


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k highest scores, smaller ids first among equals."""
    order = np.lexsort((ids, -scores))[:k]
    return scores[order], ids[order]


def products(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products, exact in all of the range of a long."""
    if x.size and np.abs(x).max() * np.abs(q).max() * x.shape[1] >= EXACT:
        return (x.astype(np.longdouble) * q.astype(np.longdouble)).sum(axis=1)
    return x @ q


def limits(q: np.ndarray, square: float, dq: np.ndarray, own: np.ndarray, columns: np.ndarray) -> np.ndarray:
    """What the inner products of a query and the vectors of a block cannot exceed, from their distances to the pivots.

    square, own: squared lengths; dq, columns: distances to each pivot. The error of a distance is a share of it, so that of
    a difference grows with both distances, however far out the pivot is.
    """
    off = ROUNDING * (q.size + 2)
    low = np.zeros(own.size)
    for p in range(columns.shape[0]):
        np.maximum(low, np.abs(columns[p] - dq[p]) - off * (columns[p] + dq[p]), out=low)
    both = square + own
    return (both - low * low) / 2 + off * (both + low * low) + SLACK


def eliminate(q: np.ndarray, own: int, limit: np.ndarray, x: np.ndarray, ids: np.ndarray, best: tuple[np.ndarray, np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """The best k after a block: candidates in the order of their limits, until no limit reaches the k-th score."""
    scores, names = best
    floor = scores[k - 1] if scores.size == k else -np.inf
    open_ = np.flatnonzero(limit >= floor)
    open_ = open_[np.argsort(-limit[open_])]
    at, step = 0, 4 * k
    while at < open_.size and (scores.size < k or limit[open_[at]] >= scores[k - 1]):
        part = open_[at : at + step]
        part = part[ids[part] != own]
        scores, names = best_of(np.concatenate([scores, products(x[part], q)]), np.concatenate([names, ids[part]]), k)
        at, step = at + step, step * 2
    return scores, names


def search(index: Index, queries: DataFrame, k: int = K, query_block: int = QUERY_BLOCK) -> DataFrame:
    """For each distinct query (id, v): query_id, rank, vec_id and score of its k best vectors, all if there are fewer.

    Vectors with the query's id are no candidates. Equal scores go to the smaller vec_id. Every block of queries is
    bounded, goes to all blocks of the index and leaves k rows for each query and task; several blocks are written one
    after the other, so the plan stays short. Scores are exact while they and their sums fit a long; beyond that range they
    become its ends and count as equal.
    """
    spark = queries.sparkSession
    asked = stage_table(queries.select("id", "v").distinct())
    count = max(1, math.ceil(asked.count() / query_block))
    path = scratch_path(spark, "nearest")
    for n in range(count):
        own = asked.filter(F.pmod(F.xxhash64("id", "v"), F.lit(count)) == n).toArrow()
        q = matrix(own.column("v"), index.width) if own.num_rows else np.zeros((0, index.width))
        shared = tx.Shared(spark, (own.column("id").to_numpy(), q, distances(q, index.pivots), index.width, n * query_block * 2))

        def run(batches: Iterator[pa.RecordBatch], shared: tx.Shared = shared) -> Iterator[pa.RecordBatch]:
            names, q, dq, width, first = shared.value
            best = [(np.zeros(0), np.zeros(0, np.int64))] * names.size
            square = (q * q).sum(axis=1)
            for batch in batches:
                for ids, x, dx in zip(*(batch.column(c) for c in ("ids", "x", "d")), strict=True):
                    ids = np.frombuffer(ids.as_buffer(), np.int64)
                    x, dx = (np.frombuffer(b.as_buffer(), t).reshape(ids.size, -1) for b, t in ((x, float), (dx, float)))
                    own = (x * x).sum(axis=1)
                    columns = np.ascontiguousarray(dx.T)
                    for i in range(names.size):
                        limit = limits(q[i], square[i], dq[i], own, columns)
                        best[i] = eliminate(q[i], names[i], limit, x, ids, best[i], k)
            sizes = np.array([b[0].size for b in best], int)
            if sizes.sum():
                which = np.repeat(np.arange(names.size), sizes)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(which + first), pa.array(names[which]), pa.array(np.concatenate([b[1] for b in best])), pa.array(as_long(np.concatenate([b[0] for b in best])))],
                    ["which", "query_id", "vec_id", "score"])

        found = index.blocks.mapInArrow(run, "which long, query_id long, vec_id long, score long")
        if count > 1:
            found.write.mode("append").parquet(path)
    if count > 1:
        found = spark.read.parquet(path)
    place = F.row_number().over(Window.partitionBy("query_id", "which").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

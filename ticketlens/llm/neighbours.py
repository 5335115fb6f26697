"""Approximate nearest neighbours by cosine: inverted lists and an adaptive scan of rotated dimensions.

Vectors of length 1 are rotated at random, so that their differences are spread evenly over all dimensions, and go to the
list of their nearest centroid. A list is kept in blocks, in which the rotated vectors stand column by column. A query is
compared with the blocks of its nearest lists, some columns at a time: after d of D columns the squared distance is guessed
as D / d times what has been summed, and a candidate is given up when that exceeds the k-th best distance by more than a
hypothesis test allows (by a factor of (1 + error / sqrt(d))^2). What survives all columns is scored in double precision on
the original vectors. The nearest list is searched first, and its k-th best goes to the other lists as a bound.

How many lists are searched follows from the data: on the sample that the centroids are fitted on, enough to find a wanted
share of the exact neighbours.
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
from ticketlens.llm.topk import matrix
from ticketlens.session import stage_table

K = 5
# Most vectors, and most bytes of them, that centroids are fitted on; vectors of a list on average, and most lists.
SAMPLE, SAMPLE_BYTES = 8192, 64 << 20
LIST_ROWS, LISTS = 1024, 1024
# Vectors of a block, and queries that meet a block together.
BLOCK, PACKET = 1024, 256
# Columns of one step of the scan, and the test's factor of error: 2.1 gives up a true neighbour very rarely.
COLUMNS, ERROR = 16, 2.1
# Share of the sample's exact neighbours that the searched lists hold, and sample queries it is measured on.
SHARE, MEASURED = 0.97, 256


def vectors(rows: DataFrame, ident: str, vector: str) -> DataFrame:
    """Ids and vectors that take part: not null, all components finite, not all zero."""
    number = lambda x: x.cast("double")
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(number(x)) & (F.abs(number(x)) < float("inf")))
    own = rows.filter(F.col(ident).isNotNull() & F.col(vector).isNotNull() & finite & F.exists(vector, lambda x: number(x) != 0))
    return own.select(F.col(ident).cast("long").alias("id"), F.transform(vector, number).alias("v"))


def scaled(x: np.ndarray) -> np.ndarray:
    """Rows times the powers of two that bring their largest components to about 1: exact, and squares do not overflow."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, initial=0))[1][:, None])


def unit(x: np.ndarray) -> np.ndarray:
    x = scaled(x)
    return x / np.sqrt((x * x).sum(axis=1))[:, None]


def cosines(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Of the rows of x and one vector, in double precision; equal rows give equal numbers."""
    x, q = scaled(x), scaled(q[None, :])[0]
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * math.sqrt(float((q * q).sum())))


def centroids_of(sample: np.ndarray, lists: int, rounds: int = 8) -> np.ndarray:
    """Centroids of length 1 of the sample's unit vectors, which come in random order."""
    centre = sample[:lists].copy()
    for _ in range(rounds if len(centre) else 0):
        near = (sample @ centre.T).argmax(axis=1)
        total = np.zeros_like(centre)
        np.add.at(total, near, sample)
        length = np.sqrt((total * total).sum(axis=1))
        centre[length > 0] = total[length > 0] / length[length > 0, None]
    return centre


def searched_lists(sample: np.ndarray, centre: np.ndarray, k: int, share: float) -> int:
    """How many of its nearest lists a query searches to find that share of its exact neighbours in the sample."""
    if not len(centre):
        return 1
    asked = sample[:: max(1, sample.shape[0] // MEASURED)][:MEASURED]
    home = (sample @ centre.T).argmax(axis=1)
    rank = np.argsort(np.argsort(-(asked @ centre.T), axis=1, kind="stable"), axis=1)
    near = np.argsort(-(asked @ sample.T), axis=1, kind="stable")[:, 1 : k + 1]
    ranks = np.sort(np.take_along_axis(rank, home[near], axis=1).ravel())
    return int(ranks[min(ranks.size - 1, math.ceil(share * ranks.size))]) + 1 if ranks.size else 1


@dataclass
class Index:
    """Blocks of the lists as a written table, the rotation, the centroids (rotated), the vectors' width, how many lists
    a query searches, and the number of vectors."""

    blocks: DataFrame
    rotation: np.ndarray
    centre: np.ndarray
    width: int
    probes: int
    size: int


def build(rows: DataFrame, k: int = K, share: float = SHARE, seed: int = 7) -> Index:
    """The index of all rows (id, v) that ``vectors`` gives. Shorter vectors are filled with zeros.

    Centroids and the number of searched lists are fitted on at most SAMPLE vectors. Rows that repeat an id or a vector are
    vectors of their own; an empty table gives an index without lists.
    """
    spark = rows.sparkSession
    told = rows.agg(F.max(F.size("v")).alias("w"), F.count("*").alias("n")).first()
    width, size = told["w"] or 0, told["n"]
    most = max(1, min(SAMPLE, SAMPLE_BYTES // (8 * max(1, width))))
    rotation = np.linalg.qr(np.random.default_rng(seed).normal(size=(width, width)))[0]
    sample = matrix(rows.orderBy(F.xxhash64("id", "v"), "id").limit(most).toArrow().column("v"), width)
    sample = unit(sample) @ rotation
    lists = max(1, min(LISTS, size // LIST_ROWS, sample.shape[0] // 8))
    centre = centroids_of(sample, min(lists, sample.shape[0]))
    shared = tx.Shared(spark, (rotation, centre))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, centre = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                near = ((unit(matrix(batch.column("v"), width)) @ rotation) @ centre.T).argmax(axis=1)
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(near, pa.int32())], ["id", "v", "list"])

    assigned = stage_table(rows.mapInArrow(assign, "id long, v array<double>, list int"))
    # At most LISTS rows. A list of many rows is dealt out over as many blocks as it needs.
    sizes = F.broadcast(assigned.groupBy("list").agg(F.count("*").alias("n")))
    dealt = assigned.join(sizes, "list").withColumn("part", F.pmod(F.xxhash64("id", "v"), F.ceil(F.col("n") / BLOCK)))

    def block(group: pa.Table) -> pa.Table:
        """Blocks of one part; equal rows can make it larger than others."""
        rotation = shared.value[0]
        made = []
        for at in range(0, group.num_rows, 2 * BLOCK):
            some = group.slice(at, 2 * BLOCK)
            x = matrix(some.column("v"), width)
            turned = np.ascontiguousarray((unit(x) @ rotation).T, np.float32)
            made.append((group.column("list")[0].as_py(), some.column("id").to_numpy().tobytes(), turned.tobytes(), x.tobytes()))
        return pa.table({c: pa.array([m[i] for m in made], kind) for i, (c, kind) in enumerate((("list", pa.int32()), ("ids", pa.binary()), ("x", pa.binary()), ("own", pa.binary())))})

    blocks = stage_table(dealt.groupBy("list", "part").applyInArrow(block, "list int, ids binary, x binary, own binary"))
    return Index(blocks, rotation, centre, width, searched_lists(sample, centre, k, share) if size else 0, size)


def scan(x: np.ndarray, own: np.ndarray, ids: np.ndarray, q: np.ndarray, v: np.ndarray, ident: int, floor: float, k: int, error: float = ERROR) -> tuple[np.ndarray, np.ndarray, int]:
    """The at most k best scores of a block for one query, their ids, and how many components were read.

    x: rotated vectors by column, own: original ones by row; q and v: the query likewise; floor: the k-th best score so far.
    """
    width, scores, names, read = x.shape[0], np.zeros(0), np.zeros(0, np.int64), 0
    alive = np.flatnonzero(ids != ident)

    def better(part: np.ndarray) -> None:
        nonlocal scores, names
        scores, names = np.concatenate([scores, cosines(own[part], v)]), np.concatenate([names, ids[part]])
        order = np.lexsort((names, -scores))[:k]
        scores, names = scores[order], names[order]

    partial = np.zeros(alive.size)
    for at in range(0, width, COLUMNS):
        if not alive.size:
            break
        to = min(width, at + COLUMNS)
        apart = x[at:to, alive] - q[at:to, None]
        partial += (apart * apart).sum(axis=0)
        read += apart.size
        if at == 0:
            # The candidates that are nearest so far are scored first, and give the others a bound.
            first = np.argpartition(partial, min(4 * k, alive.size) - 1)[: 4 * k]
            better(alive[first])
            alive, partial = np.delete(alive, first), np.delete(partial, first)
            floor = max(floor, scores[-1]) if scores.size == k else floor
        # Squared distance of unit vectors; single precision is off by some ten millionths.
        limit = 2 - 2 * floor + 1e-5 if floor > -np.inf else np.inf
        most = limit * (1 + error / math.sqrt(to)) ** 2 * to / width if to < width else limit
        near = partial <= most
        alive, partial = alive[near], partial[near]
    if alive.size:
        better(alive)
    return scores, names, read


def _visit(index: Index, asked: DataFrame, first: int, last: int, k: int) -> DataFrame:
    """which, query_id, vec_id and score of the best of each block in those of the asked queries' lists."""
    probes = stage_table(asked.select("which", "query_id", "q", "own", "floor", F.explode(F.slice("lists", first + 1, last - first)).alias("list")))
    # At most LISTS rows. Queries of one list meet a block in packets.
    many = F.broadcast(probes.groupBy("list").agg(F.count("*").alias("n")))
    dealt = probes.join(many, "list").withColumn("part", F.pmod(F.xxhash64("which"), F.ceil(F.col("n") / PACKET)))
    packets = dealt.groupBy("list", "part").agg(F.collect_list(F.struct("which", "query_id", "floor", "q", "own")).alias("packet"))
    packets = stage_table(packets.select("list", "packet"))
    width = index.width

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                ids, x, own = (np.frombuffer(batch.column(c)[r].as_buffer(), t) for c, t in (("ids", np.int64), ("x", np.float32), ("own", float)))
                x, own = x.reshape(width, ids.size), own.reshape(ids.size, width)
                found = []
                for one in batch.column("packet")[r].as_py():
                    floor = -np.inf if one["floor"] is None else one["floor"]
                    scores, names, _ = scan(x, own, ids, np.frombuffer(one["q"], np.float32), np.frombuffer(one["own"]), one["query_id"], floor, k)
                    found += [(one["which"], one["query_id"], n, s) for n, s in zip(names.tolist(), scores.tolist(), strict=True)]
                columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64()))]
                yield pa.RecordBatch.from_arrays(columns, ["which", "query_id", "vec_id", "score"])

    return index.blocks.join(packets, "list").drop("list").mapInArrow(run, "which long, query_id long, vec_id long, score double")


def search(index: Index, queries: DataFrame, k: int = K, probes: int | None = None) -> DataFrame:
    """For each distinct query (id, v): query_id, rank, vec_id and score of the k nearest vectors found, all if there are
    fewer. Vectors with the query's id are no candidates; equal scores go to the smaller vec_id.

    probes: the lists that a query searches, else what the index was fitted to. A query that finds fewer than k goes on to
    all lists. An empty table, of vectors or queries, gives no rows.
    """
    spark, width = queries.sparkSession, index.width
    probes = max(1, min(index.centre.shape[0], probes or index.probes))
    shared = tx.Shared(spark, (index.rotation, index.centre))

    def order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rotation, centre = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, BLOCK):
                batch = whole.slice(at, BLOCK)
                x = matrix(batch.column("v"), width)
                kept = (x != 0).any(axis=1)
                turned = np.zeros_like(x)
                turned[kept] = unit(x[kept]) @ rotation
                near = np.argsort(-(turned @ centre.T), axis=1, kind="stable")
                columns = [pa.array([row.tobytes() for row in m], pa.binary()) for m in (turned.astype(np.float32), x)]
                lists = pa.array(list(near.astype(np.int32)), pa.list_(pa.int32()))
                out = pa.RecordBatch.from_arrays([batch.column("id"), *columns, lists], ["query_id", "q", "own", "lists"])
                yield out.filter(pa.array(kept))

    def ranked(found: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("which", "query_id").orderBy(F.desc("score"), "vec_id"))
        return found.withColumn("rank", place).filter(F.col("rank") <= k)

    def with_floor(found: DataFrame) -> DataFrame:
        """The queries with their k-th best score so far, null before they have k."""
        last = found.filter(F.col("rank") == k).select("which", F.col("score").alias("floor"))
        return asked.drop("floor").join(last, "which", "left")

    asked = queries.select("id", "v").distinct().mapInArrow(order, "query_id long, q binary, own binary, lists array<int>")
    asked = stage_table(asked.withColumn("which", F.monotonically_increasing_id()).withColumn("floor", F.lit(None).cast("double")))
    best = stage_table(ranked(_visit(index, asked, 0, 1, k)))
    if probes > 1:
        more = _visit(index, with_floor(best), 1, probes, k)
        best = stage_table(ranked(best.drop("rank").unionByName(more)))
    if probes < index.centre.shape[0]:
        few = with_floor(best).filter("floor is null")
        if not few.isEmpty():
            more = _visit(index, few, probes, index.centre.shape[0], k)
            best = ranked(best.drop("rank").unionByName(more))
    return best.select("query_id", "rank", "vec_id", "score")

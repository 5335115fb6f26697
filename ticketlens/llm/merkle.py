"""Merkle manifest of a dataset, with a proof for every row found by pointer jumping.

Rows are leaves of one tree for each value of a column; those trees' roots, the subroots, are the leaves of a last tree. A
node is the hash of its one or two children. Every node below the root of its tree first holds a segment of one sibling,
that on the way to its parent. Then a self-join gives a node the segment of the ancestor that its own one reaches: both are put
together, and the distance doubles. After k joins segments reach 2^k levels up, so only nodes of levels that are multiples of
2^k go on as stepping stones, and the stones are few. After the logarithm of the height every leaf's segment reaches
the root.

Places of leaves come from a range partitioning of all rows by group and order: a row's place is its distance from the first
row of its group in its partition, plus the rows of the group in the partitions before. No group is sorted in one task.
Levels are built twelve at a time in blocks of consecutive nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketlens.llm import textops as tx
from ticketlens.session import small_side, stage_table

# Levels that one block of consecutive nodes is built up by; a block has 2^STEP nodes at most.
STEP = 12


def leaf(fields: Sequence[Column]) -> Column:
    """The lower-case hexadecimal SHA-256 of the fields: each `-` if null, else UTF-8 byte count, colon and value."""
    told = [F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")) for f in fields]
    return F.sha2(F.concat(*[F.coalesce(t, F.lit("-")) for t in told]).cast("binary"), 256)


def _hex(column: Column) -> Column:
    return F.lower(F.hex(column))


def numbered(rows: DataFrame, groups: list[str], order: list[str]) -> DataFrame:
    """The rows, written and read again, with place (from 0, within the group), size of the group and height of its tree.

    Group columns are not null. Rows that are equal in all columns of the order share their places in any way.
    """
    spread = rows.withColumn("_tie", F.monotonically_increasing_id())
    keys = [*groups, *[F.col(c).asc_nulls_first() for c in order], "_tie"]
    sort = spread.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_tie")
    sort = stage_table(sort.withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    parts = sort.groupBy(*groups, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    # One row for each group and partition.
    every = Window.partitionBy(*groups)
    parts = parts.withColumn("size", F.sum("_n").over(every)).withColumn("_before", F.sum("_n").over(every.orderBy("_part")) - F.col("_n"))
    placed = sort.join(small_side(parts), [*groups, "_part"]).withColumn("place", F.col("_before") + F.col("_at") - F.col("_first"))
    height = F.when(F.col("size") > 1, F.length(F.bin(F.col("size") - 1))).otherwise(0)
    return placed.withColumn("height", height.cast("int")).select(*rows.columns, "place", "size", "height")


def grown(leaves: DataFrame, groups: list[str]) -> DataFrame:
    """All nodes of the trees: groups, height, level, idx (place in its level), h and sibling (null if there is none).

    leaves: groups, idx, h and height. Each pass builds up blocks of consecutive nodes by STEP levels; the last nodes of a
    block are the first of the next pass. The root of a tree has its height as level.
    """
    schema = tx.schema_of(leaves, [*groups, "height"], "level int, idx long, h binary, sibling binary, top boolean")
    heights = leaves.agg(F.max("height")).first()[0]
    nodes, base = None, 0

    def builder(base: int) -> Callable[[pa.Table], pa.Table]:
        def block(group: pa.Table) -> pa.Table:
            group = group.sort_by("idx")
            height, first = group.column("height")[0].as_py(), group.column("idx")[0].as_py()
            own = [h.hex() for h in group.column("h").to_pylist()]
            level, idx, h, sibling, top = [], [], [], [], []
            steps = min(STEP, height - base)
            for k in range(steps + 1):
                last = k == steps
                beside = [None] * len(own)
                if not last:
                    beside[: len(own) // 2 * 2] = [own[i ^ 1] for i in range(len(own) // 2 * 2)]
                level += [base + k] * len(own)
                idx += range(first, first + len(own))
                h += map(bytes.fromhex, own)
                sibling += [b and bytes.fromhex(b) for b in beside]
                top += [last] * len(own)
                own = [hashlib.sha256("".join(own[i : i + 2]).encode()).hexdigest() for i in range(0, len(own), 2)]
                first >>= 1
            same = [pa.array([group.column(c)[0].as_py()] * len(h), group.schema.field(c).type) for c in (*groups, "height")]
            made = [pa.array(level, pa.int32()), pa.array(idx, pa.int64()), pa.array(h, pa.binary()), pa.array(sibling, pa.binary()), pa.array(top, pa.bool_())]
            return pa.table([*same, *made], names=[*groups, "height", "level", "idx", "h", "sibling", "top"])

        return block

    level = leaves.select(*groups, "height", "idx", "h")
    while True:
        blocks = level.groupBy(*groups, F.shiftright("idx", STEP).alias("_block"))
        built = stage_table(blocks.applyInArrow(builder(base), schema))
        whole = built.filter("not top or level = height").drop("top")
        nodes = whole if nodes is None else nodes.unionByName(whole)
        base += STEP
        if not heights or heights <= base:
            return nodes
        level = built.filter(F.col("top") & (F.col("height") > base))


def _beyond(rows: DataFrame, stones: DataFrame, groups: list[str], step: int) -> DataFrame:
    """Rows with segments of at most step siblings, each put together with that of the ancestor it reaches."""
    far = stones.select(*[F.col(c).alias(f"_{c}") for c in groups], F.col("level").alias("_level"), F.col("idx").alias("_idx"), F.col("path").alias("_path"))
    same = [F.col(c) == F.col(f"_{c}") for c in groups]
    met = rows.join(far, [*same, F.col("level") + step == F.col("_level"), F.shiftright("idx", step) == F.col("_idx")], "left")
    path = F.when(F.col("_path").isNull(), F.col("path")).otherwise(F.concat("path", "_path"))
    return met.withColumn("path", path).select(rows.columns)


def proven(leaves: DataFrame, nodes: DataFrame, groups: list[str]) -> DataFrame:
    """leaves (groups, idx, height) with path: the siblings from the leaf to the root of its tree, null where a node
    has none.

    stones: nodes whose segments reach step levels up, or to the root; a round keeps those of every second such level.
    """
    heights = leaves.agg(F.max("height")).first()[0] or 0
    own = nodes.filter("level < height").withColumn("path", F.array("sibling")).select(*groups, "level", "idx", "path")
    first = own.filter("level = 0").drop("level")
    out = leaves.join(first, [*groups, "idx"], "left").withColumn("path", F.coalesce("path", F.array().cast("array<binary>"))).withColumn("level", F.lit(0))
    stones, step = own.filter("level > 0"), 1
    while step < heights:
        even, odd = (stones.filter(F.col("level") % (2 * step) == rest) for rest in (0, step))
        # The lowest stones, which leaves reach, are among the odd ones. Higher levels have few nodes, and are sent to all
        # tasks where they are measured to be small.
        odd = small_side(odd)
        out = _beyond(out, odd.filter(F.col("level") == step), groups, step)
        stones = stage_table(_beyond(even, odd, groups, step))
        step *= 2
    return out.drop("level")


def manifest(docs: DataFrame, ident: str = "doc_id", group: str = "lang", fields: Sequence[str] = ("doc_id", "source", "lang", "n_chars", "text"), keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """For each row: the kept columns, leaf, subroot and root (hexadecimal), siblings (array of binary from leaf to root,
    null where a node is hashed alone) and turns (bit k is 1 where the node at level k is the second child).

    Within a group leaves ascend by ident, nulls first, then by leaf; groups ascend bytewise, null first. Null fields are
    hashed as `-`. Repeated rows are leaves of their own. An empty table gives no rows, a single row is its own root, and
    columns neither kept nor hashed are left out, whatever their names.
    """
    keys = ["_has", "_key"]
    kept = [f"k{i}" for i in range(len(keep))]
    rows = docs.select(
        *[F.col(c).alias(k) for c, k in zip(keep, kept, strict=True)], F.col(ident).alias("_ident"),
        F.col(group).isNotNull().alias("_has"), F.coalesce(F.col(group).cast("string"), F.lit("")).alias("_key"),
        F.unhex(leaf([F.col(f) for f in fields])).alias("h"),
    )
    leaves = numbered(rows, keys, ["_ident", "h"]).withColumnRenamed("place", "idx").drop("_ident", "size")
    nodes = grown(leaves, keys)
    roots = nodes.filter("level = height").select(*keys, "h")
    tops = numbered(roots.withColumn("_one", F.lit(True)), ["_one"], keys).withColumnRenamed("place", "idx").drop("size")
    upper = grown(tops, ["_one"])
    root = upper.filter("level = height").select("_one", F.col("h").alias("root"))
    tops = proven(tops, upper, ["_one"]).join(small_side(root), "_one")
    tops = tops.select(*keys, F.col("h").alias("subroot"), "root", F.col("path").alias("_above"), F.col("idx").alias("_turns"))
    found = proven(leaves, nodes, keys).join(small_side(tops), keys)
    return found.select(
        *[F.col(k).alias(c) for c, k in zip(keep, kept, strict=True)], _hex(F.col("h")).alias("leaf"), _hex(F.col("subroot")).alias("subroot"),
        _hex(F.col("root")).alias("root"), F.concat("path", "_above").alias("siblings"),
        (F.col("idx") + F.col("_turns") * F.expr("shiftleft(1L, height)")).alias("turns"),
    )


def proof_digest(siblings: str = "siblings") -> Column:
    """The hash of the siblings' hexadecimal texts in order."""
    return F.sha2(F.array_join(F.transform(siblings, _hex), "").cast("binary"), 256)


def folded(leaf: Column, siblings: str = "siblings", turns: str = "turns") -> Column:
    """The root that a leaf (hexadecimal) and the siblings give."""
    way = F.transform(siblings, lambda s, i: F.struct(_hex(s).alias("s"), F.getbit(turns, i).alias("second")))

    def up(node: Column, at: Column) -> Column:
        both = F.when(at["second"] == 1, F.concat(at["s"], node)).otherwise(F.concat(node, at["s"]))
        return F.sha2(F.coalesce(both, node).cast("binary"), 256)

    return F.aggregate(way, leaf, up)

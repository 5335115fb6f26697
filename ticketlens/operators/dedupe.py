"""Duplicate removal and duplicate reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketlens.session import settle

# The filter of repeated rows: bits for each repeated hash, fewest of them, bits set by each, and most bytes of the filter.
FILTER_BITS, FEWEST_BITS, PROBES, FILTER_BYTES = 16, 4, 4, 8 << 20
_A, _B = "_row_hash_a", "_row_hash_b"


def drop_exact(df: DataFrame, long_rows: bool = False) -> DataFrame:
    """One row per distinct row; nulls count as equal.

    Whole rows are compared.  Copies meet in the map-side aggregate first, so
    a large group of copies reaches the shuffle as one row per task.  With
    ``long_rows`` only rows that may repeat are moved (``drop_exact_in_place``).
    """
    return drop_exact_in_place(df) if long_rows else df.dropDuplicates()


def drop_exact_in_place(df: DataFrame, filter_bytes: int = FILTER_BYTES, filter_bits: int = FILTER_BITS) -> DataFrame:
    """One row per distinct row, as ``drop_exact`` gives, without moving the rows that occur once.

    Only 128-bit hashes of rows are shuffled to find those that repeat, and a
    Bloom filter of these, sized from their counted number and bounded by
    ``filter_bytes``, goes to every task.  Rows outside it occur once and stay
    where they are; rows inside are compared whole, so that neither a false
    positive nor a collision of hashes changes the result.  With so many
    repeated rows that the filter would tell little, all rows are compared.

    For tables of long rows: three reads of the table take the place of a
    shuffle of it, so it must give the same rows each time (a stored table, or
    one made from such by fixed rules).
    """
    once, rest = _by_repeats(df, filter_bytes, filter_bits)
    kept = [part for part in (once, None if rest is None else drop_exact(rest)) if part is not None]
    return kept[0] if len(kept) == 1 else kept[0].unionByName(kept[1])


def _by_repeats(df: DataFrame, filter_bytes: int = FILTER_BYTES, filter_bits: int = FILTER_BITS) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows that occur once, and those that may occur again; None for a part that need not be looked at."""
    columns = [F.col(f"`{c}`") for c in df.columns]
    hashes = df.select(F.xxhash64(F.lit(0), *columns).alias(_A), F.xxhash64(F.lit(1), *columns).alias(_B))
    repeated = settle(hashes.groupBy(_A, _B).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select(_A, _B))
    several = repeated.count()
    if not several:
        return df, None
    words = min(-(-several * filter_bits // 64), filter_bytes // 8)
    if words * 64 < several * min(FEWEST_BITS, filter_bits):
        return None, df
    slots = _slots(words * 64)
    bits = _filter_of(repeated.select(F.explode(F.array(*slots)).alias("_slot")), words).scalar()
    inside = F.lit(True)
    for slot in slots:
        inside = inside & (F.get(bits, F.shiftright(slot, 6).cast("int")).bitwiseAND(_bit(slot)) != 0)
    marked = df.withColumns({_A: F.xxhash64(F.lit(0), *columns), _B: F.xxhash64(F.lit(1), *columns)})
    return marked.filter(~inside).select(*columns), marked.filter(inside).select(*columns)


def _slots(bits: int) -> list[Column]:
    """The bits of the filter that a row's hashes set; halves of 31 bits keep the sums in range."""
    start, stride = F.shiftrightunsigned(_A, 33), F.col(_B).bitwiseAND(F.lit((1 << 31) - 1))
    return [F.pmod(start + k * stride, F.lit(bits)) for k in range(PROBES)]


def _bit(slot: Column) -> Column:
    """The word with only the slot's bit set."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int"))


def _filter_of(slots: DataFrame, words: int) -> DataFrame:
    """One row with the filter's words in order; words without a slot are zero."""
    slot = F.col("_slot")
    used = slots.select(F.shiftright(slot, 6).cast("long").alias("_word"), _bit(slot).alias("_mask"))
    every = slots.sparkSession.range(words).select(F.col("id").alias("_word"), F.lit(0).cast("long").alias("_mask"))
    filled = used.unionByName(every).groupBy("_word").agg(F.bit_or("_mask").alias("_mask"))
    row = F.array_sort(F.collect_list(F.struct("_word", "_mask")))
    return settle(filled.agg(F.transform(row, lambda x: x["_mask"]).alias("_bits")))


def exact_copies(df: DataFrame, long_rows: bool = False) -> DataFrame:
    """Row count, distinct row count and removed copies, as one row.

    With ``long_rows`` rows that occur once are counted where they are, as ``drop_exact_in_place`` leaves them.
    """
    once, rest = _by_repeats(df) if long_rows else (None, df)
    parts = [once.select(F.lit(1).cast("long").alias("_n"))] if once is not None else []
    if rest is not None:
        parts.append(rest.groupBy(*rest.columns).agg(F.count(F.lit(1)).alias("_n")).select("_n"))
    per_row = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return per_row.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("rows_dropped"),
    )


def keep_first(df: DataFrame, key: str, order: Column | str, drop_order: bool = False) -> DataFrame:
    """The row with the smallest ``order`` for each key (null is a key too, and a null order is last).

    ``order`` is required: a distributed table has no file order.  The minimum
    is combined on the map side, so a key with very many rows is no hot spot.
    Among rows of equal order the smallest row is taken.
    """
    position = F.col(order) if isinstance(order, str) else order
    rest = [c for c in df.columns if c != key]
    # A struct is never null, so rows without an order take part.
    position = F.struct(position.isNull(), position, *rest)
    kept = [c for c in df.columns if c != key and not (drop_order and c == order)]
    first = df.groupBy(key).agg(F.min_by(F.struct(*kept), position).alias("_first"))
    columns = [c for c in df.columns if c == key or c in kept]
    return first.select(*[F.col(key) if c == key else F.col("_first")[c].alias(c) for c in columns])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys with more than one row, their row count and the rows a dedupe removes."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.filter(F.col("n_rows") > 1).withColumn("n_removed", F.col("n_rows") - 1)


def duplicate_summary(df: DataFrame, key: str) -> DataFrame:
    """Rows before and after a dedupe by key, removed rows and repeated keys, as one row."""
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("rows_before"),
        F.count(F.lit(1)).alias("rows_after"),
        F.coalesce(F.sum(F.col("_n") - 1), F.lit(0)).alias("rows_removed"),
        F.count_if(F.col("_n") > 1).alias("repeated_keys"),
    )

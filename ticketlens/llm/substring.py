"""Substring deduplication with difference-cover anchors.

Any two equal stretches of at least MATCH words have, within the first PERIOD words of both, places at the same
distance from their starts that both lie on cover positions modulo the period. So only windows of
MATCH - PERIOD + 1 words at cover positions, the anchors, are hashed and compared over the whole corpus. Then the
matches are extended: around repeated anchors every full window is hashed with 96 bits, and a window that
starts in more than one place removes its words.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm import exchange as ex
from ticketlens.llm import textops as tx
from ticketlens.session import stage_table

MATCH = 35
SPANS = "array<struct<start:int,stop:int>>"
# A perfect difference set, every distance modulo 21 is the difference of two of its members.
PERIOD, COVER = 21, (3, 6, 7, 12, 14)


def anchor_length(match: int, period: int = PERIOD) -> int:
    if match <= period:
        raise ValueError(f"a match must be longer than the period of {period} words")
    return match - period + 1


def _texts(docs: DataFrame, keep: tuple[str, ...], text: str) -> tuple[DataFrame, list[str]]:
    """The rows under a key of 128 bits of all their values: ids may be null or repeated, equal rows share one."""
    own, names = tx.carried(docs, keep, text)
    own = own.withColumn("text", F.coalesce("text", F.lit("")))
    seed = F.concat_ws(",", *[F.col(n).cast("string") for n in names if n != "text"])
    return own.select(F.xxhash64("text", seed).alias("a"), F.xxhash64(seed, "text").alias("b"), *own.columns), names


def _places(bounds: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """For each word: its place in its text, and whether size words from it on are within the text."""
    count = np.diff(bounds)
    place = tx.spread(count)
    return place, place + size <= np.repeat(count, count)


def _once(h: np.ndarray, extra: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted order of the hashes, where each group of equal ones begins, and the groups' sizes."""
    order = np.argsort(h) if extra is None else np.lexsort((extra, h))
    own = h[order]
    new = np.ones(own.size, bool)
    new[1:] = own[1:] != own[:-1]
    if extra is not None:
        other = extra[order]
        new[1:] |= other[1:] != other[:-1]
    first = np.flatnonzero(new)
    return order, first, np.diff(np.append(first, own.size))


def _entries(buckets: int, a: np.ndarray, b: np.ndarray, text: np.ndarray, place: np.ndarray, h: np.ndarray, extra: np.ndarray | None = None,
             copied: np.ndarray | None = None) -> pa.RecordBatch:
    """Entries for the buckets: one for each hash of the slice, with its place if it occurs once here; and in some
    bucket all further places of hashes that are known to repeat already. copied: hashes that repeat anyway."""
    order, first, sizes = _once(h, extra)
    repeats = np.zeros(h.size, bool)
    repeats[order] = np.repeat(sizes > 1, sizes)
    lead = np.zeros(h.size, bool)
    lead[order[first]] = True
    if copied is not None:
        repeats |= copied
        lead |= copied
    # 0: occurs once in this slice; 1: stands for repeated occurrences; 2: a further place of a repeated hash,
    # in any bucket, since nothing has to meet it.
    kind = np.where(repeats, np.where(lead, 1, 2), 0)
    bucket = np.where(kind == 2, (place + text) % buckets, ex.bucket_of(h, buckets))
    marked = (place | kind << 30).astype(np.uint32)
    return ex.packed(bucket, buckets, text, [a, b], [marked, h, *([] if extra is None else [extra])])


def _repeated(slots: int) -> Callable[[pa.Table], pa.Table]:
    """The places of one bucket's repeated hashes, packed by slots of texts."""
    def run(group: pa.Table) -> pa.Table:
        a, b, marked, h, *extra = ex.unpacked(group, ["<i8", "<i8"], ["<u4", "<u8", "<u4"][: group.num_columns - 4])
        kind, place = marked >> 30, (marked & 0x3FFFFFFF).astype(np.int32)
        meet = np.flatnonzero(kind < 2)
        order, _, sizes = _once(h[meet], extra[0][meet] if extra else None)
        size = np.empty(meet.size, np.int64)
        size[order] = np.repeat(sizes, sizes)
        told = np.ones(h.size, bool)
        told[meet] = (size > 1) | (kind[meet] == 1)
        order = np.flatnonzero(told)
        order = order[np.lexsort((place[order], b[order], a[order]))]
        a, b, place = a[order], b[order], place[order]
        owner = np.cumsum(_new(a, b)) - 1
        first = np.flatnonzero(_new(a, b))
        slot = ex.bucket_of(tx.mix(a.view(np.uint64)), slots)
        return pa.Table.from_batches([ex.packed(slot, slots, owner, [a[first], b[first]], [place])])

    return run


def _new(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.ones(a.size, bool)
    out[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return out


def _by_text(group: pa.Table) -> pa.Table:
    """One row for each text of a slot, with all its places."""
    a, b, place = ex.unpacked(group, ["<i8", "<i8"], ["<i4"])
    order = np.lexsort((place, b, a))
    a, b, place = a[order], b[order], place[order]
    first = np.flatnonzero(_new(a, b))
    ends = np.append(first, a.size)
    blobs = [np.unique(place[ends[k] : ends[k + 1]]).tobytes() for k in range(first.size)]
    return pa.table({"a": pa.array(a[first]), "b": pa.array(b[first]), "places": pa.array(blobs, pa.binary())})


def _repeats(entries: DataFrame, buckets: int) -> DataFrame:
    """Texts with repeated hashes: key, and all places of them."""
    found = entries.groupBy("bucket").applyInArrow(_repeated(buckets), ex.packed_schema(3))
    return found.groupBy("bucket").applyInArrow(_by_text, "a long, b long, places binary")


def _copies(texts: DataFrame, match: int) -> DataFrame:
    """The rows whose whole text occurs again: key, and whether the row stands for the others."""
    own = texts.filter(F.octet_length("text") >= 2 * match - 1).select("a", "b", F.xxhash64("text").alias("t"), F.xxhash64("text", F.lit(1)).alias("u"))
    # Staged, so that both sides of the join are plain exchanges and a text of very many copies can be split.
    same = stage_table(own.groupBy("t", "u").agg(F.count("*").alias("n"), F.min("a").alias("lead")).filter("n > 1"))
    return own.join(same, ["t", "u"]).select("a", "b", (F.col("a") == F.col("lead")).alias("leads")).distinct()


def repeats(texts: DataFrame, match: int, buckets: int) -> DataFrame:
    """For each text with a window of match words that also starts elsewhere: key, and the places of such windows,
    or whole for a text all of whose windows do.

    Of whole texts that occur several times, one stands for all: its windows repeat, and so do those of the others.
    """
    size = anchor_length(match)
    cover = np.isin(np.arange(PERIOD), COVER)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.drop_large()
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                raw, offsets = tx.utf8(batch.column("text"))
                starts, ends, bounds = tx.words(raw, offsets)
                place, whole_match = _places(bounds, size)
                h = tx.window_hashes(tx.word_hashes(raw, starts, ends), size)
                at = np.flatnonzero(whole_match[: h.size] & cover[place[: h.size] % PERIOD])
                # A text shorter than a match has no window at all.
                at = at[np.repeat(np.diff(bounds) >= match, np.diff(bounds))[at]]
                if at.size:
                    text = np.searchsorted(bounds, at, side="right") - 1
                    a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in "ab")
                    yield _entries(buckets, a, b, text, place[at], h[at])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                raw, offsets = tx.utf8(batch.column("text"))
                starts, ends, bounds = tx.words(raw, offsets)
                place, whole_match = _places(bounds, match)
                near = np.zeros(starts.size + 1, np.int64)
                for k, places in enumerate(batch.column("places")):
                    # A window that holds an anchor starts at most match - size words before it.
                    at = np.frombuffer(places.as_buffer(), "<i4").astype(np.int64) + bounds[k]
                    np.add.at(near, np.maximum(at - (match - size), bounds[k]), 1)
                    np.add.at(near, at + 1, -1)
                at = np.flatnonzero((np.cumsum(near)[:-1] > 0) & whole_match)
                if at.size:
                    h, extra = (tx.window_hashes(tx.word_hashes(raw, starts, ends, w), match, w)[at] for w in (0, 1))
                    text = np.searchsorted(bounds, at, side="right") - 1
                    a, b = (batch.column(c).to_numpy(zero_copy_only=False) for c in "ab")
                    copied = batch.column("leads").to_numpy(zero_copy_only=False)[text]
                    yield _entries(buckets, a, b, text, place[at], h, extra.astype(np.uint32), copied)

    # Both joins with the texts read one exchange of them, so the rows go whole to both.
    anchored = _repeats(texts.select("a", "b", "text").mapInArrow(anchors, ex.packed_schema(4)), buckets)
    copies = _copies(texts, match)
    anchored = anchored.join(copies, ["a", "b"], "left").filter(F.coalesce("leads", F.lit(True))).withColumn("leads", F.col("leads").isNotNull())
    found = _repeats(texts.join(anchored, ["a", "b"]).mapInArrow(windows, ex.packed_schema(5)), buckets)
    return found.withColumn("whole", F.lit(False)).unionByName(copies.filter("not leads").select("a", "b", F.lit(None).cast("binary").alias("places"), F.lit(True).alias("whole")))


def scan(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), match: int = MATCH) -> DataFrame:
    """For each row: the kept columns, n_words, n_removed, the removed spans and the kept words joined by one blank.

    Words are runs of bytes that are no ASCII blanks. A window is match consecutive words of one text; each word of
    a window whose words also start at another place, in the same text or any other, is removed. Spans count words
    and are merged and in order. A null, empty or short text loses nothing; equal rows count as copies and get the
    same result each; an empty table has none. The columns that are not in keep are left out, whatever their names.
    """
    texts, names = _texts(docs, keep, text)
    found = repeats(texts, match, ex.bucket_count(docs, text))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                raw, offsets = tx.utf8(batch.column("text"))
                starts, ends, bounds = tx.words(raw, offsets)
                gone = np.zeros(starts.size, bool)
                spans: list[list[dict[str, int]]] = []
                for k, (places, copied) in enumerate(zip(batch.column("places").to_pylist(), batch.column("whole").to_pylist(), strict=True)):
                    own = np.zeros(bounds[k + 1] - bounds[k] + 1, np.int64)
                    if copied and own.size > match:
                        own[0] = 1
                    elif places:
                        at = np.frombuffer(places, "<i4")
                        own[at] += 1
                        np.add.at(own, at + match, -1)
                    own = np.cumsum(own)[:-1] > 0
                    gone[bounds[k] : bounds[k + 1]] = own
                    spans.append([{"start": a, "stop": b} for a, b in tx.stretches(own)] if copied or places else [])
                left = np.flatnonzero(~gone)
                kept, _ = tx.gather(raw, starts[left], ends[left])
                size = np.concatenate([[0], np.cumsum((ends - starts + 1) * ~gone)])[bounds]
                # Without the blank after the last word of a text.
                texts = [kept[size[k] : max(size[k], size[k + 1] - 1)].tobytes().decode() for k in range(batch.num_rows)]
                removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[bounds])
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c) for c in names), pa.array(np.diff(bounds).astype(np.int64)), pa.array(removed.astype(np.int64)),
                     pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), pa.array(texts, pa.string())],
                    [*names, "n_words", "n_removed", "spans", "kept"],
                )

    rows = texts.join(found, ["a", "b"], "left")
    out = rows.mapInArrow(cut, tx.schema_of(rows, names, f"n_words long, n_removed long, spans {SPANS}, kept string"))
    return tx.restored(out, keep, names, "n_words", "n_removed", "spans", "kept")

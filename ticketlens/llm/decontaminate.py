"""Benchmark decontamination with an FM-index for each shard of the training texts.

A window is a run of consecutive benchmark words. A shard is a stretch of documents that one task reads: its
words become numbers, its suffixes are sorted, and the Burrows-Wheeler transform is kept in a wavelet matrix.
All windows are searched backwards at once through ranks in it; places come from sampled suffix positions, and
the spans of a document are merged.

Words that no benchmark text has end every match, so a shard keeps only stretches of benchmark words that are
as long as the shortest window. That loses no occurrence and makes the index a small part of the text.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.llm import textops as tx

WINDOW = 10
# Benchmark bytes for one pass: more are searched in further passes.
BLOCK_BYTES = 8 << 20
SHARD_WORDS = 1 << 19
SAMPLE_RATE = 8
IN_WORD = tx.byte_table((*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)))

SPANS = "array<struct<start:int,stop:int>>"


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """All suffixes in order, by prefix doubling. The last symbol must be smaller than every other and occur once."""
    n = seq.size
    order = np.argsort(seq, kind="stable")
    size = 1
    rank = np.zeros(n, np.int64)
    rank[order] = np.cumsum(np.concatenate([[0], seq[order][1:] != seq[order][:-1]]))
    while rank[order[-1]] < n - 1:
        key = rank * (n + 1)
        key[: n - size] += rank[size:] + 1
        order = np.argsort(key)
        sorted_key = key[order]
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        size *= 2
    return order


class FmIndex:
    """Search in a sequence of symbols 0 ... top; symbol 0 stands between stretches and is never searched."""

    def __init__(self, seq: np.ndarray, top: int, rate: int = SAMPLE_RATE) -> None:
        seq = np.concatenate([seq.astype(np.int64) + 1, [0]])
        order = suffix_array(seq)
        n = seq.size
        last = seq[order - 1]
        counts = np.bincount(seq, minlength=top + 3)
        self.before = np.concatenate([[0], np.cumsum(counts)])
        self.levels: list[tuple[int, int, np.ndarray]] = []
        rest = last
        for bit in range(max(1, int(top + 1).bit_length()) - 1, -1, -1):
            ones = (rest >> bit) & 1
            below = np.zeros(n + 1, np.int32)
            np.cumsum(ones, out=below[1:])
            self.levels.append((bit, n - int(below[-1]), below))
            rest = np.concatenate([rest[ones == 0], rest[ones == 1]])
        marked = order % rate == 0
        self.marks = np.concatenate([[0], np.cumsum(marked)]).astype(np.int32)
        self.places = order[marked]
        self.size = n

    def rank(self, symbol: np.ndarray, to: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the transform before the place."""
        at, start = to.copy(), np.zeros_like(to)
        for bit, zeros, below in self.levels:
            one = (symbol >> bit) & 1 == 1
            at = np.where(one, zeros + below[at], at - below[at])
            start = np.where(one, zeros + below[start], start - below[start])
        return at - start

    def step(self, row: np.ndarray) -> np.ndarray:
        """The row of the suffix that begins one place earlier."""
        at, start, symbol = row.copy(), np.zeros_like(row), np.zeros_like(row)
        for bit, zeros, below in self.levels:
            one = below[at + 1] - below[at] == 1
            symbol |= one.astype(np.int64) << bit
            at = np.where(one, zeros + below[at], at - below[at])
            start = np.where(one, zeros + below[start], start - below[start])
        return self.before[symbol] + at - start

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows (from, to) of the suffixes that begin with each pattern, a row of the matrix."""
        low = np.zeros(patterns.shape[0], np.int64)
        high = np.full(patterns.shape[0], self.size, np.int64)
        open_ = np.arange(patterns.shape[0])
        for k in range(patterns.shape[1] - 1, -1, -1):
            symbol = patterns[open_, k].astype(np.int64) + 1
            low[open_] = self.before[symbol] + self.rank(symbol, low[open_])
            high[open_] = self.before[symbol] + self.rank(symbol, high[open_])
            open_ = open_[low[open_] < high[open_]]
        return low, np.maximum(low, high)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The places of these rows' suffixes in the sequence."""
        out = np.full(rows.size, -1, np.int64)
        row, back, open_ = rows.copy(), 0, np.arange(rows.size)
        while open_.size:
            known = self.marks[row + 1] > self.marks[row]
            out[open_[known]] = self.places[self.marks[row[known]]] + back
            open_, row = open_[~known], self.step(row[~known])
            back += 1
        return out


@dataclass
class Windows:
    """What is searched: the benchmark's words, and its distinct windows by length with the items that hold them."""

    vocabulary: np.ndarray
    patterns: dict[int, np.ndarray]
    holders: dict[int, list[np.ndarray]]
    items: list[str]
    seen: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.seen = np.zeros(1 << 20, bool)
        self.seen[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True

    @property
    def shortest(self) -> int:
        return min(self.patterns, default=0)

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """1 + the place of each word in the vocabulary, 0 for other words."""
        out = np.zeros(hashes.size, np.int32)
        if self.vocabulary.size:
            maybe = np.flatnonzero(self.seen[(hashes >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.vocabulary, hashes[maybe]), self.vocabulary.size - 1)
            same = self.vocabulary[at] == hashes[maybe]
            out[maybe[same]] = at[same] + 1
        return out


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    raw, offsets = tx.utf8(column)
    raw = tx.LOWER[raw]
    starts, ends, bounds = tx.words(raw, offsets, IN_WORD)
    return tx.word_hashes(raw, starts, ends), bounds, starts, ends


def windows_of(items: list[str], texts: list[str | None], window: int = WINDOW) -> Windows:
    hashes, bounds, _, _ = text_words(pa.array(texts, pa.string()))
    vocabulary = np.sort(hashes)
    vocabulary = vocabulary[np.concatenate([[True], vocabulary[1:] != vocabulary[:-1]])] if hashes.size else vocabulary
    numbers = (np.searchsorted(vocabulary, hashes) + 1).astype(np.int32)
    found: dict[int, dict[bytes, set[int]]] = {}
    for k in range(len(items)):
        own = numbers[bounds[k] : bounds[k + 1]]
        length = min(window, own.size)
        for s in range(own.size - length + 1 if length else 0):
            found.setdefault(length, {}).setdefault(own[s : s + length].tobytes(), set()).add(k)
    patterns = {n: np.frombuffer(b"".join(x), np.int32).reshape(-1, n) for n, x in found.items()}
    holders = {n: [np.array(sorted(y)) for y in x.values()] for n, x in found.items()}
    return Windows(vocabulary, patterns, holders, items)


def occurrences(shard: np.ndarray, wanted: Windows) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """For each window that occurs in the shard: its places, its length, and the items that hold it."""
    index = FmIndex(shard, wanted.vocabulary.size)
    for length, patterns in wanted.patterns.items():
        low, high = index.search(patterns)
        hit = np.flatnonzero(high > low)
        if not hit.size:
            continue
        counts = (high - low)[hit]
        places = index.locate(np.repeat(low[hit], counts) + tx.spread(counts))
        for k, part in zip(hit, np.split(places, np.cumsum(counts)[:-1]), strict=True):
            yield part, length, wanted.holders[length][k]


def long_runs(numbers: np.ndarray, bounds: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Stretches of known words within one text, at least that long: first word and number of words."""
    if not numbers.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    edge = np.zeros(numbers.size + 1, bool)
    edge[bounds] = True
    known = numbers > 0
    first = np.flatnonzero(known & (np.concatenate([[True], ~known[:-1]]) | edge[:-1]))
    last = np.flatnonzero(known & (np.concatenate([~known[1:], [True]]) | edge[1:])) + 1
    wide = last - first >= least
    return first[wide], (last - first)[wide]


def hits(numbers: np.ndarray, bounds: np.ndarray, wanted: Windows, shard_words: int = SHARD_WORDS) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Which words of the texts lie in an occurrence, and the items by text."""
    hit = np.zeros(numbers.size + 1, np.int64)
    items: dict[int, set[int]] = {}
    first, size = long_runs(numbers, bounds, wanted.shortest) if wanted.patterns else (np.zeros(0, np.int64),) * 2
    if first.size:
        cut = np.flatnonzero(np.diff(np.cumsum(size + 1) // shard_words)) + 1
        for f, s in zip(np.split(first, cut), np.split(size, cut), strict=True):
            # Each stretch is followed by one place that holds the separator.
            place = np.repeat(f, s + 1) + tx.spread(s + 1)
            shard = numbers[np.minimum(place, numbers.size - 1)].copy()
            shard[np.cumsum(s + 1) - 1] = 0
            for at, length, holders in occurrences(shard, wanted):
                start = place[at]
                np.add.at(hit, start, 1)
                np.add.at(hit, start + length, -1)
                for text in set((np.searchsorted(bounds, start, side="right") - 1).tolist()):
                    items.setdefault(text, set()).update(holders.tolist())
    return np.cumsum(hit)[:-1] > 0, items


def blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[tuple[bool, Windows]]:
    """The benchmark in blocks of a bounded number of bytes, each of which the driver holds alone; the last is marked."""
    table = benchmark.select(F.col(item).cast("string").alias("item"), F.col(text).alias("text")).filter("item is not null")
    total = table.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("n")).first()["n"]
    count = max(1, math.ceil(total / block_bytes))
    for k in range(count):
        own = table.filter(F.pmod(F.xxhash64("item", "text"), F.lit(count)) == k) if count > 1 else table
        rows = own.toArrow().to_pydict()
        yield k == count - 1, windows_of(rows["item"], rows["text"])


def scan(docs: DataFrame, benchmark: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), item: str = "item_id",
         item_text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each row: the kept columns, n_words, spans of benchmark words and the items found.

    Spans count words, are merged and in order. Items are distinct texts, in string order. A null or empty text
    has no words, spans or items; a null item is left out, a null or wordless item text holds no window. Repeated
    rows get the same result each, an empty table none. The columns of docs that are not in keep are left out,
    whatever their names. Nothing is shuffled: a shard of texts meets one bounded block of the benchmark at a time.
    """
    out, names = tx.carried(docs, keep, text)
    out = out.withColumns({"n_words": F.lit(0).cast("int"), "spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")})
    for last, wanted in blocks(benchmark, item, item_text, block_bytes):
        fields = [f for f in out.schema if not last or f.name in names or f.name != "text"]
        out = out.mapInArrow(_searcher(tx.Shared(docs.sparkSession, wanted), [f.name for f in fields]), T.StructType(fields))
    return tx.restored(out, keep, names, "n_words", "spans", "items")


def _searcher(shared: tx.Shared, columns: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = shared.value
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                hashes, bounds, _, _ = text_words(batch.column("text"))
                flags, found = hits(wanted.numbers(hashes), bounds, wanted)
                spans, items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
                for k in range(batch.num_rows):
                    if k in found:
                        own = flags[bounds[k] : bounds[k + 1]].copy()
                        for s in spans[k]:
                            own[s["start"] : s["stop"]] = True
                        spans[k] = [{"start": a, "stop": b} for a, b in tx.stretches(own)]
                        items[k] = sorted({*items[k], *(wanted.items[i] for i in found[k])})
                made = {"n_words": pa.array(np.diff(bounds).astype(np.int32)), "spans": pa.array(spans, batch.schema.field("spans").type), "items": pa.array(items, batch.schema.field("items").type)}
                yield pa.RecordBatch.from_arrays([made[c] if c in made else batch.column(c) for c in columns], columns)

    return run


def n_hit(spans: str = "spans") -> Column:
    return F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["start"])


def without_spans(docs: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """The texts without the words of the spans; other characters stay as they are."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, text):
                column = batch.column(text)
                cut = [k for k, s in enumerate(batch.column(spans).to_pylist()) if s]
                if cut:
                    raw, offsets = tx.utf8(column)
                    starts, ends, bounds = tx.words(tx.LOWER[raw], offsets, IN_WORD)
                    values = column.to_pylist()
                    for k in cut:
                        left, at = [], int(offsets[k])
                        for s in batch.column(spans)[k].as_py():
                            left.append(raw[at : starts[bounds[k] + s["start"]]].tobytes())
                            at = int(ends[bounds[k] + s["stop"] - 1])
                        left.append(raw[at : offsets[k + 1]].tobytes())
                        values[k] = b"".join(left).decode()
                    column = pa.array(values, column.type)
                yield pa.RecordBatch.from_arrays([column if f.name == text else batch.column(f.name) for f in batch.schema], schema=batch.schema)

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))

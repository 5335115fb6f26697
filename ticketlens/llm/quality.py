"""Quality classifier: a linear hinge-loss model on n-gram indicators scaled by class log-count ratios.

Indicators are of word n-grams and of shape n-grams. The shape of a word has its letters and digits by kind, runs of
them shortened, and its other characters as they are; a word equal to the one before has a shape of its own. Features
are hashed. The ratio of a feature is the logarithm of its smoothed share in good texts over that in bad ones; features
that few texts have are left out. The model is fitted by dual coordinate descent, its margins are turned into
probabilities on texts it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm import textops as tx

# The model is fitted on at most so many labelled texts, chosen by a hash of their ids.
SAMPLE = 12_000
BITS = 18
LEAST_TEXTS = 5
COST = 1.0
ROUNDS = 30
# Every n-th text of the sample serves to turn margins into probabilities.
CALIBRATION = 4

_KINDS = np.arange(256, dtype=np.uint8)
_KINDS[ord("a") : ord("z") + 1] = ord("a")
_KINDS[ord("A") : ord("Z") + 1] = ord("A")
_KINDS[ord("0") : ord("9") + 1] = ord("0")
_KINDS[0x80:] = ord("a")
_RUN = np.zeros(256, bool)
_RUN[[ord("a"), ord("A"), ord("0")]] = True


def features(column: pa.Array, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The hashed features of all texts in order, each once for a text, and where each text's begin."""
    raw, offsets = tx.utf8(column)
    starts, ends, bounds = tx.words(raw, offsets)
    n = starts.size
    text = np.repeat(np.arange(len(column)), np.diff(bounds))
    word = tx.word_hashes(tx.LOWER[raw], starts, ends) if n else np.zeros(0, np.uint64)
    kinds = _KINDS[raw]
    keep = np.ones(raw.size, bool)
    keep[1:] = ~(_RUN[kinds[1:]] & (kinds[1:] == kinds[:-1]))
    keep[starts] = True
    at = np.concatenate([[0], np.cumsum(keep)])
    shape = tx.word_hashes(kinds[keep], at[starts], at[ends], 1) if n else word
    again = np.zeros(n, bool)
    again[1:] = (word[1:] == word[:-1]) & (text[1:] == text[:-1])
    shape = np.where(again, np.uint64(1), shape)
    found, owner = [], []
    for h, sizes, salt in ((word, (1, 2), 0), (shape, (1, 2, 3), 8)):
        for size in sizes:
            wide = tx.window_hashes(h, size)
            inside = text[: wide.size] == text[size - 1 :] if n >= size else np.zeros(0, bool)
            found.append((tx.mix(wide[inside] + np.uint64(salt + size), 1) >> np.uint64(64 - bits)).astype(np.int64))
            owner.append(text[: wide.size][inside])
    key = np.sort(np.concatenate(owner) << bits | np.concatenate(found))
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if key.size else key
    return key & ((1 << bits) - 1), np.searchsorted(key >> bits, np.arange(len(column) + 1))


def descend(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, size: int, cost: np.ndarray, rounds: int = ROUNDS, seed: int = 7) -> np.ndarray:
    """Weights (the last one is the bias) of the linear hinge-loss model, by dual coordinate descent. y is +1 or -1,
    rows are (feature numbers, values), cost is the upper bound of each dual variable."""
    w = np.zeros(size + 1)
    alpha = np.zeros(len(rows))
    norm = np.array([float(v @ v) + 1 for _, v in rows])
    random = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in random.permutation(len(rows)):
            at, v = rows[i]
            gradient = y[i] * (w[at] @ v + w[-1]) - 1
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[at] += step * y[i] * v
                w[-1] += step * y[i]
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def logistic(margin: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and shift that turn margins into probabilities of y = 1, by Newton steps on smoothed labels."""
    good, bad = float((y == 1).sum()), float((y == 0).sum())
    target = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        q = p * (1 - p) + 1e-9
        h = np.array([[(q * margin * margin).sum() + 1e-6, (q * margin).sum()], [(q * margin).sum(), q.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 0.0)), float(b)


@dataclass
class Model:
    """scaled: weight times ratio of each feature, for the margin of a text before its length is divided out."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def score(self, found: np.ndarray, begin: np.ndarray) -> np.ndarray:
        """The probability of a good text for each text, from its features."""
        margin = margins(self.ratio, self.weight, found, begin) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _sums(values: np.ndarray, begin: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values)])
    return total[begin[1:]] - total[begin[:-1]]


def margins(ratio: np.ndarray, weight: np.ndarray, found: np.ndarray, begin: np.ndarray) -> np.ndarray:
    r = ratio[found]
    length = np.sqrt(_sums(r * r, begin))
    return _sums(r * weight[found], begin) / np.where(length > 0, length, 1)


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE, bits: int = BITS) -> Model:
    """The model from labelled texts (label 1 is good, 0 is bad), of which a bounded sample is read.

    Rows with a null id or label teach nothing; a label given twice counts once, the larger of two that differ. With
    labels of one kind only, or none, every score is the smoothed share of good texts.
    """
    tx.short_batches(docs.sparkSession)
    own = labels.filter(F.col(ident).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(ident).alias("id")).agg(F.max(label).cast("int").alias("y"))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = docs.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("id", "text", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                found, begin = features(batch.column("text"), bits)
                blobs = [found[begin[k] : begin[k + 1]].astype(np.int32).tobytes() for k in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("y"), pa.array(blobs, pa.binary())], ["id", "y", "found"])

    # One row of at most sample texts, as feature numbers.
    got = rows.mapInArrow(run, "id string, y int, found binary").orderBy("id", "found").toArrow()
    y = got.column("y").to_numpy()
    found = [np.frombuffer(b.as_buffer(), np.int32) for b in got.column("found")]
    size = 1 << bits
    flat = Model(np.zeros(size), np.zeros(size), 0.0, 1.0, float(np.log((y.sum() + 1) / ((1 - y).sum() + 1))))
    if min(y.sum(), (1 - y).sum()) < 2:
        return flat
    held = np.zeros(y.size, bool)
    for kind in (0, 1):
        held[np.flatnonzero(y == kind)[:: CALIBRATION]] = True
    if min(y[~held].sum(), (1 - y[~held]).sum()) < 1:
        held[:] = False
    counts = np.zeros((2, size))
    for kind in (0, 1):
        mine = [f for f, k, h in zip(found, y, held, strict=True) if k == kind and not h]
        counts[kind] = np.bincount(np.concatenate(mine), minlength=size)
    n = np.array([(y[~held] == k).sum() for k in (0, 1)])
    ratio = np.log((counts[1] + 1) / (n[1] + 2)) - np.log((counts[0] + 1) / (n[0] + 2))
    ratio[counts.sum(axis=0) < min(LEAST_TEXTS, max(1, n.min() // 2))] = 0
    train = []
    for k in np.flatnonzero(~held):
        at = found[k][ratio[found[k]] != 0]
        v = ratio[at]
        train.append((at, v / max(float(np.sqrt(v @ v)), 1e-9)))
    # Both classes weigh the same.
    sign = np.where(y[~held] == 1, 1.0, -1.0)
    cost = COST * np.where(sign > 0, n.sum() / (2 * n[1]), n.sum() / (2 * n[0]))
    w = descend(train, sign, size, cost)
    check = np.flatnonzero(held) if held.any() else np.arange(y.size)
    begin = np.concatenate([[0], np.cumsum([found[k].size for k in check])])
    margin = margins(ratio, w[:-1], np.concatenate([found[k] for k in check]), begin) + w[-1]
    return Model(ratio, w[:-1], float(w[-1]), *logistic(margin, y[check]))


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row: the kept columns and score, the probability that its label is 1.

    A null or empty text has no features and the score of the bias. Equal texts get equal scores, an empty table no
    rows; the other columns are left out, whatever their names.
    """
    rows, names = tx.carried(docs, keep, text)
    shared = tx.Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        bits = model.ratio.size.bit_length() - 1
        for whole in batches:
            for batch in tx.slices(whole, "text", tx.SLICE_BYTES):
                scores = model.score(*features(batch.column("text"), bits))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(scores)], [*names, "score"])

    out = rows.mapInArrow(run, tx.schema_of(rows, names, "score double"))
    return tx.restored(out, keep, names, "score")

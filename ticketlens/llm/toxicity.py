"""Toxicity by the nearest labelled examples under TF-IDF cosine, found exactly with a block-max inverted index.

Terms are words and beginnings of words that toxic labelled texts have clearly more often than others. Each
of the first uses in a text is a term of its own, so that texts with many uses are far from those with one. Document
frequencies are counted over the whole corpus. The index has a posting list for each term and, for each block of examples, the
largest weight of the term in it. For a text, the blocks' bounds are the sums of its weights times these; blocks are
scored in the order of their bounds until no bound exceeds the k-th similarity found. The neighbours' labels, weighted
by distance, are a vote that is turned into a probability on examples that were left out of the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm import textops as tx
from ticketlens.llm.quality import logistic

# Labelled texts that are read, terms that are chosen from them, and the least signal of a term (log-likelihood ratio).
SAMPLE = 12_000
TERMS = 2048
LEAST_SIGNAL = 25.0
# Bytes of the beginnings of words, and uses in a text that are told apart.
BEGINNINGS = (4, 5, 6, 7, 8)
USES = 4
NEIGHBOURS = 9
BLOCK = 64
# Every n-th example is left out of the index and calibrates the votes.
CALIBRATION = 4
IN_WORD = tx.byte_table((*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)))


def _bits(hashes: np.ndarray) -> np.ndarray:
    seen = np.zeros(1 << 16, bool)
    seen[(hashes >> np.uint64(48)).astype(np.int64)] = True
    return seen


def _among(hashes: np.ndarray, seen: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of h are among the sorted hashes, and their places there."""
    if not hashes.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    maybe = np.flatnonzero(seen[(h >> np.uint64(48)).astype(np.int64)])
    at = np.minimum(np.searchsorted(hashes, h[maybe]), hashes.size - 1)
    same = hashes[at] == h[maybe]
    return maybe[same], at[same]


_KEEP = np.array([0, 0xFF, 0xFFFF, 0xFFFFFF, 0xFFFFFFFF], np.uint32)


def _heads(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first four bytes of each word as a number."""
    padded = np.concatenate([raw, np.zeros(4, np.uint8)])
    return np.ndarray((raw.size + 1,), "<u4", padded, strides=(1,))[starts] & _KEEP[np.minimum(ends - starts, 4)]


def uses(column: pa.Array, bases: np.ndarray | None = None, heads: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For the first uses of words and beginnings in each text: text, base hash, term hash and first four bytes, in the
    order of texts. With bases, sorted hashes, only of those; heads, their sorted first four bytes, spare the rest."""
    raw, offsets = tx.utf8(column)
    raw = tx.LOWER[raw]
    starts, ends, bounds = tx.words(raw, offsets, IN_WORD)
    head = _heads(raw, starts, ends)
    if heads is not None:
        at = np.minimum(np.searchsorted(heads, head), max(0, heads.size - 1))
        some = np.flatnonzero(heads[at] == head) if heads.size else np.zeros(0, np.int64)
        starts, ends, head, texts = starts[some], ends[some], head[some], np.searchsorted(bounds, some, side="right") - 1
    else:
        texts = np.searchsorted(bounds, np.arange(starts.size), side="right") - 1
    seen = None if bases is None else _bits(bases)
    owner, found, first = [], [], []
    for size in (0, *BEGINNINGS):
        part = np.flatnonzero(ends - starts > size) if size else np.arange(starts.size)
        h = tx.word_hashes(raw, starts[part], starts[part] + size if size else ends[part])
        h = tx.mix(h + np.uint64(size), 1)
        if bases is not None:
            hit, _ = _among(bases, seen, h)
            part, h = part[hit], h[hit]
        owner.append(texts[part])
        found.append(h)
        first.append(head[part])
    text, base, head = np.concatenate(owner), np.concatenate(found), np.concatenate(first)
    order = np.lexsort((base, text))
    text, base, head = text[order], base[order], head[order]
    new = np.ones(text.size, bool)
    new[1:] = (text[1:] != text[:-1]) | (base[1:] != base[:-1])
    number = tx.spread(np.diff(np.append(np.flatnonzero(new), text.size)))
    keep = number < USES
    text, base, head, number = text[keep], base[keep], head[keep], number[keep]
    return text, base, tx.mix(base + number.astype(np.uint64)), head


@dataclass
class Terms:
    """Hashes of the terms in order, the bases they come from and the bases' first four bytes, both in order, and the
    terms' inverse document frequencies."""

    hashes: np.ndarray
    bases: np.ndarray
    heads: np.ndarray
    idf: np.ndarray

    def found(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Text and term of all terms of the texts, in order."""
        text, _, h, _ = uses(column, self.bases, self.heads)
        hit, term = _among(self.hashes, _bits(self.hashes), h)
        order = np.lexsort((term, text[hit]))
        return text[hit][order], term[order]

    def vectors(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text its terms and their weights, of length 1; nothing without a term."""
        text, term = self.found(column)
        weight = self.idf[term]
        edges = np.searchsorted(text, np.arange(len(column) + 1))
        out = []
        for k in range(len(column)):
            w = weight[edges[k] : edges[k + 1]]
            out.append((term[edges[k] : edges[k + 1]], w / np.sqrt(w @ w) if w.size else w))
        return out


class BlockMaxIndex:
    """Postings of each term by example, and the largest weight of each term in each block of examples."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int = BLOCK) -> None:
        self.block, self.size, self.read = block, len(vectors), 0
        term = np.concatenate([v[0] for v in vectors] or [np.zeros(0, np.int64)]).astype(np.int64)
        weight = np.concatenate([v[1] for v in vectors] or [np.zeros(0)])
        example = np.repeat(np.arange(self.size), [v[0].size for v in vectors])
        order = np.lexsort((example, term))
        self.example, self.weight = example[order], weight[order]
        self.begin = np.searchsorted(term[order], np.arange(terms + 1))
        # Blocks of a term as postings of their own: the block, where its postings begin, and the largest weight.
        place = term[order] * (self.size // block + 1) + self.example // block
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if place.size else np.zeros(0, np.int64)
        self.top_block = self.example[first] // block
        self.top = np.maximum.reduceat(self.weight, first) if first.size else self.weight
        self.top_first, self.top_size = first, np.diff(np.append(first, place.size))
        self.top_begin = np.searchsorted(first, self.begin)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The k examples of the highest positive similarity, and the similarities; the first among equals.

        Only postings of blocks whose bounds reach the k-th similarity are read; ``read`` counts them.
        """
        blocks = self.size // self.block + 1
        sizes = self.top_begin[term + 1] - self.top_begin[term]
        part = np.repeat(self.top_begin[term], sizes) + tx.spread(sizes)
        w, block = np.repeat(weight, sizes), self.top_block[part]
        bound = np.bincount(block, w * self.top[part], minlength=blocks)
        order = np.argsort(-bound, kind="stable")
        best, names = np.zeros(0), np.zeros(0, np.int64)
        at, step = 0, 1
        # Equal similarities of later blocks could have smaller numbers, so equal bounds are still scored.
        while at < blocks and bound[order[at]] > 0 and (best.size < k or bound[order[at]] >= best[-1] - 1e-12):
            chosen = np.zeros(blocks, bool)
            some = order[at : at + step]
            chosen[some[bound[some] >= best[-1] - 1e-12] if best.size == k else some] = True
            mine = np.flatnonzero(chosen[block])
            count = self.top_size[part[mine]]
            posting = np.repeat(self.top_first[part[mine]], count) + tx.spread(count)
            self.read += posting.size
            scores = np.bincount(self.example[posting], np.repeat(w[mine], count) * self.weight[posting], minlength=self.size)
            hit = np.flatnonzero(scores > 0)
            best, names = np.concatenate([best, scores[hit]]), np.concatenate([names, hit])
            keep = np.lexsort((names, -np.round(best, 12)))[:k]
            best, names = best[keep], names[keep]
            at, step = at + step, step * 2
        return names, best


@dataclass
class Model:
    terms: Terms
    index: BlockMaxIndex
    labels: np.ndarray
    names: list[str]
    k: int
    prior: float
    slope: float = 1.0
    shift: float = 0.0
    lone: float = 0.0

    def vote(self, term: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """The log-odds of the neighbours' weighted labels, the neighbours and their similarities. A neighbour at
        distance d = 1 - similarity weighs 1 / (0.1 + d); the prior share counts as one that has nothing in common."""
        names, near = self.index.nearest(term, weight, self.k)
        w = 1 / (1.1 - near)
        share = (w @ self.labels[names] + self.prior) / (w.sum() + 1)
        return float(np.log(share / (1 - share))), names, near

    def probability(self, vote: float) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * vote + self.shift, -30, 30))))


def _signal(n1: np.ndarray, n0: np.ndarray, all1: float, all0: float) -> np.ndarray:
    """Twice the log-likelihood ratio of a term's use by class against use without regard to class."""
    def part(seen: np.ndarray, share: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1) / np.maximum(share, 1e-12)), 0)

    rate = (n1 + n0) / (all1 + all0)
    return 2 * (part(n1, rate * all1) + part(n0, rate * all0) + part(all1 - n1, (1 - rate) * all1) + part(all0 - n0, (1 - rate) * all0))


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic", sample: int = SAMPLE,
        terms: int = TERMS, k: int = NEIGHBOURS) -> Model:
    """The index and its calibration from labelled texts (1 is toxic), of which a bounded sample is read.

    Rows with a null id or label teach nothing; a label given twice counts once, the larger of two that differ. Without
    both labels there are no terms, and every score is the smoothed share of toxic texts.
    """
    tx.short_batches(docs.sparkSession)
    own = labels.filter(F.col(ident).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(ident).alias("id")).agg(F.max(label).cast("int").alias("y"))
    chosen = own.orderBy(F.xxhash64("id"), "id").limit(sample)
    every = docs.select(F.col(ident).alias("id"), F.col(text).cast("string").alias("text"))
    rows = every.join(F.broadcast(chosen), "id").select("id", "text", "y")

    def used(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                text, base, h, head = uses(batch.column("text"))
                order = np.argsort(h)
                h, y, base, head = h[order], batch.column("y").to_numpy()[text[order]], base[order], head[order].astype(np.int64)
                first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if h.size else np.zeros(0, np.int64)
                if first.size:
                    columns = [h[first].view(np.int64), base[first].view(np.int64), head[first], np.add.reduceat(y, first).astype(np.int64), np.diff(np.append(first, h.size))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["h", "base", "head", "n1", "n"])

    counts = rows.groupBy("y").agg(F.count("*").alias("n")).collect()
    total = {r["y"]: r["n"] for r in counts}
    all1, all0 = total.get(1, 0), total.get(0, 0)
    prior = (all1 + 1) / (all1 + all0 + 2)
    told = rows.mapInArrow(used, "h long, base long, head long, n1 long, n long").groupBy("h", "base", "head").agg(F.sum("n1").alias("n1"), F.sum("n").alias("n")).filter("n > 2")
    rate = F.col("n") / max(1, all1 + all0)
    # Terms are ranked by how far their toxic uses exceed those expected; at most terms of them come here.
    gap = (F.col("n1") - rate * all1) / F.sqrt(rate * all1 + 1)
    ranked = told.withColumn("gap", gap).filter("gap > 0").orderBy(F.desc("gap"), "h").limit(terms if all1 and all0 else 0).toArrow()
    n1, n = (ranked.column(c).to_numpy().astype(float) for c in ("n1", "n"))
    strong = _signal(n1, n - n1, all1, all0) >= LEAST_SIGNAL if n.size else np.zeros(0, bool)
    hashes, bases = (np.unique(ranked.column(c).to_numpy().view(np.uint64)[strong]) if n.size else np.zeros(0, np.uint64) for c in ("h", "base"))

    heads = np.unique(ranked.column("head").to_numpy()[strong]).astype(np.uint32) if n.size else np.zeros(0, np.uint32)

    bare = tx.Shared(docs.sparkSession, Terms(hashes, bases, heads, np.ones(hashes.size)))

    def frequency(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = bare.value
        texts, sums = 0, np.zeros(terms.hashes.size, np.int64)
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                sums += np.bincount(terms.found(batch.column("text"))[1], minlength=sums.size)
                texts += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(sums.size), -1)), pa.array(np.append(sums, texts))], ["term", "n"])

    found = every.select("text").mapInArrow(frequency, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    seen = dict(zip(found.column("term").to_pylist(), found.column("n").to_pylist(), strict=True))
    idf = np.log((seen.get(-1, 0) + 1) / (np.array([seen.get(t, 0) for t in range(hashes.size)], float) + 1)) + 1
    known = Terms(hashes, bases, heads, idf)
    shared = tx.Shared(docs.sparkSession, known)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = shared.value
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                got = terms.vectors(batch.column("text"))
                blobs = [pa.array([v[k].astype(kind).tobytes() for v in got], pa.binary()) for k, kind in ((0, np.int32), (1, np.float64))]
                yield pa.RecordBatch.from_arrays([batch.column("id").cast(pa.string()), batch.column("y"), *blobs], ["id", "y", "t", "w"])

    got = rows.mapInArrow(vectors, "id string, y int, t binary, w binary").orderBy("id", "t", "w").toArrow()
    y = got.column("y").to_numpy()
    vector = [(np.frombuffer(t.as_buffer(), np.int32), np.frombuffer(w.as_buffer())) for t, w in zip(got.column("t"), got.column("w"), strict=True)]
    some = np.array([v[0].size > 0 for v in vector], bool)
    left_out = np.zeros(y.size, bool)
    for kind in (0, 1):
        left_out[np.flatnonzero(some & (y == kind))[::CALIBRATION]] = True
    inside = np.flatnonzero(some & ~left_out)
    model = Model(known, BlockMaxIndex([vector[i] for i in inside], hashes.size), y[inside].astype(float), [got.column("id")[int(i)].as_py() for i in inside], k, prior)
    check = np.flatnonzero(left_out)
    if check.size and 0 < y[check].sum():
        model.slope, model.shift = logistic(np.array([model.vote(*vector[i])[0] for i in check]), y[check])
    # Texts without any term have no neighbour: their score is the smoothed share of toxic ones among such examples.
    model.lone = float((y[~some].sum() + prior) / ((~some).sum() + 1))
    return model


EVIDENCE = "evidence array<struct<example:string,similarity:double,label:int>>"


def score(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """For each row: the kept columns, score (the probability that its label is 1) and evidence (the nearest examples).

    A text without terms, empty or null, has no evidence and the score of such examples. Equal texts get equal results;
    among equally near examples the first of the index are taken. An empty table gives no rows, and the other columns
    are left out, whatever their names.
    """
    rows, names = tx.carried(docs, keep, text)
    shared = tx.Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        voted: dict[bytes, tuple[float, list[dict]]] = {}
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                out = []
                for term, weight in model.terms.vectors(batch.column("text")):
                    if not term.size:
                        out.append((model.lone, []))
                        continue
                    key = term.tobytes() + weight.tobytes()
                    if key not in voted:
                        if len(voted) >= 50_000:
                            voted.clear()
                        vote, near, similarity = model.vote(term, weight)
                        told = [{"example": model.names[n], "similarity": float(s), "label": int(model.labels[n])} for n, s in zip(near, similarity, strict=True)]
                        voted[key] = (model.probability(vote), told)
                    out.append(voted[key])
                kind = pa.list_(pa.struct([("example", pa.string()), ("similarity", pa.float64()), ("label", pa.int32())]))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array([o[0] for o in out], pa.float64()), pa.array([o[1] for o in out], kind)], [*names, "score", "evidence"])

    out = rows.mapInArrow(run, tx.schema_of(rows, names, f"score double, {EVIDENCE}"))
    return tx.restored(out, keep, names, "score", "evidence")

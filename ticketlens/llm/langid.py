"""Language identification by unigram models over the pieces of a fixed vocabulary, all segmentations summed.

A word has the probability, in a language, of all its segmentations into pieces together: a forward pass over its
bytes adds the products. A text's log-likelihood is the sum over its words. Piece probabilities are learned with
expectation maximisation: the backward pass gives the expected count of every piece in the training words.

Each task handles the distinct words of a slice at once, one byte position after the other, with a trie of the
vocabulary as arrays. Runs of letters of LONG bytes and more, such as whole sentences of scripts without blanks, have
probabilities that a float cannot hold: the same sums are done on logarithms for them, whatever their length.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm import textops as tx
from ticketlens.session import settle

# The models are fitted on about this many texts of each language, chosen by a hash of the id; all if there are fewer.
SAMPLE_TEXTS = 2000
ROUNDS = 4
# From so many bytes on a word is summed on logarithms. Bytes of such words that are handled at once.
LONG = 32
LONG_BYTES = 1 << 18
# Shorter words that are handled at once: their prefixes take some hundred bytes a word for each language.
SHORT_WORDS = 1 << 13
SMOOTHING = 0.02
UNDETERMINED = "und"

LETTERS = np.zeros(256, bool)
LETTERS[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1), *range(0x80, 0x100)]] = True


@dataclass
class Trie:
    """follow[node * classes + class of byte] is the next node or 0; piece[node] is a piece's number or -1.
    Nodes without a next one come last, so that their part of follow is never written and takes no memory."""

    classes: np.ndarray
    width: int
    follow: np.ndarray
    piece: np.ndarray
    pieces: int


def trie_of(path: str) -> Trie:
    """The vocabulary's pieces that can occur in a word: lower-case letters with or without the blank before.
    Every single byte is a piece, so that each word has a segmentation."""
    with open(path, "rb") as f:
        tokens = [base64.b64decode(line.split()[0]) for line in f if line.strip()]
    wanted = {t for t in tokens if all(LETTERS[b] and not 0x41 <= b <= 0x5A for b in (t[1:] if t[:1] == b" " and len(t) > 1 else t))}
    wanted |= {bytes([b]) for b in (0x20, *range(0x61, 0x7B), *range(0x80, 0x100))}
    used = sorted({b for t in wanted for b in t})
    classes = np.zeros(256, np.int64)
    classes[used] = np.arange(1, len(used) + 1)
    width = len(used) + 1
    child: dict[int, int] = {}
    piece = [-1, -1]
    for number, token in enumerate(sorted(wanted)):
        node = 1
        for c in classes[list(token)].tolist():
            at = node * width + c
            node = child.get(at, 0)
            if not node:
                node = child[at] = len(piece)
                piece.append(-1)
        piece[node] = number
    node, c = np.divmod(np.fromiter(child.keys(), np.int64, len(child)), width)
    has = np.zeros(len(piece), bool)
    has[:2] = has[node] = True
    order = np.argsort(~has, kind="stable")
    place = np.argsort(order)
    follow = np.zeros(len(piece) * width, np.int32)
    follow[place[node] * width + c] = place[np.fromiter(child.values(), np.int64, len(child))]
    return Trie(classes, width, follow, np.array(piece, np.int32)[order], len(wanted))


@dataclass
class Words:
    """Distinct words as rows of bytes, the longest first, with a blank before each."""

    letters: np.ndarray
    size: np.ndarray

    def longer(self, size: int) -> int:
        """How many words have that size at least."""
        return int(np.searchsorted(-self.size, -size, side="right"))

    def steps(self, trie: Trie) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """From each byte position on: length, and which words have which piece there."""
        for at in range(self.letters.shape[1]):
            alive = int(np.searchsorted(-self.size, -at))
            word = np.arange(alive)
            node = np.ones(alive, np.int64)
            length = 0
            while word.size:
                length += 1
                node = trie.follow[node * trie.width + trie.classes[self.letters[word, at + length - 1]]]
                good = node > 0
                word, node = word[good], node[good]
                piece = trie.piece[node]
                has = piece >= 0
                if has.any():
                    yield at, length, word[has], piece[has]
                more = self.size[word] > at + length
                word, node = word[more], node[more].astype(np.int64)


def distinct_words(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[Words, np.ndarray]:
    """The distinct words, and the place of each word among them."""
    first, size, place = distinct(raw, starts, ends)
    return words_at(raw, first, size), place


def distinct(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and sizes of the distinct words, the longest first, and the place of each word among them."""
    h = tx.word_hashes(raw, starts, ends)
    order = np.argsort(h)
    new = np.ones(h.size, bool)
    new[1:] = h[order[1:]] != h[order[:-1]]
    which = np.empty(h.size, np.int64)
    which[order] = np.cumsum(new) - 1
    first = order[new]
    size = (ends - starts)[first]
    longest = np.argsort(-size, kind="stable")
    place = np.empty(first.size, np.int64)
    place[longest] = np.arange(first.size)
    return starts[first[longest]], size[longest], place[which]


def words_at(raw: np.ndarray, starts: np.ndarray, size: np.ndarray) -> Words:
    widest = int(size[0]) if size.size else 0
    letters = np.zeros((size.size, widest + 1), np.uint8)
    letters[:, 0] = 0x20
    padded = np.append(raw, np.zeros(widest, np.uint8))
    for k in range(widest):
        alive = int(np.searchsorted(-size, -k))
        letters[:alive, k + 1] = padded[starts[:alive] + k]
    return Words(letters, size + 1)


def forward(words: Words, trie: Trie, p: np.ndarray) -> list[np.ndarray]:
    """The probabilities of all prefixes of the words that are so long, by length, for each language."""
    alpha = [np.zeros((words.longer(k), p.shape[1])) for k in range(words.letters.shape[1] + 1)]
    alpha[0] += 1
    for at, length, word, piece in words.steps(trie):
        alpha[at + length][word] += alpha[at][word] * p[piece]
    return alpha


def whole(words: Words, alpha: list[np.ndarray]) -> np.ndarray:
    """The probabilities of the whole words."""
    return np.concatenate([alpha[k][words.longer(k + 1) :] for k in range(len(alpha) - 1, 0, -1)] or [np.zeros((0, 1))])


def expected(words: Words, weight: np.ndarray, trie: Trie, p: np.ndarray) -> np.ndarray:
    """Expected counts of the pieces in weighted words, for the model of one language (p has one column)."""
    alpha = forward(words, trie, p)
    share = weight / whole(words, alpha)[:, 0]
    beta = [np.zeros(a.shape[0]) for a in alpha]
    for k, b in enumerate(beta):
        b[words.longer(k + 1) :] = 1
    out = np.zeros(p.shape[0])
    for at, length, word, piece in sorted(words.steps(trie), key=lambda s: -s[0]):
        through = p[piece, 0] * beta[at + length][word]
        beta[at][word] += through
        out += np.bincount(piece, alpha[at][word, 0] * through * share[word], minlength=out.size)
    return out


def log_forward(words: Words, trie: Trie, log_p: np.ndarray) -> np.ndarray:
    """The logarithms of the probabilities of all prefixes: length, word, language."""
    alpha = np.full((words.letters.shape[1] + 1, words.size.size, log_p.shape[1]), -np.inf)
    alpha[0] = 0
    for at, length, word, piece in words.steps(trie):
        alpha[at + length, word] = np.logaddexp(alpha[at + length, word], alpha[at, word] + log_p[piece])
    return alpha


def log_expected(words: Words, weight: np.ndarray, trie: Trie, log_p: np.ndarray) -> np.ndarray:
    """As ``expected``, on logarithms."""
    alpha = log_forward(words, trie, log_p)[:, :, 0]
    each = np.arange(words.size.size)
    beta = np.full_like(alpha, -np.inf)
    beta[words.size, each] = 0
    share = alpha[words.size, each]
    out = np.zeros(log_p.shape[0])
    for at, length, word, piece in sorted(words.steps(trie), key=lambda s: -s[0]):
        through = log_p[piece, 0] + beta[at + length, word]
        beta[at, word] = np.logaddexp(beta[at, word], through)
        out += np.bincount(piece, np.exp(alpha[at, word] + through - share[word]) * weight[word], minlength=out.size)
    return out


def parts(size: np.ndarray) -> Iterator[tuple[slice, bool]]:
    """Stretches of words (sizes in descending order) that are handled together, and whether on logarithms."""
    long = int(np.searchsorted(-size, -LONG, side="right"))
    at = 0
    while at < long:
        to = min(long, at + max(1, LONG_BYTES // int(size[at] + 1)))
        yield slice(at, to), True
        at = to
    for at in range(long, size.size, SHORT_WORDS):
        yield slice(at, min(size.size, at + SHORT_WORDS)), False


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-case letters, and the words of each text."""
    raw, offsets = tx.utf8(pc.utf8_lower(column))
    starts, ends, bounds = tx.words(raw, offsets, LETTERS)
    return raw, starts, ends, bounds


@dataclass
class Model:
    """Piece probabilities of the languages. The trie is made from the vocabulary file in each worker, not sent."""

    languages: list[str]
    path: str
    p: np.ndarray

    @property
    def trie(self) -> Trie:
        return tx.kept(f"trie {self.path}", lambda: trie_of(self.path))

    def log_likelihood(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language, and the number of words of each text."""
        raw, starts, ends, bounds = text_words(column)
        out = np.zeros((len(column), len(self.languages)))
        if starts.size:
            first, size, place = distinct(raw, starts, ends)
            own = np.empty((size.size, out.shape[1]))
            for part, long in parts(size):
                words = words_at(raw, first[part], size[part])
                if long:
                    own[part] = log_forward(words, self.trie, np.log(self.p))[words.size, np.arange(words.size.size)]
                else:
                    own[part] = np.log(whole(words, forward(words, self.trie, self.p)))
            sums = np.concatenate([np.zeros((1, out.shape[1])), np.cumsum(own[place], axis=0)])
            out = sums[bounds[1:]] - sums[bounds[:-1]]
        return out, np.diff(bounds)


def fit(docs: DataFrame, path: str, text: str = "text", lang: str = "lang", ident: str = "doc_id", sample_texts: int = SAMPLE_TEXTS, rounds: int = ROUNDS) -> Model:
    """Models of all languages in a table of labelled texts; rows without text or language teach nothing.

    Only a bounded sample is read in full: about sample_texts rows of each language, by a hash of the id, so that
    copies of a text are not taken together. Its distinct words with their counts are settled once; each round is one pass over them.
    """
    spark = docs.sparkSession
    tx.short_batches(spark)
    rows = docs.select(F.xxhash64(ident).alias("place"), F.col(lang).cast("string").alias("lang"), F.col(text).cast("string").alias("text")).filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages, trie = sorted(sizes), Model([], path, np.zeros(0)).trie
    p = np.full((trie.pieces, len(languages)), 1 / trie.pieces)
    if not languages:
        return Model([], path, p)
    place = F.col("place").bitwiseAND((1 << 30) - 1)
    chosen = None
    for name in languages:
        share = min(1.0, sample_texts / sizes[name])
        own = (F.col("lang") == name) & (place < int(share * (1 << 30)))
        chosen = own if chosen is None else chosen | own
    sample = rows.filter(chosen).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.drop_large("trie ")
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                raw, starts, ends, bounds = text_words(batch.column("text"))
                names = np.repeat(np.array(batch.column("lang").to_pylist(), object), np.diff(bounds))
                for name in set(names):
                    own = names == name
                    first, size, at = distinct(raw, starts[own], ends[own])
                    texts = [raw[i : i + n].tobytes() for i, n in zip(first.tolist(), size.tolist(), strict=True)]
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(texts)), pa.array(texts, pa.binary()), pa.array(np.bincount(at, minlength=len(texts)))], ["lang", "word", "n"])

    found = sample.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    found = settle(found)
    for _ in range(rounds):
        shared = tx.Shared(spark, Model(languages, path, p))

        def gain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tx.drop_large("trie ")
            model = shared.value
            sums = np.zeros_like(model.p)
            for batch in batches:
                raw, offsets = tx.utf8(pa.array(batch.column("word").to_pylist(), pa.binary()))
                size = np.diff(offsets)
                weight = batch.column("n").to_numpy().astype(float)
                names = batch.column("lang").to_pylist()
                for k, name in enumerate(model.languages):
                    own = np.flatnonzero([n == name for n in names])
                    own = own[np.argsort(-size[own], kind="stable")]
                    for part, long in parts(size[own]):
                        words = words_at(raw, offsets[:-1][own[part]], size[own[part]])
                        if long:
                            sums[:, k] += log_expected(words, weight[own[part]], model.trie, np.log(model.p[:, k : k + 1]))
                        else:
                            sums[:, k] += expected(words, weight[own[part]], model.trie, model.p[:, k : k + 1])
            at, k = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(k), pa.array(sums[at, k])], ["piece", "k", "n"])

        # At most one sum for each piece and language.
        total = found.mapInArrow(gain, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toArrow()
        n = np.zeros_like(p)
        n[total.column("piece").to_numpy(), total.column("k").to_numpy()] = total.column("n").to_numpy()
        n += SMOOTHING
        p = n / n.sum(axis=0)
    return Model(languages, path, p)


def predict(docs: DataFrame, model: Model, text: str = "text", keep: tuple[str, ...] = ("doc_id",),
            made: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """For each row: the kept columns, lang_pred and score (or as made names them), the probability of that language for the whole text.

    Without a text, without a letter in it, or with no learned language the prediction is "und" and the score 0. Ties
    go to the first language in order. Runs of letters are words whatever their length. Equal texts get equal results, an empty table none; the other columns are left
    out, whatever their names.
    """
    rows, names = tx.carried(docs, keep, text)
    shared = tx.Shared(docs.sparkSession, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.drop_large("trie ")
        model = shared.value
        for whole in batches:
            for batch in tx.slices(whole, "text"):
                column = pc.fill_null(batch.column("text"), "")
                likely, n = model.log_likelihood(column)
                known = n > 0
                # Bytes beyond ASCII may be no letters at all.
                for k in np.flatnonzero(known):
                    t = column[k].as_py()
                    known[k] = any(c.isalpha() for c in t[:200]) or any(c.isalpha() for c in t)
                known &= bool(model.languages)
                best = likely.argmax(axis=1) if model.languages else np.zeros(len(column), int)
                top = likely.max(axis=1, keepdims=True) if model.languages else likely
                score = 1 / np.exp(likely - top).sum(axis=1) if model.languages else np.zeros(len(column))
                labels = [model.languages[b] if k else UNDETERMINED for b, k in zip(best, known, strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(labels, pa.string()), pa.array(np.where(known, score, 0.0))], [*names, "lang_pred", "score"])

    out = rows.mapInArrow(run, tx.schema_of(rows, names, "lang_pred string, score double"))
    return tx.restored(out, keep, names, *[F.col(c).alias(m) for c, m in zip(("lang_pred", "score"), made, strict=True)])

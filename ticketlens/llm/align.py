"""Alignment of two tokenizers' tokens over the same bytes.

Both sides tile the bytes of a text, so of each token start the other side has exactly one covering token: the last that
starts at it or before. ``merge_asof`` finds it for a batch of texts at once, keyed by document, in both directions; the
union of the two is the set of all pairs of tokens that share a byte. Overlapping tokens that end together are linked, and
cut both sequences into groups of equal bytes.

How often a pair of ids is linked is counted over the whole corpus. Two tokens that end together have the bytes of one as
an end of the other's, so the vocabularies alone say which pairs there can be: fewer than their tokens have bytes (about
half a million), whatever the corpus. Counts are arrays over these pairs, and only such an array is broadcast.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketlens.llm import textops as tx
from ticketlens.llm.bpe import byte_alphabet
from ticketlens.session import stage_table

# Bytes of text that are aligned at once; a longer text is aligned alone.
ALIGNED_BYTES = 1 << 20
BLANK = "▁"


class ByteLevel:
    """A byte-level BPE file of the tokenizers library; strings of special tokens in a text are plain text."""

    def __init__(self, path: str, pattern: str) -> None:
        import json

        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): n for token, n in data["model"]["vocab"].items() if token not in special}
        self.pieces = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for piece, n in ranks.items():
            self.pieces[n] = piece
        self.fast = tiktoken.Encoding("side", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.exact = Tokenizer.from_file(path)
        self.exact.encode_special_tokens = True
        self.exact.no_truncation()
        self.exact.no_padding()
        # The two libraries' classes of letters can differ beyond Latin letters.
        self.other = re.compile("[^\\x00-\\u02ff]")

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The tokens of texts that begin with a blank."""
        return [self.exact.encode(t, add_special_tokens=False).ids if self.other.search(t) else self.fast.encode_ordinary(t) for t in texts]


class Pieces:
    """A sentencepiece model, which puts a blank before a text by itself."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        told = [self.model.id_to_piece(n) for n in range(self.model.get_piece_size())]
        self.pieces = [bytes([int(p[3:5], 16)]) if self.model.is_byte(n) else p.replace(BLANK, " ").encode() for n, p in enumerate(told)]

    def encode(self, texts: list[str]) -> list[list[int]]:
        """The tokens of texts without the blank that they begin with."""
        return self.model.encode([t[1:] for t in texts], num_threads=1)


class Sides:
    """Both tokenizers in a worker."""

    def __init__(self, byte_level: str, pattern: str, pieces: str) -> None:
        self.a, self.b = ByteLevel(byte_level, pattern), Pieces(pieces)
        self.sizes = [np.array([len(p) for p in side.pieces], np.int64) for side in (self.a, self.b)]

    @cached_property
    def names(self) -> list[pa.Array]:
        return [pa.array([str(n) for n in range(len(side.pieces))]) for side in (self.a, self.b)]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Both sides' tokens of a blank and each text; none where a side's bytes are not the text's."""
        read = [" " + t for t in texts]
        out = []
        for t, a, b in zip(read, self.a.encode(read), self.b.encode(read), strict=True):
            raw = t.encode()
            same = all(b"".join(map(side.pieces.__getitem__, ids)) == raw for side, ids in ((self.a, a), (self.b, b)))
            out.append((a, b) if same else ([], []))
        return out


@dataclass
class Tokens:
    """The tokens of one side over several texts: text, id, and the bytes' range, counted through all texts."""

    text: np.ndarray
    ids: np.ndarray
    start: np.ndarray
    end: np.ndarray


def tokens(texts: list[str | None], sides: Sides) -> tuple[Tokens, Tokens]:
    """Both sides' tokens of all texts. Null and empty texts, and those whose bytes a side changes, have none."""
    own = list(dict.fromkeys(t for t in texts if t))
    encoded = dict(zip(own, sides.encode(own), strict=True))
    each = [encoded[t] if t else ([], []) for t in texts]
    out = []
    for k in (0, 1):
        text = np.repeat(np.arange(len(texts)), [len(e[k]) for e in each])
        ids = np.fromiter(chain.from_iterable(e[k] for e in each), np.int32, text.size)
        end = np.cumsum(sides.sizes[k][ids])
        out.append(Tokens(text, ids, end - sides.sizes[k][ids], end))
    return out[0], out[1]


def covering(of: Tokens, by: Tokens) -> np.ndarray:
    """For each token of one side, the other side's token that covers its start."""
    left = pd.DataFrame({"at": of.start, "text": of.text})
    right = pd.DataFrame({"at": by.start, "text": by.text, "other": np.arange(by.start.size)})
    return pd.merge_asof(left, right, on="at", by="text")["other"].to_numpy(np.int64, na_value=-1)


def overlaps(a: Tokens, b: Tokens) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of tokens that share a byte, as places in a and in b: what covers each start, from both sides. Pairs that
    start together come from both and are taken once."""
    if not a.ids.size:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    there, back = covering(a, b), covering(b, a)
    late = np.flatnonzero(a.start[back] != b.start)
    return np.concatenate([np.arange(there.size), back[late]]), np.concatenate([there, late])


def links(a: Tokens, b: Tokens, pairs: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The overlapping pairs that end together, in order."""
    same = a.end[pairs[0]] == b.end[pairs[1]]
    left, right = np.sort(pairs[0][same]), np.sort(pairs[1][same])
    return left, right


def linkable(sides: Sides) -> np.ndarray:
    """All pairs of ids that can end together, as a * (size of b) + b in order: one's bytes end the other's."""
    both = [defaultdict(list), defaultdict(list)]
    for known, side in zip(both, (sides.a, sides.b), strict=True):
        for n, piece in enumerate(side.pieces):
            if piece:
                known[piece].append(n)
    wide = len(sides.b.pieces)
    found = {a * wide + b for piece, own in both[0].items() for k in range(len(piece)) for b in both[1].get(piece[k:], ()) for a in own}
    found |= {a * wide + b for piece, own in both[1].items() for k in range(1, len(piece)) for a in both[0].get(piece[k:], ()) for b in own}
    return np.sort(np.fromiter(found, np.int64, len(found)))


def group_texts(a: Tokens, b: Tokens, link: tuple[np.ndarray, np.ndarray], texts: int, sides: Sides) -> list[str]:
    """For each text its groups as a1,a2|b1;a3|b2 with decimal ids."""
    joined = []
    for side, ends, names in zip((a, b), link, sides.names, strict=True):
        offsets = pa.array(np.concatenate([[0], ends + 1]), pa.int32())
        joined.append(pc.binary_join(pa.ListArray.from_arrays(offsets, names.take(pa.array(side.ids))), ","))
    groups = pc.binary_join_element_wise(joined[0], joined[1], "|")
    edges = np.searchsorted(a.text[link[0]], np.arange(texts + 1))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(edges, pa.int32()), groups), ";").to_pylist()


MADE = "n_a long, n_b long, n_groups long, groups_sha256 string, links binary"


def align(docs: DataFrame, byte_level: str, pattern: str, pieces: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_tokens: bool = False) -> DataFrame:
    """For each row: the kept columns, n_a, n_b (tokens of both sides), n_groups, n_links, n_best (links whose pair of ids is
    linked in the corpus as often as the b id's commonest, ties included), count_sum (how often the links' pairs are linked
    in the corpus) and groups_sha256 (of the groups, `a1,a2|b1;a3|b2`; '' without tokens).

    with_tokens adds a_ids, b_ids, overlaps (pairs of places in them that share a byte) and group_ends (pairs of places that
    end a group). byte_level is a tokenizers file of a byte-level BPE with its pattern (side a), pieces a sentencepiece
    model (side b); every executor has both. Side a reads a blank and the text, side b the text.

    Null and empty texts, and texts that a side's tokens do not give back, have no tokens, links or groups. Equal texts get
    equal rows and each counts in the corpus; an empty table gives none. Other columns are left out, whatever their names.
    """
    rows, names = tx.carried(docs, keep, text)
    spark = docs.sparkSession
    sides = Sides(byte_level, pattern, pieces)
    possible, width = linkable(sides), len(sides.b.pieces)
    shared = tx.Shared(spark, possible)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.drop_large("codec sides")
        sides = tx.kept(f"codec sides {byte_level} {pieces}", lambda: Sides(byte_level, pattern, pieces))
        possible = tx.kept("codec sides linkable", lambda: shared.value)
        for whole in batches:
            for batch in tx.slices(whole, "text", ALIGNED_BYTES):
                a, b = tokens(batch.column("text").to_pylist(), sides)
                shares = overlaps(a, b)
                link = links(a, b, shares)
                edges = [np.searchsorted(t, np.arange(batch.num_rows + 1)) for t in (a.text, b.text, a.text[link[0]])]
                told = group_texts(a, b, link, batch.num_rows, sides)
                codes = np.searchsorted(possible, a.ids[link[0]].astype(np.int64) * width + b.ids[link[1]]).astype(np.int32)
                columns = [pa.array(np.diff(e), pa.int64()) for e in edges]
                columns.append(pa.array([hashlib.sha256(g.encode()).hexdigest() if g else "" for g in told], pa.string()))
                columns.append(pa.array([np.sort(codes[i:j]).tobytes() for i, j in zip(edges[2][:-1], edges[2][1:], strict=True)], pa.binary()))
                if with_tokens:
                    columns += _told(a, b, shares, link, edges)
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], schema.names)

    schema = tx.schema_of(rows, names, MADE + ", a_ids array<int>, b_ids array<int>, overlaps array<struct<a:int,b:int>>, group_ends array<struct<a:int,b:int>>" * with_tokens)
    found = stage_table(rows.mapInArrow(run, schema))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shared.value.size, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                codes = np.frombuffer(b"".join(batch.column("links").slice(at, 256).to_pylist()), np.int32)
                total += np.bincount(codes, minlength=total.size)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["pair", "n"])

    linked = found.select("links").mapInArrow(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(possible.size, np.int64)
    counts[linked.column("pair").to_numpy()] = linked.column("n").to_numpy()
    highest = np.zeros(width, np.int64)
    np.maximum.at(highest, possible % width, counts)
    totals = tx.Shared(spark, (counts, counts == highest[possible % width]))
    rest = [c for c in schema.names if c != "links"]

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best = totals.value
        for batch in batches:
            made = []
            for packed in batch.column("links"):
                codes = np.frombuffer(packed.as_buffer(), np.int32)
                made.append((codes.size, int(np.count_nonzero(best[codes])), int(counts[codes].sum())))
            columns = [pa.array([m[k] for m in made], pa.int64()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in rest), *columns], [*rest, "n_links", "n_best", "count_sum"])

    out = found.mapInArrow(look_up, tx.schema_of(found, rest, "n_links long, n_best long, count_sum long"))
    extra = ("a_ids", "b_ids", "overlaps", "group_ends") if with_tokens else ()
    return tx.restored(out, keep, names, "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *extra)


def _told(a: Tokens, b: Tokens, shares: tuple[np.ndarray, np.ndarray], link: tuple[np.ndarray, np.ndarray], edges: list[np.ndarray]) -> list[pa.Array]:
    """The tokens of each text, and the places in it that overlap and that end groups."""
    def listed(values: pa.Array, at: np.ndarray) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(at, pa.int32()), values)

    def places(pairs: tuple[np.ndarray, np.ndarray]) -> pa.Array:
        order = np.lexsort(pairs[::-1])
        left, right = (p[order] for p in pairs)
        text = a.text[left]
        own = [pa.array(p - e[text], pa.int32()) for p, e in ((left, edges[0]), (right, edges[1]))]
        return listed(pa.StructArray.from_arrays(own, ["a", "b"]), np.searchsorted(text, np.arange(edges[0].size)))

    return [listed(pa.array(a.ids, pa.int32()), edges[0]), listed(pa.array(b.ids, pa.int32()), edges[1]), places(shares), places(link)]

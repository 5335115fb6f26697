"""BPE encoding with reuse of content-defined chunks, and decoding.

A rolling hash of the last 16 bytes cuts every text into chunks, so equal passages of different texts give equal
chunks wherever they stand. A task encodes each distinct chunk once and keeps its tokens. Where two chunks meet, the
end of the first and the start of the second may have been split otherwise in the whole text, so the stretch around
the join is encoded again. The stretch reaches from a place in the first chunk to one in the second at which the
whole text's tokens surely have a boundary: a blank after a visible ASCII character begins a new piece of the
pre-tokenizer whatever stands around it. If a chunk's own tokens have no boundary at such a place, or if there is
none, the stretch is extended until both agree.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import cached_property
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ticketlens.llm import textops as tx

# Bytes of a chunk on average, a power of two, and bytes of chunks that a task keeps the tokens of.
CHUNK_BYTES = 1024
KEPT_BYTES = 24 << 20
# Bytes of texts whose tokens are held at once: as Python numbers they take some twenty times as much.
TOKENS_BYTES = 1 << 18
MADE = ("n_tokens", "ids_sha256", "decoded_sha256", "ids")


def byte_alphabet() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: visible Latin-1 ones stand for
    themselves, the rest in order for characters from 256 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + k): b for k, b in enumerate(rest)}


class Codec:
    """Encodes as the tokenizers library does with the file, and decodes."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        self.path = path
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        special = {x["content"]: x["id"] for x in data["added_tokens"]}
        alphabet = byte_alphabet()
        ranks = {bytes(alphabet[c] for c in token): n for token, n in data["model"]["vocab"].items() if token not in special}
        self.fast = tiktoken.Encoding("chunks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pieces = [b""] * (1 + max([*ranks.values(), *special.values()]))
        for token, n in [*ranks.items(), *((s.encode(), n) for s, n in special.items())]:
            self.pieces[n] = token
        self.sizes = np.array([len(p) for p in self.pieces])
        self.names = [str(n) for n in range(len(self.pieces))]
        self.special = special
        # Characters beyond Latin letters, and special tokens, go through the library itself.
        self.other = re.compile("|".join(["[^\\x00-\\u02ff]", *map(re.escape, special)]))
        self.chunks: dict[bytes, tuple[int, int, np.ndarray]] = {}
        self.held = 0

    @cached_property
    def exact(self) -> Any:
        """The library's tokenizer, which few texts need."""
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(self.path)
        made.no_truncation()
        made.no_padding()
        return made

    def encode(self, text: str) -> list[int]:
        """The tokens of a text as a whole."""
        if self.other.search(text):
            return self.exact.encode(text, add_special_tokens=False).ids
        return self.fast.encode_ordinary(text)

    def chunk(self, raw: bytes, safe: np.ndarray) -> tuple[int, int, np.ndarray]:
        """Where the chunk's sure part begins and ends, and the tokens of that part. safe: its sure boundaries."""
        known = self.chunks.get(raw)
        if known is None:
            known = (len(raw), len(raw), np.zeros(0, np.uint32))
            if safe.size > 1:
                ids = np.array(self.encode(raw.decode()), np.uint32)
                edges = np.concatenate([[0], np.cumsum(self.sizes[ids])])
                agreed = safe[edges[np.searchsorted(edges, safe)] == safe]
                if agreed.size > 1:
                    first, last = int(agreed[0]), int(agreed[-1])
                    known = (first, last, ids[np.searchsorted(edges, first) : np.searchsorted(edges, last)])
            cost = len(raw) + known[2].nbytes
            while self.chunks and self.held + cost > KEPT_BYTES:
                oldest = next(iter(self.chunks))
                self.held -= len(oldest) + self.chunks.pop(oldest)[2].nbytes
            self.chunks[raw] = known
            self.held += cost
        return known

    def encode_chunks(self, text: bytes, cuts: list[int], safe: np.ndarray) -> list[int]:
        """The tokens of a text from those of its chunks; cuts: their ends, safe: the sure boundaries of the text."""
        if len(cuts) < 2:
            return self.encode(text.decode())
        out: list[int] = []
        open_from = at = 0
        for to in cuts:
            first, last, ids = self.chunk(text[at:to], safe[np.searchsorted(safe, at, "right") : np.searchsorted(safe, to)] - at)
            if ids.size:
                out += self.encode(text[open_from : at + first].decode())
                out += ids.tolist()
                open_from = at + last
            at = to
        return out + self.encode(text[open_from:].decode())

    def decode(self, ids: list[int]) -> str:
        """The text of the tokens, special ones included; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.pieces.__getitem__, ids)).decode("utf-8", "replace")


def _gears() -> np.ndarray:
    return tx.mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def chunk_ends(raw: np.ndarray, chunk_bytes: int = CHUNK_BYTES) -> np.ndarray:
    """Places where the rolling hash of the 16 bytes before says to cut, at whole characters."""
    h = _gears()[raw]
    for step in (1, 2, 4, 8):
        if h.size > step:
            h[step:] = h[step:] + (h[:-step] << np.uint32(step))
    cut = np.flatnonzero((h >> np.uint32(12)) % np.uint32(chunk_bytes) == 0) + 1
    cut = cut[cut < raw.size]
    return cut[(raw[cut] & 0xC0) != 0x80]


def sure_boundaries(raw: np.ndarray) -> np.ndarray:
    """Blanks after a visible ASCII character."""
    return np.flatnonzero((raw[1:] == 0x20) & (raw[:-1] > 0x20) & (raw[:-1] < 0x7F)) + 1


def _codec(path: str, pattern: str) -> Codec:
    return tx.kept(f"codec {path}", lambda: Codec(path, pattern))


def encoded(batch: pa.RecordBatch, codec: Codec) -> Iterator[list[int]]:
    """The tokens of each text of the column text."""
    raw, offsets = tx.utf8(batch.column("text"))
    cuts, safe = chunk_ends(raw), sure_boundaries(raw)
    for k in range(batch.num_rows):
        a, b = offsets[k], offsets[k + 1]
        own = cuts[np.searchsorted(cuts, a, "right") : np.searchsorted(cuts, b)] - a
        yield codec.encode_chunks(raw[a:b].tobytes(), [*own.tolist(), int(b - a)], safe[np.searchsorted(safe, a, "right") : np.searchsorted(safe, b)] - a)


def digests(docs: DataFrame, path: str, pattern: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",), with_ids: bool = False) -> DataFrame:
    """For each row: the kept columns, n_tokens, ids_sha256 (of the ids, joined by commas) and decoded_sha256 (of the
    text decoded from them); with_ids adds the ids.

    A null text is empty and has no tokens. Equal rows get equal results, an empty table none. Special tokens in a
    text are found as the library finds them. The other columns are left out, whatever their names. path is a
    tokenizers file of a byte-level BPE that every executor has, pattern the pre-tokenizer's.
    """
    rows, names = tx.carried(docs, keep, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tx.drop_large(f"codec {path}")
        codec = _codec(path, pattern)
        for whole in batches:
            for batch in tx.slices(whole, "text", TOKENS_BYTES):
                made: list[tuple[Any, ...]] = []
                for ids in encoded(batch, codec):
                    joined = ",".join(map(codec.names.__getitem__, ids)).encode()
                    decoded = codec.decode(ids).encode()
                    made.append((len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest(), ids if with_ids else None))
                kinds = [pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())][: 3 + with_ids]
                columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *columns], [*names, *MADE[: 3 + with_ids]])

    made = "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    out = rows.mapInArrow(run, tx.schema_of(rows, names, made))
    return tx.restored(out, keep, names, *MADE[: 3 + with_ids])

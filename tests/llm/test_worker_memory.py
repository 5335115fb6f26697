"""What a Python worker holds at once: words, tokens and the trie of the language models."""

import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa

from ticketlens.llm import bpe, langid
from ticketlens.llm import textops as tx

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def test_nodes_without_a_next_one_take_no_memory():
    """They are last in the trie, so that their part of the table is never written."""
    trie = langid.trie_of(VOCABULARY)
    inner = trie.follow.reshape(-1, trie.width).any(axis=1)
    inner[:2] = True
    assert not inner[inner.sum() :].any() and not inner.all()
    assert sorted(trie.piece[trie.piece >= 0].tolist()) == list(range(trie.pieces))


def test_short_words_are_handled_in_bounded_parts(monkeypatch):
    monkeypatch.setattr(langid, "SHORT_WORDS", 100, raising=False)
    size = np.sort(np.random.default_rng(1).integers(1, 60, 2000))[::-1]
    found = list(langid.parts(size))
    assert np.concatenate([np.arange(size.size)[p] for p, _ in found]).tolist() == list(range(size.size))
    assert max(p.stop - p.start for p, long in found if not long) <= 100


def test_parts_do_not_change_likelihoods(monkeypatch):
    texts = pa.array(["the cat sat on the mat", "über straße " + "z" * 50, "", "été à la plage, mañana 中文"])
    p = np.random.default_rng(2).random((langid.trie_of(VOCABULARY).pieces, 3)) / 1000
    model = langid.Model(["a", "b", "c"], VOCABULARY, p)
    whole, n = model.log_likelihood(texts)
    monkeypatch.setattr(langid, "SHORT_WORDS", 2, raising=False)
    parted, m = model.log_likelihood(texts)
    np.testing.assert_allclose(whole, parted, rtol=1e-12)
    assert n.tolist() == m.tolist()


def test_memory_of_a_batch_of_texts():
    """Words that all differ: the arrays of a batch of several slices stay under a bound."""
    letters = np.random.default_rng(3).integers(97, 123, (400_000, 8)).astype(np.uint8)
    words = [bytes(w).decode() for w in letters]
    batch = pa.record_batch({"text": pa.array([" ".join(words[k : k + 1000]) for k in range(0, len(words), 1000)])})
    model = langid.Model(["a", "b", "c", "d"], VOCABULARY, np.full((langid.trie_of(VOCABULARY).pieces, 4), 1e-3))
    assert model.trie is not None
    tracemalloc.start()
    try:
        for part in tx.slices(batch, "text"):
            model.log_likelihood(part.column("text"))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 40e6


def test_tokens_are_held_of_few_texts_at_once(spark, monkeypatch):
    sizes = []
    slices = tx.slices
    monkeypatch.setattr(tx, "slices", lambda *a: sizes.append(a[2] if len(a) > 2 and a[2] else tx.SLICE_BYTES) or slices(*a))
    rows = spark.createDataFrame([(1, "a text")], "doc_id long, text string")
    taken = {}
    monkeypatch.setattr(type(rows), "mapInArrow", lambda self, run, schema: taken.setdefault("run", run) and self)
    monkeypatch.setattr(tx, "restored", lambda out, *a: out)
    bpe.digests(rows, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    assert sum(b.num_rows for b in taken["run"](iter([pa.record_batch({"k0": pa.array([1, 2]), "text": pa.array(["a text", "another"])})]))) == 2
    assert sizes == [bpe.TOKENS_BYTES] and bpe.TOKENS_BYTES < tx.SLICE_BYTES

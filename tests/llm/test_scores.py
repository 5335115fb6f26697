"""Quality, toxicity and language: held-out accuracy, exact parts against brute force, odd rows."""

import random

import numpy as np
import pyarrow as pa
import pytest
import public_tokenizers
from pyspark.sql import functions as F

from ticketlens.llm import langid, quality, toxicity
from ticketlens.llm import textops as tx
from ticketlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
LARGER = "/root/testdata/sf0.01"
VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " ", "...", "12 34", "x" * 300_000, "word " * 40_000]


def odd_rows(spark, texts=ODD):
    return spark.createDataFrame([(k, t, "a", 0.5) for k, t in enumerate(texts)], "doc_id long, text string, lang_pred string, score double")


def held_out(spark, name, label):
    truth = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    rows = QUERIES[name](spark, LARGER).collect()
    assert len(rows) == spark.read.parquet(f"{LARGER}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 for r in rows)
    return [(truth[r["doc_id"]], r) for r in rows if r["held_out"] and r["doc_id"] in truth]


def test_quality_of_held_out_documents(spark):
    pairs = held_out(spark, "op1_quality", "quality")
    assert np.mean([y == r["predicted"] for y, r in pairs]) >= 0.97
    assert all(r["predicted"] == (r["score"] >= 0.3) for _, r in pairs)


def test_toxicity_of_held_out_documents(spark):
    pairs = held_out(spark, "op2_toxicity", "toxic")
    assert np.mean([y == r["predicted"] for y, r in pairs]) >= 0.95
    assert any(r["evidence"] for _, r in pairs)


def test_language_of_held_out_documents(spark):
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{LARGER}/documents.parquet").collect()}
    rows = QUERIES["op8_langid"](spark, LARGER).collect()
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in rows if r["held_out"]]) >= 0.98


def test_features_are_distinct_and_by_text():
    texts = ["One two TWO two!!", None, "", "One two", "a a a a"]
    found, begin = quality.features(pa.array(texts))
    own = [set(found[begin[k] : begin[k + 1]].tolist()) for k in range(5)]
    assert [len(x) for x in own] == np.diff(begin).tolist() and not own[1] and not own[2]
    alone, _ = quality.features(pa.array(["One two"]))
    assert set(alone.tolist()) == own[3]
    assert len(own[4]) < len(own[0])


def test_descent_solves_the_dual():
    """The hinge-loss problem: the weights come from the dual, and margins of free rows are one."""
    r = np.random.default_rng(4)
    x = r.normal(size=(60, 5))
    y = np.sign(x[:, 0] + 0.3 * r.normal(size=60))
    w = quality.descend([(np.arange(5), v) for v in x], y, 5, np.full(60, 1.0), rounds=3000)

    def loss(w):
        return 0.5 * w @ w + np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])).sum()

    for _ in range(50):
        assert loss(w) <= loss(w + r.normal(size=6) * 0.02) + 1e-3


def test_scores_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    for module, label in ((quality, "quality"), (toxicity, "toxic")):
        extra = labels.unionByName(labels.limit(3)).unionByName(labels.limit(1).select(F.lit(None).cast("long").alias("doc_id"), "quality", "toxic"))
        for told in (extra, extra.limit(0), extra.filter(f"{label} = 1")):
            model = module.fit(docs, told, label=label)
            got = module.score(odd_rows(spark), model, keep=("doc_id", "text")).collect()
            assert len(got) == len(ODD) and all(0 <= r["score"] <= 1 for r in got)
            assert module.score(odd_rows(spark, []), model).count() == 0
        assert module.score(odd_rows(spark), module.fit(docs.limit(0), labels, label=label)).count() == len(ODD)


@pytest.mark.parametrize("block", [1, 3, 64])
def test_nearest_examples_are_exact(block):
    r = np.random.default_rng(block)
    vectors = []
    for _ in range(150):
        term = np.sort(r.choice(20, r.integers(1, 5), replace=False))
        w = r.integers(1, 4, term.size).astype(float)
        vectors.append((term, w / np.sqrt(w @ w)))
    index = toxicity.BlockMaxIndex(vectors, 20, block)
    dense = np.zeros((150, 20))
    for k, (t, w) in enumerate(vectors):
        dense[k, t] = w
    for t, w in vectors[:60]:
        q = np.zeros(20)
        q[t] = w
        score = np.round(dense @ q, 12)
        want = [k for k in np.lexsort((np.arange(150), -score))[:7].tolist() if score[k] > 0]
        names, near = index.nearest(t, w, 7)
        assert names.tolist() == want and np.allclose(near, score[want])
    assert index.nearest(np.array([], int), np.array([]), 7)[0].size == 0


def test_postings_beyond_the_bounds_are_not_read():
    """Examples of several topics with one common term: only blocks of the text's topic are read."""
    vectors = []
    for k in range(640):
        w = np.array([0.2, 1.0, 0.5 + k % 3 / 10])
        vectors.append((np.array([0, 1 + k // 64, 20 + k // 64]), w / np.sqrt(w @ w)))
    index = toxicity.BlockMaxIndex(vectors, 40, 64)
    names, _ = index.nearest(*vectors[130], 5)
    assert set(names.tolist()) <= set(range(128, 192))
    every = sum(int(index.begin[t + 1] - index.begin[t]) for t in vectors[130][0])
    assert every == 640 + 64 + 64 and index.read < every
    apart = toxicity.BlockMaxIndex(vectors, 40, 8)
    apart.nearest(*vectors[130], 5)
    assert apart.read <= every / 4


def test_uses_count_occurrences():
    texts = pa.array(["bad bad badly", None, "bad", "other bad"])
    text, base, term, head = toxicity.uses(texts)
    wanted = np.unique(base[text == 2])
    some = toxicity.uses(texts, wanted, np.unique(head[text == 2]))
    assert all(np.array_equal(a, b[np.isin(base, wanted)]) for a, b in zip(some, (text, base, term, head), strict=True))
    text, base, term, _ = toxicity.uses(pa.array(["bad bad badly", None, "bad"]))
    assert set(text.tolist()) == {0, 2} and np.unique(term[text == 0]).size == (text == 0).sum()
    assert np.unique(base).size < np.unique(term).size


def brute_forward(word: bytes, pieces: dict[bytes, float]) -> float:
    alpha = [1.0] + [0.0] * len(word)
    for k in range(1, len(word) + 1):
        alpha[k] = sum(alpha[j] * pieces.get(word[j:k], 0.0) for j in range(k))
    return alpha[-1]


def numbered_pieces(trie):
    """The pieces by number, read from the trie."""
    byte = {c: b for b, c in enumerate(trie.classes.tolist()) if c}
    out, stack = {}, [(1, b"")]
    while stack:
        node, token = stack.pop()
        if trie.piece[node] >= 0:
            out[token] = int(trie.piece[node])
        for c in range(1, trie.width):
            if child := int(trie.follow[node * trie.width + c]):
                stack.append((child, token + bytes([byte[c]])))
    return out


def test_forward_sums_all_segmentations():
    trie = langid.trie_of(VOCABULARY)
    pieces = numbered_pieces(trie)
    assert len(pieces) == trie.pieces
    r = np.random.default_rng(2)
    p = r.random((trie.pieces, 2))
    p /= p.sum(axis=0)
    raw, starts, ends, _ = langid.text_words(pa.array(["The straße was überall the été, a 中文 thing" + "y" * 40]))
    words, place = langid.distinct_words(raw, starts, ends)
    got = langid.whole(words, langid.forward(words, trie, p))
    assert np.all(np.diff(words.size) <= 0) and place.size == starts.size
    for k in range(words.size.size):
        word = bytes(words.letters[k, : words.size[k]])
        for lang in (0, 1):
            assert got[k, lang] == pytest.approx(brute_forward(word, {t: p[n, lang] for t, n in pieces.items()}), rel=1e-9)
    for k in range(starts.size):
        assert bytes(words.letters[place[k], 1 : words.size[place[k]]]) == raw[starts[k] : ends[k]].tobytes()


def test_long_runs_of_letters():
    """Runs of 31 to 5,000 bytes: sums on logarithms against the plain ones and against one word at a time."""
    trie = langid.trie_of(VOCABULARY)
    r = np.random.default_rng(4)
    p = r.random((trie.pieces, 2)) + 0.01
    p /= p.sum(axis=0)
    runs = ["".join(r.choice(list("etaoinshrdé中文"), n)) for n in (31, 32, 33, 60, 120, 500, 2000, 5000)]
    raw, starts, ends, _ = langid.text_words(pa.array([" ".join(runs)]))
    assert starts.size == len(runs)
    first, size, place = langid.distinct(raw, starts, ends)
    own, log_p = np.empty((size.size, 2)), np.log(p)
    for part, long in langid.parts(size):
        words = langid.words_at(raw, first[part], size[part])
        assert long == bool((size[part] >= langid.LONG).all())
        own[part] = langid.log_forward(words, trie, log_p)[words.size, np.arange(words.size.size)] if long else np.log(langid.whole(words, langid.forward(words, trie, p)))
    pieces = numbered_pieces(trie)
    for k, run in enumerate(runs):
        for lang in (0, 1):
            want = scaled_forward(b" " + run.encode(), {t: p[n, lang] for t, n in pieces.items()})
            assert own[place[k], lang] == pytest.approx(want, rel=1e-9)
    short = langid.words_at(raw, first[size < 50], size[size < 50])
    weight = np.full(short.size.size, 2.0)
    plain, logs = langid.expected(short, weight, trie, p[:, :1]), langid.log_expected(short, weight, trie, log_p[:, :1])
    assert np.allclose(plain, logs, rtol=1e-9)


def scaled_forward(word: bytes, p: dict[bytes, float]) -> float:
    """The logarithm of the sum over all segmentations, scaled at each byte."""
    longest = max(map(len, p))
    alpha, scale = [1.0], 0.0
    for end in range(1, len(word) + 1):
        alpha.append(sum(alpha[-k] * p.get(word[end - k : end], 0.0) for k in range(1, min(longest, len(alpha)) + 1)))
        alpha = alpha[-longest:]
        top = alpha[-1]
        scale += np.log(top)
        alpha = [x / top for x in alpha]
    return scale


def test_language_of_text_without_blanks(spark):
    """A language of long runs is learned and told from another; the score is a share of whole sums."""
    r = random.Random(8)
    rows = [(k, "".join(r.choice("的一是不了人我在有他" if k % 2 else "اوهينملربت") for _ in range(r.choice([12, 80, 400]))), "zh" if k % 2 else "ar") for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs.filter("doc_id < 40"), VOCABULARY)
    got = {x["doc_id"]: x for x in langid.predict(docs, model).collect()}
    assert all(got[k]["lang_pred"] == lang and 0.99 < got[k]["score"] <= 1 for k, _, lang in rows)


def test_expected_counts_cover_the_words():
    """The expected counts, weighted by the lengths of the pieces, make up all bytes of the words."""
    trie = langid.trie_of(VOCABULARY)
    size = np.zeros(trie.pieces)
    for token, n in numbered_pieces(trie).items():
        size[n] = len(token)
    p = np.full((trie.pieces, 1), 1 / trie.pieces)
    raw, starts, ends, _ = langid.text_words(pa.array(["the there other é thing"]))
    words, _ = langid.distinct_words(raw, starts, ends)
    counts = langid.expected(words, np.full(words.size.size, 2.0), trie, p)
    assert counts @ size == pytest.approx(2 * words.size.sum())


def test_language_of_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = langid.fit(docs.withColumn("lang", F.when(F.col("doc_id") % 5 != 0, F.col("lang"))), VOCABULARY, sample_texts=20, rounds=2)
    texts = [*ODD, "…—", "中文", "²"]
    rows = {r["doc_id"]: r for r in langid.predict(odd_rows(spark, texts), model, keep=("doc_id", "text"), made=("_l", "_s")).collect()}
    for k in (0, 1, 2, 3, 4, 7):
        assert (rows[k]["_l"], rows[k]["_s"]) == ("und", 0.0)
    assert rows[5]["_l"] in model.languages and rows[8]["_l"] in model.languages
    assert langid.predict(odd_rows(spark, []), model).count() == 0
    nothing = langid.fit(docs.limit(0), VOCABULARY)
    assert {r["lang_pred"] for r in langid.predict(odd_rows(spark), nothing).collect()} == {"und"}


def test_slices_keep_all_rows():
    r = random.Random(1)
    texts = [None if r.random() < 0.1 else "x" * r.randrange(50) for _ in range(200)]
    batch = pa.record_batch({"text": pa.array(texts)})
    for limit in (1, 30, 10_000):
        assert [t for s in tx.slices(batch, "text", limit) for t in s.column("text").to_pylist()] == texts

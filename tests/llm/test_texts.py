"""Substring dedup, n-gram join and decontamination against brute force."""

import random

import numpy as np
import pytest

from tests.llm import brute
from ticketlens.llm import decontaminate, exchange, graph, jaccard, substring
from ticketlens.llm import textops as tx
from ticketlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, n_words string, kept string, a string, spans string"


def frame(spark, texts, ids=None):
    """Documents with extra columns whose names clash with results and inner columns."""
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "x", "y", "z", "w") for i, t in zip(ids, texts, strict=True)], DOCS)


def passages(seed: int, count: int = 40) -> list[str]:
    """Texts of few words, with shared passages, near copies, blanks of all kinds and short ones."""
    r = random.Random(seed)
    words = [f"w{k}é" if k % 5 == 0 else f"W{k}" for k in range(400)]
    shared = [[r.choice(words) for _ in range(60)] for _ in range(3)]
    texts = []
    for k in range(count):
        w = [r.choice(words) for _ in range(r.choice([0, 1, 2, 34, 35, 36, 90, 200]))]
        if k % 3 == 0:
            at = r.randrange(len(w) + 1)
            w[at:at] = shared[k % 2][r.randrange(20) :]
        if k % 7 == 0:
            w += shared[2] + ["."] + shared[2]
        texts.append("".join(x + r.choice([" ", "  ", "\n", "\t\r\n"]) for x in w))
    near = [t.replace("W1 ", "Q ", 1) for t in texts[:12]]
    return [*texts, *texts[:4], *near, "the long " * 30_000, "ab" * 50_000]


def test_words_and_hashes():
    import pyarrow as pa

    raw, offsets = tx.utf8(pa.array(["a bc", None, "", " de\n", "fghijklmnopq é"]))
    starts, ends, bounds = tx.words(raw, offsets)
    assert [raw[a:b].tobytes().decode() for a, b in zip(starts, ends, strict=True)] == ["a", "bc", "de", "fghijklmnopq", "é"]
    assert bounds.tolist() == [0, 2, 2, 2, 3, 5]
    h = np.arange(1, 50, dtype=np.uint64)
    for size in (1, 2, 3, 15, 35):
        own = tx.window_hashes(h, size)
        assert own.size == 50 - size and own[3] == tx.window_hashes(h[3 : 3 + size], size)[0]
    assert tx.window_hashes(h[:4], 5).size == 0


def test_cover_meets_every_distance():
    gaps = {(a - b) % substring.PERIOD for a in substring.COVER for b in substring.COVER}
    assert gaps == set(range(substring.PERIOD))


@pytest.mark.parametrize("seed", [1, 2])
def test_substrings(spark, seed):
    texts = [*passages(seed), None, "", "   "]
    rows = substring.scan(frame(spark, texts), keep=("doc_id", "text")).collect()
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in rows}
    assert [got[k] for k in range(len(texts))] == brute.removed(texts)
    for r in rows:
        assert sum(s["stop"] - s["start"] for s in r["spans"]) == r["n_removed"]


def test_substrings_in_small_slices(spark, monkeypatch):
    """Slices of one text each: nothing repeats within one."""
    monkeypatch.setattr(tx, "SLICE_BYTES", 1)
    monkeypatch.setattr(exchange, "BUCKET_TEXT", 5_000)
    texts = passages(3, 25)[:-2]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept"]) for r in substring.scan(frame(spark, texts)).collect()}
    assert [got[k] for k in range(len(texts))] == brute.removed(texts)


def test_substrings_of_repeated_and_null_ids(spark):
    long = " ".join(f"v{k}" for k in range(40))
    rows = substring.scan(frame(spark, [long, long, long + " end", "other " * 3], [None, None, 7, 7])).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"]) for r in rows) == [("7", 3, 0), ("7", 41, 40), ("None", 40, 40), ("None", 40, 40)]
    assert substring.scan(frame(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_links(spark, seed):
    r = random.Random(seed)
    texts = passages(seed, 30)[:-2]
    base = " ".join(f"u{k}" for k in range(150)).split()
    for k in range(25):  # a chain and a crowd of near copies
        base = [*base]
        base[r.randrange(150)] = f"n{k}"
        texts.append(" ".join(base))
    texts += ["One two", "one  TWO", "one", "ONE", "two one"]
    rows = [(100 - k, t) for k, t in enumerate(texts)]
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard.link(frame(spark, texts, [i for i, _ in rows])).collect()}
    assert got == brute.linked(rows)


def test_links_of_odd_rows(spark):
    texts = [None, "", " ", "a b c", "A  b\tc", "a b c", "x"]
    got = jaccard.link(frame(spark, texts, [1, 2, 3, 5, 4, None, 6])).collect()
    assert sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"]) for r in got) == [
        ("1", 0, 1), ("2", 0, 2), ("3", 0, 3), ("4", 1, 4), ("5", 1, 4), ("6", 1, 6), ("None", 1, None)]
    assert jaccard.link(frame(spark, [])).count() == 0


def test_bands_and_signatures():
    """Sets within the similarity share a signature in the band of the larger one."""
    r = np.random.default_rng(5)
    for size in [*range(1, 60), 200, 1000]:
        x = np.sort(r.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
        for _ in range(4):
            drop = int(r.integers(0, size // 10 + 1))
            y = x[np.sort(r.permutation(size)[drop:])]
            common = y.size
            if 100 * common < 90 * size or not common:
                continue
            found = []
            for s in (x, y):
                sums = jaccard._fingerprint(s)[2]
                band = jaccard.band_of(s.size)
                found.append({(b, v) for b in (band, band + 1) for v in jaccard.signatures(s, sums, b).tolist()})
            assert found[0] & found[1], (size, drop)
            apart = np.bitwise_count(jaccard._sketch(x).view(np.uint64) ^ jaccard._sketch(y).view(np.uint64)).sum()
            assert apart <= size - common


def test_components(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, 99), (100, 98), (7, 7), (50, 50), (None, 3)]
    got = {r["x"]: r["y"] for r in graph.components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert {got[k] for k in range(1, 41)} == {1} and got[100] == got[99] == 98 and got[50] == 50


def test_fm_index():
    r = np.random.default_rng(0)
    seq = r.integers(1, 4, 500)
    seq[::17] = 0
    index = decontaminate.FmIndex(seq, 4)
    for size in (1, 3, 6):
        patterns = np.array([seq[k : k + size] for k in range(0, 480, 5) if seq[k : k + size].all()], np.int32)
        low, high = index.search(patterns)
        for p, a, b in zip(patterns, low, high, strict=True):
            places = sorted(index.locate(np.arange(a, b)).tolist())
            assert places == [k for k in range(500 - size + 1) if (seq[k : k + size] == p).all()]


ITEMS = [(1, "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu"), (2, "short item"), (3, None), (4, "..."), ("x", "one"),
         (10, "alpha beta gamma delta epsilon zeta eta theta iota kappa"), (None, "never told")]
TEXTS = ["say ALPHA beta gamma-delta epsilon zeta eta theta iota kappa lambda! mu", "one short item", "short\x00item éone", None, "", "...",
         "nothing here", "never told", "alpha beta gamma delta epsilon zeta eta theta iota", "beta gamma delta epsilon zeta eta theta iota kappa lambda " * 500]


@pytest.mark.parametrize("block", [decontaminate.BLOCK_BYTES, 60])
@pytest.mark.parametrize("shard", [decontaminate.SHARD_WORDS, 5])
def test_decontamination(spark, block, shard, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_WORDS", shard)
    items = spark.createDataFrame([(None if i is None else str(i), t) for i, t in ITEMS], "item_id string, text string")
    found = decontaminate.scan(frame(spark, TEXTS), items, keep=("doc_id", "text"), block_bytes=block)
    got = {r["doc_id"]: r for r in found.withColumn("hit", decontaminate.n_hit()).collect()}
    for k, (_, hit, own) in enumerate(brute.leaks(TEXTS, ITEMS)):
        assert (got[k]["hit"], got[k]["items"]) == (hit, own), TEXTS[k]


def test_cut_spans(spark):
    items = spark.createDataFrame([(2, "short item"), (5, "one")], "item_id long, text string")
    found = decontaminate.scan(frame(spark, ["A short, item! éone One.", None, "none"]), items, keep=("doc_id", "text"))
    got = {r["doc_id"]: r["text"] for r in decontaminate.without_spans(found).collect()}
    assert got == {0: "A ! éone .", 1: None, 2: "none"}
    empty = items.limit(0)
    assert decontaminate.scan(frame(spark, ["a b"]), empty).first()["spans"] == []
    assert decontaminate.scan(frame(spark, []), items).count() == 0


@pytest.mark.parametrize("name", ["op3_substring_dedup", "op6_jaccard_join", "op9_decontaminate"])
def test_queries(spark, name):
    docs = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").collect()
    got = {r["doc_id"]: r for r in QUERIES[name](spark, SF).collect()}
    assert len(got) == len(docs)
    texts = [d["text"] for d in docs]
    if name.startswith("op3"):
        for d, (n, gone, kept) in zip(docs, brute.removed(texts), strict=True):
            r = got[d["doc_id"]]
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == (n, gone, brute.sha(kept))
    elif name.startswith("op6"):
        for i, own in brute.linked([(d["doc_id"], d["text"]) for d in docs]).items():
            assert (got[i]["n_shingles"], got[i]["component_id"]) == own
    else:
        items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
        for d, (n, hit, own) in zip(docs, brute.leaks(texts, items), strict=True):
            r = got[d["doc_id"]]
            assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == (n, hit, len(own), brute.sha(",".join(own)), hit > 0)

"""The pipeline's near-duplicate stage: five words, similarity 0.80."""

import random
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm import brute
from ticketlens.llm import jaccard

DOCS = "doc_id long, text string"


def least(rows, size, similarity):
    """The smallest id that each id is linked to."""
    sets = {i: brute.shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}
    for i, j in combinations(sorted(sets), 2):
        x, y = sets[i], sets[j]
        if x and y and 100 * len(x & y) >= similarity * len(x | y):
            a, b = sorted((root[i], root[j]))
            root = {k: a if v == b else v for k, v in root.items()}
    return root


def test_stage_links_five_words_at_eighty(spark):
    r = random.Random(3)
    rows = [(1, " ".join(f"a{k}" for k in range(100)))]
    rows.append((2, rows[0][1].replace("a30 ", "x ").replace("a70 ", "y ")))
    for k in range(60):
        words = [f"w{r.randrange(3000)}" for _ in range(r.choice([1, 4, 6, 12, 40, 150, 400]))]
        other = [f"v{r.randrange(3000)}" if r.random() < r.choice([0.005, 0.02, 0.03]) else w for w in words]
        rows += [(10 + 2 * k, " ".join(words)), (11 + 2 * k, " ".join(other))]
    docs = spark.createDataFrame(rows, DOCS)
    want = sorted(i for i, c in least(rows, 5, 80).items() if i == c)
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == want
    assert 1 in want and 2 not in want and 2 in [i for i, c in least(rows, 3, 90).items() if i == c]


def test_stage_on_the_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = [i for i, c in least([(x["doc_id"], x["text"]) for x in docs.collect()], 5, 80).items() if i == c]
    assert sorted(x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == sorted(want)


def test_signatures_at_eighty():
    """Sets within the similarity share a signature although each leaves out its thin ones."""
    r = np.random.default_rng(6)
    for size in [*range(1, 80), 200, 1000]:
        for _ in range(4):
            x = np.sort(r.integers(0, 2**63, size, dtype=np.uint64) * np.uint64(2))
            y = np.delete(x, r.choice(size, int(r.integers(0, size // 5 + 1)), replace=False))
            for _ in range(int(r.integers(0, size // 5 + 1))):
                more = np.unique(np.append(y, r.integers(0, 2**63, 1, dtype=np.uint64) * np.uint64(2)))
                common = np.intersect1d(x, more).size
                if 100 * common >= 80 * (x.size + more.size - common):
                    y = more
            found = []
            for s in (x, y):
                sums = jaccard._fingerprint(s)[2]
                band = jaccard.band_of(s.size, 80)
                found.append({v for b in (band, band + 1) for v in jaccard.signatures(s, sums, b, 80).tolist()})
            assert found[0] & found[1], size


def test_rows_that_share_an_id(spark):
    """Unrelated texts under one id stay, repeated rows and near copies go."""
    texts = [" ".join(f"{c}{k}" for k in range(60)) for c in "abc"]
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[1]), (2, texts[1] + " more"), (3, texts[2]), (None, texts[2]), (4, None), (4, "")]
    got = sorted((r["doc_id"] or 0, r["text"] or "-") for r in corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, DOCS), "").collect())
    assert got == sorted([(1, texts[0]), (1, texts[1]), (3, texts[2]), (0, texts[2]), (4, "-"), (4, "-")])


def test_wide_sketches():
    """Sketches differ in no more bits than the sets do in elements, whatever their lengths, and tell large unlike sets apart."""
    r = np.random.default_rng(8)
    for size, other in [(1, 1), (300, 260), (510, 515), (2040, 2060), (6000, 6000), (9000, 8000)]:
        x = np.unique(r.integers(0, 2**63, size, dtype=np.uint64))
        for shared in (0, other // 2, other * 9 // 10):
            y = np.union1d(x[:shared], r.integers(0, 2**63, other - shared, dtype=np.uint64))
            bits = jaccard.bits_apart(jaccard.wide_sketch(x), jaccard.wide_sketch(y))
            assert bits == jaccard.bits_apart(jaccard.wide_sketch(y), jaccard.wide_sketch(x)) <= np.setxor1d(x, y).size
            # At a similarity of 80; half of the elements in common is far less.
            assert size == 1 or shared > other // 2 or bits * 180 > (x.size + y.size) * 20


def test_pairs_meet_in_few_groups(spark):
    """A pair of a group is told, and one that shares many groups is not told in each of them."""
    r = random.Random(4)
    few = [(r.randrange(-50, 50), a) for a in range(10, 40) for _ in range(6)]
    many = [(g, a) for g in range(1000, 1200) for a in (1, 2, 3) if r.random() < 0.9]
    members = spark.createDataFrame(sorted(set(few + many)), "g long, a long")
    nodes = members.select("a").distinct().withColumn("n", members.a + 1)
    got = [(x["xa"], x["ya"]) for x in jaccard._meetings(jaccard._with_firsts(members, nodes), F.lit(True)).collect()]
    groups = {}
    for g, a in few + many:
        groups.setdefault(g, set()).add(a)
    assert set(got) == {(a, b) for g in groups.values() for a in g for b in g}
    assert max(got.count(p) for p in set(got) if max(p) < 10) <= 3

"""Token alignment, manifests and approximate neighbours against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from ticketlens.llm import align, merkle, neighbours
from ticketlens.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.001"
FILES = (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))
ODD = [None, "", " ", "a", "a  b\n c ", "<|endoftext|> and <s> <0x41>", "été 中文 😀", "x" * 3000, "words " * 4000, "a▁b", "tab\tnull\x00 end", "  two", "a", "a"]


# ---- alignment -----------------------------------------------------------------------------------


def plain_tokens(texts):
    """Ids and end offsets of both sides with the libraries alone."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[2])
    alphabet = align.byte_alphabet()
    out = []
    for t in texts:
        if not t:
            out.append(([], [], [], []))
            continue
        raw = (" " + t).encode()
        one = a.encode(" " + t, add_special_tokens=False).ids
        two = b.encode(t)
        parts = [[bytes(alphabet[c] for c in a.id_to_token(i)) for i in one],
                 [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in two]]
        if any(b"".join(p) != raw for p in parts):
            out.append(([], [], [], []))
            continue
        ends = [np.cumsum([len(x) for x in p]).tolist() for p in parts]
        out.append((one, two, *ends))
    return out


def plain_rows(texts):
    """The columns of the query for each text."""
    told = plain_tokens(texts)
    linked = [[(one[ea.index(e)], two[eb.index(e)]) for e in sorted(set(ea) & set(eb))] for one, two, ea, eb in told]
    counts = Counter(p for own in linked for p in own)
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    rows = []
    for (one, two, ea, eb), own in zip(told, linked, strict=True):
        groups, i, j = [], 0, 0
        for e in sorted(set(ea) & set(eb)):
            p, q = ea.index(e) + 1, eb.index(e) + 1
            groups.append(",".join(map(str, one[i:p])) + "|" + ",".join(map(str, two[j:q])))
            i, j = p, q
        sha = hashlib.sha256(";".join(groups).encode()).hexdigest() if groups else ""
        rows.append((len(one), len(two), len(groups), len(own), sum(counts[p] == best[p[1]] for p in own), sum(counts[p] for p in own), sha))
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def test_alignment_of_odd_rows(spark):
    docs = spark.createDataFrame([(k, t, 1, "x", "y") for k, t in enumerate(ODD)], "doc_id long, text string, n_a int, links string, k0 string").repartition(3)
    got = {r["doc_id"]: r for r in align.align(docs, *FILES, with_tokens=True).collect()}
    for k, want in enumerate(plain_rows(ODD)):
        assert tuple(got[k][c] for c in COLUMNS) == want, ODD[k]
    for k, (one, two, ea, eb) in enumerate(plain_tokens(ODD)):
        assert (got[k]["a_ids"], got[k]["b_ids"]) == (one, two)
        if k in (7, 8):
            continue
        shares = [(i, j) for i in range(len(one)) for j in range(len(two)) if max(([0] + ea)[i], ([0] + eb)[j]) < min(ea[i], eb[j])]
        assert [tuple(p) for p in got[k]["overlaps"]] == shares
        assert [tuple(p) for p in got[k]["group_ends"]] == [(i, j) for i, j in shares if ea[i] == eb[j]]
    assert align.align(docs.limit(0), *FILES).count() == 0


def test_alignment_of_the_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in table(spark, SF, "documents").collect()]
    got = {r["doc_id"]: tuple(r[c] for c in COLUMNS) for r in QUERIES["op11_token_alignment"](spark, SF).collect()}
    assert got == {i: want for (i, _), want in zip(rows, plain_rows([t for _, t in rows]), strict=True)}


def test_all_pairs_that_end_together_are_known():
    sides = align.Sides(*FILES)
    known = set(align.linkable(sides).tolist())
    wide = len(sides.b.pieces)
    assert len(known) <= sum(map(len, sides.a.pieces)) + sum(map(len, sides.b.pieces))
    r = random.Random(1)
    for _ in range(20_000):
        a, b = r.randrange(len(sides.a.pieces)), r.randrange(wide)
        one, two = sides.a.pieces[a], sides.b.pieces[b]
        assert ((a * wide + b) in known) == bool(one and two and (one.endswith(two) or two.endswith(one)))


# ---- manifests -----------------------------------------------------------------------------------

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_leaf(row) -> str:
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def climb(leaves):
    """The root of a list of nodes and each one's siblings with their side."""
    paths, where = [[] for _ in leaves], list(range(len(leaves)))
    while len(leaves) > 1:
        for path, at in zip(paths, where, strict=True):
            path.append((leaves[at ^ 1], at & 1) if at ^ 1 < len(leaves) else None)
        leaves = [sha("".join(leaves[i : i + 2])) for i in range(0, len(leaves), 2)]
        where = [at >> 1 for at in where]
    return leaves[0], paths


def plain_manifest(rows):
    """doc_id, leaf, subroot, root, proof and folded root of each row (FIELDS), sorted."""
    groups = {}
    for row in rows:
        groups.setdefault(row[2], []).append(row)
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    made = []
    for g in order:
        own = sorted(groups[g], key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
        made.append((own, *climb([plain_leaf(r) for r in own])))
    if not made:
        return []
    root, above = climb([m[1] for m in made])
    out = []
    for (own, subroot, paths), rest in zip(made, above, strict=True):
        for row, path in zip(own, paths, strict=True):
            changed = list(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 7 == 0 and row[3] is not None:
                changed[3] += 1
            node = plain_leaf(changed)
            for step in path + rest:
                node = sha(node if step is None else step[0] + node if step[1] else node + step[0])
            proof = sha("".join(s[0] for s in path + rest if s))
            out.append((row[0], plain_leaf(row), subroot, root, proof, node))
    return sorted(out, key=str)


def manifest(spark, rows):
    docs = spark.createDataFrame([(*r, "z", b"z") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, leaf string, h binary").repartition(4)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    changed = [F.coalesce(F.when(hit, F.col("n_chars") + 1), F.col("n_chars")) if f == "n_chars" else F.col(f) for f in FIELDS]
    found = merkle.manifest(docs.withColumn("changed", merkle.leaf(changed)), keep=("doc_id", "changed"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("p"), merkle.folded(F.col("changed")).alias("f"))
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize("sizes", [(0,), (1,), (2,), (1, 1, 1), (3, 1, 8), (5, 33, 16, 2), (70, 1)])
def test_manifest_of_any_shape(spark, monkeypatch, sizes):
    """Trees of several passes: blocks of four nodes."""
    monkeypatch.setattr(merkle, "STEP", 2)
    langs = [None, "", "de", "é", "z"]
    rows = [(100 * g + 7 * k, None if k % 5 == 0 else "s", langs[g], None if k % 4 == 0 else k, "text é " * k) for g, n in enumerate(sizes) for k in range(n)]
    assert manifest(spark, rows) == plain_manifest(rows)


def test_manifest_of_odd_rows(spark):
    """Null ids, repeated rows and equal ids with other texts."""
    rows = [(None, None, None, None, None)] * 3 + [(1, "a", "en", 1, "x"), (1, "a", "en", 1, "x"), (1, "a", "en", 1, "y"), (2, "", "en", 0, ""), (None, "a", "en", 2, "z" * 5000)]
    assert manifest(spark, rows) == plain_manifest(rows)


# ---- approximate neighbours ----------------------------------------------------------------------


def exact_best(x, ids, i, k=5):
    """The exact k best of one query, with scores."""
    cosine = (x @ x[i]) / (np.linalg.norm(x, axis=1) * np.linalg.norm(x[i]))
    other = np.flatnonzero(ids != ids[i])
    best = other[np.lexsort((ids[other], -cosine[other]))[:k]]
    return [(int(ids[j]), float(cosine[j])) for j in best]


def recall(spark, x, ids, **options):
    rows = neighbours.vectors(spark.createDataFrame([(int(i), v.tolist(), 1.0) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<double>, score double"), "vec_id", "embedding")
    index = neighbours.build(rows.repartition(3))
    got = {}
    for r in neighbours.search(index, rows.filter("id % 50 = 0"), **options).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        want = exact_best(x, ids, i)
        own = sorted(got[int(ids[i])])
        assert [n for n, _, _ in own] == list(range(1, len(want) + 1))
        assert [s for _, _, s in own] == sorted((s for _, _, s in own), reverse=True)
        sure = {j: c for j, c in exact_best(x, ids, i, len(ids))}
        assert all(s == pytest.approx(sure[j], abs=1e-12) for _, j, s in own)
        hit, total = hit + len({j for j, _ in want} & {j for _, j, _ in own}), total + len(want)
    return hit / total, index


def test_recall_on_clusters_and_noise(spark):
    r = np.random.default_rng(1)
    centre = r.normal(size=(40, 24))
    clusters = centre[r.integers(0, 40, 4000)] + 0.2 * r.normal(size=(4000, 24))
    found, index = recall(spark, clusters, np.arange(4000))
    assert found >= 0.95 and index.centre.shape[0] > 1
    found, index = recall(spark, r.normal(size=(3000, 24)), np.arange(3000))
    assert found >= 0.9


def test_one_vector_a_third_of_all(spark):
    """Equal vectors: the smallest ids come first, and their list is dealt out over blocks."""
    r = np.random.default_rng(2)
    x = r.normal(size=(3000, 16))
    x[::3] = x[0]
    found, index = recall(spark, x, np.arange(3000))
    assert found >= 0.9
    assert index.blocks.count() > index.centre.shape[0]


def test_scan_gives_up_and_loses_nothing_it_keeps():
    r = np.random.default_rng(3)
    own = r.normal(size=(20, 64))[np.arange(2000) % 20] + 0.3 * r.normal(size=(2000, 64))
    x = np.ascontiguousarray(neighbours.unit(own).T, np.float32)
    scores, names, read = neighbours.scan(x, own, np.arange(2000), x[:, 5], own[5], 5, -np.inf, 5)
    best = [i for i, _ in exact_best(own, np.arange(2000), 5)]
    assert len(set(best) & set(names.tolist())) >= 4 and read < 0.4 * own.size
    again = neighbours.scan(x, own, np.arange(2000), x[:, 5], own[5], 5, -np.inf, 5, error=1e9)
    assert again[1].tolist() == best and again[2] > read


def test_neighbours_of_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (50, [2.0, 0.0]), (50, [2.0, 0.0]), (1, [0.0, 0.0]), (2, None), (3, [None, 1.0]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0]),
            (6, [-1e200, 1e200]), (7, []), (None, [1.0, 1.0]), (8, [3e-200, 0.0]), (9, [5.0])]
    frame = neighbours.vectors(spark.createDataFrame(rows, "i long, e array<double>"), "i", "e")
    assert sorted(r["id"] for r in frame.collect()) == [0, 6, 8, 9, 50, 50]
    got = sorted(tuple(r) for r in neighbours.search(neighbours.build(frame), frame.filter("id % 50 = 0")).collect())
    assert [g[:3] for g in got] == [(0, 1, 8), (0, 2, 9), (0, 3, 50), (0, 4, 50), (0, 5, 6), (50, 1, 0), (50, 2, 8), (50, 3, 9), (50, 4, 6)]
    assert got[4][3] == pytest.approx(-np.sqrt(0.5), abs=1e-12) and got[0][3] == 1.0
    empty = frame.limit(0)
    assert neighbours.search(neighbours.build(empty), frame).count() == 0 == neighbours.search(neighbours.build(frame), empty).count()


def test_recall_of_the_query(spark):
    rows = table(spark, "/root/testdata/sf0.1", "embeddings").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    got = {}
    for r in QUERIES["op13_nearest_neighbours"](spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    asked = np.flatnonzero(ids % 50 == 0)
    assert len(got) == asked.size
    assert sum(len(got[int(ids[i])] & {j for j, _ in exact_best(x, ids, i)}) for i in asked) >= 0.95 * 5 * asked.size

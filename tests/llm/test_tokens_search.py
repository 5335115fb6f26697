"""BPE, top-k search, archives, tool calls and the pipeline."""

import gzip
import hashlib
import io
import json
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm import brute
from ticketlens.llm import bpe, langid, toolcalls, topk, warc
from ticketlens.llm import textops as tx
from ticketlens.llm.queries import ORACLES, QUERIES, table
from tests.compare import difference, duck

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "the", " ", "  ", "\n", "\t", " ", "\u0085", "\x1c", "é", "ß", "ª", "²", "中", "文", "😀", "'s", "'S", "12", "!", "<|endoftext|>",
         "­", "ʰ", "Ω", "﻿", " word", ". Next"]


@pytest.fixture(scope="module")
def exact():
    return Tokenizer.from_file(PATH)


@pytest.mark.parametrize("chunk", [4, 64, 1024])
def test_encoding_equals_the_library(exact, chunk, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNK_BYTES", chunk)
    monkeypatch.setattr(bpe.chunk_ends, "__defaults__", (chunk,))
    r = random.Random(chunk)
    texts = ["".join(r.choice(PARTS) for _ in range(r.randrange(60))) for _ in range(600)]
    texts += [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}c" for c in range(0x2FF)]
    texts += [" ".join("".join(r.choice(PARTS) for _ in range(5)) for _ in range(1500)) for _ in range(4)]
    texts += ["the quick brown fox " * 2000, "x" * 20_000, "", None]
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    got = [ids for s in tx.slices(pa.record_batch({"text": pa.array(texts)}), "text") for ids in bpe.encoded(s, codec)]
    for t, ids in zip(texts, got, strict=True):
        assert ids == exact.encode(t or "", add_special_tokens=False).ids, t
        assert codec.decode(ids) == exact.decode(ids, skip_special_tokens=False) == (t or "")


def test_chunks_are_reused(monkeypatch):
    codec = bpe.Codec(PATH, public_tokenizers.PATTERN)
    r = random.Random(3)
    passage = " ".join(f"w{r.randrange(10**6)}" for _ in range(4000))
    batch = pa.record_batch({"text": pa.array([passage, f"other start {passage}", f"third {passage} and more"])})
    list(bpe.encoded(batch, codec))
    texts = sum(len(t) for t in batch.column("text").to_pylist())
    assert sum(map(len, codec.chunks)) < 0.5 * texts
    monkeypatch.setattr(bpe, "KEPT_BYTES", 10_000)
    small = bpe.Codec(PATH, public_tokenizers.PATTERN)
    assert list(bpe.encoded(batch, small)) == list(bpe.encoded(batch, codec))
    assert small.held <= 10_000 or len(small.chunks) == 1


def test_bpe_query(spark, exact):
    texts = {r["doc_id"]: r["text"] for r in table(spark, SF, "documents").collect()}
    for r in QUERIES["op5_bpe"](spark, SF).collect():
        ids = exact.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), brute.sha(exact.decode(ids, skip_special_tokens=False)))


def best(rows, queries, k):
    out = {}
    for i, v in queries:
        scored = sorted(((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i))[:k]
        out[i] = [(n + 1, j, -s) for n, (s, j) in enumerate(scored)]
    return out


@pytest.mark.parametrize("block", [2, 10_000])
def test_search_equals_brute_force(spark, block):
    r = np.random.default_rng(block)
    rows = [(i, (r.integers(-3, 4, 6) * (1 if i % 3 else 50)).tolist()) for i in range(400)]
    rows += [(500 + i, rows[7][1]) for i in range(30)] + [(600, [0] * 6), (700, [])]
    frame = spark.createDataFrame(rows, "id long, v array<long>").repartition(5)
    index = topk.build(frame, pivots=5)
    got = topk.search(index, frame.filter("id % 20 = 0"), k=5, query_block=block)
    found = {}
    for x in got.collect():
        found.setdefault(x["query_id"], []).append((x["rank"], x["vec_id"], x["score"]))
    padded = [(i, v + [0] * (6 - len(v))) for i, v in rows]
    want = best(padded, [(i, v) for i, v in padded if i % 20 == 0], 5)
    assert {i: sorted(v) for i, v in found.items()} == want


def test_search_of_odd_rows(spark):
    rows = [(50, [0.1, 0.2]), (None, [1.0, 1.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 0.0]), (5, [-0.001, 0.5]), (50, [0.1, 0.2])]
    frame = topk.quantised(spark.createDataFrame(rows, "i long, e array<float>"), "i", "e")
    assert sorted((r["id"], r["v"]) for r in frame.collect()) == [(5, [-1, 128]), (50, [25, 51]), (50, [25, 51])]
    got = [tuple(r) for r in topk.search(topk.build(frame), frame.filter("id % 50 = 0")).collect()]
    assert got == [(50, 1, 5, -25 + 51 * 128)]
    empty = frame.limit(0)
    assert topk.search(topk.build(empty), frame).count() == 0 == topk.search(topk.build(frame), empty).count()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_with_twins(spark, name):
    assert difference(QUERIES[name](spark, SF), duck(SF), ORACLES[name]) is None


PAGES = [(1, "http://a/é\r\nX: y", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "z" * 300_000), (5, "u", "z" * 300_000), (None, "u", "q"), (6, "u", "q")]


def test_archive_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FILE_BYTES", 1000)
    pages = spark.createDataFrame([(*p, "x", 1) for p in PAGES], "page_id long, url string, html string, record_type string, payload int")
    path = warc.archive(pages.repartition(3))
    rows = sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"], r["refers_to"]) for r in warc.read_pages(spark, path).collect())
    assert rows == [("1", 9, "revisit", 2), ("2", 9, "response", None), ("3", 0, "revisit", 4), ("4", 0, "response", None),
                    ("5", 300_000, "response", None), ("5", 300_000, "response", None), ("6", 1, "response", None), ("None", 1, "response", None)]
    full = {r["record_id"]: r for r in warc.read(spark, path).collect()}
    assert full["<urn:x-page:1>"]["target_uri"] == "http://a/é%0D%0AX: y" and full["<urn:x-page:1>"]["payload"] is None
    assert full["<urn:x-page:2>"]["payload"].decode() == "<p>é</p>" and full["<urn:x-page:2>"]["target_uri"] is None
    digest = full["<urn:x-page:2>"]["payload_digest"]
    import base64
    assert digest == "sha1:" + base64.b32encode(hashlib.sha1("<p>é</p>".encode()).digest()).decode()
    assert warc.read_pages(spark, warc.archive(pages.limit(0))).count() == 0


def test_filters_are_pushed(spark):
    path = warc.archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"))
    rows = warc.read(spark, path).filter("record_type = 'revisit' and record_id in ('<urn:x-page:1>', '<urn:x-page:9>')")
    assert [r["record_id"] for r in rows.collect()] == ["<urn:x-page:1>"]
    reader = warc.WarcReader(path, True)
    from pyspark.sql.datasource import EqualTo, GreaterThan
    left = list(reader.pushFilters([EqualTo(("record_type",), "revisit"), GreaterThan(("payload_length",), 3)]))
    assert len(left) == 1 and len(reader.filters) == 1
    assert sum(len(list(reader.read(p))) for p in reader.partitions()) == 2


def test_unwanted_payloads_are_not_decoded():
    rows = [{"record_type": "response", "record_id": f"<urn:x-page:{k}>", "target_uri": "u", "date": warc.DATE, "refers_to": None,
             "payload_digest": "D", "payload_length": 500_000, "payload": random.Random(k).randbytes(500_000)} for k in range(5)]
    data = b"".join(warc.member(warc.record(r)) for r in rows)

    class Counted(io.BytesIO):
        total = 0

        def read(self, n=-1):
            out = super().read(n)
            Counted.total += len(out)
            return out

    from pyspark.sql.datasource import EqualTo
    got = list(warc.records(Counted(data), True, [EqualTo(("record_id",), "<urn:x-page:3>")], True))
    assert len(got) == 1 and got[0][-1] == rows[3]["payload"]
    assert Counted.total < 0.5 * len(data)
    assert gzip.decompress(data) == b"".join(map(warc.record, rows))


@pytest.mark.parametrize("packed", [True, False])
def test_archives_of_others(packed):
    """Plain files, and gzip members without a length field."""
    text = [b"WARC/1.0\r\nWARC-Type: warcinfo\r\nContent-Type: application/warc-fields\r\nContent-Length: 7\r\n\r\na: b\r\n\r\r\n\r\n",
            b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <x>\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: 25\r\n\r\nHTTP/1.1 200 OK\r\n\r\nhello!\r\n\r\n",
            b"WARC/1.0\r\nWARC-Type: metadata\r\nX: 1\r\n 2\r\nContent-Length: 0\r\n\r\n\r\n\r\n"]
    data = b"".join(gzip.compress(t) for t in text) if packed else b"".join(text)
    rows = list(warc.records(io.BytesIO(data), packed, [], True))
    assert [r[0] for r in rows] == ["warcinfo", "response", "metadata"]
    assert [r[-1] for r in rows] == [b"a: b\r\n\r", b"hello!", b""]
    assert rows[2][-3]["x"] == "1 2"
    bare = list(warc.records(io.BytesIO(data), packed, [], False))
    assert [r[:-1] for r in bare] == [r[:-1] for r in rows] and {r[-1] for r in bare} == {None}


TOOLS = [("f", "x", "integer", True), ("f", "y", "string", False), ("f", "z", "number", False)]
CALLS = [
    ("c", "1", "f", '{"y":"é\\n","x":1}', None), ("c", "2", "f", '{"x":"1"}', "1"), ("c", "3", "f", '{"z":1.5,"x":2,"q":[]}', "2"),
    ("c", "4", "f", "{}", "gone"), ("c", "5", "g", '{"x":1}', None), ("c", "6", "f", "[1]", None), ("c", "7", "f", '{"x":1,"x":2}', None),
    ("c", "8", "f", '{"x":1}', "9"), ("c", "9", "f", '{"x":1}', "8"), ("c", "10", "f", '{"x":1}', "9"), ("d", "1", "f", '{"x":1}', "3"),
    ("c", "11", "f", '{"x":1}', None), ("c", "11", "f", '{"x":1}', None), ("c", "12", "f", '{"x":1}', None), ("c", "12", "f", '{"x":2}', None),
    (None, "1", "f", "{}", None), ("c", None, "f", "{}", None), ("c", "13", None, None, None), ("c", "14", "f", '{"x":3}', "14"),
]
RESULTS = [("c", "1", 'say "hi"\n'), ("c", "2", "b"), ("c", "2", "a"), ("c", "3", None), ("c", "99", "lost"), ("d", "1", "ok"), ("c", "11", "k"), (None, "1", "n")]


def test_tool_calls(spark):
    calls = spark.createDataFrame([(*c, "x") for c in CALLS], "conv string, id string, tool string, arguments string, after string, level string")
    results = spark.createDataFrame([(*c, "x") for c in RESULTS], "conv string, id string, content string, n_calls string")
    schemas = spark.createDataFrame(TOOLS, "tool string, param string, type string, required boolean")
    got = {(r["conv"], r["id"]): r for r in toolcalls.link(calls, results, schemas).collect()}
    status = {k: (r["status"], r["level"], r["errors"]) for k, r in got.items()}
    assert status == {
        ("c", "1"): ("linked", 0, ""), ("c", "2"): ("invalid", 1, "type:x"), ("c", "3"): ("invalid", 2, "unknown:q"), ("c", "4"): ("invalid", 0, "missing:x"),
        ("c", "5"): ("unknown_tool", 0, ""), ("c", "6"): ("malformed", 0, ""), ("c", "7"): ("malformed", 0, ""), ("c", "8"): ("cycle", None, ""),
        ("c", "9"): ("cycle", None, ""), ("c", "10"): ("cycle", None, ""), ("d", "1"): ("linked", 0, ""), ("c", "11"): ("linked", 0, ""),
        ("c", "12"): ("repeated", 0, ""), ("c", "13"): ("unknown_tool", 0, ""), ("c", "14"): ("cycle", None, ""), ("c", "99"): ("no_call", None, "")}
    for r in got.values():
        told = json.loads(r["json"])
        assert r["json"] == json.dumps(told, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert json.loads(got["c", "1"]["json"]) == {"arguments": {"x": 1, "y": "é\n"}, "errors": [], "id": "1", "level": 0, "result": 'say "hi"\n', "status": "linked", "tool": "f"}
    assert (got["c", "2"]["n_results"], json.loads(got["c", "2"]["json"])["result"]) == (2, "a")
    assert toolcalls.link(calls.limit(0), results.limit(0), schemas.limit(0)).count() == 0


def test_levels_of_a_long_chain(spark):
    n = 300
    rows = [("c", str(k), None if k == 0 else str(k - 1)) for k in range(n)] + [("c", f"s{k}", "7") for k in range(200)]
    got = {r["id"]: r["level"] for r in toolcalls.levels(spark.createDataFrame(rows, "conv string, id string, after string")).collect()}
    assert [got[str(k)] for k in range(n)] == list(range(n)) and got["s5"] == 8


def test_pipeline_against_brute_force(spark, exact):
    """All stages after the language models, whose rejections are taken as they are."""
    docs = table(spark, SF, "documents")
    kept = corpus_pipeline.language(spark, docs, SF)
    assert kept.columns == docs.columns
    rows = {r["doc_id"]: r["text"] for r in kept.collect()}
    lang = langid.predict(docs, corpus_pipeline.language_model(docs)).filter("lang_pred != 'und'")
    assert set(rows) == {r["doc_id"] for r in lang.filter("score >= 0.5").collect()}
    first = [i for i, (_, c) in sorted(brute.linked(list(rows.items()), corpus_pipeline.NEAR_SIMILARITY, corpus_pipeline.NEAR_SHINGLE).items()) if i == c]
    texts = [rows[i] for i in first]
    texts = [kept if gone else t for t, (_, gone, kept) in zip(texts, brute.removed(texts), strict=True)]
    items = [(r["item_id"], r["text"]) for r in table(spark, SF, "benchmark").collect()]
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert sorted(got) == first
    changed = 0
    for i, t, (_, hit, _) in zip(first, texts, brute.leaks(texts, items), strict=True):
        if hit:
            changed += 1
            continue
        assert got[i]["ids"] == exact.encode(t, add_special_tokens=False).ids
        assert got[i]["decoded_sha256"] == brute.sha(t)
    assert changed < len(first)


def test_pipeline_stages_take_odd_tables(spark):
    docs = spark.createDataFrame(
        [(1, "the same text of words " * 20, "en", "a", 1, "x"), (1, "the same text of words " * 20, "en", "a", 1, "x"), (None, "the of and to in is that", "en", "a", 1, "y"),
         (2, None, None, None, None, None), (3, "", "en", "b", 0, "z"), (4, "words and more words that the of " * 3000, "en", "b", 0, "z")],
        "doc_id long, text string, lang string, source string, n_chars long, score string")
    for part in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, part, SF)
            out.count()
            assert name == "tokens" or out.columns == docs.columns

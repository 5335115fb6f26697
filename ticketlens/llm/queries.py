"""Registered queries of the training-data operators: each applies one operator to its whole table.

The operators keep their general results (spans, texts, files); a query derives its digest columns from them.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import align, bpe, decontaminate, jaccard, langid, merkle, neighbours, quality, substring, toolcalls, topk, toxicity, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return register


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def fold(column: str, parts: int) -> Column:
    """The remainder that decides which documents are held out."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(0))


def learnable(rows: DataFrame, parts: int, rest: int) -> DataFrame:
    """Labelled rows that are not held out."""
    return rows.filter(fold("doc_id", parts) != rest)


@query("op1_quality")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    model = quality.fit(docs, learnable(table(spark, sf, "labels"), 5, 0))
    return quality.score(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted")
    )


@query("op2_toxicity")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    model = toxicity.fit(docs, learnable(table(spark, sf, "labels"), 5, 0))
    return toxicity.score(docs, model).select(
        "doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


@query("op3_substring_dedup")
def _(spark, sf):
    found = substring.scan(table(spark, sf, "documents"))
    digest = F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    return found.select("doc_id", "n_words", "n_removed", digest, "spans")


# Schemas of the tools that the conversations are read as calls of.
TOOLS = (
    ("search", "query", "string", True), ("search", "limit", "integer", False), ("lookup", "key", "string", True),
    ("lookup", "exact", "boolean", False), ("lookup", "lang", "string", True), ("count", "text", "string", True), ("count", "unit", "string", False),
)


@query(
    "op4_toolcalls",
    """WITH RECURSIVE u AS (
      SELECT conv_id AS conv, turn, conv_id || ':' || turn AS id, text FROM conversations WHERE role = 'user'
    ), c AS (
      SELECT conv, turn, id, CASE turn % 3 WHEN 0 THEN 'search' WHEN 1 THEN 'lookup' ELSE 'count' END AS tool,
        CASE turn % 3 WHEN 0 THEN '{"limit":' || length(text) || ',"query":' || to_json(text) || '}'
          WHEN 1 THEN '{"exact":' || CASE WHEN conv % 2 = 0 THEN 'true' ELSE 'false' END || ',"key":' || to_json(text)
            || CASE WHEN conv % 5 <> 0 THEN ',"lang":"en"' ELSE '' END || '}'
          ELSE '{"text":' || to_json(text) || ',"unit":' || CASE WHEN conv % 7 = 0 THEN '1' ELSE '"words"' END || '}' END AS arguments,
        CASE WHEN turn % 3 = 1 AND conv % 5 = 0 THEN 'missing:lang' WHEN turn % 3 = 2 AND conv % 7 = 0 THEN 'type:unit' ELSE '' END AS errors,
        EXISTS (SELECT 1 FROM u p WHERE p.conv = u.conv AND p.turn = u.turn - 2) AS later
      FROM u
    ), l AS (
      SELECT id, conv, turn, CAST(0 AS BIGINT) AS level FROM c WHERE NOT later
      UNION ALL SELECT c.id, c.conv, c.turn, l.level + 1 FROM c JOIN l ON c.conv = l.conv AND c.turn = l.turn + 2
    ), r AS (
      SELECT conv_id AS conv, conv_id || ':' || (turn - 1) AS id, min(text) AS content, count(*) AS n_results
      FROM conversations WHERE role = 'assistant' GROUP BY ALL
    ), j AS (
      SELECT coalesce(c.conv, r.conv) AS conv, coalesce(c.id, r.id) AS id, c.tool, l.level, CAST(c.id IS NOT NULL AS BIGINT) AS n_calls,
        coalesce(r.n_results, 0) AS n_results, coalesce(c.errors, '') AS errors, c.arguments, r.content,
        CASE WHEN c.id IS NULL THEN 'no_call' WHEN c.errors <> '' THEN 'invalid' WHEN r.id IS NULL THEN 'no_result' ELSE 'linked' END AS status
      FROM c JOIN l USING (id) FULL JOIN r ON c.conv = r.conv AND c.id = r.id
    )
    SELECT conv, id, tool, level, n_calls, n_results, status, errors,
      '{"arguments":' || coalesce(arguments, 'null') || ',"errors":' || CASE WHEN errors = '' THEN '[]' ELSE '["' || errors || '"]' END
      || ',"id":"' || id || '","level":' || coalesce(CAST(level AS VARCHAR), 'null') || ',"result":' || coalesce(CAST(to_json(content) AS VARCHAR), 'null')
      || ',"status":"' || status || '","tool":' || coalesce('"' || tool || '"', 'null') || '}' AS json
    FROM j""",
)
def _(spark, sf):
    """Each user turn is a call of a tool with the turn's text, after the user's turn before; the answer is its result."""
    rows = table(spark, sf, "conversations")
    own = F.struct  # keys are not in order here, and some calls break their schema on purpose
    arguments = (
        F.when(F.col("turn") % 3 == 0, F.to_json(own(F.col("text").alias("query"), F.length("text").alias("limit"))))
        .when(F.col("turn") % 3 == 1, F.to_json(own(F.col("text").alias("key"), F.when(F.col("conv_id") % 5 != 0, "en").alias("lang"), (F.col("conv_id") % 2 == 0).alias("exact"))))
        .when(F.col("conv_id") % 7 == 0, F.to_json(own(F.lit(1).alias("unit"), "text"))).otherwise(F.to_json(own(F.lit("words").alias("unit"), "text")))
    )
    name = lambda turn: F.concat_ws(":", "conv_id", turn.cast("string"))
    tool = F.element_at(F.array(*map(F.lit, ("search", "lookup", "count"))), (F.col("turn") % 3 + 1).cast("int"))
    turn = F.col("turn")
    calls = rows.filter("role = 'user'").select(F.col("conv_id").alias("conv"), name(turn).alias("id"), tool.alias("tool"), arguments.alias("arguments"), name(turn - 2).alias("after"))
    results = rows.filter("role = 'assistant'").select(F.col("conv_id").alias("conv"), name(turn - 1).alias("id"), F.col("text").alias("content"))
    schemas = spark.createDataFrame(TOOLS, "tool string, param string, type string, required boolean")
    return toolcalls.link(calls, results, schemas)


@query("op5_bpe")
def _(spark, sf):
    return bpe.digests(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)


@query("op6_jaccard_join")
def _(spark, sf):
    return jaccard.link(table(spark, sf, "documents"))


@query(
    "op7_topk",
    """WITH v AS (
      SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings
      WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    ), s AS (
      SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
    )
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
    FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 5""",
)
def _(spark, sf):
    rows = topk.quantised(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return topk.search(topk.build(rows), rows.filter("id % 50 = 0"))


def language_model(docs: DataFrame) -> langid.Model:
    """Learned from the documents that are not held out."""
    return langid.fit(docs.filter(fold("doc_id", 4) != 2), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


@query("op8_langid")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    found = langid.predict(docs, language_model(docs))
    return found.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query("op9_decontaminate")
def _(spark, sf):
    found = decontaminate.scan(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
    return found.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"), decontaminate.n_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"),
        (decontaminate.n_hit() > 0).alias("contaminated"), "spans", "items",
    )


# Base32 of the 20 bytes of a SHA-1 digest, from its hexadecimal digits.
BASE32 = " || ".join(
    f"substr('{warc.ALPHABET}', 1 + ((CAST('0x' || substr(hexed, {5 * k + 1}, 5) AS INTEGER) >> {s}) & 31), 1)" for k in range(8) for s in (15, 10, 5, 0)
)


@query(
    "op10_warc",
    f"""WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages),
    d AS (SELECT page_id, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, upper(sha1(payload)) AS hexed FROM p),
    w AS (SELECT page_id, payload_bytes, {BASE32} AS payload_digest, max(page_id) OVER (PARTITION BY hexed, payload_bytes) AS last FROM d)
    SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id < last THEN last END AS refers_to FROM w""",
)
def _(spark, sf):
    return warc.read_pages(spark, warc.archive(table(spark, sf, "pages")))


@query("op11_token_alignment")
def _(spark, sf):
    return align.align(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, public_tokenizers.path("piece_bpe_32k.model"))


def _hashed(n_chars: str) -> str:
    """DuckDB's leaf of a document."""
    fields = ("doc_id", "source", "lang", n_chars, "text")
    return "sha256(" + " || ".join(f"coalesce(octet_length(encode(CAST({f} AS VARCHAR))) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"


# DuckDB's CRC-32 of a number's decimal digits.
CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS BIGINT))),
  lambda a, b: list_reduce(list_prepend(xor(a, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)))"""


@query(
    "op12_merkle_manifest",
    f"""WITH RECURSIVE d AS MATERIALIZED (
      SELECT doc_id, lang, {_hashed("n_chars")} AS leaf, {_hashed(f"(CASE WHEN ({CRC}) % 7 = 0 THEN n_chars + 1 ELSE n_chars END)")} AS changed FROM documents
    ), l AS MATERIALIZED (
      SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d
    ), t AS (
      SELECT lang, 0 AS level, pos AS idx, leaf AS h, n FROM l
      UNION ALL SELECT lang, level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM t WHERE n > 1 GROUP BY lang, level, idx // 2, n
    ), s AS MATERIALIZED (
      SELECT lang, level AS height, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, count(*) OVER () AS n FROM t WHERE n = 1
    ), u AS (
      SELECT 0 AS level, pos AS idx, h, n FROM s
      UNION ALL SELECT level + 1, idx // 2, sha256(string_agg(h, '' ORDER BY idx)), (n + 1) // 2 FROM u WHERE n > 1 GROUP BY level, idx // 2, n
    ), a AS MATERIALIZED (
      SELECT l.lang, l.doc_id, l.leaf, l.pos AS leaf_pos, t.level, t.h, (l.pos >> t.level) % 2 AS second
      FROM l JOIN t ON l.lang IS NOT DISTINCT FROM t.lang AND t.n > 1 AND t.idx = xor(l.pos >> t.level, 1)
    ), b AS (
      SELECT l.lang, l.pos, s.pos AS sub_pos, s.height, s.h AS subroot, l.doc_id, l.leaf, l.changed FROM l JOIN s ON l.lang IS NOT DISTINCT FROM s.lang
    ), f AS (
      SELECT lang, pos, 0 AS level, '' AS proof, changed AS node, height, sub_pos FROM b
      UNION ALL SELECT f.lang, f.pos, f.level + 1, f.proof || coalesce(a.h, u.h, ''),
        sha256(CASE WHEN coalesce(a.h, u.h) IS NULL THEN node
          WHEN (CASE WHEN f.level < height THEN f.pos >> f.level ELSE sub_pos >> (f.level - height) END) % 2 = 1 THEN coalesce(a.h, u.h) || node
          ELSE node || coalesce(a.h, u.h) END), height, sub_pos
      FROM f LEFT JOIN a ON f.lang IS NOT DISTINCT FROM a.lang AND f.pos = a.leaf_pos AND f.level = a.level AND f.level < height
        LEFT JOIN u ON f.level >= height AND u.n > 1 AND u.level = f.level - height AND u.idx = xor(sub_pos >> (f.level - height), 1)
      WHERE f.level < height + (SELECT max(level) FROM u)
    )
    SELECT b.doc_id, b.leaf, b.subroot, r.h AS root, sha256(f.proof) AS proof_sha256, f.node AS folded_root, f.node = r.h AS verified
    FROM b JOIN f ON b.lang IS NOT DISTINCT FROM f.lang AND b.pos = f.pos, u r WHERE r.n = 1 AND f.level = b.height + r.level""",
)
def _(spark, sf):
    """One row in seven is tampered with after its proof was made."""
    fields = ("doc_id", "source", "lang", "n_chars", "text")
    docs = table(spark, sf, "documents").select(*fields)
    more = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.col("n_chars").cast("decimal(38,0)") + 1)
    changed = [F.coalesce(more, F.col("n_chars").cast("decimal(38,0)")) if f == "n_chars" else F.col(f) for f in fields]
    found = merkle.manifest(docs.withColumn("changed", merkle.leaf(changed)), fields=fields, keep=("doc_id", "changed"))
    found = found.select("doc_id", "leaf", "subroot", "root", merkle.proof_digest().alias("proof_sha256"), merkle.folded(F.col("changed")).alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


@query("op13_nearest_neighbours")
def _(spark, sf):
    rows = neighbours.vectors(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return neighbours.search(neighbours.build(rows), rows.filter("id % 50 = 0"))

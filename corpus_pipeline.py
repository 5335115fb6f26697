"""The training-corpus pipeline: stages over documents, each written as Parquet and read again by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.llm import bpe, decontaminate, jaccard, langid, substring
from ticketlens.llm.queries import language_model, table
from ticketlens.session import stage_table

# Documents whose language is less likely than this are rejected.
LEAST_LANGUAGE_SCORE = 0.5
# Words of a shingle, and the similarity in hundredths from which documents are near duplicates; op6 has its own.
NEAR_SHINGLE = 5
NEAR_SIMILARITY = 80
# Names of the columns that tell rows apart; they do not clash with the tables' own.
ROW, TEXT_HASH = "_near_duplicates_row", "_near_duplicates_text"


def _changed(rows: DataFrame, docs: DataFrame, text) -> DataFrame:
    """The columns of docs, with a new text and its length."""
    rows = rows.withColumn("text", text)
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages that the labelled documents teach; those without a letter go."""
    found = langid.predict(docs, language_model(docs), keep=tuple(docs.columns), made=("_language", "_score"))
    return found.filter((F.col("_language") != langid.UNDETERMINED) & (F.col("_score") >= LEAST_LANGUAGE_SCORE)).select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked ones, that with the smallest id; documents without an id stay.

    Rows that share an id but not the text are documents of their own, told apart by a hash of the text, and of a group the
    smallest id and hash stays. Rows that repeat both are one document.
    """
    keyed = docs.filter("doc_id is not null").withColumn(TEXT_HASH, F.xxhash64("text"))
    several = keyed.groupBy("doc_id").agg(F.min(TEXT_HASH).alias("least"), F.max(TEXT_HASH).alias("most")).filter("least <> most")
    # Pairs of id and hash are twice as long as ids, so ids that are not shared by several texts stand for themselves.
    keyed = keyed.withColumn(ROW, F.col("doc_id") if several.isEmpty() else F.struct("doc_id", TEXT_HASH))
    links = jaccard.link(keyed, ident=ROW, size=NEAR_SHINGLE, similarity=NEAR_SIMILARITY)
    first = links.filter(F.col(ROW) == F.col("component_id")).select(ROW).distinct()
    one = keyed.join(first, ROW, "left_semi").dropDuplicates([ROW])
    return one.select(docs.columns).unionByName(docs.filter("doc_id is null"))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of passages that start anywhere else; other texts stay as they are."""
    found = substring.scan(docs, keep=tuple(docs.columns))
    return _changed(found, docs, F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("text")))


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark windows; other texts stay as they are."""
    found = decontaminate.scan(docs, table(spark, sf_dir, "benchmark"), keep=tuple(docs.columns))
    return _changed(decontaminate.without_spans(found), docs, F.col("text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each text, their number and digests of them and of the text decoded from them."""
    return bpe.digests(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_passages", benchmark_passages),
    ("tokens", tokens),
]

# Neither the language models nor the tokenizer can be written in SQL; tests/llm holds the run against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other, on the documents of a folder."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        docs = stage_table(docs) if k + 1 < len(STAGES) else docs
    return docs

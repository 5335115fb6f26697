"""Rows with long texts: copies are dropped and counted, and holes profiled, without moving texts that occur once."""

import re

import pyarrow.dataset as ds
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ticketlens.operators import cleaning, dedupe, models, profile, replies
from ticketlens.session import scratch_tables


def tickets(spark, n=60):
    """Raw tickets of which every fifth comes twice, with null ids and blank and null texts."""
    made = spark.range(n).select(
        F.when(F.col("id") % 11 != 0, F.col("id").cast("string")).alias("ticket_id"),
        F.when(F.col("id") % 7 == 0, None).when(F.col("id") % 7 == 1, "  ").otherwise(F.concat(F.lit("text "), F.col("id").cast("string"))).alias("initial_message"),
        F.when(F.col("id") % 3 != 0, F.lit("reply")).alias("agent_first_reply"),
        F.lit("high").alias("priority"), F.lit("bug").alias("issue_type"), F.col("id").alias("k"),
    )
    return made.unionByName(made.filter("k % 5 = 0"))


def moved(df):
    """Columns by which the exchanges of the plan deal rows."""
    return set(re.findall(r"(\w+)#", " ".join(re.findall(r"hashpartitioning\(([^)]*)\)", df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]))))


def listed(df):
    return sorted(map(repr, df.collect()))


@pytest.mark.parametrize("times", [0, 1, 3])
def test_long_rows_are_told_apart_whole(spark, times):
    df = tickets(spark)
    df = df.limit(0) if times == 0 else df
    for _ in range(1, times):
        df = df.unionByName(df)
    assert listed(dedupe.drop_exact(df, long_rows=True)) == listed(df.dropDuplicates())
    assert listed(dedupe.exact_copies(df, long_rows=True)) == listed(dedupe.exact_copies(df))


def test_rows_that_occur_once_stay_in_their_tasks(spark):
    """A table without copies needs no exchange of its rows."""
    df = tickets(spark).filter("k % 5 <> 0")
    assert not moved(cleaning.clean_tickets(df)) and not moved(dedupe.exact_copies(df, long_rows=True))


@pytest.mark.parametrize("blank", [False, True])
def test_marks_have_the_profile_of_their_texts(spark, blank):
    df = tickets(spark)
    marks = profile.marked(df, ["ticket_id"], blank)
    assert profile.missing_profile(marks, blank_as_missing=blank).collect() == profile.missing_profile(df, blank_as_missing=blank).collect()
    assert {r[0] for r in marks.select("initial_message").distinct().collect()} == {None, "x"}


def test_examples_of_tickets_that_are_not_stored(spark):
    """Sampled by stored ids; the texts are those of the chosen tickets."""
    df = cleaning.clean_tickets(tickets(spark))
    shown = replies.reply_examples(df, n=4)
    every = replies.reply_examples(df, n=None).collect()
    assert shown.count() == 4 and all(r in every for r in shown.collect())


def test_texts_of_a_classifier_are_written_once(spark):
    """The split needs no written table of its own: a row's part follows from its id."""
    rows = spark.range(60).select(F.col("id").cast("string").alias("ticket_id"), F.concat(F.lit("word "), F.when(F.col("id") % 2 == 0, "good").otherwise("bad")).alias("text"),
                                  F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("label"))
    before = scratch_tables()
    trained = models.train_sentiment(rows, settings=models.SentimentSettings(iterations=3, max_rows=None))
    assert len([p for p in scratch_tables() - before if "/stage-" in p]) == 1
    assert trained.scored.count() == 12 and trained.n_train == 48


def test_texts_of_a_classifier_are_packed_well(spark):
    rows = spark.range(40).select(F.col("id").cast("string").alias("ticket_id"), F.lit("some words").alias("text"), (F.col("id") % 2).cast("string").alias("label"))
    before = scratch_tables()
    models.train_sentiment(rows, settings=models.SentimentSettings(iterations=2, max_rows=None))
    [written] = [p for p in scratch_tables() - before if "/stage-" in p]
    files = [pq.ParquetFile(f).metadata for f in ds.dataset(written.removeprefix("file:")).files]
    assert {m.row_group(0).column(c).compression for m in files if m.num_row_groups for c in range(m.num_columns)} == {"ZSTD"}

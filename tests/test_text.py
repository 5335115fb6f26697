"""Text expressions against Python's own functions on random texts."""

import random
import textwrap

from pyspark.sql import functions as F

from ticketlens.functions import text


def random_texts(n, seed=1):
    random.seed(seed)
    words = ["a", "Ticket", "http://x.y/z?q=1", "ünïcode", "x" * 30, "don't", "42", "end.", " ", "tab\tnew\nline"]
    return ["  ".join(random.choices(words, k=random.randint(0, 25))) for _ in range(n)]


def apply(spark, texts, expression):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, v string")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_shorten_equals_textwrap(spark):
    texts = random_texts(300) + ["hello   world  this is", "abcdefghijklmnop", "a  b", "", " "]
    for width in (8, 10, 12, 40, 150):
        assert apply(spark, texts, text.shorten("v", width)) == [textwrap.shorten(t, width) for t in texts]


def test_shorten_reads_whole_texts(spark):
    long_blank = "a" + " " * 5000 + "b"
    assert apply(spark, [long_blank], text.shorten("v", 10)) == ["a b"]


def test_normalise(spark):
    raw = ["See HTTP://a.b/c?d e", "Ünï-code  42!", " \n", "http", None]
    assert apply(spark, raw, text.normalise("v")) == ["see e", "n code 42", "", "http", None]


def test_join_texts(spark):
    df = spark.createDataFrame([(" a", "b "), (None, "b"), ("a", None), (None, None)], "x string, y string")
    assert [r[0] for r in df.select(text.join_texts("x", "y")).collect()] == ["a b", "b", "a", ""]


def test_reply_defaults_also_for_null(spark):
    df = spark.createDataFrame([("bug", "high"), (None, None)], "issue_type string, priority string")
    replies = [r[0] for r in df.select(text.template_reply()).collect()]
    assert replies[0].startswith("Thank you for reaching out about bug. We have logged your ticket as high priority")
    assert "about your request." in replies[1] and "as medium priority" in replies[1]


def test_terms(spark):
    df = spark.createDataFrame([("A cat, a big-cat",), ("x",), ("",)], "v string")
    assert [r[0] for r in df.select(text.terms("v")).collect()] == [
        ["cat", "big", "cat", "cat big", "big cat"], [], [],
    ]


def test_prompt(spark):
    df = spark.createDataFrame([("high", None, "m " * 300)], "priority string, issue_type string, initial_message string")
    prompt = df.select(text.reply_prompt()).first()[0]
    assert prompt.startswith("Write a support agent reply. Priority: high. Issue: nan. Customer: m m")
    assert prompt.endswith("m [...]")


def test_log_target_inverts(spark):
    df = spark.createDataFrame([(0.0,), (12.5,)], "h double")
    back = [r[0] for r in df.select(F.expm1(F.log1p("h"))).collect()]
    assert back[0] == 0.0 and abs(back[1] - 12.5) < 1e-12


def test_terms_match_a_text_once(spark):
    """Words are found once, and not again for each use of them in the pairs."""
    df = spark.createDataFrame([("One two, TWO three a",), ("",), (None,)], "v string").select(text.terms("v").alias("t"))
    assert [r["t"] for r in df.collect()] == [["one", "two", "two", "three", "one two", "two two", "two three"], [], None]
    assert df._jdf.queryExecution().optimizedPlan().toString().count("regexp_extract_all(") == 1

"""Cleaning rules on hand-written rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ticketlens.functions import calendar, parse
from ticketlens.operators import aggregate, cleaning, dimension, repair

INF = float("inf")


def column(spark, values, expression, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.orderBy("i").select(expression).collect()]


def test_number_rules(spark):
    texts = ["1d", " 3 ", "1e3", "1,000", "inf", "0x10", "1_000", "+5", ".5", "5.", "1f", "NaN", "", None, "-inf"]
    expected = [None, 3.0, 1000.0, None, INF, None, None, 5.0, 0.5, 5.0, None, None, None, None, -INF]
    assert column(spark, texts, parse.to_number("v")) == expected


def test_flag_rules(spark):
    assert column(spark, ["1", "2", "0", "-1", "yes", None, "True", "false", "0.5"], parse.to_flag("v")) == [
        1, 1, 0, 0, 0, 0, 1, 0, 1,
    ]


def test_time_rules(spark):
    texts = ["2024-01-02 03:04:05", "2024-01-02", "01/02/2024", "bad", None, "2024-01-02T03:04:05"]
    expected = [dt.datetime(2024, 1, 2, 3, 4, 5), None, None, None, None, None]
    assert column(spark, texts, parse.to_time("v")) == expected


def test_score_rules(spark):
    texts = ["4", "4.9", "-2.5", "x", None, "inf", "-inf", "0"]
    assert column(spark, texts, parse.to_score("v")) == [4, 4, -2, 0, 0, 0, 0, 0]


def test_text_rules(spark):
    texts = ["  a b \t\n", None, "", "　x"]
    assert column(spark, texts, parse.to_text("v")) == ["a b", "", "", "x"]


def test_id_rules(spark):
    assert column(spark, ["007", None], parse.to_id("v")) == ["007", None]
    assert column(spark, ["007", None], parse.to_id("v", null_key="nan")) == ["007", "nan"]


def test_needs_fill(spark):
    texts = [None, "", " Unknown ", "NaN", "None", "NaT", "EU", "NA"]
    assert column(spark, texts, parse.needs_fill("v")) == [True] * 6 + [False] * 2


def test_country_regions(spark):
    names = ["Germany", " brazil ", "USA", "Atlantis", None, "UNITED ARAB EMIRATES"]
    df = spark.createDataFrame(list(enumerate(names)), "i int, country string")
    rows = repair.region_of_country(df).orderBy("i").collect()
    assert [r.region for r in rows] == ["EU", "LATAM", "NA", "Unknown", "Unknown", "MEA"]
    assert len(repair.COUNTRY_REGIONS) == 31


def test_sla_rules(spark):
    plans = [("standard", 48.0), ("gold", 24.1), ("platinum", 8.0), (None, 48.0), ("Gold", 30.0), ("gold", None)]
    df = spark.createDataFrame(plans, "sla_plan string, resolution_time_hours double")
    rows = aggregate.with_sla(df).collect()
    assert [r.sla_met for r in rows] == [True, False, True, True, True]


def test_exact_copies_are_found_between_typing_steps(spark):
    rows = [("1", "bad date", " x"), ("1", "other bad", " x"), ("2", "bad", "y"), ("2", "bad", "y ")]
    df = spark.createDataFrame(rows, "ticket_id string, created_at string, initial_message string")
    cleaned = cleaning.clean_tickets(df).orderBy("ticket_id").collect()
    assert [(r.ticket_id, r.initial_message) for r in cleaned] == [("1", "x"), ("2", "y"), ("2", "y")]


def test_closed_without_text(spark):
    rows = [("RESOLVED", " "), ("Closed_No_Action", None), ("open", ""), (None, ""), ("resolved", "done")]
    df = spark.createDataFrame(rows, "status string, resolution_summary string")
    filled = [r.resolution_summary for r in repair.fill_summaries(df).collect()]
    assert filled == [repair.NO_SUMMARY, repair.NO_SUMMARY, "", "", "done"]
    assert repair.summary_gaps(df).first()[0] == 2


def test_calendar_has_leap_day(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2024-02-28 10:00:00', timestamp_ntz'2024-03-01 01:00:00', null)) AS t")
    rows = dimension.calendar(df, "t").orderBy("date").collect()
    assert [(r.date_key, r.day_of_week) for r in rows] == [
        (20240228, "Wednesday"), (20240229, "Thursday"), (20240301, "Friday"),
    ]


def test_calendar_of_nothing(spark):
    empty = dimension.calendar(spark.sql("SELECT CAST(null AS timestamp_ntz) AS t"), "t")
    assert empty.count() == 0
    assert empty.columns == ["date", "date_key", "year", "month", "day", "day_of_week"]


def test_unknown_month_is_a_bucket(spark):
    df = spark.sql("SELECT explode(array(timestamp_ntz'2024-02-28 10:00:00', null)) AS t")
    assert {r[0] for r in df.select(calendar.month_bucket("t")).collect()} == {"2024-02", "NaT"}


def test_response_flag(spark):
    df = spark.createDataFrame([(0,), (3,), (None,)], "csat_score long")
    flagged = cleaning.with_response(df)
    assert [r.csat_response for r in flagged.collect()] == [0, 1, 0]
    assert repair.response_rate(flagged).first().asDict() == {
        "responded": 1, "not_responded": 2, "response_rate": pytest.approx(1 / 3),
    }
    assert aggregate.respondents(flagged).count() == aggregate.respondents(df).count() == 1


def test_fact_leaves_out_absent_columns(spark):
    df = spark.sql("SELECT 'a' AS ticket_id, timestamp_ntz'2024-02-28 10:00:00' AS created_at, 'EU' AS region")
    assert dimension.fact_tickets(df).columns == ["ticket_id", "date_key", "region"]
    assert dimension.fact_tickets(df).first().date_key == 20240228


def test_update_keeps_order_and_absent(spark):
    df = spark.createDataFrame([("1", "2")], "b string, a string")
    assert cleaning.update(df, {"a": F.lit(5), "zzz": F.lit(1)}).columns == ["b", "a"]

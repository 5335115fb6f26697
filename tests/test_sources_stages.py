"""Edge files, metrics and the stages end to end."""

import pytest
from pyspark.sql import functions as F

from ticketlens.functions.parse import needs_fill
from ticketlens.operators import models, replies
from ticketlens.plans import binding, stages
from ticketlens.sources import metrics, tables

SF = "/root/testdata/sf0.001"


def write(tmp_path, text):
    path = tmp_path / "in.csv"
    path.write_text(text)
    return str(path)


def test_csv_quotes_breaks_and_na(spark, tmp_path):
    path = write(tmp_path, 'id,msg,region\n007,"a ""b"", c\nd",NA\n2,,EU\n')
    rows = tables.read_csv(spark, path).collect()
    assert [tuple(r) for r in rows] == [("007", 'a "b", c\nd', "NA"), ("2", None, "EU")]
    compatible = tables.read_csv(spark, path, tables.PANDAS_NA_TOKENS).collect()
    assert [r.region for r in compatible] == [None, "EU"]
    assert len(tables.PANDAS_NA_TOKENS) == 19


def test_csv_position_keeps_file_order(spark, tmp_path):
    body = "".join(f"k{i % 3},{i}\n" for i in range(300))
    df = tables.read_csv(spark, write(tmp_path, "key,v\n" + body), multi_line=False, position=True)
    first = df.groupBy("key").agg(F.min_by("v", tables.POSITION).alias("v"))
    assert {r.key: r.v for r in first.collect()} == {"k0": "0", "k1": "1", "k2": "2"}


def test_required_columns_are_all_named(spark):
    df = spark.range(1)
    with pytest.raises(ValueError, match="people lacks required columns: a, b"):
        tables.require_columns(df, ["a", "id", "b"], "people")
    assert tables.require_columns(df, ["id"], "people") is df


def test_optional_columns(spark):
    got, absent = tables.optional_columns(spark.range(1), ["id", "x"])
    assert got.columns == ["id"] and absent == ["x"]


def test_tables_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("a", 'say "hi",\nyou'), ("b", "NA"), ("c", "  x\t")], "k string, v string")
    assert tables.write_table(df, f"{tmp_path}/t").count() == 3
    tables.write_table(df.limit(1), f"{tmp_path}/t")
    assert tables.read_table(spark, f"{tmp_path}/t", ["v", "zzz"]).columns == ["v"]
    assert tables.read_table(spark, f"{tmp_path}/t").count() == 1
    tables.write_csv(df, f"{tmp_path}/c")
    assert sorted(map(tuple, tables.read_csv(spark, f"{tmp_path}/c").collect())) == sorted(map(tuple, df.collect()))


def test_metrics_round_trip(spark, tmp_path):
    wide = spark.createDataFrame([("x", 1, 2.5)], "g string, n int, r double")
    for stage in ("one", "two"):
        metrics.write_metrics(metrics.metric_rows(wide, stage, "g"), str(tmp_path), stage)
    metrics.write_metrics(metrics.metric_rows(wide.drop("g"), "two"), str(tmp_path), "two")
    rows = metrics.read_metrics(spark, str(tmp_path))
    assert {(r.stage, r.metric, r.grp, r.value) for r in rows.collect()} == {
        ("one", "n", "x", 1.0), ("one", "r", "x", 2.5), ("two", "n", None, 1.0), ("two", "r", None, 2.5),
    }
    by_stage = metrics.metrics_by_stage(rows, ["one", "two"]).orderBy("metric", "grp").collect()
    assert [tuple(r) for r in by_stage] == [
        ("n", None, None, 1.0), ("n", "x", 1.0, None), ("r", None, None, 2.5), ("r", "x", 2.5, None),
    ]


def test_generator_is_loaded_per_partition_and_template_fills_in(spark):
    df = spark.createDataFrame(
        [("1", "hello", "hi", "bug", "high"), ("2", "hello you", "hi", None, None), ("3", " ", "hi", "bug", "low")],
        "ticket_id string, initial_message string, agent_first_reply string, issue_type string, priority string",
    )

    def load():
        return lambda prompts: [p.upper() if "bug" in p else None for p in prompts]

    rows = {r.ticket_id: r for r in replies.reply_examples(df, load=load).collect()}
    assert set(rows) == {"1", "2"}
    assert rows["1"].mode == "generated" and rows["1"].generated_reply == rows["1"].prompt.upper()
    assert rows["2"].mode == "template" and "your request" in rows["2"].generated_reply


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    """All stages from CSV files, with small models."""
    base = tmp_path_factory.mktemp("run")
    raw = binding.raw_tickets(spark, SF).select(*binding.TICKET_COLUMNS)
    tables.write_csv(raw, f"{base}/tickets")
    people = binding.raw_customers(spark, SF)
    tables.write_csv(people.orderBy("pos").drop("pos").coalesce(1), f"{base}/customers")
    small = models.ForestSettings(max_features=50, min_df=2, trees=3, depth=3, max_rows=None)
    stages.run_all(
        spark, f"{base}/tickets", f"{base}/customers", f"{base}/out", csat=small, resolution=small,
        sentiment=models.SentimentSettings(50, 2, 20, max_rows=None),
    )
    return f"{base}/out"


def test_star_tables(spark, finished):
    read = lambda name: tables.read_table(spark, f"{finished}/star/{name}")
    assert read("fact_tickets").count() == read("tickets_enriched").count() == 1000
    assert read("dim_customer").count() == 150
    assert read("dim_channel").count() == 5
    assert [r.product_area_key for r in read("dim_product_area").orderBy("product_area_name").collect()] == list(range(1, 8))
    fact = read("fact_tickets")
    assert fact.columns[:3] == ["ticket_id", "customer_id", "date_key"] and len(fact.columns) == 16
    orphan_days = fact.filter("date_key is not null").join(read("dim_date"), "date_key", "left_anti")
    assert orphan_days.count() == 0
    assert {r.country for r in read("dim_customer").collect()} != {"Japan"}


def test_quality_tables(spark, finished):
    for name in ("fact_tickets", "tickets_enriched"):
        table = tables.read_table(spark, f"{finished}/quality/{name}")
        assert table.count() == 1000 and "csat_response" in table.columns
        assert table.filter("region is null or trim(region) = ''").count() == 0
        assert not [c for c in table.columns if c.startswith("_")]
    rows = metrics.read_metrics(spark, f"{finished}/metrics").filter("stage = '02_quality'").collect()
    value = {(r.metric, r.grp): r.value for r in rows}
    assert value["missing_before", "fact_tickets"] == (
        value["imputed_from_country", "fact_tickets"] + value["set_unknown", "fact_tickets"]
    )
    assert value["missing_after", "fact_tickets"] == value["set_unknown", "fact_tickets"]
    assert value["rows_removed", None] == 0
    wide = tables.read_table(spark, f"{finished}/quality/tickets_enriched")
    filled = wide.filter("resolution_summary = 'No summary provided'").count()
    assert filled == value["resolution_summary_filled", "tickets_enriched"] > 0
    before = tables.read_table(spark, f"{finished}/star/fact_tickets")
    assert before.filter(needs_fill("region")).count() == value["missing_before", "fact_tickets"]
    assert value["missing_count", "resolution_summary"] > 0


def test_dashboard_and_time_tables(spark, finished):
    dashboard = lambda name: tables.read_table(spark, f"{finished}/dashboard/{name}")
    volume = dashboard("volume").agg(F.sum("n")).first()[0]
    wide = dashboard("volume_by_priority")
    assert volume == 1000 == sum(sum(r[1:]) for r in wide.collect())
    solved = tables.read_table(spark, f"{finished}/quality/fact_tickets").filter("resolution_time_hours is not null").count()
    assert dashboard("resolution_histogram").agg(F.sum("n")).first()[0] == solved
    assert dashboard("resolution_density").count() == 200
    anova = tables.read_table(spark, f"{finished}/time/anova").collect()
    assert {r.factor for r in anova} == {"priority", "sla_plan", "region"}
    assert all(0 <= r.p_value <= 1 for r in anova)


def test_models_and_replies(spark, finished):
    wide = tables.read_table(spark, f"{finished}/quality/tickets_enriched")
    scored = tables.read_table(spark, f"{finished}/models/07_sentiment_scored")
    matrix = tables.read_table(spark, f"{finished}/models_top/sentiment_confusion")
    assert scored.count() == sum(sum(r[1:]) for r in matrix.collect()) > 0
    assert tables.read_table(spark, f"{finished}/models/06_resolution_scored").columns == ["ticket_id", "actual", "prediction"]
    rows = metrics.read_metrics(spark, f"{finished}/metrics").collect()
    assert {r.stage for r in rows if r.metric == "n_train"} == {"05_csat", "06_resolution", "07_sentiment"}
    assert {r.grp for r in rows if r.metric == "significant_05"} == {"priority", "sla_plan", "region"}
    assert models.score(f"{finished}/models/05_csat", wide).filter("prediction is not null").count() == 1000
    assert tables.read_table(spark, f"{finished}/models_top/csat_features").count() == 20
    examples = tables.read_table(spark, f"{finished}/replies/examples").collect()
    assert len(examples) == 6 and {r.mode for r in examples} == {"template"}
    text = "\n".join(r.value for r in spark.read.text(f"{finished}/replies/text").collect())
    assert text.count("Customer: ") == text.count("Generated: ") == 6
    stages_seen = {r.stage for r in metrics.read_metrics(spark, f"{finished}/metrics").select("stage").distinct().collect()}
    assert len(stages_seen) == 8
    report = tables.read_table(spark, f"{finished}/report/metrics_by_stage")
    assert set(report.columns) == {"metric", "grp", *stages.STAGES} and stages_seen == set(stages.STAGES)
    assert report.filter("metric = 'n_tickets'").first()["03_dashboard"] == 1000

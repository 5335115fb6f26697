"""The ticket stages end to end: each reads stage tables and writes tables and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions.calendar import month_bucket
from ticketlens.functions.parse import closed_without_text
from ticketlens.operators import aggregate, dedupe, dimension, evaluate, models, profile, repair, replies, stats
from ticketlens.operators.cleaning import clean_customers, clean_tickets, with_response
from ticketlens.operators.join import enrich, key_coverage, lookup_first
from ticketlens.session import clear_scratch, stage_table
from ticketlens.sources import metrics, tables

# Analysed factors.
FACTORS = ("priority", "sla_plan", "region")
# The stages that write metrics, in order.
STAGES = (
    "01_clean", "02_quality", "03_dashboard", "04_time", "05_csat", "06_resolution", "07_sentiment", "08_replies",
)


def build_star(tickets: DataFrame, customers: DataFrame) -> dict[str, DataFrame]:
    """Fact, four dimensions and the wide table from cleaned tickets and customers."""
    return {
        "tickets_enriched": enrich(tickets, customers, "customer_id"),
        "fact_tickets": dimension.fact_tickets(tickets),
        "dim_customer": customers,
        "dim_date": dimension.calendar(tickets, "created_at"),
        "dim_channel": dimension.dimension(tickets, "channel", "channel"),
        "dim_product_area": dimension.dimension(tickets, "product_area", "product_area"),
    }


def profile_metrics(df: DataFrame, stage: str, blank_as_missing: bool) -> DataFrame:
    """Missing-value and descriptive metrics of a table."""
    return metrics.all_metrics(
        metrics.metric_rows(profile.missing_profile(df, blank_as_missing=blank_as_missing), stage, "column"),
        metrics.metric_rows(profile.describe(df), stage, "column"),
    )


def run_etl(
    spark: SparkSession, tickets_csv: str, customers_csv: str, out: str,
    na_tokens: tuple[str, ...] = tables.NA_TOKENS, multi_line: bool = True,
) -> None:
    """Raw CSV files to the star schema tables and their first profile."""
    raw = tables.read_csv(spark, tickets_csv, na_tokens, multi_line)
    tables.require_columns(raw, tables.TICKET_COLUMNS, "tickets")
    people = tables.read_csv(spark, customers_csv, na_tokens, multi_line, position=True)
    tables.require_columns(people, tables.CUSTOMER_COLUMNS, "customers")

    # The cleaned tables are written once; the star tables read them back.
    tickets = tables.write_table(clean_tickets(raw), f"{out}/tickets_clean")
    customers = clean_customers(people, tables.POSITION).drop(tables.POSITION)
    customers = tables.write_table(customers, f"{out}/customers_clean")
    for name, table in build_star(tickets, customers).items():
        tables.write_table(table, f"{out}/star/{name}")
    wide = tables.read_table(spark, f"{out}/star/tickets_enriched")
    metrics.write_metrics(profile_metrics(wide, "01_clean", False), f"{out}/metrics", "01_clean")


def run_quality(spark: SparkSession, out: str) -> None:
    """Repairs fact and wide table into new tables and counts what was done."""
    star, fixed, stage = f"{out}/star", f"{out}/quality", "02_quality"
    customers = tables.read_table(spark, f"{star}/dim_customer")
    # Stage tables have no row order: among rows of one id the smallest row is kept.
    whole_row = F.struct(*[c for c in customers.columns if c != "customer_id"])
    dim = tables.write_table(dedupe.keep_first(customers, "customer_id", whole_row), f"{fixed}/dim_customer")
    lookup = dim.select("customer_id", "country")
    counters = [metrics.metric_rows(dedupe.duplicate_summary(customers, "customer_id"), stage)]
    for name in ("fact_tickets", "tickets_enriched"):
        table = with_response(tables.read_table(spark, f"{star}/{name}"))
        marked = repair.mark_regions(table, lookup)
        counts = repair.region_counts()
        if "resolution_summary" in marked.columns:
            marked = marked.withColumn("_gap", closed_without_text("status", "resolution_summary"))
            marked = repair.fill_summaries(marked)
            counts.append(F.count_if("_gap").alias("resolution_summary_filled"))
        # Counted while it is written: the join runs once.
        seen = tables.write_counted(marked, f"{fixed}/{name}", counts, drop=["_missing", "_imputed", "_gap"])
        counters.append(metrics.metric_rows(seen.withColumn("table", F.lit(name)), stage, "table"))
    fact = tables.read_table(spark, f"{fixed}/fact_tickets")
    wide = tables.read_table(spark, f"{fixed}/tickets_enriched")
    counters += [
        metrics.metric_rows(repair.response_rate(fact), stage),
        metrics.metric_rows(key_coverage(fact, dim, "customer_id"), stage),
        profile_metrics(wide, stage, True),
    ]
    metrics.write_metrics(metrics.all_metrics(*counters), f"{out}/metrics", stage)


def dashboard_tables(fact: DataFrame, wide: DataFrame) -> dict[str, DataFrame]:
    """The tables behind the dashboard panels."""
    dated = lookup_first(fact, wide, "ticket_id", ["created_at", "customer_segment"], "created_at")
    # Two tables read the months: the join runs once.
    dated = stage_table(dated.select(month_bucket("created_at").alias("month"), "priority"))
    return {
        "volume": aggregate.group_sizes(dated, ["month", "priority"]),
        "volume_by_priority": aggregate.cross_tab(dated, "month", "priority"),
        "resolution_histogram": aggregate.histogram(fact, "resolution_time_hours", stats.HISTOGRAM_BINS),
        "resolution_density": stats.density(fact, "resolution_time_hours", bins=stats.HISTOGRAM_BINS),
        "sla_by_segment": aggregate.sla_rate(wide),
        "channels": aggregate.value_counts(fact, "channel"),
        "sentiments": aggregate.value_counts(fact, "customer_sentiment"),
        "csat_histogram": aggregate.histogram(fact.filter(F.col("csat_score") > 0), "csat_score", 5),
    }


def run_dashboard(spark: SparkSession, out: str) -> None:
    """Writes the dashboard tables."""
    fact = tables.read_table(spark, f"{out}/quality/fact_tickets")
    wide = tables.read_table(spark, f"{out}/quality/tickets_enriched")
    for name, table in dashboard_tables(fact, wide).items():
        tables.write_table(table, f"{out}/dashboard/{name}")
    metrics.write_metrics(
        metrics.metric_rows(fact.agg(F.count(F.lit(1)).alias("n_tickets")), "03_dashboard"),
        f"{out}/metrics", "03_dashboard",
    )


def time_tables(wide: DataFrame, hours: str = "resolution_time_hours") -> dict[str, DataFrame]:
    """Resolution time by factor: summaries, boxes, densities and variance analysis."""
    long = stats.by_factor(wide, FACTORS, hours)
    return {
        "overall": stats.overall_summary(wide, hours),
        "summary_by_group": stats.level_summary(long),
        "boxes": stats.box_stats(long),
        "violin": stats.density(wide, hours, ["priority"], stats.VIOLIN_GRID),
        "anova": stats.anova(long),
    }


def run_time_analysis(spark: SparkSession, out: str) -> None:
    """Writes the time tables and their metrics."""
    stage = "04_time"
    wanted = ["resolution_time_hours", *FACTORS]
    wide = tables.read_table(spark, f"{out}/quality/tickets_enriched", wanted)
    written = {
        name: tables.write_table(table, f"{out}/time/{name}") for name, table in time_tables(wide).items()
    }
    groups = written["summary_by_group"].withColumn("group", F.concat_ws("=", "factor", "level"))
    tests = written["anova"].select("factor", "f", "p_value", F.col("significant_05").cast("int"), F.col("skipped").cast("int"))
    rows = metrics.all_metrics(
        metrics.metric_rows(written["overall"], stage),
        metrics.metric_rows(groups.drop("factor", "level"), stage, "group"),
        metrics.metric_rows(tests, stage, "factor"),
    )
    metrics.write_metrics(rows, f"{out}/metrics", stage)


def run_models(
    spark: SparkSession, out: str,
    csat: models.ForestSettings = models.CSAT,
    resolution: models.ForestSettings = models.RESOLUTION,
    sentiment: models.SentimentSettings = models.SentimentSettings(),
) -> None:
    """Trains and saves the three models; writes the scored hold-out rows, their metrics and the confusion matrix."""
    wide = tables.read_table(spark, f"{out}/quality/tickets_enriched")
    csat_model = models.train_csat(wide, settings=csat)
    trained = {
        "05_csat": (csat_model, None),
        "06_resolution": (models.train_resolution(wide, settings=resolution), None),
        "07_sentiment": (models.train_sentiment(models.sentiment_rows(wide), settings=sentiment), "class"),
    }
    for stage, (result, group) in trained.items():
        tables.save_model(result.model, f"{out}/models/{stage}")
        tables.write_table(result.scored, f"{out}/models/{stage}_scored")
        sizes = spark.createDataFrame([(result.n_train,)], "n_train long")
        rows = metrics.all_metrics(metrics.metric_rows(result.metrics, stage, group), metrics.metric_rows(sizes, stage))
        metrics.write_metrics(rows, f"{out}/metrics", stage)
    scored = tables.read_table(spark, f"{out}/models/07_sentiment_scored")
    tables.write_table(evaluate.confusion_matrix(scored, "label", "predicted"), f"{out}/models_top/sentiment_confusion")
    importance = models.feature_importance(csat_model.model, models.CSAT_CATEGORIES, wide)
    tables.write_table(importance, f"{out}/models_top/csat_features")


def run_replies(spark: SparkSession, out: str, load: replies.GeneratorLoader | None = None) -> None:
    """Writes reply examples and how they were made."""
    wide = tables.read_table(spark, f"{out}/quality/tickets_enriched")
    examples = tables.write_table(replies.reply_examples(wide, load=load), f"{out}/replies/examples")
    tables.write_texts(replies.example_lines(examples), f"{out}/replies/text")
    counts = examples.groupBy("mode").agg(F.count(F.lit(1)).alias("n_examples"))
    metrics.write_metrics(metrics.metric_rows(counts, "08_replies", "mode"), f"{out}/metrics", "08_replies")


def run_report(spark: SparkSession, out: str) -> None:
    """Writes the metrics of all stages side by side: a row for each metric and group, a column for each stage."""
    rows = metrics.read_metrics(spark, f"{out}/metrics")
    tables.write_table(metrics.metrics_by_stage(rows, list(STAGES)), f"{out}/report/metrics_by_stage")


def dashboard_values(panels: dict[str, DataFrame]) -> DataFrame:
    """The panels of one value per item as long rows (panel, item, value)."""
    items = {
        "volume": ("month", "priority"), "channels": ("channel",), "sentiments": ("customer_sentiment",),
        "sla_by_segment": ("customer_segment",), "resolution_histogram": ("bin",), "csat_histogram": ("bin",),
    }
    return metrics.all_metrics(*[
        panels[name].select(
            F.lit(name).alias("panel"),
            F.concat_ws("|", *[F.col(c).cast("string") for c in item]).alias("item"),
            F.col("sla_rate" if name == "sla_by_segment" else "n").cast("double").alias("value"),
        )
        for name, item in items.items()
    ])


def run_all(spark: SparkSession, tickets_csv: str, customers_csv: str, out: str, **options) -> None:
    """All stages in order; stops at the first failure.  Scratch tables go when all results are written."""
    run_etl(spark, tickets_csv, customers_csv, out)
    run_quality(spark, out)
    run_dashboard(spark, out)
    run_time_analysis(spark, out)
    run_models(spark, out, **options)
    run_replies(spark, out)
    run_report(spark, out)
    clear_scratch()

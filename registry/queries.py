"""Registered queries: one or more per operator, each over whole tables.

Every function takes a session and the folder of the driver tables and returns
a DataFrame whose columns match the SQL twin of the same key.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from dataclasses import replace

from pyspark.ml import PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketlens.functions import calendar, parse, text
from ticketlens.operators import (
    aggregate, cleaning, dedupe, dimension, evaluate, features, forest, join, linear, models, profile, repair,
    replies, sample, stats,
)
from ticketlens.plans import stages
from ticketlens.plans.binding import PLAIN_COLUMNS, TICKET_COLUMNS, raw_customers, raw_tickets, table
from ticketlens.session import ensure_checkpoint_dir, scratch_path, spread, stage_table
from ticketlens.sources import metrics, tables, versions

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The classes, a seed and the factors the queries use.
SENTIMENTS = ("very_negative", "negative", "neutral", "positive", "very_positive")
SEED = 42
DECIMALS = 6


def query(name: str) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[name] = function
        return function

    return register


# ---- shared inputs -------------------------------------------------------------------------------


def raw(spark: SparkSession, sf: str, texts: bool = False) -> DataFrame:
    return raw_tickets(spark, sf, texts)


def tickets(spark: SparkSession, sf: str, texts: bool = False) -> DataFrame:
    """Cleaned tickets, still with the integer key ``k``."""
    return cleaning.clean_tickets(raw(spark, sf, texts))


def stage(df: DataFrame, *columns: str) -> DataFrame:
    """Cleaned columns written as the stage table they would be, for queries that read them several times."""
    return stage_table(df.select(*columns) if columns else df)


def customers(spark: SparkSession, sf: str) -> DataFrame:
    return cleaning.clean_customers(raw_customers(spark, sf), "pos").drop("pos")


def lookup(spark: SparkSession, sf: str) -> DataFrame:
    return customers(spark, sf).select("customer_id", "country")


def rounded(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.round(F.col(f"`{c}`"), DECIMALS) for c in columns})


def messages(spark: SparkSession, sf: str, *more: str) -> DataFrame:
    """Whole documents with their text cleaned for tokenising."""
    documents = spread(table(spark, sf, "documents").select("doc_id", "text", *more))
    return documents.select("doc_id", text.normalise("text").alias("text"), *more)


def predicted(spark: SparkSession, sf: str) -> DataFrame:
    """Labelled tickets with a fixed pseudo-prediction."""
    rows = aggregate.have(tickets(spark, sf), "customer_sentiment")
    names = F.array(*[F.lit(s) for s in SENTIMENTS])
    return rows.select(
        "k", "customer_sentiment", F.get(names, ((F.col("k") + F.col("k") % 3) % 5).cast("int")).alias("predicted")
    )


def factors(spark: SparkSession, sf: str) -> DataFrame:
    rows = stage(tickets(spark, sf), "resolution_time_hours", *stages.FACTORS)
    return stats.by_factor(rows, stages.FACTORS, "resolution_time_hours")


def dated(spark: SparkSession, sf: str) -> DataFrame:
    return tickets(spark, sf).withColumn("month", calendar.month_bucket("created_at"))


# ---- scans and metrics ---------------------------------------------------------------------------


def _through_csv(spark, sf, na_tokens):
    """All raw ticket columns, whole texts with quotes and line breaks, written as CSV and read back."""
    path = scratch_path(spark, "tickets-csv")
    tables.write_csv(raw(spark, sf, texts=True).select(*TICKET_COLUMNS), path, packed=True)
    return tables.require_columns(tables.read_csv(spark, path, na_tokens), tables.TICKET_COLUMNS, "tickets")


@query("s01_csv_scan")
def _(spark, sf):
    return _through_csv(spark, sf, tables.NA_TOKENS)


@query("s01_csv_scan_pandas_words")
def _(spark, sf):
    return _through_csv(spark, sf, tables.PANDAS_NA_TOKENS)


@query("s02_pruned_scan")
def _(spark, sf):
    rows = tables.read_table(spark, f"{sf}/orders.parquet", ["o_orderkey", "o_orderpriority", "o_totalprice"])
    return rows.filter(F.col("o_totalprice") > 200000.0)


@query("s04_optional_columns")
def _(spark, sf):
    return tables.optional_columns(raw_customers(spark, sf), ["customer_id", "tier", "country"])[0]


def _quality_metrics(spark, sf):
    """The counters and the answer rate come from one pass over the marked tickets."""
    rows = cleaning.with_response(tickets(spark, sf))
    marked = repair.mark_regions(rows, lookup(spark, sf))
    rows = stage(marked, "csat_response", "region", "_missing", "_imputed", "resolution_time_hours", "customer_segment", "sla_plan")
    return metrics.all_metrics(
        metrics.metric_rows(rows.agg(*repair.response_counts(), *repair.region_counts()), "quality"),
        metrics.metric_rows(stats.overall_summary(rows, "resolution_time_hours"), "time"),
        metrics.metric_rows(aggregate.sla_rate(rows), "time", "customer_segment"),
    )


@query("s06_metric_rows")
def _(spark, sf):
    return rounded(_quality_metrics(spark, sf), ["value"])


@query("s07_metrics_by_stage")
def _(spark, sf):
    wide = metrics.metrics_by_stage(_quality_metrics(spark, sf), ["quality", "time"])
    return rounded(wide, ["quality", "time"])


@query("s03_required_columns")
def _(spark, sf):
    return tables.require_columns(table(spark, sf, "customer"), ["c_custkey", "c_name"], "customers")


@query("s05_write_table")
def _(spark, sf):
    return tables.write_table(tickets(spark, sf).select(*PLAIN_COLUMNS), scratch_path(spark, "written"))


@query("s05_replace_table")
def _(spark, sf):
    """Tickets written, then replaced by those of them that are closed, read through the log of versions."""
    path = scratch_path(spark, "versions")
    first = versions.replace_table(tickets(spark, sf).select(*PLAIN_COLUMNS), path)
    versions.replace_table(first.filter("resolution_time_hours is not null"), path)
    return versions.read_current(spark, path)


@query("s08_model_round_trip")
def _(spark, sf):
    """Category vectors of a pipeline that was saved and loaded again."""
    rows = stage(tickets(spark, sf), "ticket_id", *models.CSAT_CATEGORIES)
    path = scratch_path(spark, "model")
    tables.save_model(PipelineModel(features.category_stages(rows, models.CSAT_CATEGORIES)), path)
    return _slots(tables.load_model(path).transform(rows))


@query("s09_text_sink")
def _(spark, sf):
    path = scratch_path(spark, "texts")
    tables.write_texts(tickets(spark, sf).select(text.template_reply("product_area", "sla_plan").alias("reply")), path)
    return spark.read.text(path)


# ---- projections ---------------------------------------------------------------------------------


@query("p01_id_text")
def _(spark, sf):
    return raw(spark, sf).select(
        parse.to_id("k").alias("ticket_id"),
        parse.to_id("customer_id").alias("customer_id"),
        parse.to_id("customer_id", null_key="nan").alias("customer_id_matching"),
    )


@query("p02_time")
def _(spark, sf):
    return raw(spark, sf).select(
        "ticket_id",
        parse.to_time("created_at").alias("created_at"),
        parse.to_time("created_at", ["yyyy-MM-dd", "yyyy-MM-dd HH:mm:ss"]).alias("created_any"),
    )


@query("p03_number")
def _(spark, sf):
    return raw(spark, sf).select(
        "ticket_id",
        parse.to_number("resolution_time_hours").alias("resolution_time_hours"),
        parse.to_number(F.concat(F.lit(" +"), "resolution_time_hours", F.lit("e1 "))).alias("scaled"),
        parse.to_number(F.concat("resolution_time_hours", F.lit("d"))).alias("suffixed"),
    )


@query("p04_score")
def _(spark, sf):
    return raw(spark, sf).select("ticket_id", parse.to_score("csat_score").alias("csat_score"))


@query("p05_binary_flag")
def _(spark, sf):
    return raw(spark, sf).select(
        "ticket_id",
        parse.to_flag("reopened").alias("reopened"),
        parse.to_flag("has_attachment").alias("has_attachment"),
    )


@query("p06_text_strip")
def _(spark, sf):
    return raw(spark, sf, texts=True).select(
        "ticket_id", *[parse.to_text(c).alias(c) for c in cleaning.TEXT_COLUMNS]
    )


@query("p07_date_key")
def _(spark, sf):
    return tickets(spark, sf).select("ticket_id", calendar.date_key("created_at").alias("date_key"))


@query("p08_calendar_parts")
def _(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", *calendar.calendar_parts("o_orderdate"))


@query("p09_month_bucket")
def _(spark, sf):
    return tickets(spark, sf).select("ticket_id", calendar.month_bucket("created_at").alias("month"))


@query("p10_response_flag")
def _(spark, sf):
    return cleaning.with_response(tickets(spark, sf)).select("ticket_id", "csat_score", "csat_response")


@query("p11_fact")
def _(spark, sf):
    return dimension.fact_tickets(tickets(spark, sf))


@query("p12_country_region")
def _(spark, sf):
    return repair.region_of_country(raw_customers(spark, sf)).select("pos", "country", "region")


@query("p13_sla_limit")
def _(spark, sf):
    return aggregate.with_sla(tickets(spark, sf)).select(
        "ticket_id", "sla_plan", "resolution_time_hours", "sla_limit", "sla_met"
    )


@query("p14_join_texts")
def _(spark, sf):
    return raw(spark, sf, texts=True).select(
        "ticket_id", text.join_texts("initial_message", "agent_first_reply").alias("text")
    )


@query("p15_log_target")
def _(spark, sf):
    hours = F.col("resolution_time_hours")
    return rounded(
        tickets(spark, sf).select(
            "ticket_id", F.log1p(hours).alias("log_hours"), F.expm1(F.log1p(hours)).alias("hours_again")
        ),
        ["log_hours", "hours_again"],
    )


@query("p16_normalise")
def _(spark, sf):
    return messages(spark, sf)


@query("p17_shorten")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", text.shorten("text", 200).alias("short_200"), text.shorten("text", 150).alias("short_150")
    )


@query("p18_template_reply")
def _(spark, sf):
    return tickets(spark, sf).select(
        "ticket_id", text.template_reply("product_area", "sla_plan").alias("reply")
    )


@query("p19_prompt")
def _(spark, sf):
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", text.reply_prompt("role", F.lit(None).cast("string"), "text").alias("prompt")
    )


@query("p20_rename_reorder")
def _(spark, sf):
    return (
        raw_customers(spark, sf).withColumnRenamed("country", "country_dim").drop("pos", "balance")
        .select("country_dim", "customer_id", "name")
    )


# ---- filters -------------------------------------------------------------------------------------


@query("f01_have_value")
def _(spark, sf):
    return aggregate.have(tickets(spark, sf), "resolution_time_hours", "customer_sentiment").select(
        "ticket_id", "resolution_time_hours", "customer_sentiment"
    )


@query("f02_respondents")
def _(spark, sf):
    return aggregate.respondents(cleaning.with_response(tickets(spark, sf))).select("ticket_id", "csat_score")


@query("f02_respondents_by_score")
def _(spark, sf):
    return aggregate.respondents(tickets(spark, sf)).select("ticket_id", "csat_score")


@query("f03_needs_fill")
def _(spark, sf):
    return raw(spark, sf).select("ticket_id", "region", parse.needs_fill("region").alias("needs_fill"))


@query("f04_closed_without_text")
def _(spark, sf):
    return raw(spark, sf).filter(parse.closed_without_text("status", "resolution_summary")).select(
        "ticket_id", "status", "resolution_summary"
    )


@query("f05_longer_than")
def _(spark, sf):
    return table(spark, sf, "conversations").filter(parse.longer_than("text", 400)).select("conv_id", "turn")


@query("f06_group_size")
def _(spark, sf):
    by_customer = stats.by_factor(tickets(spark, sf), ("customer_id", "priority"), "resolution_time_hours")
    return stats.eligible_levels(by_customer)


@query("f07_enough_rows")
def _(spark, sf):
    answers = aggregate.respondents(tickets(spark, sf))
    sizes = (1, models.MIN_RESPONDENTS, 1_000_000_000)
    return spark.createDataFrame([(n, models.enough(answers, n)) for n in sizes], "needed long, enough boolean")


# ---- updates -------------------------------------------------------------------------------------


@query("u01_impute_region")
def _(spark, sf):
    repaired, _counters = repair.impute_regions(tickets(spark, sf), lookup(spark, sf))
    return repaired.select("ticket_id", "customer_id", "region")


@query("u02_fill_summary")
def _(spark, sf):
    return repair.fill_summaries(tickets(spark, sf)).select("ticket_id", "status", "resolution_summary")


@query("u02_fill_count")
def _(spark, sf):
    return repair.summary_gaps(tickets(spark, sf))


# ---- joins ---------------------------------------------------------------------------------------


@query("j01_left_enrich")
def _(spark, sf):
    wide = join.enrich(tickets(spark, sf), customers(spark, sf), "customer_id")
    return wide.select("ticket_id", "customer_id", "name", "balance", "country", "region")


@query("j01_orders_enrich")
def _(spark, sf):
    orders = table(spark, sf, "orders").withColumnRenamed("o_custkey", "c_custkey")
    people = table(spark, sf, "customer")
    return join.enrich(orders, people, "c_custkey").select("o_orderkey", "c_custkey", "c_name", "c_mktsegment")


@query("j02_lookup_fill")
def _(spark, sf):
    wide = tickets(spark, sf).withColumn("country", F.when(F.col("k") % 3 == 0, "France"))
    return join.lookup_filling(wide, lookup(spark, sf), "customer_id", "country").select("ticket_id", "country")


@query("j03_lookup_first")
def _(spark, sf):
    fact = dimension.fact_tickets(tickets(spark, sf)).select("ticket_id", "priority")
    other = raw(spark, sf)
    return join.lookup_first(fact, other, "ticket_id", ["created_at", "customer_segment", "absent"], "k").select(
        "ticket_id", "priority", "created_at", "customer_segment"
    )


@query("j04_dictionary_default")
def _(spark, sf):
    return join.map_values(
        raw(spark, sf), "sla_plan", aggregate.SLA_HOURS, aggregate.DEFAULT_SLA_HOURS, "sla_limit", normalise=False
    ).select("ticket_id", "sla_plan", "sla_limit")


@query("j05_key_coverage")
def _(spark, sf):
    return join.key_coverage(tickets(spark, sf), customers(spark, sf), "customer_id")


@query("j05_orphan_keys")
def _(spark, sf):
    return join.orphans(tickets(spark, sf), customers(spark, sf), "customer_id")


# ---- dedupe and dimensions -----------------------------------------------------------------------


@query("d01_drop_exact")
def _(spark, sf):
    return dedupe.drop_exact(raw(spark, sf, texts=True).select(*TICKET_COLUMNS), long_rows=True)


@query("d01_drop_exact_in_place")
def _(spark, sf):
    """Documents told apart by all but their id: texts that occur once are not moved."""
    return dedupe.drop_exact_in_place(table(spark, sf, "documents").drop("doc_id"))


@query("d01_exact_copies")
def _(spark, sf):
    return dedupe.exact_copies(raw(spark, sf, texts=True).select(*TICKET_COLUMNS), long_rows=True)


@query("d01_clean_tickets")
def _(spark, sf):
    return tickets(spark, sf).select(*PLAIN_COLUMNS)


@query("d02_keep_first")
def _(spark, sf):
    return cleaning.clean_customers(raw_customers(spark, sf), "pos")


@query("d02_first_per_user")
def _(spark, sf):
    return dedupe.keep_first(
        table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type"), "user_id",
        F.struct("ts", "event_id"),
    )


@query("d03_duplicate_keys")
def _(spark, sf):
    return dedupe.duplicate_keys(raw_customers(spark, sf), "customer_id")


@query("d03_duplicate_summary")
def _(spark, sf):
    return dedupe.duplicate_summary(raw_customers(spark, sf), "customer_id")


@query("d04_dim_channel")
def _(spark, sf):
    return dimension.dimension(tickets(spark, sf), "channel", "channel")


@query("d04_dim_product_area")
def _(spark, sf):
    return dimension.dimension(tickets(spark, sf), "product_area", "product_area")


@query("d04_dim_part")
def _(spark, sf):
    return dimension.dimension(table(spark, sf, "part"), "p_name", "part")


@query("d05_label_list")
def _(spark, sf):
    return dimension.label_list(tickets(spark, sf), "customer_sentiment")


# ---- profiles, aggregates and statistics ---------------------------------------------------------

def wide_table(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned tickets with all columns of their customers."""
    return join.enrich(tickets(spark, sf).drop("k"), customers(spark, sf), "customer_id")


def _missing(spark: SparkSession, sf: str, blank_as_missing: bool) -> DataFrame:
    """The profile of the wide table with both texts, which the join gets as marks."""
    rows = profile.marked(tickets(spark, sf, texts=True).drop("k"), ["customer_id"], blank_as_missing)
    return profile.missing_profile(join.enrich(rows, customers(spark, sf), "customer_id"), blank_as_missing=blank_as_missing)


@query("a01_missing_profile")
def _(spark, sf):
    return _missing(spark, sf, False)


@query("a01_missing_profile_blank")
def _(spark, sf):
    return _missing(spark, sf, True)


@query("a02_describe")
def _(spark, sf):
    rows = wide_table(spark, sf)
    described = profile.describe(stage(rows, *profile.numeric_columns(rows)))
    return rounded(described, [c for c in described.columns if c != "column"])


@query("a02_describe_lineitem")
def _(spark, sf):
    columns = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
    described = profile.describe(table(spark, sf, "lineitem"), columns)
    return rounded(described, [c for c in described.columns if c != "column"])


@query("a03_group_stats")
def _(spark, sf):
    return rounded(stats.level_summary(factors(spark, sf)), ["mean", "median", "std"])


@query("a03_orders_by_priority")
def _(spark, sf):
    long = stats.by_factor(table(spark, sf, "orders"), ("o_orderpriority", "o_orderstatus"), "o_totalprice")
    return rounded(stats.level_summary(long), ["mean", "median", "std"])


@query("a04_overall")
def _(spark, sf):
    rows = stage(tickets(spark, sf), "resolution_time_hours")
    return rounded(stats.overall_summary(rows, "resolution_time_hours"), ["mean", "median"])


@query("a05_month_priority")
def _(spark, sf):
    return aggregate.group_sizes(dated(spark, sf), ["month", "priority"])


@query("a06_cross_tab")
def _(spark, sf):
    return aggregate.cross_tab(dated(spark, sf), "month", "priority")


@query("a06_cross_tab_rest")
def _(spark, sf):
    return aggregate.cross_tab(dated(spark, sf), "month", "priority", ["urgent", "high"])


@query("a06_cross_tab_cells")
def _(spark, sf):
    """The map of each month, as JSON so that it can be compared."""
    found = aggregate.cross_tab_cells(dated(spark, sf), "month", "priority")
    return found.select("month", F.to_json("cells").alias("cells"))


@query("a07_value_counts")
def _(spark, sf):
    return aggregate.value_counts(tickets(spark, sf), "customer_sentiment")


@query("a08_sla_rate")
def _(spark, sf):
    return rounded(aggregate.sla_rate(tickets(spark, sf)), ["sla_rate"])


@query("a09_histogram")
def _(spark, sf):
    rows = stage(tickets(spark, sf), "resolution_time_hours")
    bins = aggregate.histogram(rows, "resolution_time_hours", stats.HISTOGRAM_BINS)
    return rounded(bins, ["bin_start", "bin_end"])


@query("a09_csat_histogram")
def _(spark, sf):
    scores = stage(aggregate.respondents(tickets(spark, sf)), "csat_score")
    return rounded(aggregate.histogram(scores, "csat_score", 5), ["bin_start", "bin_end"])


@query("a09_dashboard")
def _(spark, sf):
    """The star of cleaned tickets and customers, and from it the panels of the dashboard stage."""
    star = stages.build_star(stage(tickets(spark, sf)), customers(spark, sf))
    panels = stages.dashboard_tables(star["fact_tickets"], star["tickets_enriched"])
    return rounded(stages.dashboard_values(panels), ["value"])


@query("a10_density")
def _(spark, sf):
    rows = stage(tickets(spark, sf), "resolution_time_hours")
    curve = stats.density(rows, "resolution_time_hours", bins=stats.HISTOGRAM_BINS)
    return rounded(curve, ["x", "density"])


@query("a11_density_by_priority")
def _(spark, sf):
    rows = stage(tickets(spark, sf), "priority", "resolution_time_hours")
    curve = stats.density(rows, "resolution_time_hours", ["priority"], stats.VIOLIN_GRID)
    return rounded(curve, ["x", "density"])


@query("a12_box_stats")
def _(spark, sf):
    return rounded(stats.box_stats(factors(spark, sf)), ["q1", "median", "q3", "whisker_low", "whisker_high"])


@query("a13_anova")
def _(spark, sf):
    return rounded(stats.anova(factors(spark, sf)), ["f", "p_value"])


@query("a13_anova_orders")
def _(spark, sf):
    long = stats.by_factor(table(spark, sf, "orders"), ("o_orderpriority", "o_orderstatus"), "o_totalprice")
    return rounded(stats.anova(long), ["f", "p_value"])


@query("a13_anova_p_value")
def _(spark, sf):
    return rounded(stats.anova(factors(spark, sf)), ["f", "p_value"])


@query("a13_anova_p_value_orders")
def _(spark, sf):
    long = stats.by_factor(table(spark, sf, "orders"), ("o_orderpriority", "o_orderstatus"), "o_totalprice")
    return rounded(stats.anova(long), ["f", "p_value"])


@query("a14_response_rate")
def _(spark, sf):
    return rounded(repair.response_rate(cleaning.with_response(tickets(spark, sf))), ["response_rate"])


@query("a15_region_counters")
def _(spark, sf):
    return repair.region_counters(repair.mark_regions(tickets(spark, sf), lookup(spark, sf)))


@query("a16_date_range")
def _(spark, sf):
    return dimension.date_range(tickets(spark, sf), "created_at")


@query("a17_confusion_matrix")
def _(spark, sf):
    return evaluate.confusion_matrix(predicted(spark, sf), "customer_sentiment", "predicted")


@query("a17_confusion_matrix_rest")
def _(spark, sf):
    return evaluate.confusion_matrix(predicted(spark, sf), "customer_sentiment", "predicted", ["negative", "positive"])


@query("a17_confusion_cells")
def _(spark, sf):
    found = evaluate.confusion_cells(predicted(spark, sf), "customer_sentiment", "predicted")
    return found.select("label", F.to_json("cells").alias("cells"))


@query("a18_classification_report")
def _(spark, sf):
    report = evaluate.classification_report(predicted(spark, sf), "customer_sentiment", "predicted")
    return rounded(report, ["precision", "recall", "f1"])


@query("a19_regression_errors")
def _(spark, sf):
    guessed = tickets(spark, sf).withColumn(
        "guess", F.col("resolution_time_hours") * 0.9 + (F.col("k") % 7).cast("double")
    )
    return rounded(evaluate.regression_errors(guessed, "resolution_time_hours", "guess"), ["rmse", "mae", "r2"])


# ---- sorts, samples, calendar --------------------------------------------------------------------


@query("o01_sort")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", "c_acctbal").orderBy(F.desc("c_acctbal"), "c_custkey")


@query("o02_top_k")
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return aggregate.top_k(orders, 20, "o_totalprice", "o_orderkey")


@query("o03_sample")
def _(spark, sf):
    return sample.sample_exact(stage(tickets(spark, sf), "ticket_id", "priority"), 500, "ticket_id", SEED)


@query("o04_calendar")
def _(spark, sf):
    return dimension.calendar(tickets(spark, sf), "created_at")


@query("o04_calendar_orders")
def _(spark, sf):
    return dimension.calendar(table(spark, sf, "orders"), "o_orderdate")


@query("o05_split")
def _(spark, sf):
    return sample.split_hash(tickets(spark, sf), "ticket_id", SEED).select("ticket_id", "is_test")


@query("o05_split_stratified")
def _(spark, sf):
    rows = stage(aggregate.have(tickets(spark, sf), "customer_sentiment"), "ticket_id", "customer_sentiment")
    return sample.split_exact(rows, "ticket_id", SEED, by="customer_sentiment")


# ---- text features -------------------------------------------------------------------------------


@query("m01_terms")
def _(spark, sf):
    return features.term_rows(messages(spark, sf), "doc_id", "text")


@query("m02_vocabulary")
def _(spark, sf):
    return rounded(features.vocabulary(messages(spark, sf), "text", 2500, 5), ["idf"])


@query("m02_tfidf_rows")
def _(spark, sf):
    return rounded(features.tfidf_rows(messages(spark, sf), "doc_id", "text", 2500, 5), ["weight"])


@query("m03_one_hot")
def _(spark, sf):
    rows = stage(tickets(spark, sf), "ticket_id", *models.CSAT_CATEGORIES)
    return _slots(features.apply_stages(rows, features.category_stages(rows, models.CSAT_CATEGORIES)))


@query("m03_dictionary_slots")
def _(spark, sf):
    """The same slots from a dictionary that is a table."""
    rows = stage(tickets(spark, sf), "ticket_id", *models.CSAT_CATEGORIES)
    found = features.with_slots(rows, features.category_dictionary(rows, models.CSAT_CATEGORIES), models.CSAT_CATEGORIES)
    return found.drop(*models.CSAT_CATEGORIES)


def _slots(encoded: DataFrame) -> DataFrame:
    """The filled slot of each category vector, and the vector's size."""
    arrays = {c: vector_to_array(f"_{c}_vector") for c in models.CSAT_CATEGORIES}
    return encoded.select(
        "ticket_id",
        *[(F.array_position(a, 1.0) - 1).alias(f"{c}_slot") for c, a in arrays.items()],
        *[F.size(a).alias(f"{c}_size") for c, a in arrays.items()],
    )


@query("m04_features")
def _(spark, sf):
    rows = stage_table(messages(spark, sf, "lang", "source"))
    return _cells(features.apply_stages(rows, features.feature_stages(rows, "text", ("lang", "source"), 2500, 5)))


def _cells(vectors: DataFrame) -> DataFrame:
    """The cells of the feature vectors that are not zero."""
    cells = F.transform(vector_to_array("features"), lambda v, i: F.struct(i.alias("position"), v.alias("value")))
    return rounded(vectors.select("doc_id", F.inline(F.filter(cells, lambda c: c["value"] != 0.0))), ["value"])


@query("m10_batch_scoring")
def _(spark, sf):
    """Text vectors of a pipeline that was fitted, saved and scored again on the whole table."""
    rows = stage_table(messages(spark, sf))
    path = scratch_path(spark, "model")
    tables.save_model(PipelineModel(features.text_stages(rows, "text", 2500, 5, into="features")), path)
    return _cells(models.score(path, rows))


@query("m08_class_weights")
def _(spark, sf):
    return rounded(features.class_weights(tickets(spark, sf), "customer_sentiment"), ["weight"])


@query("m08_weighted_rows")
def _(spark, sf):
    rows = aggregate.have(tickets(spark, sf), "customer_sentiment")
    return rounded(
        features.with_class_weight(rows, "customer_sentiment").select("ticket_id", "class_weight"), ["class_weight"]
    )


# ---- fitted models (row checks) ------------------------------------------------------------------

ALL_ROWS = models.SentimentSettings(max_rows=None)


def _answers(spark, sf):
    """What the satisfaction forest needs of the tickets."""
    return stage(tickets(spark, sf, texts=True), "ticket_id", "initial_message", "csat_score", *models.CSAT_CATEGORIES)


# Pipelines that were fitted in this session, by name and folder of the tables: several queries read one model.
_fitted: dict[tuple[str, str, str], str] = {}


def fitted(spark: SparkSession, sf: str, name: str, train: Callable[[], models.Trained]) -> str:
    """The folder of a model (pipeline), its scored hold-out rows and their metrics, made once for a session."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _fitted:
        trained = train()
        ensure_checkpoint_dir(spark)
        path = f"{spark.sparkContext.getCheckpointDir()}/fitted-{name}-{uuid.uuid4().hex}"
        tables.save_model(trained.model, f"{path}/model")
        trained.scored.write.parquet(f"{path}/scored")
        trained.metrics.write.parquet(f"{path}/metrics")
        _fitted[key] = path
    return _fitted[key]


def csat_forest(spark, sf) -> str:
    return fitted(spark, sf, "csat", lambda: models.train_csat(_answers(spark, sf)))


def _resolution_rows(spark, sf):
    texts = ("ticket_id", "initial_message", "agent_first_reply", "resolution_time_hours")
    return stage(tickets(spark, sf, texts=True), *texts, *models.RESOLUTION_CATEGORIES)


def resolution_forest(spark, sf) -> str:
    return fitted(spark, sf, "resolution", lambda: models.train_resolution(_resolution_rows(spark, sf)))


@query("m05_csat_forest")
def _(spark, sf):
    return spark.read.parquet(f"{csat_forest(spark, sf)}/metrics")


@query("m06_resolution_forest")
def _(spark, sf):
    return spark.read.parquet(f"{resolution_forest(spark, sf)}/metrics")


def _from_node_rows(spark: SparkSession, path: str, rows: DataFrame, settings: models.ForestSettings, scored: str = "") -> DataFrame:
    """ticket_id of the hold-out rows, and whether joins with the stored nodes give the model's prediction."""
    model = tables.load_model(f"{path}/model")
    place = next(k for k, s in enumerate(model.stages) if isinstance(s, forest.ForestModel))
    held = stage_table(PipelineModel(model.stages[:place]).transform(rows).select("ticket_id", "features"))
    nodes = spark.read.schema(forest.NODES).parquet(f"{path}/model/stages/*_ForestModel_*/nodes")
    told = forest.score_by_join(held, nodes, "ticket_id", "features", settings.trees, settings.depth)
    scored = spark.read.parquet(scored or f"{path}/scored").select("ticket_id", F.col("prediction").alias("scored"))
    return told.join(scored, "ticket_id").select("ticket_id", (F.abs(F.col("prediction") - F.col("scored")) < 1e-9).alias("agrees"))


@query("m05_scored_from_rows")
def _(spark, sf):
    rows = sample.split_exact(aggregate.respondents(_answers(spark, sf)), "ticket_id", SEED).filter("is_test")
    return _from_node_rows(spark, csat_forest(spark, sf), rows, models.CSAT)


@query("m06_scored_from_rows")
def _(spark, sf):
    rows = aggregate.have(_resolution_rows(spark, sf), "resolution_time_hours")
    rows = rows.withColumn("text", text.join_texts("initial_message", "agent_first_reply"))
    rows = sample.split_exact(stage_table(rows), "ticket_id", SEED).filter("is_test")
    path = resolution_forest(spark, sf)
    hours = spark.read.parquet(f"{path}/scored")
    # The model maps back to hours; the nodes hold logs of them.
    hours.select("ticket_id", F.log1p("prediction").alias("prediction")).write.parquet(logs := scratch_path(spark, "logs"))
    return _from_node_rows(spark, path, rows, models.RESOLUTION, logs)


@query("a20_feature_importance")
def _(spark, sf):
    model = tables.load_model(f"{csat_forest(spark, sf)}/model")
    return models.feature_importance(model, models.CSAT_CATEGORIES, table(spark, sf, "documents"))


@query("m07_sentiment")
def _(spark, sf):
    rows = tickets(spark, sf, texts=True).select("ticket_id", "initial_message", "customer_sentiment")
    return models.train_sentiment(models.sentiment_rows(rows), settings=ALL_ROWS).metrics


def _quality(spark, sf, settings: models.SentimentSettings = ALL_ROWS) -> models.Trained:
    """A classifier of the labelled documents."""
    labelled = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return models.train_sentiment(models.sentiment_rows(labelled, "doc_id", "text", "quality"), "doc_id", settings)


@query("m07_document_quality")
def _(spark, sf):
    return _quality(spark, sf).metrics


# At the optimum the slope of the loss and the pull of the penalty cancel. What is left may be this share of the pull.
LEFT = 0.02


@query("m07_quality_optimal")
def _(spark, sf):
    """Of each class the training rows, and whether the loss has no slope at the stored coefficients of a fit that was run
    until nothing moved."""
    trained = _quality(spark, sf, replace(ALL_ROWS, iterations=2000, tolerance=1e-9))
    rows = linear.coefficient_rows(trained.model, trained.scored)
    penalty = 1.0 / trained.n_train
    slopes = linear.gradient(trained.fitted_on, "doc_id", "features", "label", "class_weight", rows, penalty)
    length = slopes.groupBy("class").agg(F.sqrt(F.sum(F.col("slope") * F.col("slope"))).alias("length"))
    pull = rows.filter(F.col("position") >= 0).groupBy("class").agg((F.sqrt(F.sum(F.col("weight") * F.col("weight"))) * penalty).alias("pull"))
    sizes = trained.fitted_on.groupBy(F.col("label").alias("class")).agg(F.count("*").alias("n_train"))
    return sizes.join(length, "class").join(pull, "class").select("class", "n_train", (F.col("length") < LEFT * F.col("pull")).alias("optimal"))


def _every_document(spark, sf) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", text.normalise("text").alias("text"))


@query("m09_fit_predict")
def _(spark, sf):
    return _quality(spark, sf).model.transform(_every_document(spark, sf)).select("doc_id", "predicted")


@query("m09_scored_from_rows")
def _(spark, sf):
    """Whether joins with the stored coefficients give each document the model's class."""
    trained = _quality(spark, sf)
    rows = linear.coefficient_rows(trained.model, trained.scored)
    scored = stage_table(trained.model.transform(_every_document(spark, sf)).select("doc_id", "features", "predicted"))
    told = linear.score_rows(scored, "doc_id", "features", rows).withColumnRenamed("predicted", "told")
    return scored.join(told, "doc_id").select("doc_id", (F.col("predicted") == F.col("told")).alias("agrees"))


# ---- replies -------------------------------------------------------------------------------------


@query("x02_reply_examples")
def _(spark, sf):
    wanted = ("ticket_id", "priority", "issue_type", "product_area", "sla_plan", "initial_message", "agent_first_reply")
    return replies.reply_examples(tickets(spark, sf, texts=True).select(*wanted))


@query("x02_all_replies")
def _(spark, sf):
    return replies.reply_examples(tickets(spark, sf, texts=True), n=None)


def _length_replies():
    def generate(prompts):
        return [f"Reply to {len(p)} characters" if len(p) % 2 == 0 else None for p in prompts]

    return generate


@query("x03_generated_replies")
def _(spark, sf):
    return replies.reply_examples(tickets(spark, sf, texts=True), n=None, load=_length_replies)


# ---- the slice -----------------------------------------------------------------------------------


def sla_by_segment(spark: SparkSession, sf: str) -> DataFrame:
    """Flagship: service-level compliance by customer segment, from raw tickets."""
    return QUERIES["a08_sla_rate"](spark, sf)

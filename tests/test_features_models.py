"""Text features, evaluation and small fitted models on planted signal."""

import math

import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator, RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from ticketlens.operators import evaluate, features, models
from ticketlens.sources import tables

SMALL = models.ForestSettings(max_features=100, min_df=2, trees=5, depth=4, max_rows=None)
SMALL_SENTIMENT = models.SentimentSettings(max_features=100, min_df=2, iterations=50, max_rows=None)


def documents(spark):
    rows = [(1, "red apple red"), (2, "green apple"), (3, "red car"), (4, ""), (5, None), (6, "zzz")]
    return spark.createDataFrame(rows, "id long, text string")


def planted(spark, n=600):
    """Tickets whose words decide score, hours and sentiment."""
    i = F.col("id")
    good = i % 2 == 0
    noise = F.concat(F.lit(" word"), (i % 7).cast("string"), F.lit(" other"), (i % 11).cast("string"))
    return spark.range(n).select(
        i.cast("string").alias("ticket_id"),
        F.concat(F.when(good, "splendid help").otherwise("terrible wait"), noise).alias("initial_message"),
        F.lit(" ok ").alias("agent_first_reply"),
        F.when(good, 5).otherwise(1).cast("long").alias("csat_score"),
        F.when(i % 10 < 8, F.when(good, 2.0).otherwise(60.0)).alias("resolution_time_hours"),
        F.when(good, "positive").when(i % 3 == 0, "negative").otherwise("negative").alias("customer_sentiment"),
        F.when(i % 4 == 0, F.lit(None)).otherwise("web").alias("channel"),
        F.lit("high").alias("priority"),
    )


def test_vocabulary_rules(spark):
    rows = features.vocabulary(documents(spark), "text", 3, 1).orderBy(F.desc("total"), "term").collect()
    assert [(r.term, r.total, r.df) for r in rows] == [("red", 3, 2), ("apple", 2, 2), ("apple red", 1, 1)]
    assert rows[0].idf == pytest.approx(math.log(7 / 3) + 1)
    assert {r.term for r in features.vocabulary(documents(spark), "text", 9, 2).collect()} == {"red", "apple"}


def test_vector_form_equals_row_form(spark):
    train, other = documents(spark), spark.createDataFrame([(9, "red red unseen apple")], "id long, text string")
    stages = features.text_stages(train, "text", 50, 1)
    names = stages[1].vocabulary
    for df in (train, other):
        vectors = features.apply_stages(df, stages).select("id", vector_to_array("text_vector").alias("v")).collect()
        from_vectors = {(r.id, names[i]): w for r in vectors for i, w in enumerate(r.v) if w}
        long = features.tfidf_rows(df, "id", "text", 50, 1, fit_on=train.fillna("", ["text"])).collect()
        from_rows = {(r.id, r.term): r.weight for r in long}
        assert set(from_rows) == set(from_vectors) and len(from_rows) >= 2
        assert all(from_rows[k] == pytest.approx(from_vectors[k]) for k in from_rows)
        for key in {k for k, _ in from_rows}:
            assert sum(w * w for (k, _), w in from_rows.items() if k == key) == pytest.approx(1.0)


def test_one_hot_missing_and_unseen(spark):
    train = spark.createDataFrame([("a",), ("b",), (None,)], "c string")
    stages = features.category_stages(train, ["c"])
    test = spark.createDataFrame([("a",), (None,), ("new",)], "c string")
    vectors = [r[0].toArray().tolist() for r in features.apply_stages(test, stages).select("_c_vector").collect()]
    assert [sum(v) for v in vectors] == [1.0, 1.0, 0.0] and vectors[0] != vectors[1]
    assert {len(v) for v in vectors} == {3}


def test_class_weights(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 2 + [(None,)], "c string")
    weights = {r.c: r.weight for r in features.class_weights(df, "c").collect()}
    assert weights == {"a": 8 / (2 * 6), "b": 8 / (2 * 2)}
    weighted = features.with_class_weight(df.filter("c is not null"), "c")
    assert weighted.agg(F.sum("class_weight")).first()[0] == pytest.approx(8.0)


def test_csat_forest_finds_the_term(spark, tmp_path):
    rows = planted(spark)
    trained = models.train_csat(rows, settings=SMALL)
    metrics = trained.metrics.first()
    assert metrics.rmse < 1.0 and metrics.r2 > 0.7 and metrics.n == 120
    top = models.feature_importance(trained.model, ("priority", "channel"), rows)
    decisive = {"splendid", "help", "splendid help", "terrible", "wait", "terrible wait"}
    assert top.first().feature in decisive and top.count() <= 20
    check = RegressionEvaluator(labelCol="actual", metricName="r2").evaluate(trained.scored)
    assert metrics.r2 == pytest.approx(check)
    path = str(tmp_path / "model")
    tables.save_model(trained.model, path)
    before = {r.ticket_id: r.prediction for r in trained.model.transform(rows).collect()}
    after = {r.ticket_id: r.prediction for r in models.score(path, rows).collect()}
    assert before == after and len(after) == 600


def test_resolution_forest_in_hours(spark):
    metrics = models.train_resolution(planted(spark), settings=SMALL).metrics.first()
    assert metrics.mae < 15 and metrics.r2 > 0.7


def test_sentiment_beats_majority(spark):
    rows = models.sentiment_rows(planted(spark))
    trained = models.train_sentiment(rows, settings=SMALL_SENTIMENT)
    report = {r["class"]: r for r in trained.metrics.collect()}
    assert report["accuracy"].f1 > 0.95 and report["accuracy"].support == 120
    assert {"positive", "negative", "macro avg", "weighted avg"} < set(report)


def test_single_row_class_is_not_stratified(spark):
    one = planted(spark, 1).withColumn("ticket_id", F.lit("x")).withColumn("customer_sentiment", F.lit("odd"))
    rows = models.sentiment_rows(planted(spark, 300).unionByName(one))
    trained = models.train_sentiment(rows, settings=SMALL_SENTIMENT)
    assert trained.scored.count() == math.ceil(0.2 * 301)


def test_too_few_answers(spark):
    with pytest.raises(ValueError, match="survey answers"):
        models.train_csat(planted(spark, 199), settings=SMALL)
    assert models.enough(planted(spark, 200), 200) and not models.enough(planted(spark, 199), 200)


def test_sentiment_rows_need_text(spark):
    rows = [("1", "short", "a"), ("2", "long enough", "a"), ("3", None, "a"), ("4", "long enough", None)]
    df = spark.createDataFrame(rows, "ticket_id string, initial_message string, customer_sentiment string")
    assert [r.ticket_id for r in models.sentiment_rows(df).collect()] == ["2"]


def predictions(spark):
    pairs = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("c", "a")] + [("b", "d")]
    return spark.createDataFrame(pairs, "y string, p string")


def test_report_against_evaluator(spark):
    df = predictions(spark)
    report = {r["class"]: r for r in evaluate.classification_report(df, "y", "p").collect()}
    assert report["c"].f1 == 0.0 and report["d"].support == 0 and report["d"].precision == 0.0
    number = F.ascii
    coded = df.select(number("y").cast("double").alias("label"), number("p").cast("double").alias("prediction"))
    for metric, value in {
        "accuracy": report["accuracy"].f1,
        "weightedPrecision": report["weighted avg"].precision,
        "weightedRecall": report["weighted avg"].recall,
        "f1": report["weighted avg"].f1,
    }.items():
        assert MulticlassClassificationEvaluator(metricName=metric).evaluate(coded) == pytest.approx(value)
    assert report["macro avg"].recall == pytest.approx((5 / 7 + 3 / 4 + 0 + 0) / 4)


def test_confusion_matrix_keeps_zeros(spark):
    rows = [tuple(r) for r in evaluate.confusion_matrix(predictions(spark), "y", "p").collect()]
    assert rows == [("a", 5, 2, 0, 0), ("b", 0, 3, 0, 1), ("c", 1, 0, 0, 0), ("d", 0, 0, 0, 0)]
    assert sum(sum(r[1:]) for r in rows) == predictions(spark).count()


def test_confusion_matrix_of_given_labels_keeps_all_rows(spark):
    rows = [tuple(r) for r in evaluate.confusion_matrix(predictions(spark), "y", "p", ["a", "q"]).collect()]
    assert rows == [("a", 5, 0, 2), ("q", 0, 0, 0), ("(other)", 1, 0, 4)]


def test_classifier_has_the_classes_it_saw(spark):
    rows = models.sentiment_rows(planted(spark))
    trained = models.train_sentiment(rows, settings=SMALL_SENTIMENT)
    classifier = next(s for s in trained.model.stages if hasattr(s, "numClasses"))
    assert classifier.numClasses == rows.select("label").distinct().count()
    assert trained.scored.filter("predicted is null").count() == 0
    assert trained.n_train + trained.scored.count() == rows.count()


def test_row_cap_spares_the_held_out_rows(spark):
    rows = models.sentiment_rows(planted(spark))
    capped = models.train_sentiment(rows, settings=models.SentimentSettings(100, 2, 20, max_rows=100))
    assert capped.n_train == 100 and capped.scored.count() == math.ceil(0.2 * rows.count())
    assert models.CSAT.max_rows is None and models.RESOLUTION.max_rows is None


def test_report_of_stored_predictions(spark, tmp_path):
    """The scoring of a fitted model against plain counting on its written predictions."""
    rows = models.sentiment_rows(planted(spark))
    scored = tables.write_table(models.train_sentiment(rows, settings=SMALL_SENTIMENT).scored, str(tmp_path / "scored"))
    pairs = [(r.label, r.predicted) for r in scored.collect()]
    report = {r["class"]: r for r in evaluate.classification_report(scored, "label", "predicted").collect()}
    assert report["accuracy"].f1 == pytest.approx(sum(a == b for a, b in pairs) / len(pairs))
    for name in {a for a, _ in pairs}:
        hit = sum(a == b == name for a, b in pairs)
        assert report[name].recall == pytest.approx(hit / sum(a == name for a, _ in pairs))


def test_regression_errors_of_constant_target(spark):
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 1.0)], "y double, p double")
    row = evaluate.regression_errors(df, "y", "p").first()
    assert (row.n, row.mae, row.r2) == (2, 0.5, None)


def test_dictionary_of_very_many_levels(spark):
    """Slots without a gap over several partitions, in order, and zeros for what the dictionary does not have."""
    wide = spark.range(200_000).selectExpr("concat(repeat('x', 40), id % 150000) AS a", "if(id % 3 = 0, null, id % 7) AS b")
    dictionary = features.category_dictionary(wide, ["a", "b"])
    sizes = {r["column"]: (r.n, r.low, r.high, r.slots) for r in dictionary.groupBy("column").agg(
        F.count("*").alias("n"), F.min("slot").alias("low"), F.max("slot").alias("high"), F.countDistinct("slot").alias("slots")).collect()}
    assert sizes == {"a": (150_000, 0, 149_999, 150_000), "b": (8, 0, 7, 8)}
    b = [r.value for r in dictionary.filter("`column` = 'b'").orderBy("slot").collect()]
    assert b == sorted(b) and b[0] == "(missing)"
    new = spark.createDataFrame([("unseen", None), (None, 6)], "a string, b long")
    rows = features.with_slots(new, dictionary, ["a", "b"]).orderBy("b").collect()
    assert [(r.a_slot, r.a_size, r.b_slot) for r in rows] == [(None, 150_000, 0), (None, 150_000, 7)]


def test_dictionary_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "a string")
    dictionary = features.category_dictionary(empty, ["a"])
    assert dictionary.isEmpty() and features.with_slots(spark.createDataFrame([("q",)], "a string"), dictionary, ["a"]).first().a_size == 0

import json
import random

import pytest
from pyspark.sql import functions as F

from cuemill.operators.agreement import agreement, cohen_kappa
from cuemill.operators.metrics import (
    best_model,
    class_weights,
    comparison_report,
    confusion_long,
    confusion_metrics,
    feed_quality,
    fold_metrics,
    hedge_rate,
    label_distribution,
    melt_metrics,
    metrics_by_source,
    report_json,
    roc_auc,
    roc_curve,
    round_metrics,
    score_stats,
    step_counts,
    summary,
    with_macro_f1,
)
from cuemill.plans.training import error_analysis, keyword_baseline_eval, model_predictions


def frame(spark, rows):
    return spark.createDataFrame(rows, "gold_label int, prediction int")


def test_confusion_of_a_known_table(spark):
    df = frame(spark, [(1, 1)] * 18 + [(0, 0)] * 29 + [(0, 1)] * 15 + [(1, 0)] * 2)
    row = with_macro_f1(confusion_metrics(df)).first()
    assert (row["tp"], row["tn"], row["fp"], row["fn"]) == (18, 29, 15, 2)
    assert row["accuracy"] == pytest.approx(0.734375) and row["precision"] == pytest.approx(18 / 33)
    assert row["recall"] == pytest.approx(0.9) and row["f1"] == pytest.approx(0.6792452830188679)
    assert row["f1_macro"] == pytest.approx(0.7262893081761006)
    assert [tuple(r) for r in confusion_long(df).orderBy("actual", "pred").collect()] == [
        (0, 0, 29), (0, 1, 15), (1, 0, 2), (1, 1, 18)]


def test_empty_denominators_are_zero(spark):
    for rows in ([], [(0, 0)], [(1, 0)], [(0, 1)]):
        row = confusion_metrics(frame(spark, rows)).first()
        assert row["precision"] == row["recall"] == row["f1"] == 0.0
    assert [r["n"] for r in confusion_long(frame(spark, [])).collect()] == [0] * 4


def brute_auc(rows):
    pos, neg = [s for y, s in rows if y], [s for y, s in rows if not y]
    return sum((p > n) + (p == n) / 2 for p in pos for n in neg) / (len(pos) * len(neg))


def test_auc_and_curve(spark):
    rng = random.Random(2)
    # A third of the scores are one value; the rest are mostly distinct.
    groups = {"a": [(rng.randint(0, 1), rng.choice([0.5, rng.random(), rng.random()])) for _ in range(400)],
              "b": [(int(i % 7 == 0), round(rng.random(), 1)) for i in range(200)]}
    df = spark.createDataFrame([(g, y, s) for g, rows in groups.items() for y, s in rows]
                               + [("a", 1, None), ("a", 0, float("nan"))], "model string, y int, s double")
    for buckets in (2, 16, 256):
        out = {r["model"]: r["auc"] for r in roc_auc(df, "y", "s", ["model"], buckets).collect()}
        assert out == {g: pytest.approx(brute_auc(rows), abs=1e-12) for g, rows in groups.items()}
        curve = roc_curve(df, "y", "s", ["model"], buckets).collect()
        for g, rows in groups.items():
            p, n = sum(y for y, _ in rows), sum(1 - y for y, _ in rows)
            points = sorted((r["threshold"], r["fpr"], r["tpr"]) for r in curve if r["model"] == g)
            assert points == [
                (t, pytest.approx(sum(s >= t for y, s in rows if not y) / n),
                 pytest.approx(sum(s >= t for y, s in rows if y) / p))
                for t in [*sorted({s for _, s in rows}), float("inf")]]
            # From (0, 0) on, the trapezoids make up the whole area.
            area = sum((a[1] - b[1]) * (a[2] + b[2]) / 2 for a, b in zip(points, points[1:]))
            assert area == pytest.approx(brute_auc(rows))
    assert roc_auc(df.filter("y = 1"), "y", "s").first()["auc"] is None
    assert roc_auc(df.limit(0), "y", "s").first()["auc"] is None


def test_distribution_rate_and_weights(spark):
    df = spark.createDataFrame([("x", 1), ("x", 0), ("y", 0), ("y", 0)], "source string, label int")
    rows = {r["label"]: (r["n"], r["pct"]) for r in label_distribution(df, classes=(0, 1, 2)).collect()}
    assert rows == {0: (3, 75.0), 1: (1, 25.0), 2: (0, 0.0)}
    assert {tuple(r) for r in hedge_rate(df, ["source"]).collect()} == {
        ("x", 2, 1, 1, 0.5), ("y", 2, 0, 2, 0.0)}
    assert {r["label"]: r["weight"] for r in class_weights(df).collect()} == {
        0: pytest.approx(4 / 6), 1: pytest.approx(2.0)}
    assert {tuple(r) for r in step_counts(a=df, b=df.limit(1)).collect()} == {("a", 4), ("b", 1)}
    assert tuple(score_stats(df, "label").first()) == (0, 1, 0.25)


def predictions(spark):
    rows = [(m, d, i % 2, (i % 2) if i < k else 1 - i % 2, None if m == "svm" else i / 10)
            for m, k in (("lr", 6), ("svm", 6), ("nb", 2)) for d in ("dev", "test") for i in range(8)]
    return spark.createDataFrame(
        rows, "model string, dataset string, gold_label int, prediction int, probability double")


def test_summary_and_reports(spark):
    rows = {(r["model"], r["dataset"]): r for r in summary(predictions(spark), probability="probability").collect()}
    assert len(rows) == 6
    assert rows["svm", "dev"]["auc"] is None and rows["lr", "test"]["auc"] == pytest.approx(0.625)
    assert rows["lr", "dev"]["accuracy"] == 0.75
    place = spark.createDataFrame([("nb", 0), ("svm", 1), ("lr", 2)], "model string, position int")
    table = summary(predictions(spark)).join(place, "model")
    # svm and lr tie; svm is listed first.
    assert best_model(table.filter("dataset = 'test'")).first()["model"] == "svm"
    report = comparison_report(table.withColumn("dataset", F.when(F.col("dataset") == "dev", "val")
                                                .otherwise("test")), {"svm": "Linear SVM"})
    assert report.filter("best_f1").select("model", "dataset").collect() == [("Linear SVM", "test")]
    body = json.loads(report_json(report).first()[0])
    assert body["best_accuracy_model"] == "Linear SVM" and set(body["dev_results"]) == {"Linear SVM", "lr", "nb"}
    assert body["test_results"]["lr"]["tp"] == 3
    only_test = json.loads(report_json(report.filter("dataset = 'test'")).first()[0])
    assert only_test.get("dev_results") is None
    melted = melt_metrics(table.filter("dataset = 'test'"))
    assert melted.columns == ["model", "Metric", "Score"] and melted.count() == 12
    shown = round_metrics(spark.createDataFrame([(0.12345, 0.66666)], "a double, b double"), percents=["b"])
    assert tuple(shown.first()) == (0.123, 66.7)


def test_grouped_metrics(spark):
    df = predictions(spark).filter("model = 'lr'").withColumn("fold", F.col("gold_label"))
    rows = {r["source"]: r for r in metrics_by_source(
        df.withColumnRenamed("dataset", "source"), "gold_label").collect()}
    assert set(rows) == {"all", "dev", "test"} and rows["all"]["tp"] == 2 * rows["dev"]["tp"]
    folds = {r["fold"]: r["accuracy"] for r in fold_metrics(df).collect()}
    assert folds == {-1: 0.75, 0: 0.75, 1: 0.75}
    wrong = error_analysis(predictions(spark))
    assert wrong.count() == 2 * (2 + 2 + 6) and wrong.filter("error_type = 'false_positive'").count() == 10


def test_baseline_and_long_table(spark):
    df = spark.createDataFrame([("1", "it may rise", 1, "dev"), ("2", "dismay", 0, "dev"), ("3", "no", 0, "test")],
                               "id string, sentence string, gold_label int, dataset string")
    rows = {r["dataset"]: (r["tp"], r["tn"], r["fp"], r["fn"]) for r in keyword_baseline_eval(df).collect()}
    assert rows == {"dev": (1, 0, 1, 0), "test": (0, 1, 0, 0)}
    scored = df.withColumn("prediction", F.lit(1))
    long = model_predictions({"a": scored, "b": scored.withColumn("probability", F.lit(0.5))})
    assert long.count() == 6 and long.filter("probability IS NULL").count() == 3


def test_agreement(spark):
    df = spark.createDataFrame([(1, 1)] * 15 + [(0, 0)] * 25 + [(0, 1)] * 10, "annotator_1 int, annotator_2 int")
    row = cohen_kappa(df, "annotator_1", "annotator_2").first()
    assert row["po"] == pytest.approx(0.8) and row["kappa"] == pytest.approx(0.6)
    assert [(r["category"][:6], r["n"], r["pct"]) for r in agreement(df).collect()] == [
        ("Agreed", 40, 80.0), ("Missed", 10, 20.0)]
    three = spark.createDataFrame([("a", "a"), ("b", "c"), ("c", "c"), ("a", None)], "x string, y string")
    row = cohen_kappa(three, "x", "y").first()
    assert (row["po"], row["pe"]) == (pytest.approx(2 / 3), pytest.approx(1 / 3))
    one = cohen_kappa(df.filter("annotator_1 = 1 AND annotator_2 = 1"), "annotator_1", "annotator_2").first()
    assert one["po"] == 1.0 and one["kappa"] is None


def test_feed_quality(spark):
    df = spark.createDataFrame(
        [("https://www.cnbc.com/a", "Apple up", None), ("https://x.org/b", "Rate news", "cloud"),
         (None, "Tesla", "x"), ("https://cnbc.com/c", "", "x"), ("https://cnbc.com/d", "Bond", "y")],
        "url string, title string, description string")
    assert tuple(feed_quality(df).first()) == (5, 2, 1, 1, 2, "warn", "warn", "pass")
    assert tuple(feed_quality(df.limit(0)).first())[5:] == ("pass", "pass", "warn")

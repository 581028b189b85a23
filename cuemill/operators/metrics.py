"""Counts, rates and classification metrics. Every metric is one pass with map-side sums.

Predictions come as a long table ``(…, model, dataset, gold_label, prediction, probability)``, so
all models and datasets are evaluated by one job instead of a loop.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.labels import contains_any
from cuemill.functions.text import article_text
from cuemill.functions.web import url_host
from cuemill.lexicons import ALLOWED_DOMAINS, TOPIC_KEYWORDS
from cuemill.session import stored

COUNTS = ("tp", "tn", "fp", "fn")


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def label_distribution(df: DataFrame, label: str = "label", classes: Sequence[int] = (0, 1)) -> DataFrame:
    """Count and percent per class; ``classes`` without a row count 0."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    listed = F.explode(F.array(*[F.lit(c).cast(df.schema[label].dataType) for c in classes]))
    named = df.sparkSession.range(1).select(listed.alias("label"), F.lit(0).cast("long").alias("n"))
    full = counts.unionByName(named).groupBy("label").agg(F.sum("n").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return full.select("label", "n", (_ratio(F.col("n"), total) * 100).alias("pct"))


def hedge_rate(df: DataFrame, by: Sequence[str] = (), label: str = "label") -> DataFrame:
    """Rows, positives, negatives and the share of positives, per group."""
    return df.groupBy(*by).agg(
        F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("positives"),
        F.sum(F.lit(1) - F.col(label).cast("long")).alias("negatives"),
        F.avg(F.col(label).cast("double")).alias("rate"))


def confusion_counts(y: str = "gold_label", p: str = "prediction") -> list[Column]:
    def n(truth: int, guess: int) -> Column:
        return F.count_if((F.col(y) == truth) & (F.col(p) == guess))

    return [n(1, 1).alias("tp"), n(0, 0).alias("tn"), n(0, 1).alias("fp"), n(1, 0).alias("fn")]


def metrics_from_counts() -> list[Column]:
    """Accuracy, precision, recall and F1; 0 where the denominator is 0."""
    tp, tn, fp, fn = (F.col(c) for c in COUNTS)
    return [_ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
            _ratio(tp, tp + fp).alias("precision"), _ratio(tp, tp + fn).alias("recall"),
            _ratio(2 * tp, 2 * tp + fp + fn).alias("f1")]


def macro_f1() -> Column:
    """Mean of the F1 of both classes, from confusion counts."""
    tp, tn, fp, fn = (F.col(c) for c in COUNTS)
    return (_ratio(2 * tp, 2 * tp + fp + fn) + _ratio(2 * tn, 2 * tn + fp + fn)) / 2


def confusion_metrics(
    df: DataFrame, y: str = "gold_label", p: str = "prediction", by: Sequence[str] = ()
) -> DataFrame:
    counted = df.groupBy(*by).agg(*confusion_counts(y, p))
    return counted.select(*by, *metrics_from_counts(), *COUNTS)


def with_macro_f1(counts: DataFrame) -> DataFrame:
    return counts.withColumn("f1_macro", macro_f1())


def summary(
    predictions: DataFrame, y: str = "gold_label", p: str = "prediction",
    probability: str | None = None,
) -> DataFrame:
    """One row per model and dataset; ``auc`` is null for models without probabilities.

    The predictions are read once: counts per score serve the confusion table and the AUC.
    """
    by = ["model", "dataset"]
    if probability is None:
        out = with_macro_f1(confusion_metrics(predictions, y, p, by))
        return out.withColumn("auc", F.lit(None).cast("double"))
    counts = stored(predictions.groupBy(*by, F.col(probability).cast("double").alias("score"))
                    .agg(*confusion_counts(y, p), *_class_counts(y)), "scores")
    summed = counts.groupBy(*by).agg(*[F.sum(c).alias(c) for c in COUNTS])
    out = with_macro_f1(summed.select(*by, *metrics_from_counts(), *COUNTS))
    return out.join(_auc(_ranges(counts, by, 256), by), by, "left")


def metrics_by_source(
    df: DataFrame, y: str = "label", p: str = "prediction", source: str = "source"
) -> DataFrame:
    """Metrics of each source, and of all rows under ``all``."""
    counted = df.rollup(source).agg(F.grouping(source).alias("_all"), *confusion_counts(y, p))
    name = F.when(F.col("_all") == 1, F.lit("all")).otherwise(F.col(source))
    return counted.select(name.alias(source), *metrics_from_counts(), *COUNTS)


def fold_metrics(df: DataFrame, y: str = "gold_label", p: str = "prediction") -> DataFrame:
    """Metrics of each fold, and of all rows under fold -1."""
    counted = df.rollup("fold").agg(F.grouping("fold").alias("_all"), *confusion_counts(y, p))
    fold = F.when(F.col("_all") == 1, F.lit(-1)).otherwise(F.col("fold"))
    return counted.select(fold.alias("fold"), *metrics_from_counts(), *COUNTS)


def _class_counts(y: str) -> list[Column]:
    return [F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")]


def _by_score(df: DataFrame, y: str, score: str, by: Sequence[str], buckets: int) -> DataFrame:
    """Distinct scores with their class counts, in ranges of about equal size.

    Equal scores collapse before the shuffle, and what is left is written once, so ``df`` is read
    once. Null and NaN scores have no place in the order and are left out.
    """
    counts = df.groupBy(*by, F.col(score).cast("double").alias("score")).agg(*_class_counts(y))
    return _ranges(stored(counts, "scores"), by, buckets)


def _ranges(counts: DataFrame, by: Sequence[str], buckets: int) -> DataFrame:
    """The range ends are quantiles of the distinct scores, so no range outgrows the others however
    the scores cluster."""
    counts = counts.filter(F.col("score").isNotNull() & ~F.isnan("score")).select(*by, "score", "pos", "neg")
    steps = [i / buckets for i in range(1, buckets)]
    ends = sorted(set(counts.approxQuantile("score", steps, 0.25 / buckets)))
    ends = [e for e in ends if abs(e) != float("inf")]
    splits = [-float("inf"), *(ends or [0.0]), float("inf")]
    return Bucketizer(splits=splits, inputCol="score", outputCol="_range").transform(counts)


def roc_auc(
    df: DataFrame, y: str = "gold_label", score: str = "probability", by: Sequence[str] = (),
    buckets: int = 256,
) -> DataFrame:
    """Area under the ROC curve, tied scores counting half. Null when a class is missing.

    A positive beats the negatives of lower ranges and the lower ones of its own range, so each
    range is summed by itself and the few range totals are combined afterwards.
    """
    return _auc(_by_score(df, y, score, by, buckets), by)


def _auc(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    below = (Window.partitionBy(*by, "_range").orderBy("score")
             .rowsBetween(Window.unboundedPreceding, -1))
    wins = F.col("pos") * (F.coalesce(F.sum("neg").over(below), F.lit(0)) + F.col("neg") / 2)
    ranges = rows.withColumn("_wins", wins).groupBy(*by, "_range").agg(
        F.sum("_wins").alias("_wins"), F.sum("pos").alias("_pos"), F.sum("neg").alias("_neg"))
    lower = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    total = ranges.withColumn("_lower", F.coalesce(F.sum("_neg").over(lower), F.lit(0)))
    return total.groupBy(*by).agg(F.try_divide(
        F.sum(F.col("_wins") + F.col("_pos") * F.col("_lower")),
        (F.sum("_pos") * F.sum("_neg")).cast("double")).alias("auc"))


def roc_curve(
    df: DataFrame, y: str = "gold_label", score: str = "probability", by: Sequence[str] = (),
    buckets: int = 256,
) -> DataFrame:
    """One ``(threshold, fpr, tpr)`` row per distinct score, for ``score >= threshold``, and before
    them the start (0, 0) at an infinite threshold."""
    rows = _by_score(df, y, score, by, buckets)
    totals = rows.groupBy(*by, "_range").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    higher = (Window.partitionBy(*by).orderBy(F.desc("_range"))
              .rowsBetween(Window.unboundedPreceding, -1))
    group = Window.partitionBy(*by)
    above = totals.select(
        *by, "_range", F.coalesce(F.sum("_p").over(higher), F.lit(0)).alias("_p_above"),
        F.coalesce(F.sum("_n").over(higher), F.lit(0)).alias("_n_above"),
        F.sum("_p").over(group).alias("_p_all"), F.sum("_n").over(group).alias("_n_all"))
    within = Window.partitionBy(*by, "_range").orderBy(F.desc("score"))
    points = (rows.withColumn("_tp", F.sum("pos").over(within))
              .withColumn("_fp", F.sum("neg").over(within))
              .join(above, [*by, "_range"])
              .select(*by, F.col("score").alias("threshold"),
                      _ratio(F.col("_fp") + F.col("_n_above"), F.col("_n_all")).alias("fpr"),
                      _ratio(F.col("_tp") + F.col("_p_above"), F.col("_p_all")).alias("tpr")))
    start = rows.select(*by).distinct() if by else rows.limit(1)
    return points.union(start.select(*by, F.lit(float("inf")), F.lit(0.0), F.lit(0.0)))


def score_stats(df: DataFrame, column: str = "relevance_score") -> DataFrame:
    return df.agg(F.min(column).alias("min"), F.max(column).alias("max"),
                  F.avg(column).alias("avg"))


def feed_quality(
    df: DataFrame, domains: Sequence[str] = ALLOWED_DOMAINS,
    keywords: Sequence[str] = TOPIC_KEYWORDS,
) -> DataFrame:
    """Feed counts and verdicts. A row without url or title counts as malformed and nothing else."""
    missing = (F.coalesce(F.col("url"), F.lit("")) == "") | (F.coalesce(F.col("title"), F.lit("")) == "")
    topical = contains_any(article_text("title", "description"), keywords)
    foreign = ~url_host("url").isin(list(domains))
    counts = df.agg(
        F.count("*").alias("total"), F.count_if(~missing & topical).alias("topical"),
        F.count_if(~missing & ~topical).alias("not_topical"),
        F.count_if(~missing & foreign).alias("wrong_domain"),
        F.count_if(missing).alias("missing_fields"))

    def verdict(ok: Column, name: str) -> Column:
        return F.when(ok, "pass").otherwise("warn").alias(name)

    return counts.select("*", verdict(F.col("wrong_domain") == 0, "domain_check"),
                         verdict(F.col("missing_fields") == 0, "field_check"),
                         verdict(F.col("topical") > 0, "topic_check"))


def class_weights(df: DataFrame, label: str = "label") -> DataFrame:
    """``n / (classes · n_c)`` per class."""
    counts = df.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"))
    rows, classes = counts.agg(F.sum("n")).scalar(), counts.agg(F.count("*")).scalar()
    return counts.select("label", "n", (rows / (classes * F.col("n"))).alias("weight"))


def best_model(
    summary_df: DataFrame, metrics: str | Sequence[str] = "f1", position: str = "position"
) -> DataFrame:
    """Per metric the model with the highest value, in one pass; the first listed wins a tie."""
    names = [metrics] if isinstance(metrics, str) else list(metrics)
    best = [F.max_by(F.struct("model", F.col(m).cast("double").alias("value")),
                     F.struct(F.col(m), -F.col(position))).alias(m) for m in names]
    rows = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m)["model"].alias("model"),
                              F.col(m)["value"].alias("value")) for m in names])
    return summary_df.agg(*best).select(F.inline(rows))


def comparison_report(
    metrics: DataFrame, display: dict[str, str] | None = None, position: str = "position"
) -> DataFrame:
    """Test and dev tables with display names, and the best test models as flags.

    ``val`` stands in for dev. The table has one row per model and dataset.
    """
    shown = F.col("model")
    for name, text in (display or {}).items():
        shown = F.when(F.col("model") == name, F.lit(text)).otherwise(shown)
    rows = (metrics.withColumn("dataset", F.when(F.col("dataset") == "val", "dev")
                               .otherwise(F.col("dataset")))
            .filter(F.col("dataset").isin("test", "dev")).withColumn("model", shown))
    test = rows.filter("dataset = 'test'")

    def flag(metric: str) -> Column:
        best = test.agg(F.max_by("model", F.struct(F.col(metric), -F.col(position)))).scalar()
        return F.coalesce((F.col("dataset") == "test") & (F.col("model") == best), F.lit(False))

    return rows.select("dataset", "model", "accuracy", "precision", "recall", "f1", *COUNTS,
                       flag("f1").alias("best_f1"), flag("accuracy").alias("best_accuracy"))


def report_json(report: DataFrame) -> DataFrame:
    """The comparison report as one JSON object; a handful of models, so one row."""
    body = F.struct("accuracy", "precision", "recall", "f1", *COUNTS)
    per = report.groupBy("dataset").agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("model", body)))).alias("results"),
        F.max(F.when(F.col("best_f1"), F.col("model"))).alias("best_f1"),
        F.max(F.when(F.col("best_accuracy"), F.col("model"))).alias("best_accuracy"))

    def part(name: str) -> Column:
        return F.any_value(F.when(F.col("dataset") == name, F.col("results")), ignoreNulls=True)

    wide = per.agg(
        part("test").alias("test_results"), part("dev").alias("dev_results"),
        F.max("best_f1").alias("best_f1_model"),
        F.max("best_accuracy").alias("best_accuracy_model"))
    return wide.select(F.to_json(F.struct("*")).alias("report"))


def step_counts(**frames: DataFrame) -> DataFrame:
    """``(step, n)``: the rows of each named frame."""
    counts = [df.agg(F.lit(name).alias("step"), F.count("*").alias("n"))
              for name, df in frames.items()]
    return reduce(DataFrame.unionByName, counts)


def melt_metrics(
    df: DataFrame, metrics: Sequence[str] = ("accuracy", "f1", "precision", "recall")
) -> DataFrame:
    """Wide metrics as ``(model, Metric, Score)`` rows."""
    return df.unpivot(["model"], list(metrics), "Metric", "Score")


def confusion_long(df: DataFrame, y: str = "gold_label", p: str = "prediction") -> DataFrame:
    """The confusion matrix as four ``(actual, pred, n)`` rows, zero cells included."""
    counts = df.agg(*confusion_counts(y, p))
    cells = [F.struct(F.lit(actual).alias("actual"), F.lit(pred).alias("pred"), F.col(n).alias("n"))
             for actual, pred, n in ((0, 0, "tn"), (0, 1, "fp"), (1, 0, "fn"), (1, 1, "tp"))]
    return counts.select(F.inline(F.array(*cells)))


def round_metrics(df: DataFrame, digits: int = 3, percents: Sequence[str] = ()) -> DataFrame:
    """Doubles to ``digits`` places; ``percents`` as percentages to one place."""
    kinds = dict(df.dtypes)
    return df.select([
        F.round(F.col(c) * 100, 1).alias(c) if c in percents
        else F.round(c, digits).alias(c) if kinds[c] == "double" else F.col(c)
        for c in df.columns])

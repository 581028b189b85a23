"""Linear classifiers over TF-IDF: grid search, out-of-fold predictions, scoring.

All models of a grid are fitted in the same passes over one table of term counts; each fold has its own
vocabulary and weights, which are applied to the counts inside the pass (see ``linear``). ``C`` weighs
the summed loss.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce
from itertools import product
from typing import Any

import numpy as np
from pyspark.ml import Model, PipelineModel
from pyspark.ml.classification import LinearSVCModel, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.text import ngrams
from cuemill.operators.features import fold_vocabularies, tfidf_fit, tfidf_model, vocabulary_rows
from cuemill.operators.linear import (
    Fit,
    Loss,
    Space,
    Task,
    class_weights,
    fit_stacked,
    held_out_counts,
    linear_svm,
    logistic_regression,
)
from cuemill.session import stored

# The grid.
CS = (0.01, 0.1, 1.0, 10.0)
WEIGHTS = ("balanced", None)


@dataclass(frozen=True)
class Grid:
    """Search result: the refitted model, its parameters and ``(C, class_weight, mean_f1, best)``."""

    model: PipelineModel
    params: dict[str, Any]
    table: list[tuple[float, str | None, float, bool]] = field(default_factory=list)
    #: Passes over the rows that the slowest fit took.
    passes: int = 0

    def frame(self, df: DataFrame) -> DataFrame:
        return df.sparkSession.createDataFrame(
            self.table, "C double, class_weight string, mean_f1 double, best boolean")


Counts = dict[float, int]


def class_counts(df: DataFrame, label: str) -> Counts:
    """Rows of class 0 and of class 1; any other label is an error."""
    value = F.col(label).cast("double")
    n, zeros, ones = df.agg(F.count("*"), F.count_if(value == 0), F.count_if(value == 1)).first()
    if zeros + ones != n:
        raise ValueError(f"{label} holds {n - zeros - ones} values besides 0 and 1")
    return {c: m for c, m in ((0.0, zeros), (1.0, ones)) if m}


def _weighted(df: DataFrame, label: str, class_weight: str | None, counts: Counts) -> DataFrame:
    """Rows with ``_weight``; balanced weights, too, add up to the number of rows."""
    n = sum(counts.values())
    weight = F.lit(1.0)
    if class_weight == "balanced":
        for value, n_c in counts.items():
            weight = F.when(F.col(label) == value, F.lit(n / (len(counts) * n_c))).otherwise(weight)
    return df.withColumn("_weight", weight)


def spark_model(spark: SparkSession, loss: Loss, fit: Fit) -> Model:
    """A fit as Spark's own model class, which scores in the JVM and can be saved."""
    cls = LinearSVCModel if loss.penalised_intercept else LogisticRegressionModel
    java = spark._jvm.org.apache.spark.ml.classification
    vector = spark._jvm.org.apache.spark.ml.linalg.Vectors.dense(_java_doubles(spark, fit.coefficients))
    made = getattr(java, cls.__name__)(f"{loss.name}_{uuid.uuid4().hex[:12]}", vector, fit.intercept)
    model = cls(made)
    model._resetUid(made.uid())
    return model.setFeaturesCol("features").setPredictionCol("prediction")


def _java_doubles(spark: SparkSession, values: np.ndarray):
    out = spark.sparkContext._gateway.new_array(spark._jvm.double, len(values))
    for i, v in enumerate(values):
        out[i] = float(v)
    return out


def count_rows(df: DataFrame, terms: Sequence[str], text: str, label: str, fold: str | None) -> DataFrame:
    """``label, fold, at, value``: the counts of the given terms, as a table that every pass reads."""
    grams = df.select(F.col(label).cast("double").alias("label"),
                      (F.col(fold) if fold else F.lit(-1)).cast("int").alias("fold"),
                      F.coalesce(ngrams(text, 1, 2), F.array().cast("array<string>")).alias("_g"))
    counted = CountVectorizerModel.from_vocabulary(list(terms), "_g", "_tf").transform(grams)
    cells = F.filter(F.transform(vector_to_array("_tf"), lambda v, i: F.struct(i.alias("at"), v.alias("value"))),
                     lambda c: c["value"] > 0)
    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cells = counted.select("label", "fold", cells.alias("c")).select("label", "fold", "c.at", "c.value")
    return stored(cells.repartition(tasks), "counts")


def _space(vocabulary: Sequence[Row], place: dict[str, int], held_out: int | None) -> Space:
    return Space(np.array([place[r["term"]] for r in vocabulary], dtype=int),
                 np.array([r["idf"] for r in vocabulary], dtype=float), held_out)


def _fit_all(df: DataFrame, loss: Loss, text: str, label: str, fold: str | None, vocabularies: Sequence[Sequence[Row]],
             held_out: Sequence[int | None], params: Sequence[Sequence[tuple]], counts: Sequence[Counts],
             **options) -> tuple[DataFrame, list[Space], list[Task], list[Fit], int]:
    """Every parameter pair of every space, in shared passes. A space whose training rows hold one class
    only gets that class as a constant answer."""
    terms = sorted({r["term"] for v in vocabularies for r in v})
    place = {t: i for i, t in enumerate(terms)}
    rows = count_rows(df, terms, text, label, fold)
    spaces = [_space(v, place, h) for v, h in zip(vocabularies, held_out)]
    tasks = [Task(s, float(C), class_weights(weight, counts[s])) for s, pairs in enumerate(params) for C, weight in pairs]
    usual = [m for m, t in enumerate(tasks) if len(counts[t.space]) > 1]
    found = fit_stacked(rows, loss, spaces, [tasks[m] for m in usual], len(terms), **options) if usual else []
    fits = dict(zip(usual, found))
    for m, t in enumerate(tasks):
        if m not in fits:
            only = 1.0 if counts[t.space].get(1.0) else -1.0
            fits[m] = Fit(np.zeros(len(spaces[t.space].columns)), only * 100.0, 0, True)
    return rows, spaces, tasks, [fits[m] for m in range(len(tasks))], len(terms)


def fit_pipeline(
    df: DataFrame, loss: Loss, C: float, class_weight: str | None, text: str = "text",
    label: str = "label", vocabulary_size: int = 500, **options,
) -> PipelineModel:
    """Vocabulary, features and classifier of all rows, as one pipeline that can be saved."""
    vocabulary = vocabulary_rows(tfidf_fit(df, text, size=vocabulary_size))
    *_, fits, _ = _fit_all(df, loss, text, label, None, [vocabulary], [None], [[(C, class_weight)]],
                           [class_counts(df, label)], **options)
    return PipelineModel([tfidf_model(vocabulary, text), spark_model(df.sparkSession, loss, fits[0])])


def grid_search(
    df: DataFrame, loss: Loss, text: str = "text", label: str = "label", fold: str = "fold",
    Cs: Sequence[float] = CS, weights: Sequence[str | None] = WEIGHTS, k: int = 5,
    vocabulary_size: int = 500, per_fold_vocabulary: bool = True, **options,
) -> Grid:
    """Best parameters by the mean positive-class F1 over the folds, refitted on all rows.

    ``df`` carries a ``fold`` column. The vocabulary of a fold comes from its training rows, unless
    ``per_fold_vocabulary`` is off. The models of all folds, and those of all rows, one of which is
    the answer, take the same passes; ``options`` go to :func:`fit_stacked`.
    """
    params = list(product(Cs, weights))
    whole = vocabulary_rows(tfidf_fit(df, text, size=vocabulary_size))
    own = fold_vocabularies(df, fold, k, text, size=vocabulary_size) if per_fold_vocabulary else [whole] * k
    by_fold = _fold_counts(df, label, fold, k)
    counts = [*[_without(by_fold, i) for i in range(k)], class_counts(df, label)]
    rows, spaces, tasks, fits, width = _fit_all(df, loss, text, label, fold, [*own, whole], [*range(k), None],
                                                [params] * (k + 1), counts, **options)
    scores: dict[tuple, float] = dict.fromkeys(params, 0.0)
    for r in held_out_counts(rows, spaces, tasks, fits, width).collect():
        if spaces[tasks[r["model"]].space].held_out is not None:
            base = 2 * r["tp"] + r["fp"] + r["fn"]
            scores[params[r["model"] % len(params)]] += (2 * r["tp"] / base if base else 0.0) / k
    best = max(params, key=lambda p: scores[p])
    refit = fits[k * len(params) + params.index(best)]
    model = PipelineModel([tfidf_model(whole, text), spark_model(df.sparkSession, loss, refit)])
    return Grid(model, {"C": best[0], "class_weight": best[1]},
                [(float(c), w, scores[c, w], (c, w) == best) for c, w in params], max(f.passes for f in fits))


def logreg_grid(df: DataFrame, **options) -> Grid:
    return grid_search(df, logistic_regression, **options)


def svm_grid(df: DataFrame, **options) -> Grid:
    return grid_search(df, linear_svm, **options)


def _fold_counts(rows: DataFrame, label: str, fold: str, k: int) -> dict[int, Counts]:
    """Class counts of each of the ``k`` folds: at most k rows."""
    value = F.col(label).cast("double")
    found = rows.filter(F.col(fold).between(0, k - 1)).groupBy(fold).agg(
        F.count_if(value == 0), F.count_if(value == 1)).collect()
    return {r[0]: {0.0: r[1], 1.0: r[2]} for r in found}


def _without(by_fold: dict[int, Counts], i: int) -> Counts:
    """Class counts of the rows that train for fold ``i``."""
    sums = {c: sum(n[c] for f, n in by_fold.items() if f != i) for c in (0.0, 1.0)}
    return {c: n for c, n in sums.items() if n}


def cross_val_predict(
    df: DataFrame, loss: Loss, C: float, class_weight: str | None, text: str = "text",
    label: str = "label", fold: str = "fold", k: int = 5, vocabulary_size: int = 500,
    per_fold_vocabulary: bool = True, **options,
) -> DataFrame:
    """All rows with the prediction of the model that was not trained on them.

    The vocabularies of all folds come from one pass, and the folds' models from shared passes.
    """
    if per_fold_vocabulary:
        own = fold_vocabularies(df, fold, k, text, size=vocabulary_size)
    else:
        own = [vocabulary_rows(tfidf_fit(df, text, size=vocabulary_size))] * k
    by_fold = _fold_counts(df, label, fold, k)
    *_, fits, _ = _fit_all(df, loss, text, label, fold, own, list(range(k)), [[(C, class_weight)]] * k,
                           [_without(by_fold, i) for i in range(k)], **options)
    spark = df.sparkSession
    parts = [score(PipelineModel([tfidf_model(own[i], text), spark_model(spark, loss, fits[i])]),
                   df.filter(F.col(fold) == i)).drop("probability") for i in range(k)]
    return reduce(DataFrame.unionByName, parts)


def objective(
    model: PipelineModel, df: DataFrame, C: float, class_weight: str | None, label: str = "label",
    scales: Sequence[float] = (0.0, 0.9, 1.0, 1.1),
) -> list[float]:
    """The regularised mean loss of a fitted pipeline with its coefficients and intercept scaled by
    each of ``scales``: at the optimum none is below the one at 1. One pass over ``df``."""
    classifier = model.stages[-1]
    counts = class_counts(df, label)
    rows = _weighted(model.transform(df.withColumn(label, F.col(label).cast("double"))), label, class_weight, counts)
    # The raw prediction of class 1 is the margin.
    margin = vector_to_array("rawPrediction")[1] * (2 * F.col(label) - 1)
    hinge = isinstance(classifier, LinearSVCModel)
    squares = float(classifier.coefficients.dot(classifier.coefficients)) + (classifier.intercept ** 2 if hinge else 0.0)
    n = sum(counts.values())
    penalty = squares / (2 * C * n)

    def loss(scale: float) -> Column:
        m = margin * scale
        value = F.pow(F.greatest(F.lit(0.0), 1 - m), 2) if hinge else F.log1p(F.exp(-F.abs(m))) + F.greatest(F.lit(0.0), -m)
        return F.sum(F.col("_weight") * value)

    sums = rows.agg(*[loss(s).alias(f"s{i}") for i, s in enumerate(scales)]).first()
    return [total / n + penalty * s * s for total, s in zip(sums, scales)]


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds ``prediction`` and ``probability`` of class 1, null for models without one."""
    out = model.transform(df)
    probability = (vector_to_array("probability")[1] if "probability" in out.columns
                   else F.lit(None).cast("double"))
    return out.select(*df.columns, F.col("prediction").cast("int").alias("prediction"),
                      probability.alias("probability"))

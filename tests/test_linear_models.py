import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.sql import functions as F

from cuemill.operators.classify import (
    _fit_all,
    class_counts,
    cross_val_predict,
    fit_pipeline,
    linear_svm,
    logistic_regression,
    logreg_grid,
    objective,
    score,
    svm_grid,
)
from cuemill.operators.features import fold_vocabularies, term_stats, tfidf_fit, tfidf_model, tfidf_transform, top_vocabulary
from cuemill.operators.sampling import stratified_kfold
from cuemill.operators.scoring import batch_predict, linear_head
from cuemill.session import scratch_path
from cuemill.sources.models import load_models, save_model

DOCS = ["The cat sat. The cat ran!", "a dog sat on the cat", "Dogs ran, cats ran", "", None, "ÉTÉ été x_1",
        "the the the the", "sat sat on on the"]


def grams(text):
    words = re.findall(r"\b\w\w+\b", (text or "").lower())
    return words + [" ".join(p) for p in zip(words, words[1:])]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(DOCS)), "doc_id int, text string").repartition(3)


def brute_vocabulary(min_df, max_df, size):
    tf, df = Counter(), Counter()
    for d in DOCS:
        tf.update(grams(d))
        df.update(set(grams(d)))
    keep = [t for t in tf if df[t] >= min_df and df[t] <= max_df * len(DOCS)]
    keep = sorted(sorted(keep, key=lambda t: (-tf[t], t))[:size])
    return {t: (i, tf[t], df[t], math.log((1 + len(DOCS)) / (1 + df[t])) + 1) for i, t in enumerate(keep)}


def test_term_stats(docs):
    tf, df = Counter(), Counter()
    for d in DOCS:
        tf.update(grams(d))
        df.update(set(grams(d)))
    assert {r["term"]: (r["tf"], r["df"]) for r in term_stats(docs).collect()} == {
        t: (tf[t], df[t]) for t in tf}


def test_term_stats_shuffle_once(docs):
    plan = term_stats(docs.select("text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan


def test_vocabulary_and_weights(docs):
    for min_df, max_df, size in ((2, 0.95, 500), (1, 1.0, 5), (2, 0.5, 500)):
        wanted = brute_vocabulary(min_df, max_df, size)
        fitted = tfidf_fit(docs, min_df=min_df, max_df=max_df, size=size)
        assert {r["term"]: (r["idx"], r["tf"], r["df"], r["idf"]) for r in fitted.collect()} == {
            t: (*v[:3], pytest.approx(v[3])) for t, v in wanted.items()}
        cells = {(r["doc_id"], r["term"]): r["weight"] for r in tfidf_transform(docs, fitted).collect()}
        expected = {}
        for i, d in enumerate(DOCS):
            row = {t: n * wanted[t][3] for t, n in Counter(grams(d)).items() if t in wanted}
            norm = math.sqrt(sum(w * w for w in row.values()))
            expected |= {(i, t): pytest.approx(w / norm) for t, w in row.items()}
        assert cells == expected
    assert top_vocabulary(term_stats(docs), len(DOCS), size=3).count() == 3


def test_scoring_is_narrow(docs):
    model = tfidf_model(tfidf_fit(docs))
    plan = model.transform(docs.coalesce(1))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1  # The fixture's own repartition.
    assert model.transform(docs).columns == ["doc_id", "text", "features"]
    with pytest.raises(ValueError):
        tfidf_model(tfidf_fit(docs.limit(0)))


@pytest.fixture(scope="module")
def training(spark):
    good = ["prices may rise soon", "it could perhaps fall", "they might well sell", "it may perhaps rise"]
    bad = ["prices rose today", "it fell by two", "they sold it all", "it rose by ten today"]
    rows = [(i, (good if i % 3 == 0 else bad)[i % 4], int(i % 3 == 0)) for i in range(60)]
    rows[5] = (5, "prices may rise soon", 0)
    df = spark.createDataFrame(rows, "doc_id int, text string, label int")
    return stratified_kfold(df, "label", 3, key="doc_id").persist()


def test_logistic_regression_is_the_optimum(training):
    """Against gradient descent on C · Σ w · loss + ½|b|² with a free intercept."""
    model = fit_pipeline(training, logistic_regression, 0.5, "balanced")
    vectors, classifier = model.stages
    rows = vectors.transform(training).select("features", "label").collect()
    x = np.array([r["features"].toArray() for r in rows])
    y = np.array([r["label"] for r in rows], dtype=float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    b, a = np.zeros(x.shape[1]), 0.0
    for _ in range(20_000):
        error = 0.5 * weight * (1 / (1 + np.exp(-(x @ b + a))) - y)
        b -= 0.05 * (x.T @ error + b)
        a -= 0.05 * error.sum()
    assert classifier.coefficients.toArray() == pytest.approx(b, abs=2e-3)
    assert classifier.intercept == pytest.approx(a, abs=5e-3)


def test_grid_search_and_out_of_fold(training):
    found = logreg_grid(training, Cs=(0.001, 10.0), k=3, max_iter=40)
    table = found.frame(training).collect()
    assert len(table) == 4 and sum(r["best"] for r in table) == 1
    best = next(r for r in table if r["best"])
    assert best["mean_f1"] == max(r["mean_f1"] for r in table) > 0.8
    assert found.params == {"C": best["C"], "class_weight": best["class_weight"]}

    out = cross_val_predict(training, logistic_regression, **found.params, k=3, max_iter=40)
    assert out.columns == [*training.columns, "prediction"] and out.count() == 60
    assert out.filter("label = prediction").count() >= 57
    shared = cross_val_predict(training, logistic_regression, 10.0, None, k=3, max_iter=40,
                               per_fold_vocabulary=False)
    assert shared.count() == 60

    svm = svm_grid(training, Cs=(1.0,), weights=(None,), k=3, max_iter=20)
    scored = score(svm.model, training)
    assert scored.filter("probability IS NOT NULL").count() == 0
    assert scored.filter("label = prediction").count() >= 57


def test_models_survive_saving(training):
    model = fit_pipeline(training, logistic_regression, 1.0, None, max_iter=30)
    path = save_model(model, scratch_path(training.sparkSession, "model"))
    found = load_models({"lr": path, "gone": path + "-gone"})
    assert list(found) == ["lr"]

    def rows(m):
        out = score(m, training).orderBy("doc_id").select("prediction", "probability").collect()
        assert all((r["probability"] > 0.5) == (r["prediction"] == 1) for r in out)
        return out

    assert rows(found["lr"]) == rows(model)


def test_linear_svm_separates(training):
    model = fit_pipeline(training, linear_svm, 10.0, "balanced", max_iter=30)
    assert score(model, training).filter("label = prediction").count() >= 57


def sums(training, fold=None):
    """The features and signed labels of the rows outside a fold, with that fold's vocabulary."""
    rows = training if fold is None else training.filter(F.col("fold") != fold)
    found = tfidf_model(tfidf_fit(rows)).transform(rows).select("features", "label").collect()
    return np.array([r["features"].toArray() for r in found]), np.array([2.0 * r["label"] - 1 for r in found])


def test_squared_hinge_is_the_optimum(training):
    """Against gradient descent on C · Σ w · max(0, 1 - margin)² + ½|b|², the intercept penalised too."""
    for C, weighting in ((0.5, "balanced"), (10.0, None)):
        model = fit_pipeline(training, linear_svm, C, weighting)
        x, y = sums(training)
        x = np.hstack([x, np.ones((len(x), 1))])
        n1 = (y > 0).sum()
        weight = np.where(y > 0, len(y) / (2 * n1), len(y) / (2 * (len(y) - n1))) if weighting else np.ones(len(y))
        w = np.zeros(x.shape[1])
        rate = 1 / (1 + 2 * C * weight.max() * np.linalg.norm(x, 2) ** 2)
        for _ in range(100_000):
            w -= rate * (w - 2 * C * x.T @ (weight * np.maximum(0, 1 - y * (x @ w)) * y))
        assert model.stages[-1].coefficients.toArray() == pytest.approx(w[:-1], abs=1e-3)
        assert model.stages[-1].intercept == pytest.approx(w[-1], abs=1e-3)
        at = objective(model, training, C, weighting)
        assert at[2] < min(at[0], at[1], at[3])


def test_stacked_fits_equal_single_ones(training):
    """All fits of a grid, in few passes, against Spark's own solver fold by fold."""
    params = [(0.1, None), (10.0, "balanced")]
    own = fold_vocabularies(training, "fold", 3)
    counts = [class_counts(training.filter(F.col("fold") != i), "label") for i in range(3)]
    *_, tasks, fits, _ = _fit_all(training, logistic_regression, "text", "label", "fold", own, [0, 1, 2], [params] * 3, counts)
    assert len(fits) == 6 and max(f.passes for f in fits) <= 15 and all(f.converged for f in fits)
    for m, (task, fit) in enumerate(zip(tasks, fits)):
        i, (C, weighting) = task.space, params[m % 2]
        rows = tfidf_model(own[i]).transform(training.filter(F.col("fold") != i)).withColumn("label", F.col("label").cast("double"))
        weight = F.when(F.col("label") == 1, task.weights[1]).otherwise(task.weights[0])
        wanted = LogisticRegression(weightCol="w", regParam=1 / (C * rows.count()), standardization=False, maxIter=1000,
                                    tol=1e-12).fit(rows.withColumn("w", weight))
        assert fit.coefficients == pytest.approx(wanted.coefficients.toArray(), abs=1e-3)
        assert fit.intercept == pytest.approx(wanted.intercept, abs=1e-3)


def test_one_class_and_rows_without_terms(training):
    only = training.withColumn("label", F.lit(1))
    for loss in (logistic_regression, linear_svm):
        assert score(fit_pipeline(only, loss, 1.0, "balanced"), only).filter("prediction = 1").count() == 60
    blank = training.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text")))
    assert score(fit_pipeline(blank, linear_svm, 1.0, "balanced"), blank).filter("prediction is null").count() == 0


def test_batch_predict(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(50, 4)).astype("float32")
    weights, bias = rng.normal(size=(3, 4)), np.array([0.0, 0.1, 500.0])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "i int, v array<float>")
    for head, b in ((weights[:2], bias[:2]), (weights, bias)):
        out = batch_predict(df, linear_head(head, b), "v", [4], batch_size=7).orderBy("i").collect()
        logits = vectors.astype("float64") @ head.T + b
        exps = np.exp(logits - logits.max(axis=1, keepdims=True))
        assert [r["prediction"] for r in out] == logits.argmax(axis=1).tolist()
        assert [r["probability"] for r in out] == pytest.approx((exps[:, 1] / exps.sum(axis=1)).tolist())
    assert batch_predict(df.limit(0), linear_head(weights, bias), "v", [4]).filter(F.lit(True)).count() == 0


def test_pairs_of_rare_words_are_not_counted(spark, monkeypatch):
    """The same vocabulary as from all n-grams, though only pairs of frequent words are counted."""
    import random

    from cuemill.operators import features

    pick = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(pick.choices(words, [1 / (i + 1) for i in range(60)], k=40)) + f" rare{i} rare{i} w0" for i in range(60)] + [None, ""]
    rows = spark.createDataFrame([(i, t, i % 4 - 1) for i, t in enumerate(texts)], "id long, text string, fold int")
    for size, min_df, max_df in ((5, 2, 0.95), (40, 2, 0.5), (90, 3, 0.95), (100_000, 2, 0.95), (7, 1, 1.0)):
        stats = top_vocabulary(term_stats(rows), rows.count(), min_df, max_df, size)
        want = sorted((r["term"], r["tf"], r["df"]) for r in stats.collect())
        got = [(r["term"], r["tf"], r["df"]) for r in tfidf_fit(rows, min_df=min_df, max_df=max_df, size=size).collect()]
        assert sorted(got) == want
    short = [[tuple(r) for r in v] for v in fold_vocabularies(rows, "fold", 3, size=30)]
    counted = []
    monkeypatch.setattr(features, "term_stats", lambda *a, **k: counted.append(term_stats(*a, **k)) or counted[-1])
    tfidf_fit(rows, size=10)
    assert sum(c.count() for c in counted) < term_stats(rows).count() / 2
    monkeypatch.setattr(features, "_collected", lambda words: None)
    assert [[tuple(r) for r in v] for v in fold_vocabularies(rows, "fold", 3, size=30)] == short

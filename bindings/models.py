"""TF-IDF, classifiers, batch scoring and streams."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from bindings.columns import TOKENS
from bindings.common import (
    GOLD,
    METRIC_NAMES,
    RELEVANCE,
    SCORED,
    articles,
    gold,
    query,
    rounded,
    table,
    word_regex,
)
from bindings.splits import FOLDS, folded
from cuemill.operators.classify import (
    cross_val_predict,
    fit_pipeline,
    linear_svm,
    logistic_regression,
    logreg_grid,
    objective,
    score,
    svm_grid,
)
from cuemill.operators.features import term_stats, tfidf_fit, tfidf_transform, top_vocabulary
from cuemill.operators.metrics import fold_metrics
from cuemill.operators.scoring import batch_predict, linear_head
from cuemill.plans.training import evaluate_models
from cuemill.session import scratch_path, stored
from cuemill.sources.models import load_model, save_model
from cuemill.streaming.feeds import (
    read_feed,
    read_feed_run,
    run_to_end,
    stream_dedup,
    stream_first_versions,
    stream_relevance,
    write_feed_run,
)

VOCABULARY = f"""{TOKENS}, u AS (SELECT doc_id, unnest(g) AS term FROM grams),
  stats AS (SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM u GROUP BY term),
  size AS (SELECT count(*) AS n FROM documents),
  top AS (SELECT term, tf, df FROM stats, size WHERE df >= 2 AND df <= 0.95::DOUBLE * n
          ORDER BY tf DESC, term LIMIT 500),
  vocab AS (SELECT term, row_number() OVER (ORDER BY term) - 1 AS idx, tf, df,
            ln((1 + n)::DOUBLE / (1 + df)) + 1 AS idf FROM top, size)"""


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text")


@query("top_vocabulary", f"WITH {VOCABULARY} SELECT term, tf, df FROM top")
def top_vocabulary_(spark, sf):
    docs = _docs(spark, sf)
    return top_vocabulary(term_stats(docs), docs.agg(F.count("*")).scalar())


@query("tfidf_fit", f"""WITH {VOCABULARY} SELECT term, CAST(idx AS INTEGER) AS idx, tf, df,
  round(idf, 6) AS idf FROM vocab""")
def tfidf_fit_(spark, sf):
    return rounded(tfidf_fit(_docs(spark, sf)), "idf")


@query("tfidf_transform", f"""WITH {VOCABULARY}, w AS (SELECT doc_id, term, count(*) * any_value(idf) AS w
    FROM u JOIN vocab USING (term) GROUP BY doc_id, term)
  SELECT doc_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)), 6) AS weight FROM w""")
def tfidf_transform_(spark, sf):
    docs = _docs(spark, sf)
    return rounded(tfidf_transform(docs, tfidf_fit(docs)), "weight")


def _training(spark, sf):
    """Gold documents with five folds; written once, read by many passes."""
    texts = gold(spark, sf).select("doc_id", "dataset", F.col("sentence").alias("text"))
    folds = folded(spark, sf).select("doc_id", F.col("gold_label").alias("label"), "fold")
    return stored(folds.join(texts, "doc_id"), "training")


# The values depend on the optimizer's path; these say what must hold for any of them.
GRID_SQL = """SELECT C, class_weight, 1 AS in_range, 1 AS best_is_first_maximum, 1 AS is_optimum
  FROM (VALUES (0.01::DOUBLE), (0.1::DOUBLE), (1.0::DOUBLE), (10.0::DOUBLE)) c(C),
       (VALUES ('balanced'), (NULL)) w(class_weight)"""


def _grid_rows(found, rows):
    """One row per parameter pair: F1 in [0, 1], the best one marked, the refit at its optimum."""
    scores = [f1 for _, _, f1, _ in found.table]
    first = scores.index(max(scores))
    at = objective(found.model, rows, found.params["C"], found.params["class_weight"])
    optimum = int(at[2] <= min(at) + 1e-9)
    out = [(c, w, int(0 <= f1 <= 1), int(best == (i == first)), optimum)
           for i, (c, w, f1, best) in enumerate(found.table)]
    return rows.sparkSession.createDataFrame(
        out, "C double, class_weight string, in_range int, best_is_first_maximum int, is_optimum int")


@query("logreg_grid", GRID_SQL)
def logreg_grid_(spark, sf):
    rows = _training(spark, sf)
    return _grid_rows(logreg_grid(rows), rows)


@query("svm_grid", GRID_SQL)
def svm_grid_(spark, sf):
    rows = _training(spark, sf)
    return _grid_rows(svm_grid(rows), rows)


# What a model that guesses cannot reach: macro F1 of guessing is at most one half.
def _informed(tp, fp, fn, tn):
    one, zero = 2 * F.col(tp) / (2 * F.col(tp) + F.col(fp) + F.col(fn)), 2 * F.col(tn) / (2 * F.col(tn) + F.col(fp) + F.col(fn))
    return ((one + zero) / 2 > 0.6).cast("int")


@query("cross_val_predict", f"""WITH {FOLDS} SELECT doc_id, gold_label AS label, dataset, fold, 1 AS is_class,
  1 AS is_informed FROM folds""")
def cross_val_predict_(spark, sf):
    out = stored(cross_val_predict(_training(spark, sf), logistic_regression, 1.0, "balanced"), "predicted")
    all_folds = fold_metrics(out, "label").filter("fold = -1").select(_informed("tp", "fp", "fn", "tn").alias("is_informed"))
    # One row.
    return out.crossJoin(F.broadcast(all_folds)).select(
        "doc_id", "label", "dataset", "fold", F.col("prediction").isin(0, 1).cast("int").alias("is_class"), "is_informed")


@query("out_of_fold_metrics", f"""WITH {FOLDS} SELECT fold, count(*) AS n,
    count(*) FILTER (gold_label = 1) AS positives, 1 AS in_range, NULL AS is_informed FROM folds GROUP BY fold
  UNION ALL SELECT -1, count(*), count(*) FILTER (gold_label = 1), 1, 1 FROM folds""")
def out_of_fold_metrics(spark, sf):
    out = cross_val_predict(_training(spark, sf), linear_svm, 1.0, "balanced")
    metrics = fold_metrics(out, "label")
    in_range = F.lit(True)
    for c in METRIC_NAMES:
        in_range = in_range & F.col(c).between(0, 1)
    return metrics.select("fold", (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n"),
                          (F.col("tp") + F.col("fn")).alias("positives"), in_range.cast("int").alias("in_range"),
                          F.when(F.col("fold") == -1, _informed("tp", "fp", "fn", "tn")).alias("is_informed"))


@query("score_model", "SELECT doc_id, 1 AS in_range, 1 AS is_half_rule, 1 AS is_optimum FROM documents")
def score_model(spark, sf):
    rows = _training(spark, sf)
    model = fit_pipeline(rows, logistic_regression, 1.0, "balanced")
    at = objective(model, rows, 1.0, "balanced")
    rule = (F.col("probability") > 0.5).cast("int") == F.col("prediction")
    return score(model, _docs(spark, sf)).select(
        "doc_id", F.col("probability").between(0, 1).cast("int").alias("in_range"),
        rule.cast("int").alias("is_half_rule"), F.lit(int(at[2] < min(at[0], at[1], at[3]))).alias("is_optimum"))


@query("evaluate_models", f"""WITH {GOLD}, m AS (SELECT unnest(['lr', 'svm']) AS model)
  SELECT model, dataset, count(*) AS n, count(*) FILTER (gold_label = 1) AS positives,
    CAST(model = 'lr' AS INTEGER) AS has_auc, 1 AS errors_add_up, 1 AS in_range, 1 AS is_informed
  FROM gold, m GROUP BY model, dataset""")
def evaluate_models_(spark, sf):
    train = _training(spark, sf)
    models = {name: load_model(save_model(fit_pipeline(train, trainer, 1.0, "balanced"), scratch_path(spark, name)))
              for name, trainer in (("lr", logistic_regression), ("svm", linear_svm))}
    rows = train.withColumnRenamed("label", "gold_label")
    table_, errors = evaluate_models(models, rows, "doc_id")
    wrong = errors.groupBy("model", "dataset").agg(F.count("*").alias("errors"))
    both = table_.join(wrong, ["model", "dataset"], "left").withColumn("errors", F.coalesce("errors", F.lit(0)))
    in_range = F.coalesce(F.col("auc").between(0, 1), F.lit(True)) & F.col("f1_macro").between(0, 1)
    return both.select(
        "model", "dataset", (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("n"),
        (F.col("tp") + F.col("fn")).alias("positives"), F.col("auc").isNotNull().cast("int").alias("has_auc"),
        (F.col("errors") == F.col("fp") + F.col("fn")).cast("int").alias("errors_add_up"),
        in_range.cast("int").alias("in_range"), _informed("tp", "fp", "fn", "tn").alias("is_informed"))


HEAD = np.array([[((j * 17) % 7 - 3) / 10 for j in range(64)],
                 [((j * 37) % 11 - 5) / 10 for j in range(64)]])


def _logit_sql(i: int) -> str:
    weights = ", ".join(repr(float(w)) for w in HEAD[i])
    bias = (0.05, -0.05)[i]
    return f"list_dot_product(CAST(embedding AS DOUBLE[]), [{weights}]::DOUBLE[]) + {bias}"


@query("batch_predict", f"""WITH z AS (SELECT vec_id, {_logit_sql(0)} AS a, {_logit_sql(1)} AS b
    FROM embeddings)
  SELECT vec_id, CAST(b > a AS INTEGER) AS prediction, round(exp(b) / (exp(a) + exp(b)), 6) AS probability
  FROM z""")
def batch_predict_(spark, sf):
    vectors = table(spark, sf, "embeddings").select("vec_id", "embedding")
    head = linear_head(HEAD, np.array([0.05, -0.05]))
    out = batch_predict(vectors, head, "embedding", [64], batch_size=64)
    return rounded(out, "probability").drop("embedding")


ANY_OF, NONE_OF = ("the", "que", "und"), ("password",)


@query("stream_relevance", f"""WITH {SCORED}, q AS (SELECT * FROM scored
    WHERE regexp_matches(lower(title || ' ' || description), '{word_regex(ANY_OF)}')
      AND NOT regexp_matches(lower(title || ' ' || description), '{word_regex(NONE_OF)}'))
  SELECT doc_id, title, relevance_score, 'filtered' AS kind FROM q WHERE lang = 'en' AND relevance_score >= 3
  UNION ALL SELECT doc_id, title, NULL, 'raw' FROM scored""")
def stream_relevance_(spark, sf):
    folder, out = scratch_path(spark, "feed"), scratch_path(spark, "run")
    feed = articles(spark, sf).select("doc_id", "lang", "title", "description")
    feed.repartition(6).write.json(folder)
    source = read_feed(spark, folder, feed.schema, files_per_batch=1)

    def scored(rows):
        return stream_relevance(rows, RELEVANCE, lang="en", any_of=ANY_OF, none_of=NONE_OF)

    write_feed_run(source, scored, out, scratch_path(spark, "checkpoint")).awaitTermination()
    kinds = [read_feed_run(spark, out, kind, schema).select(
        "doc_id", "title", score.cast("int").alias("relevance_score"), F.lit(kind).alias("kind"))
        for kind, schema, score in (("filtered", scored(feed).schema, F.col("relevance_score")), ("raw", feed.schema, F.lit(None)))]
    return kinds[0].unionByName(kinds[1])


@query("stream_dedup", "SELECT DISTINCT user_id, event_type FROM events")
def stream_dedup_(spark, sf):
    folder = scratch_path(spark, "events")
    events = table(spark, sf, "events").select("user_id", "event_type", "ts")
    events.write.parquet(folder)
    # One batch: within it, repeats go at any distance.
    rows = stream_dedup(read_feed(spark, folder, events.schema, "parquet", files_per_batch=1_000_000),
                        ["user_id", "event_type"], "ts", "7 days")
    out = run_to_end(rows, scratch_path(spark, "unique"), scratch_path(spark, "checkpoint"))
    return out.select("user_id", "event_type")


# Events come in polls of five days; one in twenty is three polls late. A window closes behind the poll
# that moves the watermark (latest event so far less four days) to its end.
POLLS = """polled AS (SELECT user_id, event_type, ts, CAST(floor(epoch(ts - TIMESTAMP '2024-01-01') / 432000) AS INTEGER)
      + CASE WHEN event_id % 20 = 0 THEN 3 ELSE 0 END AS poll FROM events),
  mark AS (SELECT poll, max(max(ts)) OVER (ORDER BY poll) - INTERVAL 4 DAY AS w FROM polled GROUP BY poll),
  timely AS (SELECT user_id, event_type, p.poll, min(ts) AS ts FROM polled p
    LEFT JOIN (SELECT lead(poll) OVER (ORDER BY poll) AS poll, w FROM mark) m ON m.poll = p.poll
    WHERE m.w IS NULL OR ts > m.w GROUP BY ALL)"""


@query("stream_first_versions", f"""WITH RECURSIVE {POLLS},
  opened AS (SELECT user_id, event_type, min(poll) AS poll, arg_min(ts, poll) + INTERVAL 4 DAY AS closes FROM timely GROUP BY ALL
    UNION ALL SELECT t.user_id, t.event_type, min(t.poll), arg_min(t.ts, t.poll) + INTERVAL 4 DAY
    FROM (SELECT o.user_id, o.event_type, o.poll, min(m.poll) AS until FROM opened o JOIN mark m ON m.w >= o.closes GROUP BY ALL) e
    JOIN timely t ON t.user_id = e.user_id AND t.event_type = e.event_type AND t.poll > e.until GROUP BY t.user_id, t.event_type, e.poll),
  closed AS (SELECT o.user_id, o.event_type, o.poll, min(m.poll) AS until FROM opened o JOIN mark m ON m.w >= o.closes
    AND m.poll >= o.poll GROUP BY ALL)
  SELECT c.user_id, c.event_type, min(t.ts) AS ts FROM closed c JOIN timely t ON t.user_id = c.user_id AND t.event_type = c.event_type
    AND t.poll BETWEEN c.poll AND c.until GROUP BY c.user_id, c.event_type, c.poll""")
def stream_first_versions_(spark, sf):
    folder, sink, checkpoint = (scratch_path(spark, n) for n in ("polls", "versions", "checkpoint"))
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    events = table(spark, sf, "events").select(
        "user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"),
        (F.floor(day / 5) + F.when(F.col("event_id") % 20 == 0, 3).otherwise(0)).cast("int").alias("poll"))
    polls = stored(events, "events")
    # One number per poll of the month.
    for poll in sorted(r["poll"] for r in polls.select("poll").distinct().collect()):
        polls.filter(F.col("poll") == poll).drop("poll").write.mode("append").parquet(folder)
        feed = read_feed(spark, folder, polls.drop("poll").schema, "parquet", files_per_batch=1_000_000)
        rows = stream_first_versions(feed, ["user_id", "event_type"], "ts", "4 days", 4 * 86_400_000)
        out = run_to_end(rows, sink, checkpoint)
    return out.select("user_id", "event_type", F.col("ts").cast("timestamp_ntz").alias("ts"))

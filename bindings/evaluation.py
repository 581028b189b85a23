"""Counts, metrics, agreement and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.columns import HOST_SQL, TOKENS
from bindings.common import (
    CUES,
    DOMAINS,
    MACRO,
    METRIC_NAMES,
    METRICS,
    PREDICTIONS,
    RELEVANCE,
    SCORED,
    TOPICS,
    VALID,
    articles,
    contains_sql,
    counts_sql,
    gold,
    predictions,
    query,
    rounded,
    substring_sql,
    table,
    valid,
    with_position,
)
from bindings.splits import FOLDS, folded
from cuemill.operators.agreement import agreement, cohen_kappa
from cuemill.operators.features import term_stats
from cuemill.operators.joins import pair_annotators
from cuemill.operators.metrics import (
    best_model,
    comparison_report,
    confusion_long,
    confusion_metrics,
    feed_quality,
    fold_metrics,
    hedge_rate,
    melt_metrics,
    metrics_by_source,
    report_json,
    roc_auc,
    roc_curve,
    score_stats,
    summary,
    with_macro_f1,
)
from cuemill.operators.ranking import score_articles
from cuemill.plans.training import error_analysis, keyword_baseline_eval, write_error_tables
from cuemill.session import scratch_path

SUMMARY = f"""{PREDICTIONS}, counted AS (
    SELECT model, dataset, {counts_sql()} FROM predictions GROUP BY model, dataset),
  summary AS (SELECT model, dataset, {METRICS}, tp, tn, fp, fn, {MACRO} AS f1_macro FROM counted)"""
COLUMNS = "accuracy, precision, recall, f1, tp, tn, fp, fn"


@query("hedge_rate", f"""WITH {VALID} SELECT source, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives,
  CAST(sum(1 - label) AS BIGINT) AS negatives, round(avg(label), 6) AS rate FROM valid GROUP BY source""")
def hedge_rate_(spark, sf):
    return rounded(hedge_rate(valid(spark, sf), ["source"]), "rate")


@query("confusion_metrics", f"WITH {SUMMARY} SELECT model, dataset, {COLUMNS} FROM summary")
def confusion_metrics_(spark, sf):
    return rounded(confusion_metrics(predictions(spark, sf), by=["model", "dataset"]), *METRIC_NAMES)


@query("macro_f1", f"WITH {SUMMARY} SELECT model, dataset, f1_macro FROM summary")
def macro_f1_(spark, sf):
    counts = confusion_metrics(predictions(spark, sf), by=["model", "dataset"])
    return rounded(with_macro_f1(counts), "f1_macro").select("model", "dataset", "f1_macro")


# A score without ties and one with many, each with its label.
SCORES = f"""{PREDICTIONS}, scores AS (
    SELECT 'vector' AS kind, CAST(embedding[1] AS DOUBLE) AS score, CAST(label >= 5 AS INTEGER) AS y
    FROM embeddings
    UNION ALL SELECT 'share', probability, gold_label FROM scored)"""


def scores(spark, sf):
    vectors = table(spark, sf, "embeddings").select(
        F.lit("vector").alias("kind"), F.get("embedding", F.lit(0)).cast("double").alias("score"),
        (F.col("label") >= 5).cast("int").alias("y"))
    shares = predictions(spark, sf).filter("model = 'boundary'").select(
        F.lit("share").alias("kind"), F.col("probability").alias("score"),
        F.col("gold_label").alias("y"))
    return vectors.unionByName(shares)


@query("roc_auc", f"""WITH {SCORES}, g AS (SELECT kind, score, count(*) FILTER (y = 1) AS p,
    count(*) FILTER (y = 0) AS n FROM scores GROUP BY kind, score),
  c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY kind ORDER BY score
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g)
  SELECT kind, round(sum(p * (below + n / 2.0::DOUBLE)) / (sum(p) * sum(n)), 6) AS auc
  FROM c GROUP BY kind""")
def roc_auc_(spark, sf):
    return rounded(roc_auc(scores(spark, sf), "y", "score", ["kind"]), "auc")


@query("roc_curve", f"""WITH {SCORES}, g AS (SELECT kind, score, count(*) FILTER (y = 1) AS p,
    count(*) FILTER (y = 0) AS n FROM scores GROUP BY kind, score)
  SELECT kind, round(score, 6) AS threshold,
    round(sum(n) OVER w / sum(n) OVER (PARTITION BY kind)::DOUBLE, 6) AS fpr,
    round(sum(p) OVER w / sum(p) OVER (PARTITION BY kind)::DOUBLE, 6) AS tpr
  FROM g WINDOW w AS (PARTITION BY kind ORDER BY score DESC)
  UNION ALL SELECT DISTINCT kind, 'inf'::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE FROM g""")
def roc_curve_(spark, sf):
    return rounded(roc_curve(scores(spark, sf), "y", "score", ["kind"]), "threshold", "fpr", "tpr")


@query("summary_by_model_split", f"""WITH {SUMMARY}, g AS (SELECT model, dataset, probability AS score,
    count(*) FILTER (gold_label = 1) AS p, count(*) FILTER (gold_label = 0) AS n
    FROM predictions GROUP BY ALL),
  c AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY model, dataset ORDER BY score
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below FROM g),
  a AS (SELECT model, dataset, round(sum(p * (below + n / 2.0::DOUBLE)) / (sum(p) * sum(n)), 6) AS auc
        FROM c GROUP BY model, dataset)
  SELECT model, dataset, {COLUMNS}, f1_macro, auc FROM summary JOIN a USING (model, dataset)""")
def summary_by_model_split(spark, sf):
    rows = summary(predictions(spark, sf), probability="probability")
    return rounded(rows, *METRIC_NAMES, "f1_macro", "auc")


@query("gold_vs_all_metrics", f"""WITH {PREDICTIONS}, one AS (SELECT * FROM predictions
    WHERE model = 'boundary'), c AS (
    SELECT dataset AS source, {counts_sql()} FROM one GROUP BY dataset
    UNION ALL SELECT 'all', {counts_sql()} FROM one)
  SELECT source, {METRICS}, tp, tn, fp, fn FROM c""")
def gold_vs_all_metrics(spark, sf):
    rows = predictions(spark, sf).filter("model = 'boundary'").withColumnRenamed("dataset", "source")
    return rounded(metrics_by_source(rows, "gold_label"), *METRIC_NAMES)


@query("fold_metrics", f"""WITH {FOLDS}, p AS (SELECT f.fold, f.gold_label,
    {substring_sql('g.sentence')} AS prediction FROM folds f JOIN gold g USING (doc_id)), c AS (
    SELECT fold, {counts_sql()} FROM p GROUP BY fold UNION ALL SELECT -1, {counts_sql()} FROM p)
  SELECT fold, {METRICS}, tp, tn, fp, fn FROM c""")
def fold_metrics_(spark, sf):
    own = predictions(spark, sf).filter("model = 'substring'").select("doc_id", "prediction")
    return rounded(fold_metrics(folded(spark, sf).join(own, "doc_id")), *METRIC_NAMES)


@query("cohen_kappa", """WITH p AS (SELECT quality AS a, 1 - toxic AS b FROM labels),
  n AS (SELECT count(*)::DOUBLE AS n, avg(CAST(a = b AS INTEGER)) AS po FROM p),
  m AS (SELECT label, count(*) FILTER (side = 0) AS na, count(*) FILTER (side = 1) AS nb
        FROM (SELECT a AS label, 0 AS side FROM p UNION ALL SELECT b, 1 FROM p) GROUP BY label),
  e AS (SELECT sum(na * nb) / (SELECT n * n FROM n) AS pe FROM m)
  SELECT round(po, 6) AS po, round(pe, 6) AS pe, round((po - pe) / (1 - pe), 6) AS kappa FROM n, e""")
def cohen_kappa_(spark, sf):
    return rounded(cohen_kappa(_annotators(spark, sf)), "po", "pe", "kappa")


def _annotators(spark, sf):
    labels = table(spark, sf, "labels")
    return pair_annotators(labels.select("doc_id", F.col("quality").alias("gold_label")),
                           labels.select("doc_id", (1 - F.col("toxic")).alias("gold_label")), "doc_id")


@query("agreement_categories", """WITH p AS (SELECT CASE WHEN quality = 1 - toxic THEN 'Agreed'
    WHEN toxic = 0 THEN 'Missed Hedge (A2 found)' ELSE 'False Alarm (A2 found)' END AS category
    FROM labels)
  SELECT category, count(*) AS n, round(100.0::DOUBLE * count(*) / (SELECT count(*) FROM p), 6) AS pct
  FROM p GROUP BY category""")
def agreement_categories(spark, sf):
    return rounded(agreement(_annotators(spark, sf), "label_a", "label_b"), "pct")


@query("score_stats", f"""WITH {SCORED} SELECT min(relevance_score) AS min, max(relevance_score) AS max,
  round(avg(relevance_score), 6) AS avg FROM scored""")
def score_stats_(spark, sf):
    scored = score_articles(articles(spark, sf), RELEVANCE, min_score=None)
    return rounded(score_stats(scored), "avg")


PAGE_TITLE = "regexp_extract(html, '(?is)<title>(.*?)</title>', 1)"


@query("feed_quality_report", f"""WITH p AS (SELECT url, {PAGE_TITLE} AS title, '' AS description FROM pages),
  c AS (SELECT *, coalesce(url, '') = '' OR coalesce(title, '') = '' AS missing,
    {contains_sql("title || ' ' || description", TOPICS)} AS topical,
    {HOST_SQL} NOT IN ({', '.join(repr(d) for d in DOMAINS)}) AS wrong FROM p),
  r AS (SELECT count(*) AS total, count(*) FILTER (NOT missing AND topical) AS topical,
    count(*) FILTER (NOT missing AND NOT topical) AS not_topical,
    count(*) FILTER (NOT missing AND wrong) AS wrong_domain,
    count(*) FILTER (missing) AS missing_fields FROM c)
  SELECT *, CASE WHEN wrong_domain = 0 THEN 'pass' ELSE 'warn' END AS domain_check,
    CASE WHEN missing_fields = 0 THEN 'pass' ELSE 'warn' END AS field_check,
    CASE WHEN topical > 0 THEN 'pass' ELSE 'warn' END AS topic_check FROM r""")
def feed_quality_report(spark, sf):
    feed = table(spark, sf, "pages").select(
        "url", F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1).alias("title"),
        F.lit("").alias("description"))
    return feed_quality(feed, DOMAINS, TOPICS)


LISTED = "list_position(['substring', 'boundary', 'token_set'], model)"


@query("best_model", f"""WITH {SUMMARY}, t AS (SELECT * FROM summary WHERE dataset = 'test')
  (SELECT 'f1' AS metric, model, f1 AS value FROM t ORDER BY f1 DESC, {LISTED} LIMIT 1)
  UNION ALL (SELECT 'accuracy', model, accuracy FROM t ORDER BY accuracy DESC, {LISTED} LIMIT 1)""")
def best_model_(spark, sf):
    rows = rounded(confusion_metrics(predictions(spark, sf), by=["model", "dataset"]), *METRIC_NAMES)
    test = with_position(rows.filter("dataset = 'test'"))
    return best_model(test, ["f1", "accuracy"])


SHOWN = {"substring": "Baseline (Keyword)", "boundary": "Boundary", "token_set": "Token Set"}


def _report(spark, sf):
    rows = rounded(confusion_metrics(predictions(spark, sf), by=["model", "dataset"]), *METRIC_NAMES)
    return comparison_report(with_position(rows), SHOWN)


@query("comparison_report", f"""WITH {SUMMARY}, t AS (SELECT *, {LISTED} AS place,
    CASE model WHEN 'substring' THEN 'Baseline (Keyword)' WHEN 'boundary' THEN 'Boundary'
      ELSE 'Token Set' END AS shown FROM summary)
  SELECT dataset, shown AS model, {COLUMNS},
    dataset = 'test' AND row_number() OVER (PARTITION BY dataset ORDER BY f1 DESC, place) = 1 AS best_f1,
    dataset = 'test' AND row_number() OVER (PARTITION BY dataset ORDER BY accuracy DESC, place) = 1
      AS best_accuracy FROM t""")
def comparison_report_(spark, sf):
    return _report(spark, sf)


@query("comparison_report_json", f"""WITH {SUMMARY}, t AS (SELECT *, {LISTED} AS place,
    CASE model WHEN 'substring' THEN 'Baseline (Keyword)' WHEN 'boundary' THEN 'Boundary'
      ELSE 'Token Set' END AS shown FROM summary)
  SELECT dataset, shown AS model, {COLUMNS},
    (SELECT shown FROM t WHERE dataset = 'test' ORDER BY f1 DESC, place LIMIT 1) AS best_f1_model,
    (SELECT shown FROM t WHERE dataset = 'test' ORDER BY accuracy DESC, place LIMIT 1) AS best_accuracy_model
  FROM t""")
def comparison_report_json(spark, sf):
    numbers = ", ".join(f"{c}: double" for c in METRIC_NAMES) + ", tp: bigint, tn: bigint, fp: bigint, fn: bigint"
    body = F.from_json("report", f"""best_f1_model string, best_accuracy_model string,
        test_results map<string, struct<{numbers}>>, dev_results map<string, struct<{numbers}>>""")
    rows = report_json(_report(spark, sf)).select(body.alias("r"))
    best = ["r.best_f1_model", "r.best_accuracy_model"]
    parts = [rows.select(F.lit(name).alias("dataset"), *best, F.explode(f"r.{name}_results").alias("model", "m"))
             for name in ("test", "dev")]
    return parts[0].union(parts[1]).select("dataset", "model", "m.*", "best_f1_model", "best_accuracy_model")


@query("term_doc_freq", f"""WITH {TOKENS}, u AS (SELECT doc_id, unnest(g) AS term FROM grams)
  SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM u GROUP BY term""")
def term_doc_freq(spark, sf):
    return term_stats(table(spark, sf, "documents").select("text"))


@query("melt_metrics", f"""WITH {SUMMARY}, t AS (SELECT model, accuracy, f1, precision, recall
    FROM summary WHERE dataset = 'test')
  SELECT model, 'accuracy' AS "Metric", accuracy AS "Score" FROM t
  UNION ALL SELECT model, 'f1', f1 FROM t UNION ALL SELECT model, 'precision', precision FROM t
  UNION ALL SELECT model, 'recall', recall FROM t""")
def melt_metrics_(spark, sf):
    rows = rounded(confusion_metrics(predictions(spark, sf), by=["model", "dataset"]), *METRIC_NAMES)
    return melt_metrics(rows.filter("dataset = 'test'"))


@query("confusion_matrix_long", f"""WITH {PREDICTIONS}, one AS (SELECT * FROM predictions
    WHERE model = 'boundary')
  SELECT c.actual, c.pred, count(o.doc_id) AS n
  FROM (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) c(actual, pred)
  LEFT JOIN one o ON o.gold_label = c.actual AND o.prediction = c.pred GROUP BY ALL""")
def confusion_matrix_long(spark, sf):
    return confusion_long(predictions(spark, sf).filter("model = 'boundary'"))


@query("keyword_baseline_eval", f"""WITH {SUMMARY}
  SELECT 'baseline' AS model, dataset, {COLUMNS}, f1_macro FROM summary WHERE model = 'substring'""")
def keyword_baseline_eval_(spark, sf):
    return rounded(keyword_baseline_eval(gold(spark, sf), CUES), *METRIC_NAMES, "f1_macro")


@query("error_analysis", f"""WITH {PREDICTIONS} SELECT doc_id, model, dataset, gold_label, prediction,
    round(probability, 6) AS probability,
    CASE WHEN prediction = 1 THEN 'false_positive' ELSE 'false_negative' END AS error_type
  FROM predictions WHERE prediction <> gold_label""")
def error_analysis_(spark, sf):
    path = write_error_tables(error_analysis(predictions(spark, sf)), scratch_path(spark, "errors"))
    schema = ("doc_id bigint, gold_label int, prediction int, probability double, model string, "
              "dataset string, error_type string")
    return rounded(spark.read.schema(schema).option("header", True).csv(path), "probability")

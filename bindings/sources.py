"""Sources and sinks: tables go out in a format and come back."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from bindings.common import (
    METRIC_NAMES,
    METRICS,
    PIECES,
    PREDICTIONS,
    RELEVANCE,
    SCORED,
    VALID,
    articles,
    counts_sql,
    gold,
    pieces,
    predictions,
    query,
    rounded,
    table,
    valid,
)
from cuemill.operators.classify import fit_pipeline, logistic_regression, score
from cuemill.operators.filters import only
from cuemill.operators.metrics import confusion_metrics, hedge_rate
from cuemill.operators.ranking import score_articles
from cuemill.operators.sampling import hash_split
from cuemill.session import scratch_path
from cuemill.sources.metrics_files import read_metrics, write_metrics
from cuemill.sources.models import load_models, save_model
from cuemill.sources.sinks import write_csv, write_json_array, write_json_run, write_splits
from cuemill.sources.tables import (
    read_csv,
    read_csv_any_encoding,
    read_json_array,
    read_jsonl,
    read_mixed,
    read_parquet,
    require_columns,
)

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ALL_DOCUMENTS = "SELECT doc_id, text, lang, source, n_chars FROM documents"


@query("scan_csv", ALL_DOCUMENTS)
def scan_csv(spark, sf):
    path = write_csv(table(spark, sf, "documents"), scratch_path(spark, "csv"))
    return read_csv(spark, path, DOCUMENTS)


@query("scan_csv_encoding", ALL_DOCUMENTS)
def scan_csv_encoding(spark, sf):
    docs = table(spark, sf, "documents")
    latin = F.coalesce((F.col("lang") != "en") & ~F.col("text").rlike(r"[^\x00-\xff]"), F.lit(False))
    path = scratch_path(spark, "csv-encoding")
    write_csv(docs.filter(~latin), f"{path}/a")
    write_csv(docs.filter(latin), f"{path}/b", encoding="ISO-8859-1")
    return read_csv_any_encoding(spark, [f"{path}/a", f"{path}/b"], DOCUMENTS)


@query("scan_parquet", "SELECT doc_id, lang, n_chars FROM documents")
def scan_parquet(spark, sf):
    return read_parquet(spark, f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars")


@query("scan_json_lines", ALL_DOCUMENTS)
def scan_json_lines(spark, sf):
    path = scratch_path(spark, "jsonl")
    table(spark, sf, "documents").write.json(path)
    return read_jsonl(spark, path, DOCUMENTS)


@query("scan_json_array", ALL_DOCUMENTS)
def scan_json_array(spark, sf):
    path = write_json_array(table(spark, sf, "documents"), scratch_path(spark, "json-array"),
                            "doc_id", 500)
    return read_json_array(spark, path, DOCUMENTS)


@query("scan_folder_mixed", ALL_DOCUMENTS)
def scan_folder_mixed(spark, sf):
    docs = table(spark, sf, "documents")
    path = scratch_path(spark, "mixed")
    docs.filter("lang = 'en'").write.parquet(f"{path}/a")
    write_csv(docs.filter("lang = 'fr'"), f"{path}/b")
    docs.filter("lang IS NULL OR lang NOT IN ('en', 'fr')").write.json(f"{path}/c")
    return read_mixed(spark, [f"{path}/absent", path], DOCUMENTS, DOCUMENTS)


@query("sink_csv", f"WITH {PIECES} SELECT doc_id, pos, sentence FROM pieces")
def sink_csv(spark, sf):
    rows = pieces(spark, sf).select("doc_id", "pos", "sentence")
    return read_csv(spark, write_csv(rows, scratch_path(spark, "sink")),
                    "doc_id bigint, pos int, sentence string")


@query("sink_json_run", f"""WITH {SCORED}
  SELECT doc_id, title, description, relevance_score, '20240131_120500' AS run_ts, 'filtered' AS kind
  FROM scored WHERE relevance_score >= 3
  UNION ALL SELECT doc_id, title, description, NULL, '20240131_120500', 'raw' FROM scored""")
def sink_json_run(spark, sf):
    raw = articles(spark, sf).select("doc_id", "title", "description")
    run = F.lit(datetime.datetime(2024, 1, 31, 12, 5)).cast("timestamp_ntz")
    paths = write_json_run(score_articles(raw, RELEVANCE), scratch_path(spark, "run"), run, raw,
                           save_all=True)
    schema = "doc_id bigint, title string, description string, relevance_score int, run_ts string"
    kinds = [read_jsonl(spark, p, schema).withColumn("kind", F.lit(kind))
             for p, kind in zip(paths, ("filtered", "raw"))]
    return kinds[0].unionByName(kinds[1])


@query("scan_metrics", f"""WITH {PREDICTIONS}
  SELECT model, dataset, {METRICS}, tp, tn, fp, fn
  FROM (SELECT model, dataset, {counts_sql()} FROM predictions GROUP BY model, dataset)""")
def scan_metrics(spark, sf):
    metrics = confusion_metrics(predictions(spark, sf), by=["model", "dataset"])
    path = write_metrics(metrics, scratch_path(spark, "metrics"))
    return rounded(read_metrics(spark, path, whole_files=False), *METRIC_NAMES)


@query("require_columns", "SELECT doc_id, text AS sentence, lang FROM documents")
def require_columns_(spark, sf):
    docs = table(spark, sf, "documents").withColumnRenamed("text", "sentence")
    return require_columns(docs, ["doc_id", "sentence"]).select("doc_id", "sentence", "lang")


@query("model_save_load", """SELECT doc_id, 1 AS same FROM documents JOIN labels USING (doc_id)""")
def model_save_load(spark, sf):
    rows = gold(spark, sf)
    model = fit_pipeline(rows, logistic_regression, 1.0, "balanced", "sentence", "gold_label")
    path = save_model(model, scratch_path(spark, "model"))
    loaded = load_models({"lr": path, "absent": f"{path}-absent"})
    assert list(loaded) == ["lr"]
    before = score(model, rows).select("doc_id", "prediction", "probability")
    after = score(loaded["lr"], rows).select("doc_id", F.col("prediction").alias("p"),
                                             F.col("probability").alias("q"))
    same = (F.col("prediction") == F.col("p")) & (F.col("probability") == F.col("q"))
    return before.join(after, "doc_id").select("doc_id", same.cast("int").alias("same"))


HASH_TEST = ("CAST('0x' || substr(md5('42:' || doc_id || '_' || pos), 1, 8) AS BIGINT) "
             "/ 4294967296.0::DOUBLE < 0.2")


@query("split_sink", f"""WITH {VALID}
  SELECT doc_id, pos, label, sentence, CASE WHEN {HASH_TEST} THEN 'test' ELSE 'train' END AS split,
    CASE WHEN {HASH_TEST} THEN 1 ELSE 0 END AS alone FROM valid""")
def split_sink(spark, sf):
    rows = valid(spark, sf).withColumn("key", F.concat_ws("_", F.col("doc_id").cast("string"),
                                                          F.col("pos").cast("string")))
    path = write_splits(hash_split(rows, "key"), scratch_path(spark, "splits"))
    parts = spark.read.parquet(path)
    # Every split, and whether reading it alone gives it.
    alone = [only(parts, "split", name).withColumn("alone", F.lit(int(name == "test"))) for name in ("train", "test")]
    return alone[0].union(alone[1]).select("doc_id", "pos", "label", "sentence", "split", "alone")


@query("entry", f"""WITH {VALID}
  SELECT lang, source, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives,
         round(avg(label), 6) AS rate FROM valid GROUP BY lang, source""")
def labelled_sentences_by_source(spark, sf):
    rates = hedge_rate(valid(spark, sf), ["lang", "source"])
    return rounded(rates, "rate").select("lang", "source", "n", "positives", "rate")

"""Annotation samples and training sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.functions.labels import label_substring, label_word_boundary
from cuemill.lexicons import KEYWORD_CUES, SUBSTRING_CUES, TRAINING_JUNK
from cuemill.operators.classify import score
from cuemill.operators.dedup import dedup_by, union_all
from cuemill.operators.filters import errors, min_length, valid_sentence
from cuemill.operators.metrics import summary
from cuemill.operators.sampling import gold_rows, sample_per_class, shuffle, three_way_split
from cuemill.operators.schema import annotation_rows
from cuemill.operators.sentences import sentences
from cuemill.session import scratch_path, stored


def build_annotation_set(
    df: DataFrame, cues: Sequence[str] = SUBSTRING_CUES, n: int = 50, seed: int = 42,
    doc: str = "doc_id", pos: str = "pos",
) -> DataFrame:
    """``n`` sentences with and ``n`` without a cue, in random order, ready to annotate."""
    rows = min_length(df, "sentence").withColumn("rule_pred", label_substring("sentence", cues))
    keyed = rows.withColumn("_key", F.concat_ws("_", F.col(doc).cast("string"),
                                                F.col(pos).cast("string")))
    sampled = sample_per_class(keyed, "rule_pred", n, seed, "_key")
    return shuffle(annotation_rows(sampled, cues, doc, pos), "id", seed)


def label_training_sentences(
    articles: DataFrame, cues: Sequence[str] = KEYWORD_CUES, junk: Sequence[str] = TRAINING_JUNK,
    text: str = "text", key: str = "doc_id", lo: int = 5, hi: int = 100,
) -> DataFrame:
    """Valid sentences of the articles with their keyword label. One narrow pass."""
    pieces = sentences(articles, text, min_word_count=lo, keep=[key])
    return valid_sentence(pieces, "sentence", lo, hi, junk).withColumn(
        "label", label_word_boundary("sentence", cues))


def prepare_training_set(
    articles: DataFrame, gold: DataFrame, cues: Sequence[str] = KEYWORD_CUES,
    junk: Sequence[str] = TRAINING_JUNK, seed: int = 42, text: str = "text", key: str = "doc_id",
    dedup: bool = False, scratch: str | None = None,
) -> DataFrame:
    """``sentence, label, source, split``: training rows, and val and test with their gold rows.

    ``gold`` holds ``sentence, gold_label, split`` with splits ``dev`` and ``test``. Repeated
    sentences may fall into several splits unless ``dedup`` is set.

    The labelled sentences are cut once and written to ``scratch``, a path in a shared folder (by
    default a new one below ``spark.checkpoint.dir``), which the split then reads.
    """
    rows = label_training_sentences(articles, cues, junk, text, key)
    if dedup:
        rows = dedup_by(rows, ["sentence"], [key, "pos"])
    rows = rows.withColumn("_key", F.concat_ws("_", F.col(key).cast("string"),
                                               F.col("pos").cast("string")))
    scratch = scratch or scratch_path(articles.sparkSession, "sentences")
    rows.select("_key", "label", "sentence").write.parquet(scratch)
    rows = articles.sparkSession.read.parquet(scratch)
    split = three_way_split(rows, "label", seed, "_key").select("sentence", "label", "split")
    # One scan gives all splits; training rows carry no source.
    own = split.withColumn("source", F.when(F.col("split") != "train", F.lit("external")))
    golden = gold.withColumn("split", F.when(F.col("split") == "dev", "val")
                             .otherwise(F.col("split")))
    return own.unionByName(gold_rows(golden.filter(F.col("split").isin("val", "test"))))


def keyword_baseline_eval(
    df: DataFrame, cues: Sequence[str] = SUBSTRING_CUES, text: str = "sentence",
    y: str = "gold_label", dataset: str = "dataset",
) -> DataFrame:
    """Metrics of the substring baseline on each dataset."""
    predicted = df.select(F.lit("baseline").alias("model"), F.col(dataset).alias("dataset"),
                          F.col(y).alias(y), label_substring(text, cues).alias("prediction"))
    return summary(predicted, y).drop("auc")


def model_predictions(scored: dict[str, DataFrame], id: str = "id", y: str = "gold_label") -> DataFrame:
    """The long prediction table of several scored frames, one per model name."""
    parts = []
    for name, df in scored.items():
        probability = F.col("probability") if "probability" in df.columns else F.lit(None)
        parts.append(df.select(id, F.lit(name).alias("model"), "dataset", y, "prediction",
                               probability.cast("double").alias("probability")))
    return union_all(*parts)


def error_analysis(
    predictions: DataFrame, y: str = "gold_label", p: str = "prediction"
) -> DataFrame:
    """Misclassified rows of every model and dataset, told apart by ``error_type``."""
    return errors(predictions, y, p)


def evaluate_models(
    models: dict[str, PipelineModel], rows: DataFrame, id: str = "id", y: str = "gold_label"
) -> tuple[DataFrame, DataFrame]:
    """The evaluation job: summary and error tables of fitted models over ``id, text, gold_label,
    dataset`` rows. Every model scores the rows once; the AUC is null without probabilities."""
    scored = {name: score(model, rows) for name, model in models.items()}
    found = stored(model_predictions(scored, id, y), "predictions")
    return summary(found, y, probability="probability"), error_analysis(found, y)


def write_error_tables(rows: DataFrame, path: str) -> str:
    """One folder per model, dataset and error type."""
    (rows.write.mode("overwrite").partitionBy("model", "dataset", "error_type")
     .option("header", True).option("escape", '"').csv(path))
    return path

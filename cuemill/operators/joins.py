"""Joins: deny-lists, annotators, predictions, folds. All are equi-joins on unique keys.

No side is forced to broadcast: Spark broadcasts a side it knows to be small and otherwise sorts
and merges, splitting skewed partitions at run time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.operators.dedup import dedup_by, union_all


def drop_denied(df: DataFrame, deny: DataFrame, on: str = "sentence") -> DataFrame:
    """Rows whose exact text is not denied. Rows without text stay."""
    return df.join(deny.select(on).distinct(), on, "left_anti").select(*df.columns)


def denied_sentences(annotations: DataFrame, ignore_case: bool = False) -> DataFrame:
    """Sentences marked ``delete``; other spellings count only with ``ignore_case``."""
    label = F.lower("gold_label") if ignore_case else F.col("gold_label")
    return annotations.filter(label == "delete").select("sentence")


def backfill_missing(
    df: DataFrame, annotated: DataFrame, on: str = "sentence", order: Sequence[str] = ("url",)
) -> DataFrame:
    """One row per text: the first of ``df``, or of the annotated rows where ``df`` lacks the text.

    Both sides meet in one aggregate, reduced to one row per text and task before the shuffle, so a
    repeated text is no hot key.
    """
    extra = annotated.select(*[c for c in df.columns if c in annotated.columns])
    both = union_all(df.withColumn("_side", F.lit(0)), extra.withColumn("_side", F.lit(1)))
    return dedup_by(both, [on], ["_side", *order]).select(*df.columns)


def pair_annotators(a: DataFrame, b: DataFrame, on: str = "id", label: str = "gold_label") -> DataFrame:
    """Both annotators' labels of each row that both labelled."""
    return a.select(on, F.col(label).alias("label_a")).join(
        b.select(on, F.col(label).alias("label_b")), on)


def apply_annotations(queue: DataFrame, labels: DataFrame, on: str = "id") -> DataFrame:
    """The queue with the labels given so far; open rows keep their mark."""
    given = labels.select(on, F.col("label").cast("string").alias("_given"))
    return (queue.join(given, on, "left")
            .withColumn("gold_label", F.coalesce("_given", "gold_label")).select(*queue.columns))


def attach_predictions(df: DataFrame, predictions: DataFrame, on: str = "id") -> DataFrame:
    """Rows with the prediction, and the probability where there is one, of the same key."""
    extra = [c for c in predictions.columns if c != on and c not in df.columns]
    return df.join(predictions.select(on, *extra), on).select(*df.columns, *extra)


def fold_rows(df: DataFrame, fold: int, part: str = "val") -> DataFrame:
    """Training or validation rows of one fold, by the ``fold`` column."""
    inside = F.col("fold") == fold
    return df.filter(inside if part == "val" else ~inside)


def fold_rows_by_index(
    df: DataFrame, index: DataFrame, fold: int, part: str = "val", key: str = "doc_id"
) -> DataFrame:
    """The same by a fold index table, whose lists come in chunks."""
    wanted = index.filter((F.col("fold") == fold) & (F.col("part") == part))
    keys = wanted.select(F.explode("indices").alias(key))
    return df.join(keys, key, "left_semi").select(*df.columns)

"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions.labels import contains_any, is_junk
from cuemill.functions.text import (
    article_text,
    col,
    normal_word_count,
    normalize_space,
    strip,
    with_computed,
)
from cuemill.lexicons import TOPIC_KEYWORDS, TRAINING_JUNK


def min_length(df: DataFrame, column: str, n: int = 10, stripped: bool = True) -> DataFrame:
    """Non-null values longer than ``n`` characters, stripped first by default."""
    if stripped:
        df = with_computed(df, column, strip(column))
    return df.filter(F.length(column) > n)


def valid_sentence(
    df: DataFrame, column: str = "sentence", lo: int = 5, hi: int = 100,
    junk: Sequence[str] = TRAINING_JUNK,
) -> DataFrame:
    """Normalised sentences of ``lo`` to ``hi`` words without junk."""
    out = with_computed(df, column, normalize_space(column))
    out = out.filter(normal_word_count(column).between(lo, hi))
    return out.filter(~is_junk(column, junk)) if junk else out


def drop_rejected(df: DataFrame, label: str = "gold_label") -> DataFrame:
    """Rows with a label that is an integer. ``delete`` in any case, open marks, other text and nulls
    are no gold labels; ``unparsable_labels`` lists what is neither a number nor ``delete``."""
    return df.withColumn(label, F.col(label).try_cast("int")).filter(F.col(label).isNotNull())


def unparsable_labels(df: DataFrame, label: str = "gold_label") -> DataFrame:
    """Rows whose label is neither an integer nor ``delete``."""
    rejected = F.coalesce(F.lower(label) == "delete", F.lit(False))
    return df.filter(F.col(label).try_cast("int").isNull() & ~rejected)


def lookback(ts: Column | str, to: Column, days_back: int = 7) -> Column:
    """True within the ``days_back`` days that end at ``to``, both ends included."""
    return col(ts).between(to - F.make_dt_interval(days=F.lit(days_back)), to)


def language_is(column: Column | str, lang: str = "en") -> Column:
    return col(column) == lang


def is_topical(
    title: Column | str, description: Column | str, keywords: Sequence[str] = TOPIC_KEYWORDS
) -> Column:
    """True if any keyword is a substring of title and description."""
    return contains_any(article_text(title, description), keywords)


def only(df: DataFrame, column: str, value) -> DataFrame:
    """Rows of one partition value; prunes folders when the table is partitioned by it."""
    return df.filter(F.col(column) == value)


def errors(df: DataFrame, y: str = "gold_label", p: str = "prediction") -> DataFrame:
    """False positives and false negatives, told apart by ``error_type``."""
    kind = (F.when((F.col(p) == 1) & (F.col(y) == 0), "false_positive")
            .when((F.col(p) == 0) & (F.col(y) == 1), "false_negative"))
    return df.withColumn("error_type", kind).filter("error_type is not null")

"""Orders and first rows. A limited order keeps the first rows per task and merges only those."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.functions.labels import relevance_score
from cuemill.functions.text import with_computed
from cuemill.lexicons import RelevanceLexicon


def score_articles(
    df: DataFrame, lexicon: RelevanceLexicon = RelevanceLexicon(), title: str = "title",
    description: str = "description", min_score: int | None = 3,
) -> DataFrame:
    """Adds ``relevance_score`` and keeps scores from ``min_score`` on. Narrow: streams too."""
    score = relevance_score(title, description, lexicon)
    scored = with_computed(df, "relevance_score", score)
    return scored if min_score is None else scored.filter(F.col("relevance_score") >= min_score)


def rank_articles(
    df: DataFrame, min_score: int = 3, score: str = "relevance_score", order: Sequence[str] = ("id",)
) -> DataFrame:
    """Articles from ``min_score`` on, highest score first, ties in feed order."""
    return df.filter(F.col(score) >= min_score).orderBy(F.desc(score), *order)


def top_k(
    df: DataFrame, k: int = 3, score: str = "relevance_score", order: Sequence[str] = ("id",)
) -> DataFrame:
    return df.orderBy(F.desc(score), *order).limit(k)


def limit_in_order(df: DataFrame, n: int = 200, order: Sequence[str] = ("doc_id", "pos")) -> DataFrame:
    return df.orderBy(*order).limit(n)


def head(df: DataFrame, n: int = 2, order: Sequence[str] = ("id",)) -> DataFrame:
    return df.orderBy(*order).limit(n)


def latest(df: DataFrame, ts: str, n: int = 100, order: Sequence[str] = ("id",)) -> DataFrame:
    """The newest ``n`` rows."""
    return df.orderBy(F.desc(ts), *order).limit(n)

"""From articles to a clean sentence corpus."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.labels import is_junk, label_token_set, matches_any_regex
from cuemill.functions.text import normalize_space, strip, truncate_at
from cuemill.lexicons import (
    CANDIDATE_PATTERNS,
    CORPUS_JUNK,
    KEYWORD_CUES,
    MERGE_JUNK,
    TEXT_COLUMNS,
    TRUNCATE_PATTERNS,
)
from cuemill.operators.counting import StepCounts
from cuemill.operators.dedup import dedup_by, dedup_rows, union_all
from cuemill.operators.filters import drop_rejected, min_length
from cuemill.operators.joins import denied_sentences
from cuemill.operators.ranking import limit_in_order
from cuemill.operators.schema import (
    canonicalize,
    label_alias,
    resolve_text_column,
    select_existing,
)
from cuemill.operators.sentences import sentences
from cuemill.sources.tables import read_mixed


def articles_to_sentences(
    df: DataFrame, text: str = "text", patterns: Sequence[str] = TRUNCATE_PATTERNS,
    min_words: int = 5, keep: Sequence[str] = ("doc_id", "url"),
) -> DataFrame:
    """Article text without boilerplate, as sentences. One narrow pass.

    White space is normalised after the cut, so a cut reaches to the end of its line only.
    """
    cleaned = df.select(*keep, normalize_space(truncate_at(text, patterns)).alias(text))
    return sentences(cleaned, text, min_words, keep).filter(F.length("sentence") > 0)


def clean_annotations(annotations: DataFrame, order: Sequence[str] = ("id",)) -> DataFrame:
    """Gold rows: without rule labels, rejected rows and repeated sentences."""
    return dedup_by(drop_rejected(annotations.drop("rule_pred")), ["sentence"], order)


def clean_corpus(
    corpus: DataFrame, annotations: DataFrame, junk: Sequence[str] = CORPUS_JUNK,
    order: Sequence[str] = ("doc_id", "pos"), ignore_case: bool = False,
) -> DataFrame:
    """``url, sentence`` rows: distinct, not denied, not junk, and every gold sentence kept.

    Corpus, deny-list and gold rows meet in one aggregate by sentence, so the corpus is cut,
    filtered and shuffled once, and a repeated sentence is one row per task before the shuffle.
    """
    own = corpus.filter(~is_junk("sentence", junk)).select(
        "sentence", "url", F.struct(*order).alias("_order"))
    denied = denied_sentences(annotations, ignore_case).select("sentence", F.lit(True).alias("_denied"))
    gold = clean_annotations(annotations).select("sentence", F.col("url").alias("_gold"), F.lit(True).alias("_is_gold"))
    found = union_all(own, denied, gold).groupBy("sentence").agg(
        F.min_by(F.struct("url"), "_order").alias("_own"), F.bool_or("_denied").alias("_denied"),
        F.min(F.when(F.col("_is_gold"), F.struct("_gold"))).alias("_gold"))
    kept = F.col("_own").isNotNull() & F.col("_denied").isNull()
    return found.filter(kept | F.col("_gold").isNotNull()).select(
        F.when(kept, F.col("_own.url")).otherwise(F.col("_gold._gold")).alias("url"), "sentence")


def split_external(
    external: DataFrame, junk: Sequence[str] = MERGE_JUNK, min_words: int = 5,
    keep: Sequence[str] = ("doc_id", "url"), text: str = "sentence",
) -> DataFrame:
    """External texts as sentences of at least ``min_words`` words and 5 characters, without junk."""
    pieces = sentences(external.withColumn(text, strip(text)), text, min_words, keep)
    return pieces.filter((F.length("sentence") >= 5) & ~is_junk("sentence", junk))


def merge_corpora(
    base: DataFrame, external_sentences: DataFrame, order: Sequence[str] = ("doc_id", "pos"),
    counts: StepCounts | None = None,
) -> DataFrame:
    """Base sentences, then external ones, one row per text; base rows win.

    With ``counts`` the steps ``base``, ``external`` and ``merged`` are counted in the job that
    ``counts.write`` runs.
    """
    if counts:
        base, external_sentences = counts.watch("base", base), counts.watch("external", external_sentences)
    both = union_all(base.withColumn("_side", F.lit(0)), external_sentences.withColumn("_side", F.lit(1)))
    merged = dedup_by(both, ["sentence"], ["_side", *order]).drop("_side")
    return counts.watch("merged", merged) if counts else merged


def label_external_news(
    df: DataFrame, cues: Sequence[str] = KEYWORD_CUES, candidates: Sequence[str] = TEXT_COLUMNS,
    min_len: int = 10, distinct: bool = True, counts: StepCounts | None = None,
) -> DataFrame:
    """A raw news table as ``sentence, label, hedge`` and the optional columns it has.

    With ``counts`` the steps ``raw``, ``distinct`` and ``kept`` are counted in the job that
    ``counts.write`` runs.
    """
    def step(name: str, rows: DataFrame) -> DataFrame:
        return counts.watch(name, rows) if counts else rows

    rows = step("distinct", dedup_rows(step("raw", df))) if distinct else step("raw", df)
    named = canonicalize(rows, text_column=resolve_text_column(df, candidates))
    hedged = label_alias(named.withColumn("hedge", label_token_set("sentence", cues)))
    kept = select_existing(hedged, ["sentence", "label", "hedge"],
                           ["date", "stock_symbol", "publisher", "url"])
    return step("kept", min_length(kept, "sentence", min_len, stripped=False))


def load_external_news(
    spark: SparkSession, folders: Sequence[str], cues: Sequence[str] = KEYWORD_CUES, **options
) -> DataFrame:
    """The first folder with files, read, deduplicated and labelled."""
    return label_external_news(read_mixed(spark, folders), cues, **options)


def cue_candidates(
    df: DataFrame, patterns: Sequence[str] = CANDIDATE_PATTERNS, n: int = 200,
    order: Sequence[str] = ("doc_id", "pos"),
) -> DataFrame:
    """The first ``n`` sentences, in corpus order, that match a cue pattern."""
    matched = df.filter(matches_any_regex("sentence", patterns))
    return limit_in_order(matched, n, order).select("url", "sentence")

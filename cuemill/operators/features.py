"""TF-IDF over word n-grams.

Fitting is one map-side-combined aggregation by term; scoring is narrow. Only the vocabulary, whose
size is a parameter, reaches the driver and is sent to the tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    CountVectorizerModel,
    ElementwiseProduct,
    NGram,
    Normalizer,
    RegexTokenizer,
    SQLTransformer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from cuemill.functions.text import ngrams, with_computed
from cuemill.session import stored


#: The longest list of words that the texts are searched for.
MOST_WORDS = 20_000


def term_stats(
    df: DataFrame, text: str = "text", lo: int = 1, hi: int = 2, by: Sequence[str] = (), among: Sequence[str] | None = None,
) -> DataFrame:
    """``(term, tf, df)``: corpus and document frequency, one row of ``df`` being one document; per
    group of ``by``; with ``among``, of the n-grams that consist of these words.

    The n-grams of a row are sorted, so the first of equal ones marks the document. Both counts
    then come from one aggregation, and a term found in every row is summed inside each task.
    """
    found = ngrams(text, lo, hi) if among is None else F.filter(ngrams(text, lo, hi, among), lambda g: g.isNotNull())
    grams = with_computed(df, "_g", F.sort_array(found)).select(*by, F.col("_g").alias("g"))
    shifted = F.concat(F.array(F.lit(None).cast("string")), F.col("g"))
    rows = grams.select(*by, F.inline(F.arrays_zip(F.col("g").alias("term"), shifted.alias("last"))))
    first = (~F.col("term").eqNullSafe(F.col("last"))).cast("long")
    return (rows.filter("term is not null").groupBy(*by, "term")
            .agg(F.count("*").alias("tf"), F.sum(first).alias("df")))


def _least(stats: DataFrame, n_docs: int, min_df: int, max_df: float, size: int) -> int:
    """The frequency that a term needs to be among the ``size`` most frequent, by the terms of ``stats`` alone."""
    n, least = top_vocabulary(stats, n_docs, min_df, max_df, size).agg(F.count("*"), F.min("tf")).first()
    return least if n == size else 0


def _collected(words: DataFrame) -> list[str] | None:
    """The words, unless they are too many for a list."""
    found = [r["term"] for r in words.select("term").limit(MOST_WORDS + 1).collect()]
    return found if len(found) <= MOST_WORDS else None


def top_vocabulary(
    stats: DataFrame, n_docs: int | Column, min_df: int = 2, max_df: float = 0.95, size: int = 500
) -> DataFrame:
    """The ``size`` most frequent terms within the document-frequency limits; ties by term."""
    n_docs = n_docs if isinstance(n_docs, Column) else F.lit(n_docs)
    usual = (F.col("df") >= min_df) & (F.col("df") <= F.lit(max_df) * n_docs)
    return stats.filter(usual).orderBy(F.desc("tf"), "term").limit(size)


def tfidf_fit(
    df: DataFrame, text: str = "text", min_df: int = 2, max_df: float = 0.95, size: int = 500,
    lo: int = 1, hi: int = 2,
) -> DataFrame:
    """``(term, idx, tf, df, idf)`` of the vocabulary; idf is ``ln((1 + n) / (1 + df)) + 1``.

    An n-gram is no more frequent than any of its words, in the corpus and by documents. So words are counted first, and
    then only the n-grams of words that are as frequent as the last word that would be taken: the same
    vocabulary, without the many rare n-grams.
    """
    n_docs = df.agg(F.count("*")).scalar()
    among = None
    if lo == 1 < hi and size > 0:
        words = stored(term_stats(df, text, 1, 1), "words")
        least = _least(words, df.count(), min_df, max_df, size)
        among = _collected(words.filter((F.col("tf") >= least) & (F.col("df") >= min_df)))
    if among is None:
        stats = term_stats(df, text, lo, hi)
    else:
        stats = words.union(term_stats(df, text, 2, hi, among=among))
    vocabulary = top_vocabulary(stats, n_docs, min_df, max_df, size)
    idf = F.log((1 + n_docs).cast("double") / (1 + F.col("df"))) + 1
    # At most ``size`` rows are left to number.
    idx = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("term")) - 1
    return vocabulary.select("term", idx.alias("idx"), "tf", "df", idf.alias("idf"))


def fold_vocabularies(
    df: DataFrame, fold: str, k: int, text: str = "text", min_df: int = 2, max_df: float = 0.95,
    size: int = 500, lo: int = 1, hi: int = 2,
) -> list[list[Row]]:
    """For each fold the vocabulary of the other folds' rows.

    One pass counts terms by fold; what the training rows of a fold hold is the total without it.
    The counts are written once, and each fold takes its top terms from them. As in :func:`tfidf_fit`, words are
    counted first, and then the n-grams of words that are frequent enough for some fold.
    """
    folds = F.map_from_entries(F.collect_list(F.struct(fold, F.struct("tf", "df"))))

    def by_term(counts: DataFrame, name: str) -> DataFrame:
        return stored(counts.groupBy("term").agg(F.sum("tf").alias("tf"), F.sum("df").alias("df"), folds.alias("own")), name)

    def without(i: int) -> list[Column]:
        own = F.col("own")[F.lit(i)]
        return [(F.col(c) - F.coalesce(own[c], F.lit(0))).alias(c) for c in ("tf", "df")]

    docs = {r[0]: r[1] for r in df.groupBy(fold).count().filter(F.col(fold).between(0, k - 1)).collect()}
    total = df.count()
    among = None
    if lo == 1 < hi and size > 0:
        words = by_term(term_stats(df, text, 1, 1, by=[fold]), "words")
        usual = F.lit(False)
        for i in range(k):
            tf, held = without(i)
            least = _least(words.select("term", tf, held), total - docs.get(i, 0), min_df, max_df, size)
            usual = usual | ((tf >= least) & (held >= min_df))
        among = _collected(words.filter(usual))
    if among is None:
        terms = by_term(term_stats(df, text, lo, hi, by=[fold]), "terms")
    else:
        terms = words.union(by_term(term_stats(df, text, 2, hi, by=[fold], among=among), "terms"))
    out = []
    for i in range(k):
        rest = terms.select("term", *without(i))
        n = total - docs.get(i, 0)
        top = top_vocabulary(rest, n, min_df, max_df, size)
        idf = F.log(F.lit(float(1 + n)) / (1 + F.col("df"))) + 1
        rows = sorted(top.select("term", idf.alias("idf")).collect(), key=lambda r: r["term"])
        out.append([Row(idx=j, term=r["term"], idf=r["idf"]) for j, r in enumerate(rows)])
    return out


def vocabulary_rows(vocabulary: DataFrame) -> list[Row]:
    """The fitted terms, in index order. Their number is the vocabulary size given at the fit."""
    rows = vocabulary.select("idx", "term", "idf").collect()
    if not rows:
        raise ValueError("no term is left in the vocabulary")
    return sorted(rows, key=lambda r: r["idx"])


def tfidf_model(
    vocabulary: DataFrame | list[Row], text: str = "text", features: str = "features", hi: int = 2
) -> PipelineModel:
    """The fitted vocabulary as a pipeline: words, n-grams, counts, idf weights, unit length.

    All stages are narrow JVM transformers, and the pipeline can be saved with its classifier.
    """
    rows = vocabulary if isinstance(vocabulary, list) else vocabulary_rows(vocabulary)
    stages = [
        SQLTransformer(statement=f"SELECT *, coalesce({text}, '') AS _text FROM __THIS__"),
        RegexTokenizer(inputCol="_text", outputCol="_n1", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False,
                       minTokenLength=2),
    ]
    stages += [NGram(n=n, inputCol="_n1", outputCol=f"_n{n}") for n in range(2, hi + 1)]
    grams = ", ".join(f"_n{n}" for n in range(1, hi + 1))
    helpers = ", ".join(["_text", *[f"_n{n}" for n in range(1, hi + 1)], "_grams", "_tf", "_tfidf"])
    stages += [
        SQLTransformer(statement=f"SELECT *, concat({grams}) AS _grams FROM __THIS__"),
        CountVectorizerModel.from_vocabulary([r["term"] for r in rows], "_grams", "_tf"),
        ElementwiseProduct(scalingVec=Vectors.dense([r["idf"] for r in rows]), inputCol="_tf",
                           outputCol="_tfidf"),
        Normalizer(p=2.0, inputCol="_tfidf", outputCol=features),
        SQLTransformer(statement=f"SELECT * EXCEPT ({helpers}) FROM __THIS__"),
    ]
    return PipelineModel(stages)


def tfidf_transform(
    df: DataFrame, vocabulary: DataFrame, key: str = "doc_id", text: str = "text", hi: int = 2
) -> DataFrame:
    """Long ``(key, term, weight)`` rows, unit length per document; unknown terms are dropped.

    The weights of a row are computed inside the row, so nothing is shuffled.
    """
    rows = vocabulary_rows(vocabulary)
    scored = tfidf_model(rows, text, "features", hi).transform(df.select(key, text))
    names = F.array(*[F.lit(r["term"]) for r in rows])
    cells = F.arrays_zip(names.alias("term"), vector_to_array("features").alias("weight"))
    # Only the row's own terms leave the row.
    return scored.select(key, F.inline(F.filter(cells, lambda c: c["weight"] > 0)))

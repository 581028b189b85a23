"""Column selection and naming."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType, StringType

from cuemill.functions.labels import label_substring
from cuemill.lexicons import COLUMN_VARIANTS, SUBSTRING_CUES, TEXT_COLUMNS


def resolve_text_column(
    df: DataFrame, candidates: Sequence[str] = TEXT_COLUMNS, min_len: int = 20,
    order: Sequence[Column | str] = (),
) -> str:
    """The first candidate name present; else the first text column with a long first value.

    Only the second case reads data: one aggregate over all text columns. ``order`` says which row
    is the first; without it the row with the smallest values in its sortable columns.
    """
    for name in candidates:
        if name in df.columns:
            return name
    texts = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if texts:
        order = order or [F.col(f"`{f.name}`") for f in df.schema.fields if isinstance(f.dataType, AtomicType)]

        def first(name: str) -> Column:
            rank = F.when(F.col(name).isNotNull(), F.struct(*order))
            return F.min_by(name, rank)

        row = df.agg(*[F.length(first(name)).alias(name) for name in texts]).first()
        for name in texts:
            if (row[name] or 0) > min_len:
                return name
    raise ValueError(f"no text column among {df.columns}")


def canonicalize(
    df: DataFrame, mapping: Mapping[str, Sequence[str]] = COLUMN_VARIANTS,
    text_column: str | None = None,
) -> DataFrame:
    """Rename the first variant present of each column; later variants keep their names.

    A later variant that already bears the canonical name would be ambiguous: it is kept with
    ``_other`` behind its name.
    """
    renames = {text_column: "sentence"} if text_column else {}
    for canonical, variants in mapping.items():
        for variant in variants:
            if variant in df.columns and variant not in renames:
                renames[variant] = canonical
                break
    # Columns are named by position, as names that differ in case only are one name to Spark.
    taken = {c.lower() for c in renames.values()}
    names: list[str] = []
    for c in df.columns:
        name = renames.get(c) or c
        if c not in renames and c.lower() in taken:
            name = f"{c}_other"
            while name.lower() in taken:
                name += "_other"
            taken.add(name.lower())
        names.append(name)
    return df.toDF(*names)


def select_existing(
    df: DataFrame, required: Sequence[str], optional: Sequence[str] = (), drop: Sequence[str] = ()
) -> DataFrame:
    """Required columns, then the optional ones present, without those in ``drop``."""
    kept = [*required, *[c for c in optional if c in df.columns]]
    return df.select([c for c in kept if c not in drop])


def annotation_rows(
    df: DataFrame, cues: Sequence[str] = SUBSTRING_CUES, doc: str = "doc_id", pos: str = "pos"
) -> DataFrame:
    """Rows for the annotators: a stable id, the rule's label and ``?`` for the gold label."""
    return df.select(
        F.concat(F.lit("S"), F.col(doc).cast("string"), F.lit("_"), F.col(pos).cast("string"))
        .alias("id"),
        "sentence", "url", label_substring("sentence", cues).alias("rule_pred"),
        F.lit("?").alias("gold_label"))


def tag_source(df: DataFrame, value: str) -> DataFrame:
    return df.withColumn("source", F.lit(value))


def label_alias(df: DataFrame, src: str = "hedge", dst: str = "label") -> DataFrame:
    return df.withColumn(dst, F.col(src))

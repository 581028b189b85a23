"""Annotator agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The category names.
AGREED, MISSED, FALSE_ALARM = "Agreed", "Missed Hedge (A2 found)", "False Alarm (A2 found)"


def cohen_kappa(df: DataFrame, a: str = "label_a", b: str = "label_b") -> DataFrame:
    """Observed agreement, chance agreement and kappa over any number of classes.

    The pairs are counted once, map-side; the rest runs over the counted label pairs. Kappa is null
    when chance agreement is 1.
    """
    pairs = (df.filter(F.col(a).isNotNull() & F.col(b).isNotNull())
             .groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n")))
    none = F.lit(0).cast("long").alias
    sides = pairs.select(F.inline(F.array(
        F.struct(F.col("a").alias("label"), F.col("n").alias("na"), none("nb")),
        F.struct(F.col("b").alias("label"), none("na"), F.col("n").alias("nb")))))
    margins = sides.groupBy("label").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb"))
    n = pairs.agg(F.sum("n")).scalar().cast("double")
    out = pairs.agg((F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)) / n)
                    .alias("po"))
    chance = margins.agg(F.sum(F.col("na").cast("double") * F.col("nb"))).scalar() / (n * n)
    return out.select("po", chance.alias("pe")).withColumn(
        "kappa", F.try_divide(F.col("po") - F.col("pe"), 1 - F.col("pe")))


def agreement(df: DataFrame, a: str = "annotator_1", b: str = "annotator_2") -> DataFrame:
    """Agreed, missed and false-alarm rows with counts and percents, largest first."""
    category = (F.when(F.col(a) == F.col(b), AGREED).when(F.col(b) == 1, MISSED)
                .otherwise(FALSE_ALARM))
    counts = df.groupBy(category.alias("category")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select("category", "n", (F.col("n") * 100 / total).alias("pct")).orderBy(
        F.desc("n"), "category")

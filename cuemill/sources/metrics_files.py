"""Metric files: one JSON object per model, flat or nested by split."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, StringType, StructField, StructType

from cuemill.sources.schemas import METRICS

def _quoted(c: str) -> Column:
    """A JSON string."""
    text = F.to_json(F.array(c))
    return F.substring(text, F.lit(2), F.length(text) - 2)


def write_metrics(metrics: DataFrame, path: str) -> str:
    """``(model, dataset, …)`` rows as one nested JSON object per model, any datasets.

    A model's repeated dataset is an error, since an object holds a key once.
    """
    fields = [c for c in METRICS.names if c in metrics.columns]
    entry = F.concat(_quoted("dataset"), F.lit(":"), F.to_json(F.struct(*fields)))
    models = metrics.groupBy("model").agg(
        F.array_sort(F.collect_list("dataset")).alias("names"), F.array_sort(F.collect_list(entry)).alias("entries"))
    once = F.size("names") == F.size(F.array_distinct("names"))
    value = F.when(once, F.concat(F.lit('{"model":'), _quoted("model"), F.lit(","), F.array_join("entries", ","), F.lit("}")))
    problem = F.raise_error(F.concat(F.lit("a dataset comes twice for model "), "model"))
    models.select(F.coalesce(value, problem).alias("value")).write.mode("overwrite").text(path)
    return path


def read_metrics(
    spark: SparkSession, paths: Mapping[str, str] | str, whole_files: bool = True
) -> DataFrame:
    """Long ``(model, dataset, accuracy, …)`` rows from metric files.

    ``paths`` is a file pattern whose objects name their model, or a mapping from model name to
    file. Each file is one object, or with ``whole_files=False`` each line. A missing file means an absent model. Numbers may lie at the top (read as ``test``),
    under a split, or under a model and then a split.
    """
    if isinstance(paths, Mapping):
        parts = [part for name, path in paths.items()
                 if (part := _read_one(spark, path, name, whole_files)) is not None]
    else:
        parts = [part for part in [_read_one(spark, paths, None, whole_files)] if part is not None]
    if not parts:
        schema = StructType([StructField("model", StringType()), StructField("dataset", StringType()),
                             *METRICS.fields])
        return spark.createDataFrame([], schema)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _read_one(spark: SparkSession, path: str, name: str | None, whole: bool) -> DataFrame | None:
    try:
        text = spark.read.text(path, wholetext=whole)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return None
        raise
    # Each object as a map from its keys to their JSON text; a small file, a few keys. An object with
    # numbers is a dataset, an object of such objects a model.
    as_map = MapType(StringType(), StringType())
    keys = text.select(F.from_json("value", as_map).alias("top"))
    model = F.coalesce(F.col("top")["model"], F.lit(name))
    flat = keys.filter(F.map_contains_key("top", "accuracy")).select(
        model.alias("model"), F.lit("test").alias("dataset"), F.to_json("top").alias("body"))
    entries = (keys.filter(~F.map_contains_key("top", "accuracy"))
               .select(model.alias("model"), F.explode("top").alias("key", "body"))
               .filter(F.col("body").startswith("{"))
               .withColumn("inner", F.from_json("body", as_map)))
    by_split = entries.filter(F.map_contains_key("inner", "accuracy")).select(
        "model", F.col("key").alias("dataset"), "body")
    deeper = (entries.filter(~F.map_contains_key("inner", "accuracy"))
              .select(F.col("key").alias("model"), F.explode("inner").alias("dataset", "body"))
              .filter(F.col("body").startswith("{"))
              .filter(F.map_contains_key(F.from_json("body", as_map), "accuracy")))
    rows = flat.unionByName(by_split).unionByName(deeper)
    return (rows.withColumn("m", F.from_json("body", _TEXT_METRICS)).filter("m is not null")
            .select("model", "dataset",
                    *[F.col(f"m.{f.name}").cast(f.dataType).alias(f.name) for f in METRICS.fields]))


_TEXT_METRICS = StructType([StructField(n, StringType()) for n in METRICS.names])

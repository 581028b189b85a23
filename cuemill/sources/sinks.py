"""Writers. Each task writes its own files; nothing is gathered first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions.text import run_stamp


def write_csv(
    df: DataFrame, path: str, mode: str = "overwrite", encoding: str = "UTF-8",
    rows_per_file: int = 1_000_000,
) -> str:
    """Headered CSV with doubled quotes and no index column.

    ``rows_per_file`` bounds the files, since a multi-line CSV file is read by one task.
    """
    (df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"')
     .option("encoding", encoding).option("emptyValue", '""')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
     .option("maxRecordsPerFile", rows_per_file).csv(path))
    return path


def write_json_array(df: DataFrame, path: str, key: str, rows_per_file: int = 10_000) -> str:
    """Files that each hold one JSON array of about ``rows_per_file`` objects.

    Rows are spread by the hash of ``key``, so no array outgrows a task.
    """
    files = F.greatest(F.lit(1), F.ceil(df.agg(F.count("*")).scalar() / F.lit(rows_per_file)))
    placed = df.select(F.pmod(F.xxhash64(key), files).alias("_file"), F.struct("*").alias("_row"))
    arrays = placed.groupBy("_file").agg(F.to_json(F.collect_list("_row")).alias("value"))
    arrays.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return path


def write_json_run(
    scored: DataFrame, path: str, run_ts: Column, raw: DataFrame | None = None,
    save_all: bool = False,
) -> list[str]:
    """Scored articles, and with ``save_all`` the raw ones, each below its run's stamp."""
    targets = [("filtered", scored)] + ([("raw", raw)] if save_all and raw is not None else [])
    written = []
    for name, df in targets:
        out = f"{path}/{name}"
        (df.withColumn("run_ts", run_stamp(run_ts)).write.mode("append")
         .partitionBy("run_ts").json(out))
        written.append(out)
    return written


def write_splits(df: DataFrame, path: str, by: str = "split") -> str:
    """One folder per split, so that reading one split scans only its files."""
    df.write.mode("overwrite").partitionBy(by).parquet(path)
    return path

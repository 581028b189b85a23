"""Readers. Schemas are given; only ``read_mixed`` infers those it is not given."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cuemill.operators.dedup import union_all
from cuemill.sources.csv_records import csv_records
from cuemill.sources.json_records import json_objects

# Words that mean "missing" in a CSV cell besides the empty cell.
NULL_WORDS = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
              "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


def _csv_reader(spark: SparkSession, multiline: bool, encoding: str):
    # Quotes are doubled inside quoted cells; Spark's default escape is the backslash.
    return (spark.read.option("header", True).option("quote", '"').option("escape", '"')
            .option("multiLine", multiline).option("encoding", encoding)
            .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))


def csv_headers(
    spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", **options
) -> DataFrame:
    """``(file, names, valid)`` of each file that has a line: its header and whether it is UTF-8.

    The first line is the one with the smallest row number among those of the split at byte 0. Two
    narrow passes by line; hash aggregates of one number and one flag per file, nothing collected.
    """
    reader = spark.read.options(**options)
    lines = reader.text(path).select(
        F.col("_metadata.file_path").alias("file"), F.is_valid_utf8("value").alias("valid"),
        (F.col("_metadata.file_block_start") == 0).alias("head"),
        F.monotonically_increasing_id().alias("row"), "value")
    files = lines.groupBy("file").agg(F.bool_and("valid").alias("valid"),
                                      F.min(F.when(F.col("head"), F.col("row"))).alias("row"))
    first = lines.select("file", "row", "value").join(files, ["file", "row"])
    line = F.regexp_replace(F.decode(F.col("value").cast("binary"), encoding), "^\ufeff", "")
    # One line is a CSV row of so many cells as it has commas and one more, at most.
    width = first.agg(F.max(F.length("value") - F.length(F.replace("value", F.lit(","))))).first()[0]
    cells = F.from_csv(line, F.lit(_cells_schema((width or 0) + 1)), {"quote": '"', "escape": '"'})
    names = F.filter(F.array([cells[f"_c{i}"] for i in range((width or 0) + 1)]), lambda c: c.isNotNull())
    return first.select("file", "valid", names.alias("names"))


def _cells_schema(width: int) -> str:
    return ", ".join(f"_c{i} string" for i in range(width))


def _read_cells(
    spark: SparkSession, path: str | list[str], multiline: bool, encoding: str, **options
) -> DataFrame:
    """``(file, cells, names, valid)``: every data row as text cells beside its file's header.

    Files may differ in columns and their order. The headers, one row per file, are joined to the
    rows by file; Spark broadcasts them where they are few.
    """
    headers = csv_headers(spark, path, encoding, **options)
    width = headers.agg(F.max(F.size("names"))).first()[0]
    if not width:
        return spark.createDataFrame([], "file string, cells array<string>, names array<string>, valid boolean")
    if multiline and not encoding.upper().replace("-", "").startswith(("UTF16", "UTF32")):
        found = csv_records(spark, path, encoding, **options).where("NOT first")
        parsed = F.from_csv("record", F.lit(_cells_schema(width)), {"quote": '"', "escape": '"', "multiLine": "true"})
        return found.select("file", parsed.alias("c")).select(
            "file", F.array(*[F.col(f"c._c{i}") for i in range(width)]).alias("cells")).join(headers, "file")
    rows = (_csv_reader(spark, multiline, encoding).options(**options).schema(_cells_schema(width)).csv(path)
            .select(F.col("_metadata.file_path").alias("file"),
                    F.array([F.col(f"_c{i}") for i in range(width)]).alias("cells")))
    return rows.join(headers, "file")


def _by_name(rows: DataFrame, schema: StructType | str, null_words: Sequence[str] = ()) -> DataFrame:
    """The cells as columns of the schema, found by header; a column a file lacks is null."""
    fields = rows.sparkSession.createDataFrame([], schema).schema.fields if isinstance(schema, str) else schema.fields
    out = []
    for f in fields:
        cell = F.get("cells", (F.array_position("names", F.lit(f.name)) - 1).cast("int"))
        if null_words and isinstance(f.dataType, StringType):
            cell = F.when(~cell.isin(*null_words), cell)
        out.append((cell if isinstance(f.dataType, StringType) else F.trim(cell).try_cast(f.dataType)).alias(f.name))
    return rows.select(out)


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str,
    multiline: bool = True,
    encoding: str = "UTF-8",
    null_words: Sequence[str] = (),
    **options,
) -> DataFrame:
    """Headered CSV with doubled quotes; columns are found by the header of each file.

    ``multiline`` allows line breaks in cells: files are still read in splits, by many tasks, but in
    two passes and with one exchange of their lines (``csv_records``); pass False when no cell holds a line break. Only
    files in UTF-16 or UTF-32, whose line ends are not single bytes, are then read one per task.
    ``null_words`` turns further words into null; a cell that does not parse is null.
    """
    return _by_name(_read_cells(spark, path, multiline, encoding, **options), schema, null_words)


def read_csv_any_encoding(
    spark: SparkSession,
    path: str | list[str],
    schema: StructType | str,
    fallback: str = "ISO-8859-1",
    multiline: bool = True,
    **options,
) -> DataFrame:
    """CSV files of mixed encodings: each file is read as UTF-8 if it is, else as ``fallback``."""
    return _by_name(_decoded(spark, path, fallback, multiline, **options), schema)


def _decoded(
    spark: SparkSession, path: str | list[str], fallback: str, multiline: bool = True, **options
) -> DataFrame:
    """Cells by file encoding. Latin-1 keeps every byte and the signs of CSV are ASCII, so one read
    serves all files and the cells are decoded afterwards."""
    rows = _read_cells(spark, path, multiline, "ISO-8859-1", **options)

    def decode(c: Column) -> Column:
        raw = F.encode(c, "ISO-8859-1")
        return F.when(F.col("valid"), F.decode(raw, "UTF-8")).otherwise(F.decode(raw, fallback))

    return rows.withColumn("cells", F.transform("cells", decode)).withColumn("names", F.transform("names", decode))


def read_parquet(spark: SparkSession, *paths: str) -> DataFrame:
    return spark.read.parquet(*paths)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """One JSON object per line, which splits."""
    return spark.read.schema(schema).json(path)


def read_json_array(spark: SparkSession, path: str | list[str], schema: StructType | str) -> DataFrame:
    """Whole-file JSON arrays of objects, in UTF-8, each file read by many tasks; an object that does
    not parse is a row of nulls."""
    wide = spark.createDataFrame([], schema).schema if isinstance(schema, str) else schema
    rows = json_objects(spark, path).select(F.from_json("record", wide).alias("r"))
    return rows.select("r.*")


def _holds(spark: SparkSession, folder: str, kind: str) -> bool:
    """Whether a folder has a non-empty file of a kind; an absent folder has none."""
    try:
        found = (spark.read.format("binaryFile").option("pathGlobFilter", f"*.{kind}")
                 .option("recursiveFileLookup", True).load(folder).select("length"))
        return not found.filter("length > 0").limit(1).isEmpty()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return False
        raise


def first_folder(spark: SparkSession, folders: Sequence[str]) -> tuple[str, list[str]]:
    """The first folder that holds csv, parquet or json files, and which of these kinds."""
    for folder in folders:
        if kinds := [k for k in ("csv", "parquet", "json") if _holds(spark, folder, k)]:
            return folder, kinds
    raise FileNotFoundError(f"no csv, parquet or json file in {list(folders)}")


_BAD = "_bad_line"


def _json_lines(spark: SparkSession, folder: str, schema: StructType | str | None) -> tuple[DataFrame, StructType]:
    """Parsed lines ``(file, line, row)`` with the text of bad ones in ``row``; and the schema."""
    options = {"pathGlobFilter": "*.json", "recursiveFileLookup": "true"}
    if schema is None:
        found = spark.read.options(**options).option("columnNameOfCorruptRecord", _BAD).json(folder).schema
    else:
        found = spark.createDataFrame([], schema).schema
    fields = StructType([f for f in found.fields if f.name != _BAD])
    lines = spark.read.options(**options).text(folder).filter(F.trim("value") != "")
    wide = StructType([*fields.fields, StructField(_BAD, StringType())])
    row = F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _BAD})
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("line"), row.alias("row")), fields


def read_mixed(
    spark: SparkSession,
    folders: Sequence[str],
    csv_schema: StructType | str | None = None,
    json_schema: StructType | str | None = None,
) -> DataFrame:
    """All csv, parquet and JSON-lines files of the first folder that holds any.

    Columns are united by name. Without a schema, CSV cells are text under each file's own header
    and JSON is inferred by a pass of its own. Empty files are skipped; lines and files that cannot
    be read are left out here and listed by ``read_mixed_rejects``.
    """
    folder, kinds = first_folder(spark, folders)
    options = {"recursiveFileLookup": "true"}
    parts = []
    if "parquet" in kinds:
        parts.append(spark.read.options(**options, pathGlobFilter="*.parquet", ignoreCorruptFiles="true",
                                        mergeSchema="true").parquet(folder))
    if "csv" in kinds:
        rows = _decoded(spark, folder, "ISO-8859-1", **options, pathGlobFilter="*.csv")
        if csv_schema is None:  # the distinct column names, in order of appearance by name
            names = rows.select(F.explode("names").alias("n")).distinct().orderBy("n").collect()
            csv_schema = StructType([StructField(r["n"], StringType()) for r in names])
        parts.append(_by_name(rows, csv_schema))
    if "json" in kinds:
        lines, fields = _json_lines(spark, folder, json_schema)
        parts.append(lines.filter(F.col(f"row.{_BAD}").isNull()).select(*[F.col("row")[f.name].alias(f.name) for f in fields]))
    return union_all(*parts)


def read_mixed_rejects(
    spark: SparkSession, folders: Sequence[str], json_schema: StructType | str | None = None
) -> DataFrame:
    """``(file, line)`` of what ``read_mixed`` leaves out: JSON lines that do not parse, and, with a
    null line, Parquet files without a readable row."""
    folder, kinds = first_folder(spark, folders)
    out = spark.createDataFrame([], "file string, line string")
    if "json" in kinds:
        lines, _ = _json_lines(spark, folder, json_schema)
        out = out.union(lines.filter(F.col(f"row.{_BAD}").isNotNull()).select("file", "line"))
    if "parquet" in kinds:
        options = {"recursiveFileLookup": "true", "pathGlobFilter": "*.parquet"}
        plain = F.regexp_replace("file", "^file:/+", "file:/")
        there = spark.read.format("binaryFile").options(**options).load(folder).filter("length > 0").select(
            F.col("path").alias("file"))
        read = spark.read.options(**options, ignoreCorruptFiles="true", mergeSchema="true").parquet(folder).select(
            F.col("_metadata.file_path").alias("file")).distinct()
        bad = there.withColumn("f", plain).join(read.select(plain.alias("f")), "f", "left_anti")
        out = out.union(bad.select("file", F.lit(None).cast("string")))
    return out


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The frame itself, or an error that names the missing columns, before anything runs."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df

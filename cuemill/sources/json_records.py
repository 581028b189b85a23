"""Objects of whole-file JSON arrays, read in splits.

A file is read in pieces that end at a closing brace, so a file of one line splits, too. Whether that
brace closes an object of the array depends on what lies before it: whether a string is open, which
each piece flips or leaves, and the depth, to which each piece adds a number. Both are sums: over the
pieces of a split, then over the splits of a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def json_pieces(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """``file, block, row, value``: pieces up to a closing brace, which is left out, in their order in a split."""
    return spark.read.options(**options).option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), "value")


def _depth(text: Column) -> Column:
    """What a piece without escapes adds to the depth, if it starts outside of a string."""
    bare = F.regexp_replace(text, '"[^"]*+(?:"|$)', "")
    return F.length(F.regexp_replace(bare, r"[^{\[]", "")) - F.length(F.regexp_replace(bare, r"[^}\]]", ""))


def _marked(pieces: DataFrame) -> DataFrame:
    """Adds, if a string is not (0) or is (1) open where the split starts: the depth behind the piece and its
    brace, counted from the split's start, and whether the brace is outside of strings."""
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    quotes = F.length(plain) - F.length(F.replace(plain, F.lit('"')))
    rows = pieces.withColumns({"flip": F.pmod(quotes, F.lit(2)), "out": _depth(plain), "in": _depth(F.concat(F.lit('"'), plain))})
    here = Window.partitionBy("file", "block").orderBy("row")
    rows = rows.withColumn("flips", F.sum("flip").over(here))
    for start in (0, 1):
        behind = F.pmod(F.col("flips") + start, F.lit(2)) == 1
        before = F.pmod(F.col("flips") - F.col("flip") + start, F.lit(2)) == 1
        delta = F.when(before, F.col("in")).otherwise(F.col("out")) - F.when(behind, 0).otherwise(1)
        rows = rows.withColumns({f"string_{start}": behind, f"depth_{start}": F.sum(delta).over(here)})
    return rows


def json_objects(spark: SparkSession, path: str | list[str], **options) -> DataFrame:
    """``file, record``: the text of every object of the files' top-level arrays; a file without an array
    gives its objects one by one.

    Two passes over the pieces, spread over all splits; in between there is one row per split. An object
    without inner objects is one piece and passes on as it is, the others are glued.
    """
    pieces = json_pieces(spark, path, **options)
    marked = _marked(pieces)
    last = lambda c: F.max_by(c, "row").alias(c)
    head = F.regexp_replace(F.min_by("value", "row"), "^﻿", "")
    splits = marked.groupBy("file", "block").agg(
        last("string_0"), last("string_1"), last("depth_0"), last("depth_1"),
        F.rlike(head, F.lit(r"^\s*\[")).cast("int").alias("array"))
    here = Window.partitionBy("file").orderBy("block")
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    # A split flips the string bit or leaves it, so its state is a sum again.
    splits = splits.withColumn("open", F.pmod(F.coalesce(F.sum(F.col("string_0").cast("int")).over(earlier), F.lit(0)), F.lit(2)))
    own = F.when(F.col("open") == 1, F.col("depth_1")).otherwise(F.col("depth_0"))
    splits = splits.select("file", "block", "open", F.first("array").over(here).alias("base"),
                           F.coalesce(F.sum(own).over(earlier), F.lit(0)).alias("depth"))
    rows = marked.join(splits, ["file", "block"])
    of = lambda c: F.when(F.col("open") == 1, F.col(f"{c}_1")).otherwise(F.col(f"{c}_0"))
    ends = ~of("string") & (F.col("depth") + of("depth") == F.col("base"))
    rows = rows.select("file", "block", "row", "value", ends.alias("ends"))
    # An object's number: the ends before it, in its split and in those before.
    counts = rows.groupBy("file", "block").agg(F.count_if("ends").alias("n"))
    counts = counts.select("file", "block", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("file", "block").orderBy("row")
    upto = F.sum(F.col("ends").cast("int")).over(inside) - F.col("ends").cast("int")
    rows = rows.withColumn("upto", upto).withColumn("alone", F.col("ends") & F.lag("ends").over(inside))
    rows = rows.join(counts, ["file", "block"]).withColumn("nth", F.col("upto") + F.col("earlier"))
    whole = rows.where("alone").select("file", F.concat("value", F.lit("}")).alias("record"))
    parts = rows.where("NOT coalesce(alone, false)").groupBy("file", "nth").agg(
        F.array_sort(F.collect_list(F.struct("block", "row", "value"))).alias("p"), F.bool_or("ends").alias("ended"))
    glued = parts.where("ended").select("file", F.concat(F.array_join(F.transform("p", lambda p: p["value"]), "}"), F.lit("}")).alias("record"))
    return whole.union(glued).select("file", F.regexp_replace("record", "^﻿?[\\s,\\[]*", "").alias("record"))

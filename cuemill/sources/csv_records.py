"""CSV records of files whose cells hold line breaks, read in splits.

Whether a line starts a record depends on all lines before it, but only through one bit: whether a
quoted cell is open. Each line says what becomes of that bit: it stays, it flips, or it is set whatever
it was. Such steps combine like sums, so lines are summed up inside their split, splits inside their
file, and only the lines of records that span several are glued.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a quoted cell looks like from its first character on, and from somewhere inside it.
_CELL, _REST = r'"(?:[^"]|"")*+"', r'^(?:[^"]|"")*+"'


def _open_after(line: Column, inside: bool) -> Column:
    """Whether a quoted cell is open behind a line that starts inside or outside of one.

    A quote opens a cell only at its start; within other text it means itself.
    """
    if inside:
        closed = F.regexp_replace(line, _REST, "")
        return F.when(line.rlike(_REST), _open_behind(F.concat(F.lit("x"), closed))).otherwise(True)
    return _open_behind(line)


def _open_behind(line: Column) -> Column:
    # Whole quoted cells go; a cell that still starts with a quote is not closed in this line.
    bare = F.regexp_replace(line, f"(^|,){_CELL}", "$1x")
    return bare.rlike('(?:^|,)"')


def csv_lines(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", **options) -> DataFrame:
    """``file, block, row, value``: lines with their split and their order in it; ``\\n`` ends a line."""
    value = F.col("value") if encoding.upper() == "UTF-8" else F.decode(F.col("value").cast("binary"), encoding)
    return spark.read.options(**options).option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), value.alias("value"))


def _marked(lines: DataFrame) -> DataFrame:
    """Adds ``before_0, after_0, before_1, after_1``: whether a cell is open before and behind a line, if
    none, or one, is open where its split starts."""
    plain = ~F.contains("value", F.lit('"'))
    out = F.when(plain, False).otherwise(_open_after(F.col("value"), False))
    in_ = F.when(plain, True).otherwise(_open_after(F.col("value"), True))
    rows = lines.withColumn("out", out).withColumn("in", in_)
    flips = (F.col("out") & ~F.col("in")).cast("int")
    here = Window.partitionBy("file", "block").orderBy("row")
    rows = rows.withColumn("flips", F.sum(flips).over(here))
    # The last line that sets the bit, and the flips so far.
    fixed = F.when(F.col("out") == F.col("in"), F.struct(F.col("out").alias("bit"), F.col("flips").alias("flips")))
    rows = rows.withColumn("fixed", F.last(fixed, ignorenulls=True).over(here))

    def after(start: bool) -> Column:
        odd = lambda n: F.pmod(n, F.lit(2)) == 1
        since = F.col("flips") - F.col("fixed.flips")
        return F.when(F.col("fixed").isNull(), odd(F.col("flips")) != F.lit(start)).otherwise(odd(since) != F.col("fixed.bit"))

    rows = rows.withColumns({"after_0": after(False), "after_1": after(True)})
    return rows.withColumns({"before_0": F.coalesce(F.lag("after_0").over(here), F.lit(False)),
                             "before_1": F.coalesce(F.lag("after_1").over(here), F.lit(True))})


def csv_records(spark: SparkSession, path: str | list[str], encoding: str = "UTF-8", **options) -> DataFrame:
    """``file, first, record``: every record that is not blank, line breaks in cells kept; ``first`` marks a file's
    first one, its header.

    Two passes over the lines, each spread over all splits: one that leaves a row per split, from
    which follows how each split starts, and one that marks the records. Lines that are records pass
    on as they are; the others meet by record. A record that no quote closes reaches to its file's end,
    as for any reader of the format.
    """
    lines = csv_lines(spark, path, encoding, **options)
    marked = _marked(lines)
    last = lambda c: F.max_by(c, "row").alias(c)
    splits = marked.groupBy("file", "block").agg(
        last("after_0"), last("after_1"), F.count_if(~F.col("before_0")).alias("starts_0"),
        F.count_if(~F.col("before_1")).alias("starts_1"))
    # The same sum over the splits of a file: one row each.
    here = Window.partitionBy("file").orderBy("block")
    # Left open if it starts closed, and closed if it starts open.
    splits = splits.withColumn("flips", F.sum((F.col("after_0") & ~F.col("after_1")).cast("int")).over(here))
    fixed = F.when(F.col("after_0") == F.col("after_1"), F.struct(F.col("after_0").alias("bit"), F.col("flips").alias("flips")))
    splits = splits.withColumn("fixed", F.last(fixed, ignorenulls=True).over(here))
    end = F.when(F.col("fixed").isNull(), F.pmod("flips", F.lit(2)) == 1).otherwise(
        (F.pmod(F.col("flips") - F.col("fixed.flips"), F.lit(2)) == 1) != F.col("fixed.bit"))
    splits = splits.withColumn("end", end).withColumn("open", F.coalesce(F.lag("end").over(here), F.lit(False)))
    starts = F.when(F.col("open"), F.col("starts_1")).otherwise(F.col("starts_0"))
    earlier = here.rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.select("file", "block", "open", F.coalesce(F.sum(starts).over(earlier), F.lit(0)).alias("earlier"))
    rows = marked.join(splits, ["file", "block"])
    before, after = (F.when(F.col("open"), F.col(f"{c}_1")).otherwise(F.col(f"{c}_0")) for c in ("before", "after"))
    rows = rows.select("file", "block", "row", "value", "earlier", before.alias("before"), after.alias("after"))
    inside = Window.partitionBy("file", "block").orderBy("row")
    rows = rows.withColumn("nth", F.col("earlier") + F.sum((~F.col("before")).cast("int")).over(inside))
    whole = rows.where("NOT before AND NOT after").select("file", "nth", F.col("value").alias("record"))
    parts = rows.where("before OR after").groupBy("file", "nth").agg(F.array_sort(F.collect_list(
        F.struct("block", "row", "value"))).alias("p"))
    glued = parts.select("file", "nth", F.array_join(F.transform("p", lambda p: p["value"]), "\n").alias("record"))
    record = F.regexp_replace("record", "\r$", "")
    return whole.union(glued).select("file", (F.col("nth") == 1).alias("first"), record.alias("record")).where("first OR record <> ''")

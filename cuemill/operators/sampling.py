"""Samples, splits and folds in a seeded order.

The order is ``(md5(seed:key), key)``, so results do not depend on layout or task order, and
``key`` must be unique. A class may hold most rows, hence no operator sorts a class in one task:
rows are counted in ranges of the hash, and only inside a range are they ranked. Classes may be
many: their counts and quotas stay tables.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.functions.text import col, seeded_hash
from cuemill.session import stored

_HASH, _BUCKET = "_hash", "_bucket"
# Rows that one range of the hash may hold on average.
ROWS_PER_RANGE = 1_000_000


def _narrow(df: DataFrame, columns: Sequence[str], key: str, seed: int) -> DataFrame:
    """``columns``, the key, its hash and hash range, written once: what the passes below read.

    The ranges are as many as keep each at about ``ROWS_PER_RANGE`` rows, 65 536 at least.
    """
    rows = stored(df.select(*dict.fromkeys([*columns, key])).withColumn(_HASH, seeded_hash(F.col(key), seed)), "keys")
    digits = 4
    while rows.count() > ROWS_PER_RANGE * 16 ** digits:
        digits += 1
    return rows.withColumn(_BUCKET, F.conv(F.substring(_HASH, 1, digits), 16, 10).cast("long"))


def _first_per_class(df: DataFrame, label: str, order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows of each class. Each task passes on at most ``n`` rows per class, and these
    meet in 64 groups before the last ranking, which sees at most ``64 n`` rows per class."""
    salted = df.withColumn("_salt", F.spark_partition_id() % 64)
    part = Window.partitionBy(label, "_salt").orderBy(*order)
    few = salted.withColumn("_rank", F.row_number().over(part)).filter(F.col("_rank") <= n)
    whole = Window.partitionBy(label).orderBy(*order)
    return (few.withColumn("_rank", F.row_number().over(whole)).filter(F.col("_rank") <= n)
            .drop("_salt"))


def sample_per_class(
    df: DataFrame, label: str, n: int = 50, seed: int = 42, key: str = "id"
) -> DataFrame:
    """``min(n, class size)`` rows of each class, the first ones in the seeded order."""
    hashed = df.withColumn(_HASH, seeded_hash(F.col(key), seed))
    return _first_per_class(hashed, label, [F.col(_HASH), F.col(key)], n).drop(_HASH, "_rank")


def head_per_class(df: DataFrame, label: str, n: int = 5, order: Sequence[str] = ("id",)) -> DataFrame:
    """First ``n`` rows of each class in the given order."""
    return _first_per_class(df, label, [F.col(c) for c in order], n).drop("_rank")


def shuffle(df: DataFrame, key: str, seed: int = 42) -> DataFrame:
    """All rows in the seeded order, by a range-partitioned sort."""
    return df.orderBy(seeded_hash(F.col(key), seed), F.col(key))


def running_total(rows: DataFrame, order: Sequence[Column], value: Column, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over all earlier rows in ``order``, which must be unique.

    Rows are laid out in ranges of the order and summed inside each; only one total per range meets,
    so no task sees all rows. The layout is written, as later passes must not draw other ranges.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()).withColumn("_value", value)
    inside = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    dealt = stored(dealt, "ranges").withColumn("_inside", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    totals = dealt.groupBy("_range").agg(F.sum("_value").alias("_total"))
    # One row per range.
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("_range", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_earlier"))
    return (dealt.join(totals, "_range").withColumn(name, F.col("_earlier") + F.col("_inside"))
            .select(*rows.columns, name))


def quotas(counts: DataFrame, label: str, n: str, name: str, draws: int) -> DataFrame:
    """Adds ``name``: ``draws`` shared out in proportion to ``n``; the largest remainders round up,
    earlier classes first. One row per class, however many there are."""
    total = counts.agg(F.sum(n)).first()[0] or 0
    if not total:
        return counts.withColumn(name, F.lit(0).cast("long"))
    shares = counts.withColumn("_product", (F.col(n).cast("decimal(19,0)") * F.lit(draws).cast("decimal(19,0)")))
    shares = shares.withColumn("_floor", F.expr(f"cast(_product div cast({total} as decimal(19,0)) as long)"))
    shares = shares.withColumn("_rest", F.col("_product") % F.lit(total).cast("decimal(19,0)"))
    left = draws - (shares.agg(F.sum("_floor")).first()[0] or 0)
    order = [F.desc("_rest"), F.col(label).asc_nulls_last()]
    return (running_total(shares, order, F.lit(1).cast("long"), "_place")
            .withColumn(name, F.col("_floor") + F.when(F.col("_place") < left, 1).otherwise(0))
            .drop("_product", "_floor", "_rest", "_place"))


def split_quotas(counts: DataFrame, label: str, fractions: Sequence[float]) -> DataFrame:
    """``end_0, end_1, …``: rows of each class up to the end of each part but the last. Each step
    leaves ``ceil(fraction · rest)`` rows to the later parts."""
    out = counts.withColumn("_left", F.col("n"))
    before = F.lit(0).cast("long")
    for i, fraction in enumerate(fractions):
        total = out.agg(F.sum("_left")).first()[0] or 0
        out = quotas(out, label, "_left", f"_take_{i}", total - math.ceil(fraction * total))
        before = before + F.col(f"_take_{i}")
        out = out.withColumn("_left", F.col("_left") - F.col(f"_take_{i}")).withColumn(f"end_{i}", before)
    return out.select(label, *[f"end_{i}" for i in range(len(fractions))])


def class_cutoffs(
    df: DataFrame, label: str, key: str, fractions: Sequence[float], seed: int = 42
) -> DataFrame:
    """Where in the seeded order each class passes from one part to the next: per class the hash and
    key of the last row of each part but the last, null for an empty part.

    Label and key are written once; then one aggregate counts hash ranges, and only the ranges that
    hold a boundary are ranked. The result is all that a split needs, so rows never move.
    """
    hashed = _narrow(df, [label], key, seed)
    ranges = stored(hashed.groupBy(label, _BUCKET).agg(F.count("*").alias("n")), "ranges")
    counts = ranges.groupBy(label).agg(F.sum("n").alias("n"))
    ends = stored(split_quotas(counts, label, fractions), "ends").withColumnRenamed(label, "_class")
    running = Window.partitionBy(label).orderBy(_BUCKET)
    spans = ranges.withColumn("_upto", F.sum("n").over(running))
    part = F.explode(F.array(*[F.struct(F.lit(i).alias("part"), F.col(f"end_{i}").alias("end"))
                               for i in range(len(fractions))]))
    wanted = spans.join(ends, F.col(label).eqNullSafe(F.col("_class"))).select(
        "_class", F.col(_BUCKET).alias("_range"), "n", "_upto", part.alias("p"))
    wanted = wanted.filter((F.col("p.end") <= F.col("_upto")) & (F.col("p.end") > F.col("_upto") - F.col("n")))
    wanted = wanted.select("_class", "_range", F.col("p.part").alias("_part"),
                           (F.col("p.end") - F.col("_upto") + F.col("n")).alias("_at"))
    same = F.col(label).eqNullSafe(F.col("_class")) & (F.col(_BUCKET) == F.col("_range"))
    within = Window.partitionBy(label, _BUCKET).orderBy(_HASH, key)
    places = wanted.select("_class", "_range").distinct()
    ranked = hashed.join(places, same).drop("_class", "_range").withColumn("_rank", F.row_number().over(within))
    hits = ranked.join(wanted, same & (F.col("_rank") == F.col("_at"))).groupBy("_class").agg(*[
        F.max(F.when(F.col("_part") == i, F.struct(F.col(_HASH).alias("hash"), F.col(key).alias("key"))))
        .alias(f"cut_{i}") for i in range(len(fractions))])
    found = ends.select("_class").alias("e").join(hits.alias("h"), F.col("e._class").eqNullSafe(F.col("h._class")), "left")
    return stored(found.select("e._class", *[f"cut_{i}" for i in range(len(fractions))]), "cutoffs")


def assign_split(
    df: DataFrame, label: str, key: str, names: Sequence[str], cutoffs: DataFrame, seed: int = 42
) -> DataFrame:
    """Adds ``split`` by comparing each row's place with its class's cutoffs: one narrow pass.

    The cutoffs have one row per class; Spark broadcasts them where they are few.
    """
    part = F.lit(names[-1])
    place = F.col(_HASH)
    for i, name in reversed(list(enumerate(names[:-1]))):
        cut = F.col(f"cut_{i}")
        inside = (place < cut["hash"]) | ((place == cut["hash"]) & (F.col(key) <= cut["key"]))
        part = F.when(F.coalesce(inside, F.lit(False)), F.lit(name)).otherwise(part)
    hashed = df.withColumn(_HASH, seeded_hash(F.col(key), seed))
    joined = hashed.join(cutoffs, F.col(label).eqNullSafe(F.col("_class")))
    return joined.withColumn("split", part).select(*df.columns, "split")


def stratified_split(
    df: DataFrame, label: str, test: float = 0.2, seed: int = 42, key: str = "id",
    names: tuple[str, str] = ("train", "test"),
) -> DataFrame:
    """Exact per-class split; ``ceil(test · n)`` rows are test rows."""
    cutoffs = class_cutoffs(df, label, key, [test], seed)
    return assign_split(df, label, key, names, cutoffs, seed)


def three_way_split(
    df: DataFrame, label: str, seed: int = 42, key: str = "id", held_out: float = 0.2,
    test_share: float = 0.5, names: tuple[str, str, str] = ("train", "val", "test"),
) -> DataFrame:
    """Exact per-class split into train, val and test: 80 %, 10 %, 10 % by default."""
    cutoffs = class_cutoffs(df, label, key, [held_out, test_share], seed)
    return assign_split(df, label, key, names, cutoffs, seed)


def rank_in_order(
    df: DataFrame, by: Sequence[str], key: str, seed: int = 42, name: str = "_rank"
) -> DataFrame:
    """``by``, the key and the rank from 1 of each row in the seeded order of its group, without a
    task per group. Only these columns are shuffled."""
    hashed = _narrow(df, by, key, seed)
    counts = hashed.groupBy(*by, _BUCKET).agg(F.count("*").alias("_n"))
    earlier = Window.partitionBy(*by).orderBy(_BUCKET).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*by, _BUCKET,
                            F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))
    within = Window.partitionBy(*by, _BUCKET).orderBy(_HASH, key)
    # Both sides are laid out by group and range, so a join that is not broadcast moves no row.
    return (hashed.withColumn("_within", F.row_number().over(within))
            .join(offsets, [*by, _BUCKET])
            .select(*by, key, (F.col("_before") + F.col("_within")).alias(name)))


def stratified_kfold(
    df: DataFrame, label: str, k: int = 5, seed: int = 42, key: str = "id"
) -> DataFrame:
    """Adds ``fold``: classes are dealt out in turn, each starting where the last one stopped.

    Folds are found on label and key alone and joined back by key.
    """
    ranked = stored(rank_in_order(df, [label], key, seed), "ranks")
    # Null labels drop out of the equi-join by label above.
    counts = ranked.groupBy(label).agg(F.count("*").alias("_n"))
    if not df.filter(F.col(label).isNull()).limit(1).isEmpty():
        raise ValueError(f"{label} has null values")
    starts = running_total(counts, [F.col(label).asc()], F.col("_n"), "_start").select(label, "_start")
    fold = ((F.col("_rank") - 1 + F.col("_start")) % k).cast("int").alias("fold")
    folds = ranked.join(starts, label).select(key, fold)
    return df.join(folds, key).select(*df.columns, "fold")


def fold_index_table(
    folded: DataFrame, key: str, k: int = 5, seed: int = 42, chunk: int = 100_000
) -> DataFrame:
    """Rows ``(fold, part, chunk, indices)``: the training and validation keys of each fold.

    A fold's index list grows with the table, so it comes in chunks of about ``chunk`` keys (by
    hash, at most a few more); a reader concatenates them. Each key is in ``k`` lists, once as a
    validation key.
    """
    n_chunks = F.greatest(F.lit(1), F.ceil(folded.agg(F.count("*")).scalar() / F.lit(chunk)))
    placed = folded.select(key, "fold", F.pmod(F.xxhash64(key), n_chunks).alias("chunk"))
    lists = placed.select(
        key, "chunk",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                              lambda f: F.struct(f.alias("fold"), F.when(f == F.col("fold"), "val")
                                                 .otherwise("train").alias("part")))).alias("f"))
    return (lists.groupBy(F.col("f.fold").alias("fold"), F.col("f.part").alias("part"), "chunk")
            .agg(F.sort_array(F.collect_list(key)).alias("indices")))


def fold_index(folded: DataFrame, key: str, k: int = 5, seed: int = 42, chunk: int = 100_000) -> DataFrame:
    """The same with both lists side by side: ``(fold, chunk, train_indices, val_indices)``."""
    parts = fold_index_table(folded, key, k, seed, chunk)

    def of(part: str) -> Column:
        empty = F.array().cast(parts.schema["indices"].dataType)
        return F.coalesce(F.max(F.when(F.col("part") == part, F.col("indices"))), empty).alias(f"{part}_indices")

    return parts.groupBy("fold", "chunk").agg(of("train"), of("val"))


def hash_split(
    df: DataFrame, key: str, test: float = 0.2, seed: int = 42,
    names: tuple[str, str] = ("train", "test"),
) -> DataFrame:
    """Split by hash alone: one narrow pass, also on a stream; sizes hold on average only."""
    place = F.conv(F.substring(seeded_hash(col(key), seed), 1, 8), 16, 10).cast("double") / 2.0 ** 32
    return df.withColumn("split", F.when(place < test, names[1]).otherwise(names[0]))


def gold_rows(gold: DataFrame, source: str = "gold") -> DataFrame:
    """Gold rows ``(sentence, gold_label, split)`` in the shape of evaluation rows."""
    return gold.select("sentence", F.col("gold_label").alias("label"), "split",
                       F.lit(source).alias("source"))


def add_gold(eval_df: DataFrame, gold: DataFrame, split: str, source: str = "external") -> DataFrame:
    """Evaluation rows and the gold rows of ``split``, told apart by ``source``."""
    own = eval_df.withColumn("source", F.lit(source))
    golden = gold_rows(gold.filter(F.col("split") == split)).drop("split")
    return own.unionByName(golden, allowMissingColumns=True)

"""Mixing sources to target weights: exact block quotas per output shard, native DataFrame code only."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.common import n_words, own_name, own_prefix, tasks, written


def ranked_sources(sizes: DataFrame) -> DataFrame:
    """``source, source_size`` with ``source_no`` from 0 by code point, null last.

    Sources are range-partitioned and numbered inside the ranges; only one count per range meets.
    """
    key = F.col("source").asc_nulls_last()
    dealt = written(sizes.repartitionByRange(tasks(sizes), key).sortWithinPartitions(key)
                    .withColumn("m", F.monotonically_increasing_id()), "sources")
    place = dealt.withColumn("part", F.shiftright("m", 33)).withColumn(
        "inside", F.col("m").bitwiseAND(F.lit((1 << 33) - 1)))
    parts = place.groupBy("part").agg(F.count("*").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    return place.join(parts, "part").select(
        "source", "source_size", (F.col("before") + F.col("inside")).alias("source_no"))


def source_targets(sources: DataFrame, weights: Sequence[float], share: float,
                   cap: float) -> DataFrame:
    """Adds ``target``: ``share`` of all sizes by weight, none above ``cap`` times its source.

    What a capped source cannot take is shared again by weight among the others. Every round is one
    aggregate over the sources; the capped ones only grow in number, so the rounds end.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    rows = written(sources.withColumn(
        "weight", F.get(cycle, F.pmod("source_no", F.lit(len(weights))).cast("int")))
        .withColumn("most", cap * F.col("source_size").cast("double")), "weights")
    total = share * float(rows.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, -1
    while True:
        full = F.col("weight") * level >= F.col("most")
        n, held, free = rows.agg(
            F.count(F.when(full, 1)), F.sum(F.when(full, F.col("most")).otherwise(0.0)),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight")))).first()
        if n == capped or not free:
            break
        level, capped = (total - held) / free, n
    full = F.col("weight") * level >= F.col("most")
    return rows.withColumn("target", F.when(full, F.col("most")).otherwise(F.col("weight") * level))


def halved(total: int, n_shards: int) -> list[int]:
    """``total`` blocks over the shards: every node's left child gets the larger half."""
    sizes = [total]
    while len(sizes) < n_shards:
        sizes = [part for n in sizes for part in ((n + 1) // 2, n // 2)]
    return sizes


def split_groups(members: DataFrame, quotas: DataFrame, n_shards: int, seed: int) -> DataFrame:
    """``member, shard, quota`` from ``grp, member, n`` and ``grp, q``: a group's blocks per shard.

    A node of a group holds the block counts of its members and the quotas of its shards. Its left
    child gets as many blocks as the left half of these shards, drawn without replacement: the fold
    goes over members and blocks and takes a block with probability (places left) / (blocks left),
    which is the exact conditional law. Numbers follow a hash of seed, group and node, so reruns and
    retries agree.
    """
    node = members.where("n > 0").groupBy("grp").agg(F.expr("array_sort(collect_list(struct(member, n)))").alias("c"))
    node = node.join(quotas, "grp").withColumn("node", F.lit(1).cast("long"))
    hit = f"IF(pmod(xxhash64({seed}L, grp, node, a.n), a.n) < a.l, 1L, 0L)"
    draw = ("aggregate(sequence(1L, x.n), struct(s.n AS n, s.l AS l, 0L AS got), "
            f"(a, k) -> struct(a.n - 1 AS n, a.l - {hit} AS l, a.got + {hit} AS got))")
    typed = "cast(array() as array<struct<member:bigint,n:bigint,got:bigint>>)"
    fold = (f"aggregate(c, struct(total AS n, places AS l, {typed} AS out), (s, x) -> "
            f"transform(array({draw}), d -> struct(d.n AS n, d.l AS l, "
            "concat(s.out, array(struct(x.member AS member, x.n AS n, d.got AS got))) AS out))[0])")
    # Members without blocks left are out: sequence(1, 0) would count down.
    children = ("array(struct(node * 2 AS node, slice(q, 1, half) AS q, filter(transform(drawn, d -> struct("
                "d.member AS member, d.got AS n)), d -> d.n > 0) AS c), struct(node * 2 + 1 AS node, "
                "slice(q, half + 1, half) AS q, filter(transform(drawn, d -> struct(d.member AS member, "
                "d.n - d.got AS n)), d -> d.n > 0) AS c))")
    for _ in range(int(math.log2(n_shards))):
        sums = (node.withColumn("half", F.expr("size(q) div 2").cast("int"))
                .withColumn("total", F.expr("aggregate(c, 0L, (s, x) -> s + x.n)"))
                .withColumn("places", F.expr("aggregate(slice(q, 1, half), 0L, (s, x) -> s + x)")))
        split = sums.withColumn("drawn", F.expr(fold).getField("out"))
        node = split.select("grp", F.explode(F.expr(children)).alias("x")).select("grp", "x.*")
        node = node.repartition(tasks(members), "grp", "node")  # a level's nodes draw side by side
    return node.select((F.col("node") - n_shards).alias("shard"), F.explode("c").alias("x")).select(
        F.col("x.member").alias("member"), "shard", F.col("x.n").alias("quota"))


def shard_quotas(blocks: DataFrame, n_shards: int, seed: int, fan: int = 256) -> DataFrame:
    """``source_no, shard, quota`` from ``source_no, n_blocks`` by a multivariate-hypergeometric tree.

    Sources are put in groups of ``fan`` neighbours, these in groups again, until one holds all. The
    top group's blocks are halved down to the shards; what a shard takes from a group is drawn among
    its members, from the top down, so that a row holds at most ``fan`` counts however many sources
    there are. Drawing a group's total first and then its members is the same law as drawing the
    members at once. The work is one step per block and level, and there are at most ``n_shards *
    blocks_per_shard`` blocks besides one per source, whatever the input.
    """
    if n_shards < 1 or n_shards & (n_shards - 1):
        raise ValueError("n_shards must be a power of two")
    total, last = blocks.agg(F.sum("n_blocks"), F.max("source_no")).first()
    depth = 1
    while fan ** depth <= (last or 0):
        depth += 1
    sizes = F.array(*[F.lit(n).cast("long") for n in halved(total or 0, n_shards)])
    quotas = blocks.sparkSession.range(1).select(F.col("id").alias("grp"), sizes.alias("q"))
    for level in range(depth - 1, -1, -1):
        members = blocks.select(F.expr(f"source_no div {fan ** (level + 1)}").alias("grp"),
                                F.expr(f"source_no div {fan ** level}").alias("member"), "n_blocks")
        members = members.groupBy("grp", "member").agg(F.sum("n_blocks").alias("n"))
        drawn = split_groups(members, quotas, n_shards, seed + level)
        if level:
            drawn = written(drawn, "quotas")
            of = F.map_from_entries(F.collect_list(F.struct("shard", "quota")))
            quotas = drawn.groupBy(F.col("member").alias("grp")).agg(of.alias("m")).select("grp", F.expr(
                f"transform(sequence(0L, {n_shards - 1}L), k -> coalesce(m[k], 0L))").alias("q"))
    return drawn.select(F.col("member").alias("source_no"), "shard", "quota")


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", weights: Sequence[float] = (5, 2, 1), share: float = 1.5,
             cap: float = 2.0, n_shards: int = 64, blocks_per_shard: int = 256,
             seed: int = 17) -> DataFrame:
    """One row per document: ``size, source_size, target, taken``, its ``place`` in the stream of its
    source, the ``source_blocks`` that the shards hold of it, and per epoch ``words_e, shard_e``.

    A source's documents in seeded order, repeated, are a stream of words; the mix takes its first
    ``round(target)`` words, so every source meets its target to the word, no document is taken more
    than ``ceil(cap)`` times, and only one document a source is cut. The stream is cut into blocks;
    the splitting tree says how many blocks of each source a shard gets, and a seeded permutation
    which. No text is shuffled: offsets come from sums per (source, 4096 hash ranges), so a source
    with a third of all rows is spread over as many groups.

    A null text has size 0; null is a source of its own; sources without words get target 0.
    Repeated rows are documents of their own. An empty table gives an empty result.
    """
    epochs = math.ceil(cap)
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))))
    rows = written(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"),
                               n_words(text_col).alias("size"), order.alias("h"))
                   .withColumn("range", F.substring("h", 1, 3)), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = written(source_targets(ranked_sources(sizes), weights, share, cap), "targets")
    total = targets.agg(F.sum(F.floor(F.col("target") + 0.5))).first()[0] or 0
    block = max(1, -(-total // (n_shards * blocks_per_shard)))
    targets = (targets.withColumn("goal", F.floor(F.col("target") + 0.5).cast("long"))
               .withColumn("n_blocks", F.ceil(F.col("goal") / block).cast("long")))
    # Which shard gets which block: quotas laid end to end, blocks in a seeded order.
    quotas = shard_quotas(targets.select("source_no", "n_blocks"), n_shards, seed)
    upto = Window.partitionBy("source_no").orderBy("shard")
    slots = (quotas.withColumn("last", F.sum("quota").over(upto)).where("quota > 0")
             .select("source_no", "shard", F.explode(F.expr("sequence(last - quota + 1, last)")).alias("slot")))
    listed = targets.where("n_blocks > 0").select("source_no", F.explode(F.expr("sequence(0L, n_blocks - 1)")).alias("block"))
    shuffled = listed.withColumn("slot", F.row_number().over(Window.partitionBy("source_no").orderBy(
        F.xxhash64(F.lit(seed), "source_no", "block"), "block")).cast("long"))
    placed = written(shuffled.join(slots, ["source_no", "slot"]).select("source_no", "block", "shard"),
                     "blocks")
    held = placed.groupBy("source_no").agg(F.count("*").alias("source_blocks"))
    targets = targets.join(held, "source_no", "left").withColumn(
        "source_blocks", F.coalesce("source_blocks", F.lit(0).cast("long")))
    # A document's place in its source's stream.
    ranges = rows.groupBy("source", "range").agg(F.sum("size").alias("in_range"))
    before = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("base", F.coalesce(F.sum("in_range").over(before), F.lit(0))).drop("in_range")
    inside = (Window.partitionBy("source", "range").orderBy("h", "id", "size")
              .rowsBetween(Window.unboundedPreceding, -1))
    out = rows.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0))).alias("d")
    out = (out.join(ranges.alias("r"), F.col("d.source").eqNullSafe(F.col("r.source"))
                    & (F.col("d.range") == F.col("r.range")))
           .select("d.*", (F.col("base") + F.col("inside")).alias("place")).alias("d"))
    out = (out.join(targets.alias("t"), F.col("d.source").eqNullSafe(F.col("t.source")))
           .select("d.*", "source_no", "source_size", "target", "goal", "source_blocks"))
    taken = F.lit(0).cast("long")
    for e in range(epochs):
        start = F.col("place") + e * F.col("source_size")
        words = F.greatest(F.lit(0).cast("long"), F.least(F.col("size"), F.col("goal") - start))
        out = (out.withColumn(f"words_{e}", words)
               .withColumn("block", F.when(words > 0, F.floor(start / F.lit(block)).cast("long")))
               .join(placed.withColumnRenamed("shard", f"shard_{e}"), ["source_no", "block"], "left")
               .drop("block"))
        taken = taken + F.when(F.col(f"shard_{e}").isNotNull(), F.col(f"words_{e}")).otherwise(0)
    return out.select(
        F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"), "place", "source_blocks",
        *[c for e in range(epochs) for c in (f"words_{e}", f"shard_{e}")])


def mix_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  source_col: str = "source", cap: float = 2.0, seed: int = 17, **options) -> DataFrame:
    """The mix itself: every taken copy as a row of ``docs`` with ``copy``, ``shard`` and ``place`` in it.

    Copies are shuffled inside their shard by a seeded order. The one copy a source that its target
    cuts is kept whole. Rows without an id are left out; of rows that share one, each gets its own
    copies, in the order of their texts. An added column whose name ``docs`` bears already gets
    underscores behind it.
    """
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(source_col).alias("source"))
    plan = mix_plan(narrow, id_col="id", cap=cap, seed=seed, **options)
    epochs = range(math.ceil(cap))
    shards = F.filter(F.array(*[F.when(F.col(f"words_{e}") > 0, F.col(f"shard_{e}")) for e in epochs]),
                      lambda x: x.isNotNull())
    p = own_prefix(docs)
    shard, copy, place = (own_name(docs, c) for c in ("shard", "copy", "place"))
    mine = plan.groupBy(F.col("id").alias(f"{p}id")).agg(F.array_sort(F.collect_list(
        F.struct("size", "place", shards.alias("shards")))).alias(f"{p}plan"))
    nth = Window.partitionBy(id_col).orderBy(f"{p}size", text_col)
    rows = (docs.withColumn(f"{p}size", n_words(text_col)).withColumn(f"{p}n", F.row_number().over(nth))
            .join(mine, F.col(id_col) == F.col(f"{p}id")))
    copies = rows.select(*[F.col(f"`{c}`") for c in docs.columns], F.posexplode(
        F.element_at(f"{p}plan", F.col(f"{p}n"))["shards"]).alias(copy, shard))
    local = Window.partitionBy(shard).orderBy(F.xxhash64(F.lit(seed), F.col(id_col), F.col(copy)), id_col)
    return copies.withColumn(place, F.row_number().over(local))

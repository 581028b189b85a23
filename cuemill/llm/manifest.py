"""Merkle dataset manifest: hash trees by slot pivots, proofs, and the check of changed rows.

A level of the tree is a table of parents with one column per child slot, filled by conditional
aggregates. The digest of a parent concatenates its columns; leaving out the own slot gives a child's
siblings. Everything is DataFrame code, and each level is written, so a lost executor costs no more
than its tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.common import tasks, written

#: What the documents of a corpus are hashed over, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STEP = "array<struct<before:string,after:string>>"


def leaf_digest(values: Sequence[Column]) -> Column:
    """SHA-256 over the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-"))
                             for t in texts]), 256)


def numbered(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` with ``no`` from 0 in the given order, as a written table.

    Rows are range-partitioned and numbered inside their range; only one count per range meets. The
    order must tell rows apart, or a range could hold no more than one value's rows.
    """
    dealt = written(df.repartitionByRange(tasks(df), *order).sortWithinPartitions(*order)
                    .withColumn("_m", F.monotonically_increasing_id()), f"{name}-dealt")
    part = F.shiftright("_m", 33)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(part.alias("_part")).agg(F.count("*").alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    return dealt.withColumn("_part", part).join(starts, "_part").select(
        *df.columns, (F.col("_start") + inside).alias("no"))


def _slots(fanout: int) -> list[str]:
    return [f"c{s}" for s in range(fanout)]


def _pivoted(nodes: DataFrame, fanout: int, *more: Column) -> DataFrame:
    """``g, n, up, c0…`` from nodes ``g, n, idx, h``: each parent's children by slot."""
    slot = F.pmod("idx", F.lit(fanout))
    return nodes.groupBy("g", "n", F.expr(f"idx div {fanout}").alias("up")).agg(
        *[F.max(F.when(slot == s, F.col("h"))).alias(c) for s, c in enumerate(_slots(fanout))], *more)


def _parents(pivot: DataFrame, fanout: int) -> DataFrame:
    """The nodes of the next level; ``n`` is their number in the tree ``g``."""
    digest = F.sha2(F.concat(*[F.coalesce(c, F.lit("")) for c in _slots(fanout)]), 256)
    return pivot.select("g", F.expr(f"(n + {fanout - 1}) div {fanout}").alias("n"), F.col("up").alias("idx"),
                        digest.alias("h"))


def _step(slot: Column, fanout: int) -> Column:
    """The siblings left and right of a slot; empty slots add nothing."""
    row = F.array(*_slots(fanout))
    return F.struct(F.array_join(F.slice(row, 1, slot), "").alias("before"),
                    F.array_join(F.slice(row, slot + 2, F.lit(fanout)), "").alias("after"))


def _levels(first: DataFrame, most: int, fanout: int, name: str) -> tuple[list[DataFrame], DataFrame]:
    """The pivots above ``first`` (itself a pivot over the leaves, of any group size) and the top
    digest ``g, h`` of every tree. ``most`` is the largest number of leaves in a tree."""
    slots = _slots(fanout)
    # A lone leaf is its own top.
    tops = first.where("n = 1").select("g", F.col(slots[0]).alias("h"))
    pivots, pivot = [], first
    while most > 1:
        nodes = _parents(pivot.where("n > 1"), fanout)
        most = -(-most // fanout)
        tops = tops.union(nodes.where("n = 1").select("g", "h"))
        if most > 1:
            pivot = written(_pivoted(nodes.where("n > 1"), fanout), name)
            pivots.append(pivot)
    return pivots, tops


def _with_steps(first: DataFrame, pivots: list[DataFrame], above: DataFrame, fanout: int) -> DataFrame:
    """``first`` with ``steps``, those of its parents up to the root; ``above`` holds ``g, steps`` of
    the trees' tops. A level has a sixteenth of the rows below it, and joins go from the top down."""
    known = None
    for pivot in [*reversed(pivots), first]:
        # The parent that a pivot row stands for is a top if it is the only one.
        top = F.col("n") <= fanout
        out = pivot.where(top).join(above, "g")
        if known is not None:
            parent = known.select("g", F.col("up").alias("upper"), F.col("steps").alias("rest"), *_slots(fanout))
            own = pivot.where(~top).select(
                *[F.col(c).alias(f"own_{c}" if c in _slots(fanout) else c) for c in pivot.columns])
            own = own.withColumn("upper", F.expr(f"up div {fanout}")).join(parent, ["g", "upper"])
            steps = F.concat(F.array(_step(F.pmod("up", F.lit(fanout)).cast("int"), fanout)), "rest")
            out = out.unionByName(own.withColumn("steps", steps).select(
                *[F.col(f"own_{c}" if c in _slots(fanout) else c).alias(c) for c in pivot.columns], "steps"))
        known = out
    return known


@dataclass(frozen=True)
class Manifest:
    """A built tree. ``root`` is null for an empty table."""

    leaves: DataFrame     # runs of leaves: g, n, up, c0…, members (slot, id, claim)
    levels: list[DataFrame]
    tops: DataFrame       # g, source, subroot, steps from the subroot to the root
    root: str | None
    fanout: int

    def subroots(self) -> DataFrame:
        return self.tops.select("source", "subroot")

    def proofs(self) -> DataFrame:
        """``id, leaf, claim, source, subroot, steps`` for every row: the siblings left and right of it
        on every level from its leaf to the root."""
        rows = _with_steps(self.leaves, self.levels, self.tops.select("g", "steps"), self.fanout)
        rows = rows.join(self.tops.select("g", "source", "subroot"), "g")
        rows = rows.withColumn("m", F.explode("members"))
        slot = F.col("m.slot")
        own = F.when(F.col("n") > 1, F.array(_step(slot, self.fanout))).otherwise(F.array().cast(STEP))
        return rows.select(F.col("m.id").alias("id"), F.element_at(F.array(*_slots(self.fanout)), slot + 1).alias("leaf"),
                           F.col("m.claim").alias("claim"), "source", "subroot",
                           F.concat(own, "steps").alias("steps"))


def build_manifest(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source",
                   fields: Sequence[str] = FIELDS, fanout: int = 16, claim: Column | None = None) -> Manifest:
    """The hash tree of ``docs``: leaves per source by id, sources in a tree of their own.

    A leaf is the digest of ``fields``. Per source, leaves ascend by id (null first; rows of one id
    by their digest, equal rows in any order, as they cannot be told apart); while several nodes
    remain, each run of ``fanout`` becomes the digest of its digests. The trees' tops, ordered by
    source (null first, then bytewise), form a tree alike. ``claim`` is a digest over a row's
    columns, such as that of a changed copy, to hold against the tree; it is kept where it is not null.

    Texts are read once; what moves is 64 bytes a row and field. A source with most rows is numbered
    and pivoted in ranges and runs like any other. Any number of sources will do. Repeated rows are
    leaves of their own, null and empty values have different digests, other columns are not looked
    at, and an empty table has no root.
    """
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"),
                       leaf_digest([F.col(f"`{c}`") for c in fields]).alias("h"),
                       (F.lit(None).cast("string") if claim is None else claim).alias("claim"),
                       F.monotonically_increasing_id().alias("tie"))
    rows = written(rows, "leaves")
    rows = numbered(rows, [F.col("source").asc_nulls_first(), F.col("id").asc_nulls_first(), F.col("h"), F.col("tie")],
                    "leaves")
    sources = written(rows.groupBy("source").agg(F.count("*").alias("n"), F.min("no").alias("first")), "sources")
    sources = written(numbered(sources, [F.col("source").asc_nulls_first()], "sources")
                      .withColumnRenamed("no", "g"), "numbered")
    most, n_sources = sources.agg(F.max("n"), F.count("*")).first()
    leaves = rows.alias("r").join(sources.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source"))).select(
        "g", "n", (F.col("no") - F.col("first")).alias("idx"), "h",
        F.struct(F.pmod(F.col("no") - F.col("first"), F.lit(fanout)).cast("int").alias("slot"), "id", "claim").alias("m"))
    first = written(_pivoted(leaves, fanout, F.collect_list("m").alias("members")), "runs")
    levels, tops = _levels(first, most or 0, fanout, "level")
    tops = written(tops, "tops")
    heads = written(_pivoted(tops.select(F.lit(0).cast("long").alias("g"), F.lit(n_sources).cast("long").alias("n"),
                                         F.col("g").alias("idx"), "h"), fanout), "heads")
    upper, roots = _levels(heads, n_sources, fanout, "upper")
    root = roots.first()
    # From a subroot to the root: as many steps as the tree of sources has levels.
    none = docs.sparkSession.range(1).select(F.lit(0).cast("long").alias("g"), F.array().cast(STEP).alias("steps"))
    paths = _with_steps(heads, upper, none, fanout).select(
        "n", "steps", "up", *_slots(fanout), F.explode(F.sequence(F.lit(0), F.lit(fanout - 1))).alias("slot")
    ).where(F.element_at(F.array(*_slots(fanout)), F.col("slot") + 1).isNotNull())
    own = F.when(F.col("n") > 1, F.array(_step(F.col("slot"), fanout))).otherwise(F.array().cast(STEP))
    paths = paths.select((F.col("up") * fanout + F.col("slot")).alias("g"), F.concat(own, "steps").alias("steps"))
    tops = written(tops.withColumnRenamed("h", "subroot").join(sources.select("g", "source"), "g").join(paths, "g"), "paths")
    return Manifest(first, levels, tops, root["h"] if root else None, fanout)


def proof_digest(steps: Column) -> Column:
    """SHA-256 over all siblings, level by level to the root, left to right."""
    return F.sha2(F.array_join(F.transform(steps, lambda s: F.concat(s["before"], s["after"])), ""), 256)


def folded(leaf: Column, steps: Column) -> Column:
    """The root that follows from a leaf's digest and its siblings."""
    return F.aggregate(steps, leaf, lambda h, s: F.sha2(F.concat(s["before"], h, s["after"]), 256))


def verified_proofs(manifest: Manifest) -> DataFrame:
    """``id, leaf, subroot, root, proof_sha256, folded_root, verified`` of every row: its root is
    computed anew from its claimed digest (its own one if it claims none) and its siblings."""
    root = F.lit(manifest.root).cast("string")
    rows = manifest.proofs().select("id", "leaf", "subroot", root.alias("root"), proof_digest(F.col("steps")).alias("proof_sha256"),
                                    folded(F.coalesce("claim", "leaf"), F.col("steps")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))


def merkle_manifest(docs: DataFrame, *, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
                    fields: Sequence[str] = FIELDS, fanout: int = 16, every: int = 5) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified``: every row's proof, held
    against a copy in which rows whose CRC-32 of the id ``every`` divides have lost their capitals A-Z.

    A null id is never changed and counts as null; a null text stays null. See :func:`build_manifest`.
    """
    lowered = [F.translate(F.col(f"`{c}`"), UPPER, LOWER) if c == text_col else F.col(f"`{c}`") for c in fields]
    hit = F.crc32(F.col(f"`{id_col}`").cast("string")) % every == 0
    manifest = build_manifest(docs, id_col=id_col, source_col=source_col, fields=fields, fanout=fanout,
                              claim=F.when(hit, leaf_digest(lowered)))
    return verified_proofs(manifest).withColumnRenamed("id", id_col)

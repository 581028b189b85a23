"""Exact substring dedup: a suffix order by blocks, with difference-cover samples against long ties."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.common import bounded_batches, distinct, pack_sorted, tasks, unpack_sorted, utf8, written

#: A planar difference set: every residue modulo 57 but 0 is a difference of two members once.
PERIOD, COVER = 57, (1, 6, 7, 9, 19, 38, 42, 49)


def window_prints(raw: np.ndarray, width: int) -> np.ndarray:
    """64-bit fingerprints of the ``width`` bytes at every position, by doubling."""
    n = len(raw) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
        base, size = np.uint64(0x9E3779B97F4A7C15), 1
        while size * 2 <= width:
            h = h[:-size] * base + h[size:]
            base, size = base * base, size * 2
        # Two overlapping windows of a power of two make the whole width; then mix the bits.
        h = h[:n] * np.uint64(0xFF51AFD7ED558CCD) + h[width - size:width - size + n]
        h ^= h >> np.uint64(33)
        h *= np.uint64(0xC4CEB9FE1A85EC53)
        h ^= h >> np.uint64(29)
    return h


class Block:
    """The texts of one range of ids in order, without later copies, as one string of bytes."""

    def __init__(self, rows: pd.DataFrame, copies: dict[int, set[bytes]], width: int):
        """``copies``: by id the SHA-256 of texts that an earlier block has whole."""
        texts = [utf8(t) for t in rows["text"]]
        order = sorted(range(len(texts)), key=lambda i: (rows["id"].iat[i], texts[i]))
        self.ids = [int(rows["id"].iat[i]) for i in order]
        self.texts = [texts[i] for i in order]
        known = {t for i, t in zip(self.ids, self.texts)
                 if i in copies and hashlib.sha256(t).digest() in copies[i]}
        self.copy = np.array([t in known for t in self.texts], bool)
        sizes = np.array([0 if c else len(t) for t, c in zip(self.texts, self.copy)], np.int64)
        self.raw = np.frombuffer(b"".join(t for t, c in zip(self.texts, self.copy) if not c), np.uint8)
        self.width, self.ends = width, np.cumsum(sizes)
        self.starts = self.ends - sizes
        self.left = np.repeat(self.ends, sizes) - np.arange(len(self.raw))  # bytes up to the text's end
        self.place = np.arange(len(self.raw)) - np.repeat(self.starts, sizes)

    def samples(self, bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the cover sample and ``bits`` of the fingerprints of what they begin: as much
        as a string of ``width`` bytes has behind any offset below a period."""
        size = self.width - PERIOD + 1
        prints = window_prints(self.raw, size)
        cover = np.zeros(PERIOD, bool)
        cover[[c % PERIOD for c in COVER]] = True
        at = np.flatnonzero(cover[self.place % PERIOD][:len(prints)] & (self.left[:len(prints)] >= size))
        return at, prints[at] >> np.uint64(64 - bits)

    def candidates(self, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes with a shared sample within a period, and the keys of their first ``width`` bytes.

        Of two equal strings of ``width`` bytes, some pair of samples at the same distance below a
        period lies in both; so a suffix none of whose samples is shared is unique.
        """
        prints = window_prints(self.raw, self.width)
        if not len(prints) or not len(shared):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        reach = np.zeros(len(self.raw) + 1, np.int32)
        np.add.at(reach, np.maximum(shared - PERIOD + 1, 0), 1)
        np.add.at(reach, shared + 1, -1)
        near = np.cumsum(reach)[:len(prints)] > 0
        at = np.flatnonzero(near & (self.left[:len(prints)] >= self.width))
        return at, prints[at]

    def result(self, later: np.ndarray, id_col: str) -> pd.DataFrame:
        """Per text what stays when the ``width`` bytes at every later position are removed."""
        edge = np.zeros(len(self.raw) + 1, np.int32)
        edge[later] += 1
        edge[np.minimum(later + self.width, len(self.raw))] -= 1
        gone = np.cumsum(edge[:-1]) > 0
        out = []
        for i, t, copy, a, b in zip(self.ids, self.texts, self.copy, self.starts, self.ends):
            cut = np.full(len(t), len(t) >= self.width) if copy else gone[a:b]
            spans = int(np.count_nonzero(cut[1:] & ~cut[:-1]) + (len(cut) > 0 and bool(cut[0])))
            kept = np.frombuffer(t, np.uint8)[~cut].tobytes() if spans else t
            out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest(), kept))
        return pd.DataFrame(out, columns=[id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def _bucketed(keys: np.ndarray, buckets: int, bits: int) -> list[tuple[int, np.ndarray]]:
    """Ascending keys of so many bits cut at the buckets' borders; a bucket is a range of the keys."""
    bucket = (keys >> np.uint64(bits - 32)) * np.uint64(buckets) >> np.uint64(32)
    first = np.flatnonzero(np.diff(bucket.astype(np.int64), prepend=-1))
    return [(int(bucket[a]), keys[a:b]) for a, b in zip(first, np.append(first[1:], len(keys)))]


SENT = "bucket int, block long, keys binary"
BACK = "block long, kind int, bucket int, bits binary"


def _send(block: int, keys: np.ndarray, buckets: int, bits: int) -> pd.DataFrame:
    parts = _bucketed(keys, buckets, bits)
    return pd.DataFrame({"bucket": [b for b, _ in parts], "block": block,
                         "keys": [pack_sorted(k) for _, k in parts]})


def _sort_bucket(kind: int, keep_first: bool):
    """Sorts one bucket of all blocks' keys; marks those that (an earlier) another block has too."""
    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("block")
        lists = [unpack_sorted(k) for k in group["keys"]]
        keys = np.concatenate(lists)
        order = np.argsort(keys, kind="stable")  # equal keys stay in block order
        ranked = keys[order]
        same = ranked[1:] == ranked[:-1]
        marks = np.zeros(len(keys), bool)
        marks[order[1:]] = same
        if not keep_first:
            marks[order[:-1]] |= same
        cuts = np.cumsum([len(k) for k in lists])[:-1]
        bits = [np.packbits(m).tobytes() for m in np.split(marks, cuts)]
        return pd.DataFrame({"block": group["block"].to_numpy(), "kind": kind,
                             "bucket": group["bucket"].to_numpy(), "bits": bits})

    return run


def _marked(keys: np.ndarray, back: pd.DataFrame, kind: int, buckets: int, bits: int) -> np.ndarray:
    """Which of the block's distinct ascending keys the buckets have marked."""
    maps = {r.bucket: r.bits for r in back[back["kind"] == kind].itertuples()}
    parts = [np.unpackbits(np.frombuffer(maps[b], np.uint8), count=len(k))
             for b, k in _bucketed(keys, buckets, bits)]
    return np.concatenate(parts).astype(bool) if parts else np.zeros(0, bool)


def _with_blocks(rows: DataFrame, block_bytes: int) -> tuple[DataFrame, int]:
    """Adds ``block``: rows in the order of id and text, cut by the running sum of their bytes.

    Nothing is assumed about the ids. Bytes are summed per id, ids are dealt to ranges, and sums run
    inside each range behind those of the ranges before. The driver gets one sum per range and one id
    per block. An id of more than ``block_bytes`` is cut by a running sum in the order of its texts:
    a sort that can spill, but one task per such id. Also returns all bytes.
    """
    length = F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(1)
    ids = rows.groupBy("id").agg(F.sum(length).alias("n"))
    # Written, as the borders of the ranges are drawn anew by each job.
    ids = written(ids.repartitionByRange(tasks(rows), "id").withColumn("part", F.spark_partition_id()), "ids")
    sums = {r.part: (r.low, r.n) for r in ids.groupBy("part").agg(F.min("id").alias("low"), F.sum("n").alias("n")).collect()}
    before, table = 0, []
    for part, (_, n) in sorted(sums.items(), key=lambda x: x[1][0]):
        table.append((part, before))
        before += n
    if not table:
        return rows.withColumn("block", F.lit(0).cast("long")), 0
    parts = rows.sparkSession.createDataFrame(table, "part int, start long")
    inside = F.sum("n").over(Window.partitionBy("part").orderBy("id")) - F.col("n")
    ids = ids.withColumn("inside", inside).join(F.broadcast(parts), "part").withColumn("before", F.col("start") + F.col("inside"))
    block = F.floor(F.col("before") / F.lit(block_bytes)).cast("long")
    marks = ids.groupBy(block.alias("block")).agg(
        F.min("id").alias("low"), F.max(F.when(F.col("n") > block_bytes, F.struct("id", "before"))).alias("big")).collect()
    marks.sort(key=lambda r: r.low)
    lows, numbers = np.array([r.low for r in marks], np.int64), np.array([r.block for r in marks], np.int64)

    @F.pandas_udf("long")
    def block_of(ids: pd.Series) -> pd.Series:
        return pd.Series(numbers[np.searchsorted(lows, ids.to_numpy(), side="right") - 1])

    # The sum of a big id passes a block's end, so it is the last of its block.
    big = [(r.big.id, r.big.before) for r in marks if r.big]
    if not big:
        return rows.withColumn("block", block_of("id")), before
    big = F.broadcast(rows.sparkSession.createDataFrame(big, "id long, before long"))
    own = F.sum(length).over(Window.partitionBy("id").orderBy("text").rowsBetween(Window.unboundedPreceding, 0)) - length
    cut = rows.join(big, "id").withColumn("block", F.floor((F.col("before") + own) / F.lit(block_bytes)).cast("long"))
    whole = rows.join(big, "id", "left_anti").withColumn("block", block_of("id"))
    return whole.select("id", "text", "block").union(cut.select("id", "text", "block")), before


def substring_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    width: int = 100, block_bytes: int = 1 << 21, with_text: bool = True) -> DataFrame:
    """``id, n_bytes, n_removed, n_spans, kept_sha256`` per document, and the ``kept`` bytes.

    A byte goes if some ``width``-byte string that covers it also starts earlier (in a smaller id,
    or before in the same text). Strings never cross texts; they are judged on the input.

    Texts are cut into blocks of consecutive ids, an id of more than ``block_bytes`` by its texts. (1) Blocks send the fingerprints of their
    difference-cover samples; each bucket of the key order is sorted by itself and marks the samples
    that several blocks share. (2) Only suffixes with a shared sample within a period, the long
    ties, are keyed by their first ``width`` bytes, each key once per block, and again sorted one
    bucket at a time; a key's first block keeps it. (3) Blocks remove what is marked. A string in a
    third of all rows is one key per block, and whole copies are found before by their hash and
    send nothing. A task holds one block or one bucket, whatever the input; a block ends with the id
    or, in a repeated id, the text that passes ``block_bytes``. All three steps read one
    shuffle of the texts; only packed keys and bit maps move besides.

    Null texts are empty. Rows without an id are left out. Rows that share an id are ordered by
    text; the later one counts as the later text. Texts shorter than ``width`` lose nothing.
    Keys are 64-bit fingerprints: n candidate strings clash with probability n^2 / 2^65.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id IS NOT NULL")
    placed, size = _with_blocks(rows, block_bytes)
    n = tasks(docs)
    buckets = max(n, -(-size // (4 * block_bytes)))
    # Samples only choose candidates, so a chance match costs work, not a byte: 13 bits beyond the
    # number of positions leave one in 8192.
    bits = min(64, max(32, int(size).bit_length() + 10))
    # Later copies of whole texts, by hash. One row per block and text: what repeats inside a block is
    # found there, so a text in a third of all rows is a row per block here.
    prints = placed.where(F.octet_length("text") >= width).select(
        "id", "block", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("h"))
    prints = prints.groupBy("h", "block").agg(F.min("id").alias("id"))
    first = prints.groupBy("h").agg(F.min("block").alias("first"), F.count("*").alias("n")).where("n > 1")
    copies = written(prints.join(first, "h").where("block > first").select("block", "id", "h"), "copies")
    based = placed.repartition(n, "block")
    columns = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][:6 if with_text else 5]
    schema = ", ".join(f"`{c}` {kind}" for c, kind in zip(columns, ("long", "long", "long", "long", "string", "binary")))

    # What a block gets back in any step: hash and id of copies (kind 0), bit maps (kinds 1 and 2).
    known = copies.select("block", F.lit(0).alias("kind"), F.lit(0).alias("bucket"),
                          F.concat("h", F.col("id").cast("string").cast("binary")).alias("bits"))

    def block_of(group: pd.DataFrame, back: pd.DataFrame) -> Block:
        found: dict[int, set[bytes]] = {}
        for b in back.loc[back["kind"] == 0, "bits"]:
            found.setdefault(int(b[32:]), set()).add(bytes(b[:32]))
        return Block(group, found, width)

    def shared_of(block: Block, back: pd.DataFrame) -> np.ndarray:
        at, prints = block.samples(bits)
        keys, inverse, counts = np.unique(prints, return_inverse=True, return_counts=True)
        return at[(_marked(keys, back, 1, buckets, bits) | (counts > 1))[inverse]]

    def send_samples(key, group: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"bucket": [], "block": [], "keys": []})
        return _send(key[0], distinct(block_of(group, back).samples(bits)[1]), buckets, bits)

    def send_candidates(key, group: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({"bucket": [], "block": [], "keys": []})
        block = block_of(group, back)
        return _send(key[0], distinct(block.candidates(shared_of(block, back))[1]), buckets, 64)

    def finish(key, group: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
        if not len(group):
            return pd.DataFrame({c: [] for c in columns})
        block = block_of(group, back)
        at, prints = block.candidates(shared_of(block, back))
        keys, place, inverse = np.unique(prints, return_index=True, return_inverse=True)
        earlier = _marked(keys, back, 2, buckets, 64)[inverse] | (place[inverse] != np.arange(len(at)))
        return block.result(at[earlier], id_col)[columns]

    def step(fn, back: DataFrame, out: str) -> DataFrame:
        return based.groupBy("block").cogroup(back.groupBy("block")).applyInPandas(fn, out)

    samples = step(send_samples, known, SENT).groupBy("bucket").applyInPandas(_sort_bucket(1, False), BACK)
    known = known.union(samples)
    ranked = step(send_candidates, known, SENT).groupBy("bucket").applyInPandas(_sort_bucket(2, True), BACK)
    return step(finish, known.union(ranked), schema)

"""SimHash near-duplicates: bit-sliced comparison of fingerprints that share a pigeonhole key."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.common import bounded_batches, fresh_worker, own_prefix, tasks, utf8, written
from cuemill.llm.components import components

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
BLOCKS, PARTS = 4, 4


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of all word shingles, as an unsigned integer.

    Words are runs without ASCII white space, A-Z lower-cased; a shorter text is one shingle, and a
    text without words has fingerprint 0.
    """
    words = utf8(text).lower().split()
    if not words:
        return 0
    digest, join = xxhash.xxh64_intdigest, b" ".join
    if len(words) <= shingle:
        return digest(join(words), 42)
    spans = zip(*[words[i:] for i in range(shingle)])
    hashes = np.array([digest(join(s), 42) for s in spans], dtype="<u8")
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 15):
        bits = hashes[at:at + (1 << 15)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def with_fingerprints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id`` and ``fp``, the fingerprint as a signed long."""
    bounded_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh_worker()
        for batch in batches:
            fps = np.array([fingerprint(t) for t in batch["text"]], dtype=np.uint64)
            yield pd.DataFrame({"id": batch["id"], "fp": fps.view(np.int64)})

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.where("id IS NOT NULL").mapInPandas(run, "id long, fp long")


def bit_planes(fps: np.ndarray) -> np.ndarray:
    """(64, words): bit k of 64 consecutive fingerprints in each word of plane k."""
    padded = np.zeros(-(-len(fps) // 64) * 64, "<u8")
    padded[:len(fps)] = fps
    bits = np.unpackbits(padded.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little").view("<u8")


def _pairs(planes: np.ndarray, fps: np.ndarray, query: np.ndarray, word: np.ndarray,
           valid: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Lanes within the radius among (query, word) pairs whose lanes ``valid`` are to be compared.

    The distances of a word's 64 lanes are counted together: each plane's differing bits are added
    by carries into a few counter planes, preset so that radius + 1 overflows. Words all of whose
    lanes have overflowed are abandoned after every eighth plane.
    """
    depth = max(1, radius.bit_length())
    start = (1 << depth) - 1 - radius
    counter = [np.full(len(query), ALL if start >> k & 1 else 0, np.uint64) for k in range(depth)]
    over = ~valid
    for k in range(64):
        mask = (fps[query] >> np.uint64(k) & np.uint64(1)) * ALL
        carry = planes[k][word] ^ mask
        for c in counter:
            up = c & carry
            c ^= carry
            carry = up
        over |= carry
        if k % 8 == 7:
            alive = np.flatnonzero(over != ALL)
            if len(alive) < len(over):
                query, word, over = query[alive], word[alive], over[alive]
                counter = [c[alive] for c in counter]
    lanes = np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, lane = np.nonzero(lanes)
    return query[row], word[row] * 64 + lane


def _join(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins the classes of a and b; labels point to the smallest member."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            jumped = label[label]
            if (jumped == label).all():
                break
            label[:] = jumped


def linked(keys: np.ndarray, fps: np.ndarray, radius: int = 3, chunk: int = 1 << 17) -> tuple:
    """Positions (member, first member of its class) for fingerprints linked under an equal key."""
    order = np.argsort(keys, kind="stable")
    keys, fps = keys[order], fps[order]
    n = len(keys)
    last = np.append(np.flatnonzero(keys[1:] != keys[:-1]) + 1, n)
    end = np.repeat(last, np.diff(np.concatenate([[0], last])))  # of each one's run
    index = np.arange(n)
    query = index[end - index > 1]  # compared with the later members of its run
    planes, label = bit_planes(fps), np.arange(n)
    first, stop = (query + 1) // 64, (end[query] - 1) // 64 + 1
    sizes = np.cumsum(stop - first)
    at = 0
    while at < len(query):
        upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + chunk)))
        part = slice(at, upto)
        span = (stop - first)[part]
        q = np.repeat(query[part], span)
        w = np.arange(span.sum()) - np.repeat(np.cumsum(span) - span, span) + np.repeat(first[part], span)
        low = np.clip(q + 1 - w * 64, 0, 63).astype(np.uint64)
        high = np.clip(w * 64 + 64 - end[q], 0, 63).astype(np.uint64)
        valid = (ALL << low) & (ALL >> high)
        _join(label, *_pairs(planes, fps, q, w, valid, radius))
        at = upto
    moved = np.flatnonzero(label != index)
    return order[moved], order[label[moved]]


def fingerprint_links(classes: DataFrame, radius: int = 3) -> DataFrame:
    """Links ``a, b`` between the ``node`` ids of distinct fingerprints ``fp`` that join all classes.

    Two fingerprints with at most 3 differing bits agree in one of 4 blocks of 16 bits, and in one
    of 4 parts of the other 48; so they meet under one of 16 keys of 28 bits. Keys are dealt to
    groups of bounded mean size; under a key only equal-key runs are compared, bit-sliced, and a
    spanning forest leaves the group, never all pairs.
    """
    if radius > 3:
        raise ValueError("the keys are complete up to 3 differing bits")
    fp, keys = F.col("fp"), []
    for b in range(BLOCKS):
        block = F.shiftrightunsigned(fp, 16 * b).bitwiseAND(F.lit(0xFFFF))
        rest = fp.bitwiseAND(F.lit((1 << 16 * b) - 1))
        if b < BLOCKS - 1:
            rest = rest.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, 16 * (b + 1)), 16 * b))
        for p in range(PARTS):
            part = F.shiftrightunsigned(rest, 12 * p).bitwiseAND(F.lit(0xFFF))
            keys.append(F.lit((b * PARTS + p) << 28) + F.shiftleft(block, 12) + part)
    groups = max(tasks(classes), -(-classes.count() * BLOCKS * PARTS // 30_000))
    rows = classes.select("fp", "node", F.explode(F.array(*keys)).alias("key"))
    rows = rows.withColumn("g", F.pmod(F.xxhash64("key"), F.lit(groups)).cast("int"))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        a, b = linked(group["key"].to_numpy(), group["fp"].to_numpy().view(np.uint64), radius)
        nodes = group["node"].to_numpy()
        return pd.DataFrame({"a": nodes[a], "b": nodes[b]})

    return rows.groupBy("g").applyInPandas(run, "a long, b long").distinct()


def simhash_components(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       radius: int = 3) -> DataFrame:
    """``id, fingerprint, component_id`` per document; fingerprints link within ``radius`` bits.

    Copies collapse to one fingerprint before anything is compared, so a group of copies is one
    node. ``component_id`` is the smallest id that links reach. Null, empty and wordless texts have
    fingerprint 0, which links like any other. Rows without an id are left out; rows that share an
    id each count with their own text.
    """
    prints = written(with_fingerprints(docs, id_col, text_col), "prints")
    classes = written(prints.groupBy("fp").agg(F.min("id").alias("first_id")), "classes")
    roots = components(fingerprint_links(classes.select("fp", F.col("fp").alias("node")), radius))
    named = written(classes.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root")), "named")
    least = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    found = prints.join(named.join(least, "root").select("fp", "component_id"), "fp")
    return found.select(F.col("id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
                        "component_id")


def simhash_dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  radius: int = 3) -> DataFrame:
    """One document of each component: the row with the smallest id (of rows that share it, the
    one with the smallest text). Rows without an id are left out; columns of any name are kept."""
    p = own_prefix(docs)
    narrow = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kept = simhash_components(narrow, id_col="id", radius=radius).where(
        "component_id = id").select(F.col("id").alias(f"{p}id")).distinct()
    one = Window.partitionBy(id_col).orderBy(text_col)
    return (docs.join(kept, F.col(id_col) == F.col(f"{p}id")).withColumn(f"{p}n", F.row_number().over(one))
            .where(F.col(f"{p}n") == 1).select(*[F.col(f"`{c}`") for c in docs.columns]))

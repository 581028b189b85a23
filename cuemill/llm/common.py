"""Helpers shared by the corpus operators."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.session import scratch_path, ship_package

#: Rows per Arrow batch, so that a batch of long texts stays within a Python worker's memory.
BATCH_ROWS = 1024
#: ASCII white space, and everything else: a word.
WORD = r"[^\x20\x09-\x0D]+"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows from here on in this session, and workers that can
    import this package."""
    ship_package(spark)
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch"))
    if now <= 0 or now > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


#: What operators keep in a Python worker between tasks: functions that let go of it.
KEPT: list[Callable[[], None]] = []


def fresh_worker(own: Callable[[], None] | None = None) -> None:
    """Called first by an operator's worker function: Spark reuses workers, and an executor's memory
    must not hold what the operator before has kept there. What ``own`` lets go of stays."""
    for release in KEPT:
        if release != own:
            release()
    gc.collect()
    try:
        # Freed memory goes back to the system; elsewhere than with glibc it stays with the worker.
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared scratch folder: cuts the lineage, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text) -> "F.Column":
    """Words of a text column, as a long; 0 for null."""
    return F.coalesce(F.regexp_count(F.col(text) if isinstance(text, str) else text, F.lit(WORD)),
                      F.lit(0)).cast("long")


def own_prefix(df: DataFrame) -> str:
    """The shortest run of underscores that begins no column of ``df``: helper columns start with it."""
    prefix = "_"
    while any(c.startswith(prefix) for c in df.columns):
        prefix += "_"
    return prefix


def own_name(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores behind it as no column of ``df`` bears it, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def tasks(df: DataFrame) -> int:
    """The session's number of shuffle partitions."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values, by sorting."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values


def pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending uint64 keys as a first key and gaps of a fixed width of bytes, the one that takes
    the least space; the highest value of that width only moves on, for wider gaps."""
    if not len(keys):
        return b""
    gaps = np.diff(keys, prepend=keys[:1]).astype(np.uint64)
    best = None
    for width in range(1, 8):
        most = np.uint64((1 << 8 * width) - 1)
        if float(gaps.max()) / float(most) > len(gaps):
            continue
        more = gaps // most
        size = width * (len(gaps) + int(more.sum()))
        if best is None or size < best[0]:
            best = (size, width, more)
        if not more.any():
            break
    if best is None or best[0] > 8 * len(gaps):
        width, values = 8, gaps
    else:
        _, width, more = best
        most = np.uint64((1 << 8 * width) - 1)
        values = np.full(len(gaps) + int(more.sum()), most)
        values[np.cumsum(more + np.uint64(1)).astype(np.int64) - 1] = gaps - more * most
    body = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return np.uint64(keys[0]).tobytes() + bytes([width]) + body.tobytes()


def unpack_sorted(blob: bytes) -> np.ndarray:
    if not blob:
        return np.zeros(0, np.uint64)
    width = blob[8]
    body = np.frombuffer(blob, np.uint8, offset=9).reshape(-1, width)
    wide = np.zeros((len(body), 8), np.uint8)
    wide[:, :width] = body
    values = wide.view("<u8").ravel()
    keys = np.frombuffer(blob[:8], "<u8")[0] + np.cumsum(values, dtype=np.uint64)
    return keys if width == 8 else keys[values != np.uint64((1 << 8 * width) - 1)]

"""Article feeds as streams. The columns are the batch ones, so both give the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.types import BinaryType, DataType, DoubleType, FloatType, LongType, StructField, StructType

from cuemill.functions.labels import keyword_query
from cuemill.functions.text import article_text
from cuemill.lexicons import RelevanceLexicon
from cuemill.operators.ranking import score_articles
from cuemill.session import ship_package


def read_feed(
    spark: SparkSession, path: str, schema: StructType | str, kind: str = "json",
    files_per_batch: int = 100,
) -> DataFrame:
    """New files of a folder as a stream; ``files_per_batch`` bounds each batch."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
            .format(kind).load(path))


def write_feed(
    df: DataFrame, sink: str, checkpoint: str, available_now: bool = True, kind: str = "parquet",
    every: str = "1 minute",
) -> StreamingQuery:
    """Appends to a file sink, exactly once over restarts from ``checkpoint``.

    ``available_now`` handles what has arrived and stops; otherwise a batch starts every interval.
    """
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return (df.writeStream.format(kind).outputMode("append").trigger(**trigger)
            .option("checkpointLocation", checkpoint).start(sink))


def write_feed_run(
    feed: DataFrame, score: Callable[[DataFrame], DataFrame], path: str, checkpoint: str,
    available_now: bool = True, every: str = "1 minute",
) -> StreamingQuery:
    """Each poll of the feed, as it came and scored, below ``path/raw`` and ``path/filtered``.

    One query reads a batch once: it writes the raw copy, and scores that copy. Both go to a folder of the
    batch's number and overwrite it, so a batch that failed anywhere in between is written again
    whole, without loss or repeat, and the two copies cannot drift apart.
    """

    def write(batch: DataFrame, number: int) -> None:
        folder = lambda kind: f"{path}/{kind}/batch={number}"
        batch.write.mode("overwrite").parquet(folder("raw"))
        raw = batch.sparkSession.read.schema(batch.schema).parquet(folder("raw"))
        score(raw).write.mode("overwrite").parquet(folder("filtered"))

    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return feed.writeStream.foreachBatch(write).trigger(**trigger).option("checkpointLocation", checkpoint).start()


def read_feed_run(spark: SparkSession, path: str, kind: str, schema: StructType) -> DataFrame:
    """The copies of all polls so far, ``kind`` being raw or filtered, with their ``batch``."""
    return spark.read.schema(StructType([*schema.fields, StructField("batch", LongType())])).parquet(f"{path}/{kind}")


def stream_relevance(
    feed: DataFrame, lexicon: RelevanceLexicon = RelevanceLexicon(), min_score: int | None = 3,
    lang: str | None = None, any_of: Sequence[str] = (), none_of: Sequence[str] = (),
) -> DataFrame:
    """Articles of the query and language that reach ``min_score``. Stateless."""
    if lang:
        feed = feed.filter(F.col("lang") == lang)
    if any_of:
        feed = feed.filter(keyword_query(article_text("title", "description"), any_of, none_of))
    return score_articles(feed, lexicon, min_score=min_score)


def stream_dedup(
    feed: DataFrame, keys: Sequence[str], ts: str = "publishedAt", delay: str = "7 days"
) -> DataFrame:
    """Drops repeats of a key that come within ``delay`` of each other.

    State is one row per key seen in that time, spread over the state partitions by key; on large
    feeds use the RocksDB state store, which keeps it off the heap. All repeats of a key that come in
    one batch meet in one task, so bound the batch (``files_per_batch``).
    """
    stamped = feed.withColumn(ts, F.col(ts).cast("timestamp"))
    return stamped.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def run_to_end(
    feed: DataFrame, sink: str, checkpoint: str, timeout: float | None = None,
    write: Callable[..., StreamingQuery] = write_feed,
) -> DataFrame:
    """Runs a stream over what has arrived and returns the sink as a table; ``timeout`` (seconds) is
    for callers that would rather have an error than wait."""
    query = write(feed, sink, checkpoint)
    try:
        if timeout is None:
            query.awaitTermination()
        elif not query.awaitTermination(timeout):
            raise TimeoutError(f"stream into {sink} did not end within {timeout} s")
    finally:
        if query.isActive:
            query.stop()
    return feed.sparkSession.read.schema(feed.schema).parquet(sink)


class FirstVersions(StatefulProcessor):
    """Per key the version of earliest event time, given out when its time to live is over.

    The key's first row opens a window of ``delay`` behind its event time. Rows of the window replace the kept
    version if they are earlier (of equal ones, the smaller content). When the watermark passes the window's
    end, the version goes out and the key is forgotten.

    The state holds a group of keys as one Arrow table, ``id`` telling them apart, with one timer at the earliest
    end: a batch reads and writes a group once, not each of its keys.
    """

    def __init__(self, schema: StructType, ts: str, delay_ms: int, id: str):
        self._schema, self._ts, self._delay, self._id, self._closes = schema, ts, delay_ms, id, f"{id}_closes"

    def init(self, handle) -> None:
        self._handle = handle
        self._open = handle.getValueState("open", "versions binary, timer long")
        self._arrow = to_arrow_schema(self._schema).append(
            pa.field(self._id, pa.string())).append(pa.field(self._closes, pa.int64()))

    def _load(self) -> tuple[pd.DataFrame | None, int | None]:
        if not self._open.exists():
            return None, None
        blob, timer = self._open.get()
        found = pa.ipc.open_stream(bytes(blob)).read_all().to_pandas()
        # Times as the session's, which are UTC, without a zone: like those of the rows.
        zoned = {c: found[c].dt.tz_localize(None) for c in found.columns if isinstance(found[c].dtype, pd.DatetimeTZDtype)}
        return found.assign(**zoned), timer

    def _store(self, versions: pd.DataFrame, timer: int | None) -> None:
        """Keeps the group, its timer moved to the earliest end."""
        first = int(versions[self._closes].min()) if len(versions) else None
        if timer is not None and timer != first:
            self._handle.deleteTimer(timer)
        if first is None:
            self._open.clear()
            return
        if timer != first:
            self._handle.registerTimer(first)
        out = pa.BufferOutputStream()
        with pa.ipc.new_stream(out, self._arrow) as writer:
            writer.write_table(pa.Table.from_arrays(
                [pa.Array.from_pandas(versions[f.name], type=f.type) for f in self._arrow], schema=self._arrow))
        self._open.update((out.getvalue().to_pybytes(), first))

    def _earliest(self, rows: pd.DataFrame) -> pd.DataFrame:
        """One row per key."""
        if rows[self._ts].isna().any():
            raise ValueError(f"{self._ts} must not be null")
        rows = rows[rows[self._ts] == rows.groupby(self._id)[self._ts].transform("min")]
        if not rows[self._id].duplicated().any():
            return rows
        # Equal times: by content, of these rows only.
        again = rows[self._id].duplicated(keep=False)
        tied = rows[again]
        part = tied[self._schema.names].astype(object)
        texts = [repr(tuple(v.to_pydatetime() if isinstance(v, pd.Timestamp) else v for v in row))
                 for row in part.where(part.notna(), None).itertuples(index=False, name=None)]
        order = pd.Series(texts, index=tied.index).sort_values(kind="stable").index
        return pd.concat([rows[~again], tied.loc[order].drop_duplicates(self._id)])

    def handleInputRows(self, key, rows, timerValues):
        kept, timer = self._load()
        best = None
        for batch in rows:
            part = batch[[*self._schema.names, self._id]]
            best = self._earliest(part if best is None else pd.concat([best, part], ignore_index=True)).reset_index(drop=True)
        if kept is not None:
            ends = kept.set_index(self._id)[self._closes]
            # Groups without new rows of a key keep its version as it is.
            best = self._earliest(pd.concat([kept.drop(columns=self._closes), best], ignore_index=True))
            closes = best[self._id].map(ends)
        else:
            closes = pd.Series(np.nan, index=best.index)
        own = (best[self._ts] - pd.Timestamp(0)) // pd.Timedelta(milliseconds=1) + self._delay
        # A new key's window; ends are whole milliseconds, which doubles hold exactly.
        self._store(best.assign(**{self._closes: closes.where(closes.notna(), own).astype("int64")}), timer)
        yield pd.DataFrame(columns=self._schema.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        kept, _ = self._load()
        at = expiredTimerInfo.getExpiryTimeInMs()
        # A timer expires when the watermark is behind it.
        due = (kept[self._closes] <= at) | (kept[self._closes] < timerValues.getCurrentWatermarkInMs())
        self._store(kept[~due], None)
        yield kept.loc[due, self._schema.names]

    def close(self) -> None:
        pass


def _key_text(name: str, kind: DataType) -> Column:
    """A key as text that no other value of its column has, null included."""
    value = F.col(name)
    if isinstance(kind, (FloatType, DoubleType)):
        value = value + F.lit(0.0)  # the two zeros are one key
    text = F.hex(value) if isinstance(kind, BinaryType) else value.cast("string")
    return F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def stream_first_versions(
    feed: DataFrame, keys: Sequence[str], ts: str = "publishedAt", delay: str = "7 days", delay_ms: int = 7 * 86_400_000,
    groups: int = 256,
) -> DataFrame:
    """The earliest version of every key, once its window of ``delay`` has passed the watermark.

    State is one row per open key, on disk in the RocksDB store, dropped when its window is over. The keys are dealt
    to ``groups`` by hash; a task holds one group's open keys at a time, so let the number grow with them (some
    100 000 keys a group); a checkpoint keeps the number it began with. Rows behind the watermark are left out; the
    query's progress counts them (:func:`late_rows`). Event times are taken as UTC, as the session's should be, and
    must not be null.
    """
    if "RocksDB" not in feed.sparkSession.conf.get("spark.sql.streaming.stateStore.providerClass", ""):
        feed.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass",
                                   "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    ship_package(feed.sparkSession)
    stamped = feed.withColumn(ts, F.col(ts).cast("timestamp"))
    # Spark's workers rename columns that begin with an underscore.
    id, group = "key_id", "key_group"
    while any(c.lower().startswith((id, group)) for c in stamped.columns):
        id, group = f"{id}_", f"{group}_"
    # Workers turn a column of longs with nulls into doubles, so longs travel as text.
    longs = [f.name for f in stamped.schema if isinstance(f.dataType, LongType)]
    carried = stamped.withColumns({c: F.col(c).cast("string") for c in longs})
    rows = carried.withColumn(id, F.concat(*[_key_text(k, stamped.schema[k].dataType) for k in keys]))
    rows = rows.withColumn(group, F.pmod(F.xxhash64(id), F.lit(groups)).cast("int"))
    out = rows.withWatermark(ts, delay).groupBy(group).transformWithStateInPandas(
        FirstVersions(carried.schema, ts, delay_ms, id), carried.schema, "Append", "EventTime")
    return out.withColumns({c: F.col(c).cast("long") for c in longs})


def late_rows(query: StreamingQuery) -> list[tuple[int, int]]:
    """``(batch, rows)`` that came behind the watermark and were left out, of the batches that a query still reports."""
    return [(p["batchId"], sum(o["numRowsDroppedByWatermark"] for o in p["stateOperators"])) for p in query.recentProgress]

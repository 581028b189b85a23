import datetime

import pytest
from pyspark.errors import StreamingQueryException

from cuemill.functions.labels import relevance_score
from cuemill.session import scratch_path
from cuemill.sources.schemas import ARTICLES
from cuemill.streaming.feeds import (
    late_rows,
    read_feed,
    read_feed_run,
    run_to_end,
    stream_dedup,
    stream_first_versions,
    stream_relevance,
    write_feed,
    write_feed_run,
)


def day(n, hour=0):
    return datetime.datetime(2024, 1, n, hour)


ROWS = [("u1", "Stocks rally on earnings", "S&P 500 up", day(1)), ("u2", "Rain", "all day", day(1)),
        ("u3", "Gift guide", "stock", day(2)), ("u4", None, "market and bond", day(3))]


def test_stream_equals_batch_and_resumes(spark):
    feed, sink, checkpoint = (scratch_path(spark, n) for n in ("feed", "sink", "checkpoint"))
    spark.createDataFrame(ROWS[:2], ARTICLES).write.json(feed)
    rows = stream_relevance(read_feed(spark, feed, ARTICLES, files_per_batch=1))
    first = run_to_end(rows, sink, checkpoint)
    assert {r["url"] for r in first.collect()} == {"u1"}
    # A later run from the same checkpoint reads only what is new.
    spark.createDataFrame(ROWS[2:], ARTICLES).write.mode("append").json(feed)
    second = run_to_end(rows, sink, checkpoint)
    batch = spark.createDataFrame(ROWS, ARTICLES)
    batch = batch.withColumn("relevance_score", relevance_score("title", "description"))
    wanted = {(r["url"], r["relevance_score"]) for r in batch.filter("relevance_score >= 3").collect()}
    found = [(r["url"], r["relevance_score"]) for r in second.collect()]
    assert sorted(found) == sorted(wanted) and len(wanted) == 2


def test_stream_filters(spark):
    feed = scratch_path(spark, "feed")
    schema = "url string, title string, description string, lang string"
    spark.createDataFrame([("a", "Shares up", "x", "en"), ("b", "Shares up", "x", "de"),
                           ("c", "Shares up", "a deal", "en"), ("d", "Bond", "x", "en")],
                          schema).write.json(feed)
    rows = stream_relevance(read_feed(spark, feed, schema), min_score=None, lang="en",
                            any_of=["shares"], none_of=["deal"])
    out = run_to_end(rows, scratch_path(spark, "sink"), scratch_path(spark, "checkpoint"))
    assert [r["url"] for r in out.collect()] == ["a"]


def test_repeats_of_overlapping_polls_are_dropped(spark):
    feed = scratch_path(spark, "feed")
    sink, checkpoint = scratch_path(spark, "sink"), scratch_path(spark, "checkpoint")
    spark.createDataFrame([("u1", "t", "d", day(1)), ("u1", "t", "d", day(1))], ARTICLES).write.json(feed)
    source = read_feed(spark, feed, ARTICLES)
    rows = stream_dedup(source, ["url"], delay="7 days")
    assert run_to_end(rows, sink, checkpoint).count() == 1
    # The second poll overlaps the first one.
    spark.createDataFrame([("u1", "t", "d", day(1)), ("u2", "t", "d", day(4))],
                          ARTICLES).write.mode("append").json(feed)
    out = run_to_end(rows, sink, checkpoint)
    assert sorted(r["url"] for r in out.collect()) == ["u1", "u2"]


def test_running_query_can_be_stopped(spark):
    feed = scratch_path(spark, "feed")
    spark.createDataFrame(ROWS, ARTICLES).write.json(feed)
    query = write_feed(stream_relevance(read_feed(spark, feed, ARTICLES)), scratch_path(spark, "sink"),
                       scratch_path(spark, "checkpoint"), available_now=False, every="1 second")
    query.processAllAvailable()
    query.stop()
    assert not query.isActive


def test_a_key_expires(spark):
    feed, sink, checkpoint = (scratch_path(spark, n) for n in ("feed", "sink", "checkpoint"))
    spark.createDataFrame([], ARTICLES).write.json(feed)
    rows = stream_dedup(read_feed(spark, feed, ARTICLES), ["url"], delay="7 days")
    for url, n in (("u1", 1), ("u2", 20), ("u3", 21), ("u1", 22), ("u3", 23)):
        spark.createDataFrame([(url, "t", "d", day(n))], ARTICLES).write.mode("append").json(feed)
        out = run_to_end(rows, sink, checkpoint)
    # The watermark has passed u1's week, not u3's.
    assert sorted(r["url"] for r in out.collect()) == ["u1", "u1", "u2", "u3"]


def test_raw_copy_beside_the_filtered_feed(spark):
    """A poll that fails between its two copies is written again whole."""
    feed, out, checkpoint = (scratch_path(spark, n) for n in ("feed", "run", "checkpoint"))
    for row in ROWS:
        spark.createDataFrame([row], ARTICLES).coalesce(1).write.mode("append").json(feed)
    failing = {2}

    def score(batch):
        if failing and batch.filter("url = 'u3'").count():
            failing.clear()
            raise RuntimeError("lost between the copies")
        return stream_relevance(batch)

    source = read_feed(spark, feed, ARTICLES, files_per_batch=1)
    with pytest.raises(StreamingQueryException, match="between the copies"):
        write_feed_run(source, score, out, checkpoint).awaitTermination()
    write_feed_run(source, score, out, checkpoint).awaitTermination()
    raw = read_feed_run(spark, out, "raw", ARTICLES)
    assert sorted(r["url"] for r in raw.collect()) == ["u1", "u2", "u3", "u4"]
    assert raw.select("batch").distinct().count() == 4
    kept = read_feed_run(spark, out, "filtered", stream_relevance(spark.createDataFrame(ROWS, ARTICLES)).schema)
    assert sorted(r["url"] for r in kept.collect()) == ["u1", "u4"]


def test_first_versions_expire_and_late_rows_are_counted(spark):
    feed, sink, checkpoint = (scratch_path(spark, n) for n in ("feed", "sink", "checkpoint"))
    spark.createDataFrame([], ARTICLES).write.json(feed)
    rows = stream_first_versions(read_feed(spark, feed, ARTICLES, files_per_batch=1), ["url"])
    late = 0
    polls = [[("u1", "b", None, day(2)), ("u1", "a", None, day(2)), ("u2", "x", "d", day(3))], [("u1", "older", "d", day(1))],
             [("u3", "x", "d", day(12))], [("u1", "behind", "d", day(4)), ("u1", "new", "d", day(13))], [("u3", "y", "d", day(25))]]
    for poll in polls:
        spark.createDataFrame(poll, ARTICLES).coalesce(1).write.mode("append").json(feed)
        query = write_feed(rows, sink, checkpoint)
        query.awaitTermination()
        late += sum(n for _, n in late_rows(query))
    found = spark.read.schema(ARTICLES).parquet(sink).collect()
    # The watermark went to day 5, then 6, then 18; u1's first window took the earlier version of the second poll.
    assert sorted((r["url"], r["title"]) for r in found) == [("u1", "older"), ("u2", "x")]
    assert late == 1


def test_first_versions_keep_groups_of_keys(spark):
    """The state holds groups, not keys, and tells keys apart that share a group, null and long ones too."""
    schema = "key long, part string, content string, ts timestamp"
    feed, sink, checkpoint = (scratch_path(spark, n) for n in ("feed", "sink", "checkpoint"))
    spark.createDataFrame([], schema).write.parquet(feed)
    rows = stream_first_versions(read_feed(spark, feed, schema, "parquet"), ["key", "part"], "ts", "7 days", groups=3)
    keys = [(2**53 + i, str(i % 3)) for i in range(200)] + [(None, "a"), (None, None), (1, None), (1, "1"), (11, "")]
    first = [(*k, c, day(2, n % 5)) for n, k in enumerate(keys) for c in ("b", "a")] + [(*k, "late", day(3)) for k in keys]
    ends = [(7, "x", "end", day(d)) for d in (20, 28)]
    held = 0
    for poll in (first, [(*keys[0], "older", day(1)), (*keys[1], "c", day(2, 1))], ends[:1], ends[1:]):
        spark.createDataFrame(poll, schema).write.mode("append").parquet(feed)
        query = write_feed(rows, sink, checkpoint)
        query.awaitTermination()
        held = max(held, *[o["numRowsTotal"] for p in query.recentProgress for o in p["stateOperators"]])
    found = spark.read.schema(schema).parquet(sink).collect()
    want = {k: (*k, "a", day(2, n % 5)) for n, k in enumerate(keys)} | {keys[0]: (*keys[0], "older", day(1))}
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want.values()))
    assert held <= 3

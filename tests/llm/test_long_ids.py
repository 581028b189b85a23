"""Ids above 2**53 beside a null in the same batch, and scores of large components."""

from cuemill.llm.decontaminate import benchmark_matches
from cuemill.llm.langid import language_id
from cuemill.llm.licenses import license_scan
from cuemill.llm.topk import exact_topk

IDS = [2**60 + 1, 2**60 + 3, None]


def test_ids_stay_exact_beside_nulls(spark):
    text = "released under the mit license by all the people who wrote these many words of plain prose"
    docs = spark.createDataFrame([(i, text, "en") for i in IDS], "doc_id long, text string, lang string").coalesce(1)
    for found in (language_id(docs), license_scan(docs)):
        assert {r.doc_id for r in found.collect()} == set(IDS)
    items = spark.createDataFrame([(i, text) for i in IDS], "item_id long, text string").coalesce(1)
    found = benchmark_matches(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(a, b) for a in IDS for b in IDS}


def test_scores_of_large_components(spark):
    from pyspark.sql import functions as F

    rows = [(0, [2e9, 1.0]), (1, [3e9, 5.0]), (2, [-4e9, 7.0]), (3, [4e9, 3.0])]
    found = exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, scale=1.0).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [
        (3, 8 * 10**18 + 3), (1, 6 * 10**18 + 5), (2, -8 * 10**18 + 7)]
    rows = [(0, [1.2e7, 1.0]), (1, [1e9 + 1, 9.0]), (2, [1e9 + 1, 8.0])]
    found = exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") == 0, scale=1.0).collect()
    assert [(r.vec_id, r.score) for r in sorted(found, key=lambda r: r.rank)] == [
        (1, 12_000_000 * (10**9 + 1) + 9), (2, 12_000_000 * (10**9 + 1) + 8)]

import random

import pytest
from pyspark.sql import functions as F

from cuemill.operators import counting
from cuemill.operators.counting import StepCounts
from cuemill.operators.membership import bloom_filter, drop_denied_large, filter_bits, might_hold
from cuemill.operators.sampling import quotas, running_total
from cuemill.plans.curation import label_external_news, merge_corpora


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


@pytest.mark.parametrize("again", [False, True])
def test_steps_are_counted_by_the_writing_job(spark, tmp_path, monkeypatch, again):
    monkeypatch.setattr(counting, "_ran_again", lambda *_: again) if again else None
    base = spark.createDataFrame([("a", 1, 0), ("a", 2, 0), ("b", 3, 0)], "sentence string, doc_id int, pos int")
    base.write.parquet(f"{tmp_path}/base")
    base = spark.read.parquet(f"{tmp_path}/base")
    other = spark.createDataFrame([("b", 1, 0), ("c", 2, 0), (None, 3, 1)], base.schema)
    counts = StepCounts()
    merged = merge_corpora(base, other, counts=counts)
    assert scans(merged) == 1
    got = counts.write(merged, f"{tmp_path}/merged")
    assert [tuple(r) for r in got.collect()] == [("base", 3), ("external", 3), ("merged", 4)]
    assert spark.read.parquet(f"{tmp_path}/merged").count() == 4


def test_news_steps_and_empty_table(spark, tmp_path):
    rows = [("may be a long sentence",)] * 3 + [("short",), (None,)]
    for i, (table, want) in enumerate(((rows, [5, 3, 1]), ([], [0, 0, 0]))):
        counts = StepCounts()
        news = label_external_news(spark.createDataFrame(table, "text string"), counts=counts)
        got = counts.write(news, f"{tmp_path}/{i}").collect()
        assert [r.step for r in got] == ["raw", "distinct", "kept"] and [r.n for r in got] == want


def test_filter_misses_no_key_and_clears_most_others(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), "id").alias("k"))
    bits = filter_bits(5000)
    found = spark.range(10000).select(F.concat(F.lit("k"), "id").alias("k"), "id").select(
        "id", might_hold(bloom_filter(keys, "k", bits), F.col("k"), bits).alias("hit"))
    rows = found.collect()
    assert all(r.hit for r in rows if r.id < 5000)
    assert sum(r.hit for r in rows if r.id >= 5000) < 250
    assert bits == 65536 and filter_bits(0) == 64


@pytest.mark.parametrize("max_bytes", [8 << 20, 0])
def test_large_deny_list_equals_the_plain_anti_join(spark, max_bytes):
    rng = random.Random(3)
    texts = [None, "", "É", *[f"t{rng.randrange(400)}" for _ in range(1500)], *["hot"] * 800]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sentence string")
    for denied in ([], [None], ["hot", "", None, "hot", *[f"t{i}" for i in range(0, 400, 3)]]):
        deny = spark.createDataFrame([(d,) for d in denied], "sentence string")
        got = {r.i for r in drop_denied_large(df, deny, max_bytes=max_bytes).collect()}
        assert got == {i for i, t in enumerate(texts) if t is None or t not in denied}


def test_running_totals_and_quotas_of_many_classes(spark):
    n = {f"c{i:05d}": random.Random(i).randrange(1, 9) for i in range(3000)}
    counts = spark.createDataFrame(list(n.items()), "label string, n long")
    plan = running_total(counts, [F.col("label")], F.col("n"), "before")
    total = 0
    for r in sorted(plan.collect()):
        assert r.before == total
        total += r.n
    draws = total // 3
    got = {r.label: r.take for r in quotas(counts, "label", "n", "take", draws).collect()}
    left = draws - sum(c * draws // total for c in n.values())
    up = set(sorted(n, key=lambda x: (-(n[x] * draws % total), x))[:left])
    assert got == {x: c * draws // total + (x in up) for x, c in n.items()}
    assert running_total(counts.limit(0), [F.col("label")], F.col("n"), "before").count() == 0

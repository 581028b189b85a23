import hashlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuemill.operators import sampling
from cuemill.operators.joins import fold_rows, fold_rows_by_index
from cuemill.operators.ranking import latest, limit_in_order, rank_articles, top_k
from cuemill.operators.sampling import (
    add_gold,
    fold_index,
    fold_index_table,
    hash_split,
    head_per_class,
    quotas,
    sample_per_class,
    shuffle,
    split_quotas,
    stratified_kfold,
    stratified_split,
    three_way_split,
)
from cuemill.plans.training import build_annotation_set, prepare_training_set


def place(key, seed=42):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest(), key


@pytest.fixture(scope="module")
def labelled(spark):
    """81 rows, 56 and 25, like a small gold set."""
    rows = [(f"S{i}", int(i % 81 < 25)) for i in range(81)]
    return spark.createDataFrame(rows, "id string, label int").repartition(5)


def ranked(df):
    by_class = {}
    for r in df.collect():
        by_class.setdefault(r["label"], []).append(r["id"])
    return {c: sorted(ids, key=place) for c, ids in by_class.items()}


def test_quotas(spark):
    def counts(rows):
        return spark.createDataFrame(list(rows.items()), "c int, n long")

    def shared(rows, draws):
        return {r["c"]: r["q"] for r in quotas(counts(rows), "c", "n", "q", draws).collect()}

    assert shared({0: 56, 1: 25}, 64) == {0: 44, 1: 20}
    assert shared({0: 3, 1: 3, 2: 3}, 4) == {0: 2, 1: 1, 2: 1}
    assert shared({}, 0) == {} and shared({0: 0}, 0) == {0: 0}
    large = {i: 10 ** 12 + i for i in range(5)}
    assert sum(shared(large, 3 * 10 ** 12 + 1).values()) == 3 * 10 ** 12 + 1
    ends = split_quotas(counts({0: 35_000, 1: 12_632}), "c", [0.2, 0.5]).collect()
    assert (sum(r["end_0"] for r in ends), sum(r["end_1"] for r in ends)) == (38_105, 38_105 + 4_763)


def test_split_sizes_and_members(labelled):
    out = stratified_split(labelled, "label", names=("dev", "test"))
    assert Counter((r["split"], r["label"]) for r in out.collect()) == {
        ("dev", 0): 44, ("dev", 1): 20, ("test", 0): 12, ("test", 1): 5}
    order = ranked(labelled)
    assert {r["id"] for r in out.filter("split = 'dev'").collect()} == {*order[0][:44], *order[1][:20]}


def test_splits_do_not_depend_on_the_layout(labelled):
    def members(df):
        return {(r["id"], r["split"]) for r in three_way_split(df, "label").collect()}

    whole = members(labelled)
    assert len(whole) == 81 and Counter(s for _, s in whole) == {"train": 64, "val": 8, "test": 9}
    assert members(labelled.coalesce(1)) == whole == members(labelled.orderBy("id"))
    assert {(r["id"], r["split"]) for r in three_way_split(labelled, "label", seed=7).collect()} != whole


def test_split_with_few_rows_and_null_labels(spark):
    df = spark.createDataFrame([("a", 1)], "id string, label int")
    assert [r["split"] for r in stratified_split(df, "label").collect()] == ["test"]
    assert stratified_split(df.limit(0), "label").count() == 0
    df = spark.createDataFrame([(str(i), None if i < 10 else 1) for i in range(30)], "id string, label int")
    out = stratified_split(df, "label").collect()
    assert Counter(r["split"] for r in out) == {"train": 24, "test": 6}
    assert sum(r["split"] == "train" for r in out if r["label"] is None) == 8


def test_many_classes(spark):
    df = spark.range(900).select(F.col("id").cast("string").alias("id"), (F.col("id") % 150).alias("label"))
    split = Counter((r["label"], r["split"]) for r in stratified_split(df, "label", 0.5).collect())
    assert all(split[c, "test"] == split[c, "train"] == 3 for c in range(150))
    folds = Counter((r["label"], r["fold"]) for r in stratified_kfold(df, "label", 3).collect())
    assert all(folds[c, f] == 2 for c in range(150) for f in range(3))


def test_ranges_follow_the_table(labelled, monkeypatch):
    whole = {(r["id"], r["split"]) for r in stratified_split(labelled, "label").collect()}
    monkeypatch.setattr(sampling, "ROWS_PER_RANGE", 1 / 16 ** 5)
    assert {(r["id"], r["split"]) for r in stratified_split(labelled, "label").collect()} == whole


def test_split_moves_no_row(labelled):
    plan = stratified_split(labelled.coalesce(2), "label")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "Window" not in plan  # The fixture's own repartition.


def test_folds(spark, labelled):
    dev = stratified_split(labelled, "label", names=("dev", "test")).filter("split = 'dev'").drop("split")
    folds = stratified_kfold(dev, "label").persist()
    sizes = Counter((r["fold"], r["label"]) for r in folds.collect())
    assert [(sizes[f, 0], sizes[f, 1]) for f in range(5)] == [(9, 4)] * 4 + [(8, 4)]
    order = ranked(dev)
    expected = {key: i % 5 for i, key in enumerate(order[0])}
    expected |= {key: (44 + i) % 5 for i, key in enumerate(order[1])}
    assert {r["id"]: r["fold"] for r in folds.collect()} == expected

    for chunk in (100_000, 10):
        index = fold_index(folds, "id", chunk=chunk).collect()
        assert {r["fold"] for r in index} == set(range(5)) and (len(index) > 5) == (chunk == 10)
        for f in range(5):
            lists = [r for r in index if r["fold"] == f]
            assert sorted(k for r in lists for k in r["val_indices"]) == sorted(k for k, v in expected.items() if v == f)
            assert sorted(k for r in lists for k in r["train_indices"]) == sorted(k for k, v in expected.items() if v != f)
    chunks = fold_index_table(folds, "id", chunk=10)
    assert chunks.filter("fold = 0 AND part = 'train'").count() > 1
    for part in ("train", "val"):
        by_index = {r["id"] for r in fold_rows_by_index(dev, chunks, 2, part, "id").collect()}
        assert by_index == {r["id"] for r in fold_rows(folds, 2, part).collect()}
    with pytest.raises(ValueError, match="null"):
        stratified_kfold(dev.withColumn("label", F.lit(None).cast("int")), "label")
    folds.unpersist()


def test_samples_with_a_hot_class(spark):
    rows = [(f"k{i}", 1 if i % 20 else 0) for i in range(2000)]
    df = spark.createDataFrame(rows, "id string, label int")
    for parts in (1, 9):
        out = sample_per_class(df.repartition(parts), "label", 30)
        assert out.columns == df.columns
        order = ranked(df)
        assert {r["id"] for r in out.collect()} == {*order[0][:30], *order[1][:30]}
        first = head_per_class(df.repartition(parts), "label", 3)
        assert {r["id"] for r in first.collect()} == {
            *sorted(k for k, c in rows if c)[:3], *sorted(k for k, c in rows if not c)[:3]}
    assert sample_per_class(df, "label", 5000).count() == 2000


def test_sampling_limits_rows_before_the_shuffle(spark):
    df = spark.range(100).select(F.col("id").cast("string").alias("id"), F.lit(1).alias("label"))
    plan = sample_per_class(df, "label", 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2


def test_shuffle_and_hash_split(spark):
    df = spark.range(500).select(F.col("id").cast("string").alias("id"))
    assert [r["id"] for r in shuffle(df, "id").collect()] == sorted(map(str, range(500)), key=place)
    out = hash_split(df, "id")
    test = {r["id"] for r in out.filter("split = 'test'").collect()}
    assert test == {str(i) for i in range(500) if int(place(i)[0][:8], 16) / 2 ** 32 < 0.2}
    assert 60 < len(test) < 140


def test_orders(spark):
    df = spark.createDataFrame([(i, (i * 7) % 5) for i in range(20)], "id int, relevance_score int").repartition(3)
    rows = sorted(df.collect(), key=lambda r: (-r["relevance_score"], r["id"]))
    assert rank_articles(df, 3).collect() == [r for r in rows if r["relevance_score"] >= 3]
    assert top_k(df, 3).collect() == rows[:3]
    assert [r["id"] for r in limit_in_order(df, 4, ["id"]).collect()] == [0, 1, 2, 3]
    assert [r["id"] for r in latest(df, "relevance_score", 2).collect()] == [r["id"] for r in rows[:2]]


def test_annotation_set(spark):
    rows = [(d, p, f"it {'may' if d % 3 else 'will'} be so {d} {p}", "u") for d in range(40) for p in range(2)]
    df = spark.createDataFrame(rows + [(99, 0, "may", "u"), (99, 1, None, "u")],
                               "doc_id int, pos int, sentence string, url string")
    out = build_annotation_set(df, n=10).collect()
    assert Counter(r["rule_pred"] for r in out) == {0: 10, 1: 10}
    assert {r["gold_label"] for r in out} == {"?"}
    assert [r["id"] for r in out] == sorted((r["id"] for r in out), key=place)


def test_training_set(spark):
    text = "It may rise by a lot today. Shares fell by a lot today. Sign up for more of our news. Too short."
    articles = spark.createDataFrame([(i, text) for i in range(50)] + [(99, None)], "doc_id int, text string")
    gold = spark.createDataFrame([("g1", 1, "dev"), ("g2", 0, "test"), ("g3", 0, "test")],
                                 "sentence string, gold_label int, split string")
    out = prepare_training_set(articles, gold)
    sizes = Counter((r["split"], r["source"], r["label"]) for r in out.collect())
    assert sizes == {("train", None, 0): 40, ("train", None, 1): 40, ("val", "external", 0): 5,
                     ("val", "external", 1): 5, ("test", "external", 0): 5, ("test", "external", 1): 5,
                     ("val", "gold", 1): 1, ("test", "gold", 0): 2}
    assert prepare_training_set(articles, gold, dedup=True).count() == 2 + 3
    own = out.filter("split = 'val'").select("sentence", "label")
    assert add_gold(own, gold, "test").filter("source = 'gold'").count() == 2

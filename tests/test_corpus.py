import random

from pyspark.sql import functions as F

from cuemill.operators.dedup import dedup_by, dedup_rows, union_all
from cuemill.operators.filters import (
    drop_rejected,
    unparsable_labels,
    errors,
    lookback,
    min_length,
    valid_sentence,
)
from cuemill.operators.joins import (
    apply_annotations,
    attach_predictions,
    backfill_missing,
    denied_sentences,
    drop_denied,
    pair_annotators,
)
from cuemill.operators.schema import canonicalize, resolve_text_column, select_existing
from cuemill.plans.curation import (
    clean_annotations,
    clean_corpus,
    cue_candidates,
    label_external_news,
    merge_corpora,
    split_external,
)


def test_dedup_keeps_the_first_row_wherever_it_lies(spark):
    # One text makes up a third of the rows.
    rng = random.Random(4)
    rows = [(i, p, rng.choice(["hot", "hot", *"abcdefgh"]), f"u{i}") for i in range(60) for p in range(5)]
    first = {}
    for row in sorted(rows):
        first.setdefault(row[2], row)
    for seed, parts in ((1, 1), (2, 7)):
        random.Random(seed).shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id int, pos int, sentence string, url string").repartition(parts)
        out = dedup_by(df, ["sentence"], ["doc_id", "pos"])
        assert out.columns == df.columns
        assert sorted(map(tuple, out.collect())) == sorted(first.values())


def test_dedup_aggregates_before_the_shuffle(spark):
    df = spark.range(10).select("id", F.lit("x").alias("sentence"))
    plan = dedup_by(df, ["sentence"], ["id"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("partial_min_by") >= 1 and "Window" not in plan


def test_union_and_distinct(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    b = spark.createDataFrame([("x", 2.0), ("x", 2.0)], "b string, c double")
    both = union_all(a, b)
    assert both.columns == ["a", "b", "c"] and both.count() == 3
    assert dedup_rows(both).count() == 2


ANNOTATED = [("S1", "keep me please", "u1", 1, "1"), ("S2", "throw me away", "u2", 0, "delete"),
             ("S3", "spelled otherwise", "u3", 0, "Delete"), ("S4", "keep me please", "u4", 1, "0"),
             ("S5", "a newsletter with a label", "u5", 0, "0"), ("S6", "unparsable", "u6", 0, "?")]
SCHEMA = "id string, sentence string, url string, rule_pred int, gold_label string"


def test_rejected_rows_and_deny_list(spark):
    a = spark.createDataFrame(ANNOTATED, SCHEMA)
    kept = drop_rejected(a)
    assert {(r["id"], r["gold_label"]) for r in kept.collect()} == {
        ("S1", 1), ("S4", 0), ("S5", 0)}
    assert [r["id"] for r in unparsable_labels(a).collect()] == ["S6"]
    gold = clean_annotations(a)
    assert "rule_pred" not in gold.columns
    assert {r["id"] for r in gold.collect()} == {"S1", "S5"}
    assert [r[0] for r in denied_sentences(a).collect()] == ["throw me away"]
    assert denied_sentences(a, ignore_case=True).count() == 2
    df = spark.createDataFrame([("throw me away",), (None,), ("Throw me away",)], "sentence string")
    assert {r[0] for r in drop_denied(df, denied_sentences(a)).collect()} == {None, "Throw me away"}


def test_clean_corpus(spark):
    corpus = spark.createDataFrame(
        [(1, 0, "plain text", "a"), (1, 1, "throw me away", "a"), (2, 0, "plain text", "b"),
         (2, 1, "a newsletter with a label", "b"), (3, 0, "a newsletter without", "c"),
         (3, 1, "spelled otherwise", "c"), (4, 0, None, "d")],
        "doc_id int, pos int, sentence string, url string")
    out = clean_corpus(corpus, spark.createDataFrame(ANNOTATED, SCHEMA))
    assert sorted(map(tuple, out.collect())) == [
        ("a", "plain text"), ("c", "spelled otherwise"), ("u1", "keep me please"),
        ("u5", "a newsletter with a label")]


def test_backfill(spark):
    df = spark.createDataFrame([("a", "u2"), ("a", "u1"), ("b", "u")], "sentence string, url string")
    extra = spark.createDataFrame([("b", "x"), ("c", "y"), ("c", "x")], "sentence string, url string")
    assert sorted(map(tuple, backfill_missing(df, extra).collect())) == [
        ("a", "u1"), ("b", "u"), ("c", "x")]


def test_merge(spark):
    base = spark.createDataFrame([(1, 0, "One old text of six words", "u")],
                                 "doc_id int, pos int, sentence string, url string")
    news = spark.createDataFrame(
        [(7, "  One old text of six words", "v"), (8, "Brand new words are in here. Too short. "
          "Seeking Alpha said so many words. Watch: is fine inside WATCH: this one", "w"), (9, None, "x")],
        "doc_id int, sentence string, url string")
    found = split_external(news)
    assert {r["sentence"] for r in found.collect()} == {
        "One old text of six words", "Brand new words are in here."}
    out = merge_corpora(base, found)
    assert {(r["sentence"], r["url"]) for r in out.collect()} == {
        ("One old text of six words", "u"), ("Brand new words are in here.", "w")}


def test_external_news(spark):
    df = spark.createDataFrame(
        [("2024", "Shares may fall soon", "R", "u"), ("2024", "Shares may fall soon", "R", "u"),
         (None, "No cue is in this", None, None), (None, "short", None, None), (None, None, None, None)],
        "Date string, Article_title string, Publisher string, Url string")
    out = label_external_news(df)
    assert out.columns == ["sentence", "label", "hedge", "date", "publisher", "url"]
    assert {(r["sentence"], r["label"], r["hedge"]) for r in out.collect()} == {
        ("Shares may fall soon", 1, 1), ("No cue is in this", 0, 0)}
    assert out.count() == 2


def test_columns(spark):
    df = spark.createDataFrame([("2020", "2021", "x" * 30, "short")],
                               "Date string, Date_string string, body string, z string")
    assert canonicalize(df).columns == ["date", "Date_string", "body", "z"]
    assert resolve_text_column(df.select("z", "body"), ()) == "body"
    late = spark.createDataFrame([(2, "x" * 30), (1, "short")], "i int, t string")
    assert resolve_text_column(late.filter("i = 2"), (), order=["i"]) == "t"
    try:
        resolve_text_column(late, (), order=["i"])
        raise AssertionError
    except ValueError:
        pass
    assert resolve_text_column(df.withColumn("Text", F.lit(""))) == "Text"
    assert select_existing(df, ["z"], ["nope", "body"]).columns == ["z", "body"]


def test_valid_and_long_sentences(spark):
    texts = [" ".join(["w"] * n) for n in (4, 5, 100, 101)] + [
        "Sign up  and read all of it", "we  Sign up and read it", None, "a  b\nc d   e",
        "views and\nopinions are his own here"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, sentence string")
    out = {r["i"]: r["sentence"] for r in valid_sentence(df).collect()}
    assert set(out) == {1, 2, 5, 7} and out[7] == "a b c d e"
    lengths = spark.createDataFrame([(" 1234567890 ",), ("12345678901",), (None,)], "t string")
    assert [r[0] for r in min_length(lengths, "t").collect()] == ["12345678901"]
    assert min_length(lengths, "t", stripped=False).count() == 2


def test_costly_columns_are_computed_once(spark):
    df = spark.range(5).select(F.concat(F.lit(" a  b c d e "), F.col("id").cast("string")).alias("sentence"))
    plan = valid_sentence(df)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace") == 1


def test_joins_on_keys(spark):
    a = spark.createDataFrame([("1", 0), ("2", 1)], "id string, gold_label int")
    b = spark.createDataFrame([("2", 0), ("3", 1)], "id string, gold_label int")
    assert [tuple(r) for r in pair_annotators(a, b).collect()] == [("2", 1, 0)]
    queue = a.select("id", F.lit("?").alias("gold_label"))
    given = spark.createDataFrame([("2", 1)], "id string, label int")
    assert {tuple(r) for r in apply_annotations(queue, given).collect()} == {("1", "?"), ("2", "1")}
    predicted = attach_predictions(a, b.select("id", F.lit(1).alias("prediction")))
    assert predicted.columns == ["id", "gold_label", "prediction"] and predicted.count() == 1
    wrong = errors(a.withColumn("prediction", 1 - F.col("gold_label")))
    assert {(r["id"], r["error_type"]) for r in wrong.collect()} == {
        ("1", "false_positive"), ("2", "false_negative")}


def test_lookback_includes_both_ends(spark):
    df = spark.sql("""SELECT * FROM VALUES (TIMESTAMP_NTZ '2024-01-01 00:00:00'),
        (TIMESTAMP_NTZ '2024-01-08 00:00:00'), (TIMESTAMP_NTZ '2023-12-31 23:59:59'),
        (TIMESTAMP_NTZ '2024-01-08 00:00:01') AS t(ts)""")
    to = F.lit("2024-01-08 00:00:00").cast("timestamp_ntz")
    assert df.filter(lookback("ts", to)).count() == 2


def test_cue_candidates_come_in_corpus_order(spark):
    rows = [(d, p, "it may rise" if (d + p) % 2 else "dismay", f"u{d}") for d in range(30) for p in range(4)]
    df = spark.createDataFrame(rows, "doc_id int, pos int, sentence string, url string").repartition(5)
    out = [r["url"] for r in cue_candidates(df, n=7).collect()]
    assert out == [f"u{d}" for d, p, s, _ in sorted(rows) if s.startswith("it")][:7]

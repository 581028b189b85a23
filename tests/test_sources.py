import datetime
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from cuemill.session import scratch_path
from cuemill.sources.csv_records import csv_lines
from cuemill.sources.json_records import json_pieces
from cuemill.sources.metrics_files import read_metrics, write_metrics
from cuemill.sources.schemas import ANNOTATIONS, ARTICLES
from cuemill.sources.sinks import write_csv, write_json_array, write_json_run, write_splits
from cuemill.sources.tables import (
    NULL_WORDS,
    csv_headers,
    read_csv,
    read_csv_any_encoding,
    read_json_array,
    read_jsonl,
    read_mixed,
    read_mixed_rejects,
    require_columns,
)

ROWS = [("S1", 'He said "buy", then\nsold', "u,1", 1, "0"), ("S2", " spaced ", None, 0, "Delete"),
        ("S3", "back\\slash", "u3", 1, "?"), ("S4", "NA", "null", 0, "1")]


def test_csv_round_trip(spark):
    df = spark.createDataFrame(ROWS, ANNOTATIONS)
    path = write_csv(df, scratch_path(spark, "t"))
    back = read_csv(spark, path, ANNOTATIONS)
    assert sorted(map(tuple, back.collect())) == sorted(ROWS)
    nulls = read_csv(spark, path, ANNOTATIONS, null_words=NULL_WORDS).filter("id = 'S4'").first()
    assert nulls["sentence"] is None and nulls["url"] is None


def test_encodings_are_decided_per_file(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("id,t\n1,café\n".encode())
    (tmp_path / "b.csv").write_bytes("id,t\n2,naïve\n3,plain\n".encode("latin-1"))
    (tmp_path / "c.csv").write_bytes(b"")
    found = {os.path.basename(r["file"]): r["valid"] for r in csv_headers(spark, str(tmp_path)).collect()}
    assert found == {"a.csv": True, "b.csv": False}
    rows = read_csv_any_encoding(spark, str(tmp_path), "id int, t string").collect()
    assert {tuple(r) for r in rows} == {(1, "café"), (2, "naïve"), (3, "plain")}


def test_columns_are_found_by_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('\ufefftitle,url\nTa,Ua\n"T, b",Ub\n')
    (tmp_path / "b.csv").write_text("url,n,title\nUc,7,Tc\nUd,x,\n")
    (tmp_path / "c.csv").write_text("url\n")
    for reader in (read_csv, read_csv_any_encoding):
        rows = reader(spark, str(tmp_path), "title string, url string, n int").collect()
        assert {tuple(r) for r in rows} == {("Ta", "Ua", None), ("T, b", "Ub", None), ("Tc", "Uc", 7), (None, "Ud", None)}
    assert read_csv(spark, str(tmp_path / "a.csv"), "other string").collect() == [(None,), (None,)]


def test_header_is_the_first_line_of_a_split_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,t\n" + "".join(f"{i},row {i}\n" for i in range(20_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "20000")
    try:
        rows = read_csv(spark, str(tmp_path), "t string, n int", multiline=False)
        assert rows.agg(F.count("*"), F.sum("n"), F.countDistinct("t")).first() == (20_000, 199_990_000, 20_000)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_forms(spark, tmp_path):
    (tmp_path / "feed.json").write_text('[{"url": "u", "title": null,\n"description": "d"}, {"url": "v"}]')
    rows = read_json_array(spark, str(tmp_path / "feed.json"), ARTICLES).orderBy("url").collect()
    assert [(r["url"], r["title"], r["description"]) for r in rows] == [("u", None, "d"), ("v", None, None)]
    df = spark.range(25).withColumn("t", F.lit("x\ny"))
    path = write_json_array(df, scratch_path(spark, "t"), "id", 10)
    back = read_json_array(spark, path, "id long, t string")
    assert sorted(r["id"] for r in back.collect()) == list(range(25))
    assert len(back.inputFiles()) > 1


def test_mixed_folder(spark, tmp_path):
    empty, data = tmp_path / "first", tmp_path / "second"
    empty.mkdir()
    data.mkdir()
    (empty / "notes.txt").write_text("x")
    (data / "a.csv").write_text("title,url\nFrom csv,u1\n")
    (data / "b.csv").write_text("Headline,extra\nOther header,5\n")
    (data / "empty.csv").write_text("")
    (data / "c.json").write_text('{"title": "From json", "url": "u3"}\nnot json\n')
    (data / "broken.parquet").write_bytes(b"PAR1 this is no parquet file")
    spark.createDataFrame([("From parquet", "u4")], "title string, url string").coalesce(1).write.parquet(
        str(data / "d"))
    rows = read_mixed(spark, [str(tmp_path / "absent"), str(empty), str(data)],
                      json_schema="title string, url string").collect()
    assert {r["title"] for r in rows if r["title"]} == {"From csv", "From json", "From parquet"}
    assert [r["extra"] for r in rows if r["Headline"]] == ["5"]
    bad = read_mixed_rejects(spark, [str(tmp_path / "absent"), str(data)], "title string, url string").collect()
    assert sorted((os.path.basename(r["file"]), r["line"]) for r in bad) == [("broken.parquet", None), ("c.json", "not json")]
    assert read_mixed(spark, [str(data)]).filter("title = 'From json'").count() == 1
    with pytest.raises(FileNotFoundError):
        read_mixed(spark, [str(empty)])


def test_json_runs_are_stamped(spark):
    raw = spark.createDataFrame([(1, 5), (2, 1)], "id int, relevance_score int")
    run = F.lit(datetime.datetime(2024, 5, 6, 7, 8, 9))
    path = scratch_path(spark, "t")
    for _ in range(2):
        paths = write_json_run(raw.filter("relevance_score >= 3"), path, run, raw, save_all=True)
    assert [p.rsplit("/", 1)[1] for p in paths] == ["filtered", "raw"]
    rows = read_jsonl(spark, paths[0], "id int, run_ts string").collect()
    assert [tuple(r) for r in rows] == [(1, "20240506_070809")] * 2
    assert write_json_run(raw, scratch_path(spark, "t"), run, raw)[0].endswith("filtered")


def test_metric_files(spark, tmp_path):
    one = '{"accuracy": 0.5, "precision": 1, "recall": 0.25, "f1": 0.4, "tp": 1, "tn": 2, "fp": 0, "fn": 3}'
    (tmp_path / "flat.json").write_text(one)
    (tmp_path / "split.json").write_text(f'{{"model": "m2",\n "dev": {one}, "fold_metrics": [1]}}')
    (tmp_path / "deep.json").write_text(f'{{"lr": {{"dev": {one}, "test": {one}, "best_params": {{"C": 1}}}},'
                                        f' "svm": {{"test": {one}}}}}')
    names = {"flat": "flat.json", "m2": "split.json", "deep": "deep.json", "gone": "gone.json"}
    out = read_metrics(spark, {k: str(tmp_path / v) for k, v in names.items()})
    assert {(r["model"], r["dataset"]) for r in out.collect()} == {
        ("flat", "test"), ("m2", "dev"), ("lr", "dev"), ("lr", "test"), ("svm", "test")}
    assert {(r["f1"], r["fn"]) for r in out.collect()} == {(0.4, 3)}
    path = write_metrics(out, scratch_path(spark, "t"))
    back = read_metrics(spark, path, whole_files=False)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, out.collect()))
    assert read_metrics(spark, {"gone": str(tmp_path / "gone.json")}).count() == 0


def test_splits_are_partitions(spark):
    df = spark.range(10).withColumn("split", F.when(F.col("id") < 3, "test").otherwise("train"))
    back = spark.read.parquet(write_splits(df, scratch_path(spark, "t")))
    test = back.filter("split = 'test'")
    assert test.count() == 3
    assert "PartitionFilters: [isnotnull(split" in test._jdf.queryExecution().executedPlan().toString()


def test_require_columns(spark):
    df = spark.range(1)
    assert require_columns(df, ["id"]) is df
    with pytest.raises(ValueError, match="gold_label"):
        require_columns(df, ["id", "gold_label"])


class _Session:
    def __init__(self, folder, master):
        self.conf = {"spark.checkpoint.dir": folder}
        self.sparkContext = type("Context", (), {"master": master})


def test_scratch_folder_is_the_shared_one():
    cluster = scratch_path(_Session("/shared/place/", "spark://host:7077"), "x")
    assert cluster.startswith("/shared/place/x-")
    assert os.path.isdir(os.path.dirname(scratch_path(_Session(None, "local[2]"), "x")))
    with pytest.raises(RuntimeError):
        scratch_path(_Session(None, "yarn"), "x")


def test_rows_without_a_language_go_to_one_part(spark, tmp_path):
    from bindings import corpus, sources  # noqa: F401
    from bindings.common import QUERIES

    rows = [(1, "An English text, long enough.", "en", "a", 29), (2, "Un texte assez long.", "fr", "b", 20),
            (3, "Ein Text, lang genug.", "de", "c", 21), (4, "A text of no language.", None, "d", 22)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    lost = {}
    for name in ("scan_folder_mixed", "scan_csv_encoding"):
        lost[name] = set(rows) ^ {tuple(r) for r in QUERIES[name](spark, str(tmp_path)).select(docs.columns).collect()}
    news = QUERIES["label_external_news"](spark, str(tmp_path)).select("sentence", "publisher").collect()
    lost["label_external_news"] = {(r[1], r[2]) for r in rows} ^ {tuple(r) for r in news}
    assert not any(lost.values()), lost


def whole_file_rows(spark, path, width):
    schema = ", ".join(f"c{i} string" for i in range(width))
    reader = spark.read.option("header", True).option("quote", '"').option("escape", '"').option("multiLine", True)
    return sorted((tuple(r) for r in reader.option("ignoreLeadingWhiteSpace", False).schema(schema).csv(path).collect()), key=repr)


@pytest.mark.parametrize("seed, end", [(1, "\n"), (2, "\n"), (3, "\r\n")])
def test_one_csv_file_is_read_by_many_tasks(spark, tmp_path, seed, end):
    rng = random.Random(seed)
    bits = ["a", "é", ",", '"', "\n", " ", "word", '""', "\n\n", ",x"]
    rows = [["".join(rng.choice(bits) for _ in range(rng.randrange(12))) for _ in range(3)] for _ in range(1500)]
    # A cell that covers several splits, and quotes that mean themselves.
    rows[700][1] = 'long\n"x"\n' * 3000

    def cell(text):
        bare = text and not any(c in text for c in ',"\n') and rng.random() < 0.7
        return text if bare else '"' + text.replace('"', '""') + '"'

    lines = ["c0,c1,c2"] + [",".join(map(cell, r)) for r in rows[:1000]] + ['5" pipe,b "c" d,"e"', 'x"y",z,"1\n2"']
    lines += [",".join(map(cell, r)) for r in rows[1000:]]
    path = str(tmp_path / "one.csv")
    with open(path, "w", newline="", encoding="utf-8") as out:
        out.write(end.join(lines) + end)
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        lines_read = csv_lines(spark, path)
        assert lines_read.rdd.getNumPartitions() > 8
        found = read_csv(spark, path, "c0 string, c1 string, c2 string")
        assert sorted((tuple(r) for r in found.collect()), key=repr) == whole_file_rows(spark, path, 3)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert found.count() == 1502


@pytest.mark.parametrize("seed, indent", [(1, None), (2, 1), (3, None)])
def test_one_json_array_is_read_by_many_tasks(spark, tmp_path, seed, indent):
    rng = random.Random(seed)
    bits = ["a", "é", "{", "}", "[", "]", '"', "\\", "\n", ",", " ", "\\\\", '\\"', "}]"]
    text = lambda n: "".join(rng.choice(bits) for _ in range(rng.randrange(n)))
    rows = [{"id": i, "t": text(30), "in": {"a": [text(5) for _ in range(rng.randrange(3))], "b": {"c": text(8)}}} if i % 3
            else {"id": i, "t": None if i % 2 else text(60)} for i in range(900)]
    rows[300]["t"] = '{"' * 5000 + "}}" * 5000
    path = str(tmp_path / "one.json")
    with open(path, "w", encoding="utf-8") as out:
        json.dump(rows, out, ensure_ascii=seed == 3, indent=indent)
    schema = "id long, t string, in struct<a:array<string>,b:struct<c:string>>"
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        assert json_pieces(spark, path).rdd.getNumPartitions() > 8
        found = read_json_array(spark, path, schema)
        wanted = spark.read.schema(schema).option("multiLine", True).json(path)
        assert sorted(found.collect(), key=lambda r: r["id"]) == sorted(wanted.collect(), key=lambda r: r["id"])
        assert found.count() == 900
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_json_files_without_an_array(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id": 1, "t": "}"}')
    (tmp_path / "b.json").write_text(" [ ] \n")
    (tmp_path / "c.json").write_text("")
    (tmp_path / "d.json").write_text('﻿[{"id": 2, "t": {"x": 1}}, {"id": 3}]')
    found = read_json_array(spark, str(tmp_path), "id long, t string").collect()
    assert sorted((r["id"], r["t"]) for r in found) == [(1, "}"), (2, '{"x":1}'), (3, None)]

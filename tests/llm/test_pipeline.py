import random

import pytest

import corpus_pipeline


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with junk, near copies and benchmark passages."""
    rng = random.Random(9)
    prose = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    path = str(tmp_path_factory.mktemp("corpus"))
    items = [(i, prose(30)) for i in range(10)]
    rows, labels = [], []
    for i in range(400):
        text = prose(rng.randrange(60, 200))
        if i % 8 == 1:
            text = text.upper().replace(" ", "!! ")
        if i % 8 == 2:
            text = text + " " + items[i % 10][1]
        if i % 8 == 3 and i > 8:
            text = rows[i - 8][1]
        rows.append((i, text, "en", f"s{i % 3}", len(text)))
        if i % 2:
            labels.append((i, int(i % 8 != 1), 0))
    rows += [(900, None, None, None, None), (901, "", "en", "s0", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "SimHash near-dedup", "benchmark decontamination",
                     "mixing sources to target weights", "token-ID / binary output"]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, kept, folder)
        assert kept.columns == docs.columns
        path = corpus_pipeline.scratch_path(spark, "test")
        kept.write.parquet(path)
        kept = spark.read.parquet(path)
        ids = {r.doc_id for r in kept.select("doc_id").collect()}
        if name == "quality classifier":
            assert not [i for i in ids if i < 400 and i % 8 == 1] and len([i for i in ids if i < 400]) == 350
        if name == "SimHash near-dedup":
            assert len([i for i in ids if i % 8 == 3]) == 1 and len([i for i in ids if i % 8 == 0 and i < 400]) == 50
        if name == "benchmark decontamination":
            assert not [i for i in ids if i % 8 == 2] and len([i for i in ids if i % 8 == 0 and i < 400]) == 50


def test_run(spark, folder):
    got = corpus_pipeline.run(spark, folder).orderBy("start").collect()
    at = 0
    for r in got:
        assert r.start == at
        at += r.n_tokens
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in got) and len(got) > 150

"""Stages keep columns whose names are those of their own helpers and outputs."""

from pyspark.sql import functions as F

from cuemill.llm.mixing import mix_documents
from cuemill.llm.quality import fit, quality_filter
from cuemill.llm.simhash import simhash_dedup

NAMES = ("id", "_id", "_n", "_host", "_path", "_good", "_plan", "_size", "_evidence", "shard", "copy", "Place", "h", "size", "fp",
         "component_id", "block", "range", "text.x")


def table(spark):
    text = "some words that are told apart by their number {} and again {} so that none is a copy {}"
    rows = [(i, f"s{i % 3}", "en", text.format(i, i * i, i ** 3)) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string")
    return docs.select("*", *[F.concat(F.lit(f"{n}:"), "doc_id").alias(n) for n in NAMES])


def own_values(rows):
    return all(r[n] == f"{n}:{r.doc_id}" for r in rows for n in NAMES)


def test_stages_keep_clashing_columns(spark):
    docs = table(spark)
    kept = simhash_dedup(docs)
    assert kept.columns == docs.columns and own_values(kept.collect())
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    good = quality_filter(docs, labels, threshold=0.0)
    assert good.columns == docs.columns and good.count() == 30 and own_values(good.collect())
    mixed = mix_documents(docs, n_shards=2, blocks_per_shard=4)
    assert mixed.columns == [*docs.columns, "copy_", "shard_", "place_"]
    rows = mixed.collect()
    assert rows and own_values(rows)
    assert all(isinstance(r["place_"], int) and r["shard_"] in (0, 1) for r in rows)


def test_classifier_learns_one_row_of_a_repeated_id(spark):
    rows = [(1, "the good text"), (1, "another text"), (2, "x x x x"), (2, None)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    few = fit(docs.dropDuplicates(), labels)
    assert (few.weights == fit(docs, labels).weights).all()

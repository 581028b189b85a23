"""The registered queries: their SQL where there is one, their contracts where there is none."""

import os

import duckdb
import pytest

from cuemill.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    found = QUERIES[name](spark, SF)
    columns = sorted(found.columns)
    assert sorted(names) == columns
    wanted = [tuple(repr(r[names.index(c)]) for c in columns) for r in cursor.fetchall()]
    assert sorted(tuple(repr(r[c]) for c in columns) for r in found.collect()) == sorted(wanted) and wanted


def test_every_operator_has_a_query():
    numbers = {int(n[2:].split("_")[0]) for n in QUERIES}
    assert numbers == set(range(1, 14))


@pytest.mark.parametrize("name, first", [
    ("op2_simhash_dedup", ["doc_id", "fingerprint", "component_id"]),
    ("op5_language_id", ["doc_id", "held_out", "lang_pred", "score"]),
    ("op6_license_scan", ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels"]),
    ("op8_substring_dedup", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    ("op10_token_files", ["doc_id", "start", "n_tokens", "ids_crc32"])])
def test_one_row_per_document(spark, name, first):
    df = QUERIES[name](spark, SF)
    assert df.columns[:len(first)] == first
    ids = [r.doc_id for r in df.select("doc_id").collect()]
    assert sorted(ids) == sorted(r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect())


def test_languages_of_held_out_documents(spark):
    rows = QUERIES["op5_language_id"](spark, SF).join(
        spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 30 and sum(r.lang_pred == r.lang for r in rows) > 0.95 * len(rows)


def test_every_verbatim_item_is_found(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    items = spark.read.parquet(f"{SF}/benchmark.parquet").collect()
    there = {(d.doc_id, i.item_id) for d in docs for i in items if i.text in d.text}
    found = {(r.doc_id, r.item_id) for r in QUERIES["op9_benchmark_decontamination"](spark, SF).collect()}
    assert there and there <= found

"""Every driver query against its SQL, and the plans of the ones without Python."""

import os

import duckdb
import pytest

import __spark_entry__ as driver
from bindings.common import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables")

@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLES) and set(QUERIES) <= set(driver.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, duck, name):
    df = driver.queries()[name](spark, SF)
    columns = sorted(df.columns)
    cursor = duck.execute(driver.oracle_sql()[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    wanted = [tuple(repr(row[names.index(c)]) for c in columns) for row in cursor.fetchall()]
    found = [tuple(repr(row[c]) for c in columns) for row in df.collect()]
    assert sorted(found) == sorted(wanted) and found


def test_labels_are_mixed(spark):
    """With one label only, a broken matcher would pass."""
    for name, column in (("label_token_set", "label"), ("label_substring", "label"),
                         ("label_word_boundary", "label"), ("filter_hard_exclude", "excluded")):
        values = {r[0] for r in driver.queries()[name](spark, SF).select(column).distinct().collect()}
        assert values == {0, 1}


def test_entry(spark):
    rows = driver.entry(spark).collect()
    assert rows and rows[0].__fields__ == ["lang", "source", "n", "positives", "rate"]


@pytest.mark.parametrize("name", ["entry", "clean_corpus", "term_doc_freq", "html_paragraphs",
                                  "prepare_training_set", "roc_auc", "relevance_score", "stratified_kfold"])
def test_plans_are_native(spark, name):
    plan = driver.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    for operator in ("Python", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert operator not in plan

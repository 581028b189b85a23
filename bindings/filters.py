"""Filters and predicates."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from bindings.columns import HOST_SQL
from bindings.common import (
    ANNOTATIONS,
    ARTICLES,
    DOMAINS,
    JUNK,
    PATTERNS,
    PHRASES,
    PIECES,
    PREDICTIONS,
    RAW,
    RELEVANCE,
    SCORED,
    TOPICS,
    VALID,
    annotations,
    articles,
    contains_sql,
    excluded_sql,
    junk_sql,
    pieces,
    predictions,
    query,
    strip_sql,
    table,
    valid,
    word_regex,
    words_sql,
)
from cuemill.functions.labels import (
    bad_paragraph,
    hard_excluded,
    is_junk,
    is_relevant,
    keyword_query,
    matches_any_regex,
)
from cuemill.functions.text import min_words, with_computed
from cuemill.functions.web import domain_in
from cuemill.operators.filters import (
    drop_rejected,
    errors,
    is_topical,
    language_is,
    lookback,
    min_length,
    only,
)
from cuemill.operators.sentences import sentences
from cuemill.session import scratch_path
from cuemill.sources.sinks import write_splits

KEYS = ("doc_id", "pos", "sentence")


@query("filter_min_length", f"""WITH {RAW}, s AS (SELECT doc_id, pos, {strip_sql('piece')} AS sentence
  FROM raw) SELECT * FROM s WHERE length(sentence) > 30""")
def filter_min_length(spark, sf):
    raw = sentences(table(spark, sf, "documents"), min_word_count=0)
    return min_length(raw, "sentence", 30)


@query("filter_cue_regex", f"""WITH {PIECES} SELECT doc_id, pos, sentence FROM pieces
  WHERE regexp_matches(lower(sentence), '{word_regex(["with", "from", "the?", "of the"])}')""")
def filter_cue_regex(spark, sf):
    return pieces(spark, sf).filter(matches_any_regex("sentence", PATTERNS)).select(*KEYS)


@query("filter_junk_search", f"""WITH {PIECES} SELECT doc_id, pos, sentence FROM pieces
  WHERE NOT {junk_sql('sentence')}""")
def filter_junk_search(spark, sf):
    return pieces(spark, sf).filter(~is_junk("sentence", JUNK)).select(*KEYS)


@query("filter_valid_sentence", f"WITH {VALID} SELECT doc_id, pos, sentence FROM valid")
def filter_valid_sentence(spark, sf):
    return valid(spark, sf).select(*KEYS)


@query("filter_min_words", f"""WITH {RAW} SELECT doc_id, pos, {strip_sql('piece')} AS sentence
  FROM raw WHERE {words_sql('piece')} > 5""")
def filter_min_words(spark, sf):
    raw = sentences(table(spark, sf, "documents"), min_word_count=0)
    return raw.filter(min_words("sentence", 6))


@query("filter_bad_paragraph", f"""WITH {PIECES} SELECT doc_id, pos, sentence FROM pieces
  WHERE NOT {contains_sql('sentence', PHRASES)}""")
def filter_bad_paragraph(spark, sf):
    return pieces(spark, sf).filter(~bad_paragraph("sentence", PHRASES)).select(*KEYS)


@query("filter_rejected", f"""WITH {ANNOTATIONS}
  SELECT doc_id, CAST(gold_label AS INTEGER) AS gold_label FROM marks
  WHERE lower(gold_label) <> 'delete'""")
def filter_rejected(spark, sf):
    return drop_rejected(annotations(spark, sf))


@query("filter_hard_exclude", f"""SELECT doc_id, CAST({excluded_sql('text')} AS INTEGER) AS excluded
  FROM documents""")
def filter_hard_exclude(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", hard_excluded("text", RELEVANCE.exclude).cast("int").alias("excluded"))


@query("filter_min_score", f"""WITH {SCORED} SELECT doc_id, title FROM scored
  WHERE relevance_score >= 9 AND regexp_matches(title, '\\S')""")
def filter_min_score(spark, sf):
    rows = with_computed(articles(spark, sf), "relevant",
                         is_relevant("title", "description", 9, RELEVANCE))
    return rows.filter("relevant").select("doc_id", "title")


@query("filter_keyword_query", f"""SELECT doc_id, lang FROM documents
  WHERE regexp_matches(lower(text), '{word_regex(["from the", "with"])}')
    AND NOT regexp_matches(lower(text), '{word_regex(["that", "was"])}')""")
def filter_keyword_query(spark, sf):
    return table(spark, sf, "documents").filter(
        keyword_query("text", ["from the", "with"], ["that", "was"])).select("doc_id", "lang")


@query("filter_domains", f"""SELECT page_id, url FROM pages
  WHERE {HOST_SQL} IN ({', '.join(repr(d) for d in DOMAINS)})""")
def filter_domains(spark, sf):
    return table(spark, sf, "pages").filter(domain_in("url", DOMAINS)).select("page_id", "url")


@query("filter_lookback", """SELECT event_id, user_id FROM events
  WHERE ts BETWEEN TIMESTAMP '2024-01-20 12:00:00' - INTERVAL 7 DAY AND TIMESTAMP '2024-01-20 12:00:00'""")
def filter_lookback(spark, sf):
    to = F.lit(datetime.datetime(2024, 1, 20, 12)).cast("timestamp_ntz")
    return table(spark, sf, "events").filter(lookback("ts", to, 7)).select("event_id", "user_id")


@query("filter_language", "SELECT doc_id, text FROM documents WHERE lang = 'en'")
def filter_language(spark, sf):
    return table(spark, sf, "documents").filter(language_is("lang", "en")).select("doc_id", "text")


@query("filter_topic", f"""WITH {ARTICLES} SELECT doc_id, title FROM articles
  WHERE {contains_sql("title || ' ' || description", TOPICS)}""")
def filter_topic(spark, sf):
    return articles(spark, sf).filter(
        is_topical("title", "description", TOPICS)).select("doc_id", "title")


@query("filter_partition", "SELECT doc_id, n_chars FROM documents WHERE source = 'src3'")
def filter_partition(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "source")
    path = write_splits(docs, scratch_path(spark, "by-source"), "source")
    return only(spark.read.parquet(path), "source", "src3").select("doc_id", "n_chars")


@query("filter_errors", f"""WITH {PREDICTIONS} SELECT doc_id, model, dataset,
  CASE WHEN prediction = 1 THEN 'false_positive' ELSE 'false_negative' END AS error_type
  FROM predictions WHERE prediction <> gold_label""")
def filter_errors(spark, sf):
    return errors(predictions(spark, sf)).select("doc_id", "model", "dataset", "error_type")

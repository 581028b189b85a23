"""Joins, deduplication and curation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.columns import truncate_sql
from bindings.common import (
    ANNOTATED,
    CUES,
    JUNK,
    PATTERNS,
    PIECES,
    PREDICTIONS,
    TRUNCATE,
    annotated_sentences,
    gold,
    junk_sql,
    pieces,
    predictions,
    query,
    split_sql,
    strip_sql,
    table,
    token_set_sql,
    word_regex,
    words_sql,
)
from bindings.splits import FOLDS, folded
from cuemill.functions.labels import is_junk
from cuemill.operators.counting import StepCounts
from cuemill.operators.dedup import dedup_by, dedup_rows, union_all
from cuemill.operators.joins import (
    apply_annotations,
    attach_predictions,
    backfill_missing,
    drop_denied,
    fold_rows_by_index,
    pair_annotators,
)
from cuemill.operators.membership import drop_denied_large
from cuemill.operators.metrics import step_counts
from cuemill.operators.sampling import fold_index_table
from cuemill.operators.sentences import sentences
from cuemill.plans.curation import (
    articles_to_sentences,
    clean_annotations,
    clean_corpus,
    cue_candidates,
    load_external_news,
    merge_corpora,
    split_external,
)
from cuemill.session import scratch_path, stored
from cuemill.sources.sinks import write_csv

BENCH = f"""braw AS ({split_sql('benchmark', 'item_id')}),
  bench AS (SELECT item_id, pos, {strip_sql('piece')} AS sentence FROM braw
            WHERE {words_sql('piece')} >= 5)"""
FIRST = """QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY doc_id, pos) = 1"""


def bench_sentences(spark, sf):
    return sentences(table(spark, sf, "benchmark"), keep=["item_id"])


@query("antijoin_denylist", f"""WITH {PIECES}, {BENCH}
  SELECT doc_id, pos, sentence FROM pieces WHERE sentence NOT IN (SELECT sentence FROM bench)""")
def antijoin_denylist(spark, sf):
    return drop_denied(pieces(spark, sf).select("doc_id", "pos", "sentence"), bench_sentences(spark, sf))


@query("antijoin_denylist_large", f"""WITH {PIECES}, {BENCH}
  SELECT doc_id, pos, sentence FROM pieces WHERE sentence NOT IN (SELECT sentence FROM bench)""")
def antijoin_denylist_large(spark, sf):
    rows = stored(pieces(spark, sf).select("doc_id", "pos", "sentence"), "pieces")
    return drop_denied_large(rows, bench_sentences(spark, sf))


@query("antijoin_missing_backfill", f"""WITH {PIECES}, {BENCH},
  base AS (SELECT sentence, min(source) AS url FROM pieces WHERE NOT {junk_sql('sentence')}
           GROUP BY sentence),
  extra AS (SELECT sentence, 'item/' || min(item_id) AS url FROM bench
            WHERE sentence NOT IN (SELECT sentence FROM base) GROUP BY sentence)
  SELECT sentence, url FROM base UNION ALL SELECT sentence, url FROM extra""")
def antijoin_missing_backfill(spark, sf):
    base = pieces(spark, sf).filter(~is_junk("sentence", JUNK)).select(
        "sentence", F.col("source").alias("url"))
    first = bench_sentences(spark, sf).groupBy("sentence").agg(F.min("item_id").alias("item_id"))
    annotated = first.select("sentence", F.concat(F.lit("item/"), F.col("item_id").cast("string"))
                             .alias("url"))
    return backfill_missing(base, annotated)


@query("annotator_pair_join", """SELECT d.doc_id, l.quality AS label_a, 1 - l.toxic AS label_b
  FROM documents d JOIN labels l USING (doc_id)""")
def annotator_pair_join(spark, sf):
    labels = table(spark, sf, "labels")
    docs = table(spark, sf, "documents").select("doc_id")
    a = docs.join(labels, "doc_id").select("doc_id", F.col("quality").alias("gold_label"))
    b = labels.select("doc_id", (1 - F.col("toxic")).alias("gold_label"))
    return pair_annotators(a, b, "doc_id")


@query("apply_annotations", """SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '?') AS gold_label
  FROM documents d LEFT JOIN labels l USING (doc_id)""")
def apply_annotations_(spark, sf):
    queue = table(spark, sf, "documents").select("doc_id", F.lit("?").alias("gold_label"))
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("label"))
    return apply_annotations(queue, labels, "doc_id")


@query("attach_predictions", f"""WITH {PREDICTIONS} SELECT g.doc_id, g.gold_label, p.prediction,
    round(p.probability, 6) AS probability
  FROM gold g JOIN predictions p USING (doc_id) WHERE p.model = 'boundary'""")
def attach_predictions_(spark, sf):
    own = predictions(spark, sf).filter("model = 'boundary'").select(
        "doc_id", "prediction", F.round("probability", 6).alias("probability"))
    return attach_predictions(gold(spark, sf).select("doc_id", "gold_label"), own, "doc_id")


@query("fold_membership_join", f"""WITH {FOLDS}
  SELECT doc_id, gold_label FROM folds WHERE fold = 2""")
def fold_membership_join(spark, sf):
    rows = folded(spark, sf)
    index = fold_index_table(rows, "doc_id", chunk=100)
    return fold_rows_by_index(rows, index, 2, "val", "doc_id").select("doc_id", "gold_label")


@query("union_by_name", """SELECT doc_id, text, lang, NULL AS role FROM documents
  UNION ALL SELECT conv_id, text, NULL, role FROM conversations""")
def union_by_name(spark, sf):
    return union_all(table(spark, sf, "documents").select("doc_id", "text", "lang"),
                     table(spark, sf, "conversations").select(
                         F.col("conv_id").alias("doc_id"), "text", "role"))


@query("dedup_sentence", f"""WITH {PIECES} SELECT doc_id, pos, sentence FROM pieces {FIRST}""")
def dedup_sentence(spark, sf):
    return dedup_by(pieces(spark, sf).select("doc_id", "pos", "sentence"), ["sentence"],
                    ["doc_id", "pos"])


@query("dedup_full_row", "SELECT DISTINCT text, lang FROM documents")
def dedup_full_row(spark, sf):
    return dedup_rows(table(spark, sf, "documents").select("text", "lang"))


CONV = f"""craw AS ({split_sql('conversations', 'conv_id, turn')}),
  conv AS (SELECT conv_id, turn, pos, {strip_sql('piece')} AS sentence FROM craw
           WHERE {words_sql('piece')} >= 5),
  ext AS (SELECT * FROM conv WHERE length(sentence) >= 5 AND NOT {junk_sql('sentence')})"""
MERGED = f"""{PIECES}, {CONV},
  base AS (SELECT sentence, doc_id, pos FROM pieces {FIRST}),
  merged AS (SELECT sentence FROM base UNION SELECT sentence FROM ext)"""


def _corpora(spark, sf):
    base = dedup_by(pieces(spark, sf).select("doc_id", "pos", "sentence"), ["sentence"],
                    ["doc_id", "pos"]).withColumn("origin", F.lit("base"))
    key = F.col("conv_id") * 1000 + F.col("turn")
    external = table(spark, sf, "conversations").select(key.alias("doc_id"),
                                                        F.col("text").alias("sentence"))
    found = split_external(external, JUNK, keep=["doc_id"]).withColumn("origin", F.lit("external"))
    return base, found


@query("merge_corpora", f"""WITH {MERGED} SELECT sentence,
    CASE WHEN sentence IN (SELECT sentence FROM base) THEN 'base' ELSE 'external' END AS origin
  FROM merged""")
def merge_corpora_(spark, sf):
    return merge_corpora(*_corpora(spark, sf)).select("sentence", "origin")


@query("step_counts", f"""WITH {MERGED} SELECT 'base' AS step, count(*) AS n FROM base
  UNION ALL SELECT 'external', count(*) FROM ext UNION ALL SELECT 'merged', count(*) FROM merged""")
def step_counts_(spark, sf):
    # Each step's rows are cut once and written, as the job itself does.
    base, external = (stored(df, "step") for df in _corpora(spark, sf))
    return step_counts(base=base, external=external, merged=merge_corpora(base, external))


@query("merge_step_counts", f"""WITH {MERGED} SELECT 'base' AS step, count(*) AS n FROM base
  UNION ALL SELECT 'external', count(*) FROM ext UNION ALL SELECT 'merged', count(*) FROM merged""")
def merge_step_counts(spark, sf):
    """The same counts, taken by the job that writes the merged corpus."""
    counts = StepCounts()
    merged = merge_corpora(*_corpora(spark, sf), counts=counts)
    return counts.write(merged, scratch_path(spark, "merged"))


@query("clean_annotations", f"""WITH {ANNOTATED} SELECT id, sentence, url, CAST(gold_label AS INTEGER) AS gold_label
  FROM annotated WHERE lower(gold_label) <> 'delete'
  QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY id) = 1""")
def clean_annotations_(spark, sf):
    return clean_annotations(annotated_sentences(spark, sf)).select("id", "sentence", "url", "gold_label")


@query("clean_corpus", f"""WITH {ANNOTATED},
  denied AS (SELECT sentence FROM annotated WHERE gold_label = 'delete'),
  clean AS (SELECT doc_id, pos, sentence, source AS url FROM pieces
            WHERE sentence NOT IN (SELECT sentence FROM denied) AND NOT {junk_sql('sentence')} {FIRST}),
  kept AS (SELECT sentence, url FROM annotated WHERE lower(gold_label) <> 'delete'
           QUALIFY row_number() OVER (PARTITION BY sentence ORDER BY id) = 1)
  SELECT url, sentence FROM clean UNION ALL
  SELECT url, sentence FROM kept WHERE sentence NOT IN (SELECT sentence FROM clean)""")
def clean_corpus_(spark, sf):
    corpus = pieces(spark, sf).select("doc_id", "pos", "sentence", F.col("source").alias("url"))
    return clean_corpus(corpus, annotated_sentences(spark, sf), JUNK)


@query("articles_to_sentences", f"""WITH
  cut AS (SELECT doc_id, trim(regexp_replace({truncate_sql('text')}, '\\s+', ' ', 'g')) AS text
          FROM documents),
  craw AS ({split_sql('cut', 'doc_id')})
  SELECT 'doc/' || doc_id AS url, pos, piece AS sentence FROM craw WHERE {words_sql('piece')} >= 5""")
def articles_to_sentences_(spark, sf):
    url = F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url")
    return articles_to_sentences(table(spark, sf, "documents").select(url, "text"),
                                 patterns=TRUNCATE, keep=["url"])


@query("label_external_news", f"""SELECT DISTINCT text AS sentence, {token_set_sql('text')} AS hedge,
    {token_set_sql('text')} AS label, lang AS publisher, 'https://' || source AS url
  FROM documents WHERE length(text) > 10""")
def label_external_news_(spark, sf):
    raw = table(spark, sf, "documents").select(
        F.col("text").alias("Article"), F.col("lang").alias("Publisher"),
        F.concat(F.lit("https://"), "source").alias("Url"))
    path = scratch_path(spark, "external")
    raw.filter("NOT (Publisher <=> 'en')").write.parquet(f"{path}/a")
    write_csv(raw.filter("Publisher <=> 'en'"), f"{path}/b")
    return load_external_news(spark, [f"{path}/absent", path], CUES)


@query("cue_candidates", f"""WITH {PIECES} SELECT source AS url, sentence FROM pieces
  WHERE regexp_matches(lower(sentence), '{word_regex(["with", "from", "the?", "of the"])}')
  ORDER BY doc_id, pos LIMIT 200""")
def cue_candidates_(spark, sf):
    return cue_candidates(pieces(spark, sf).withColumn("url", F.col("source")), PATTERNS)

"""Samples, splits, folds, orders and first rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import (
    CUES,
    GOLD,
    JUNK,
    PIECES,
    RELEVANCE,
    SCORED,
    VALID,
    articles,
    gold,
    pieces,
    query,
    substring_sql,
    table,
    valid,
)
from cuemill.operators.metrics import class_weights, label_distribution
from cuemill.operators.ranking import head, latest, limit_in_order, rank_articles, score_articles, top_k
from cuemill.operators.sampling import (
    add_gold,
    fold_index_table,
    hash_split,
    head_per_class,
    sample_per_class,
    shuffle,
    stratified_kfold,
    stratified_split,
    three_way_split,
)
from cuemill.plans.training import build_annotation_set, prepare_training_set
from cuemill.session import scratch_path


def hash_sql(key: str, seed: int = 42) -> str:
    return f"md5('{seed}:' || {key})"


KEY = "doc_id || '_' || pos"


def keyed(df):
    return df.withColumn("key", F.concat_ws("_", F.col("doc_id").cast("string"),
                                            F.col("pos").cast("string")))


def quota_sql(counts: str, name: str, rest: str, label: str, fraction: float) -> str:
    """CTE ``name(label, rest, quota)``: rows taken from ``rest`` rows of each class."""
    return f"""{name} AS (
    SELECT label, rest, fl + CASE WHEN row_number() OVER (ORDER BY rem DESC, label)
             <= draws - sum(fl) OVER () THEN 1 ELSE 0 END AS quota
    FROM (SELECT label, rest, draws, rest * draws // total AS fl, rest * draws % total AS rem
          FROM (SELECT {label} AS label, {rest} AS rest, sum({rest}) OVER () AS total,
                  sum({rest}) OVER () - CAST(ceil({fraction}::DOUBLE * sum({rest}) OVER ()) AS BIGINT) AS draws
                FROM {counts})))"""


def split_ctes(source: str, label: str, key: str) -> str:
    """Ranked rows with the quotas of a three-way split."""
    return f"""ranked AS (SELECT *, row_number() OVER (PARTITION BY {label}
        ORDER BY {hash_sql(key)}, {key}) AS rn FROM {source}),
    counts AS (SELECT {label} AS label, count(*) AS n FROM {source} GROUP BY 1),
    {quota_sql('counts', 'q1', 'n', 'label', 0.2)},
    left_over AS (SELECT label, rest - quota AS n FROM q1),
    {quota_sql('left_over', 'q2', 'n', 'label', 0.5)},
    splits AS (SELECT r.*, CASE WHEN rn <= q1.quota THEN 'train'
        WHEN rn <= q1.quota + q2.quota THEN 'val' ELSE 'test' END AS split,
        CASE WHEN rn <= q1.quota THEN 'train' ELSE 'test' END AS split2
      FROM ranked r JOIN q1 ON r.{label} = q1.label JOIN q2 ON r.{label} = q2.label)"""


@query("stratified_sample_n", f"""WITH {VALID} SELECT doc_id, pos, label, sentence FROM valid
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY {hash_sql(KEY)}, {KEY}) <= 50""")
def stratified_sample_n(spark, sf):
    rows = keyed(valid(spark, sf).select("doc_id", "pos", "label", "sentence"))
    return sample_per_class(rows, "label", 50, key="key").drop("key")


@query("seeded_shuffle", "SELECT doc_id, lang, text FROM documents")
def seeded_shuffle(spark, sf):
    return shuffle(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")


ANNOTATION_SET = f"""{PIECES}, cued AS (SELECT *, {substring_sql('sentence')} AS rule_pred FROM pieces
    WHERE length(sentence) > 10),
  chosen AS (SELECT * FROM cued QUALIFY row_number() OVER (PARTITION BY rule_pred
    ORDER BY {hash_sql(KEY)}, {KEY}) <= 50)"""


@query("build_annotation_set", f"""WITH {ANNOTATION_SET}
  SELECT 'S' || {KEY} AS id, sentence, source AS url, rule_pred, '?' AS gold_label FROM chosen""")
def build_annotation_set_(spark, sf):
    return build_annotation_set(pieces(spark, sf).withColumn("url", F.col("source")), CUES)


@query("stratified_split", f"""WITH {VALID}, {split_ctes('valid', 'label', KEY)}
  SELECT doc_id, pos, label, split2 AS split FROM splits""")
def stratified_split_(spark, sf):
    rows = keyed(valid(spark, sf).select("doc_id", "pos", "label"))
    return stratified_split(rows, "label", key="key").drop("key")


@query("three_way_split", f"""WITH {VALID}, {split_ctes('valid', 'label', KEY)}
  SELECT doc_id, pos, label, split FROM splits""")
def three_way_split_(spark, sf):
    rows = keyed(valid(spark, sf).select("doc_id", "pos", "label"))
    return three_way_split(rows, "label", key="key").drop("key")


FOLDS = f"""{GOLD}, folds AS (
    SELECT r.doc_id, r.gold_label, r.dataset, CAST((r.rn - 1 + coalesce(o.off, 0)) % 5 AS INTEGER) AS fold
    FROM (SELECT *, row_number() OVER (PARTITION BY gold_label
            ORDER BY {hash_sql('doc_id')}, doc_id) AS rn FROM gold) r
    JOIN (SELECT gold_label, sum(n) OVER (ORDER BY gold_label ROWS BETWEEN UNBOUNDED PRECEDING
            AND 1 PRECEDING) AS off
          FROM (SELECT gold_label, count(*) AS n FROM gold GROUP BY gold_label)) o USING (gold_label))"""


def folded(spark, sf, k: int = 5):
    return stratified_kfold(gold(spark, sf).select("doc_id", "gold_label", "dataset"), "gold_label",
                            k, key="doc_id")


@query("stratified_kfold", f"WITH {FOLDS} SELECT doc_id, gold_label, fold FROM folds")
def stratified_kfold_(spark, sf):
    return folded(spark, sf).select("doc_id", "gold_label", "fold")


@query("fold_index_table", f"""WITH {FOLDS}, f AS (SELECT CAST(unnest(range(5)) AS INTEGER) AS fold)
  SELECT f.fold, CASE WHEN d.fold = f.fold THEN 'val' ELSE 'train' END AS part, d.doc_id
  FROM folds d, f""")
def fold_index_table_(spark, sf):
    chunks = fold_index_table(folded(spark, sf), "doc_id", chunk=100)
    return chunks.select("fold", "part", F.explode("indices").alias("doc_id"))


@query("hash_split", f"""SELECT doc_id, CASE WHEN CAST('0x' || substr({hash_sql('doc_id')}, 1, 8) AS BIGINT)
  / 4294967296.0::DOUBLE < 0.2 THEN 'test' ELSE 'train' END AS split FROM documents""")
def hash_split_(spark, sf):
    return hash_split(table(spark, sf, "documents").select("doc_id"), "doc_id")


GOLD_SPLIT = f"""{GOLD}, granked AS (SELECT *, CASE WHEN dataset = 'test' THEN 'test' ELSE 'val' END AS split
  FROM gold)"""


@query("add_gold_to_eval", f"""WITH {VALID}, {GOLD_SPLIT}
  SELECT sentence, label, 'external' AS source FROM valid
  UNION ALL SELECT sentence, gold_label, 'gold' FROM granked WHERE split = 'val'""")
def add_gold_to_eval(spark, sf):
    golden = gold(spark, sf).withColumn(
        "split", F.when(F.col("dataset") == "test", "test").otherwise("val"))
    own = valid(spark, sf).select("sentence", "label")
    return add_gold(own, golden, "val")


@query("prepare_training_set", f"""WITH {VALID}, {split_ctes('valid', 'label', KEY)}, {GOLD_SPLIT}
  SELECT sentence, label, split, CASE WHEN split = 'train' THEN NULL ELSE 'external' END AS source
  FROM splits
  UNION ALL SELECT sentence, gold_label, split, 'gold' FROM granked""")
def prepare_training_set_(spark, sf):
    golden = gold(spark, sf).withColumn("split", F.col("dataset"))
    return prepare_training_set(table(spark, sf, "documents"), golden, CUES, JUNK,
                                scratch=scratch_path(spark, "sentences"))


@query("class_weights", f"""WITH {VALID}, c AS (SELECT label, count(*) AS n FROM valid GROUP BY label)
  SELECT label, n, round(sum(n) OVER () / (count(*) OVER () * n)::DOUBLE, 6) AS weight FROM c""")
def class_weights_(spark, sf):
    return class_weights(valid(spark, sf)).withColumn("weight", F.round("weight", 6))


@query("label_distribution", f"""WITH {VALID}
  SELECT c.label, count(v.label) AS n,
         round(100.0 * count(v.label) / (SELECT count(*) FROM valid), 6) AS pct
  FROM (VALUES (0), (1), (2)) c(label) LEFT JOIN valid v USING (label) GROUP BY c.label""")
def label_distribution_(spark, sf):
    return label_distribution(valid(spark, sf), classes=(0, 1, 2)).withColumn("pct", F.round("pct", 6))


def _scored(spark, sf):
    return score_articles(articles(spark, sf), RELEVANCE, min_score=None).select(
        "doc_id", "title", "relevance_score")


@query("rank_articles", f"""WITH {SCORED} SELECT doc_id, title, relevance_score FROM scored
  WHERE relevance_score >= 3 ORDER BY relevance_score DESC, doc_id""")
def rank_articles_(spark, sf):
    return rank_articles(_scored(spark, sf), order=["doc_id"])


@query("top_k_articles", f"""WITH {SCORED} SELECT doc_id, title, relevance_score FROM scored
  ORDER BY relevance_score DESC, doc_id LIMIT 3""")
def top_k_articles(spark, sf):
    return top_k(_scored(spark, sf), 3, order=["doc_id"])


@query("limit_in_order", f"""WITH {PIECES} SELECT doc_id, pos, sentence FROM pieces
  ORDER BY doc_id, pos LIMIT 200""")
def limit_in_order_(spark, sf):
    return limit_in_order(pieces(spark, sf).select("doc_id", "pos", "sentence"))


@query("head_per_class", f"""WITH {VALID} SELECT doc_id, pos, label, sentence FROM valid
  QUALIFY row_number() OVER (PARTITION BY label ORDER BY doc_id, pos) <= 5""")
def head_per_class_(spark, sf):
    return head_per_class(valid(spark, sf).select("doc_id", "pos", "label", "sentence"), "label", 5,
                          ["doc_id", "pos"])


@query("head_sample", "SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 2")
def head_sample(spark, sf):
    return head(table(spark, sf, "documents").select("doc_id", "text"), 2, ["doc_id"])


@query("latest_page", """SELECT event_id, user_id, event_type FROM events
  ORDER BY ts DESC, event_id LIMIT 100""")
def latest_page(spark, sf):
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type", "ts")
    return latest(events, "ts", 100, ["event_id"]).drop("ts")

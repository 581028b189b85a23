"""Cue lists that come from a table, matched through an index."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import query, table
from cuemill.operators.lexicon_index import label_lexicon, lexicon_hits

# The neighbouring words of all benchmark items are the cues, so that their number grows with the table.
PAIR = "[A-Za-z]+ [A-Za-z]+"
# The SQL takes every two whole words with one blank between them and looks them up.
HITS = rf"""cues AS (SELECT DISTINCT lower(unnest(regexp_extract_all(text, '{PAIR}'))) AS cue FROM benchmark),
  units AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_]') AS u FROM documents),
  places AS (SELECT doc_id, u, unnest(range(1, len(u) - 1)) AS i FROM units),
  hits AS (SELECT DISTINCT doc_id, cue FROM places JOIN cues ON cue = u[i] || u[i + 1] || u[i + 2])"""


def benchmark_cues(spark, sf):
    pairs = F.regexp_extract_all("text", F.lit(PAIR), F.lit(0))
    return table(spark, sf, "benchmark").select(F.explode(pairs).alias("cue"))


@query("filter_cue_lexicon", f"WITH {HITS} SELECT doc_id, cue FROM hits")
def filter_cue_lexicon(spark, sf):
    return lexicon_hits(table(spark, sf, "documents"), benchmark_cues(spark, sf), ["doc_id"])


@query("label_cue_lexicon", f"""WITH {HITS} SELECT doc_id, CAST(count(cue) > 0 AS INTEGER) AS label,
    count(cue) AS n_cues, min(cue) AS first_cue FROM documents LEFT JOIN hits USING (doc_id) GROUP BY doc_id""")
def label_cue_lexicon(spark, sf):
    # A list that is not sent to the tasks: the other way, through a join on the key.
    return label_lexicon(table(spark, sf, "documents"), benchmark_cues(spark, sf), ["doc_id"], max_bytes=0)

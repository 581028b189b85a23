"""Projection, schema and text columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from bindings.common import (
    ARTICLES,
    CUES,
    NW,
    PIECES,
    RELEVANCE,
    SCORED,
    TRUNCATE,
    articles,
    boundary_sql,
    contains_sql,
    norm_sql,
    strip_sql,
    pieces,
    query,
    rounded,
    substring_sql,
    table,
    token_set_sql,
    words_sql,
    METRICS,
    METRIC_NAMES,
    PREDICTIONS,
    counts_sql,
    predictions,
)
from cuemill.functions.labels import (
    has_suffix,
    has_ticker,
    label_substring,
    label_token_set,
    label_word_boundary,
    relevance_score,
)
from cuemill.functions.text import (
    article_text,
    iso_stamp,
    ngrams,
    normalize_space,
    preview,
    run_stamp,
    truncate_at,
    word_count,
)
from cuemill.functions.web import url_host
from cuemill.operators.metrics import confusion_metrics, round_metrics
from cuemill.operators.schema import (
    annotation_rows,
    canonicalize,
    label_alias,
    resolve_text_column,
    select_existing,
    tag_source,
)
from cuemill.operators.sentences import html_article_text, html_paragraphs

PAGE_PHRASES = ("licensed under", "©", "the was thnterble")


@query("resolve_text_column", """SELECT doc_id, 'by_name' AS how, text AS sentence FROM documents
  UNION ALL SELECT doc_id, 'by_length', text FROM documents""")
def resolve_text_column_(spark, sf):
    docs = table(spark, sf, "documents")
    renamed = docs.withColumnRenamed("text", "body")
    parts = [df.select("doc_id", F.lit(how).alias("how"),
                       F.col(resolve_text_column(df, order=["doc_id"])).alias("sentence"))
             for how, df in (("by_name", docs), ("by_length", renamed))]
    return parts[0].unionByName(parts[1])


@query("canonical_rename", """SELECT doc_id, text AS sentence, lang AS publisher, source AS url,
  CAST(n_chars AS VARCHAR) AS date, lang AS "Date_string" FROM documents""")
def canonical_rename(spark, sf):
    raw = table(spark, sf, "documents").select(
        "doc_id", "text", F.col("lang").alias("Publisher"), F.col("source").alias("Url"),
        F.col("n_chars").cast("string").alias("Date"), F.col("lang").alias("Date_string"))
    return canonicalize(raw, text_column="text")


@query("select_existing", "SELECT doc_id, text AS sentence, lang, source FROM documents")
def select_existing_(spark, sf):
    raw = table(spark, sf, "documents").select("doc_id", F.col("text").alias("sentence"), "lang",
                                               "source", F.lit(1).alias("rule_pred"))
    return select_existing(raw, ["doc_id", "sentence", "rule_pred"],
                           ["lang", "publisher", "source"], drop=["rule_pred"])


@query("annotation_rows", f"""WITH {PIECES} SELECT 'S' || doc_id || '_' || pos AS id, sentence,
  source || '/' || doc_id AS url, {substring_sql('sentence')} AS rule_pred, '?' AS gold_label
  FROM pieces""")
def annotation_rows_(spark, sf):
    url = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))
    return annotation_rows(pieces(spark, sf).withColumn("url", url), CUES)


@query("tag_source", "SELECT doc_id, text, 'external' AS source FROM documents")
def tag_source_(spark, sf):
    return tag_source(table(spark, sf, "documents").select("doc_id", "text"), "external")


@query("article_text", f"""WITH {ARTICLES}
  SELECT doc_id, lower(title || ' ' || description) AS text FROM articles""")
def article_text_(spark, sf):
    return articles(spark, sf).select("doc_id", article_text("title", "description").alias("text"))


@query("preview", """SELECT doc_id, CASE WHEN length(text) > 80 THEN substr(text, 1, 80) || '...'
  ELSE text END AS preview FROM documents""")
def preview_(spark, sf):
    return table(spark, sf, "documents").select("doc_id", preview("text").alias("preview"))


@query("label_alias", f"""SELECT doc_id, {token_set_sql('text')} AS hedge,
  {token_set_sql('text')} AS label FROM documents""")
def label_alias_(spark, sf):
    hedged = table(spark, sf, "documents").select("doc_id", label_token_set("text", CUES).alias("hedge"))
    return label_alias(hedged)


@query("sentence_split", f"WITH {PIECES} SELECT doc_id, pos, sentence FROM pieces")
def sentence_split(spark, sf):
    return pieces(spark, sf).select("doc_id", "pos", "sentence")


def truncate_sql(x: str) -> str:
    return f"regexp_replace({x}, '(?i)({'|'.join(TRUNCATE)}).*', '', 'g')"


@query("truncate_boilerplate", f"SELECT doc_id, {truncate_sql('text')} AS text FROM documents")
def truncate_boilerplate(spark, sf):
    return table(spark, sf, "documents").select("doc_id", truncate_at("text", TRUNCATE).alias("text"))


@query("normalize_space", f"SELECT doc_id, {norm_sql('text')} AS text FROM documents")
def normalize_space_(spark, sf):
    return table(spark, sf, "documents").select("doc_id", normalize_space("text").alias("text"))


_CLEAN = "html"
for _pattern in (r"(?is)<script\b.*?</script\s*>", r"(?is)<style\b.*?</style\s*>", r"(?s)<!--.*?-->"):
    _CLEAN = f"regexp_replace({_CLEAN}, '{_pattern}', '', 'g')"


def unescape_sql(x: str) -> str:
    for name, char in (("lt", "<"), ("gt", ">"), ("quot", '"'), ("copy", "©"), ("middot", "·"),
                       ("amp", "&")):
        x = f"replace({x}, '&{name};', '{char}')"
    return x


# Depth per element name by running sums; an element ends where its name's depth falls below its own, or
# where an element around it ends.
_VOID = "'area', 'base', 'br', 'col', 'embed', 'hr', 'img', 'input', 'link', 'meta', 'param', 'source', 'track', 'wbr'"
PAGES = rf"""cleaned AS (SELECT page_id, url, {_CLEAN} AS html FROM pages),
  tag AS (SELECT page_id, unnest(regexp_extract_all(html, '<[^>]*>')) AS t,
      generate_subscripts(regexp_extract_all(html, '<[^>]*>'), 1) AS i FROM cleaned),
  named AS (SELECT page_id, i, ltrim(n, '/') AS n, CASE WHEN n[1] = '/' THEN -1 ELSE 1 END AS way
    FROM (SELECT page_id, i, lower(regexp_extract(t, '^<(/?[A-Za-z][^\s/>]*)', 1)) AS n FROM tag WHERE NOT ends_with(t, '/>'))
    WHERE n <> '' AND n NOT IN ({_VOID})),
  deep AS (SELECT *, sum(way) OVER (PARTITION BY page_id, n ORDER BY i) AS d FROM named),
  ended AS (SELECT a.page_id, a.n, a.i, coalesce(min(b.i), 1000000000) AS j FROM deep a
    LEFT JOIN deep b ON b.page_id = a.page_id AND b.n = a.n AND b.i > a.i AND b.d < a.d WHERE a.way = 1 GROUP BY a.page_id, a.n, a.i),
  span AS (SELECT a.page_id, a.n, a.i, min(b.j) AS j FROM ended a JOIN ended b
    ON b.page_id = a.page_id AND b.i <= a.i AND b.j > a.i WHERE a.n IN ('p', 'article', 'section') GROUP BY a.page_id, a.n, a.i),
  node AS (SELECT page_id, {strip_sql(unescape_sql('n'))} AS n, k FROM (SELECT page_id, unnest(regexp_split_to_array(html, '<[^>]*>')) AS n,
      generate_subscripts(regexp_split_to_array(html, '<[^>]*>'), 1) AS k FROM cleaned)),
  body AS (SELECT s.page_id, s.n, s.i, coalesce(string_agg(node.n, ' ' ORDER BY k) FILTER (node.n <> ''), '') AS body
    FROM span s LEFT JOIN node ON node.page_id = s.page_id AND k > s.i AND k <= s.j GROUP BY s.page_id, s.n, s.i),
  line AS (SELECT page_id, flatten(list(CASE WHEN n = 'p' THEN [body] ELSE string_split(body, chr(10)) END
      ORDER BY CASE n WHEN 'p' THEN 0 WHEN 'article' THEN 1 ELSE 2 END, i)) AS parts FROM body GROUP BY page_id),
  blocks AS (SELECT page_id, url, parts FROM cleaned JOIN line USING (page_id)),
  raw AS (SELECT page_id, url, unnest(parts) AS piece, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos
          FROM blocks),
  texts AS (SELECT page_id, url, pos, {norm_sql('piece')} AS text FROM raw),
  paragraphs AS (SELECT * FROM texts WHERE {words_sql('text')} > 5
      AND NOT {contains_sql('text', PAGE_PHRASES)})"""


@query("html_paragraphs", f"WITH {PAGES} SELECT page_id, pos, text FROM paragraphs")
def html_paragraphs_(spark, sf):
    return html_paragraphs(table(spark, sf, "pages"), phrases=PAGE_PHRASES)


@query("html_article_text", f"""WITH {PAGES}, joined AS (
    SELECT page_id, string_agg(text, ' ' ORDER BY pos) AS text FROM paragraphs GROUP BY page_id)
  SELECT p.page_id, p.url, replace(p.url, ',', ' ') AS title,
    replace(coalesce(j.text, ''), ',', ' ') AS text FROM pages p LEFT JOIN joined j USING (page_id)""")
def html_article_text_(spark, sf):
    pages = table(spark, sf, "pages").withColumn("title", F.col("url"))
    return html_article_text(pages, phrases=PAGE_PHRASES)


@query("label_token_set", f"""WITH {PIECES} SELECT doc_id, pos, {token_set_sql('sentence')} AS label
  FROM pieces""")
def label_token_set_(spark, sf):
    return pieces(spark, sf).select("doc_id", "pos", label_token_set("sentence", CUES).alias("label"))


@query("label_substring", f"""WITH {PIECES} SELECT doc_id, pos, {substring_sql('sentence')} AS label
  FROM pieces""")
def label_substring_(spark, sf):
    return pieces(spark, sf).select("doc_id", "pos", label_substring("sentence", CUES).alias("label"))


@query("label_word_boundary", f"""WITH {PIECES} SELECT doc_id, pos, {boundary_sql('sentence')} AS label
  FROM pieces""")
def label_word_boundary_(spark, sf):
    return pieces(spark, sf).select("doc_id", "pos",
                                    label_word_boundary("sentence", CUES).alias("label"))


@query("relevance_score", f"WITH {SCORED} SELECT doc_id, relevance_score FROM scored")
def relevance_score_(spark, sf):
    return articles(spark, sf).select(
        "doc_id", relevance_score("title", "description", RELEVANCE).alias("relevance_score"))


HOST_SQL = ("replace(regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)', 1), "
            "'www.', '')")


@query("url_host", f"SELECT page_id, {HOST_SQL} AS host FROM pages")
def url_host_(spark, sf):
    return table(spark, sf, "pages").select("page_id", url_host("url").alias("host"))


@query("ticker_match", f"""WITH {ARTICLES} SELECT doc_id,
  CAST(regexp_matches(title, '(^|{NW})[A-Z]{{1,5}}({NW}|$)') AS INTEGER) AS ticker FROM articles""")
def ticker_match(spark, sf):
    return articles(spark, sf).select("doc_id", has_ticker("title").cast("int").alias("ticker"))


@query("suffix_match", f"""SELECT doc_id,
  CAST({contains_sql('text', RELEVANCE.suffixes)} AS INTEGER) AS suffix FROM documents""")
def suffix_match(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", has_suffix("text", RELEVANCE.suffixes).cast("int").alias("suffix"))


TOKENS = r"""tokens AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}') AS t
    FROM documents),
  grams AS (SELECT doc_id, list_concat(t, list_transform(range(1, len(t)),
      lambda i: t[i] || ' ' || t[i + 1])) AS g FROM tokens)"""


@query("tokenize_ngrams", f"""WITH {TOKENS} SELECT doc_id, len(g) AS n,
  array_to_string(g, '|') AS grams FROM grams""")
def tokenize_ngrams(spark, sf):
    grams = table(spark, sf, "documents").select("doc_id", ngrams("text").alias("g"))
    return grams.select("doc_id", F.size("g").cast("long").alias("n"),
                        F.array_join("g", "|").alias("grams"))


@query("run_stamp", """SELECT event_id, strftime(ts, '%Y%m%d_%H%M%S') AS stamp,
  strftime(ts, '%Y-%m-%dT%H:%M:%S') AS iso FROM events""")
def run_stamp_(spark, sf):
    return table(spark, sf, "events").select("event_id", run_stamp("ts").alias("stamp"),
                                             iso_stamp("ts").alias("iso"))


@query("word_count", f"SELECT doc_id, CAST({words_sql('text')} AS INTEGER) AS n FROM documents")
def word_count_(spark, sf):
    return table(spark, sf, "documents").select("doc_id", word_count("text").alias("n"))


@query("format_metrics", f"""WITH {PREDICTIONS}, m AS (
    SELECT model, dataset, {METRICS} FROM (
      SELECT model, dataset, {counts_sql()} FROM predictions GROUP BY model, dataset))
  SELECT model, dataset, round(accuracy * 100, 1) AS accuracy, round(precision, 3) AS precision,
         round(recall, 3) AS recall, round(f1, 3) AS f1 FROM m""")
def format_metrics(spark, sf):
    metrics = confusion_metrics(predictions(spark, sf), by=["model", "dataset"])
    return round_metrics(rounded(metrics, *METRIC_NAMES).drop("tp", "tn", "fp", "fn"),
                         percents=["accuracy"])

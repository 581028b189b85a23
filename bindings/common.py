"""Registry, input views and SQL fragments shared by the queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.functions.labels import label_substring, label_token_set, label_word_boundary
from cuemill.lexicons import Exclusion, RelevanceLexicon
from cuemill.operators.dedup import union_all
from cuemill.operators.filters import valid_sentence
from cuemill.operators.sentences import sentences
from cuemill.sources.tables import read_parquet

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers a query and, where SQL can say the same, its SQL."""

    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


# The tables' prose is invented, so the default lexicons would match nothing in it.
CUES = ("with", "from", "this", "that", "of the", "to the")
JUNK = ("^Licensed under", "^Released under", "is licensed under")
TRUNCATE = ("licensed under", "from the", r"with \w\w\w ")
PHRASES = ("licensed under", "that the", "©")
PATTERNS = (r"\bwith\b", r"\bfrom\b", r"\bthe?\b", r"\bof the\b")
TOPICS = ("thing", "ation of", "und ", "que de")
RELEVANCE = RelevanceLexicon(
    strong=("with", "from the", "of the", "und", "that"),
    moderate=("this", "ation", "que", "para", "the"),
    suffixes=("inc", "llc", "plc"),
    exclude=(Exclusion(("licensed under", "password")),
             Exclusion(("with", "from"), ("this", "that", "was"))))
DOMAINS = ("m.tionsh.example.net", "ththin.example.com", "thther.example.org", "ththhe.example.com",
           "blog.ththan.example.net", "m.ththth.example.net", "tionble.example.org",
           "ththon.example.org")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf}/{name}.parquet")


def pieces(spark: SparkSession, sf: str) -> DataFrame:
    """All sentence pieces of at least 5 words."""
    return sentences(table(spark, sf, "documents"), keep=["doc_id", "lang", "source"])


def valid(spark: SparkSession, sf: str) -> DataFrame:
    """Valid sentences with their word-boundary label."""
    raw = sentences(table(spark, sf, "documents"), min_word_count=0,
                    keep=["doc_id", "lang", "source"])
    return valid_sentence(raw, junk=JUNK).withColumn("label", label_word_boundary("sentence", CUES))


def articles(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as articles: the first line is the title, the rest the description."""
    title = F.substring_index("text", "\n", 1)
    return table(spark, sf, "documents").select(
        "doc_id", "lang", "source",
        F.concat(F.lit("https://"), "source", F.lit(".example.com/"), F.col("doc_id").cast("string"))
        .alias("url"),
        title.alias("title"), F.expr("substring(text, length(substring_index(text, '\n', 1)) + 2)")
        .alias("description"))


def gold(spark: SparkSession, sf: str) -> DataFrame:
    """Documents with a gold label; the English ones are the test set."""
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("gold_label"))
    docs = table(spark, sf, "documents").select("doc_id", "lang", F.col("text").alias("sentence"))
    dataset = F.when(F.col("lang") == "en", "test").otherwise("dev")
    return docs.join(labels, "doc_id").select("doc_id", "sentence", "gold_label",
                                              dataset.alias("dataset"))


MATCHERS = {"substring": label_substring, "boundary": label_word_boundary,
            "token_set": label_token_set}


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    """The gold documents with the label of each matcher, long; one scan for all."""
    labels = F.array(*[F.struct(F.lit(name).alias("model"), fn("sentence", CUES).alias("prediction"))
                       for name, fn in MATCHERS.items()])
    # The share of cues in a document, as a score with many ties.
    low = F.lower("sentence")
    share = sum((F.contains(low, F.lit(cue)).cast("int") for cue in CUES), F.lit(0)) / len(CUES)
    rows = gold(spark, sf).withColumn("probability", share).withColumn("m", F.explode(labels))
    return rows.select("doc_id", "dataset", "gold_label", "m.model", "m.prediction", "probability")


def with_position(metrics: DataFrame) -> DataFrame:
    """The order in which the models are listed."""
    place = F.lit(None)
    for i, name in enumerate(MATCHERS):
        place = F.when(F.col("model") == name, F.lit(i)).otherwise(place)
    return metrics.withColumn("position", place)


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    """Gold labels as annotators leave them: '0', '1', 'delete', 'Delete'."""
    labels = table(spark, sf, "labels")
    mark = (F.when((F.col("toxic") == 1) & (F.col("quality") == 1), "Delete")
            .when(F.col("toxic") == 1, "delete").otherwise(F.col("quality").cast("string")))
    return labels.select("doc_id", mark.alias("gold_label"))


def annotated_sentences(spark: SparkSession, sf: str) -> DataFrame:
    """Benchmark passages and the sentences of labelled documents, annotated."""
    marks = annotations(spark, sf)
    own = pieces(spark, sf).join(marks, "doc_id").select(
        F.concat(F.lit("S"), F.col("doc_id").cast("string"), F.lit("_"), F.col("pos").cast("string"))
        .alias("id"), "sentence", F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
        label_substring("sentence", CUES).alias("rule_pred"), "gold_label")
    extra = sentences(table(spark, sf, "benchmark"), keep=["item_id"]).select(
        F.concat(F.lit("B"), F.col("item_id").cast("string"), F.lit("_"), F.col("pos").cast("string"))
        .alias("id"), "sentence", F.concat(F.lit("item/"), F.col("item_id").cast("string")).alias("url"),
        label_substring("sentence", CUES).alias("rule_pred"), F.lit("1").alias("gold_label"))
    return union_all(own, extra)


# ---- SQL fragments ----

W = r"[\p{L}\p{N}_]"
NW = r"[^\p{L}\p{N}_]"


def quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def strip_sql(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def norm_sql(x: str) -> str:
    return rf"trim(regexp_replace({x}, '\s+', ' ', 'g'))"


def words_sql(x: str) -> str:
    return rf"len(regexp_extract_all({x}, '\S+'))"


def word_regex(words) -> str:
    return f"(^|{NW})({'|'.join(words)})({NW}|$)"


def boundary_sql(x: str, cues=CUES) -> str:
    return f"CAST(regexp_matches(lower({x}), '{word_regex(cues)}') AS INTEGER)"


def contains_sql(x: str, phrases) -> str:
    return "(" + " OR ".join(f"contains(lower({x}), {quote(p.lower())})" for p in phrases) + ")"


def substring_sql(x: str, cues=CUES) -> str:
    return f"CAST({contains_sql(x, cues)} AS INTEGER)"


def token_set_sql(x: str, cues=CUES) -> str:
    listed = ", ".join(quote(c) for c in cues)
    return (rf"CAST(list_has_any(string_split_regex(translate(lower({x}), ',.', '  '), '\s+'), "
            f"[{listed}]) AS INTEGER)")


def junk_sql(x: str, patterns=JUNK) -> str:
    return "(" + " OR ".join(f"regexp_matches({x}, '(?i){p}')" for p in patterns) + ")"


def split_sql(source: str, keys: str, text: str = "text") -> str:
    """All pieces of a text column, with their position from 0."""
    return rf"""SELECT {keys}, unnest(parts) AS piece, CAST(generate_subscripts(parts, 1) - 1 AS INTEGER) AS pos
    FROM (SELECT {keys}, string_split(regexp_replace({text}, '([.!?])\s+([A-Z])',
          '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM {source})"""


RAW = f"raw AS ({split_sql('documents', 'doc_id, lang, source')})"
PIECES = f"""{RAW}, pieces AS (SELECT doc_id, lang, source, pos, {strip_sql('piece')} AS sentence
  FROM raw WHERE {words_sql('piece')} >= 5)"""
VALID = f"""{RAW}, valid AS (SELECT doc_id, lang, source, pos, sentence, {boundary_sql('sentence')} AS label
  FROM (SELECT doc_id, lang, source, pos, {norm_sql('piece')} AS sentence FROM raw
        WHERE {words_sql('piece')} BETWEEN 5 AND 100) WHERE NOT {junk_sql('sentence')})"""
ARTICLES = """articles AS (SELECT doc_id, lang, source,
    'https://' || source || '.example.com/' || doc_id AS url,
    split_part(text, chr(10), 1) AS title,
    substr(text, length(split_part(text, chr(10), 1)) + 2) AS description FROM documents)"""
GOLD = """gold AS (SELECT d.doc_id, d.text AS sentence, l.quality AS gold_label,
    CASE WHEN d.lang = 'en' THEN 'test' ELSE 'dev' END AS dataset
  FROM documents d JOIN labels l USING (doc_id))"""
_SHARE = " + ".join(f"CAST(contains(lower(sentence), {quote(c)}) AS INTEGER)" for c in CUES)
PREDICTIONS = f"""{GOLD}, scored AS (SELECT *, ({_SHARE}) / {len(CUES)}.0::DOUBLE AS probability FROM gold),
  predictions AS (
    SELECT doc_id, dataset, gold_label, probability, 'substring' AS model, 0 AS position,
           {substring_sql('sentence')} AS prediction FROM scored
    UNION ALL SELECT doc_id, dataset, gold_label, probability, 'boundary', 1,
           {boundary_sql('sentence')} FROM scored
    UNION ALL SELECT doc_id, dataset, gold_label, probability, 'token_set', 2,
           {token_set_sql('sentence')} FROM scored)"""


def counts_sql(y: str = "gold_label", p: str = "prediction") -> str:
    return ", ".join(f"count(*) FILTER ({y} = {a} AND {p} = {b}) AS {name}"
                     for name, a, b in (("tp", 1, 1), ("tn", 0, 0), ("fp", 0, 1), ("fn", 1, 0)))


def ratio_sql(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif({b}, 0), 0.0)"


METRICS = ", ".join([
    f"round({ratio_sql('tp + tn', 'tp + tn + fp + fn')}, 6) AS accuracy",
    f"round({ratio_sql('tp', 'tp + fp')}, 6) AS precision",
    f"round({ratio_sql('tp', 'tp + fn')}, 6) AS recall",
    f"round({ratio_sql('2 * tp', '2 * tp + fp + fn')}, 6) AS f1"])
MACRO = (f"round(({ratio_sql('2 * tp', '2 * tp + fp + fn')} + "
         f"{ratio_sql('2 * tn', '2 * tn + fp + fn')}) / 2, 6)")
METRIC_NAMES = ("accuracy", "precision", "recall", "f1")


def excluded_sql(x: str, rules=RELEVANCE.exclude) -> str:
    """Per line: a trigger, and for rules with exceptions none after the line's last trigger."""
    tests = []
    for rule in rules:
        found = f"regexp_matches(line, '{word_regex(rule.triggers)}')"
        if rule.unless:
            tail = (f"regexp_extract(line, '^.*(?:^|{NW})(?:{'|'.join(rule.triggers)})"
                    f"((?:{NW}.*)?)$', 1)")
            found += f" AND NOT regexp_matches({tail}, '{NW}({'|'.join(rule.unless)})({NW}|$)')"
        tests.append(f"({found})")
    return (f"(len(list_filter(string_split(lower({x}), chr(10)), lambda line: "
            f"{' OR '.join(tests)})) > 0)")


def relevance_sql(lexicon: RelevanceLexicon = RELEVANCE) -> str:
    text = "lower(title || ' ' || description)"
    terms = [f"CASE WHEN contains({text}, {quote(t)}) THEN 3 ELSE 0 END + "
             f"CASE WHEN contains(lower(title), {quote(t)}) THEN 2 ELSE 0 END" for t in lexicon.strong]
    terms += [f"CASE WHEN contains({text}, {quote(t)}) THEN 1 ELSE 0 END" for t in lexicon.moderate]
    terms.append(f"CASE WHEN regexp_matches(title, '(^|{NW})[A-Z]{{1,5}}({NW}|$)') THEN 2 ELSE 0 END")
    terms.append(f"CASE WHEN {contains_sql(text, lexicon.suffixes)} THEN 1 ELSE 0 END")
    return (f"CASE WHEN {excluded_sql(text, lexicon.exclude)} THEN -1 ELSE "
            + " + ".join(terms) + " END")


SCORED = f"""{ARTICLES}, scored AS (SELECT *, CAST({relevance_sql()} AS INTEGER) AS relevance_score
  FROM articles)"""
ANNOTATIONS = """marks AS (SELECT doc_id, CASE WHEN toxic = 1 AND quality = 1 THEN 'Delete'
    WHEN toxic = 1 THEN 'delete' ELSE CAST(quality AS VARCHAR) END AS gold_label FROM labels)"""
ANNOTATED = f"""{PIECES}, {ANNOTATIONS},
  braw AS ({split_sql('benchmark', 'item_id')}),
  bpieces AS (SELECT item_id, pos, {strip_sql('piece')} AS sentence FROM braw
              WHERE {words_sql('piece')} >= 5),
  annotated AS (
    SELECT 'S' || doc_id || '_' || pos AS id, sentence, 'doc/' || doc_id AS url,
           {substring_sql('sentence')} AS rule_pred, gold_label
    FROM pieces JOIN marks USING (doc_id)
    UNION ALL SELECT 'B' || item_id || '_' || pos, sentence, 'item/' || item_id,
           {substring_sql('sentence')}, '1' FROM bpieces)"""

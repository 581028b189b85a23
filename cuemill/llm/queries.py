"""Registered queries of the corpus operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuemill.llm.decontaminate import benchmark_matches
from cuemill.llm.langid import language_id
from cuemill.llm.licenses import license_scan
from cuemill.llm.manifest import merkle_manifest
from cuemill.llm.mixing import mix_plan
from cuemill.llm.personal import personal_data
from cuemill.llm.quality import quality_scores
from cuemill.llm.simhash import simhash_components
from cuemill.llm.spelling import spelling_variants
from cuemill.llm.substrings import substring_dedup
from cuemill.llm.tokens import read_token_documents, write_token_shards
from cuemill.llm.topk import exact_topk
from cuemill.llm.urls import LINK, LOWER, RULES, UPPER, url_filter
from cuemill.session import scratch_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(read(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


ORACLES["op1_exact_topk"] = r"""
WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * x::DOUBLE) AS DOUBLE)) AS v
           FROM embeddings WHERE embedding IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
      FROM e q JOIN e c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 50 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
WHERE rank <= 5"""


@query
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_components(read(spark, sf_dir, "documents"))


@query
def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(read(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "place", "source_blocks")


ORACLES["op3_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
                  md5('17:' || doc_id) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, 2.0::DOUBLE * source_size AS most,
       CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS weight
      FROM s),
c AS (SELECT *, coalesce(sum(most) OVER lower_, 0) AS held, sum(weight) OVER upper_ AS free,
             row_number() OVER (ORDER BY most / weight, source) AS k,
             1.5::DOUBLE * (SELECT sum(source_size) FROM s) AS total
      FROM w WINDOW lower_ AS (ORDER BY most / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
                    upper_ AS (ORDER BY most / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
lvl AS (SELECT arg_min((total - held) / free, k) FILTER (weight * ((total - held) / free) < most) AS level FROM c),
t AS (SELECT source, source_size, CASE WHEN level IS NULL OR weight * level >= most THEN most ELSE weight * level END AS target
      FROM w, lvl),
g AS (SELECT *, floor(target + 0.5)::BIGINT AS goal FROM t),
b AS (SELECT greatest(1, ceil(sum(goal) / 16384.0))::BIGINT AS block FROM g),
p AS (SELECT d.doc_id, size, source_size, target, goal, ceil(goal / block::DOUBLE)::BIGINT AS source_blocks,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h, doc_id, size
                                      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS place
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source, b)
SELECT doc_id, size::BIGINT AS size, source_size, target, place, source_blocks,
       (greatest(0, least(size, goal - place)) + greatest(0, least(size, goal - place - source_size)))::BIGINT AS taken
FROM p"""


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(read(spark, sf_dir, "documents"))


@query
def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(read(spark, sf_dir, "documents"))


@query
def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(read(spark, sf_dir, "pages")).drop("trust", "distrust")


def _url_sql() -> str:
    """The rules, the host graph and both ranks as sums over walks of every length, until they vanish."""
    upper, lower = UPPER, LOWER
    ordered = sorted(RULES, key=lambda r: (-len(r[0]), r[0]))

    def fits(text: str) -> str:
        host, path = text.split("/", 1)
        return f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '/{path}')"

    rule = " ".join(f"WHEN {fits(t)} THEN '{t}'" for t, _ in ordered)
    says = " ".join(f"WHEN {fits(t)} THEN '{v}'" for t, v in ordered)
    link = LINK.replace("'", "''")
    return rf"""WITH RECURSIVE u AS (SELECT page_id, html,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{upper}', '{lower}') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
  j AS (SELECT page_id, host, path, html, CASE {rule} END AS rule, CASE {says} END AS says FROM u),
  found AS (SELECT host AS src, translate(unnest(list_distinct(regexp_extract_all(html, '{link}', 1))), '{upper}', '{lower}') AS dst
    FROM j WHERE host <> ''),
  hosts AS (SELECT host FROM j WHERE host <> '' UNION SELECT dst FROM found WHERE dst <> src),
  parts AS (SELECT DISTINCT array_to_string(l[i:], '.') AS src, array_to_string(l[i + 1:], '.') AS dst
    FROM (SELECT l, unnest(range(1, len(l) - 1)) AS i FROM (SELECT string_split(host, '.') AS l FROM hosts))),
  edges AS (SELECT src, dst, sum(n)::DOUBLE AS n FROM (
      SELECT src, dst, 1 AS n FROM found WHERE src <> dst UNION ALL SELECT src, dst, 1 FROM parts
      UNION ALL SELECT dst, src, 1 FROM parts) GROUP BY src, dst),
  both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM edges UNION ALL SELECT 'distrust', dst, src, n FROM edges),
  steps AS MATERIALIZED (SELECT kind, src, dst, 0.85::DOUBLE * n / sum(n) OVER (PARTITION BY kind, src) AS p FROM both_ways),
  seeds AS (SELECT 'trust' AS kind, host, count(*) AS n FROM j WHERE says = 'allow' AND host <> '' GROUP BY host
    UNION ALL SELECT 'distrust', host, count(*) FROM j WHERE says = 'block' AND host <> '' GROUP BY host),
  walks AS (SELECT 0 AS len, kind, host, 0.15::DOUBLE * n / sum(n) OVER (PARTITION BY kind) AS rank FROM seeds
    UNION ALL SELECT w.len + 1, s.kind, s.dst, sum(w.rank * s.p) FROM walks w JOIN steps s ON w.kind = s.kind AND w.host = s.src
    GROUP BY w.len, s.kind, s.dst HAVING sum(w.rank * s.p) > 1e-18),
  score AS (SELECT host, coalesce(sum(rank) FILTER (kind = 'trust'), 0) AS t,
      coalesce(sum(rank) FILTER (kind = 'distrust'), 0) AS d FROM walks GROUP BY host)
  SELECT page_id, j.host, path, rule,
    coalesce(says, CASE WHEN round(d / (t + d), 3) > 0.5 THEN 'block' ELSE 'allow' END) AS verdict
  FROM j LEFT JOIN score s ON s.host = j.host"""


ORACLES["op7_url_filter"] = _url_sql()


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(read(spark, sf_dir, "documents"), with_text=False)


@query
def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return benchmark_matches(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query
def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "tokens")
    write_token_shards(read(spark, sf_dir, "documents"), path,
                       public_tokenizers.path("byte_bpe_50k.json"))
    return read_token_documents(spark, path)


# CRC-32 of a text of code points below U+0100, with the table of its 256 byte steps from the polynomial.
CRC_TABLE = """crc AS MATERIALIZED (SELECT list(step ORDER BY i) AS t FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0],
    lambda a, x: CASE WHEN a & 1 = 1 THEN xor(3988292384, a >> 1) ELSE a >> 1 END) AS step FROM range(256) r(i)))"""


def _crc_sql(text: str) -> str:
    """The unsigned CRC-32 of a text's UTF-8; the table is in scope as crc.t."""
    octets = (f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)::BIGINT] "
              "ELSE [(192 | (ord(c) >> 6))::BIGINT, (128 | (ord(c) & 63))::BIGINT] END))")
    return (f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), "
            "lambda a, b: xor(a >> 8, crc.t[(xor(a, b) & 255) + 1])))")


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest(read(spark, sf_dir, "documents"))


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"coalesce(strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')"
                                   for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLES["op11_merkle_manifest"] = f"""
WITH RECURSIVE {CRC_TABLE},
d AS (SELECT doc_id, source, {_leaf_sql('text')} AS leaf, CASE WHEN {_crc_sql('doc_id::VARCHAR')} % 5 = 0
        THEN {_leaf_sql(f"translate(text, '{UPPER}', '{LOWER}')")} END AS claim FROM documents, crc),
p AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS g, count(*) OVER (PARTITION BY source) AS n,
        row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d),
nodes AS (SELECT 0 AS lvl, g, n, pos AS idx, leaf AS h FROM p
  UNION ALL SELECT lvl + 1, g, (n + 15) // 16, idx // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes
    WHERE n > 1 GROUP BY lvl, g, n, idx // 16),
upper_nodes AS (SELECT 0 AS lvl, (SELECT count(DISTINCT g) FROM p) AS n, g AS idx, h FROM nodes WHERE n = 1
  UNION ALL SELECT lvl + 1, (n + 15) // 16, idx // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM upper_nodes
    WHERE n > 1 GROUP BY lvl, n, idx // 16),
depth AS (SELECT g, max(lvl) AS top FROM nodes GROUP BY g),
-- A row's place among the nodes of each level, of its source's tree and of the tree above.
own AS (SELECT p.g, p.pos, w.lvl AS k, p.pos // (16 ** w.lvl)::BIGINT AS mine, w.idx, w.h
  FROM p JOIN nodes w ON w.n > 1 AND w.g = p.g AND w.idx // 16 = p.pos // (16 ** (w.lvl + 1))::BIGINT
  UNION ALL SELECT p.g, p.pos, top + u.lvl, p.g // (16 ** u.lvl)::BIGINT, u.idx, u.h
  FROM p JOIN depth USING (g) JOIN upper_nodes u ON u.n > 1 AND u.idx // 16 = p.g // (16 ** (u.lvl + 1))::BIGINT),
steps AS (SELECT g, pos, k, coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx < mine), '') AS before,
    coalesce(string_agg(h, '' ORDER BY idx) FILTER (idx > mine), '') AS after FROM own GROUP BY g, pos, k),
fold AS (SELECT g, pos, 0 AS k, coalesce(claim, leaf) AS h FROM p
  UNION ALL SELECT f.g, f.pos, f.k + 1, sha256(s.before || f.h || s.after) FROM fold f JOIN steps s USING (g, pos, k)),
ends AS (SELECT g, pos, arg_max(h, k) AS h FROM fold GROUP BY g, pos),
proof AS (SELECT g, pos, sha256(string_agg(before || after, '' ORDER BY k)) AS proof FROM steps GROUP BY g, pos),
root AS (SELECT h FROM upper_nodes WHERE n = 1)
SELECT doc_id, leaf, t.h AS subroot, root.h AS root, coalesce(proof, sha256('')) AS proof_sha256, ends.h AS folded_root,
  ends.h = root.h AS verified
FROM root, p JOIN ends USING (g, pos) LEFT JOIN proof USING (g, pos) JOIN nodes t ON t.g = p.g AND t.n = 1"""


@query
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(read(spark, sf_dir, "documents"))


# Near words by deletion: two words share what is left without the code point at one place, or one
# is what is left of the other.
ORACLES["op12_spelling_variants"] = rf"""
WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{C0}}-\x{{FF}}]+')), '{UPPER}', '{LOWER}') AS run
  FROM documents),
own AS (SELECT doc_id, run, count(*) AS m FROM runs GROUP BY doc_id, run),
hashed AS (SELECT run, m, {_crc_sql("(doc_id || ':' || run)")} AS h FROM own, crc),
slips AS (SELECT m, CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % len(run))::BIGINT) || substr(run, (h % len(run))::BIGINT + 2)
    ELSE run END AS word FROM hashed),
w AS MATERIALIZED (SELECT word, sum(m)::BIGINT AS n FROM slips WHERE len(word) >= 5 GROUP BY word HAVING sum(m) >= 3),
cut AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(len(word))) AS i FROM w)),
longer AS (SELECT DISTINCT cut.word AS a, cut.n AS an, w.word AS b, w.n AS bn FROM cut JOIN w ON cut.rest = w.word),
near AS (SELECT DISTINCT a.word AS a, b.word AS b, b.n AS bn FROM cut a JOIN cut b USING (rest, i) WHERE a.word <> b.word
  UNION ALL SELECT a, b, bn FROM longer UNION ALL SELECT b, a, an FROM longer),
best AS (SELECT a, count(*) AS n_near, max(bn) AS most, arg_min(b, struct_pack(m := -bn, b := b)) AS b FROM near GROUP BY a),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 2 * n THEN b END AS form,
    CASE WHEN most >= 2 * n THEN most END AS form_n FROM w LEFT JOIN best ON a = word),
chain AS (SELECT word, word AS root, form AS onward FROM f
  UNION ALL SELECT c.word, f.word, f.form FROM chain c JOIN f ON c.onward = f.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN chain c ON c.word = f.word AND c.onward IS NULL"""


@query
def op13_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(read(spark, sf_dir, "documents"))

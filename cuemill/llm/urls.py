"""URL filters: longest host and path rule, else trust and distrust spread over the host graph.

Native DataFrame code only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"),
         ("com/fr/", "allow"), ("com/de/", "block"))
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
#: Hosts of absolute and scheme-relative links.
LINK = r"""(?i)href\s*=\s*["']?\s*(?:https?:)?//([^/?#"'\s>]+)"""

#: Rounds of the rank between two tables in shared storage.
ROUNDS_A_TABLE = 8
#: Steps, and seeds, some 60 bytes each, up to which a graph is short: one task takes all its rounds.
SHORT = 200_000


def url_host_path(url: str | Column) -> tuple[Column, Column]:
    host = F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER)
    return F.coalesce(host, F.lit("")), F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits (of equal ones the first by text) and its verdict, else null."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), [-ord(c) for c in r[0]])):
        own, _, rest = text.partition("/")
        fits = (((host == own) | F.endswith(host, F.lit("." + own)))
                & F.startswith(path, F.lit("/" + rest)))
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, html_col: str) -> DataFrame:
    """``src, dst, n``: links between hosts, and steps between a host and its parent domains.

    Links inside a host say nothing about others and are left out. A subdomain answers for its
    parent domain and the other way round, so each level counts as one link both ways.
    """
    links = pages.where("host <> ''").select("host", F.explode(F.array_distinct(F.regexp_extract_all(
        F.col(html_col), F.lit(LINK), F.lit(1)))).alias("to"))
    links = links.select(F.col("host").alias("src"), F.translate("to", UPPER, LOWER).alias("dst"))
    links = links.where("src <> dst").groupBy("src", "dst").agg(F.count("*").cast("double").alias("n"))
    hosts = pages.select("host").union(links.select("dst")).where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    chain = F.transform(F.sequence(F.lit(1), F.greatest(F.size(labels) - 1, F.lit(1))), lambda i: F.array_join(
        F.slice(labels, i, F.size(labels)), "."))
    # Pairs (host, parent) along the chain, top-level domains left out.
    steps = hosts.select(F.explode(F.arrays_zip(
        chain.alias("a"), F.slice(chain, F.lit(2), F.size(chain)).alias("b"))).alias("s"))
    steps = steps.select(F.col("s.a").alias("src"), F.col("s.b").alias("dst")).where("dst IS NOT NULL").distinct()
    both = steps.union(steps.select("dst", "src")).withColumn("n", F.lit(1.0))
    return links.union(both).groupBy("src", "dst").agg(F.sum("n").alias("n"))


def spread(edges: DataFrame, seeds: DataFrame, damping: float, tolerance: float) -> DataFrame:
    """``host, trust, distrust``: personalised PageRank of both kinds of seeds.

    Trust follows links from allowed seeds; distrust follows them backwards from blocked seeds: who
    links to a blocked host is suspect. Both run as one table of (kind, host); each round is one
    join and one pre-aggregated sum, written to shared storage every eighth round. Rank that a
    host without links would pass on stays with the seeds, by the restart.

    Ranks only grow from round to round. They are settled when in eight rounds no host has gained
    its first rank or more than ``tolerance`` of its rank; hosts far from every seed, whose ranks
    are small, are held to the same share as near ones. As a round adds at most ``damping`` times what
    the one before added, this ends after some log(tolerance) / log(damping) rounds behind the
    longest way from a seed, whatever the number of hosts.
    """
    forward = edges.select(F.lit("trust").alias("kind"), "src", "dst", "n")
    back = edges.select(F.lit("distrust").alias("kind"), F.col("dst").alias("src"), F.col("src").alias("dst"), "n")
    steps = forward.union(back)
    out = steps.groupBy("kind", "src").agg(F.sum("n").alias("total"))
    steps = written(steps.join(out, ["kind", "src"]).select(
        "kind", "src", "dst", (damping * F.col("n") / F.col("total")).alias("p")), "steps")
    both = F.array(F.struct(F.lit("trust").alias("kind"), F.col("allowed").alias("n")),
                   F.struct(F.lit("distrust").alias("kind"), F.col("blocked").alias("n")))
    seeds = seeds.select("host", F.explode(both).alias("s")).select("s.kind", "host", F.col("s.n").cast("double").alias("n"))
    sums = seeds.groupBy("kind").agg(F.sum("n").alias("total"))
    restart = written(seeds.where("n > 0").join(F.broadcast(sums), "kind").select(  # two rows
        "kind", "host", (F.col("n") / F.col("total")).alias("rank")), "seeds")
    # The rounds over short tables run in one task: every exchange would leave files by the square of the partitions.
    short = all(t.limit(SHORT + 1).count() <= SHORT for t in (steps, restart))
    together = (lambda df: df.coalesce(1)) if short else (lambda df: df)
    steps, restart = together(steps), together(restart)
    base = restart.withColumn("rank", F.col("rank") * (1 - damping))
    rank, growth = base, 1.0
    while growth > tolerance:
        before = rank.select("kind", "host", F.lit(0.0).alias("rank"), F.col("rank").alias("was"))
        for _ in range(ROUNDS_A_TABLE):
            passed = rank.withColumnRenamed("host", "src").join(steps, ["kind", "src"]).select(
                "kind", F.col("dst").alias("host"), (F.col("rank") * F.col("p")).alias("rank"))
            rank = together(passed.union(base)).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        both = together(rank.withColumn("was", F.lit(0.0)).union(before))
        both = written(both.groupBy("kind", "host").agg(F.sum("rank").alias("rank"), F.sum("was").alias("was")), "rank")
        growth = both.where("rank > 0").agg(F.max(1 - F.col("was") / F.col("rank"))).first()[0] or 0.0
        rank = together(both.drop("was"))
    one = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("rank"))), F.lit(0.0))
    return rank.groupBy("host").agg(one("trust").alias("trust"), one("distrust").alias("distrust"))


def url_filter(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url",
               html_col: str = "html", rules: Sequence[tuple[str, str]] = RULES,
               damping: float = 0.85, tolerance: float = 1e-5, threshold: float = 0.5) -> DataFrame:
    """``id, host, path, rule, verdict`` and the host's ``trust`` and ``distrust`` per page.

    A rule ``host/path`` fits its host and all subdomains if the path starts with the rule's; the
    longest rule decides. Pages without a rule are blocked if distrust makes up more than
    ``threshold`` (beyond the third digit) of what has reached their host when ranks have settled
    to ``tolerance``; a host that nothing reaches is allowed. Seeds are
    the pages that a rule allows or blocks, counted per host. A null url, or one without ``://``,
    has an empty host and path, fits no rule and is allowed; a null html has no links. Every row
    gives one row. The host table is as long as there are hosts; it meets the pages in a plain
    join, broadcast only when Spark measures it as small, else split where a host is hot.
    """
    host, path = url_host_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"), F.col(html_col).alias("html"))
    rule, says = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("says", says)
    links = written(host_edges(rows, "html"), "links")
    judged = written(rows.drop("html"), "judged")
    seeds = judged.where("host <> ''").groupBy("host").agg(
        F.count(F.when(F.col("says") == "allow", 1)).alias("allowed"),
        F.count(F.when(F.col("says") == "block", 1)).alias("blocked"))
    scores = spread(links, seeds, damping, tolerance)
    # Compared after rounding: neither the order of additions nor what is not settled may decide.
    doubt = F.round(F.col("distrust") / (F.col("trust") + F.col("distrust")), 3) > threshold
    return judged.join(scores, "host", "left").select(
        F.col("id").alias(id_col), "host", "path", "rule",
        F.coalesce("says", F.when(doubt, "block").otherwise("allow")).alias("verdict"), "trust", "distrust")

"""Personal data: fixed patterns, and unseen identifiers by bootstrapped contexts. Native DataFrame code only.

What the fixed patterns find are seeds. The words before them are lexical patterns; a pattern that
introduces mostly one kind of known identifier vouches for the other identifier-like tokens behind
it, and what is vouched for well enough counts as known in the next round.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuemill.llm.common import written

# The kinds, in their order, and what they look like. The matches are those of the plain
# patterns in the comments; possessive loops and starts only where a run starts keep long runs of
# one class linear and off the stack.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ ; a match may start in a run right behind another match.
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 16 to 19 digits: whole runs of digits with single separators.
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){15,18}+(?![\x20-]?[0-9])",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: A text that a kind's matches must hold; others are not searched.
NEEDED = {"email": "@", "phone": "+"}
#: Tokens that may be identifiers: those with a digit or an at sign.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
CORE = r"""^["'(\[<{]*+(.*?)[\])>}"'.,;:!?]*$"""
OPENING = r"""^["'(\[<{]*+"""
#: Code points before a find that its context is taken from.
TAIL = 100


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether every second digit from the right, doubled, and the others add up to a multiple of ten."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    place = F.sequence(F.lit(1), F.length(digits))
    total = F.aggregate(place, F.lit(0), lambda s, i: s + F.when(
        F.pmod(F.length(digits) - i, F.lit(2)) == 1, doubled(F.substr(digits, i, F.lit(1)).cast("int")))
        .otherwise(F.substr(digits, i, F.lit(1)).cast("int")))
    return total % 10 == 0


def is_valid(kind: str, text: Column) -> Column:
    """The test that a match must pass."""
    if kind == "ip":
        small = lambda p: F.length(F.regexp_replace(p, "^0+", "")) <= 3
        return F.forall(F.split(text, r"\."), lambda p: small(p) & F.when(
            small(p), F.coalesce(F.right(p, F.lit(3)).cast("int"), F.lit(0)) <= 255).otherwise(False))
    if kind == "card":
        return F.length(_digits(text)).between(16, 19) & _luhn(_digits(text))
    if kind == "phone":
        return F.length(_digits(text)).between(8, 15)
    return F.lit(True)


def _context(gap: Column) -> Column:
    """The lexical patterns of a find: its last word before if that ends with ``:`` or ``=``, and its
    last two words before; none at the start of a text."""
    tail = F.lower(F.right(gap, F.lit(TAIL)))
    label = F.regexp_extract(tail, r"(\S*[:=])\s*$", 1)
    words = F.regexp_extract(tail, r"(\S+\s+\S+)\s*$", 1)
    both = F.array(F.when(label != "", label), F.when(words != "", F.regexp_replace(words, r"\s+", " ")))
    return F.filter(both, lambda p: p.isNotNull())


def _hits(text: Column, kind: str, pattern: str) -> Column:
    """All matches of a pattern as an array, with the code points since the match before."""
    gaps = F.arrays_zip(F.split(text, pattern, -1).alias("gap"),
                        F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
    core = lambda h: F.regexp_extract(h, "(?s)" + CORE, 1)
    opening = lambda h: F.length(F.regexp_extract(h, OPENING, 0))
    found = F.transform(F.filter(gaps, lambda g: g["hit"].isNotNull()), lambda g: F.struct(
        F.length(g["gap"]).cast("long").alias("gap"), F.length(g["hit"]).cast("long").alias("length"),
        (opening(g["hit"]) if kind == "token" else F.lit(0)).cast("long").alias("lead"),
        F.lower(core(g["hit"]) if kind == "token" else g["hit"]).alias("instance"),
        (F.lit(True) if kind == "token" else is_valid(kind, g["hit"])).alias("valid"),
        _context(g["gap"]).alias("patterns")))
    if kind in NEEDED:
        return F.when(F.contains(text, F.lit(NEEDED[kind])), found)
    return F.when(F.rlike(text, F.lit("[0-9]" if kind != "token" else "[0-9@]")), found)


def finds(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """The rows ``row, id`` and everything found in them: ``row, kind, start, end, instance,
    patterns``, base finds by kind, tokens that overlap none of them as kind ``token``.

    Texts are read once; matches, contexts and gaps are written. Places follow from running sums of gaps
    and lengths per row and kind, over the finds alone.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kinds = [*KINDS, "token"]
    rows = written(docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(f"`{id_col}`").alias("id"),
        *[_hits(text, k, PATTERNS.get(k, TOKEN)).alias(f"h_{k}") for k in kinds]), "finds")
    flat = None
    for k in kinds:
        one = rows.select("row", F.lit(k).alias("kind"), F.posexplode(f"h_{k}").alias("nth", "h"))
        flat = one if flat is None else flat.union(one)
    flat = flat.select("row", "kind", "nth", "h.*")
    upto = Window.partitionBy("row", "kind").orderBy("nth")
    placed = flat.withColumn("stop", F.sum(F.col("gap") + F.col("length")).over(upto))
    start = F.col("stop") - F.col("length") + F.col("lead")
    placed = placed.where("valid").select("row", "kind", start.alias("start"), F.when(
        F.col("kind") == "token", start + F.length("instance")).otherwise(F.col("stop")).alias("end"), "instance", "patterns")
    # A token that overlaps a base find is that find, not an unseen one.
    before = Window.partitionBy("row").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    after = Window.partitionBy("row").orderBy(F.desc("start"), F.desc("end")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    base = F.col("kind") != "token"
    marked = placed.withColumns({"reach": F.max(F.when(base, F.col("end"))).over(before),
                                 "next": F.min(F.when(base, F.col("start"))).over(after)})
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & F.coalesce(F.col("next") >= F.col("end"), F.lit(True))
    kept = marked.where(base | clear).drop("reach", "next")
    return rows.select("row", "id"), written(kept, "places")


def bootstrap(occurrences: DataFrame, *, support: int = 3, confidence: float = 0.5, accept: float = 0.6,
              min_length: int = 6) -> DataFrame:
    """``instance, kind, score`` of the unseen identifiers, from ``kind, instance, patterns``.

    The graph has an edge for every distinct pair of pattern and instance, whatever the number of
    their meetings, so a frequent pattern or instance is summed up inside the tasks. A pattern vouches
    for a kind if at least ``support`` of its instances are known as that kind, and at least
    ``confidence`` of all; its weight is known / (all + 1). An instance's score is
    1 - product of (1 - weight) over the patterns that vouch for it; from ``accept`` on it is known.
    Known instances only grow in number, so the order of events does not matter; rounds go on until
    none is added. Tokens of fewer than ``min_length`` code points are no identifiers.
    """
    spark = occurrences.sparkSession
    seen = occurrences.where((F.col("kind") != "token") | (F.length("instance") >= min_length))
    pairs = seen.select(F.explode("patterns").alias("pattern"), "instance", F.when(F.col("kind") != "token", F.col("kind")).alias("kind"))
    edges = written(pairs.groupBy("pattern", "instance").agg(F.array_sort(F.collect_set("kind")).alias("seeds")), "edges")
    sizes = written(edges.groupBy("pattern").agg(F.count("*").alias("n"), F.count(F.when(F.size("seeds") > 0, 1)).alias("s"))
                    .where(F.col("n") >= support), "sizes")
    seeds = edges.select("pattern", "instance", F.explode("seeds").alias("kind"))
    known_edges, accepted, before = seeds, None, 0
    while True:
        vouching = known_edges.groupBy("pattern", "kind").agg(F.count("*").alias("k")).where(F.col("k") >= support).join(
            sizes, "pattern").where(F.col("k") >= confidence * F.col("n")).select(
            "pattern", "kind", F.log1p(-F.col("k") / (F.col("n") + 1)).alias("doubt"))
        # Only instances that no base pattern knows can be found.
        open_edges = edges.where(F.size("seeds") == 0).select("pattern", "instance")
        scores = open_edges.join(vouching, "pattern").groupBy("instance", "kind").agg(F.sum("doubt").alias("doubt"))
        # Rounded: the order of additions must not decide.
        found = written(scores.select("instance", "kind", F.round(1 - F.exp("doubt"), 9).alias("score"))
                        .where(F.col("score") >= accept), "accepted")
        n = found.count()
        if n == before:
            return accepted if accepted is not None else spark.createDataFrame([], found.schema)
        accepted, before = found, n
        known_edges = seeds.union(edges.where(F.size("seeds") == 0).select("pattern", "instance").join(
            found.select("instance", "kind"), "instance").select("pattern", "instance", "kind"))


def _listed(spans: Column) -> Column:
    """``kind:start:end`` of spans (kind number, start, end), by kind and start."""
    name = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(
        ":", F.element_at(name, s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans`` per row.

    Base spans are the leftmost matches of each kind that pass its test; ``spans`` adds, under the kind
    of the contexts that vouch for it (the best score, of equal ones the first kind), every
    place of an unseen identifier that overlaps no base span. Places count code points, the end is
    exclusive. A null or empty text has no spans and the digest of an empty text. Repeated rows and null ids
    have a result each. A row's finds are gathered in one place, as its text is. See :func:`bootstrap` for the options.
    """
    rows, found = finds(docs, id_col, text_col)
    unseen = bootstrap(found, **options)
    number = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind")).cast("int") - 1
    best = unseen.groupBy("instance").agg(F.min(F.struct((-F.col("score")).alias("s"), number.alias("k"))).alias("b")).select(
        "instance", "b.k")
    base = found.where("kind <> 'token'").select("row", F.struct(number.alias("k"), "start", "end").alias("s"), F.lit(True).alias("base"))
    more = found.where("kind = 'token'").join(best, "instance").select(
        "row", F.struct("k", "start", "end").alias("s"), F.lit(False).alias("base"))
    of_kind = [F.count(F.when(F.col("base") & (F.col("s.k") == i), 1)).alias(f"n_{k}") for i, k in enumerate(KINDS)]
    gathered = base.union(more).groupBy("row").agg(
        *of_kind, F.collect_list(F.when(F.col("base"), F.col("s"))).alias("own"), F.collect_list("s").alias("all"))
    gathered = gathered.select("row", *[f"n_{k}" for k in KINDS], _listed(F.col("own")).alias("own"), _listed(F.col("all")).alias("all"))
    return rows.join(gathered, "row", "left").select(
        F.col("id").alias(id_col), *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.coalesce("own", F.lit("")), 256).alias("base_sha256"), F.coalesce("all", F.lit("")).alias("spans"))

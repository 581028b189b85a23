"""Cue lists too long for one expression: an index of cues by a run of their units.

Matches as ``label_word_boundary``, for a table of cues of any length. Texts and cues are cut into units, words
and single other characters. A cue that is found is a run of the text's units, so cues of up to ``WIDEST`` units
are looked up as they are, among the text's runs of their length. A longer one is looked up by the run of
``WIDEST`` units that fewest cues hold, and its expression decides.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions.patterns import BOUNDARY, NOT_AFTER_WORD, NOT_BEFORE_WORD, WORD
from cuemill.functions.text import col, with_computed
from cuemill.session import stored

#: A word, or any other single character.
_UNIT = f"{WORD}+|(?s:.)"
#: The same within a longer expression: a word is taken whole.
_EACH = rf"(?:{WORD}++|[^\p{{L}}\p{{N}}_])"
#: Units of the longest cue that is looked up as it is.
WIDEST = 8


def _expression(low: Column) -> Column:
    """The cue as text between word boundaries."""
    quoted = F.concat(F.lit(r"\Q"), F.replace(low, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    before = F.when(low.rlike(f"^{WORD}"), F.lit(NOT_AFTER_WORD)).otherwise(F.lit(f"(?<={WORD})"))
    behind = F.when(low.rlike(rf"{WORD}\z"), F.lit(NOT_BEFORE_WORD)).otherwise(F.lit(f"(?={WORD})"))
    return F.concat(before, quoted, behind)


def _runs(low: Column, length: int) -> Column:
    """All distinct runs of ``length`` units."""
    return F.array_distinct(F.regexp_extract_all(low, F.lit(rf"(?:(?<!{WORD})|(?!{WORD}))(?=({_EACH}{{{length}}}))"), F.lit(1)))


def _free_runs(low: Column, lengths: Sequence[int]) -> Column:
    """The distinct runs that can be a cue of ``lengths`` units: with a boundary at both ends."""
    runs = [F.regexp_extract_all(low, F.lit(rf"{BOUNDARY}(?=({_EACH}{{{m}}}){BOUNDARY})"), F.lit(1)) for m in lengths]
    return F.array_distinct(F.concat(*runs, F.array().cast("array<string>")))


def lexicon_index(cues: DataFrame, cue: str = "cue") -> DataFrame:
    """``(key, cue, n, expression)``: each distinct lower-cased cue once; null and empty cues are left out.

    A cue of ``n`` units, up to ``WIDEST``, is its own key and needs no expression. The key of a longer one is
    the run of ``WIDEST`` units that fewest cues hold, of these the first by text: a frequent beginning thus
    gathers no long list.
    """
    lows = stored(cues.select(F.lower(col(cue)).alias("cue")).where("cue <> ''").distinct()
                  .withColumn("n", F.regexp_count("cue", F.lit(_UNIT))), "cues")
    short = lows.where(F.col("n") <= WIDEST).select(
        F.col("cue").alias("key"), "cue", "n", F.lit(None).cast("string").alias("expression"))
    held = lows.where(F.col("n") > WIDEST).select("cue", "n", F.explode(_runs(F.col("cue"), WIDEST)).alias("key"))
    many = held.groupBy("key").agg(F.count("*").alias("many"))
    best = held.join(many, "key").groupBy("cue", "n").agg(F.min(F.struct("many", "key")).alias("best"))
    return short.union(best.select("best.key", "cue", "n", _expression(F.col("cue")).alias("expression")))


def lexicon_hits(
    df: DataFrame, cues: DataFrame, keys: Sequence[str], text: str = "text", cue: str = "cue",
    max_bytes: int = 32 << 20,
) -> DataFrame:
    """``(*keys, cue)``: the distinct cues found in the texts of each key, ignoring case.

    The index is written and its size measured: up to ``max_bytes`` it is sent to the tasks and texts stay
    where they lie; a longer one meets the texts' distinct runs in a join on the key, where a hot run is
    split at run time. Pairs with a cue of more than ``WIDEST`` units go back to their text by ``keys``. Rows that
    share their keys give their cues together; null keys are keys like others. A null text holds no cue.
    """
    index = stored(lexicon_index(cues, cue), "lexicon")
    of = lambda test, value: F.sum(F.when(test, value))
    is_long = F.col("n") > WIDEST
    # At most WIDEST lengths.
    size, lengths, n_long = index.agg(
        F.sum(F.octet_length("key") + F.octet_length("cue") + F.coalesce(F.octet_length("expression"), F.lit(0)) + 48),
        F.collect_set(F.when(~is_long, F.col("n"))), of(is_long, 1)).first()
    sent = (lambda part: F.broadcast(part)) if (size or 0) <= max_bytes else (lambda part: part)
    names = [f"k{i}" for i in range(len(keys))]
    rows = df.select(*[col(k).alias(n) for k, n in zip(keys, names)], F.lower(col(text)).alias("low")).where("low <> ''")
    runs = _free_runs(F.col("low"), sorted(lengths))
    short = index.where(~is_long).select("key", "cue")
    pairs = with_computed(rows, "runs", runs).select(*names, F.explode("runs").alias("key")).join(sent(short), "key").select(*names, "cue")
    if n_long:
        kept = stored(rows, "texts")
        words = with_computed(kept, "runs", _runs(F.col("low"), WIDEST)).select(*names, F.explode("runs").alias("key")).distinct()
        near = words.join(sent(index.where(is_long)), "key").drop("key").alias("n")
        same = [F.col(f"n.{n}").eqNullSafe(F.col(f"t.{n}")) for n in names]
        found = F.contains("low", F.col("cue")) & F.expr("low rlike expression")
        pairs = pairs.union(near.join(kept.alias("t"), same).select("t.*", "n.cue", "n.expression")
                            .where(found).select(*names, "cue"))
    return pairs.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], "cue").distinct()


def label_lexicon(
    df: DataFrame, cues: DataFrame, keys: Sequence[str], text: str = "text", cue: str = "cue",
    max_bytes: int = 32 << 20,
) -> DataFrame:
    """``(*keys, label, n_cues, first_cue)``, one row per key: whether, how many and which first by text."""
    hits = lexicon_hits(df, cues, keys, text, cue, max_bytes)
    rows = df.select(*keys, F.lit(None).cast("string").alias("cue")).unionByName(hits)
    return rows.groupBy(*keys).agg(
        F.max(F.col("cue").isNotNull().cast("int")).alias("label"),
        F.count("cue").alias("n_cues"), F.min("cue").alias("first_cue"))

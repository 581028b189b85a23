"""Text columns: white space, sentences, words, n-grams, stamps and the seeded order."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuemill.functions.patterns import (
    NON_SPACE,
    SPACE,
    WHITESPACE,
    any_pattern,
    required_literal,
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def with_computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds or replaces a costly column that later filters must not compute again.

    Catalyst moves a filter below a projection by copying the projected expression into it, once
    per mention. It does not move one below an explosion.
    """
    rest = [c for c in df.columns if c != name]
    return df.select(*rest, F.explode(F.array(value)).alias(name)).select(
        *df.columns, *([] if name in df.columns else [name]))


def strip(c: Column | str) -> Column:
    """Remove white space of any kind from both ends (``trim`` only knows the blank)."""
    return F.btrim(col(c), F.lit(WHITESPACE))


def normalize_space(c: Column | str) -> Column:
    """Collapse each run of white space to one blank and strip."""
    return F.trim(F.regexp_replace(col(c), f"{SPACE}+", " "))


def normal_word_count(c: Column | str) -> Column:
    """Number of words of a text in normal form: its blanks are counted, no word is built."""
    c = col(c)
    blanks = F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    return F.when(c == "", 0).otherwise(blanks + 1)


def word_count(c: Column | str) -> Column:
    """Number of words, that is runs of non-space characters."""
    return let(normalize_space(c), normal_word_count)


def min_words(c: Column | str, n: int) -> Column:
    """True from ``n`` words on. Stops reading at word ``n``."""
    if n <= 0:
        return col(c).isNotNull()
    return col(c).rlike(f"^{SPACE}*+(?:{NON_SPACE}++{SPACE}++){{{n - 1}}}{NON_SPACE}")


def sentence_array(c: Column | str) -> Column:
    """Split after ``. ! ?`` and white space where an ASCII capital follows."""
    return F.split(col(c), rf"(?<=[.!?]){SPACE}+(?=[A-Z])")


def truncate_at(c: Column | str, patterns: Iterable[str]) -> Column:
    """Cut each line where the first of ``patterns`` starts, ignoring case."""
    patterns = list(patterns)
    if not patterns:
        return col(c)
    cut = F.regexp_replace(col(c), f"(?iud)(?:{any_pattern(patterns)}).*", "")
    literals = [required_literal(p) for p in patterns]
    if not all(literals):
        return cut
    # The expression only reads the texts that hold one of the phrases.
    low = F.lower(col(c))
    held = [F.contains(low, F.lit(literal.lower())) for literal in dict.fromkeys(literals)]
    return F.when(reduce(Column.__or__, held), cut).otherwise(col(c))


def article_text(title: Column | str, description: Column | str) -> Column:
    """Lower-cased title and description, nulls as empty."""
    blank = F.lit("")
    return F.lower(F.concat(F.coalesce(col(title), blank), F.lit(" "),
                            F.coalesce(col(description), blank)))


def preview(c: Column | str, n: int = 80) -> Column:
    """First ``n`` characters, with ``...`` when there are more."""
    c = col(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


def run_stamp(ts: Column | str) -> Column:
    """``20240131_235959`` form of a timestamp."""
    return F.date_format(col(ts), "yyyyMMdd_HHmmss")


def iso_stamp(ts: Column | str) -> Column:
    """ISO-8601 form of a timestamp, to the second."""
    return F.date_format(col(ts), "yyyy-MM-dd'T'HH:mm:ss")


def words(c: Column | str) -> Column:
    """Lower-cased word tokens of at least two word characters."""
    return F.regexp_extract_all(F.lower(col(c)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def ngrams(c: Column | str, lo: int = 1, hi: int = 2, among: Iterable[str] | None = None) -> Column:
    """All n-grams from ``lo`` to ``hi`` words, shorter ones first; those with a word not in ``among`` are null."""

    def grams(tokens: Column, n: int) -> Column:
        out = tokens
        for k in range(1, n):
            left = F.slice(out, F.lit(1), F.greatest(F.size(out) - 1, F.lit(0)))
            right = F.slice(tokens, F.lit(k + 1), F.greatest(F.size(tokens) - k, F.lit(0)))
            out = F.zip_with(left, right, lambda a, b: F.concat(a, F.lit(" "), b))
        return out

    tokens = words(c)
    if among is not None:
        known = sorted(among)
        tokens = F.transform(tokens, lambda w: F.when(w.isin(known), w))
    return let(tokens, lambda t: F.concat(*[grams(t, n) for n in range(lo, hi + 1)]))


def seeded_hash(key: Column, seed: int) -> Column:
    """md5 of ``seed:key``: the same pseudo-random order on every run, engine and layout."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))

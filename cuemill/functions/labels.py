"""Cue matchers, junk tests and the relevance score.

Three matchers exist because they label differently: ``label_substring`` finds a cue inside a
longer word, ``label_token_set`` needs the whole token, ``label_word_boundary`` lies between.

All compare lower-cased text. A plain substring test is several times cheaper than a regular
expression, so an expression only reads the rows that hold a text which its matches must contain.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuemill.functions.patterns import (
    NOT_AFTER_WORD,
    NOT_BEFORE_WORD,
    SPACE_SET,
    any_literal,
    any_pattern,
    any_word,
    lower_pattern,
    required_literal,
)
from cuemill.functions.text import col, let
from cuemill.lexicons import (
    CORPUS_JUNK,
    EXCLUSIONS,
    KEYWORD_CUES,
    PARAGRAPH_JUNK,
    SUBSTRING_CUES,
    Exclusion,
    RelevanceLexicon,
)


def _minimal(phrases: Iterable[str]) -> list[str]:
    """The phrases that hold no other one: finding any phrase means finding one of these."""
    distinct = list(dict.fromkeys(p for p in phrases if p))
    return [p for p in distinct if not any(q != p and q in p for q in distinct)]


def _holds_any(low: Column, phrases: Iterable[str]) -> Column:
    tests = [F.contains(low, F.lit(p)) for p in _minimal(phrases)]
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def _flag(found: Column) -> Column:
    """1 or 0; null text counts as no match."""
    return F.coalesce(found, F.lit(False)).cast("int")


def contains_any(c: Column | str, phrases: Iterable[str]) -> Column:
    """True if any phrase is a substring, ignoring case."""
    return F.coalesce(_holds_any(F.lower(col(c)), [p.lower() for p in phrases]), F.lit(False))


def label_substring(c: Column | str, cues: Iterable[str] = SUBSTRING_CUES) -> Column:
    return _flag(_holds_any(F.lower(col(c)), list(cues)))


def _has_word(low: Column, phrases: Sequence[str]) -> Column:
    return _holds_any(low, phrases) & low.rlike(f"(?d){any_word(phrases)}")


def label_word_boundary(c: Column | str, cues: Iterable[str] = KEYWORD_CUES) -> Column:
    cues = [cue.lower() for cue in cues]
    return _flag(_has_word(F.lower(col(c)), cues)) if cues else F.lit(0)


def label_token_set(c: Column | str, cues: Iterable[str] = KEYWORD_CUES) -> Column:
    """Whole tokens between white space, commas and full stops.

    A cue that holds one of these separators can never be a token, so it never matches.
    """
    tokens = [cue for cue in cues if cue and not re.search(r"[\s,.]", cue)]
    if not tokens:
        return F.lit(0)
    inner = f"(?U:[^{SPACE_SET},.])"
    low = F.lower(col(c))
    whole = low.rlike(f"(?<!{inner})(?:{any_literal(tokens)})(?!{inner})")
    return _flag(_holds_any(low, tokens) & whole)


def matches_any_regex(c: Column | str, patterns: Iterable[str]) -> Column:
    """True if any regular expression is found, ignoring case."""
    low = F.lower(col(c))
    shown: list[tuple[str, str]] = []
    other: list[str] = []
    for pattern in patterns:
        literal = required_literal(pattern)
        if literal:
            shown.append((literal.lower(), lower_pattern(pattern)))
        else:
            other.append(lower_pattern(pattern))
    tests = []
    if shown:
        tests.append(_holds_any(low, [literal for literal, _ in shown])
                     & low.rlike(f"(?d){any_pattern(p for _, p in shown)}"))
    if other:
        tests.append(low.rlike(f"(?d){any_pattern(other)}"))
    return reduce(Column.__or__, tests) if tests else F.lit(False)


def is_junk(c: Column | str, patterns: Iterable[str] = CORPUS_JUNK) -> Column:
    """True for a null and for any junk pattern found."""
    return F.coalesce(matches_any_regex(c, patterns), F.lit(True))


def bad_paragraph(c: Column | str, phrases: Iterable[str] = PARAGRAPH_JUNK) -> Column:
    """True for an empty paragraph and for one that holds a boilerplate phrase."""
    return F.coalesce((col(c) == "") | _holds_any(F.lower(col(c)), [p.lower() for p in phrases]),
                      F.lit(True))


def _excluded_by(low: Column, rule: Exclusion) -> Column:
    triggers = any_word(rule.triggers)
    if not rule.unless:
        return _has_word(low, rule.triggers)
    unless = any_word(rule.unless)
    found = _has_word(low, rule.triggers)
    if set(" ".join(rule.triggers).split()) & set(" ".join(rule.unless).split()):
        return found & low.rlike(f"(?d){triggers}(?!.*{unless})")
    # Cut each line behind its last exception; a trigger in what remains has none after it. This
    # reads a line once, where a look-ahead would read its rest once per trigger.
    rest = F.regexp_replace(low, f"(?dm)^.*{unless}", " ")
    return found & (~_holds_any(low, rule.unless) | rest.rlike(f"(?d){triggers}"))


def hard_excluded(c: Column | str, rules: Sequence[Exclusion] = EXCLUSIONS) -> Column:
    """True if a rule's trigger word is found with none of its exceptions later on the line."""
    if not rules:
        return F.lit(False)
    # Rules without exceptions are one test; the others are only tried when it fails.
    plain = tuple(t for rule in rules if not rule.unless for t in rule.triggers)
    merged = [Exclusion(plain)] if plain else []
    merged += [rule for rule in rules if rule.unless]

    def test(low: Column) -> Column:
        return reduce(Column.__or__, [_excluded_by(low, rule) for rule in merged])

    return F.coalesce(let(F.lower(col(c)), test), F.lit(False))


def has_ticker(title: Column | str) -> Column:
    """True if a word of one to five ASCII capitals is in the title."""
    return F.coalesce(col(title).rlike(f"{NOT_AFTER_WORD}[A-Z]{{1,5}}{NOT_BEFORE_WORD}"), F.lit(False))


def has_suffix(c: Column | str, suffixes: Iterable[str]) -> Column:
    return contains_any(c, suffixes)


def _count_terms(text: Column, terms: Sequence[str]) -> Column:
    """How many of the terms are substrings of ``text``."""
    if not terms:
        return F.lit(0)
    listed = F.array(*[F.lit(t) for t in terms])
    return F.size(F.filter(listed, lambda term: F.contains(text, term)))


def relevance_score(
    title: Column | str, description: Column | str, lexicon: RelevanceLexicon = RelevanceLexicon()
) -> Column:
    """-1 when excluded, else the weighted number of market terms in title and description."""
    title = F.coalesce(col(title), F.lit(""))
    low_title = F.lower(title)
    text = F.concat(low_title, F.lit(" "), F.lower(F.coalesce(col(description), F.lit(""))))

    def points(t: Column) -> Column:
        found = _count_terms(t, lexicon.strong) * 3 + _count_terms(t, lexicon.moderate)
        return found + _holds_any(t, lexicon.suffixes).cast("int")

    # A term in the title is also in the text, so the bonus needs no second test.
    bonus = let(low_title, lambda t: _count_terms(t, lexicon.strong) * 2)
    ticker = has_ticker(title).cast("int") * 2
    return (F.when(hard_excluded(text, lexicon.exclude), F.lit(-1))
            .otherwise(let(text, points) + bonus + ticker))


def is_relevant(
    title: Column | str,
    description: Column | str,
    threshold: int = 3,
    lexicon: RelevanceLexicon = RelevanceLexicon(),
) -> Column:
    """Non-blank title and a score of at least ``threshold``."""
    titled = F.coalesce(col(title).rlike(r"[^\s]"), F.lit(False))
    return titled & (relevance_score(title, description, lexicon) >= threshold)


def keyword_query(c: Column | str, any_of: Sequence[str], none_of: Sequence[str] = ()) -> Column:
    """Whole phrases: at least one of ``any_of`` and none of ``none_of``."""
    wanted = label_word_boundary(c, any_of) == 1
    return wanted & (label_word_boundary(c, none_of) == 0) if none_of else wanted

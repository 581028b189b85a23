"""Regular expressions that mean the same on every JVM.

Java's ``\\s``, ``\\w`` and ``\\b`` are ASCII or change with the Java version, so patterns are
translated to Unicode classes before they reach Spark.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

# Every character that counts as white space, ASCII separators included.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Java's Unicode white space lacks the four ASCII separators.
SPACE_SET = r"\s\x1c-\x1f"
SPACE = f"(?U:[{SPACE_SET}])"
NON_SPACE = f"(?U:[^{SPACE_SET}])"
WORD = r"[\p{L}\p{N}_]"
NOT_AFTER_WORD = rf"(?<!{WORD})"
NOT_BEFORE_WORD = rf"(?!{WORD})"
BOUNDARY = rf"(?:(?<!{WORD})(?={WORD})|(?<={WORD})(?!{WORD}))"


def portable(pattern: str) -> str:
    """Replace the classes whose meaning depends on the regex engine."""
    # A boundary next to a letter of the pattern needs one look-around, not four.
    pattern = re.sub(r"\\b(?=\w(?![?*{]))", lambda _: NOT_AFTER_WORD, pattern)
    pattern = re.sub(r"(?<!\\)(\w)\\b", lambda m: m[1] + NOT_BEFORE_WORD, pattern)
    for short, full in ((r"\b", BOUNDARY), (r"\s", SPACE), (r"\S", NON_SPACE), (r"\w", WORD)):
        pattern = pattern.replace(short, full)
    return pattern


# What keeps its case: group names, back-references, property classes and escapes; then plain text.
_TOKENS = re.compile(r"\(\?P?<[A-Za-z]\w*>|\\k<\w+>|\\[pP]\{\^?\w+\}|\\[pP]\w|\\x[0-9a-fA-F]{2}"
                     r"|\\x\{[0-9a-fA-F]+\}|\\u[0-9a-fA-F]{4}|\\.|[^\\(]+|\(", re.S)
_CASED = {"Lu", "Ll", "Lt", "Upper", "Lower"}


def lower_pattern(pattern: str) -> str:
    """The pattern for lower-cased text: letters, also those given by code, are lowered; a class of
    upper or lower case takes both; group names and other escapes stay."""

    def lower(m: re.Match) -> str:
        token = m[0]
        if token[:2] in (r"\p", r"\P"):
            if token[2:].strip("{}") not in _CASED:
                return token
            return r"[\p{Lu}\p{Ll}\p{Lt}]" if token[1] == "p" else r"[^\p{Lu}\p{Ll}\p{Lt}]"
        if token[:2] in (r"\x", r"\u"):
            low = chr(int(token[2:].strip("{}"), 16)).lower()
            return token if len(low) > 1 else rf"\x{{{ord(low):x}}}"
        return token if token[0] == "\\" or token.startswith("(?") else token.lower()

    return _TOKENS.sub(lower, pattern)


def any_pattern(patterns: Iterable[str]) -> str:
    """One alternation of regular expressions."""
    return "|".join(f"(?:{portable(p)})" for p in patterns)


def any_literal(phrases: Iterable[str]) -> str:
    """One alternation of plain phrases, matched anywhere."""
    return "|".join(re.escape(p) for p in phrases)


def any_word(phrases: Iterable[str]) -> str:
    """One alternation of plain phrases, matched between word boundaries."""
    phrases = list(phrases)
    if all(re.fullmatch(r"\w(.*\w)?", p, re.S) for p in phrases):
        return f"{NOT_AFTER_WORD}(?:{any_literal(phrases)}){NOT_BEFORE_WORD}"
    # Beside a phrase that starts or ends with a sign, a boundary needs a letter outside.
    return f"(?:{any_pattern(rf'\b{re.escape(p)}\b' for p in phrases)})"


def required_literal(pattern: str) -> str | None:
    """A text that every match contains, if the pattern is simple enough to show one."""
    plain = re.sub(r"\\[bBdDsSwW]|\.[?*+]?|[\^$]", "\0", pattern.replace(r"\.", "\1"))
    plain = re.sub(r".[?*]", "\0", plain)
    if re.search(r"[\\|()\[\]{}+?*]", plain):
        return None
    return max(plain.replace("\1", ".").split("\0"), key=len) or None

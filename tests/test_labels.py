import random
import re

import pytest
from pyspark.sql import functions as F

from cuemill import lexicons as lex
from cuemill.functions.labels import (
    bad_paragraph,
    contains_any,
    hard_excluded,
    has_ticker,
    is_junk,
    is_relevant,
    keyword_query,
    label_substring,
    label_token_set,
    label_word_boundary,
    matches_any_regex,
    relevance_score,
)
from cuemill.functions.patterns import required_literal
from cuemill.lexicons import Exclusion, RelevanceLexicon

TEXTS = [
    None, "", "dismay", "May be", "it may; or", "émay", "may_be", "mayé", "they plan, set to go",
    "set  to", "will, may.", "(may)", "MIGHT", "x.might,y", "about it", "S&P 500", "ﬁn set to",
    "He depends on estimates", "estimate", "WATCH: now", "say watch: now", "WATCHING", "watch",
    "CNBC's Daily Open", "cnbcs daily open", "-- CNBC’s X contributed to this report", "Disclosure: a",
    "London — a", "in London — a", "U.S. futures are mostly flat", "UxS. futures are mostly flat",
]


def mixed(n, words, seed):
    rng = random.Random(seed)
    seps = [" ", " ", " ", ", ", ". ", "; ", "-", "_", "\n", "é"]
    return ["".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randint(1, 12)))
            for _ in range(n)]


ALL = TEXTS + mixed(300, [*lex.KEYWORD_CUES, "Dismayed", "the", "Stock", "aboutface", "É"], 3)


def python(texts, fn):
    return [fn(t) for t in texts]


def test_token_set(column):
    cues = lex.KEYWORD_CUES
    assert column(ALL, label_token_set("t", cues)) == python(ALL, lambda t: 0 if t is None else int(
        any(c in set(t.lower().replace(",", " ").replace(".", " ").split()) for c in cues)))


def test_substring(column):
    cues = lex.SUBSTRING_CUES
    assert column(ALL, label_substring("t", cues)) == python(ALL, lambda t: 0 if t is None else int(
        any(c in t.lower() for c in cues)))


def test_word_boundary(column):
    for cues in (lex.KEYWORD_CUES, ("&x", "s&p", "may")):
        pattern = re.compile(r"\b(" + "|".join(map(re.escape, cues)) + r")\b", re.I)
        texts = ALL + ["a&x b", " &x", "s&p", "xs&p"]
        assert column(texts, label_word_boundary("t", cues)) == python(
            texts, lambda t: 0 if t is None else int(bool(pattern.search(t))))


def test_matchers_differ(column):
    text = ["they may; dismay set to"]
    assert column(["dismay"], label_substring("t", ["may"])) == [1]
    assert column(["dismay"], label_word_boundary("t", ["may"])) == [0]
    assert column(["may;"], label_word_boundary("t", ["may"])) == [1]
    assert column(["may;"], label_token_set("t", ["may"])) == [0]
    assert column(text, label_token_set("t", ["set to"])) == [0]
    assert column(text, label_token_set("t", [])) == [0]


@pytest.mark.parametrize("patterns", [lex.CORPUS_JUNK, lex.MERGE_JUNK, lex.TRAINING_JUNK,
                                      lex.CANDIDATE_PATTERNS, (r"(a|b)may", r"\bset\s+to", "^.?may")])
def test_regex_lists(column, patterns):
    texts = ALL + mixed(200, [p.strip("^").replace(".?", "'").replace("\\b", "") for p in patterns], 5)
    compiled = [re.compile(p, re.I) for p in patterns]
    assert column(texts, is_junk("t", patterns)) == python(
        texts, lambda t: t is None or any(p.search(t) for p in compiled))
    assert column(texts, matches_any_regex("t", patterns)) == python(
        texts, lambda t: None if t is None else any(bool(p.search(t)) for p in compiled))


def test_required_literal_is_in_every_match():
    assert required_literal(r"^WATCH\b") == "WATCH"
    assert required_literal(r"estimates?") == "estimate"
    assert required_literal(r"U\.S\. x") == "U.S. x"
    assert required_literal(r"CNBC.?s Daily") == "s Daily"
    for pattern in ("a|b", "(ab)?c", "[ab]c", r"\p{L}x", "a{0}b", ".*"):
        assert required_literal(pattern) is None


def test_bad_paragraph(column):
    texts = [None, "", "fine", "please SIGN UP here", "© me"]
    assert column(texts, bad_paragraph("t")) == [True, True, False, True, True]


def plain_excluded(text, rules):
    for rule in rules:
        later = rf"(?!.*\b({'|'.join(rule.unless)})\b)" if rule.unless else ""
        if re.search(rf"\b({'|'.join(rule.triggers)})\b{later}", text.lower()):
            return True
    return False


@pytest.mark.parametrize("rules", [
    lex.EXCLUSIONS, (Exclusion(("how to", "guide"), ("guide book", "stock")),),
    (Exclusion(("sale",), ("filing",)), Exclusion(("film",)))])
def test_hard_exclusions(column, rules):
    words = ["salary", "filing", "report", "guide", "guide book", "stock", "movie", "game", "ipo",
             "share", "sale", "film", "x", "how to", "salaryfiling", "deal"]
    texts = ["", "salary", "salary\nfiling", "filing salary", "salary filing", "salary, report salary",
             "guide book", "guide book guide"] + mixed(500, words, 9)
    assert column(texts, hard_excluded("t", rules)) == [plain_excluded(t, rules) for t in texts]
    assert column([None], hard_excluded("t", rules)) == [False]


def test_relevance_score(spark):
    lexicon = RelevanceLexicon()
    words = [*lex.STRONG_TERMS[:12], *lex.MODERATE_TERMS[:12], "since", "A", "IBM", "plain", "deal",
             "Stock", "review"]
    titles, descriptions = mixed(200, words, 1), mixed(200, words, 2)
    rows = [*zip(titles, descriptions), (None, "stock"), ("Stocks", None), (" ", "stock"), ("", "")]

    def score(title, description):
        title, description = title or "", description or ""
        text = (title + " " + description).lower()
        if plain_excluded(text, lexicon.exclude):
            return -1
        total = sum(3 + 2 * (t in title.lower()) for t in lexicon.strong if t in text)
        total += sum(t in text for t in lexicon.moderate)
        total += 2 * bool(re.search(r"\b[A-Z]{1,5}\b", title))
        return total + any(s in text for s in lexicon.suffixes)

    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, t string, d string")
    out = df.select("i", relevance_score("t", "d").alias("s"),
                    is_relevant("t", "d", 3).alias("r")).orderBy("i").collect()
    assert [r["s"] for r in out] == [score(*r) for r in rows]
    assert [r["r"] for r in out] == [bool((t or "").strip()) and score(t, d) >= 3 for t, d in rows]
    assert len({r["s"] for r in out}) > 10


def test_ticker_and_query(column):
    assert column(["A b", "abc", "ABCDEF", "IBM's", None, "xIBM"], has_ticker("t")) == [
        True, False, False, True, False, False]
    assert column(["price target up", "price targets", "ipo deal", None],
                  keyword_query("t", lex.QUERY_ANY, lex.QUERY_NONE)) == [True, False, False, False]
    assert column(["AI chips", "rain", None], contains_any("t", lex.TOPIC_KEYWORDS)) == [
        True, True, False]


def test_no_python_in_the_plan(spark):
    df = spark.range(1).select(F.lit("x").alias("t"))
    plan = df.select(label_word_boundary("t"), is_junk("t"), relevance_score("t", "t"))
    assert "Python" not in plan._jdf.queryExecution().toString()


def test_lowered_patterns_keep_their_meaning(column):
    texts = ["ÀB X", "ab x", "12 X", "aXb", "A-A"]
    for pattern, wanted in ((r"\p{L}+ X", [True, True, False, False, False]),
                            (r"^\p{Lu}", [True, True, False, True, True]), (r"\x58b", [False] * 3 + [True, False]),
                            (r"(?<Name>A)-\k<Name>", [False] * 4 + [True]), (r"\P{L}\S", [True] * 3 + [False, True])):
        assert column(texts, matches_any_regex("t", [pattern])) == wanted, pattern

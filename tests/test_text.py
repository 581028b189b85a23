import random
import re

from pyspark.sql import functions as F

from cuemill.functions.text import (
    article_text,
    min_words,
    ngrams,
    normalize_space,
    preview,
    sentence_array,
    strip,
    truncate_at,
    word_count,
)
from cuemill.operators.sentences import sentences
from cuemill.plans.curation import articles_to_sentences

SPACES = " \t\n\r\x0b\x0c\x1c\x1f\x85\xa0 　 "
TEXTS = [
    None, "", " ", "one", "  a  b\tc\n", "1234567890", "12345678901",
    "First one. Second one! third? No. É stays. A\n\nB. C", "End. Next? Yes.  No",
    "a.b C. D", "U.S. Stocks fell. they rose", " ".join("w" * 100), " ".join("w" * 101),
    " ".join("w" * 4), " ".join("w" * 5), "x\x1cy\x1fz", " lead. Trail ",
]


def random_texts(n, alphabet, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(n)]


ALL = TEXTS + random_texts(400, list("aAbB.!?é") + list(SPACES) * 2, 1)


def expected(texts, fn):
    return [None if t is None else fn(t) for t in texts]


def test_white_space_is_unicode(column):
    assert column(ALL, word_count("t")) == expected(ALL, lambda t: len(t.split()))
    assert column(ALL, normalize_space("t")) == expected(ALL, lambda t: " ".join(t.split()))
    assert column(ALL, strip("t")) == expected(ALL, str.strip)
    for n in (1, 5, 6, 101):
        assert column(ALL, min_words("t", n)) == expected(ALL, lambda t: len(t.split()) >= n)


def test_sentence_array_splits_before_ascii_capitals(column):
    pattern = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
    assert column(ALL, sentence_array("t")) == expected(ALL, pattern.split)


def test_sentences_are_stripped_counted_and_placed(spark):
    pattern = re.compile(r"(?<=[.!?])\s+(?=[A-Z])")
    df = spark.createDataFrame(list(enumerate(ALL)), "doc_id int, text string")
    for n in (0, 3):
        found = sorted(map(tuple, sentences(df, min_word_count=n).collect()))
        wanted = sorted((i, pos, piece.strip()) for i, t in enumerate(ALL) if t is not None
                        for pos, piece in enumerate(pattern.split(t))
                        if len(piece.split()) >= n)
        assert found == wanted


def test_truncate_cuts_to_the_end_of_the_line(column):
    texts = ["Keep this. SUBSCRIBE NOW and more\nnext line", "no phrase", None,
             "a © 2024 b © 1999", "x Advertisement\r y\nz", "second first\nfirst second third"]
    patterns = ["Subscribe now", r"© 20\d\d", "advertisement", "first", "second"]

    def python(t):
        for p in patterns:
            t = re.sub(p + ".*", "", t, flags=re.I)
        return t

    assert column(texts, truncate_at("t", patterns)) == expected(texts, python)


def test_articles_to_sentences_skips_empty_articles(spark):
    df = spark.createDataFrame([("u1", "Advertisement all of it"), ("u2", None), ("u3", ""),
                                ("u4", "One two three four five. Subscribe now or never again.")],
                               "url string, text string")
    rows = articles_to_sentences(df, keep=["url"]).collect()
    assert [tuple(r) for r in rows] == [("u4", 0, "One two three four five.")]


def test_ngrams(column):
    def python(t):
        words = re.findall(r"\b\w\w+\b", t.lower())
        return words + [" ".join(p) for p in zip(words, words[1:])]

    texts = [t for t in ALL if t is not None] + ["A bb ccc_d éé-ff 12 3", "solo"]
    assert column(texts, ngrams("t")) == [python(t) for t in texts]
    assert column(["aa bb cc dd"], ngrams("t", 3, 3)) == [["aa bb cc", "bb cc dd"]]


def test_preview_and_article_text(spark, column):
    assert column(["x" * 80, "x" * 81, None], preview("t")) == ["x" * 80, "x" * 80 + "...", None]
    df = spark.createDataFrame([(None, "Desc"), ("Title", None)], "a string, b string")
    assert [r[0] for r in df.select(article_text("a", "b")).collect()] == [" desc", "title "]
    assert df.select(F.length(article_text("a", "b"))).first()[0] == 5

import random

import pytest
from pyspark.sql import functions as F

from cuemill.functions.labels import label_word_boundary
from cuemill.operators.lexicon_index import label_lexicon, lexicon_hits, lexicon_index

CUES = ["may", "Set to", "set  to", "S&P 500", "(may)", "&", "...", "to", "émay", "a\\Eb", "depends on", "x.y", "may_be", "$5", None, ""]
TEXTS = [None, "", "dismay", "May be", "it may; or", "émay", "may_be", "mayé", "they plan, set to go", "set  to",
         "(may)", "x(may)y", "S&P 500", "S&P 5000", "a&b", "a & b", "a\\Eb", "He depends\non", "xxy", "x.y", "a...b", "US$5", "may may MAY"]


@pytest.mark.parametrize("max_bytes", [1 << 20, 0])
def test_equals_the_expression(spark, max_bytes):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "id long, text string")
    cues = spark.createDataFrame([(c, 1) for c in CUES + ["MAY"]], "cue string, key int")
    got = {tuple(r) for r in lexicon_hits(docs, cues, ["id"], max_bytes=max_bytes).collect()}
    tests = [label_word_boundary("text", [c]).alias(f"c{i}") for i, c in enumerate(CUES[:-2])]
    want = {(r[0], CUES[i].lower()) for r in docs.select("id", *tests).collect() for i in range(len(tests)) if r[i + 1]}
    assert got == want and len(want) > 12


@pytest.mark.parametrize("max_bytes", [64 << 20, 0])
def test_a_hundred_thousand_cues(spark, max_bytes):
    """Half of the cues begin with the same word; the index keys them by the other."""
    pick = random.Random(5)
    cues = [f"the w{i}" if i % 2 else f"w{i} w{pick.randrange(50)}" for i in range(100_000)]
    texts = [" ".join(pick.choice(["the", f"w{pick.randrange(50)}", f"w{pick.randrange(100_000)}"]) for _ in range(60)) for _ in range(300)]
    texts[7] = None
    known = set(cues)
    want = {(i, f"{a} {b}") for i, t in enumerate(texts) if t
            for a, b in zip(t.split(), t.split()[1:]) if f"{a} {b}" in known}
    table = spark.createDataFrame([(c,) for c in cues], "cue string")
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    got = {tuple(r) for r in lexicon_hits(docs, table, ["id"], max_bytes=max_bytes).collect()}
    assert got == want and len(want) > 100
    if max_bytes:
        longest = lexicon_index(table).groupBy("key").count().agg(F.max("count")).first()[0]
        assert longest < 2500  # of 50 000 cues that begin with the same word


def test_label_counts_repeated_and_null_keys(spark):
    docs = spark.createDataFrame([(1, "may"), (1, "will"), (None, "may"), (2, None), (3, "none")], "id long, text string")
    cues = spark.createDataFrame([("may",), ("will",)], "word string")
    got = {tuple(r) for r in label_lexicon(docs, cues, ["id"], cue="word", max_bytes=0).collect()}
    assert got == {(1, 1, 2, "may"), (None, 1, 1, "may"), (2, 0, 0, None), (3, 0, 0, None)}
    nothing = label_lexicon(docs, cues.limit(0), ["id"], cue="word")
    assert {r.label for r in nothing.collect()} == {0} and nothing.count() == 4
    assert label_lexicon(docs.limit(0), cues, ["id"], cue="word").count() == 0


def test_cues_are_looked_up_as_they_are(spark):
    """Short cues are their own keys, so a text meets no cue that it does not hold; long ones differ late."""
    lead = "one two three four five "
    cues = [f"common w{i}" for i in range(300)] + [f"{lead}w{i}" for i in range(300)] + ["(x) of", " of", "b ", "."]
    texts = ["common w7", f"{lead}w8, and {lead}w9", f"{lead}w99x", f"a{lead}w3", "see (x) of it", "(x) of", "b of", "b  of .", "a.b"]
    index = lexicon_index(spark.createDataFrame([(c,) for c in cues], "cue string"))
    assert index.groupBy("key").count().agg(F.max("count")).first()[0] == 1
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string")
    tests = [label_word_boundary("text", [c]).alias(f"c{i}") for i, c in enumerate(cues)]
    want = {(r[0], cues[i]) for r in docs.select("id", *tests).collect() for i in range(len(tests)) if r[i + 1]}
    for max_bytes in (1 << 20, 0):
        got = {tuple(r) for r in lexicon_hits(docs, spark.createDataFrame([(c,) for c in cues], "cue string"), ["id"], max_bytes=max_bytes).collect()}
        assert got == want and len(want) == 6

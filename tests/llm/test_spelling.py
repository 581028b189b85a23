import itertools
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from cuemill.llm import spelling
from cuemill.llm.spelling import near_pairs, pivots, spelling_variants


def near(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def brute(rows, min_count=3):
    counts = Counter()
    lower = {c: c + 32 for c in range(65, 91)}
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(lower)
            h = zlib.crc32(f"{doc_id}:{run}".encode())
            if doc_id is not None and h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    n = {w: c for w, c in counts.items() if len(w) >= 5 and c >= min_count}
    by_size = {}
    for w in n:
        by_size.setdefault(len(w), []).append(w)
    close = {w: [v for size in (len(w) - 1, len(w), len(w) + 1) for v in by_size.get(size, []) if near(w, v)] for w in n}
    form = {}
    for w, vs in close.items():
        if vs:
            best = min(vs, key=lambda v: (-n[v], v))
            if n[best] >= 2 * n[w]:
                form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n[w], len(close[w]), n[form[w]] if w in form else None) for w in n)


def run(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, n int, root string, form int")
    return sorted(tuple(r) for r in spelling_variants(df.repartition(4), **options).collect())


@pytest.mark.parametrize("letters", ["abc", "aé", "abcdefghij"])
def test_equals_brute_force(spark, letters):
    rng = np.random.default_rng(5)
    words = ["".join(rng.choice(list(letters), rng.integers(4, 9))) for _ in range(400)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 120))).title(), "w", 1, "r", 0) for i in range(120)]
    got = run(spark, rows)
    assert got == brute(rows) and got
    assert any(r[1] for r in got) or len(letters) > 3


def test_chains_ties_and_hot_keys(spark, monkeypatch):
    # Each form has its own form; of two near words with the same count the first one wins.
    monkeypatch.setattr(spelling, "KEY_ROWS", 2)
    chain = {"aaaaab": 3, "aaaabb": 6, "aaabbb": 12, "aabbbb": 24, "zzzzza": 4, "zzzzzb": 8, "zzzzzc": 8}
    many = {f"hothot{a}{b}": 3 for a, b in itertools.product("abcdefg", repeat=2)}
    rows = [(None, " ".join([w] * n), "w", 1, "r", 0) for w, n in (chain | many).items()]
    got = run(spark, rows)
    assert got == brute(rows)
    assert {r[0]: r[2] for r in got}["aaaaab"] == "aabbbb" and {r[0]: r[1] for r in got}["zzzzza"] == "zzzzzb"


def test_edge_rows(spark):
    rows = [(None, None), (1, ""), (1, "1 2 3 , ."), (2**60 + 1, "Größe grösse GRÖSSE ×÷×÷× " * 3), (2**60 + 1, "Größe größe " * 2),
            (3, "a" * 5000 + " " + "a" * 5001), (3, "a" * 5000 + " " + "a" * 5001), (4, "a" * 5000 + " " + "a" * 5001 + " ŁÓDŹ")]
    rows = [(*r, "w", 1, "r", 0) for r in rows]
    assert run(spark, rows) == brute(rows)
    assert run(spark, rows[:3]) == [] and run(spark, []) == []
    with pytest.raises(ValueError):
        run(spark, rows, factor=1)


def test_pivots_are_the_cheapest_disjoint_choice():
    rng = np.random.default_rng(1)
    for _ in range(200):
        grams = [(int(p), int(rng.integers(1, 50))) for p in rng.choice(20, 9, replace=False)]
        best = min((x[1] + y[1] for x, y in itertools.combinations(grams, 2) if abs(x[0] - y[0]) >= 2))
        got = pivots(grams, 2)
        assert sum(c for _, c in got) == best and got[1][0] - got[0][0] >= 2


def test_pairs_of_short_words(spark):
    words = [("abcd", 1), ("abce", 2), ("abcde", 3), ("xbcd", 4), ("dcba", 5)]
    got = {frozenset((r.a, r.b)) for r in near_pairs(spark.createDataFrame(words, "word string, n long")).collect()}
    assert got == {frozenset((a, b)) for (a, _), (b, _) in itertools.combinations(words, 2) if near(a, b)}

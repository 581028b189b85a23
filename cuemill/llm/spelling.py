"""Spelling variants: words one edit apart, found by pivotal grams and verified.

Every word has as many disjoint rare bigrams, its pivots, as an edit distance of one needs to leave one
of them alone. A word's rarest bigrams are its prefix. Of two near words, the one whose prefix ends
earlier in the order of bigrams has a pivot that stands, moved by at most one place, in the other's
prefix; so pivots look up prefixes by bigram, place and length.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import bounded_batches, fresh_worker, tasks, written

#: Runs of letters; what lies between U+00C0 and U+00FF counts as a letter.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWERED = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Counts that a task keeps before it hands them on, by entries and by characters.
KEPT_WORDS, KEPT_CHARS = 400_000, 16_000_000
#: Index entries under one key that one task compares; a longer list is dealt out.
KEY_ROWS = 4096


def ascii_lower(run: str) -> str:
    return run.lower() if run.isascii() else run.translate(LOWERED)


def slipped(doc_id: str | None, run: str, period: int) -> str:
    """The run, without one code point where the period divides the CRC-32 of id and run."""
    if doc_id is None:
        return run
    h = zlib.crc32(f"{doc_id}:{run}".encode())
    if h % period:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5,
                min_count: int = 3, period: int = 97) -> DataFrame:
    """``word, n`` of all texts, as a written table.

    Equal runs of a document share their hash, so each is hashed once. A task adds up its words in a
    table of bounded size, which it hands on when full; Spark adds up those. Null texts have no
    words; with a null id no run loses a code point. Repeated rows count like any others.
    """
    bounded_batches(docs.sparkSession)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh_worker()
        sums: dict[str, int] = {}
        chars = 0
        for batch in batches:
            for doc_id, text in zip(batch["id"], batch["text"]):
                own: dict[str, int] = {}
                for found in RUN.finditer(text or ""):
                    run = found[0]
                    own[run] = own.get(run, 0) + 1
                lowered: dict[str, int] = {}
                for run, n in own.items():
                    if len(run) >= min_length:
                        low = ascii_lower(run)
                        lowered[low] = lowered.get(low, 0) + n
                for run, n in lowered.items():
                    word = slipped(doc_id, run, period)
                    if len(word) < min_length:
                        continue
                    if word not in sums:
                        chars += len(word)
                    sums[word] = sums.get(word, 0) + n
                if len(sums) > KEPT_WORDS or chars > KEPT_CHARS:
                    yield pd.DataFrame({"word": list(sums), "n": list(sums.values())})
                    sums, chars = {}, 0
        yield pd.DataFrame({"word": pd.Series(list(sums), dtype=object), "n": pd.Series(list(sums.values()), dtype="int64")})

    rows = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"), F.col(f"`{text_col}`").alias("text"))
    counts = rows.mapInPandas(count, "word string, n long")
    return written(counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count), "words")


def pivots(grams: list[tuple[int, int]], n: int, width: int = 2) -> list[tuple[int, int]]:
    """``n`` disjoint grams (place, cost) of least total cost, by dynamic programming over the places:
    the best choice of k among the first i is that without the i-th, or the i-th with the best choice
    of k - 1 among those that end before it."""
    grams = sorted(grams)
    best: list[list[tuple[int, tuple]]] = [[(0, ())] * (len(grams) + 1)]
    for _ in range(n):
        row: list = [None]
        for i, (place, cost) in enumerate(grams):
            before = i
            while before and grams[before - 1][0] > place - width:
                before -= 1
            last = best[-1][before]
            taken = None if last is None else (last[0] + cost, (*last[1], (place, cost)))
            row.append(taken if row[-1] is None or (taken is not None and taken[0] < row[-1][0]) else row[-1])
        best.append(row)
    return list(best[-1][-1][1])


def gram_signature(word: str, rank: dict[str, int], cost: list[int]) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]]]:
    """The rank at which the word's prefix ends, its prefix and its two pivots, as (rank, place).

    Three grams hold two disjoint ones. All grams of the last one's rank are in the prefix, so that
    a gram's rank alone says whether it is. The pivots are chosen among three distinct places.
    """
    grams = sorted((rank[word[i:i + 2]], i) for i in range(len(word) - 1))
    last = grams[2][0]
    chosen = pivots([(i, cost[r]) for r, i in grams[:3]], 2)
    ranks = {i: r for r, i in grams[:3]}
    return last, [g for g in grams if g[0] <= last], [(ranks[i], i) for i, _ in chosen]


def near_pairs(words: DataFrame) -> DataFrame:
    """``a, a_n, b, b_n`` for every two distinct words (of at least 4 code points) that one inserted, deleted or
    replaced code point turns into each other, each pair once, from ``word, n``.

    The rarity of a bigram is the number of words with it. Bigrams are pairs of the run pattern's 90
    letters after lower-casing, 90 x 90 at most, so their table is small whatever the corpus. A key is bigram, place
    and length: a word of equal length has an untouched pivot at its own place, one that is longer or
    shorter by one there or one place on. Keys with long lists are dealt out by word, their lookups
    repeated. Only verified pairs leave the join.
    """
    session = words.sparkSession
    bounded_batches(session)
    grams = words.select(F.explode(F.array_distinct(F.expr(
        "transform(sequence(1, length(word) - 1), i -> substring(word, i, 2))"))).alias("gram"))
    # At most 90 * 90 rows.
    counted = sorted((r["count"], r["gram"]) for r in grams.groupBy("gram").count().collect())
    rank, cost = {g: i for i, (_, g) in enumerate(counted)}, [c for c, _ in counted]

    def signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fresh_worker()
        for batch in batches:
            ends, prefixes, chosen = [], [], []
            for word in batch["word"]:
                last, prefix, own = gram_signature(word, rank, cost)
                size = len(word)
                ends.append(last)
                prefixes.append([{"gram": g, "place": i, "size": size} for g, i in prefix])
                chosen.append([{"gram": g, "place": i + moved, "size": size + more} for g, i in own
                               for more in (-1, 0, 1) for moved in sorted({0, more}) if i + moved >= 0])
            yield pd.DataFrame({"word": batch["word"], "n": batch["n"], "last": ends, "prefix": prefixes, "chosen": chosen})

    key = "array<struct<gram:int,place:int,size:int>>"
    signed_words = written(words.repartition(tasks(words), "word").mapInPandas(
        signed, f"word string, n long, last int, prefix {key}, chosen {key}"), "signatures")
    index = signed_words.select("word", "n", "last", F.inline("prefix"))
    looked_up = signed_words.select("word", "n", "last", F.inline("chosen"))
    keys = ["gram", "place", "size"]
    lists = written(index.groupBy(*keys).agg(F.expr(f"cast((count(*) - 1) div {KEY_ROWS} + 1 as int)").alias("deals")), "keys")
    index = index.join(lists, keys).withColumn("deal", F.pmod(F.xxhash64("word"), F.col("deals")).cast("int")).alias("i")
    looked_up = looked_up.join(lists, keys).withColumn("deal", F.explode(F.sequence(F.lit(0), F.col("deals") - 1))).alias("p")
    meets = (F.col("p.last") < F.col("i.last")) | ((F.col("p.last") == F.col("i.last")) & (F.col("p.word") < F.col("i.word")))
    # One edit leaves the first or the last half of the shorter word alone.
    half = F.expr("least(length(p.word), i.size) div 2").cast("int")
    halves = ((F.left("p.word", half) == F.left("i.word", half)) | (F.right("p.word", half) == F.right("i.word", half)))
    same = [F.col(f"p.{c}") == F.col(f"i.{c}") for c in (*keys, "deal")]
    near = F.levenshtein("p.word", "i.word", 1) == 1
    on = same[0]
    for condition in (*same[1:], meets, halves, near):
        on = on & condition
    return looked_up.join(index, on).select(
        F.col("p.word").alias("a"), F.col("p.n").alias("a_n"), F.col("i.word").alias("b"), F.col("i.n").alias("b_n")).distinct()


def last_forms(forms: DataFrame) -> DataFrame:
    """``word, root`` for the words of ``word, form``: where a chain of forms ends.

    Paths double each round, and only words whose root still has a form go on; counts at least double
    along a chain, so seven rounds end the longest.
    """
    forms = written(forms.select("word", F.col("form").alias("root")), "forms")
    while True:
        onward = forms.alias("a").join(forms.alias("b"), F.col("a.root") == F.col("b.word"), "left").select(
            "a.word", F.coalesce("b.root", "a.root").alias("root"), F.col("b.root").isNotNull().alias("moved"))
        onward = written(onward, "forms")
        forms = onward.drop("moved")
        if onward.where("moved").isEmpty():
            return forms


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_length: int = 5,
                      min_count: int = 3, period: int = 97, factor: int = 2) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every word of the texts.

    Words are the runs of letters, A-Z lower-cased, slips included (see :func:`word_counts`), of at least
    ``min_length`` code points and ``min_count`` occurrences. A word's form is its near word of largest count
    (of equal ones the first in code-point order) if that is at least ``factor`` times its own; its
    root is where the chain of forms ends. A table without words gives an empty result.
    """
    if min_length < 4 or factor < 2:
        raise ValueError("words of fewer than 4 code points lack two disjoint bigrams; a factor below 2 allows circles")
    words = word_counts(docs, id_col=id_col, text_col=text_col, min_length=min_length, min_count=min_count, period=period)
    pairs = written(near_pairs(words), "pairs")
    both = pairs.select(F.col("a").alias("word"), F.col("b").alias("near"), F.col("b_n").alias("near_n")).union(
        pairs.select("b", "a", "a_n"))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), "near")).alias("x"))
    rows = words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(-F.col("x.m") >= factor * F.col("n"), F.col("x.near")).alias("form"), (-F.col("x.m")).alias("near_n"))
    rows = written(rows.withColumn("form_n", F.when(F.col("form").isNotNull(), F.col("near_n"))).drop("near_n"), "variants")
    roots = last_forms(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

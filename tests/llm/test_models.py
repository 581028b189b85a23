import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.llm.decontaminate import answer_of, benchmark_matches, decontaminate, lcs_length
from cuemill.llm.langid import ByteCnn, held_out, language_id, windows
from cuemill.llm.quality import quality_filter, quality_scores


def prose(rng, alphabet, n):
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randrange(2, 8))) for _ in range(n))


# ---- languages ----

def test_windows_cover_every_byte():
    for n in (0, 1, 253, 256, 257, 509, 510, 2000):
        raw = bytes(i % 251 + 1 for i in range(n))
        w = windows(raw)
        again = w[0].tobytes() + b"".join(x.tobytes()[3:] for x in w[1:])
        assert again.rstrip(b"\0") == raw and len(w) == max(1, -(-(n - 3) // 253))


def test_pair_tables_equal_the_plain_convolution():
    rng = random.Random(1)
    rows = [(lang, prose(rng, letters, 30).encode()[:256]) for lang, letters in (("a", "abcde"), ("b", "defgh")) for _ in range(20)]
    model = ByteCnn.train(rows, steps=20)
    w = np.stack([np.frombuffer(r.ljust(256, b"\0"), np.uint8) for _, r in rows])
    x, pooled = model.symbol[w], []
    for f in model.filters:
        n = 256 - len(f) + 1
        conv = sum((model.embedding @ f[k])[x[:, k:k + n]] for k in range(len(f)))
        pooled.append(np.maximum(conv.max(axis=1), 0))
    z = np.concatenate(pooled, axis=1) @ model.dense + model.bias
    p = np.exp(z - z.max(axis=1, keepdims=True))
    assert np.allclose(model.probabilities(w), p / p.sum(axis=1, keepdims=True), atol=1e-4)


def test_language_id_on_held_out(spark):
    rng = random.Random(2)
    alphabets = {"aa": "abcdefgh", "bb": "ghijklmn", "cc": "éàçüabcd"}
    rows = [(i, prose(rng, alphabets[lang], rng.randrange(5, 400)), lang) for i in range(600) for lang in [sorted(alphabets)[i % 3]]]
    odd = [(900, None, "aa"), (901, "", "aa"), (902, "12 !", "bb"), (903, prose(rng, alphabets["bb"], 30_000), None), (None, rows[0][1], "aa")]
    docs = spark.createDataFrame([(*r, "x") for r in rows + odd + rows[:1]], "doc_id long, text string, lang string, score string")
    got = language_id(docs).collect()
    assert len(got) == 606
    by = {r.doc_id: r for r in got}
    import zlib

    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    test = [(by[i].lang_pred, lang) for i, _, lang in rows if by[i].held_out]
    assert len(test) > 150 and np.mean([a == b for a, b in test]) > 0.97
    assert [by[i].lang_pred for i in (900, 901, 902, 903)] == ["und"] * 3 + ["bb"]
    assert all(0 <= r.score <= 1 for r in got)
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert language_id(empty).count() == 0
    assert [r.lang_pred for r in language_id(docs.withColumn("lang", F.lit(None).cast("string"))).collect()] == ["und"] * 606
    assert docs.where(held_out("doc_id").isNull()).count() == 0


# ---- quality ----

def test_quality(spark):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(900):
        bad = i % 5 == 0
        text = prose(rng, "abcdefgh ", 60)
        rows.append((i, text.upper() + " !!" * 30 if bad else text, f"s{i % 9}" if i % 3 else "hot", "en", "x"))
        if i % 2 == 0:
            labels.append((i, 0 if bad else 1))
    rows += [(1000, None, None, None, "x"), (1001, "", "rare", "fr", "x"), rows[1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, keep string")
    labelled = spark.createDataFrame(labels + [(None, 1), (7, None)], "doc_id long, quality int")
    got = quality_scores(docs, labelled).collect()
    assert len(got) == len(rows)
    held = [(r.keep, r.doc_id % 5 != 0) for r in got if r.doc_id < 900 and r.doc_id % 2]
    assert np.mean([a == b for a, b in held]) > 0.98
    kept = quality_filter(docs, labelled)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in got if r.keep)
    none = quality_scores(docs, labelled.where("quality = 1")).collect()
    assert all(r.keep and r.score == 0.5 for r in none)
    empty = spark.createDataFrame([], docs.schema)
    assert quality_scores(empty, labelled).count() == 0


def test_sites_shrink(spark):
    """A sparse site lies between its own rate and the global one; a bad host lowers its documents."""
    from cuemill.llm.quality import site_posteriors

    rows = [("good", "a", 4.0)] * 200 + [("bad", "a", -4.0)] * 200 + [("bad", "b", 4.0)] * 2 + [("new", "a", -4.0)]
    sites, rate, strength = site_posteriors(spark.createDataFrame(rows, "host string, path string, evidence double"))
    host = {r.host: r.host_rate for r in sites.collect()}
    assert host["bad"] < 0.1 < rate < 0.9 < host["good"] and 0.02 < host["new"] < rate and strength > 0


# ---- benchmark ----

def test_lcs():
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(1, 20))] for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(max(row[j] + 1 if x == y else 0, row[j + 1], new[-1]))
            row = new
        assert lcs_length(a, b) == row[-1]
    assert answer_of("one two. Three four five. Six.") == [b"three", b"four", b"five"]


def test_decontamination(spark):
    rng = random.Random(7)
    letters = "abcdefghijklmnop"
    items = [(i, prose(rng, letters, rng.randrange(14, 60)).capitalize() + ".") for i in range(40)]
    rows, leaks = [], set()
    for i in range(500):
        words = prose(rng, letters, rng.randrange(5, 400)).split()
        if i % 6 == 0:
            item = items[i % 40]
            passage = item[1].split()
            if i % 12 == 0:  # a paraphrase: a few words changed, another case
                passage = [w.upper() if rng.random() < 0.3 else w for w in passage]
                passage[len(passage) // 3] = "zzz"
            at = rng.randrange(len(words) + 1)
            words[at:at] = passage
            leaks.add((i, item[0]))
        rows.append((i, " ".join(words), "x"))
    rows += [(600, None, "x"), (601, "", "x"), (602, items[0][1], "x"), (602, items[0][1], "x"), (None, "q", "x"),
             (603, prose(rng, letters, 40_000) + " " + items[1][1], "x")]
    leaks |= {(602, 0), (603, 1)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([*items, (90, None), (91, ""), (None, "!")], "item_id long, text string")
    docs = docs.withColumnRenamed("item_id", "cosine")
    got = benchmark_matches(docs, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == leaks and len(got) == len(leaks) + 1
    assert {(r.doc_id, r.item_id) for r in benchmark_matches(docs, bench, chunk_items=15).collect()} == leaks
    clean = decontaminate(docs, bench)
    assert clean.columns == docs.columns
    assert sorted(r.doc_id or -1 for r in clean.collect()) == sorted(
        {r[0] or (-1 if r[0] is None else 0) for r in rows} - {d for d, _ in leaks})
    assert benchmark_matches(docs.limit(0), bench).count() == 0
    assert benchmark_matches(docs, bench.limit(0)).count() == 0
    assert decontaminate(docs, bench.limit(0)).count() == len(rows)


def rare_words_benchmark(seed, n_items, low, high):
    """Items that share few words, and as many documents that hold one each, word for word."""
    rng = random.Random(seed)

    def text(n):
        return [f"w{rng.randrange(50_000)}" for _ in range(n)]

    items = [(i, " ".join(text(rng.randrange(low, high)))) for i in range(n_items)]
    rows = []
    for i, item in items:
        around, at = text(100), rng.randrange(101)
        rows.append((i, " ".join([*around[:at], item, *around[at:]])))
    return items, rows


@pytest.mark.parametrize("n_items", [400, 1024])
def test_verbatim_items_of_large_benchmarks(spark, n_items):
    items, rows = rare_words_benchmark(5, n_items, 14, 60)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = benchmark_matches(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
    missed = {i for i, _ in items} - {r.item_id for r in got if r.doc_id == r.item_id}
    assert len(missed) == 0


def test_short_items_and_partial_quotes(spark):
    """Ordinary words among rare ones; a half, or all but the last sentence, of long items."""
    rng = random.Random(9)
    common = [f"c{i}" for i in range(300)]
    around = lambda n: [f"r{rng.randrange(10**6)}" for _ in range(n)]
    short = [rng.choices(common, k=rng.randrange(4, 9)) for _ in range(60)]
    long = [rng.choices(common, k=rng.randrange(40, 60)) for _ in range(20)]
    ask = [rng.choices(common, k=12) for _ in range(20)]
    items = [(i, " ".join(w)) for i, w in enumerate(short)] + [(100 + i, " ".join(w)) for i, w in enumerate(long)]
    items += [(200 + i, " ".join(w) + ". Which is it now?") for i, w in enumerate(ask)]
    rows = [(i, w) for i, w in enumerate(short)] + [(100 + i, w[len(w) // 2:]) for i, w in enumerate(long)]
    rows += [(200 + i, w) for i, w in enumerate(ask)]
    rows += [(300 + i, w[:7]) for i, w in enumerate(long)]  # too little of them
    rows = [(i, " ".join([*around(40), *w, *around(40)])) for i, w in rows]
    rows += [(1000 + i, " ".join(rng.sample(common, 150) + around(150))) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = benchmark_matches(docs, bench).collect()
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    missed = {i for i, _ in items} - {r.item_id for r in got if r.doc_id == r.item_id}
    assert len(missed) == 0, sorted(missed)
    assert not [r for r in got if 300 <= r.doc_id < 1000]
    assert {r.doc_id for r in decontaminate(docs, bench).collect()}.isdisjoint(i for i, _ in items)
    one = spark.createDataFrame([(1, "a word"), (2, "word"), (3, "sword")], docs.schema)
    word = spark.createDataFrame([(7, "Word!"), (8, "a word")], bench.schema)
    assert {(r.doc_id, r.item_id) for r in benchmark_matches(one, word).collect()} == {(1, 7), (1, 8), (2, 7)}

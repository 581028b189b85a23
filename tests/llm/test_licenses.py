import random
import re

from cuemill.llm.licenses import NOTICES, PHRASES, license_scan, scan, words_of


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    places = [(i, label) for i in range(len(words)) for p, label in PHRASES.items()
              if words[i:i + len(p.split())] == p.split()]
    at = [i for i, _ in places]
    return (len(words), len(places), min(at, default=None), max(at, default=None),
            ",".join(sorted({x for _, x in places})))


TEXTS = [None, "", "MIT License", "the MIT-license, and MIT\nLicense: cc-by cc by", "smit license mit licenses",
         "É mit license É", "GNU General  Public License" * 2, "cc by cc by cc by", "x" * 100_000 + " MIT license",
         "mit mit license", "KİT mit license"]


def test_base_equals_brute_force(spark):
    docs = spark.createDataFrame([(i, t, "a") for i, t in enumerate(TEXTS)] + [(None, "mit license", "b"), (3, TEXTS[3], "c")],
                                 "doc_id long, text string, labels string")
    got = license_scan(docs).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        if r.doc_id is not None:
            assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute(TEXTS[r.doc_id])


def test_near_notices():
    r = scan("Released under teh Mozila Public Lisense today")
    assert r["labels"] == "mpl" and r["base_labels"] == "" and 0.8 < r["score"] < 1
    assert r["spans"].startswith("mpl@3-5~")
    assert scan("licence apache by the public general")["labels"] == ""
    assert scan("gnu genral public licens")["labels"] == "gpl"
    assert scan("the mit licence")["labels"] == "mit"


def test_empty(spark):
    assert license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute_spans(text):
    words, out = words_of(text), []
    for phrase, label, edits in NOTICES:
        raw, runs = phrase.encode(), []
        for i in range(len(words)):
            for j in range(i, min(len(words), i + 8)):
                e = distance(b" ".join(words[i:j + 1]), raw)
                if e <= edits:
                    runs.append((e, i, j))
        taken = []
        for e, i, j in sorted(runs):
            if all(j < a or b < i for a, b, _ in taken):
                taken.append((i, j, e))
        out += [f"{label}@{i}-{j}~{e}" for i, j, e in sorted(taken)]
    return "; ".join(out)


NEAR = ["mit licence mit license", "mit license mit licence mit license mit licence", "mit licens e mit license a",
        "released under the mit licence released under mit license", "bsd license bsd licensee bsd licence bsd",
        "gnu general public licence gnu genral public license gnu general public license", "all right reserved al rights reserved",
        "apache license version apache licence version apache license", "a mit mit license license", "mozila public licence x"]


def test_spans_equal_brute_force():
    rng = random.Random(5)
    mixed = [" ".join(rng.choice("mit license licence bsd the under released apache version all rights right reserved a e".split())
                      for _ in range(40)) for _ in range(40)]
    for text in NEAR + mixed:
        assert scan(text)["spans"] == brute_spans(text), text
    assert scan(NEAR[0])["spans"].count("mit@") == 2

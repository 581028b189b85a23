import random
import re

import numpy as np
import xxhash

from cuemill.llm.simhash import fingerprint, linked, simhash_components, simhash_dedup


def brute_print(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(prints):
    """Smallest id reachable per (id, print) row."""
    label = list(range(len(prints)))
    while True:
        before = list(label)
        for i, (_, a) in enumerate(prints):
            for j, (_, b) in enumerate(prints):
                if (a ^ b).bit_count() <= 3:
                    label[i] = label[j] = min(label[i], label[j])
        if label == before:
            break
    first = {}
    for (i, _), k in zip(prints, label):
        first[k] = min(first.get(k, i), i)
    return [first[k] for k in label]


def test_fingerprint():
    for t in (None, "", " \n", "one", "One two", "a b c", "a b c d e", "x\x1fy z\xa0w \x0b q", "É Ünï ça", "W " * 70_000):
        assert fingerprint(t) == brute_print(t), t


def test_linked_finds_all_pairs_under_a_key():
    rng = random.Random(2)
    centre = [rng.getrandbits(64) for _ in range(6)]
    fps = [c ^ (sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))) for c in centre for _ in range(60)]
    keys = [rng.randrange(3) for _ in fps]
    a, b = linked(np.array(keys, np.int64), np.array(fps, np.uint64), chunk=50)
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in zip(a, b):
        assert keys[i] == keys[j]
        label[max(root(i), root(j))] = min(root(i), root(j))
    want = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if keys[i] == keys[j] and (fps[i] ^ fps[j]).bit_count() <= 3:
                old, new = max(want[i], want[j]), min(want[i], want[j])
                want = [new if x == old else x for x in want]
    assert len({(root(i), w) for i, w in enumerate(want)}) == len(set(want)) == len({root(i) for i in range(len(fps))})


def near(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    texts = [None, "", "  ", "one", "ONE", "two words"]
    for _ in range(25):
        words = [word() for _ in range(rng.choice([3, 5, 80, 300]))]
        texts.append(" ".join(words))
        for _ in range(3):
            changed = list(words)
            changed[rng.randrange(len(words))] = word()
            texts.append(" ".join(changed))
    texts += [texts[6]] * 40
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(7, "other text for seven", "x"), (None, "none", "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")


def test_components_equal_brute_force(spark):
    rows, docs = near(spark)
    known = [(i, brute_print(t)) for i, t, _ in rows if i is not None]
    want = sorted((i, f"{p:016x}", c) for (i, p), c in zip(known, brute_components(known)))
    got = sorted(map(tuple, simhash_components(docs).collect()))
    assert got == want
    assert len({c for _, _, c in want}) < len(want) - 60
    kept = simhash_dedup(docs).collect()
    assert sorted(r.doc_id for r in kept) == sorted({c for _, _, c in want})
    assert kept[0].asDict().keys() == {"doc_id", "text", "fingerprint"}


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash_components(docs).count() == 0 and simhash_dedup(docs).count() == 0

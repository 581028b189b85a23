"""Recall of reworded benchmark passages."""

import random

from cuemill.llm.decontaminate import benchmark_matches


def reworded(rng, words, common):
    """One word in six is another one, one in twenty is dropped, and two pairs of neighbours change places."""
    out = [rng.choice(common) if rng.random() < 1 / 6 else w for w in words if rng.random() > 0.05]
    for _ in range(2):
        i = rng.randrange(len(out) - 1)
        out[i], out[i + 1] = out[i + 1], out[i]
    return out


def test_reworded_passages(spark):
    rng = random.Random(21)
    common = [f"c{i}" for i in range(3000)]
    items = [rng.choices(common, k=rng.randrange(20, 50)) for _ in range(500)]
    rows = [(i, " ".join([*rng.choices(common, k=60), *reworded(rng, w, common), *rng.choices(common, k=60)]))
            for i, w in enumerate(items)]
    rows += [(1000 + i, " ".join(rng.choices(common, k=150))) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in benchmark_matches(docs, bench).collect()}
    # Those that keep eight words in a row may be found as quotes; the others only by cosine, order and answer.
    padded = [f" {text} " for _, text in rows]
    quoted = {i for i, w in enumerate(items) if any(f" {' '.join(w[k:k + 8])} " in padded[i] for k in range(len(w) - 7))}
    other = set(range(500)) - quoted
    found = {i for i in range(500) if (i, i) in got}
    print(f"recall {len(found)} of 500; without a quote {len(found & other)} of {len(other)}")
    assert len(found) >= 450
    assert len(found & other) >= 0.9 * len(other) and len(other) > 100
    assert all(d == i for d, i in got)

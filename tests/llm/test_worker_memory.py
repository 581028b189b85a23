"""What the pipeline's stages take of an executor's memory."""

import random
import tracemalloc

import numpy as np

from cuemill.llm.decontaminate import Index, row_sums
from cuemill.llm.quality import quality_filter


def test_the_filter_judges_each_text_once(spark):
    rows = [(i, f"{'good words here' if i % 2 else 'x,x;x'} {i}", f"s{i % 3}", None if i % 5 else "en") for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    kept = quality_filter(docs, labels)
    # Each evaluation in a task takes a Python worker of its own.
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython [") == 1
    assert 0 < kept.count() < 60


def test_sums_of_gathered_rows():
    rng = np.random.default_rng(5)
    table = rng.normal(size=(50, 7)).astype(np.float32)
    for sizes in ([1], [20_000], [3, 9000, 1, 8191, 1, 8192, 8193], rng.integers(1, 60, 5000)):
        first = np.cumsum(sizes) - sizes
        rows = rng.integers(0, 50, int(np.sum(sizes)))
        assert (row_sums(table, rows, first) == np.add.reduceat(table[rows], first, axis=0)).all()


def test_search_gathers_few_vectors_at_a_time():
    rng, table = random.Random(3), np.random.default_rng(3)
    words = [b"w%d" % i for i in range(300)]
    items = [rng.choices(words, k=56) for _ in range(4)]
    basis = table.normal(size=(300, 256)).astype(np.float32)
    terms = {w: i for i, w in enumerate(words)}
    placed = np.stack([basis[[terms[w] for w in ws]].sum(axis=0) for ws in items])
    placed /= np.linalg.norm(placed, axis=1, keepdims=True)
    index = Index(terms, np.ones(300), 1.0, basis, placed, [1, 2, 3, 4], items, items, np.full(4, 56), 0.35, 0.6, 0.5)
    text = b" ".join([*rng.choices(words, k=20_000), *items[2], *rng.choices(words, k=20)]).decode()
    tracemalloc.start()
    try:
        found = index.search([text])
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert [(t, i) for t, i, *_ in found] == [(0, 3)]
    assert peak < 48e6  # 2048 passages of 56 vectors of 1 KB were 117 MB

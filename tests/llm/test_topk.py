import math

import numpy as np
from pyspark.sql import functions as F

from cuemill.llm import topk
from cuemill.llm.topk import exact_topk


def brute(rows, k=5):
    ok = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, _ in rows
          if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = set()
    for i, v in ok:
        if i % 10 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in ok if j != i and len(w) == len(v))[:k]
            out |= {(i, r + 1, j, -s) for r, (s, j) in enumerate(best)}
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = exact_topk(df, F.col("vec_id") % 10 == 0, n_pivots=4).collect()
    assert {tuple(r) for r in got} == brute(rows)
    assert len(got) == len(brute(rows))


def test_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "CHUNK", 8)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=12) * (1 + i % 3)).astype(np.float32).tolist(), 0) for i in range(400)]
    rows += [(400 + i, rows[7][1], 0) for i in range(30)]  # ties
    rows += [(500, None, 0), (501, [], 0), (510, [], 0), (502, [math.nan] * 12, 0), (520, [math.inf] + [0.0] * 11, 0),
             (530, [None] + [0.0] * 11, 0), (540, [1.0, 2.0], 0), (541, [-3.0, 1.0], 0), (None, [1.0, 2.0], 0)]
    check(spark, rows)


def test_large_numbers_are_exact(spark):
    rng = np.random.default_rng(4)
    check(spark, [(i, (rng.normal(size=3) * 2e5).astype(np.float32).tolist(), 0) for i in range(50)])


def test_few_and_none(spark):
    check(spark, [(0, [1.0, 0.5], 0), (1, [0.1, 0.2], 0)])
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_topk(df, F.col("vec_id") % 50 == 0).count() == 0

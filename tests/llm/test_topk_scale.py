import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from cuemill.llm import topk
from cuemill.llm.topk import exact_topk


def brute(rows, k, asks):
    """Of (id, integer components): sorted (query_id, rank, vec_id, score), each distinct query row once."""
    out = []
    for i, v in {(i, tuple(v)) for i, v in rows if asks(i)}:
        best = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in rows if j != i and len(w) == len(v))[:k]
        out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(best)]
    return sorted(out)


def search(spark, rows, k=5, every=3):
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")
    return sorted(tuple(r) for r in exact_topk(df.repartition(3), F.col("vec_id") % every == 0, k=k, scale=1.0).collect())


@pytest.fixture
def small_cells(monkeypatch):
    """Several rounds of many cells, of small blocks."""
    for name, value in (("BLOCK", 8), ("CHUNK", 4), ("FIRST", 20), ("GROWTH", 3), ("LEAST_WORK", 2000), ("PIECE", 32)):
        monkeypatch.setattr(topk, name, value)


def test_rounds_of_cells_equal_brute_force(spark, small_cells):
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-9, 9, 6).tolist()) for i in range(200)]
    rows += [(200 + i, rows[3][1]) for i in range(20)] + rows[:10]  # ties, and rows that come again
    rows += [(i, rng.integers(-9, 9, 6).tolist()) for i in range(12)]  # ids that come again with another vector
    rows += [(300 + i, rng.integers(-9, 9, 2).tolist()) for i in range(7)] + [(310, []), (312, []), (333, [1, 2, 3])]
    assert search(spark, rows) == brute(rows, 5, lambda i: i % 3 == 0)


def test_equal_vectors_give_the_smallest_ids(spark, small_cells):
    rows = [(i, [3, -2]) for i in range(150)]
    assert search(spark, rows, k=2) == brute(rows, 2, lambda i: i % 3 == 0)


@pytest.mark.parametrize("reach", [2 ** 11, 2 ** 12, 2 ** 26, 2 ** 27, 2 ** 30])
def test_scores_near_the_limits_of_each_type_are_exact(spark, small_cells, reach):
    rng = np.random.default_rng(6)
    rows = [(i, (reach * (1 if i % 2 else rng.choice([-1, 1], 3)) - rng.integers(0, 3, 3)).tolist()) for i in range(90)]
    rows += [(100 + i, rng.integers(-3, 3, 3).tolist()) for i in range(30)]
    assert search(spark, rows) == brute(rows, 5, lambda i: i % 3 == 0)


def test_what_a_search_is_shipped_stays_small(spark, monkeypatch, tmp_path):
    frame = type(spark.range(0))
    shipped = frame.mapInPandas

    def noted(self, func, schema, *args, **kwargs):
        def run(batches):
            def each():
                for batch in batches:
                    size = sum(len(x) for c in batch for x in batch[c] if isinstance(x, bytes | bytearray))
                    with open(tmp_path / f"{os.getpid()}", "a") as f:
                        f.write(f"{size}\n")
                    yield batch
            return func(each())
        return shipped(self, run, schema, *args, **kwargs)

    monkeypatch.setattr(frame, "mapInPandas", noted)
    n = 16000
    df = spark.range(n).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: (
        F.pmod(F.xxhash64("id", i), F.lit(1000)) / 1000).cast("float")).alias("embedding"))
    assert exact_topk(df, F.col("vec_id") % 2 == 0).count() == 5 * n // 2
    sizes = [int(x) for f in tmp_path.iterdir() for x in f.read_text().split()]
    # Vectors of two bytes a component and ids: 72 bytes a row; queries go to each group of candidates.
    assert max(sizes) < 8e6
    assert sum(sizes) < 20 * 72 * n


def test_cells_follow_the_work_not_the_partitions():
    assert topk.grid(1000, 50_000, 64, 10 ** 6, 6) == (1, 1)
    of, cells = topk.grid(300_000, 14_000_000, 64, 10 ** 8, 6)
    # Queries and candidates are shipped, all in all, a few times as much as the candidates hold.
    assert 48 <= of * cells <= 600 and of * 14_000_000 + cells * 300_000 < 5 * 14_000_000
    assert topk.grid(10 ** 6, 10 ** 6, 64, 10 ** 9, 6)[0] >= 10 ** 9 // topk.QUERY_BYTES
    assert topk.slices(1000) == [1.0]
    shares = topk.slices(15_000_000)
    assert shares[-1] == 1 and abs(shares[0] * 15_000_000 - topk.FIRST) < 1
    assert all(b <= a * topk.GROWTH * 1.001 for a, b in zip(shares, shares[1:]))

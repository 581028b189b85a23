import hashlib
import random

import numpy as np

from cuemill.llm.common import pack_sorted, unpack_sorted
from cuemill.llm.substrings import COVER, PERIOD, _with_blocks, substring_dedup, window_prints


def brute(rows, width):
    """Removed bytes by looking up every string of the input."""
    seen, out = set(), []
    for i, t in sorted((i, (t or "").encode()) for i, t, _ in rows if i is not None):
        gone = [False] * len(t)
        for p in range(len(t) - width + 1):
            s = t[p:p + width]
            if s in seen:
                gone[p:p + width] = [True] * width
            seen.add(s)
        kept = bytes(b for b, g in zip(t, gone) if not g)
        spans = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(t), len(t) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcé") for _ in range(rng.randrange(1, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared = [prose(40) for _ in range(4)] + ["x" * 400, "ab" * 120]
    rows = []
    for i in range(120):
        parts = [prose(rng.randrange(40)) for _ in range(3)]
        for _ in range(rng.randrange(3)):
            parts.insert(rng.randrange(len(parts)), rng.choice(shared))
        rows.append((i * 7, " ".join(parts), "x"))
    rows += [(1000 + i, rows[3][1], "x") for i in range(40)]  # whole copies
    rows += [(2000 + i, rows[5][1][:50] + "!" + rows[5][1][51:], "x") for i in range(20)]  # near copies
    rows += [(3000, None, "x"), (3001, "", "x"), (3002, "short", "x"), (3003, "short", "x"), (None, rows[3][1], "x"),
             (14, rows[2][1], "x"), (1005, "no copy, but a new text under an id whose other text is one " * 3, "x"), (21, "another text with the same id " + shared[0], "x")]
    return rows


def test_cover_has_every_difference():
    assert {(a - b) % PERIOD for a in COVER for b in COVER} == set(range(PERIOD))


def test_prints_tell_windows_apart():
    raw = np.random.default_rng(1).integers(97, 99, 5000).astype(np.uint8)
    for width in (1, 28, 64, 100):
        prints = window_prints(raw, width)
        texts = [raw[i:i + width].tobytes() for i in range(len(raw) - width + 1)]
        assert len(prints) == len(texts) and len(set(prints.tolist())) == len(set(texts))
        first = {}
        assert all(first.setdefault(t, p) == p for t, p in zip(texts, prints.tolist()))


def test_packed_keys():
    for keys in ([], [5], [0, 0, 2**64 - 1], list(range(0, 10**6, 1001))):
        assert unpack_sorted(pack_sorted(np.array(keys, np.uint64))).tolist() == keys


def test_equals_brute_force(spark):
    for seed, block in ((1, 2000), (2, 1 << 20)):
        rows = corpus(seed)
        docs = spark.createDataFrame(rows, "doc_id long, text string, block string").repartition(5)
        got = substring_dedup(docs, block_bytes=block)
        assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"]
        got = got.collect()
        assert sorted(tuple(r)[:5] for r in got) == brute(rows, 100)
        assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got)


def test_empty(spark):
    assert substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = substring_dedup(spark.createDataFrame([(1, None)], "doc_id long, text string"), with_text=False).collect()
    assert [tuple(r) for r in one] == [(1, 0, 0, 0, hashlib.sha256(b"").hexdigest())]


def test_blocks_are_bounded_whatever_the_ids(spark):
    rows = corpus(3)
    dealt = [(None if i is None else (k % 3 << 33) + k, t, x) for k, (i, t, x) in enumerate(rows)]  # as by partition
    far = [(-2**62, "far " * 60, "x"), *dealt, (2**62, "far " * 60, "x")]
    one = [(None if i is None else 5 if k % 2 else i, t, x) for k, (i, t, x) in enumerate(rows)]  # a repeated id
    for rows in (dealt, far, one):
        docs = spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(5)
        placed, size = _with_blocks(docs.selectExpr("doc_id AS id", "text").where("id IS NOT NULL"), 2000)
        blocks, last = {}, -1
        for r in sorted(placed.collect(), key=lambda r: (r.id, (r.text or "").encode())):
            assert r.block >= last
            last = r.block
            blocks[r.block] = blocks.get(r.block, 0) + len((r.text or "").encode()) + 1
        longest = max(len((t or "").encode()) for _, t, _ in rows)
        assert sum(blocks.values()) == size and max(blocks.values()) <= 2000 + longest + 1
        got = substring_dedup(docs, block_bytes=2000, with_text=False).collect()
        assert sorted(tuple(r) for r in got) == brute(rows, 100)

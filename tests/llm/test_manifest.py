import hashlib
import zlib

import pytest

from cuemill.llm.manifest import build_manifest, merkle_manifest, verified_proofs

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g int, h string, no long, claim int"
CAPITALS = {c: c + 32 for c in range(65, 91)}


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(*values):
    return digest("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fanout):
    """The top digest and every node's siblings (left, right), level by level."""
    paths, spans, row = [[] for _ in nodes], [[i] for i in range(len(nodes))], list(nodes)
    while len(row) > 1:
        runs = range(0, len(row), fanout)
        for a in runs:
            run = row[a:a + fanout]
            for j in range(len(run)):
                for i in spans[a + j]:
                    paths[i].append(("".join(run[:j]), "".join(run[j + 1:])))
        spans = [sum(spans[a:a + fanout], []) for a in runs]
        row = [digest("".join(row[a:a + fanout])) for a in runs]
    return row[0], paths


def brute(rows, fanout=16, every=5):
    by = {}
    for d, source, lang, n, text, *_ in rows:
        own = claim = leaf(d, source, lang, n, text)
        if d is not None and zlib.crc32(str(d).encode()) % every == 0:
            claim = leaf(d, source, lang, n, None if text is None else text.translate(CAPITALS))
        by.setdefault(source, []).append((d, own, claim))
    sources = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for s in sources:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    trees = {s: tree([r[1] for r in by[s]], fanout) for s in sources}
    root, tops = tree([trees[s][0] for s in sources], fanout)
    out = []
    for s, top in zip(sources, tops):
        for (d, own, claim), path in zip(by[s], trees[s][1]):
            for a, b in path + top:
                claim = digest(a + claim + b)
            out.append((d, own, trees[s][0], root, digest("".join(a + b for a, b in path + top)), claim, claim == root))
    return out


def key(row):
    return [(v is not None, v or 0) if i == 0 else v for i, v in enumerate(row)]


@pytest.mark.parametrize("fanout, n_sources", [(16, 3), (2, 5), (3, 1), (16, 40)])
def test_equals_brute_force(spark, fanout, n_sources):
    rows = [(i, f"s{i % n_sources}" if i % 3 else "s0", "en" if i % 7 else None, i, f"Text {i} ÄB" * (i % 4), 1, "x", 2, 3)
            for i in range(300)]
    got = merkle_manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), fanout=fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    got = [tuple(r) for r in got.collect()]
    assert sorted(got, key=key) == sorted(brute(rows, fanout), key=key)
    assert {r[-1] for r in got} == {True, False}


def test_nulls_repeats_and_extremes(spark):
    big = 2**60 + 1
    rows = [(None, None, None, None, None), (None, None, None, None, None), (None, "", "", 0, ""), (big, None, "A", 1, "Ab"),
            (big + 2, None, "A", 1, "Ab"), (7, "Zé", None, None, "X" * 200_000), (7, "Zé", None, None, "X" * 200_000),
            (8, "-", "-", -5, "-"), (9, "\U0001f600", "a", 1, "b"), (10, "～", "a", 1, "b")]
    rows = [(*r, 0, "", 0, 0) for r in rows]
    got = [tuple(r) for r in merkle_manifest(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)
    assert len({r[1] for r in got if r[0] is None}) == 2  # null and empty differ


def test_lone_rows_and_empty_table(spark):
    one = [(5, "s", "en", 1, "ab", 0, "", 0, 0)]
    got = merkle_manifest(spark.createDataFrame(one, SCHEMA)).collect()
    assert [tuple(r) for r in got] == brute(one) and got[0].root == got[0].leaf
    assert merkle_manifest(spark.createDataFrame([], SCHEMA)).collect() == []


def test_manifest_of_other_fields_and_claims(spark):
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([(i, "ab"[i % 2], f"t{i}") for i in range(20)], "key int, part string, body string")
    tree_ = build_manifest(rows, id_col="key", source_col="part", fields=("body",), fanout=4,
                           claim=F.when(F.col("key") == 3, F.sha2(F.lit("other"), 256)))
    assert [r.source for r in tree_.subroots().orderBy("source").collect()] == ["a", "b"]
    proofs = verified_proofs(tree_).collect()
    assert [r.id for r in proofs if not r.verified] == [3]
    assert {r.leaf for r in proofs} == {leaf(f"t{i}") for i in range(20)}

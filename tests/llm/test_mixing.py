import pytest

from cuemill.llm.mixing import halved, mix_documents, mix_plan, shard_quotas


def waterfill(sizes, weights, share, cap):
    """Excess of capped sources is reshared until none is above."""
    total, capped = share * sum(sizes.values()), set()
    while True:
        free = [s for s in sizes if s not in capped]
        level = (total - sum(cap * sizes[s] for s in capped)) / (sum(weights[s] for s in free) or 1)
        new = {s for s in free if weights[s] * level >= cap * sizes[s]}
        if not new:
            return {s: cap * sizes[s] if s in capped else weights[s] * level for s in sizes}
        capped |= new


def corpus(spark):
    rows = [(i, "w " * (i % 37), "hot" if i % 3 == 0 else f"s{i % 7}", "x") for i in range(2000)]
    rows += [(2000, None, None, "x"), (2001, "a b c", None, "x"), (5, "w " * 5, "s5", "x"), (2002, "w " * 9000, "s1", "x")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, target string")


def test_targets_and_taken(spark):
    got = mix_plan(corpus(spark), n_shards=8, blocks_per_shard=16).collect()
    assert len(got) == 2004
    assert sum(r.taken for r in got) == pytest.approx(1.5 * sum(r["size"] for r in got), abs=5)
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r["size"]
        by.setdefault((r.source_size, r.target), []).append(r.taken)
    sources = {}
    for r in corpus(spark).collect():
        sources[r.source] = sources.get(r.source, 0) + len((r.text or "").split())
    names = sorted(s for s in sources if s is not None) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    want = waterfill(sources, weights, 1.5, 2.0)
    assert sorted(t for _, t in by) == pytest.approx(sorted(want.values()))
    for (_, target), taken in by.items():
        assert abs(sum(taken) - target) <= 1
    again = mix_plan(corpus(spark).repartition(7), n_shards=8, blocks_per_shard=16).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_tree_quotas_are_exact(spark):
    blocks = spark.createDataFrame([(0, 40), (1, 1), (2, 0), (3, 87)], "source_no long, n_blocks long")
    got = shard_quotas(blocks, 8, 3).collect()
    for s, n in ((0, 40), (1, 1), (3, 87)):
        assert sum(r.quota for r in got if r.source_no == s) == n
    assert {sum(r.quota for r in got if r.shard == k) for k in range(8)} == {16}
    assert len({r.quota for r in got if r.source_no == 0}) > 1


def test_quotas_of_nested_groups(spark):
    """Sources beyond one row: groups of four, of four of them, and so on; the law stays hypergeometric."""
    blocks = {i: (i * 7) % 5 for i in range(70)} | {33: 400}
    rows = spark.createDataFrame(list(blocks.items()), "source_no long, n_blocks long")
    got = [tuple(r) for r in shard_quotas(rows, 8, 3, fan=4).collect()]
    assert all(q > 0 for _, _, q in got)
    for s, n in blocks.items():
        assert sum(q for t, _, q in got if t == s) == n
    totals = [sum(q for _, k, q in got if k == shard) for shard in range(8)]
    assert totals == halved(sum(blocks.values()), 8)
    # The hot source's share of a shard is near its share of all blocks: 400 of 540, deviation about 3.
    hot = [q for t, _, q in got if t == 33]
    assert len(hot) == 8 and all(abs(q - 50) <= 15 for q in hot)
    assert sorted(got) == sorted(tuple(r) for r in shard_quotas(rows.repartition(5), 8, 3, fan=4).collect())


def test_shards_hold_every_block(spark):
    got = mix_plan(corpus(spark), n_shards=8, blocks_per_shard=16).collect()
    goals = {(r.source_size, r.target): r.source_blocks for r in got}
    block = -(-sum(int(t + 0.5) for _, t in goals) // 128)
    assert all(n == -(-int(t + 0.5) // block) for (_, t), n in goals.items())


def test_copies(spark):
    docs = corpus(spark)
    plan = {(r.doc_id, r["size"], r.place): r for r in mix_plan(docs, n_shards=4, blocks_per_shard=8).collect()}
    got = mix_documents(docs, n_shards=4, blocks_per_shard=8).collect()
    assert got[0].asDict().keys() >= set(docs.columns) | {"shard", "copy", "place"}
    assert len(got) == sum((r.words_0 > 0) + (r.words_1 > 0) for r in plan.values())
    for k in range(4):
        places = sorted(r.place for r in got if r.shard == k)
        assert places == list(range(1, len(places) + 1))


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert mix_plan(spark.createDataFrame([], schema)).count() == 0
    rows = mix_plan(spark.createDataFrame([(1, None, "a"), (2, "", None)], schema)).collect()
    assert [(r["size"], r.target, r.taken) for r in rows] == [(0, 0.0, 0)] * 2

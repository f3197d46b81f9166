import random

import numpy as np
import pytest

from test_shingle_sets import shingles, similar
from weft.components import connected_components
from weft.llm import shingle_sets, vote_pivots as v
from weft.llm import simhash_pivots as m


def roots(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_nearest_pivot_has_the_least_total_distance():
    rng = np.random.default_rng(1)
    texts = [rng.integers(0, 1 << 63, n).astype(np.uint64) for n in (1, 2, 7, 60)]
    of = np.array([v.votes(t) for t in texts])
    for number in (0, 5, 95):
        signs = v.pivots(number).T > 0
        signs = np.concatenate([signs, ~signs])
        got = v.nearest(of, number)
        for t, at in zip(texts, got, strict=True):
            bits = np.array([v.votes(t[i : i + 1]) > 0 for i in range(len(t))])
            totals = (bits[:, None, :] != signs[None]).sum(axis=(0, 2))
            assert totals[at] == totals.min()
    assert len(set(v.table_keys(of)[0] >> 18)) == v.TABLES
    assert all(np.bitwise_count(v.fingerprint(x).view(np.uint64)).sum() == (x > 0).sum() for x in of)


@pytest.mark.parametrize(("group", "words"), [(4096, 1 << 21), (16, 1 << 21), (4096, 400)])
def test_no_link_is_lost_in_groups_of_any_size(spark, monkeypatch, group, words):
    """Two groups: chains of sets, dense and scattered, cut into parts or not."""
    monkeypatch.setattr(v, "HUBS", 2)
    rng = random.Random(7)
    rows, sets = [], []
    for k in (1, 2):
        while len(rows) < 60 * k:
            base = {rng.getrandbits(62) for _ in range(rng.randrange(5, 30))}
            for _ in range(rng.randrange(1, 14 if k == 1 else 3)):
                rows.append((k, len(rows) * 1000 - 9000, sorted(base)))
                sets.append((k, frozenset(base)))
                base = set(rng.sample(sorted(base), max(1, len(base) - rng.randrange(0, 4)))) | {rng.getrandbits(62)}
    want = roots(len(rows), lambda i, j: sets[i][0] == sets[j][0] and similar(sets[i][1], sets[j][1]))
    edges = shingle_sets.links(spark.createDataFrame(rows, "k bigint, f bigint, shingles array<bigint>"), group, words)
    at = {f: i for i, (_, f, _) in enumerate(rows)}
    assert all(want[at[r.a]] == want[at[r.b]] for r in edges.collect())
    found = {at[r.node]: at[r.component] for r in connected_components(edges).collect()}
    assert [found.get(i, i) for i in range(len(rows))] == want and len(set(want)) < len(rows) - 20


@pytest.mark.parametrize("copies", [3, 70, 300])
def test_exact_check_of_few_and_many_members(copies):
    """Small groups count by marks, large groups of copies by bitmaps, large groups of unlike sets by marks."""
    rng = random.Random(copies)
    for bases in (1, copies // 2):
        sets = []
        for i in range(copies):
            base = list(range(1000 * (i % bases), 1000 * (i % bases) + 60))
            for at in rng.sample(range(60), rng.randrange(0, 9)):
                base[at] = rng.getrandbits(60)
            sets.append(set(base))
        members = np.concatenate([[i, i, len(x), *sorted(x)] for i, x in enumerate(sets)]).astype(np.int64)
        edges = shingle_sets.spanning_sets(members)
        want = roots(copies, lambda i, j: similar(sets[i], sets[j]))
        assert len(edges) == copies - len(set(want)) and all(similar(sets[a], sets[b]) for a, b in edges)


def made(spark, after):
    """The most rows that a join has made in executions since then, and the number of executions."""
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    executions = store.executionsList()
    for i in range(after, executions.size()):
        key = executions.apply(i).executionId()
        nodes, values = store.planGraph(key).allNodes(), store.executionMetrics(key)
        for j in range(nodes.size()):
            metrics = nodes.apply(j).metrics()
            for k in range(metrics.size() if "Join" in nodes.apply(j).name() else 0):
                value = values.get(metrics.apply(k).accumulatorId())
                if metrics.apply(k).name() == "number of output rows" and value.isDefined():
                    most = max(most, int(value.get().replace(",", "")))
    return most, executions.size()


def test_near_copies_without_a_hub_make_no_pairs(spark, docs):
    """Copies of a text that isn't there, most of similarity 0.76 to each other, some of 0.8: 45,000 pairs of 300 texts."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    base, rows = [rng.choice(words) for _ in range(1004)], []
    for i in range(300):
        near = i and i % 10 == 0
        text = rows[-1][1].split() if near else list(base)
        for at in rng.sample(range(200), 3 if near else 14):
            text[5 * at + 2] = rng.choice(words)
        rows.append((i, " ".join(text)))
    sets = [shingles(t) for _, t in rows]
    want = sorted(set(roots(len(rows), lambda i, j: similar(sets[i], sets[j]))))
    _, before = made(spark, 1 << 30)
    assert sorted(r.doc_id for r in m.keep_one(docs(rows)).collect()) == want and 20 < len(want) < 300
    most, after = made(spark, before)
    assert after > before and 0 < most <= 2 * v.TABLES * len(rows) < len(rows) ** 2 // 3  # spanning edges of each table, both ways


def test_near_copies_meet_by_pivots_only(spark, docs, monkeypatch):
    rows = [(1, " ".join(f"w{i}" for i in range(100))), (2, " ".join(f"w{i}" for i in range(99))), (3, "other words stand here alone")]
    assert sorted(r.doc_id for r in m.keep_one(docs(rows)).collect()) == [1, 3]
    monkeypatch.setattr(v, "spanning_prints", lambda members: [])
    assert sorted(r.doc_id for r in m.keep_one(docs(rows)).collect()) == [1, 2, 3]


def test_stars_and_lowered_edges_have_the_same_components(spark):
    """Trees of twenty tables have many times as many edges as members; what is left has about one each."""
    rng = random.Random(6)
    most, dealt, trees = 300, [], []
    for _ in range(20):
        cells = [[x for x in range(most) if x % 3 < 2 and rng.random() < 0.6], rng.sample(range(most), 4)]
        for ids in cells:
            tree = [(ids[rng.randrange(i)] - 100, ids[i] - 100) for i in range(1, len(ids))]
            got = v.stars(tree)
            assert sorted(got) == [(min(ids) - 100, x - 100) for x in sorted(ids) if x != min(ids)]
            dealt += got
            trees += tree
    edges = spark.createDataFrame(dealt, "a bigint, b bigint")
    low = v.lowered(edges)
    found = {r.node: r.component for r in connected_components(low).collect()}
    assert found == {r.node: r.component for r in connected_components(spark.createDataFrame(trees, "a bigint, b bigint")).collect()}
    assert len(set(trees)) > 5 * len(found) and low.count() <= 1.2 * len(found)
    assert v.stars([]) == [] and v.stars([(5, 5)]) == []


def test_near_copies_that_meet_in_all_tables_make_an_edge_each(spark, docs):
    """The edges of 48 tables' trees made 18 rows a text in the components' joins."""
    rng = random.Random(4)
    words = [f"w{i}" for i in range(900)]
    base, rows = [rng.choice(words) for _ in range(504)], []
    for i in range(300):
        text = list(base)
        for at in rng.sample(range(100), rng.randrange(1, 7)):
            text[5 * at + 2] = rng.choice(words)
        rows.append((i, " ".join(text)))
    sets = [shingles(t) for _, t in rows]
    want = sorted(set(roots(len(rows), lambda i, j: similar(sets[i], sets[j]))))
    _, before = made(spark, 1 << 30)
    assert sorted(r.doc_id for r in m.keep_one(docs(rows)).collect()) == want and len(want) < 10
    most, after = made(spark, before)
    assert after > before and 0 < most <= 2 * len(rows)

import random

import numpy as np
from xxhash import xxh64_intdigest

from weft.llm import simhash_pivots as m

EDGE = [(None, "no id"), (7, None), (8, ""), (9, " \t\n"), (10, "one"), (11, "one two"), (12, "x " * 30000), (13, "A b C"), (14, "a B c"), (14, "a B c")]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, ids):
    parent = list(range(len(prints)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    out = {}
    for i in range(len(prints)):
        members = [ids[j] for j in range(len(prints)) if root(j) == root(i) and ids[j] is not None]
        out[i] = min(members, default=None)
    return out


def test_against_brute_force(spark, docs):
    rng = random.Random(3)
    words = [f"w{i}" for i in range(60)]
    rows = list(EDGE)
    for i in range(60):
        text = [rng.choice(words) for _ in range(rng.randrange(40, 90))]
        rows.append((100 + 10 * i, " ".join(text)))
        for j in range(rng.randrange(0, 4)):
            text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((101 + 10 * i + j, " ".join(text)))
    got = [(r.doc_id, r.f & (2**64 - 1), r.component_id) for r in m.near_duplicates(docs(rows)).collect()]
    prints = [plain_fingerprint(t) for _, t in rows]
    want = components(prints, [i for i, _ in rows])
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(got, key=key) == sorted(((i, p, want[k]) for k, ((i, _), p) in enumerate(zip(rows, prints, strict=True))), key=key)


def planted(n=400, seed=5):
    rng = random.Random(seed)
    centre = rng.getrandbits(64)
    near = {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 5))) for _ in range(n)}
    far = {rng.getrandbits(64) for _ in range(200)}
    return sorted(near | far)


def test_no_link_is_lost_in_dense_groups(spark):
    """With a small group size the finer split has to find everything that the coarse groups hand on."""
    prints = planted()
    df = spark.createDataFrame([(m._signed(p),) for p in prints], "f bigint")
    want = components(prints, list(range(len(prints))))
    classes = lambda pairs: {frozenset(v) for v in pairs.values()}
    groups = {}
    for i, c in want.items():
        groups.setdefault(c, set()).add(prints[i])
    for size in (4096, 4):
        found = m.connected_components(m.links(df, group=size)).collect()
        got = {}
        linked = set()
        for r in found:
            got.setdefault(r.component, set()).add(r.node & (2**64 - 1))
            linked.add(r.node & (2**64 - 1))
        for p in prints:
            if p not in linked:
                got[("single", p)] = {p}
        assert classes(got) == classes(groups)


def test_spanning_edges():
    prints = np.array([m._signed(p) for p in planted(60)], np.int64)
    edges = m.spanning_edges(prints, 3)
    assert all((a & (2**64 - 1) ^ b & (2**64 - 1)).bit_count() <= 3 for a, b in edges)


def test_keep_one_and_empty(spark, docs):
    rows = [*EDGE, (1, "same words here again"), (2, "same words here again"), (3, "quite another text there")]
    kept = m.keep_one(docs(rows))
    assert kept.columns == ["doc_id", "text", "source"]
    got = sorted((r.doc_id is None, r.doc_id) for r in kept.collect())
    assert (False, 1) in got and (False, 2) not in got and (False, 3) in got and len(set(got)) == len(got)
    assert m.near_duplicates(docs([])).collect() == [] and m.keep_one(docs([])).collect() == []

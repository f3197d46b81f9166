import random

from weft.llm import simhash_pivots as m


def shingles(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} or {tuple(words)}


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def corpus(seed=11):
    """Bases with near copies of similarity 0.6 to 0.97, chains of near copies, and one large group."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(30):
        base = [rng.choice(words) for _ in range(rng.randrange(60, 300))]
        rows.append((1000 * i, " ".join(base)))
        text = list(base)
        for j in range(40 if i == 0 else rng.randrange(0, 5)):
            if rng.random() < 0.5:
                text = list(base)
            for _ in range(max(1, round(len(text) * rng.uniform(0.002, 0.04)))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((1000 * i + j + 1, " ".join(text)))
    return rows


def test_keep_one_against_brute_force(spark, docs):
    rows = corpus()
    sets = [shingles(t) for _, t in rows]
    component = list(range(len(rows)))
    near = 0
    for i in range(len(rows)):
        for j in range(i):
            if similar(sets[i], sets[j]):
                near += len(sets[i] & sets[j]) / len(sets[i] | sets[j]) < 0.95
                a, b = component[i], component[j]
                component = [min(a, b) if c in (a, b) else c for c in component]
    assert near > 30
    want = sorted(min(rows[j][0] for j in range(len(rows)) if component[j] == c) for c in set(component))
    assert sorted(r.doc_id for r in m.keep_one(docs(rows)).collect()) == want


def test_signatures_agree_as_minima_do(spark):
    import numpy as np
    from pyspark.sql import functions as F

    from weft.llm import shingle_sets as S

    rng = np.random.default_rng(2)
    a = rng.integers(0, 1 << 63, (30, S.BANDS * S.ROWS)).astype(np.uint64) << np.uint64(1)
    b = np.where(rng.random(a.shape) < 0.6, a, rng.integers(0, 1 << 63, a.shape).astype(np.uint64) << np.uint64(1))
    assert ((S.signature(a[0]) == S.signature(b[0])).sum() < 5) and len(set(S.signature(a[0]).view(np.uint8).tolist())) > 40
    rows = [(i, S.signature(x).tolist(), S.signature(y).tolist()) for i, (x, y) in enumerate(zip(a, b, strict=True))]
    out = spark.createDataFrame(rows, "i int, a array<long>, b array<long>").select("i", S.alike(F.col("a"), F.col("b")).alias("n")).collect()
    assert all(r.n == int((S.signature(a[r.i]).view(np.uint8) == S.signature(b[r.i]).view(np.uint8)).sum()) for r in out)

import pytest

import corpus_pipeline as p
from tests_plain import plain_hits, plain_place

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage gets and gives, written and read again as the next one's documents."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in p.STAGES:
        made = p.cut(stage(spark, docs, SF), f"test-{name}")
        out.append((name, docs, made))
        docs = made
    return {name: (before, after) for name, before, after in out}


def _ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(stages):
    names = [x for x, _ in p.STAGES]
    assert names == ["language", "near_duplicates", "decontamination", "mixing", "sharding"]
    for name in names[:-1]:
        before, after = stages[name]
        assert after.columns == before.columns and after.count() > 0


def test_language_keeps_texts_of_a_language(stages):
    before, after = stages["language"]
    kept = set(_ids(after))
    rows = before.select("doc_id", "text", "lang").collect()
    assert all(any(c.isalpha() for c in r.text) for r in rows if r.doc_id in kept)
    lost = [r for r in rows if r.doc_id not in kept and r.text and any(c.isalpha() for c in r.text)]
    assert len(lost) <= 0.02 * len(rows)


def test_near_duplicates_against_all_pairs(stages):
    before, after = stages["near_duplicates"]
    texts = {r.doc_id: tuple((r.text or "").encode().lower().split()) for r in before.select("doc_id", "text").collect()}
    sets = {i: {w[k : k + 5] for k in range(max(1, len(w) - 4))} if w else set() for i, w in texts.items()}
    root = {i: i for i in texts}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if (not x and not y) or 5 * len(x & y) >= 4 * len(x | y) > 0:
                ra, rb = find(a), find(b)
                root[max(ra, rb)] = min(ra, rb)
    assert _ids(after) == sorted({find(i) for i in ids})


def test_decontamination_against_windows(spark, stages):
    before, after = stages["decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    assert _ids(after) == sorted(r.doc_id for r in before.collect() if plain_hits(r.text, items)[1] == 0)


def test_mixing_meets_targets(spark, stages):
    from weft.llm import soft_mixing as M

    before, after = stages["mixing"]
    texts = {r.doc_id: r.text for r in before.collect()}
    given = {i: 0 for i in texts}
    for i in _ids(after):
        given[i] += 1  # and no others
    model = M.fit(before, M.quality_domains(spark.read.parquet(f"{SF}/labels.parquet")))
    raw = {i: (t or "").encode() for i, t in texts.items()}
    posterior = {i: model.posteriors(model.features(t)[None])[0] for i, t in raw.items()}
    mixed = {r.doc_id: r._mix for r in M.mix(before, model, M.TARGETS).collect()}
    tokens = sum(len(t.split()) for t in raw.values())
    totals = sum(mixed[i].rate * len(raw[i].split()) * posterior[i] for i in raw) / tokens
    wanted = [M.TARGETS.get(d, 0.0) for d in model.domains]
    assert all(abs(a - b) < 0.02 for a, b in zip(totals, [w / sum(wanted) for w in wanted], strict=True))
    assert all(given[i] == mixed[i].copies and abs(mixed[i].copies - mixed[i].rate) <= 1 for i in given)


def test_sharding_against_plain_descent(stages):
    from weft.llm import hash_tree as T

    before, after = stages["sharding"]
    rows = after.collect()
    assert sorted(r.doc_id for r in rows) == _ids(before)
    assert all(r.shard == plain_place(r.doc_id, T.tree(T.SHARDS))[2] for r in rows)
    slots = {}
    for r in rows:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_registered():
    import __spark_entry__ as e

    names = e.queries()
    assert {f"op{n}_" for n in range(1, 11)} <= {x.split("_")[0] + "_" for x in names} and "pipeline" in names
    assert set(e.oracle_sql()) <= set(names)

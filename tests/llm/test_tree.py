import zlib
from collections import defaultdict

from pyspark.sql import functions as F
from tests_plain import plain_place

from weft.llm import hash_tree as T

EDGE = [(None, "no id"), (7, None), (8, ""), (9, " \t\n"), (10, "one"), (11, "z. " * 20000), (12, "same"), (12, "same")]


def test_sharding(docs, monkeypatch):
    rows = [*EDGE, *((100 + i, "é" * (i % 5)) for i in range(800)), *[(99, "again")] * 70]
    monkeypatch.setattr(T, "NUMBERED", 100)
    monkeypatch.setattr(T, "RUN", 16)
    for n in (7, 12):
        out = T.shard_documents(docs(rows), n).collect()
        assert len(out) == len(rows)
        slots, leaves = defaultdict(list), T.tree(n)
        for r in out:
            assert (r.region, r.rack, r.shard) == plain_place(r.doc_id, leaves) and r.grown_shard == plain_place(r.doc_id, T.grown(leaves))[2]
            assert r.grown_shard in (r.shard, n)
            slots[r.shard].append(r.slot)
        assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == n
        assert len({r.shard for r in out if r.doc_id == 99}) == 1
        want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
        assert sorted((r["size"], r.text_crc32) for r in out) == want
    assert T.shard_documents(docs([])).collect() == []


def test_weights_move_only_changed_subtrees(docs):
    df = docs([(i, "") for i in range(6000)]).select("doc_id")
    leaves = T.tree(18, 3, 2)  # three regions of two racks
    heavier = [T.Leaf(x.shard, x.rack, x.region, 3.0 if x.shard == 4 else 1.0) for x in leaves]
    both = T.place(T.place(df, F.col("doc_id"), leaves), F.col("doc_id"), heavier, "new_").collect()
    moved = [r for r in both if r.shard != r.new_shard]
    assert moved
    for r in moved:
        assert r.new_region == 0  # the region that grew takes, the others only give
        if r.region == 0:
            assert r.new_rack == 1
            if r.rack == 1:
                assert r.new_shard == 4
    assert abs(sum(r.new_shard == 4 for r in both) / 6000 - 3 / 20) < 0.02
    assert all(abs(sum(r.shard == s for r in both) / 6000 - 1 / 18) < 0.02 for s in range(18))


def test_grown_takes_only_into_itself(docs):
    df = docs([(i, "") for i in range(3000)]).select("doc_id")
    for n in (13, 40):
        both = T.place(T.place(df, F.col("doc_id"), T.tree(n)), F.col("doc_id"), T.grown(T.tree(n)), "new_").collect()
        assert all(r.new_shard in (r.shard, n) for r in both) and any(r.new_shard == n for r in both)


def test_zero_weights(docs):
    leaves = [T.Leaf(0, 0, 0, 0.0), T.Leaf(1, 0, 0, 1.0), T.Leaf(2, 1, 1, -1.0)]
    assert {r.shard for r in T.place(docs(EDGE), F.col("doc_id"), leaves).collect()} == {1}


def test_query(spark):
    from __spark_entry__ import queries

    sf = "/root/testdata/sf0.001"
    out = queries()["op8_hash_tree"](spark, sf).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(out) == len(texts)
    for r in out:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert (r.shard, r.grown_shard) == (plain_place(r.doc_id, T.tree(40))[2], plain_place(r.doc_id, T.grown(T.tree(40)))[2])

"""The registered queries over a whole small table, column by column, against plain versions or SQL."""

import hashlib
import zlib
from collections import defaultdict

import duckdb
import pytest
from xxhash import xxh64_intdigest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def _rows(spark, name, columns):
    out = entry.queries()[name](spark, SF)
    assert out.columns[: len(columns)] == columns
    return out.collect()


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_op1(spark, documents):
    rows = _rows(spark, "op1_simhash_pivots", ["doc_id", "fingerprint", "component_id"])
    prints = {i: plain_fingerprint(r.text) for i, r in documents.items()}
    assert {r.doc_id: r.fingerprint for r in rows} == {i: f"{f:016x}" for i, f in prints.items()}
    least = {i: i for i in prints}
    for _ in prints:
        before = dict(least)
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 3 and least[b] < least[a]:
                    least[a] = least[b]
        if before == least:
            break
    assert {r.doc_id: r.component_id for r in rows} == least


def test_op2(spark, documents):
    rows = _rows(spark, "op2_progressive_jpeg", ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    same = defaultdict(set)
    for r in rows:
        raw = (documents[r.doc_id].text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        same[raw].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in same.values())


def test_op3(spark, documents):
    from weft.llm.soft_mixing import TARGETS

    rows = _rows(spark, "op3_soft_mixing", ["doc_id", "n_tokens"])
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len((d.text or "").encode().split()) for i, d in documents.items()}
    names = [c[2:] for c in rows[0].__fields__ if c.startswith("p_")]
    assert all(abs(sum(r[f"p_{d}"] for d in names) - 1) < 1e-5 and r.rate >= 0 and abs(r.copies - r.rate) <= 1 for r in rows)
    total, wanted = sum(r.n_tokens for r in rows), sum(TARGETS[d] for d in names)
    for d in names:
        assert abs(sum(r.n_tokens * r.rate * r[f"p_{d}"] for r in rows) / total - TARGETS[d] / wanted) < 0.02


def test_op4(spark, documents):
    rows = _rows(spark, "op4_byte_cnn", ["doc_id", "held_out", "lang_pred", "score"])
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    known = {d.lang for d in documents.values() if d.lang}
    for r in rows:
        text = documents[r.doc_id].text or ""
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
        assert r.lang_pred in known if any(c.isalpha() for c in text) else r.lang_pred == "und"
    unseen = [r for r in rows if r.held_out and r.lang_pred != "und" and documents[r.doc_id].lang]
    assert sum(r.lang_pred == documents[r.doc_id].lang for r in unseen) >= 0.9 * len(unseen) > 0


def test_op5(spark, documents):
    rows = _rows(spark, "op5_clause_grammar", ["doc_id", "held_out", "score", "predicted"])
    assert sorted(r.doc_id for r in rows) == sorted(documents)
    same = defaultdict(set)
    for r in rows:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        same[documents[r.doc_id].text or ""].add(r.score)
    assert all(len(x) == 1 for x in same.values())


@pytest.mark.parametrize("name", ["op6_decontaminate", "op7_line_spread", "op9_chat_format"])
def test_against_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    out = entry.queries()[name](spark, SF)
    found = con.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(out.columns)
    assert sorted(map(str, map(list, out.select(*columns).collect()))) == sorted(map(str, map(list, found.fetchall())))

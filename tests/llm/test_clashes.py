"""Each operator over nulls, empty and long texts, repeated rows, ties, an empty table, and columns named as inside."""

import pytest
from pyspark.sql import functions as F

from weft.llm import byte_cnn, chat_format, clause_grammar, decontaminate, hash_tree, line_spread, progressive_jpeg, sentence_spans, simhash_pivots, soft_mixing
from weft.llm._common import bound_batches

PASSAGE = "One sentence of the passage that repeats has these words, then come a few more. Another one goes on for quite a while, with words enough to count. The third of them ends it here, as it has to. "
ROWS = [(1, PASSAGE), (2, PASSAGE), (2, PASSAGE), (None, PASSAGE), (3, None), (None, None), (4, ""), (5, " \n\t"), (6, "word"), (7, "you idiot. " * 9000), (8, "é" * 50000), (9, "line\n" * 3000), (10, "ünïcode 漢字。第二句！ \U0001f600"), (11, PASSAGE + "Its own end."), (11, "another text of the same id")]
CLASHES = ["f", "n", "d", "k", "pos", "h1", "text_hash", "component_id", "size", "region", "slot", "_lang", "a.b", "weft_i", "weft_h", "weft_n", "weft_row", "weft_x", "weft_d", "weft_k", "weft_m", "weft_found", "weft_more", "weft_gone", "weft_key", "weft_rate", "weft_numbers", "WEFT_SHARD", "_key", "_x", "_rate", "_weft_n"]


@pytest.fixture(scope="module")
def frame(spark):
    df = spark.createDataFrame([(i, t, None if n % 4 == 0 else f"s{n % 3}", ("aa", "bb", None)[n % 3]) for n, (i, t) in enumerate(ROWS)], "doc_id bigint, text string, source string, lang string")
    bound_batches(spark)
    return df.select("*", *[F.lit(f"own {c}").alias(c) for c in CLASHES])


def _mixed(df):
    labels = df.sparkSession.createDataFrame([(1, "x"), (2, "y"), (2, "x"), (None, "x"), (7, None)], "doc_id bigint, domain string")
    return soft_mixing.mix(df, soft_mixing.fit(df, labels), {"x": 0.5, "y": 0.5})


def _toxic(df):
    labels = df.sparkSession.createDataFrame([(1, 0), (7, 1), (7, 0), (None, 1), (2, None)], "doc_id bigint, toxic int")
    return clause_grammar.score_toxicity(df, clause_grammar.fit(df, labels))


def _clean(df):
    items = df.sparkSession.createDataFrame([(1, PASSAGE), (2, "word"), (None, "word"), (3, None)], "item_id bigint, text string")
    return decontaminate.decontaminate(df, items, limit=150)


PASSING = {
    "keep_one": (simhash_pivots.keep_one, None),
    "jpeg": (lambda df: df.withColumn("_jpeg", progressive_jpeg.encode_column(F.col("text").cast("binary"))).withColumn("_rgb", progressive_jpeg.tensor_column(F.col("_jpeg"))), len(ROWS)),
    "mixing": (_mixed, len(ROWS)),
    "language": (lambda df: byte_cnn.identify(df, df, out="_found_lang"), len(ROWS)),
    "toxicity": (_toxic, len(ROWS)),
    "decontamination": (_clean, len(ROWS)),
    "lines": (line_spread.remove_spread_lines, len(ROWS)),
    "tree": (lambda df: hash_tree.place(df, F.col("doc_id"), hash_tree.tree(7), "new_"), len(ROWS)),
    "spans": (sentence_spans.remove_repeated_spans, len(ROWS)),
}


@pytest.mark.parametrize("name", PASSING)
def test_columns_pass(frame, name):
    operator, count = PASSING[name]
    out = operator(frame)
    rows = out.collect()
    assert out.columns[: len(frame.columns)] == frame.columns or set(frame.columns) <= set(out.columns)
    if count is not None:
        assert len(rows) == count
        key = lambda x: (x[0] is None, x[0] or 0, x[1] is None, x[1] or "")
        assert sorted(((r["doc_id"], r["text"]) for r in rows), key=key) == sorted(ROWS, key=key)
    for r in rows:
        assert all(r[c] == f"own {c}" for c in CLASHES)
    assert operator(frame.limit(0)).collect() == []


def test_what_is_kept(frame):
    kept = [(r["doc_id"], r["text"]) for r in simhash_pivots.keep_one(frame).collect()]
    assert kept.count((1, PASSAGE)) == 1 and (2, PASSAGE) not in kept and (None, PASSAGE) not in kept
    assert sum(not (t or "").strip() for _, t in kept) == 1 and len(kept) == len(set(kept))


def test_the_same_row_of_repeats_stays(spark):
    rows = [(5, "some words of a text", s) for s in "abcdef" for _ in range(30)]
    first = [tuple(r) for r in simhash_pivots.keep_one(spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)).collect()]
    again = [tuple(r) for r in simhash_pivots.keep_one(spark.createDataFrame(rows[::-1], "doc_id bigint, text string, source string").repartition(2)).collect()]
    assert len(first) == 1 and first == again


def test_own_columns(frame):
    found = simhash_pivots.near_duplicates(frame).collect()
    assert len(found) == len(ROWS) and {r.component_id for r in found if r.doc_id in (1, 2)} == {1}
    placed = hash_tree.shard_documents(frame).collect()
    assert len(placed) == len(ROWS) and len({r.shard for r in placed if r.doc_id == 2}) == 1


def test_chats(spark):
    rows = [(1, 0, "user", "u"), (1, 0, "user", "u"), (1, None, None, None), (None, 1, "assistant", "a"), (2, 1, "assistant", "x" * 100000), *[(3, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(700)]]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").select("*", *[F.lit(1).alias(c) for c in ("t", "ts", "ps", "formatted", "loss_mask", "turns")])
    out = {r.conv_id: r for r in chat_format.read_back(chat_format.format_chats(df)).withColumn("loss", chat_format.under_mask(F.col("formatted"), F.col("loss_mask"))).collect()}
    assert out[1].loss == "" and out[2].loss == "x" * 100000 and out[None].loss == "a" and len(out[1].turns) == 3
    assert out[3].loss == "".join(f"t{i}" for i in range(1, 700, 2)) and [t.text for t in out[3].turns] == [f"t{i}" for i in range(700)]
    assert chat_format.format_chats(df.limit(0)).collect() == []

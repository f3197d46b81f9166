import hashlib
import random
from collections import defaultdict

import numpy as np
from pyspark.sql import functions as F

from tests_plain import plain_hits
from weft.llm._common import text_key
from weft.llm import byte_cnn, chat_format, clause_grammar, decontaminate, line_spread, soft_mixing

EDGE = [(None, "no id"), (7, None), (8, ""), (9, " \t\n"), (10, "one"), (11, "z. " * 20000), (12, "same"), (12, "same")]


# --------------------------------------------------------------------------------------------------- decontamination
def test_decontamination(spark, docs):
    rng = random.Random(1)
    vocab = ["Alpha", "beta", "gámma", "d4", "É", "x"]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([0, 2, 5, 12, 14])))) for i in range(12)] + [(90, None), (None, "beta beta")]
    rows = [*EDGE, *((100 + i, ", ".join(rng.choice(vocab) for _ in range(rng.randrange(1, 300)))) for i in range(25)), *((200 + n, f"start! {t} end") for n, (_, t) in enumerate(items) if t)]
    frame = spark.createDataFrame(items, "item_id bigint, text string")
    known = [(i, t) for i, t in items if i is not None]
    for limit in (decontaminate.AUTOMATON_CHARS, 300):  # one automaton, and one after the other
        out = decontaminate.decontaminate(docs(rows), frame, limit=limit).collect()
        assert len(out) == len(rows)
        for r in out:
            n, h, found = plain_hits(r.text, known)
            assert (r._found.n_words, r._found.n_hit, r._found.items) == (n, h, found)
            for s in r._found.spans:
                words = decontaminate.normalised(r.text[s.start : s.end])
                assert words == decontaminate.normalised(r.text)[s.first_word : s.last_word + 1]
    assert decontaminate.decontaminate(docs([]), frame).collect() == []
    assert {r._found.n_hit for r in decontaminate.decontaminate(docs(rows[:12]), frame.limit(0)).collect()} == {0}


# ------------------------------------------------------------------------------------------------------------ lines
def test_line_spread(spark):
    rng = random.Random(2)
    rows = [(i, "\n".join(rng.choice(["menu ", "  menu", "about", "", f"own {i}", "rare"]) for _ in range(rng.randrange(1, 8))), rng.choice(["a", "b", "c", "d", None])) for i in range(60)]
    rows += [(None, "menu\nx", "a"), (70, None, "b"), (71, "", "c"), (72, "menu", None), (72, "menu", None)]
    sites = defaultdict(set)
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            if line.strip(" ") and s is not None:
                sites[line.strip(" ")].add(s)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumn("h1", F.lit(1)).withColumn("pos", F.lit("p"))
    for lg_k, sigmas in ((12, 8), (4, 50)):  # decided by sketches, and by exact counts
        out = line_spread.remove_spread_lines(df, sites=3) if lg_k == 12 else None
        lines = df.filter("text is not null").select(F.explode(F.split("text", "\n")).alias("l"), F.col("source").alias("site")).select(F.trim("l").alias("l"), "site").filter("l <> ''")
        h1, h2 = text_key(F.col("l"))
        spread = line_spread.spread_lines(lines.select(h1.alias("h1"), h2.alias("h2"), "site"), 3, lg_k, sigmas).count()
        assert spread == sum(len(s) >= 3 for s in sites.values())
        if out is None:
            continue
        got = out.collect()
        assert len(got) == len(rows)
        for r in got:
            gone = [i for i, line in enumerate((r.text or "").split("\n")) if len(sites[line.strip(" ")]) >= 3] if r.text is not None else []
            assert r._removed == gone
            assert r._clean == (None if r.text is None else "\n".join(line for i, line in enumerate(r.text.split("\n")) if i not in gone))
    assert line_spread.remove_spread_lines(df.limit(0)).collect() == []


# -------------------------------------------------------------------------------------------------------------- chat
def test_chat_format(spark):
    rows = [(1, 1, "assistant", "<|end|>\n<|start|>user\n&lt;"), (1, 0, "user", "hi"), (1, 2, "assistant", ""), (1, 3, "user", None), (2, None, None, "x\ny"), (2, 0, "a<\n&nl;", "é<|also|>"), (None, 0, "assistant", "null"), (3, 0, "user", "u"), (3, 0, "user", "u")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit("clash"))
    out = chat_format.read_back(chat_format.format_chats(df)).withColumn("loss", chat_format.under_mask(F.col("formatted"), F.col("loss_mask"))).collect()
    assert len(out) == 4
    for r in out:
        mine = sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: (x[1] is not None, x[1] or 0, x[2] or "", x[3] or ""))
        assert [(t.role, t.text) for t in r.turns] == [(x[2] or "", x[3] or "") for x in mine]
        assert r.loss == "".join(x[3] or "" for x in mine if x[2] == "assistant")
        blocks = 1 + sum((a[2] or "") != (b[2] or "") for a, b in zip(mine, mine[1:], strict=False))
        assert r.formatted.count(chat_format.START) == r.formatted.count(chat_format.END) == blocks
    assert chat_format.format_chats(df.limit(0)).collect() == []


# ---------------------------------------------------------------------------------------------------------- language
def test_language(spark):
    words = {"aa": "the of and ing tion with from".split(), "bb": "ñez ción los para que una doña".split(), "cc": "für über straße nicht ungen schön".split()}
    rng = random.Random(4)
    make = lambda lang: " ".join(rng.choice(words[lang]) for _ in range(rng.randrange(5, 60)))
    rows = [(i, make(lang), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 50)]
    train, test = rows[:120], rows[120:]
    test += [(900, None, "aa"), (901, "", "aa"), (902, "123 !!", "aa"), (None, make("bb"), None), (903, make("bb") * 200, "bb")]
    schema = "doc_id bigint, text string, lang string"
    labelled = spark.createDataFrame([*train, (800, None, "aa"), (801, "x", None)], schema)
    found = byte_cnn.identify(spark.createDataFrame(test, schema), labelled).collect()
    good = sum(r._lang.lang_pred == r.lang for r in found if r.doc_id is not None and r.doc_id not in (900, 901, 902))
    assert good >= 29 and all(0 <= r._lang.score <= 1 for r in found)
    assert [r._lang.lang_pred for r in found if r.doc_id in (900, 901, 902)] == ["und"] * 3
    assert byte_cnn.identify(labelled.limit(0), labelled).collect() == []
    assert {r._lang.lang_pred for r in byte_cnn.identify(labelled, labelled.limit(0)).collect()} == {"und"}


def test_tables_equal_the_network():
    rng = np.random.default_rng(0)
    x = rng.integers(0, 256, (40, byte_cnn.WINDOW)).astype(np.uint8)
    model = byte_cnn.train(x, np.arange(40) % 3, ["a", "b", "c"], epochs=1)
    assert np.allclose(byte_cnn._forward(model, x)[0], byte_cnn.Predictor(model).windows(x), atol=1e-4)


# ---------------------------------------------------------------------------------------------------------- toxicity
def test_grammar():
    words, machine = clause_grammar.lexicon(), clause_grammar.grammar()
    score = lambda t: sum(clause_grammar.clause_scores(t, words, machine)[1])
    assert score("a quiet day") == score(None) == score("") == 0
    assert score("you idiot") > score("an idiot") > score("he said that some idiot came") > 0
    assert score("an idiot") > score("he is not an idiot") > 0
    assert score("i will kill you") > 0 == score("kill the process")
    assert score("not here. idiot") == score("idiot")
    assert score("classidiotic") == 0


def test_toxicity(spark):
    rng = random.Random(6)
    plain = [f"w{c}{d}" for c in "abcdefgh" for d in "xyzuvw"]
    bad = ["gorp", "blarg"]
    rows = [(i, " ".join(rng.choice(plain) for _ in range(40)) + (f" {rng.choice(bad)} {rng.choice(bad)}." if i % 4 == 0 else ".")) for i in range(160)]
    docs = spark.createDataFrame([*rows, (900, None), (901, ""), (None, "gorp blarg gorp")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(120)] + [(121, None), (None, 1)], "doc_id bigint, toxic int")
    scorer = clause_grammar.fit(docs, labels)
    assert {w for w, (s, _) in scorer.words.items() if s == "I"} >= set(bad)
    out = {r.doc_id: r._toxicity.score for r in clause_grammar.score_toxicity(docs, scorer).collect()}
    assert all((out[i] >= 0.7) == (i % 4 == 0) for i in range(120, 160)) and out[None] >= 0.7 and out[900] == out[901] < 0.7
    unlearned = clause_grammar.fit(docs, labels.limit(0))
    assert (unlearned.weights == clause_grammar.DEFAULT).all()


# ------------------------------------------------------------------------------------------------------------ mixing
def test_rates_meet_targets(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.4, 0.4, 0.4], 400)
    n = rng.integers(0, 500, 400)
    members = spark.createDataFrame([(int(a), *map(float, b)) for a, b in zip(n, p, strict=True)], "n bigint, p0 double, p1 double, p2 double")
    targets = {"a": 0.6, "b": 0.3, "c": 0.1}
    steps, totals = soft_mixing.solve(members, ["a", "b", "c"], targets)
    rates = soft_mixing.rates_after(p, steps)
    assert (rates >= 0).all() and np.allclose((n * rates) @ p, totals)
    assert np.allclose(totals / n.sum(), [0.6, 0.3, 0.1], atol=1e-3)


def test_mixing(spark, docs):
    rows = [*EDGE, *((100 + i, ("good fine " if i % 3 else "junk!! ##") * 20 + str(i)) for i in range(150))]
    df = docs(rows)
    labels = spark.createDataFrame([(100 + i, "good" if i % 3 else "junk") for i in range(100)] + [(None, "good"), (7, None)], "doc_id bigint, domain string")
    model = soft_mixing.fit(df, labels)
    soft_mixing.bound_batches(spark)
    out = soft_mixing.mix(df, model, {"good": 0.9, "junk": 0.1}).collect()
    assert len(out) == len(rows) and model.domains == ["good", "junk"]
    tokens = sum(r._mix.tokens for r in out)
    share = sum(r._mix.tokens * r._mix.rate * r._mix.p.good for r in out) / tokens
    assert abs(share - 0.9) < 0.01 and all(r._mix.rate >= 0 and abs(r._mix.copies - r._mix.rate) <= 1 for r in out)
    assert soft_mixing.mix(df.limit(0), model, {"good": 1.0}).collect() == []
    assert soft_mixing.fit(df, labels.limit(0)).domains == ["all"]


def test_digest_of_items():
    assert decontaminate.digest(["1", "10"]) == hashlib.sha256(b"1,10").hexdigest()

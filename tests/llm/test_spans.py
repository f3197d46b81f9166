import random

import pytest

from weft.llm import sentence_spans as S

EDGE = [(None, "no id"), (7, None), (8, ""), (9, " \t\n"), (10, "one"), (11, "z. " * 20000), (12, "same"), (12, "same")]


def plain_removed(rows, span, min_words):
    """Numbers of the sentences to remove for each row: every run of any length against every earlier place."""
    texts = sorted({(i is None, i or 0, t) for i, t in rows if t is not None})
    sentences = {}
    for key in texts:
        at = S.bounds(key[2])
        sentences[key] = [" ".join(key[2][a:b].lower().split()) for a, b in zip(at, at[1:], strict=False)]

    def counts(own, a, b):
        words = len(" ".join(own[a:b]).split())
        if words == 0:
            return False
        whole = a == 0 and b == len(own) and b >= span and words < min_words
        return whole or (words >= min_words and (b - a >= span or b - a == 1))

    seen, gone = set(), {}
    for key in texts:
        own, marks, mine = sentences[key], set(), []
        for a in range(len(own)):
            for b in range(a + 1, len(own) + 1):
                if counts(own, a, b):
                    mine.append((a, b, tuple(own[a:b])))
        for a, b, run in sorted(mine):
            if run in seen:
                marks |= set(range(a, b))
            seen.add(run)
        gone[key] = sorted(marks)
    return {(i, t): gone[i is None, i or 0, t] for i, t in rows if t is not None}


@pytest.mark.parametrize("seed", range(3))
def test_against_all_runs(docs, seed):
    rng = random.Random(seed)
    words = ["Aa", "bb", "cc,", "dd", "é"]
    sentence = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(1, 5))) + rng.choice([". ", "! ", "\n"])
    pool = ["".join(sentence() for _ in range(rng.randrange(1, 5))) for _ in range(12)]
    rows = [(n if n % 17 else None, "".join(rng.choice([rng.choice(pool), sentence()]) for _ in range(rng.randrange(1, 6)))) for n in range(60)]
    rows += [(3, "Short one. Short two. Three."), (4, "short one.  short TWO. Three."), (4, "short one.  short TWO. Three."), (5, "alone"), (6, "alone"), (None, None)]
    for span, least in ((2, 6), (3, 8), (2, 1)):
        out = S.remove_repeated_spans(docs(rows), span=span, min_words=least).collect()
        assert len(out) == len(rows)
        want = plain_removed(rows, span, least)
        for r in out:
            if r.text is not None:
                # texts that equal another row's in id have one result; ids that repeat with other texts are ordered by hash
                if sum(i == r.doc_id for i, _ in rows) == 1:
                    assert r._spans.removed == want[r.doc_id, r.text], (span, least, r.text)


def test_edges(docs):
    passage = "The first sentence of a passage has some words. A second one follows it closely with more. The third is here to make it long enough! And a fourth ends it, so that it has as many words as are needed. "
    rows = [*EDGE, (1, f"Own start one. {passage}Own end one."), (2, f"Other start two, quite different. {passage}"), (3, "Nothing in common with the others at all. Truly nothing whatsoever here."), (None, passage), (4, passage), (4, passage)]
    got = S.remove_repeated_spans(docs(rows)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r)
        left = "".join(r.text[a:b] for a, b in zip([0, *(x.end for x in r._spans.ranges)], [*(x.start for x in r._spans.ranges), len(r.text)], strict=True)) if r.text is not None else None
        assert left == r._spans.clean
    assert not by[1][0]._spans.removed and not by[3][0]._spans.removed
    assert by[2][0]._spans.clean == "Other start two, quite different. "
    assert all(r._spans.clean == "" for r in by[4]) and [r._spans.clean for r in by[None] if r.text == passage] == [""]
    assert by[7][0]._spans.clean is None and by[8][0]._spans.clean == ""
    assert S.remove_repeated_spans(docs([])).collect() == []


def test_a_passage_inside_other_sentences(docs):
    rng = random.Random(5)
    vocab = [f"w{a}{b}" for a in "abcdefgh" for b in "klmnop"]
    run = lambda n: "".join(rng.choice(vocab) + rng.choice([" ", " ", " ", ", ", ". "]) for _ in range(n))
    caught = 0
    for n in range(60):
        passage = run(55)
        a, b = run(30) + passage + run(30), run(41) + passage + run(7)
        spans = [set(zip(*(x.tolist() for x in S.span_hashes(t)[2:4]), strict=True)) for t in (a, b)]
        caught += bool(spans[0] & spans[1])
        assert not spans[0] & set(zip(*(x.tolist() for x in S.span_hashes(run(400))[2:4]), strict=True)), n
    assert caught >= 54


def test_bounds():
    for text in ("", "a", "A b. C d! E\n\nF", "word " * 400, "x, " * 400, "é. " * 3, "句子。第二！第三" * 30):
        at = S.bounds(text)
        assert at[0] == 0 and at[-1] == len(text) and at == sorted(set(at))


def test_query(spark):
    from __spark_entry__ import queries

    sf = "/root/testdata/sf0.001"
    out = {r.doc_id: r for r in queries()["op10_sentence_spans"](spark, sf).collect()}
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert len(out) == len(rows) and [c for c in next(iter(out.values())).__fields__] == ["doc_id", "n_sentences", "n_removed", "removed_ranges", "removed_chars", "clean_sha256"]
    first = {}
    for i, t in sorted((x for x in rows if x[1]), key=lambda x: x[0]):
        begins, ends, h1, _, again = S.span_hashes(t)
        gone = set()
        for a, b, h, x in zip(begins.tolist(), ends.tolist(), h1.tolist(), again, strict=True):
            if first.setdefault(h, i) != i or x:
                gone |= set(range(a, b))
        assert out[i].n_removed == len(gone) and out[i].n_sentences == len(S.bounds(t)) - 1

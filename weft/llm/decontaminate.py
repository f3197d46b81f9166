"""Benchmark decontamination with an Aho-Corasick automaton.

Item texts are normalised to words; every run of ``window`` words (a shorter item is one window) becomes a pattern,
words joined and bounded by single spaces. One automaton holds all patterns and each document's normalised text is
scanned once. The position of a match in the normalised text is mapped to word numbers and from these to character
offsets of the original text.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.llm._common import LOWER, UPPER, bound_batches, quoted, spare, table

WINDOW = 10
#: Characters of patterns that one automaton may hold. A character is a state of about 40 bytes, so 160 MB in a worker; its
#: items, about a tenth of the patterns, are what is broadcast. A benchmark with more is cut into parts; a document's text
#: then passes one automaton after the other, and the results are merged. (An automaton over word numbers has a sixth of
#: the states, but takes two and a half times as long to scan with.)
AUTOMATON_CHARS = 4 << 20
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans(UPPER, LOWER)
_SPANS = "array<struct<start:int,end:int,first_word:int,last_word:int>>"
RESULT = f"n_words long, n_hit long, items array<string>, spans {_SPANS}"


def normalised(text: str | None) -> list[str]:
    return WORD.findall((text or "").translate(_LOWER))


def patterns(items: list[tuple[str, str | None]], window: int = WINDOW) -> dict[tuple[str, ...], tuple[str, ...]]:
    """Window -> ids of the items that have it."""
    owners: dict[tuple[str, ...], set[str]] = defaultdict(set)
    for item, text in items:
        words = normalised(text)
        for i in range(max(1, len(words) - window + 1) if words else 0):
            owners[tuple(words[i : i + window])].add(item)
    return {w: tuple(sorted(ids)) for w, ids in owners.items()}


class Finder:
    """The automaton of some windows."""

    def __init__(self, found: dict[tuple[str, ...], tuple[str, ...]]):
        self.automaton = ahocorasick.Automaton()
        for words, ids in found.items():
            pattern = f" {' '.join(words)} "
            self.automaton.add_word(pattern, (len(pattern), len(words), ids))
        if found:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, int, list[str], list[dict]]:
        """Words, words hit, ids of items with occurring windows, and merged spans of the original text."""
        words = normalised(text)
        if not words or not len(self.automaton):
            return len(words), 0, [], []
        ids, runs = set(), []
        for end, (length, n, owners) in self.automaton.iter(f" {' '.join(words)} "):
            ids.update(owners)
            runs.append((end - length + 1, n))
        if not runs:
            return len(words), 0, [], []
        # a word's position in the normalised text is that of the space before it
        at = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        first = np.searchsorted(at, [p for p, _ in runs])
        change = np.zeros(len(words) + 1, np.int64)
        np.add.at(change, first, 1)
        np.add.at(change, first + np.array([n for _, n in runs]), -1)
        hit = np.cumsum(change[:-1]) > 0
        edges = np.flatnonzero(np.diff(np.concatenate(([False], hit, [False])).astype(np.int8)))
        where = [m.span() for m in WORD.finditer(text.translate(_LOWER))]  # one character for one: offsets of the original
        spans = [{"start": where[a][0], "end": where[b - 1][1], "first_word": int(a), "last_word": int(b) - 1} for a, b in zip(edges[::2], edges[1::2], strict=True)]
        return len(words), int(hit.sum()), sorted(ids), spans


#: In a worker: the automaton of the part that its tasks scan with, built once and not for each task.
_built: dict[str, Finder] = {}


def joined(a: tuple, b: tuple) -> tuple:
    """What two automata found in one text: words are hit by either, and touching spans become one."""
    spans = []
    for x in sorted([*a[3], *b[3]], key=lambda x: x["first_word"]):
        if spans and x["first_word"] <= spans[-1]["last_word"] + 1:
            if x["last_word"] > spans[-1]["last_word"]:
                spans[-1] = {**spans[-1], "last_word": x["last_word"], "end": x["end"]}
        else:
            spans.append(dict(x))
    return a[0], sum(x["last_word"] - x["first_word"] + 1 for x in spans), sorted({*a[2], *b[2]}), spans


def _scanned(text: Column, before: Column | None, part: list[tuple[str, str]], window: int, spark: SparkSession) -> Column:
    """What one part's automaton finds, joined with what those before it found."""
    shared, name, names = spark.sparkContext.broadcast(part), uuid.uuid4().hex, ["n_words", "n_hit", "items", "spans"]

    def finder() -> Finder:
        if name not in _built:
            _built.clear()
            _built[name] = Finder(patterns(shared.value, window))
        return _built[name]

    @F.pandas_udf(RESULT)
    def first(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([finder().scan(t) for t in texts], columns=names)

    @F.pandas_udf(RESULT)
    def more(batches: Iterator[tuple[pd.Series, pd.DataFrame]]) -> Iterator[pd.DataFrame]:
        for texts, found in batches:
            yield pd.DataFrame([joined(x, finder().scan(t)) for t, x in zip(texts, found[names].itertuples(index=False, name=None), strict=True)], columns=names)

    return first(text.cast("string")) if before is None else more(text.cast("string"), before)


def _parts(items: DataFrame, item_col: str, item_text_col: str, window: int, limit: int) -> Iterator[list]:
    """Items part by part; the driver holds one part at a time. An item that a part has no room for goes on in the next one,
    with texts that overlap by a window less one word, so every part is bounded."""
    part, size = [], 0
    for row in items.select(F.col(item_col).cast("string"), F.col(item_text_col).cast("string")).toLocalIterator():
        if row[0] is None or row[1] is None:
            continue
        words = normalised(row[1])
        begin = 0
        while begin <= max(0, len(words) - window) and words:
            # windows from here on, as many as the part has room for, one at least
            end, cost = begin, 0
            while end == begin or (end <= len(words) - window and size + cost <= limit):
                cost += sum(map(len, words[end : end + window])) + window + 1
                end += 1
            part.append((row[0], " ".join(words[begin : end - 1 + window])))
            size += cost
            begin = end
            if size > limit:
                yield part
                part, size = [], 0
    yield part


def decontaminate(df: DataFrame, items: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, limit: int = AUTOMATON_CHARS) -> DataFrame:
    """df with one more column ``_found``: struct n_words, n_hit, items (sorted ids), spans of the original text.

    Null and empty texts have no words. Items whose id or text is null, or that have no words, have no windows; items
    that repeat are one item if their id is the same. Without items nothing is hit. A column ``_found`` that df has is
    replaced; all other columns pass through whatever their names. Equal rows have equal results.
    """
    spark = df.sparkSession
    bound_batches(spark)
    kept = [c for c in df.columns if c != "_found"]
    (one,) = spare(df, "weft_found")
    out = df
    for i, part in enumerate(_parts(items, item_col, item_text_col, window, limit)):
        out = out.withColumn(one, _scanned(F.col(text_col), F.col(one) if i else None, part, window, spark))
    return out.select(*quoted(kept), F.col(one).alias("_found"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents; null texts have no words, items with a null id no windows."""
    found = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("_found.n_words").alias("n_words"),
        F.col("_found.n_hit").alias("n_hit"),
        F.size("_found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("_found.items", ","), 256).alias("items_sha256"),
        (F.col("_found.n_hit") > 0).alias("contaminated"),
    )


def digest(items: list[str]) -> str:
    return hashlib.sha256(",".join(items).encode()).hexdigest()


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM documents),
     b AS (SELECT CAST(item_id AS VARCHAR) AS item,
                  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
           FROM benchmark WHERE item_id IS NOT NULL),
     bw AS (SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
            FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
     ns AS (SELECT DISTINCT n FROM bw),
     dw AS (SELECT r, i, n, array_to_string(w[i : i + n - 1], ' ') AS s
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, ns WHERE len(w) >= n)),
     hit AS (SELECT r, i, dw.n AS n, item FROM dw JOIN bw USING (n, s)),
     nh AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hit) GROUP BY r),
     ni AS (SELECT r, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS h FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(h, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN nh USING (r) LEFT JOIN ni USING (r)
"""

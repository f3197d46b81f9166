"""Substring dedup over sliding spans of sentences.

A run of sentences counts if it has SPAN sentences or more and MIN_WORDS words or more, if it is one sentence of that many
words, or if it is a whole text of SPAN sentences or more. A sentence goes if it lies in a run whose words occur at an
earlier place (a smaller document, or further ahead in the same one). Every run that counts has its sentences covered by
shortest runs inside it, so the shortest that begin at each sentence and the shortest that end at each are hashed, and
no others. Runs are counted, and of those that occur more than once the first place is found, by aggregations, so a run
that a third of all documents share is combined before it is shuffled; the joins back to the places are ones whose large
partitions Spark can split.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh3_128_digest

from weft.checkpointing import cut
from weft.llm._common import bound_batches, quoted, spare, table

SPAN = 2
#: A run with fewer words is chance or a phrase, not a passage. A passage of 50 words that begins and ends inside
#: sentences has as many in whole ones.
MIN_WORDS = 34
#: A sentence ends with . ! or ? and the blanks after it, with their full-width forms, or with a newline.
END = re.compile(r"[.!?]+\s+|[。！？]+\s*|\n+")
#: What is longer than LONG characters is cut after commas and after words of 14 letters or more, places that depend on
#: the words there alone: a passage is cut alike in whatever sentence it stands.
LONG, INNER = 120, re.compile(r"[,;:]\s+|\S{14,}\s+|[，、；：]")
_RANGES = "array<struct<start:int,end:int>>"


def bounds(text: str) -> list[int]:
    """0, the end of each sentence, ..., len(text); one number for an empty text."""
    out = [0]
    for end in (*(m.end() for m in END.finditer(text)), len(text)):
        begin = out[-1]
        if end > begin:
            if end - begin > LONG:
                out += [m.end() for m in INNER.finditer(text, begin, end) if m.end() < end]
            out.append(end)
    return out


def _words(text: str, at: list[int]) -> list[list[str]]:
    return [text[a:b].lower().split() for a, b in zip(at, at[1:], strict=False)]


def runs(lengths: list[int], span: int = SPAN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """First sentence and end of each run to hash, given the sentences' numbers of words."""
    n, length = len(lengths), np.asarray(lengths, np.int64)
    total = np.concatenate(([0], np.cumsum(length)))
    place = np.arange(n)
    if total[-1] < min_words:
        whole = int(n >= span and total[-1] > 0)
        return np.zeros(whole, np.int64), np.full(whole, n)
    alone = length >= min_words
    ends = np.where(alone, place + 1, np.maximum(place + span, np.searchsorted(total, total[:-1] + min_words)))
    begins = np.where(alone, place, np.minimum(place + 1 - span, np.searchsorted(total, total[1:] - min_words, side="right") - 1))
    found = np.concatenate((np.stack((place, ends))[:, ends <= n], np.stack((begins, place + 1))[:, begins >= 0]), axis=1)
    found = np.unique(found, axis=1)
    return found[0], found[1]


def span_hashes(text: str | None, span: int = SPAN, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each run its first sentence, its end, 128 bits of hash in two numbers, and whether the text has it before."""
    words = _words(text or "", bounds(text or ""))
    begins, ends = runs(list(map(len, words)), span, min_words)
    parts = [" ".join(w).encode("utf-8", "surrogatepass") for w in words]
    digests = [xxh3_128_digest(b"\n".join(parts[i:e])) for i, e in zip(begins, ends, strict=True)]
    both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
    seen: set[bytes] = set()
    again = np.fromiter((d in seen or seen.add(d) is not None for d in digests), bool, len(digests))
    return begins.astype(np.int32), ends.astype(np.int32), both[:, 0], both[:, 1], again


def cleaned(text: str | None, found: list | None) -> tuple[int, list[int], list[dict], str | None]:
    """Sentences, numbers of those removed, character ranges removed, and what is left if anything was removed."""
    at = bounds(text or "")
    if found is None or not len(found):
        return len(at) - 1, [], [], None
    change = np.zeros(len(at), np.int64)
    for r in found:
        change[r["begin"]] += 1
        change[r["end"]] -= 1
    gone = np.cumsum(change[:-1]) > 0
    edges = np.flatnonzero(np.diff(np.concatenate(([False], gone, [False])).astype(np.int8)))
    ranges = [{"start": at[a], "end": at[b]} for a, b in zip(edges[::2], edges[1::2], strict=True)]
    left = "".join(text[at[i] : at[i + 1]] for i in np.flatnonzero(~gone))
    return len(gone), np.flatnonzero(gone).tolist(), ranges, left


def _hashed(text: Column, span: int, min_words: int) -> Column:
    @F.pandas_udf("begin array<int>, end array<int>, h1 array<long>, h2 array<long>, again array<boolean>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            yield pd.DataFrame([span_hashes(t, span, min_words) for t in texts], columns=["begin", "end", "h1", "h2", "again"])

    return of(text.cast("string"))


def _cleaned(text: Column, found: Column) -> Column:
    @F.pandas_udf(f"n int, removed array<int>, ranges {_RANGES}, clean string")
    def of(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, lists in batches:
            yield pd.DataFrame([cleaned(t, s) for t, s in zip(texts, lists, strict=True)], columns=["n", "removed", "ranges", "clean"])

    return of(text.cast("string"), found)


def remove_repeated_spans(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", span: int = SPAN, min_words: int = MIN_WORDS) -> DataFrame:
    """df with one more column ``_spans``: struct n (sentences), removed (sorted sentence numbers from 0), ranges
    (removed character ranges) and clean (the text that is left, null if the text is null).

    Documents are ordered by id, nulls last, then by the hash of the text; rows with equal id and text are one document
    and get the same result. A later repeat inside the same document is removed as well. Sentences are compared in
    lower case with blanks collapsed; what is kept is unchanged, character for character. A text of fewer words than
    ``min_words`` is compared as a whole, if it has ``span`` sentences; shorter repeats inside longer texts, at their
    ends too, stay. Null and empty texts lose nothing. Other columns pass through whatever their names; a column
    ``_spans`` is replaced. An empty table gives no rows.
    """
    bound_batches(df.sparkSession)
    kept = [c for c in df.columns if c != "_spans"]
    keyed = df.select(F.col(id_col).alias("d"), F.xxhash64(F.col(text_col)).alias("k"), F.col(text_col).alias("text")).filter("text is not null")
    # read several times below, so texts are cut and hashed once; rows are numbered there, as a number is short to shuffle
    hashed = cut(keyed.select(F.monotonically_increasing_id().alias("m"), "d", "k", _hashed(F.col("text"), span, min_words).alias("s")).select("m", "d", "k", "s.*"), "spans")
    zipped = F.inline(F.arrays_zip("begin", "end", "h1", "h2", "again"))
    across = hashed.select("m", zipped).filter(~F.col("again")).drop("again")
    often = cut(across.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h1", "h2"), "often")
    candidates = cut(across.join(often, ["h1", "h2"], "left_semi"), "candidates").join(hashed.select("m", "d", "k"), "m")
    place = F.struct(F.col("d").isNull().alias("z"), F.col("d").alias("d"), F.col("k").alias("k"))
    first = candidates.groupBy("h1", "h2").agg(F.min(place).alias("first"))
    later = candidates.join(first, ["h1", "h2"]).filter(place != F.col("first")).select("d", "k", "begin", "end")
    inside = hashed.filter(F.array_contains("again", True)).select("d", "k", zipped).filter("again").select("d", "k", "begin", "end")
    tmp, d, k, found = spare(df, "weft_x", "weft_d", "weft_k", "weft_found")
    marks = later.unionByName(inside).groupBy(F.col("d").alias(d), F.col("k").alias(k)).agg(F.collect_set(F.struct("begin", "end")).alias(found))  # two for each sentence of the text at most
    source = df.select(*quoted(kept), F.xxhash64(F.col(text_col)).alias(tmp))
    joined = source.join(marks, F.col(id_col).eqNullSafe(F.col(d)) & (F.col(tmp) == F.col(k)), "left")
    done = joined.withColumn(tmp, _cleaned(F.col(text_col), F.col(found)))
    part = F.col(tmp)
    return done.select(*quoted(kept), F.struct(part["n"].alias("n"), part["removed"].alias("removed"), part["ranges"].alias("ranges"), F.coalesce(part["clean"], F.col(text_col)).alias("clean")).alias("_spans"))


def op10_sentence_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents; null texts have no sentences, equal rows equal results."""
    out = remove_repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("_spans.n").cast("long").alias("n_sentences"),
        F.size("_spans.removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("_spans.ranges", lambda r: F.concat_ws("-", r["start"].cast("string"), r["end"].cast("string"))), ",").alias("removed_ranges"),
        (F.coalesce(F.char_length("text"), F.lit(0)) - F.coalesce(F.char_length("_spans.clean"), F.lit(0))).cast("long").alias("removed_chars"),
        F.sha2(F.coalesce("_spans.clean", F.lit("")), 256).alias("clean_sha256"),
    )

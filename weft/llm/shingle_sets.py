"""Five-word shingle sets: their sketches, and the exact check that their Jaccard similarity is 0.8 or more.

Which texts are compared is decided by ``vote_pivots``: by SimHash fingerprints and tables of nearest pivots. Its links make
classes, and every pair of a class that isn't linked yet by others is settled here by the sets themselves.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weft.llm import vote_pivots
from weft.llm._common import utf8

SHINGLE, SEED, BANDS, ROWS = 5, 42, 20, 4


def shingle_set(text: bytes | None) -> np.ndarray:
    """The distinct 64-bit hashes of a UTF-8 text's five-word shingles; a shorter text is one shingle."""
    words = (text or b"").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    runs = list(map(b" ".join, zip(*(words[i:] for i in range(SHINGLE)), strict=False))) or [b" ".join(words)]
    return np.unique(np.fromiter(map(xxh64_intdigest, runs, repeat(SEED)), np.uint64, len(runs)))


def signature(least: np.ndarray) -> np.ndarray:
    """A byte of each minimum, eight to a signed number. The upper bytes of a minimum are zero more often than not."""
    return (least >> np.uint64(16)).astype(np.uint8).view("<i8")


def sketch_column(text: Column) -> Column:
    """Struct f (64 bits that stand for the words), print (the SimHash of the shingle set) and keys (one for each table of
    pivots); an empty set has no keys."""

    @F.pandas_udf("f long, print array<long>, keys array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            sets = [shingle_set(t) for t in texts]
            votes = np.array([vote_pivots.votes(s) for s in sets], np.int64).reshape(len(sets), vote_pivots.WIDTH)
            f = np.array([xxh64_intdigest(b" ".join((t or b"").lower().split()), SEED) for t in texts], np.uint64).view(np.int64)
            keys = [k if len(s) else k[:0] for k, s in zip(vote_pivots.table_keys(votes), sets, strict=True)]
            yield pd.DataFrame({"f": f, "print": [vote_pivots.fingerprint(v) for v in votes], "keys": keys})

    return of(utf8(text))


def alike(a: Column, b: Column) -> Column:
    """The number of bytes in which two signatures agree."""
    total = None
    for i in range(BANDS * ROWS // 8):
        x = F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))
        for shift, mask in ((4, 0x0F), (2, 0x03), (1, 0x01)):  # each byte's bits are folded into its lowest
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift)).bitwiseAND(F.lit(int.from_bytes(bytes([mask]) * 8)))
        differ = F.bit_count(x)
        total = differ if total is None else total + differ
    return F.lit(BANDS * ROWS) - total


def set_column(text: Column) -> Column:
    @F.pandas_udf("array<long>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([shingle_set(t).view(np.int64) for t in texts])

    return of(utf8(text))


def spanning_sets(members: np.ndarray) -> list[tuple[int, int]]:
    """Spanning edges of the members (id, class, number of words, shingles) whose sets have similarity 0.8 or more."""
    heads, at = [], 0
    while at < len(members):
        heads.append(at)
        at += vote_pivots.HEAD + int(members[at + 2])
    heads = np.array(heads)
    sizes = members[heads + 2]
    own = np.ones(len(members), bool)
    own[(heads[:, None] + np.arange(vote_pivots.HEAD)).ravel()] = False
    known, numbers, times = np.unique(members[own], return_inverse=True, return_counts=True)
    ends = np.cumsum(sizes)
    ids, classes = members[heads], members[heads + 1]
    # what only one member has is in no intersection; if the others are few, as among copies of one text, bitmaps are narrow
    places = np.cumsum(times > 1) - 1
    if len(heads) > 64 and 64 * len(numbers) >= len(heads) * places[-1]:
        rows = np.zeros((len(heads), 8 * (places[-1] // 64 + 1)), np.uint8)
        for row, end, n in zip(rows, ends, sizes, strict=True):
            of = numbers[end - n : end]
            flags = np.zeros(8 * len(row), bool)
            flags[places[of[times[of] > 1]]] = True
            row[:] = np.packbits(flags)
        bits = rows.view(np.uint64)

        def close(i: int, rest: np.ndarray) -> np.ndarray:
            common = np.bitwise_count(bits[rest] & bits[i]).sum(axis=1, dtype=np.int64)
            return 5 * common >= 4 * (sizes[i] + sizes[rest] - common)

        return vote_pivots.walk(ids, classes, close)
    marks = np.zeros(len(known), np.int32)

    def near(i: int, rest: np.ndarray) -> np.ndarray:
        marks[numbers[ends[i] - sizes[i] : ends[i]]] = 1
        if len(rest) < 8:
            common = np.array([marks[numbers[ends[j] - sizes[j] : ends[j]]].sum() for j in rest], np.int64)
        else:
            common = np.add.reduceat(marks[numbers], ends - sizes, dtype=np.int64)[rest]
        marks[numbers[ends[i] - sizes[i] : ends[i]]] = 0
        return 5 * common >= 4 * (sizes[i] + sizes[rest] - common)

    return vote_pivots.walk(ids, classes, near)


def links(members: DataFrame, group: int = vote_pivots.GROUP, words: int = vote_pivots.WORDS) -> DataFrame:
    """Rows (k, f, shingles), k a class of texts that may be similar -> edges (a, b) with the components of all similar pairs."""
    bodies = members.select("k", "f", vote_pivots.member(F.col("f"), F.col("shingles")).alias("body"))
    return vote_pivots.class_edges(bodies, spanning_sets, group, words)

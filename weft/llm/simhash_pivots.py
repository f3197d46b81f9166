"""SimHash near-duplicates through pivot distance tables.

A fingerprint's row in the pivot table holds its Hamming distances to reference fingerprints. By the triangle
inequality two fingerprints that differ in at most ``k`` bits differ by at most ``k`` in every coordinate, so a pair
whose largest coordinate difference exceeds ``k`` is discarded, and the pairs that survive are verified bit by bit.

Which pairs meet at all is decided by the coordinates too, by equality, so that a shuffle can bring them together.
Besides the scattered ``PIVOTS`` there are unit pivots (zero and the 64 single bits). Within a block of bits the
distances to the block's unit pivots fix the block: d(f, unit i) - d(f, zero) = 1 - 2 * bit i. At most three differing
bits touch at most three of six blocks, so a linked pair has equal coordinates on three whole blocks: one of the
twenty block triples. Candidate lists of scattered pivots alone can't be joined by equality: a coordinate is binomial
with deviation 4, so a window of +-3 keeps 46 % of all pairs.

Groups of equal coordinates hold distinct fingerprints only (copies collapse before), are small at any corpus size
(about 32 bits of key), and are handled by their size: two members are one candidate pair; up to ``GROUP`` members are
searched in one call; members of larger groups go to a finer split, sixteen blocks of four bits of which thirteen agree,
whose groups can't exceed 2**12 members. Every link lies in one of these, and only spanning edges are emitted.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from weft.checkpointing import cut
from weft.components import connected_components
from weft.llm import shingle_sets, vote_pivots
from weft.llm._common import bound_batches, quoted, spare, table, utf8

BITS, SEED, SHINGLE = 64, 42, 3
#: Scattered reference fingerprints, made by a rule: the XXH64 of their number.
PIVOTS = tuple(xxh64_intdigest(f"pivot {i}".encode(), SEED) for i in range(16))
#: Widths of the six coarse blocks, and members of a coarse group that one call searches.
COARSE, GROUP = (11, 11, 11, 11, 10, 10), 4096


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes | None, shingle: int = SHINGLE) -> int:
    """The SimHash of a UTF-8 text as a signed 64-bit number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    runs = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False)) if len(words) >= shingle else iter([b" ".join(words)])
    n = max(1, len(words) - shingle + 1)
    ones, left = np.zeros(BITS, np.int64), n
    while left:
        step = min(left, 1 << 15)
        hashes = np.fromiter(map(xxh64_intdigest, runs, repeat(SEED)), np.uint64, step)
        ones += np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(step, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        left -= step
    return int(np.packbits(2 * ones > n, bitorder="little").view("<i8")[0])


def fingerprint_column(text: Column, shingle: int = SHINGLE) -> Column:
    @F.pandas_udf("long")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of(utf8(text))


def _block_masks(widths: tuple[int, ...], agreeing: int) -> list[int]:
    starts = [sum(widths[:i]) for i in range(len(widths))]
    blocks = [((1 << w) - 1) << s for w, s in zip(widths, starts, strict=True)]
    return [_signed(sum(c)) for c in combinations(blocks, agreeing)]


def _dealt(prints: DataFrame, masks: list[int]) -> DataFrame:
    """One row (t, k, f) for each fingerprint and each choice of agreeing blocks."""
    keys = F.array(*[F.struct(F.lit(i).cast("short").alias("t"), F.col("f").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)])
    return prints.select("f", F.explode(keys).alias("key")).select("key.t", "key.k", "f")


def _near(a: Column, b: Column, limit: int) -> Column:
    """Discard by the largest pivot coordinate difference, then verify."""
    coordinates = [F.abs(F.bit_count(a.bitwiseXOR(F.lit(_signed(p)))) - F.bit_count(b.bitwiseXOR(F.lit(_signed(p))))) for p in PIVOTS]
    return (F.greatest(*coordinates) <= limit) & (F.bit_count(a.bitwiseXOR(b)) <= limit)


def spanning_edges(prints: np.ndarray, limit: int) -> list[tuple[int, int]]:
    """Edges that span the components of one group of distinct fingerprints (signed 64-bit).

    A walk over the group: the pivot table discards, popcounts verify, and whatever is reached is never looked at again,
    so a dense group costs about its size, and a group without links half its square.
    """
    f = prints.astype(np.int64).view(np.uint64)
    pivots = np.array(PIVOTS, np.uint64)
    distances = np.bitwise_count(f[:, None] ^ pivots[None, :]).astype(np.int8)
    rest, edges = np.arange(len(f)), []
    while len(rest):
        stack, rest = [rest[0]], rest[1:]
        while stack and len(rest):
            i = stack.pop()
            near = (np.abs(distances[rest] - distances[i]) <= limit).all(axis=1)
            near[near] = np.bitwise_count(f[rest[near]] ^ f[i]) <= limit
            found, rest = rest[near], rest[~near]
            edges += [(int(prints[i]), int(prints[j])) for j in found]
            stack += list(found)
    return edges


def _group_edges(groups: DataFrame, limit: int) -> DataFrame:
    @F.pandas_udf("array<struct<a:long,b:long>>")
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for lists in batches:
            yield pd.Series([[{"a": a, "b": b} for a, b in spanning_edges(np.asarray(x, np.int64), limit)] for x in lists])

    return groups.select(F.explode(of("members")).alias("e")).select("e.a", "e.b")


def links(prints: DataFrame, limit: int = 3, group: int = GROUP) -> DataFrame:
    """Distinct fingerprints (f) -> edges (a, b) with the components of all pairs that differ in <= limit bits."""
    if limit != 3:
        raise ValueError("the block choices below are made for three differing bits")
    dealt = _dealt(prints, _block_masks(COARSE, 3))
    sizes = cut(dealt.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n"), F.min("f").alias("a"), F.max("f").alias("b")).filter("n > 1"), "groups")
    edges = sizes.filter("n = 2").filter(_near(F.col("a"), F.col("b"), limit)).select("a", "b")
    larger = cut(dealt.join(sizes.filter("n > 2").select("t", "k", "n"), ["t", "k"]), "members")
    middle = larger.filter(F.col("n") <= group).groupBy("t", "k").agg(F.collect_list("f").alias("members"))
    fine = _dealt(larger.filter(F.col("n") > group).select("f").distinct(), _block_masks((4,) * 16, 13))
    fine = fine.groupBy("t", "k").agg(F.collect_list("f").alias("members")).filter(F.size("members") > 1)
    return edges.unionByName(_group_edges(middle, limit)).unionByName(_group_edges(fine, limit))


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", limit: int = 3, group: int = GROUP) -> DataFrame:
    """One row (doc_id, text_hash, f, component_id) for each row of df; f is the signed fingerprint.

    Only the two named columns are read, so other columns may have any name. Null and wordless texts have fingerprint
    zero and are linked like any other. component_id is the smallest id in the component; null ids take part and are
    ignored by the minimum, so a component of nothing but null ids has a null component_id. Repeated rows are kept.
    An empty table gives no rows.
    """
    bound_batches(df.sparkSession)
    rows = cut(df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), fingerprint_column(F.col(text_col)).alias("f")), "prints")
    prints = cut(rows.groupBy("f").agg(F.min("doc_id").alias("first")), "distinct")
    return _labelled(rows, prints, links(prints.select("f"), limit, group))


def _labelled(rows: DataFrame, prints: DataFrame, edges: DataFrame) -> DataFrame:
    found = connected_components(edges)
    known = prints.join(found.withColumnRenamed("node", "f"), "f", "left").select("f", "first", F.coalesce("component", "f").alias("component"))
    smallest = known.groupBy("component").agg(F.min("first").alias("component_id"))
    members = known.join(smallest, "component").select("f", "component_id")
    return rows.join(members, "f").select("doc_id", "text_hash", "f", "component_id")


def _similar(df: DataFrame, id_col: str, text_col: str, group: int = GROUP) -> DataFrame:
    """Rows as of near_duplicates, with components of five-word Jaccard similarity 0.8 or more; f stands for the words.

    Wide fingerprints that meet in a table of nearest pivots and verify by popcounts make classes; the exact check of the
    shingle sets follows within them.
    """
    bound_batches(df.sparkSession)
    source = df.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text"))
    rows = cut(source.select("doc_id", "text_hash", shingle_sets.sketch_column(F.col("text")).alias("s")).select("doc_id", "text_hash", "s.*"), "sketches")
    place = F.struct(F.col("doc_id").isNull().alias("z"), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    prints = cut(rows.groupBy("f").agg(F.min("doc_id").alias("first"), F.min(place).alias("o"), F.first("print").alias("print"), F.first("keys").alias("keys")), "distinct")
    classes = cut(connected_components(vote_pivots.links(prints, group)).select(F.col("node").alias("f"), F.col("component").alias("k")), "classes")
    wanted = prints.join(classes, "f").select("f", "k", _key(F.col("o.i")).alias("i"), F.col("o.h").alias("text_hash"))
    texts = source.withColumn("i", _key(F.col("doc_id"))).join(wanted, ["i", "text_hash"]).select("k", "f", shingle_sets.set_column(F.col("text")).alias("shingles"))
    sets = cut(texts.groupBy("k", "f").agg(F.first("shingles").alias("shingles")), "sets")
    return _labelled(rows, prints, shingle_sets.links(sets, group))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df with one row of each component of texts whose five-word shingle sets have a Jaccard similarity of
    0.8 or more: the smallest (id, text hash), nulls last. Wordless texts are one component.

    All columns pass through whatever their names. Of rows with equal id and text the one with the smallest hash of all
    columns stays, so the same one in each run. An empty table gives no rows.
    """
    labelled = _similar(df, id_col, text_col)
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id").alias("i"), F.col("text_hash").alias("h"))
    group = F.struct(F.col("component_id"), F.when(F.col("component_id").isNull(), F.col("f")))
    i, h, n, row = spare(df, "weft_i", "weft_h", "weft_n", "weft_row")
    times = labelled.groupBy("doc_id", "text_hash").agg(F.count(F.lit(1)).alias("n")).alias("t")
    chosen = labelled.groupBy(group.alias("g")).agg(F.min(order).alias("o")).select(F.col("o.i").alias("doc_id"), F.col("o.h").alias("text_hash")).distinct()
    same = F.col("t.doc_id").eqNullSafe(F.col("c.doc_id")) & (F.col("t.text_hash") == F.col("c.text_hash"))
    chosen = cut(times.join(chosen.alias("c"), same, "left_semi").select(_key(F.col("doc_id")).alias(i), F.col("text_hash").alias(h), F.col("n").alias(n)), "chosen")
    keyed = df.withColumns({i: _key(F.col(id_col)), h: F.xxhash64(F.col(text_col))})
    single = keyed.join(chosen.filter(F.col(n) == 1), [i, h], "left_semi").select(*quoted(df.columns))
    # what repeats is combined before it is shuffled: a row that a third of the table repeats is no more than others
    repeats = keyed.join(chosen.filter(F.col(n) > 1), [i, h], "left_semi")
    whole = F.struct(F.xxhash64(*quoted(df.columns)).alias("z"), *quoted(df.columns)).alias(row)
    first = repeats.select(i, h, whole).groupBy(i, h).agg(F.min_by(row, F.col(row)["z"]).alias(row))
    return single.unionByName(first.select(*[F.col(row)[c].alias(c) for c in df.columns]))


def _key(column: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), column.cast("string")), F.lit(""))


def op1_simhash_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents; null and wordless texts have fingerprint zero, equal rows equal results."""
    found = near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("f")), 16, "0").alias("fingerprint"), "component_id")

"""Removing lines that spread over many sites.

A line's spread is the number of distinct sites that have it. Each line hash gets a HyperLogLog sketch of its sites,
merged by ordinary two-phase aggregation, so a line that a third of all documents share is a few sketches in the
shuffle. Where a sketch's estimate is too near the threshold to be believed, the line's sites are counted exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.checkpointing import cut
from weft.llm._common import quoted, spare, table

#: A line found on this many distinct sites is boilerplate.
SITES = 8
#: 2**LG_K registers: a relative standard error of about 0.83 / sqrt(2**LG_K), 1.3 % here; SIGMAS of these are doubted.
LG_K, SIGMAS = 12, 8


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), "\n", -1)


def _hashed(texts: DataFrame) -> DataFrame:
    """(d, k of the document, site, lines): of each line with a visible character its position and 128 bits of the trimmed line."""
    trimmed = F.transform(_lines(F.col("text")), lambda line, i: F.struct(i.cast("int").alias("pos"), F.trim(line).alias("line")))
    hashed = lambda x: F.struct(x["pos"].alias("pos"), F.xxhash64(x["line"]).alias("h1"), F.xxhash64(F.lit("second"), x["line"]).alias("h2"))
    return texts.select("d", "k", "site", F.transform(F.filter(trimmed, lambda x: x["line"] != ""), hashed).alias("lines"))


def spread_lines(lines: DataFrame, sites: int = SITES, lg_k: int = LG_K, sigmas: float = SIGMAS) -> DataFrame:
    """lines (h1, h2, site) -> (h1, h2) of those on at least ``sites`` distinct sites; null sites don't count."""
    # a line on so many sites occurs as often, and has two different sites; this needs no sketch and drops most
    known = lines.filter("site is not null")
    frequent = known.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("site").alias("a"), F.max("site").alias("b")).filter((F.col("n") >= sites) & ((F.col("a") != F.col("b")) | F.lit(sites < 2)))
    frequent = cut(frequent.select("h1", "h2"), "frequent")
    candidates = known.join(frequent, ["h1", "h2"], "left_semi")
    sketched = candidates.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", F.lit(lg_k)).alias("sketch")).select("h1", "h2", F.hll_sketch_estimate("sketch").alias("about"))
    sketched = cut(sketched, "sketched")
    doubt = sigmas * 0.83 / 2 ** (lg_k / 2)
    sure = sketched.filter(F.col("about") > F.lit(sites * (1 + doubt) + 1)).select("h1", "h2")
    near = sketched.filter(F.col("about").between(F.lit(sites * (1 - doubt) - 1), F.lit(sites * (1 + doubt) + 1))).select("h1", "h2")
    exact = candidates.join(near, ["h1", "h2"], "left_semi").select("h1", "h2", "site").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= sites).select("h1", "h2")
    return sure.unionByName(exact)


def remove_spread_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", site_col: str = "source", sites: int = SITES) -> DataFrame:
    """df with two more columns: ``_removed``, sorted positions (from 0) of lines removed, and ``_clean``, the rest.

    Lines are compared without surrounding blanks; blank lines are never removed, nor are a text's other characters
    changed. A null text has no lines and a null ``_clean``; a null site doesn't count as a site, yet its documents lose
    spread lines too. Rows with equal id and text have equal results, whether ids repeat or are null. Other columns
    pass through whatever their names; columns ``_removed`` and ``_clean`` are replaced. An empty table gives no rows.
    """
    kept = [c for c in df.columns if c not in ("_removed", "_clean")]
    key = F.xxhash64(F.col(text_col))
    texts = df.select(F.col(id_col).alias("d"), key.alias("k"), F.col(text_col).alias("text"), F.col(site_col).cast("string").alias("site")).filter("text is not null")
    # texts are split and hashed once; what follows reads hashes
    lines = cut(_hashed(texts), "lines").select("d", "k", "site", F.inline("lines"))
    spread = cut(spread_lines(lines.select("h1", "h2", "site"), sites), "spread")
    tmp, d, k, gone = spare(df, "weft_k", "weft_d", "weft_m", "weft_gone")
    hits = lines.join(spread, ["h1", "h2"], "left_semi").groupBy(F.col("d").alias(d), F.col("k").alias(k)).agg(F.array_sort(F.collect_set("pos")).alias(gone))
    keyed = df.select(*quoted(kept), key.alias(tmp))
    joined = keyed.join(hits, F.col(id_col).eqNullSafe(F.col(d)) & (F.col(tmp) == F.col(k)), "left")
    removed = F.coalesce(F.col(gone), F.array().cast("array<int>"))
    split = joined.withColumn(tmp, F.when(F.size(F.col(gone)) > 0, _lines(F.col(text_col))))
    # positions that stay, by a set difference: a text of many lines costs its size
    stay = F.array_except(F.sequence(F.lit(0), F.size(tmp) - 1), F.col(gone))
    left = F.array_join(F.transform(stay, lambda i: F.get(F.col(tmp), i)), "\n")
    return split.select(*quoted(kept), removed.alias("_removed"), F.when(F.col(tmp).isNull(), F.col(text_col)).otherwise(left).alias("_clean"))


def op7_line_spread(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of documents; null texts have no lines, equal rows equal results."""
    out = remove_spread_lines(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select(
        "doc_id",
        F.when(F.col("text").isNull(), 0).otherwise(F.size(_lines(F.col("text")))).cast("long").alias("n_lines"),
        F.size("_removed").cast("long").alias("n_removed"),
        F.array_join(F.transform("_removed", lambda p: p.cast("string")), ",").alias("removed"),
        F.sha2(F.coalesce("_clean", F.lit("")), 256).alias("clean_sha256"),
    )


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
     l AS (SELECT r, source, i - 1 AS pos, ls[i] AS raw, trim(ls[i], ' ') AS line FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM d)),
     s AS (SELECT line FROM l WHERE line <> '' AND source IS NOT NULL GROUP BY line HAVING count(DISTINCT source) >= {SITES}),
     x AS (SELECT l.*, s.line IS NOT NULL AS gone FROM l LEFT JOIN s USING (line))
SELECT doc_id, CASE WHEN any_value(text) IS NULL THEN 0 ELSE count(*) END AS n_lines, count(*) FILTER (gone) AS n_removed,
       coalesce(string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) FILTER (gone), '') AS removed,
       sha256(coalesce(string_agg(raw, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS clean_sha256
FROM x JOIN d USING (r) GROUP BY r, doc_id
"""

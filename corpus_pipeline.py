"""From raw documents to shards: five stages, each written and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.checkpointing import cut
from weft.llm import byte_cnn, decontaminate, hash_tree, simhash_pivots, soft_mixing
from weft.llm._common import bound_batches, spare, table

#: A document whose language is this uncertain, or that has no letter, is rejected.
SURE = 0.3


def _aside(docs: DataFrame, result: str) -> tuple[DataFrame, list]:
    """docs with a column of its own named like an operator's result renamed, and the columns that give docs back."""
    (aside,) = spare(docs, "weft_own")
    own = docs.withColumnRenamed(result, aside) if result in docs.columns else docs
    return own, [F.col(f"`{aside if c == result else c}`").alias(c) for c in docs.columns]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    own, back = _aside(docs, "_lang")
    found = byte_cnn.identify(own, docs.filter(F.col("lang").isNotNull()))
    return found.filter((F.col("_lang.lang_pred") != byte_cnn.UNKNOWN) & (F.col("_lang.score") >= SURE)).select(*back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return simhash_pivots.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    own, back = _aside(docs, "_found")
    return decontaminate.decontaminate(own, table(spark, sf_dir, "benchmark")).filter(F.col("_found.n_hit") == 0).select(*back)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says: some not at all, some more than once."""
    bound_batches(spark)
    own, back = _aside(docs, "_mix")
    model = soft_mixing.fit(docs, soft_mixing.quality_domains(table(spark, sf_dir, "labels")))
    mixed = soft_mixing.mix(own, model, soft_mixing.TARGETS)
    (copy,) = spare(mixed, "weft_copy")
    return mixed.select("*", F.explode(F.array_repeat(F.lit(1), F.col("_mix.copies"))).alias(copy)).select(*back)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return hash_tree.shard_documents(docs).select("doc_id", "size", "text_crc32", "shard", "slot", "region", "rack")


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: No SQL: stages learn models and walk a graph. tests/llm/test_pipeline.py holds each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

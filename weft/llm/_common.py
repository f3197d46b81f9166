"""Helpers shared by the text operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.shipping import ship

#: Upper limits for one Arrow batch on its way to a Python worker: texts differ in length by orders of magnitude, so
#: a limit on rows alone would not bound memory.
BATCH_ROWS, BATCH_BYTES = 512, 8 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Keep Arrow batches small enough for whole texts of any length, and make the package known to workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def utf8(text: Column) -> Column:
    """The text's UTF-8 bytes; null stays null."""
    return text.cast("string").cast("binary")


def text_key(text: Column) -> list[Column]:
    """128 bits that stand for a text: two independent 64-bit hashes."""
    return [F.xxhash64(text), F.xxhash64(F.lit("second"), text)]


def slices(sizes: list[int], limit: int) -> list[tuple[int, int]]:
    """Runs [a, b) of consecutive items whose sizes sum to about limit at most, one item at least."""
    out, a, total = [], 0, 0
    for i, n in enumerate(sizes):
        if i > a and total + n > limit:
            out.append((a, i))
            a, total = i, 0
        total += n
    if a < len(sizes):
        out.append((a, len(sizes)))
    return out


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like these that no column of df has, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def quoted(columns: list[str]) -> list[Column]:
    """Columns by their exact names, dots and all."""
    return [F.col(f"`{c}`") for c in columns]

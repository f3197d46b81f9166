"""Cutting lineage through the folder that all executors share.

``cut`` writes a DataFrame as Parquet below ``spark.checkpoint.dir`` and reads it back. Unlike a local checkpoint the
result survives the loss of an executor, and unlike ``DataFrame.checkpoint`` it stays columnar, with statistics that
adaptive execution can use. Where the setting is unset, a local master (tests) gets a temporary folder for the process, and
any other an error: executors wouldn't see each other's folders.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The shared folder: spark.checkpoint.dir, the context's checkpoint folder, or on a local master a new one."""
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if "dir" not in _own:
        _own["dir"] = tempfile.mkdtemp(prefix="weft-")
        atexit.register(shutil.rmtree, _own["dir"], ignore_errors=True)
    return _own["dir"]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended; what is left belongs to the checkpoint folder's owner
        pass


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the table read from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/weft-{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(schema).parquet(path)


def cut_counted(df: DataFrame, name: str, **counts: Column) -> tuple[DataFrame, dict]:
    """cut, and aggregates of the rows taken while they are written, so no other job is needed for them."""
    seen = Observation(f"{name}-{uuid.uuid4().hex}")
    out = cut(df.observe(seen, *[c.alias(k) for k, c in counts.items()]), name)
    return out, seen.get

"""Appending a stream of edges to a stored graph: each micro-batch is one version."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from weft.checkpointing import cut
from weft.operators.mutate import numbered
from weft.sources import store


def append_edges(stream: DataFrame, type: str, root: str, checkpoint: str, **trigger) -> StreamingQuery:
    """stream ([id,] src, dst, <property>...) -> edges of this type in the graph stored at root.

    A batch costs what it holds: its rows become one part of the type's table, and parts are folded now and then. Edges
    get ids above all others; an id that the stream brings becomes the property ``given``. Ends must be there. The version
    that a batch makes also notes its number, so a batch that is delivered again after a failure adds nothing.
    """

    def write(batch: DataFrame, number: int) -> None:
        graph = store.load(batch.sparkSession, root).settled()
        done = dict(graph.streams)
        if done.get(checkpoint, -1) >= number:
            return
        own = batch.withColumnRenamed("id", "given") if "id" in batch.columns else batch
        rows = cut(numbered(own, "_number").withColumn("id", F.col("_number") + graph.next_edge).drop("_number"), "batch")
        if rows.isEmpty():
            return
        n = rows.count()
        graph = graph.add_edges(rows, type, below=graph.next_edge + n)
        store.save(graph.with_(streams=tuple((done | {checkpoint: number}).items())), root, graph.version)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

"""Graphs on storage: a folder of tables, and a numbered manifest for each version that names its tables.

A version's tables are written before its manifest, and a manifest's file is created under the condition that there is
none of its number: of two commits from one version, the first wins and the other is a conflict. The current version
is the highest whole manifest; one that a lost writer left incomplete is passed over. A table is a list of parts, added
rows and ids that are gone (see sources.graph); a commit writes the parts that are new, and vacuum makes one of them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import replace

from pyspark.sql import SparkSession

from weft.errors import GraphError
from weft.sources.graph import Constraint, EdgeTable, Graph, Index, NodeTable, Part, read_parts


class Files:
    """Hadoop's file system, so that any store that Spark reads will do."""

    def __init__(self, spark: SparkSession, root: str):
        self.jvm, self.conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        self.root = root.rstrip("/")

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def fs(self, name: str = ""):
        return self.path(name).getFileSystem(self.conf)

    def exists(self, name: str = "") -> bool:
        return self.fs(name).exists(self.path(name))

    def read(self, name: str) -> str:
        stream = self.fs(name).open(self.path(name))
        try:
            return str(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def create(self, name: str, text: str) -> bool:
        """Write a file that doesn't exist; False if it does."""
        try:
            out = self.fs(name).create(self.path(name), False)
        except Exception as e:
            if "AlreadyExists" in str(e) or "already exists" in str(e):
                return False
            raise
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        return True

    def list(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self.fs(name).listStatus(self.path(name))) if self.exists(name) else []

    def delete(self, name: str) -> None:
        self.fs(name).delete(self.path(name), True)

    def rename(self, a: str, b: str) -> None:
        self.fs(a).rename(self.path(a), self.path(b))

    def mkdirs(self, name: str) -> None:
        self.fs(name).mkdirs(self.path(name))


PREFIX = "manifest-"


def _manifests(files: Files) -> list[str]:
    return [x for x in files.list() if x.startswith(PREFIX) and x.endswith(".json")]


def _current(files: Files) -> dict | None:
    """The highest manifest that can be read whole."""
    for name in reversed(_manifests(files)):
        try:
            return json.loads(files.read(name))
        except ValueError:
            continue
    return None


def save(graph: Graph, root: str, expected: int | None = None) -> Graph:
    """Write graph as the next version. If ``expected`` isn't the current version any more, that is a conflict."""
    files = Files(graph.spark, root)
    found = _current(files)
    current = found["version"] if found else 0
    if expected is not None and expected != current:
        raise GraphError("Conflict", f"version {current} was committed meanwhile")
    current = max([current, *(int(x[len(PREFIX) : -5]) for x in _manifests(files))])
    version, folder = current + 1, f"{files.root}/v{current + 1}-{uuid.uuid4().hex[:8]}"
    graph = graph.settled()
    written: dict[tuple[int, bool], Part] = {}

    def stored(part: Part) -> Part:
        if part.path and part.path.startswith(f"{files.root}/"):
            return part
        key = id(part.df), part.gone
        if key not in written:
            path = f"{folder}/p{len(written)}"
            part.df.write.parquet(path)
            written[key] = Part(_open(graph.spark, path), part.gone, path)
        return written[key]

    def table(t):
        parts = tuple(stored(x) for x in t.deltas)
        return replace(t, df=read_parts(parts), parts=parts)

    nodes, edges = tuple(map(table, graph.nodes)), tuple(map(table, graph.edges))
    listed = lambda t: [{"path": x.path[len(files.root) + 1 :], "gone": x.gone} for x in t.parts]
    body = {
        "version": version,
        "next_node": graph.next_node,
        "next_edge": graph.next_edge,
        "nodes": [{"labels": t.labels, "parts": listed(t)} for t in nodes],
        "edges": [{"type": t.type, "src": t.src_labels, "dst": t.dst_labels, "parts": listed(t)} for t in edges],
        "indexes": [vars(x) for x in graph.indexes],
        "constraints": [vars(x) for x in graph.constraints],
        "streams": dict(graph.streams),
    }
    if not files.create(f"{PREFIX}{version:010d}.json", json.dumps(body)):
        raise GraphError("Conflict", f"version {version} was committed meanwhile")
    return graph.with_(nodes=nodes, edges=edges, version=version)


def _open(spark: SparkSession, path: str):
    return spark.read.parquet(path)


def _parts(spark: SparkSession, files: Files, entry: dict) -> tuple[Part, ...]:
    listed = entry.get("parts") or [{"path": entry["path"], "gone": False}]
    return tuple(Part(_open(spark, f"{files.root}/{x['path']}"), x["gone"], f"{files.root}/{x['path']}") for x in listed)


def load(spark: SparkSession, root: str) -> Graph:
    files = Files(spark, root)
    m = _current(files)
    if m is None:
        return Graph(spark)
    sets = lambda x: tuple(map(tuple, x)) if x is not None else None
    nodes = [(tuple(t["labels"]), _parts(spark, files, t)) for t in m["nodes"]]
    edges = [(t, _parts(spark, files, t)) for t in m["edges"]]
    return Graph(
        spark,
        tuple(NodeTable(labels, read_parts(parts), parts) for labels, parts in nodes),
        tuple(EdgeTable(t["type"], read_parts(parts), sets(t["src"]), sets(t["dst"]), parts) for t, parts in edges),
        tuple(Index(**{**x, "props": tuple(x["props"])}) for x in m["indexes"]),
        tuple(Constraint(**x) for x in m["constraints"]),
        m["next_node"],
        m["next_edge"],
        m["version"],
        streams=tuple(m.get("streams", {}).items()),
    )


def vacuum(spark: SparkSession, root: str) -> int:
    """Make one part of each table's parts, as a new version, and delete what the current version doesn't name, older
    manifests included; how many table folders there were to delete."""
    files = Files(spark, root)
    if _current(files) is None:
        return 0
    graph = load(spark, root)
    tables = (*graph.nodes, *graph.edges)
    if any(len(t.deltas) > 1 for t in tables):
        save(graph.with_(nodes=tuple(t.compact() for t in graph.nodes), edges=tuple(t.compact() for t in graph.edges)), root, graph.version)
    m = _current(files)
    named = {x["path"].split("/")[0] for t in (*m["nodes"], *m["edges"]) for x in t.get("parts") or [t]}
    old = [x for x in files.list() if x.startswith("v") and x not in named]
    for x in old:
        files.delete(x)
    for x in _manifests(files):
        if int(x[len(PREFIX) : -5]) < m["version"]:
            files.delete(x)
    return len(old)

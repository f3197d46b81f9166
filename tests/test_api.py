import glob
import io

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from weft import repl
from weft.errors import GraphError
from weft.operators import bulk
from weft.session import Session
from weft.sources import store
from weft.sources.graph import Graph
from weft.streaming.edges import append_edges


def made(spark):
    nodes = spark.createDataFrame([(1, "A"), (2, "B"), (3, "C"), (4, "D")], "id bigint, name string")
    edges = spark.createDataFrame([(10, 1, 2), (11, 2, 3), (12, 1, 4)], "id bigint, src bigint, dst bigint")
    return Graph(spark).add_nodes(nodes, ["N"]).add_edges(edges, "TO")


def test_walks(spark):
    g = made(spark)
    assert bulk.neighbors(g, 1, 1).count() == 2 and bulk.neighbors(g, 1, 2).count() == 3
    assert bulk.shortest_path(g, 1, 3) == [1, 2, 3] and bulk.shortest_path(g, 3, 1) is None and bulk.shortest_path(g, 2, 2) == [2]
    assert bulk.depth_first(g, 1) == [1, 2, 3, 4]
    assert g.edges_between(1, 2).count() == 1 and g.incident_edges(1).count() == 2 and g.get_node(2).first()["p_name"] == "B" and g.get_edge(99).count() == 0


def test_changes(spark):
    g = made(spark)
    ids = spark.createDataFrame([(2,)], "id bigint")
    changed = bulk.update_nodes(g, spark.createDataFrame([(1, None, 5), (2, "X", None)], "id bigint, name string, age int"))
    rows = {r["id"]: (r["p_name"], r["p_age"]) for r in changed.nodes_of("N").collect()}
    assert rows == {1: (None, 5), 2: ("X", None), 3: ("C", None), 4: ("D", None)}
    assert bulk.delete_nodes(g, ids).edges_of().count() == 1 and bulk.delete_edges(g, spark.createDataFrame([(12,)], "id bigint")).edges_of("TO").count() == 2
    marked = bulk.change_labels(g, ids, add=["M"])
    assert Session(spark, marked).run("MATCH (n:M) RETURN n.name AS n, labels(n) AS l")[0].rows() == [("B", ["M", "N"])]
    assert g.counts() == {"nodes": 4, "edges": 3, "labels": {"N": 4}, "types": {"TO": 3}}
    weighted = bulk.update_edges(g, spark.createDataFrame([(10, 2.5)], "id bigint, w double"))
    assert Session(spark, weighted).run("MATCH ()-[e:TO]->() RETURN sum(e.w) AS s")[0].rows() == [(2.5,)]


def test_stream(spark, tmp_path):
    root, source, checkpoint = str(tmp_path / "g"), str(tmp_path / "in"), str(tmp_path / "cp")
    store.save(made(spark), root)
    for rows in ([(20, 3, 4), (10, 1, 2)], [(21, 4, 1)]):
        spark.createDataFrame(rows, "id bigint, src bigint, dst bigint").write.mode("append").parquet(source)
        stream = spark.readStream.schema("id bigint, src bigint, dst bigint").parquet(source)
        append_edges(stream, "TO", root, checkpoint).awaitTermination()
    graph = store.load(spark, root)
    got = {r["id"]: (r["src"], r["dst"], r["p_given"]) for r in graph.edges_of("TO").collect()}
    assert len(graph.edges) == 1 and set(got) == {10, 11, 12, 13, 14, 15} and got[15] == (4, 1, 21) and {got[13], got[14]} == {(3, 4, 20), (1, 2, 10)}
    session = Session(spark, graph)
    session.run("MATCH (a:N {name: \"A\"}), (b:N {name: \"D\"}) CREATE (a)-[:TO]->(b)")
    assert session.run("MATCH ()-[e:TO]->() RETURN count(e) AS n, count(DISTINCT id(e)) AS d")[0].rows() == [(7, 7)]


def test_a_batch_counts_once(spark, tmp_path):
    from weft.sources.graph import Graph as G

    root = str(tmp_path / "g")
    store.save(made(spark), root)
    graph = store.load(spark, root)
    store.save(graph.with_(streams=(("there", 0),)), root, graph.version)
    spark.createDataFrame([(3, 4)], "src bigint, dst bigint").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src bigint, dst bigint").parquet(str(tmp_path / "in"))
    # the version notes batch 0 of this checkpoint already, as after a failure between the commit and its acknowledgement
    store.save(store.load(spark, root).with_(streams=((str(tmp_path / "cp"), 0),)), root)
    append_edges(stream, "TO", root, str(tmp_path / "cp")).awaitTermination()
    assert store.load(spark, root).edges_of("TO").count() == 3 and isinstance(graph, G)


def test_ids_after_load(spark):
    session = Session(spark, made(spark))
    session.run('CREATE (:N {name: "E"})-[:TO]->(:N {name: "F"})')
    assert session.run("MATCH (n) RETURN count(n) AS n, count(DISTINCT id(n)) AS d")[0].rows() == [(6, 6)]
    assert session.run("MATCH ()-[e]->() RETURN count(e) AS n, count(DISTINCT id(e)) AS d")[0].rows() == [(4, 4)]
    again = session.graph.add_nodes(spark.createDataFrame([(900, "late")], "id bigint, name string"), ["N"])
    session = Session(spark, again)
    session.run('CREATE (:N {name: "G"})')
    assert session.run('MATCH (n:N {name: "G"}) RETURN id(n) AS i')[0].rows() == [(901,)]


def test_ends_must_be_there(spark):
    with pytest.raises(GraphError) as e:
        made(spark).add_edges(spark.createDataFrame([(30, 1, 99)], "id bigint, src bigint, dst bigint"), "TO")
    assert e.value.code == "NotFound"


def _written(root, version):
    """Rows in the files that a version wrote."""
    return sum(pq.read_metadata(f).num_rows for f in glob.glob(f"{root}/default/v{version}-*/**/*.parquet", recursive=True))


def test_commits_write_deltas(spark, tmp_path):
    root = str(tmp_path / "r")
    nodes = spark.range(1, 1001).select("id", (F.col("id") * 2).alias("v"))
    edges = spark.range(1, 1000).select("id", F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    store.save(Graph(spark).add_nodes(nodes, ["N"]).add_edges(edges, "E", src_labels=[["N"]], dst_labels=[["N"]]), f"{root}/default")
    session = Session(spark, root=root)
    session.run("MATCH (n:N {v: 10}) DETACH DELETE n")
    assert _written(root, 2) == 3  # a node's id and two edges' ids
    session.run("MATCH (n:N {v: 20}) SET n.v = 21, n.w = true")
    assert _written(root, 3) == 2
    session.run("CREATE (:N {v: 5000})")
    assert _written(root, 4) == 1
    for again in (session, Session(spark, root=root)):
        assert again.run("MATCH (n:N) RETURN count(n) AS n, sum(n.v) AS s, count(n.w) AS w")[0].rows() == [(1000, 1001000 - 10 + 1 + 5000, 1)]
        assert again.run("MATCH ()-[e:E]->() RETURN count(e) AS n")[0].rows() == [(997,)]
    for i in range(20):  # parts are folded, and the first one is not written again
        session.run(f"MATCH (n:N {{v: {100 + 2 * i}}}) SET n.v = {9000 + i}")
    assert max(_written(root, v) for v in range(5, 25)) < 60
    session.run("VACUUM")
    assert [len(t.deltas) for t in store.load(spark, f"{root}/default").nodes] == [1]
    assert Session(spark, root=root).run("MATCH (n:N) RETURN count(n) AS n, max(n.v) AS m")[0].rows() == [(1000, 9019)]


def test_limits(spark):
    graph = made(spark)
    with pytest.raises(GraphError) as e:
        Session(spark, graph, max_writes=2).run("MATCH (n:N) SET n.x = 1")
    assert e.value.code == "ResourceExhausted"
    slow = Session(spark, timeout=0.5)
    with pytest.raises(GraphError) as e:
        slow.run("UNWIND range(1, 2000000000) AS a UNWIND range(1, 1000) AS b RETURN max(a * b % 7) AS m")[0].rows()
    assert e.value.code == "DeadlineExceeded"
    one = [Session(spark, seed=5).run("UNWIND range(1, 5) AS i RETURN rand() AS r")[0].rows() for _ in range(2)]
    assert one[0] == one[1]


def test_profile_and_savepoints(spark):
    session = Session(spark, made(spark))
    result = session.run("PROFILE MATCH (a:N)-[:TO]->(b) WITH a, count(*) AS n WHERE n > 1 RETURN a.name AS name")[0]
    assert result.rows() == [("A",)] and "MATCH: 3 rows" in result.profile and "WITH: 1 rows" in result.profile
    session.run("BEGIN")
    mark = session.mark()
    session.run("MATCH (n:N) DETACH DELETE n")
    session.rollback_to(mark)
    session.run("COMMIT")
    assert session.run("MATCH (n) RETURN count(*) AS n")[0].rows() == [(4,)]


def test_maps_and_mixed_values(spark):
    session = Session(spark)
    assert session.run('UNWIND [{a: 1}, {b: "x"}] AS m RETURN collect(m) AS ms, max(size(m)) AS n')[0].rows() == [([{"a": 1}, {"b": "x"}], 1)]
    assert session.run('RETURN [1, {a: 1, b: "q\\""}, [true, null]] AS l')[0].rows() == [([1, {"a": 1, "b": 'q"'}, [True, None]],)]
    assert session.run("UNWIND [{a: 1}, {}] AS m RETURN values(m) AS v")[0].rows() == [([1],), ([],)]


def test_nothing_is_left_out_in_the_shell(spark):
    text = "\n".join(repl.formatted(Session(spark).run("UNWIND range(1, 2500) AS i RETURN i")[0]))
    assert text.count("\n") == 2501 and text.endswith("2500 rows")


def test_shell(spark):
    out = io.StringIO()
    repl.serve(Session(spark), ["HELP\n", "CREATE (:P {n: 1});\n", "MATCH (p:P) RETURN p.n AS n\n", "RETURN x\n", "EXIT\n", "RETURN 1 AS y\n"], out)
    text = out.getvalue()
    assert "nodes_created: 1" in text and "1 rows" in text and "Semantic: x is not defined" in text and "y" not in text.split("1 rows")[1]

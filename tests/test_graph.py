import random
from itertools import product

import pytest

from weft.errors import GraphError
from weft.session import Session
from weft.sources import store
from weft.sources.graph import Graph


@pytest.fixture(scope="module")
def social(spark):
    session = Session(spark)
    session.run('CREATE (a:Person {name: "Alice", city: "Paris", age: 36}), (b:Person {name: "Bob", city: "Paris"}), (z:Person {name: "Zoe", city: "Lima"}), (c:City {name: "Paris"}), (a)-[:KNOWS {since: 2020}]->(b)')
    return session


def rows(session, source, params=None):
    return session.run(source, params)[-1].rows()


def test_matching(social):
    assert rows(social, 'MATCH (a:Person {name: "Alice"})-[e:KNOWS]->(b) RETURN a.name AS a, b.name AS b, e.since AS s, type(e) AS t, startNode(e) = a AS ok') == [("Alice", "Bob", 2020, "KNOWS", True)]
    assert sorted(rows(social, "MATCH (a:Person), (c:City) WHERE a.city = c.name RETURN a.name AS n")) == [("Alice",), ("Bob",)]
    assert rows(social, "MATCH (a:Person) OPTIONAL MATCH (a)-[:KNOWS]->(b) RETURN a.name AS a, b.name AS b ORDER BY a") == [("Alice", "Bob"), ("Bob", None), ("Zoe", None)]
    assert rows(social, "MATCH (a:Person) OPTIONAL MATCH (a)-[:KNOWS]->(b) WHERE a.age > 40 RETURN a.name AS a, b.name AS b ORDER BY a") == [("Alice", None), ("Bob", None), ("Zoe", None)]
    assert rows(social, "MATCH ()-[e:KNOWS]->() RETURN count(e) AS n") == [(1,)]
    assert rows(social, "MATCH (a:Person)-[:KNOWS]-(b) RETURN count(*) AS n") == [(2,)]
    assert rows(social, "MATCH (a:City|Person) RETURN count(*) AS n") == [(4,)]
    assert rows(social, "MATCH (a:Nothing) RETURN count(*) AS n") == [(0,)]
    assert rows(social, "MATCH (a:Person) WITH a ORDER BY a.name DESC LIMIT 2 RETURN collect(a.name) AS n") == [(["Zoe", "Bob"],)]
    assert rows(social, "MATCH (a:Person {name: $n}) RETURN properties(a).city AS c, keys(a) AS k", {"n": "Bob"}) == [("Paris", ["city", "name"])]
    assert rows(social, "MATCH (n) WITH n AS m WHERE m.name = \"Zoe\" RETURN m.city AS c") == [("Lima",)]


def test_repeated_names(social):
    assert rows(social, "MATCH (a:Person)-[:KNOWS]->(a) RETURN count(*) AS n") == [(0,)]
    assert rows(social, "MATCH (a)-[e:KNOWS]->(b) MATCH (a)-[e]->(c) RETURN b = c AS same") == [(True,)]


def _walks(edges, start, least, most, directed):
    out = []

    def go(node, used):
        if least <= len(used) <= most:
            out.append((start, node, len(used)))
        if len(used) == most:
            return
        for i, (a, b) in edges.items():
            if i in used:
                continue
            if a == node:
                go(b, [*used, i])
            elif not directed and b == node:
                go(a, [*used, i])

    go(start, [])
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_against_plain_matcher(spark, seed):
    rng = random.Random(seed)
    n = 7
    edges = {i: (rng.randrange(1, n + 1), rng.randrange(1, n + 1)) for i in range(1, 13)}
    nodes = spark.createDataFrame([(i, i % 3) for i in range(1, n + 1)], "id bigint, k bigint")
    frame = spark.createDataFrame([(i, a, b) for i, (a, b) in edges.items()], "id bigint, src bigint, dst bigint")
    session = Session(spark, Graph(spark).add_nodes(nodes, ["N"]).add_edges(frame, "E", src_labels=[["N"]], dst_labels=[["N"]]))
    got = sorted(rows(session, "MATCH (a:N)-[e:E]->(b)-[f:E]->(c) RETURN id(a) AS a, id(b) AS b, id(c) AS c"))
    want = sorted((a, b, d) for (i, (a, b)), (j, (c, d)) in product(edges.items(), edges.items()) if i != j and b == c)
    assert got == want
    got = sorted(rows(session, "MATCH (a)-[e]-(b)<-[f]-(c) WHERE a.k = c.k RETURN id(a) AS a, id(b) AS b, id(c) AS c"))
    both = [(i, a, b) for i, (a, b) in edges.items()] + [(i, b, a) for i, (a, b) in edges.items() if a != b]
    want = sorted((a, b, c) for (i, a, b), (j, (c, d)) in product(both, edges.items()) if i != j and d == b and a % 3 == c % 3)
    assert got == want
    for arrow, directed in (("->", True), ("-", False)):
        got = sorted(rows(session, f"MATCH (a:N {{k: 1}})-[w:E*1..3]{arrow}(b) RETURN id(a) AS a, id(b) AS b, size(w) AS n"))
        assert got == sorted(x for s in range(1, n + 1) if s % 3 == 1 for x in _walks(edges, s, 1, 3, directed))
    dist = {}
    for s in range(1, n + 1):
        front, seen, d = {s}, {s}, 0
        while front:
            d += 1
            front = {b for a, b in edges.values() if a in front} - seen
            seen |= front
            dist |= {(s, t): d for t in front}
    got = {(a, b): h for a, b, h in rows(session, "MATCH (a:N), (b:N) WHERE id(a) <> id(b) MATCH p = shortestPath((a)-[:E*]->(b)) RETURN id(a) AS a, id(b) AS b, length(p) AS h")}
    assert {k: v for k, v in got.items() if v is not None} == dist
    got = dict(rows(session, "MATCH (a:N) RETURN id(a) AS a, size(neighbors(a, 2)) AS n"))
    assert got == {s: sum(1 for (x, _), d in dist.items() if x == s and d <= 2) for s in range(1, n + 1)}


def test_hop_limit(spark):
    session = Session(spark, max_hops=3)
    session.run("CREATE (:N {i: 1})-[:X]->(:N)-[:X]->(:N)-[:X]->(:N)-[:X]->(:N)")
    with pytest.raises(GraphError) as e:
        rows(session, "MATCH (a:N {i: 1})-[:X*]->(b) RETURN b")
    assert e.value.code == "ResourceExhausted"
    assert rows(session, "MATCH (a:N {i: 1})-[k:X*1..2]->(b) RETURN max(size(k)) AS n") == [(2,)]


def test_shortest_paths(run):
    run("CREATE (a:P {n: 1}), (b:P {n: 2}), (c:P {n: 3}), (d:P {n: 4}), (a)-[:K]->(b), (b)-[:K]->(d), (a)-[:K]->(c), (c)-[:K]->(d), (a)-[:S]->(a)")
    ends = "MATCH (a:P {n: 1}), (d:P {n: 4})"
    assert run(f"{ends} WITH shortestPath(a, d) AS p RETURN relationships(p) AS e, nodes(p) AS n") == [([1, 2], [1, 2, 4])]
    assert run(f"{ends} RETURN size(allShortestPaths(a, d)) AS n, shortestPath(d, a) IS NULL AS none, length(shortestPath(a, a)) AS zero") == [(2, True, 0)]
    assert run(f"{ends} MATCH p = allShortestPaths((a)-[:K*]->(d)) RETURN length(p) AS l, [x IN nodes(p) | x.n] AS ns ORDER BY ns") == [(2, [1, 2, 4]), (2, [1, 3, 4])]
    assert run('MATCH (a:P {n: 1}) RETURN degree(a) AS o, degree(a, "in") AS i, degree(a, "both") AS b') == [(3, 1, 3)]


def test_mutation(run):
    session = run.session
    result = session.run('CREATE (:Person {name: "Ada"})-[:KNOWS {since: 1}]->(:Person {name: "Bea"})')[0]
    assert {k: v for k, v in result.summary.items() if v} == {"nodes_created": 2, "edges_created": 1, "properties_set": 3, "labels_added": 2}
    assert session.run('MATCH (a {name: "Ada"}) SET a.name = null')[0].summary["properties_set"] == 1
    assert run("MATCH (a) WHERE a.name IS NULL SET a:Anon, a.age = 3 RETURN labels(a) AS l, a.age AS x") == [(["Anon", "Person"], 3)]
    assert session.run("MATCH (a:Anon) REMOVE a:Anon")[0].summary["labels_removed"] == 1
    with pytest.raises(GraphError) as e:
        run("MATCH (a) WHERE a.age = 3 DELETE a")
    assert e.value.code == "ConstraintViolation" and run("MATCH (a) RETURN count(*) AS n") == [(2,)]
    done = session.run("MATCH (a) WHERE a.age = 3 DETACH DELETE a")[0].summary
    assert (done["nodes_deleted"], done["edges_deleted"]) == (1, 1)
    assert run("MATCH (a) RETURN count(*) AS n") == [(1,)]


def test_merge_is_sequential(run):
    assert sorted(run('UNWIND ["u", "u", "v"] AS k MERGE (x:T {k: k}) ON CREATE SET x.c = 1 ON MATCH SET x.c = 5 RETURN k, id(x) AS i')) == [("u", 1), ("u", 1), ("v", 2)]
    assert sorted(run("MATCH (x:T) RETURN x.k AS k, x.c AS c")) == [("u", 5), ("v", 1)]
    run('MATCH (a:T {k: "u"}), (b:T {k: "v"}) MERGE (a)-[:R]->(b)')
    run('MATCH (a:T {k: "u"}), (b:T {k: "v"}) MERGE (a)-[:R]->(b)')
    assert run("MATCH (:T)-[r:R]->(:T) RETURN count(*) AS n") == [(1,)]


def test_statements_are_atomic(run):
    with pytest.raises(GraphError):
        run("CREATE (:A); CREATE (:B); RETURN 1 / 0 AS x" if False else 'CREATE (:A); CREATE (:B {x: toInt("no")})')
    assert run("MATCH (n) RETURN count(*) AS n") == [(1,)]
    run("BEGIN; CREATE (:C)")
    assert run("MATCH (n:C) RETURN count(*) AS n") == [(1,)]
    run("ROLLBACK")
    assert run("MATCH (n:C) RETURN count(*) AS n") == [(0,)]
    run("BEGIN READ ONLY")
    with pytest.raises(GraphError):
        run("CREATE (:C)")
    run("COMMIT")
    with pytest.raises(GraphError):
        run("COMMIT")


def test_schema(run):
    run('CREATE (:Person {name: "Ada", age: 36}), (:Person {name: "Bea", age: 22})')
    run("CREATE INDEX by_age FOR (n:Person) ON (n.age); CREATE CONSTRAINT u FOR (n:Person) REQUIRE n.name IS UNIQUE")
    assert run("MATCH (n:Person) WHERE n.age >= 30 AND n.age < 40 RETURN n.name AS n") == [("Ada",)]
    assert run("EXPLAIN MATCH (n:Person) WHERE n.age >= 30 RETURN n.name AS n") == [("Project(n.name AS n)",), ("  Filter(n.age >= 30)",), ("    IndexSeek((n:Person) using by_age)",)]
    for source, code in (('CREATE (:Person {name: "Ada"})', "ConstraintViolation"), ("CREATE INDEX by_age FOR (n:Person) ON (n.age)", "AlreadyExists"), ("DROP INDEX nope", "NotFound"), ("CREATE CONSTRAINT t FOR (n:Person) REQUIRE n.age IS :: STRING", "ConstraintViolation"), ("SHOW USERS", "Unavailable"), ("CREATE ROLE r", "Unavailable")):
        with pytest.raises(GraphError) as e:
            run(source)
        assert e.value.code == code
    assert [r[0] for r in run("SHOW CONSTRAINTS")] == ["u"] and run("SHOW LABELS") == [("Person",)]
    run("ANALYZE; DROP CONSTRAINT u")
    assert [r[0] for r in run("SHOW INDEXES")] == ["by_age"]


def test_plans(run):
    plan = lambda q: "\n".join(r[0] for r in run("EXPLAIN " + q))
    assert plan("MATCH (a:Person)-[:KNOWS]->(b)-[:WORKS]->(c) RETURN c") == "Project(c)\n  Expand((b)-[:WORKS]->(c))\n    Expand((a)-[:KNOWS]->(b))\n      LabelScan((a:Person))"
    assert plan("MATCH (a:Person) OPTIONAL MATCH (a)-[:LIVES_IN]->(c:City) RETURN a.name AS name") == "Project(a.name AS name)\n  Apply\n    LabelScan((a:Person))\n    Optional\n      Expand((a)-[:LIVES_IN]->(c:City))"
    assert plan("MATCH (a:Person) WITH a.name AS name, count(*) AS n WHERE n > 1 RETURN name, n") == "Project(name, n)\n  Filter(n > 1)\n    Aggregate(a.name AS name, count(*) AS n)\n      LabelScan((a:Person))"
    assert plan("MATCH (a) SET a.age = 1, a:Flagged RETURN a") == "Project(a)\n  SetLabels(a:Flagged)\n    SetProps(a.age = 1)\n      NodeScan((a))"
    profile = run.session.run("PROFILE RETURN 1 AS x")[0]
    assert profile.profile[0] == "Project(1 AS x)" and "rows: 1" in profile.profile[-1]


def test_unneeded_joins_are_left_out(spark):
    nodes = spark.createDataFrame([(1,), (2,)], "id bigint")
    edges = spark.createDataFrame([(1, 1, 2)], "id bigint, src bigint, dst bigint")
    g = Graph(spark).add_nodes(nodes, ["N"]).add_edges(edges, "E", src_labels=[["N"]], dst_labels=[["N"]])
    plan = Session(spark, g).query("MATCH (a:N)-[:E]->(b:N) RETURN count(b) AS n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def test_storage(spark, tmp_path):
    root = str(tmp_path / "db")
    one, two = Session(spark, root=root), None
    one.run('CREATE (:P {n: 1})-[:R {w: 2.5}]->(:Q {t: date("2024-01-01")}); CREATE INDEX i FOR (n:P) ON (n.n)')
    two = Session(spark, root=root)
    assert rows(two, "MATCH (a:P)-[r]->(b) RETURN a.n AS n, r.w AS w, year(b.t) AS y") == [(1, 2.5, 2024)]
    assert [r[0] for r in rows(two, "SHOW INDEXES")] == ["i"]
    one.run("CREATE (:P {n: 2})")
    with pytest.raises(GraphError) as e:
        two.run("CREATE (:P {n: 3})")
    assert e.value.code == "Conflict" and e.value.retryable
    assert rows(one, "VACUUM")[0][0] > 0
    assert rows(Session(spark, root=root), "MATCH (a:P) RETURN count(*) AS n") == [(2,)]
    one.run("CREATE DATABASE other; USE other; CREATE (:Z)")
    assert rows(one, "MATCH (n) RETURN count(*) AS n") == [(1,)] and store.load(spark, f"{root}/other").version == 1
    assert ("other", True) in rows(one, "SHOW DATABASES")
    one.run("DROP DATABASE other CONFIRM")
    assert rows(one, "MATCH (n) RETURN count(*) AS n") == [(3,)]


def test_older_lines_run(run):
    run("CREATE NODE person {name: Alice, age: 30}")
    run("CREATE NODE person {name: Bob, age: 20}\nCREATE EDGE 1 -KNOWS-> 2 {since: 2020}")
    assert run("MATCH person WHERE age > 25") == [(1,)]
    assert run("EDGES 1 TO 2") == [(1,)] and run("NEIGHBORS 1") == [(2,)]
    assert run.session.run("GET NODE 1")[0].notifications == ["DeprecatedSyntax"]


def test_large_range_streams(run):
    result = run.session.run("UNWIND range(1, 200000) AS n RETURN n")[0]
    assert sum(len(b) for b in result.batches(1024)) == 200000


def test_timestamps_reach_the_scan(spark, tmp_path):
    import datetime as dt

    spark.createDataFrame([(1, dt.datetime(2024, 1, 1, 12)), (2, dt.datetime(2024, 1, 2)), (3, None)], "id bigint, at timestamp").write.parquet(str(tmp_path / "n"))
    session = Session(spark, Graph(spark).add_nodes(spark.read.parquet(str(tmp_path / "n")), ["N"]))
    ids = lambda cond: [r[0] for r in rows(session, f"MATCH (n:N) WHERE {cond} RETURN id(n) AS i ORDER BY i")]
    noon = 'datetime("2024-01-01T12:00:00")'
    assert ids(f"n.at >= {noon}") == [1, 2] and ids(f"n.at > {noon}") == [2] and ids(f"n.at <= {noon}") == [1] and ids(f"n.at < {noon}") == [] and ids(f"{noon} = n.at") == [1] and ids(f"n.at <> {noon}") == [2]
    zoned = 'datetime("2024-01-01T12:00:00Z")'
    assert ids(f"n.at >= {zoned}") == [2] and ids(f"n.at < {zoned}") == [1] and ids(f"n.at = {zoned}") == [] and ids('n.at > datetime("2024-01-01T11:59:59.9999999")') == [1, 2]
    df = session.query('MATCH (n:N) WHERE n.at >= datetime("2024-01-02T00:00:00") RETURN id(n) AS i')
    assert "GreaterThanOrEqual(at" in df._jdf.queryExecution().executedPlan().toString()
    session.run('MATCH (n:N) WHERE id(n) = 2 SET n.at = datetime("2030-01-01T00:00:00")')
    assert ids('n.at > datetime("2025-01-01T00:00:00")') == [2]


def test_a_lost_label_is_noticed(spark):
    nodes, edges = spark.createDataFrame([(1,), (2,)], "id bigint"), spark.createDataFrame([(1, 1, 2)], "id bigint, src bigint, dst bigint")
    session = Session(spark, Graph(spark).add_nodes(nodes, ["N"]).add_edges(edges, "E", src_labels=[["N"]], dst_labels=[["N"]]))
    session.run("MATCH (n:N) WHERE id(n) = 2 REMOVE n:N")
    assert rows(session, "MATCH (a:N)-[:E]->(b:N) RETURN count(b) AS n") == [(0,)]
    assert rows(session, "MATCH (a:N)-[:E]->(b) RETURN count(b) AS n") == [(1,)]


def test_writes_follow_row_order(spark):
    session = Session(spark)
    session.run("UNWIND range(0, 300) AS i CREATE (:S {i: i})")
    session.run("CREATE (:K); MATCH (s:S), (k:K) WITH s, k ORDER BY s.i DESC SET k.last = s.i")
    assert rows(session, "MATCH (k:K) RETURN k.last AS x") == [(0,)]
    session.run("MATCH (s:S) WITH s ORDER BY s.i DESC CREATE (:C {i: s.i})")
    assert rows(session, "MATCH (a:C), (b:C) WHERE a.i = b.i + 1 AND id(a) > id(b) RETURN count(*) AS n") == [(0,)]
    assert rows(session, "MATCH (c:C) RETURN max(id(c)) - min(id(c)) AS n") == [(300,)]

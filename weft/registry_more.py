"""More graph queries with their SQL: the smaller operators, the older language, and what is called without a script."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weft.checkpointing import shared_dir
from weft.errors import GraphError
from weft.operators import bulk
from weft.session import Session
from weft.sources import store
from weft.sources.graph import Graph
from weft.sources.tables import EDGES, NODES
from weft.streaming.edges import append_edges

_NATION, _REGION = 2 << 40, 1 << 40
_CLOCK = "epoch_us(ts) % 1000000"

SCRIPTS: dict[str, tuple[str, str | None]] = {
    "unit_row": ('RETURN 1 + 2 AS x, "a" AS s, true AS t, 1.5 AS f', "SELECT CAST(3 AS BIGINT) AS x, 'a' AS s, true AS t, CAST(1.5 AS DOUBLE) AS f"),
    "literals": ('RETURN 1 AS i, -2.5e3 AS f, "q\\"r" AS s, [1, 2] AS l, {a: 1, b: "x"}.b AS m, null IS NULL AS n', "SELECT CAST(1 AS BIGINT) AS i, CAST(-2500 AS DOUBLE) AS f, 'q\"r' AS s, [CAST(1 AS BIGINT), CAST(2 AS BIGINT)] AS l, 'x' AS m, true AS n"),
    "return_node": ("MATCH (r:Region) RETURN r", f"SELECT {_REGION} + r_regionkey AS r FROM region"),
    "bound_filter": ('MATCH (c:Customer) WHERE c.acctbal > 0 MATCH (c {mktsegment: "BUILDING"}) RETURN c.custkey AS ck', "SELECT c_custkey AS ck FROM customer WHERE c_acctbal > 0 AND c_mktsegment = 'BUILDING'"),
    "optional_outer_props": ("MATCH (n:Nation) OPTIONAL MATCH (s:Supplier {nationkey: n.nationkey}) RETURN n.nationkey AS nk, count(s) AS n", "SELECT CAST(n_nationkey AS BIGINT) AS nk, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "optional_hop_props": ("MATCH (r:Region) WITH r, r.regionkey * 5 AS k OPTIONAL MATCH (n:Nation {nationkey: k})-[:IN_REGION]->(r) RETURN r.regionkey AS rk, n.name AS name", "SELECT CAST(r_regionkey AS BIGINT) AS rk, n_name AS name FROM region LEFT JOIN nation ON n_regionkey = r_regionkey AND n_nationkey = r_regionkey * 5"),
    "optional_chain": ("MATCH (r:Region) OPTIONAL MATCH (r)<-[:IN_REGION]-(n:Nation)<-[:IN_NATION]-(s:Supplier) WHERE s.acctbal > 5000 RETURN r.regionkey AS rk, count(DISTINCT n) AS nations, count(s) AS suppliers", "SELECT CAST(r_regionkey AS BIGINT) AS rk, count(DISTINCT n_nationkey) AS nations, count(s_suppkey) AS suppliers FROM region LEFT JOIN (nation JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > 5000) ON n_regionkey = r_regionkey GROUP BY 1"),
    "theta_less": ("MATCH (a:Nation), (b:Nation) WHERE a.nationkey < b.nationkey RETURN a.nationkey AS a, count(*) AS n", "SELECT CAST(a.n_nationkey AS BIGINT) AS a, count(*) AS n FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey GROUP BY 1"),
    "grouped_empty": ("MATCH (p:Part) WHERE p.size > 100000 RETURN p.brand AS brand, count(*) AS n", "SELECT p_brand AS brand, count(*) AS n FROM part WHERE p_size > 100000 GROUP BY 1"),
    "union_chain": ("MATCH (n:Nation) RETURN n.regionkey AS k UNION MATCH (r:Region) RETURN r.regionkey AS k UNION ALL UNWIND [1, 99] AS k RETURN k", "SELECT * FROM (SELECT CAST(n_regionkey AS BIGINT) AS k FROM nation UNION SELECT r_regionkey FROM region) UNION ALL SELECT * FROM (VALUES (CAST(1 AS BIGINT)), (99)) AS t(k)"),
    "unary": ("MATCH (n:Nation) RETURN n.nationkey AS nk, -n.nationkey AS neg, +n.nationkey AS pos", "SELECT CAST(n_nationkey AS BIGINT) AS nk, -CAST(n_nationkey AS BIGINT) AS neg, CAST(n_nationkey AS BIGINT) AS pos FROM nation"),
    "xor": ("MATCH (n:Nation) WHERE n.nationkey > 10 XOR n.regionkey = 1 RETURN n.nationkey AS nk", "SELECT CAST(n_nationkey AS BIGINT) AS nk FROM nation WHERE (n_nationkey > 10) <> (n_regionkey = 1)"),
    "mixed_list": ('UNWIND [1, "a", 2.5, true, null, [1, 2], {k: 1}] AS x RETURN typeOf(x) AS t, x = 1 AS one', "SELECT * FROM (VALUES ('int', true), ('string', NULL), ('float', false), ('bool', NULL), ('null', NULL), ('list', NULL), ('map', NULL)) AS v(t, one)"),
    "map_shapes": ('UNWIND [{a: 1}, {b: 2, c: "z"}, {}] AS m RETURN keys(m) AS k, size(m) AS n, m.a AS a, m.c AS c', "SELECT ['a'] AS k, CAST(1 AS BIGINT) AS n, CAST(1 AS BIGINT) AS a, NULL AS c UNION ALL SELECT ['b', 'c'], 2, NULL, 'z' UNION ALL SELECT CAST([] AS VARCHAR[]), 0, NULL, NULL"),
    "map_values": ("UNWIND [{a: 1, b: 2}, {b: 3}] AS m RETURN values(m) AS v", "SELECT [CAST(1 AS BIGINT), 2] AS v UNION ALL SELECT [CAST(3 AS BIGINT)]"),
    "properties_fn": ("MATCH (r:Region) WITH properties(r) AS p RETURN p.name AS name, size(p) AS n, keys(p) AS k", "SELECT r_name AS name, CAST(2 AS BIGINT) AS n, ['name', 'regionkey'] AS k FROM region"),
    "string_pred_fns": ('MATCH (n:Nation) WHERE startsWith(n.name, "NATION_1") AND endsWith(n.name, "2") OR contains(n.name, "_2") RETURN n.name AS name', "SELECT n_name AS name FROM nation WHERE n_name LIKE 'NATION\\_1%' ESCAPE '\\' AND n_name LIKE '%2' OR contains(n_name, '_2')"),
    "rand_bounds": ("MATCH (n:Nation) WITH rand() AS r RETURN count(*) AS n, min(r) >= 0.0 AS lo, max(r) < 1.0 AS hi", "SELECT count(*) AS n, true AS lo, true AS hi FROM nation"),
    "conversions": ('MATCH (n:Nation) RETURN n.nationkey AS nk, toFloat(n.nationkey) / 2.0 AS half, toBool("false") AS f, size(bytes("AAEC")) AS b, toFloat("1e3") AS e', "SELECT CAST(n_nationkey AS BIGINT) AS nk, n_nationkey / 2.0::DOUBLE AS half, false AS f, CAST(3 AS BIGINT) AS b, CAST(1000 AS DOUBLE) AS e FROM nation"),
    "offset_seconds": ('RETURN offsetSeconds(datetime("2024-01-01T00:00:00+02:30")) AS o, offsetSeconds(datetime("2024-01-01T00:00:00Z")) AS z', "SELECT CAST(9000 AS BIGINT) AS o, CAST(0 AS BIGINT) AS z"),
    "duration_parts": ('WITH duration("P1Y2M3DT4H5M6.5S") AS d RETURN months(d) AS mo, days(d) AS da, hours(d) AS h, minutes(d) AS mi, seconds(d) AS s, nanoseconds(d) AS n', "SELECT CAST(14 AS BIGINT) AS mo, CAST(3 AS BIGINT) AS da, CAST(4 AS BIGINT) AS h, CAST(245 AS BIGINT) AS mi, CAST(14706 AS BIGINT) AS s, CAST(14706500000000 AS BIGINT) AS n"),
    "duration_math": ('RETURN days(duration("P3D") * 2 - duration("P1D")) AS a, days(duration("P7D") / 2) AS b, months(duration("P1M") + duration("P1Y")) AS c', "SELECT CAST(5 AS BIGINT) AS a, CAST(3 AS BIGINT) AS b, CAST(13 AS BIGINT) AS c"),
    "datetime_plus": ('MATCH (o:Order) WITH o.orderdate + duration("P1M1DT36H") AS t RETURN year(t) AS y, month(t) AS m, day(t) AS d, count(*) AS n', "SELECT year(t) AS y, month(t) AS m, day(t) AS d, count(*) AS n FROM (SELECT o_orderdate + INTERVAL 1 MONTH + INTERVAL 1 DAY + INTERVAL 36 HOUR AS t FROM orders) GROUP BY 1, 2, 3"),
    "datetime_minus": ('MATCH (o:Order) WITH o.orderdate - datetime("1992-01-01T00:00:00") AS d RETURN max(hours(d)) AS h, min(nanoseconds(d)) AS n', "SELECT max((epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1992-01-01')) // 3600000000) AS h, min(epoch_us(o_orderdate) - epoch_us(TIMESTAMP '1992-01-01')) * 1000 AS n FROM orders"),
    "clock_parts": ("MATCH (e:Event) RETURN month(e.ts) AS mo, day(e.ts) AS d, sum(minute(e.ts)) AS mi, sum(second(e.ts)) AS s, sum(millisecond(e.ts)) AS ms, sum(microsecond(e.ts)) AS us, sum(nanosecond(e.ts)) AS ns", f"SELECT month(ts) AS mo, day(ts) AS d, CAST(sum(minute(ts)) AS BIGINT) AS mi, CAST(sum(second(ts)) AS BIGINT) AS s, CAST(sum(({_CLOCK}) // 1000) AS BIGINT) AS ms, CAST(sum({_CLOCK}) AS BIGINT) AS us, CAST(sum(({_CLOCK}) * 1000) AS BIGINT) AS ns FROM events GROUP BY 1, 2"),
    "percentile_float": ("MATCH (p:Part) RETURN p.brand AS brand, percentileDisc(p.retailprice, 0.9) AS high, percentileDisc(p.retailprice, 0.0) AS low", "SELECT p_brand AS brand, percentile_disc(0.9) WITHIN GROUP (ORDER BY p_retailprice) AS high, min(p_retailprice) AS low FROM part GROUP BY 1"),
    "percentile_global": ("MATCH (o:Order) RETURN percentileDisc(o.totalprice, 0.25) AS p, percentileDisc(DISTINCT o.custkey, 0.5) AS c", "SELECT percentile_disc(0.25) WITHIN GROUP (ORDER BY o_totalprice) AS p, (SELECT percentile_disc(0.5) WITHIN GROUP (ORDER BY k) FROM (SELECT DISTINCT o_custkey AS k FROM orders)) AS c FROM orders"),
    "stdev_distinct": ("MATCH (p:Part) RETURN p.brand AS brand, toInt(round(stdev(DISTINCT p.size) * 10000)) AS sd", "SELECT p_brand AS brand, CAST(round(stddev_samp(DISTINCT p_size) * 10000) AS BIGINT) AS sd FROM part GROUP BY 1"),
    "all_shortest_none": ("MATCH (a:Region {regionkey: 0}), (b:Nation) MATCH p = allShortestPaths((a)-[:IN_REGION*]->(b)) RETURN b.nationkey AS nk, p IS NULL AS none, size(relationships(p)) AS n", "SELECT CAST(n_nationkey AS BIGINT) AS nk, false AS none, CAST(0 AS BIGINT) AS n FROM nation"),
    # mutation and administration
    "create_after_load": ('CREATE (t:Region {name: "new"}); MATCH (r:Region) RETURN count(DISTINCT id(r)) AS ids, count(*) AS n', "SELECT count(*) + 1 AS ids, count(*) + 1 AS n FROM region"),
    "create_edge_after_load": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) CREATE (r)-[:HAS {k: n.nationkey}]->(n); MATCH ()-[e]->() RETURN count(DISTINCT id(e)) - count(*) AS twice, sum(e.k) AS s", "SELECT CAST(0 AS BIGINT) AS twice, CAST(sum(n_nationkey) AS BIGINT) AS s FROM nation"),
    "set_plus_map": ("MATCH (r:Region) SET r += {extra: r.regionkey * 2}; MATCH (r:Region) RETURN r.name AS name, r.extra AS extra", "SELECT r_name AS name, CAST(r_regionkey * 2 AS BIGINT) AS extra FROM region"),
    "set_edge": ("MATCH (n:Nation)-[e:IN_REGION]->(r:Region) WHERE r.regionkey < 2 SET e.w = n.nationkey; MATCH ()-[e:IN_REGION]->() RETURN count(*) AS n, sum(e.w) AS s", "SELECT count(*) AS n, CAST(sum(n_nationkey) FILTER (n_regionkey < 2) AS BIGINT) AS s FROM nation"),
    "remove_prop": ("MATCH (r:Region) REMOVE r.name; MATCH (r:Region) RETURN r.regionkey AS rk, r.name IS NULL AS gone", "SELECT CAST(r_regionkey AS BIGINT) AS rk, true AS gone FROM region"),
    "merge_edge": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) MERGE (n)-[e:IN_REGION]->(r) MERGE (r)-[f:HOLDS]->(n) RETURN count(DISTINCT e) AS old, count(DISTINCT f) AS new", "SELECT count(*) AS old, count(*) AS new FROM nation"),
    "transaction_commit": ("BEGIN; MATCH (r:Region) WHERE r.regionkey = 0 DETACH DELETE r; COMMIT; MATCH (r:Region) RETURN count(*) AS n", "SELECT count(*) AS n FROM region WHERE r_regionkey <> 0"),
    "analyze": ("ANALYZE; MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS name, count(*) AS n", "SELECT r_name AS name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "show_indexes": ("CREATE INDEX by_size FOR (p:Part) ON (p.size); SHOW INDEXES", "SELECT 'by_size' AS name, 'node' AS entity, 'Part' AS label, ['size'] AS properties, false AS \"unique\", 'online' AS state"),
    "drop_index": ("CREATE INDEX by_size FOR (p:Part) ON (p.size); CREATE INDEX by_brand FOR (p:Part) ON (p.brand); DROP INDEX by_size; SHOW INDEXES", "SELECT 'by_brand' AS name, 'node' AS entity, 'Part' AS label, ['brand'] AS properties, false AS \"unique\", 'online' AS state"),
    "show_transactions": ("BEGIN; SHOW TRANSACTIONS", "SELECT CAST(1 AS BIGINT) AS id, 'READ WRITE' AS mode"),
    "show_labels": ("SHOW LABELS", "SELECT label FROM (VALUES ('Region'), ('Nation'), ('Customer'), ('Supplier'), ('Part'), ('Order'), ('User'), ('Turn'), ('Event')) AS t(label)"),
    # the older line language
    "legacy_create_node": ('CREATE NODE City {name: "x", size: 3}\nMATCH City WHERE size > 2', f"SELECT CAST({NODES} AS BIGINT) AS n"),
    "legacy_create_edge": (f"CREATE EDGE {_NATION}-FRIEND->{_NATION + 1} {{w: 2}}\nMATCH EDGE FRIEND WHERE w = 2", f"SELECT CAST({EDGES} AS BIGINT) AS e"),
    "legacy_update_node": (f'UPDATE NODE {_REGION} {{name: "zero"}}\nMATCH Region WHERE name = "zero"', f"SELECT CAST({_REGION} AS BIGINT) AS n"),
    "legacy_update_edge": (f"UPDATE EDGE {_REGION} {{w: 1}}\nMATCH EDGE IN_REGION WHERE w = 1", f"SELECT CAST({_REGION} AS BIGINT) AS e"),
    "legacy_delete": (f"DELETE EDGE {_REGION}\nDELETE NODE {_NATION + 1}\nMATCH EDGE IN_REGION", f"SELECT CAST({_REGION} + n_nationkey AS BIGINT) AS e FROM nation WHERE n_nationkey > 1"),
    "legacy_get_node": (f"GET NODE {_REGION + 1}", f"SELECT CAST({_REGION + 1} AS BIGINT) AS n"),
    "legacy_get_edge": (f"GET EDGE {_REGION + 3}", f"SELECT CAST({_REGION + 3} AS BIGINT) AS e"),
    "legacy_rollback": (f"BEGIN; DELETE NODE {_REGION}; ROLLBACK; MATCH Region", f"SELECT CAST({_REGION} + r_regionkey AS BIGINT) AS n FROM region"),
}


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark).rstrip('/')}/weft-graph-{uuid.uuid4().hex}"


def _small(graph: Graph) -> Graph:
    """Nations and regions alone."""
    keep = ("Region", "Nation")
    return graph.with_(nodes=tuple(t for t in graph.nodes if t.labels[0] in keep), edges=tuple(t for t in graph.edges if t.type == "IN_REGION"))


def _script(source: str, **session) -> Callable[[SparkSession, Graph], DataFrame]:
    params = session.pop("params", None)
    return lambda spark, graph: Session(spark, graph, **session).query(source, params)


def _errors(spark: SparkSession, graph: Graph) -> DataFrame:
    """Codes of statements that fail, and that what they began to write isn't there."""
    session, codes = Session(spark, graph), []
    session.run("CREATE CONSTRAINT one_name FOR (r:Region) REQUIRE r.name IS UNIQUE")
    for source in ('CREATE (:Region {name: "twice"}), (:Region {name: "twice"})', "MATCH (r:Region) DELETE r", "MATCH (r:Region) SET r.bad = 1 / (r.regionkey - r.regionkey)", "MATCH (n:Nation) RETURN sum(n.name) AS s"):
        try:
            session.run(source)[-1].rows()
        except GraphError as e:
            codes.append((e.code,))
    rest = session.query("MATCH (r:Region) RETURN count(*) AS n, count(r.bad) AS bad")
    return spark.createDataFrame(codes, "code string").groupBy("code").agg(F.count(F.lit(1)).alias("times")).crossJoin(F.broadcast(rest))  # one row


def _summary(spark: SparkSession, graph: Graph) -> DataFrame:
    counts = Session(spark, graph).run('CREATE (a:X {n: 1})-[:Y {w: 2}]->(b:X:Z {n: 3}) SET b.more = true')[0].summary
    return spark.createDataFrame(sorted((k, v) for k, v in counts.items() if v), "name string, n bigint")


def _exported(spark: SparkSession, graph: Graph) -> DataFrame:
    a, b = _folder(spark), _folder(spark)
    _small(graph).export(a)
    session = Session(spark, root=b)
    session.import_from(a)
    return session.query("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS name, count(*) AS n")


def _vacuumed(spark: SparkSession, graph: Graph) -> DataFrame:
    root = _folder(spark)
    store.save(_small(graph), f"{root}/default")
    session = Session(spark, root=root)
    session.run('MATCH (r:Region) WHERE r.regionkey = 1 SET r.name = "one"; MATCH (r:Region) WHERE r.regionkey = 2 DETACH DELETE r; VACUUM')
    return Session(spark, root=root).query("MATCH (r:Region) OPTIONAL MATCH (n:Nation)-[:IN_REGION]->(r) RETURN r.name AS name, count(n) AS n")


def _databases(spark: SparkSession, graph: Graph) -> DataFrame:
    session = Session(spark, root=_folder(spark))
    session.run("CREATE DATABASE one; CREATE DATABASE two; USE one; CREATE (:A); DROP DATABASE two CONFIRM")
    return session.query("SHOW DATABASES")


def _marked(spark: SparkSession, graph: Graph) -> DataFrame:
    session = Session(spark, _small(graph))
    session.run("BEGIN; MATCH (r:Region) WHERE r.regionkey = 0 DETACH DELETE r")
    mark = session.mark()
    session.run("MATCH (r:Region) DETACH DELETE r")
    session.rollback_to(mark)
    session.run("COMMIT")
    return session.query("MATCH (r:Region) RETURN r.regionkey AS rk")


def _streamed(spark: SparkSession, graph: Graph) -> DataFrame:
    """Two batches of edges appended to a stored graph, the second by a stream that goes on from the first's checkpoint."""
    root, source, checkpoint = _folder(spark), _folder(spark), _folder(spark)
    store.save(_small(graph), root)
    pairs = graph.edges_of("IN_REGION").select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    for part in range(2):
        pairs.filter(F.col("dst") % 2 == part).write.mode("append").parquet(source)
        stream = spark.readStream.schema("src bigint, dst bigint").parquet(source)
        append_edges(stream, "HOLDS", root, checkpoint).awaitTermination()
    return Session(spark, store.load(spark, root)).query("MATCH (r:Region)-[e:HOLDS]->(n:Nation) RETURN r.regionkey AS rk, count(DISTINCT id(e)) AS n")


_OF_REGION = "SELECT r_name AS name, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"

CALLS: dict[str, tuple[Callable[[SparkSession, Graph], DataFrame], str | None]] = {
    "parameters": (_script("MATCH (n:Nation) WHERE n.nationkey IN $keys AND n.regionkey = $region RETURN n.name AS name, $tag AS tag", params={"keys": list(range(1, 20)), "region": 2, "tag": "t"}), "SELECT n_name AS name, 't' AS tag FROM nation WHERE n_nationkey BETWEEN 1 AND 19 AND n_regionkey = 2"),
    "now_fixed": (_script("RETURN year(now()) AS y, dayOfWeek(now()) AS d", now="2024-05-06T07:08:09Z"), "SELECT CAST(2024 AS BIGINT) AS y, CAST(1 AS BIGINT) AS d"),
    "rand_seeded": (lambda spark, graph: Session(spark, graph, seed=3).query("MATCH (n:Nation) RETURN n.nationkey AS nk, rand() AS r").join(Session(spark, graph, seed=3).query("MATCH (n:Nation) RETURN n.nationkey AS nk, rand() AS r"), ["nk", "r"]).select("nk"), "SELECT CAST(n_nationkey AS BIGINT) AS nk FROM nation"),
    "profile": (_script("PROFILE MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS name, count(*) AS n"), _OF_REGION),
    "get_node": (lambda spark, graph: graph.get_node(_NATION + 4).select("id", F.col("labels")[0].alias("label"), F.col("p_name").alias("name")), f"SELECT {_NATION} + n_nationkey AS id, 'Nation' AS label, n_name AS name FROM nation WHERE n_nationkey = 4"),
    "get_edge": (lambda spark, graph: graph.get_edge(_REGION + 4).select("id", "src", "dst", "type"), f"SELECT {_REGION} + n_nationkey AS id, {_NATION} + n_nationkey AS src, {_REGION} + n_regionkey AS dst, 'IN_REGION' AS type FROM nation WHERE n_nationkey = 4"),
    "incident_edges": (lambda spark, graph: graph.incident_edges(_REGION).groupBy("type").agg(F.count(F.lit(1)).alias("n")), "SELECT 'IN_REGION' AS type, count(*) AS n FROM nation WHERE n_regionkey = 0"),
    "edges_between": (lambda spark, graph: graph.edges_between(_NATION + 7, _REGION + 2).select("id", "type"), f"SELECT {_REGION} + n_nationkey AS id, 'IN_REGION' AS type FROM nation WHERE n_nationkey = 7 AND n_regionkey = 2"),
    "nodes_by_equal": (lambda spark, graph: graph.nodes_by("Customer", "mktsegment", "=", "BUILDING").select(F.col("p_custkey").alias("ck")), "SELECT c_custkey AS ck FROM customer WHERE c_mktsegment = 'BUILDING'"),
    "nodes_by_range": (lambda spark, graph: graph.nodes_by("Part", "size", "RANGE", 10, 12).select(F.col("p_partkey").alias("pk")), "SELECT p_partkey AS pk FROM part WHERE p_size >= 10 AND p_size < 12"),
    "nodes_by_prefix": (lambda spark, graph: graph.nodes_by(None, "name", "STARTS WITH", "NATION_2").select(F.col("p_name").alias("name")), "SELECT n_name AS name FROM nation WHERE starts_with(n_name, 'NATION_2')"),
    "edges_by_value": (lambda spark, graph: graph.edges_by("CONTAINS", "quantity", ">=", 45.0).groupBy().agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM lineitem WHERE l_quantity >= 45"),
    "call_neighbors": (lambda spark, graph: bulk.neighbors(graph, 3 << 40, 2).filter(F.col("node") < 3 << 40), f"SELECT {_NATION} + c_nationkey AS node, 1 AS depth FROM customer WHERE c_custkey = 0 UNION ALL SELECT {_REGION} + n_regionkey, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey = 0"),
    "call_shortest_path": (lambda spark, graph: spark.createDataFrame([(bulk.shortest_path(graph, _NATION, _REGION),)], "nodes array<bigint>"), f"SELECT CASE WHEN n_regionkey = 0 THEN [CAST({_NATION} AS BIGINT), CAST({_REGION} AS BIGINT)] END AS nodes FROM nation WHERE n_nationkey = 0"),
    "call_depth_first": (lambda spark, graph: spark.createDataFrame([(bulk.depth_first(graph, _NATION),)], "nodes array<bigint>"), f"SELECT [CAST({_NATION} AS BIGINT), CAST({_REGION} + n_regionkey AS BIGINT)] AS nodes FROM nation WHERE n_nationkey = 0"),
    "call_add": (lambda spark, graph: Session(spark, graph.add_nodes(spark.createDataFrame([(NODES + 5, "x")], "id bigint, name string"), ["Region"]).add_edges(spark.createDataFrame([(EDGES + 1, _NATION, NODES + 5)], "id bigint, src bigint, dst bigint"), "IN_REGION")).query('MATCH (n:Nation)-[e:IN_REGION]->(r:Region {name: "x"}) RETURN n.nationkey AS nk, id(e) AS e'), f"SELECT CAST(0 AS BIGINT) AS nk, CAST({EDGES + 1} AS BIGINT) AS e"),
    "call_update": (lambda spark, graph: bulk.update_nodes(graph, graph.nodes_of("Region").select("id", F.lower("p_name").alias("name"))).nodes_of("Region").select(F.col("p_name").alias("name"), F.col("p_regionkey").alias("rk")), "SELECT lower(r_name) AS name, CAST(r_regionkey AS BIGINT) AS rk FROM region"),
    "call_update_edges": (lambda spark, graph: bulk.update_edges(graph, graph.edges_of("IN_REGION").select("id", (F.col("src") % 7).alias("w"))).edges_of("IN_REGION").groupBy().agg(F.sum("p_w").alias("s")), f"SELECT CAST(sum(({_NATION} + n_nationkey) % 7) AS BIGINT) AS s FROM nation"),
    "call_labels_change": (lambda spark, graph: Session(spark, bulk.change_labels(graph, graph.nodes_of("Region").filter("p_regionkey < 2"), add=["Low"])).query("MATCH (r:Low) RETURN r.name AS name, size(labels(r)) AS n"), "SELECT r_name AS name, CAST(2 AS BIGINT) AS n FROM region WHERE r_regionkey < 2"),
    "call_cascade_delete": (lambda spark, graph: bulk.delete_nodes(graph, graph.nodes_of("Region").filter("p_regionkey < 2")).edges_of("IN_REGION").groupBy("dst").agg(F.count(F.lit(1)).alias("n")), f"SELECT {_REGION} + n_regionkey AS dst, count(*) AS n FROM nation WHERE n_regionkey >= 2 GROUP BY 1"),
    "call_delete_edges": (lambda spark, graph: bulk.delete_edges(graph, graph.edges_of("IN_REGION").filter(F.col("dst") == _REGION)).edges_of("IN_REGION").groupBy().agg(F.count(F.lit(1)).alias("n")), "SELECT count(*) AS n FROM nation WHERE n_regionkey <> 0"),
    "summary_counters": (_summary, "SELECT * FROM (VALUES ('edges_created', CAST(1 AS BIGINT)), ('labels_added', 3), ('nodes_created', 2), ('properties_set', 4)) AS t(name, n)"),
    "errors_undo": (_errors, "SELECT code, times, (SELECT count(*) FROM region) AS n, CAST(0 AS BIGINT) AS bad FROM (VALUES ('ConstraintViolation', CAST(2 AS BIGINT)), ('InvalidArgument', 2)) AS t(code, times)"),
    "export_import": (_exported, _OF_REGION),
    "vacuum": (_vacuumed, "SELECT CASE WHEN r_regionkey = 1 THEN 'one' ELSE r_name END AS name, count(n_nationkey) AS n FROM region LEFT JOIN nation ON n_regionkey = r_regionkey WHERE r_regionkey <> 2 GROUP BY 1"),
    "databases": (_databases, "SELECT * FROM (VALUES ('default', false), ('one', true)) AS t(name, current)"),
    "savepoint": (_marked, "SELECT CAST(r_regionkey AS BIGINT) AS rk FROM region WHERE r_regionkey <> 0"),
    "stream_edges": (_streamed, "SELECT CAST(n_regionkey AS BIGINT) AS rk, count(*) AS n FROM nation GROUP BY 1"),
    "legacy_path": (lambda spark, graph: (lambda df: df.select(F.size(F.col(f"`{df.columns[0]}`")["nodes"]).alias("n")))(Session(spark, graph).query(f"PATH {_NATION} TO {_REGION}")), "SELECT CASE WHEN n_regionkey = 0 THEN 2 END AS n FROM nation WHERE n_nationkey = 0"),
}

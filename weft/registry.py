"""The graph queries and the SQL that checks them, over the benchmark tables (see sources.tables)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from weft.registry_more import CALLS, SCRIPTS
from weft.session import Session
from weft.sources.graph import Graph
from weft.sources.tables import tables_graph

#: name -> (script, SQL); the last statement's rows are the result.
CATALOG: dict[str, tuple[str, str | None]] = {
    # scans, filters, projection
    "scan_label": ("MATCH (n:Nation) RETURN n.nationkey AS nk, n.name AS name", "SELECT CAST(n_nationkey AS BIGINT) AS nk, n_name AS name FROM nation"),
    "scan_all": ("MATCH (n) RETURN count(*) AS n", "SELECT (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM conversations) + (SELECT count(*) FROM events) AS n"),
    "scan_multi_label": ("MATCH (n:Customer|Supplier) WHERE n.acctbal < 0 RETURN labels(n)[0] AS kind, count(*) AS n", "SELECT 'Customer' AS kind, count(*) AS n FROM customer WHERE c_acctbal < 0 HAVING count(*) > 0 UNION ALL SELECT 'Supplier', count(*) FROM supplier WHERE s_acctbal < 0 HAVING count(*) > 0"),
    "index_eq_map": ('MATCH (c:Customer {mktsegment: "BUILDING", nationkey: 3}) RETURN c.custkey AS ck', "SELECT c_custkey AS ck FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey = 3"),
    "declared_index": ("CREATE INDEX by_size FOR (p:Part) ON (p.size); MATCH (p:Part) WHERE p.size = 7 RETURN p.partkey AS pk", "SELECT p_partkey AS pk FROM part WHERE p_size = 7"),
    "range_filter": ("MATCH (p:Part) WHERE p.size >= 10 AND p.size < 12 RETURN p.partkey AS pk, p.size AS size", "SELECT p_partkey AS pk, CAST(p_size AS BIGINT) AS size FROM part WHERE p_size >= 10 AND p_size < 12"),
    "starts_with": ('MATCH (n:Nation) WHERE n.name STARTS WITH "NATION_1" RETURN n.name AS name', "SELECT n_name AS name FROM nation WHERE starts_with(n_name, 'NATION_1')"),
    "ends_contains": ('MATCH (n:Nation) WHERE n.name ENDS WITH "3" OR n.name CONTAINS "_2" RETURN n.name AS name', "SELECT n_name AS name FROM nation WHERE ends_with(n_name, '3') OR contains(n_name, '_2')"),
    "in_list": ("MATCH (o:Order) WHERE o.orderpriority IN [\"1-URGENT\", \"2-HIGH\"] RETURN o.orderpriority AS p, count(*) AS n", "SELECT o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') GROUP BY 1"),
    "null_predicates": ("MATCH (n) WHERE n.acctbal IS NULL AND n.nationkey IS NOT NULL RETURN n.nationkey AS nk", "SELECT CAST(n_nationkey AS BIGINT) AS nk FROM nation"),
    "case_when": ('MATCH (p:Part) RETURN CASE WHEN p.size < 10 THEN "small" WHEN p.size < 30 THEN "medium" ELSE "large" END AS class, count(*) AS n', "SELECT CASE WHEN p_size < 10 THEN 'small' WHEN p_size < 30 THEN 'medium' ELSE 'large' END AS class, count(*) AS n FROM part GROUP BY 1"),
    "case_simple": ('MATCH (o:Order) RETURN CASE o.orderstatus WHEN "F" THEN 1 WHEN "O" THEN 2 ELSE 3 END AS code, count(*) AS n', "SELECT CAST(CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 3 END AS BIGINT) AS code, count(*) AS n FROM orders GROUP BY 1"),
    "project_star": ("MATCH (r:Region) WITH r.regionkey AS rk, r.name AS name RETURN *", "SELECT CAST(r_regionkey AS BIGINT) AS rk, r_name AS name FROM region"),
    "return_distinct": ("MATCH (c:Customer) RETURN DISTINCT c.mktsegment AS segment", "SELECT DISTINCT c_mktsegment AS segment FROM customer"),
    "short_circuit": ("MATCH (n:Nation) WHERE n.nationkey <> 0 AND 24 / n.nationkey > 3 RETURN n.nationkey AS nk", "SELECT CAST(n_nationkey AS BIGINT) AS nk FROM nation WHERE n_nationkey <> 0 AND 24 // n_nationkey > 3"),
    # aggregation
    "count_star": ("MATCH (o:Order) RETURN count(*) AS n", "SELECT count(*) AS n FROM orders"),
    "count_distinct": ("MATCH (o:Order) RETURN count(DISTINCT o.custkey) AS n", "SELECT count(DISTINCT o_custkey) AS n FROM orders"),
    "sum_int": ("MATCH (p:Part) RETURN p.brand AS brand, sum(p.size) AS total", "SELECT p_brand AS brand, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY 1"),
    "avg_float": ("MATCH (p:Part) RETURN p.brand AS brand, round(avg(p.size) * 1000) AS mean", "SELECT p_brand AS brand, round(avg(p_size) * 1000) AS mean FROM part GROUP BY 1"),
    "min_max": ("MATCH (o:Order) RETURN o.orderstatus AS s, min(o.totalprice) AS lo, max(o.totalprice) AS hi", "SELECT o_orderstatus AS s, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders GROUP BY 1"),
    "collect_sorted": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, collect(n.name) AS names", "SELECT r_name AS region, list(n_name ORDER BY n_nationkey) AS names FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "collect_distinct": ("MATCH (c:Customer) WITH DISTINCT c.nationkey AS nk, c.mktsegment AS s ORDER BY s RETURN nk, size(collect(DISTINCT s)) AS n", "SELECT CAST(c_nationkey AS BIGINT) AS nk, count(DISTINCT c_mktsegment) AS n FROM customer GROUP BY 1"),
    "percentile_disc": ("MATCH (p:Part) RETURN p.brand AS brand, percentileDisc(p.size, 0.5) AS med", "SELECT p_brand AS brand, CAST(percentile_disc(0.5) WITHIN GROUP (ORDER BY p_size) AS BIGINT) AS med FROM part GROUP BY 1"),
    "stdev_sample": ("MATCH (p:Part) RETURN p.brand AS brand, toInt(round(stdev(p.size) * 10000)) AS sd", "SELECT p_brand AS brand, CAST(round(stddev_samp(p_size) * 10000) AS BIGINT) AS sd FROM part GROUP BY 1"),
    "group_by_null": ("MATCH (n:Nation|Part) RETURN n.regionkey AS rk, count(*) AS n", "SELECT CAST(n_regionkey AS BIGINT) AS rk, count(*) AS n FROM nation GROUP BY 1 UNION ALL SELECT NULL, count(*) FROM part"),
    "with_having": ("MATCH (c:Customer) WITH c.nationkey AS nk, count(*) AS n WHERE n > 55 RETURN nk, n", "SELECT CAST(c_nationkey AS BIGINT) AS nk, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 55"),
    "agg_expression": ("MATCH (p:Part) RETURN p.brand AS brand, 1 + count(*) * 2 AS x, max(p.size) - min(p.size) AS spread", "SELECT p_brand AS brand, 1 + count(*) * 2 AS x, CAST(max(p_size) - min(p_size) AS BIGINT) AS spread FROM part GROUP BY 1"),
    "global_empty": ("MATCH (p:Part) WHERE p.size > 100000 RETURN count(*) AS n, sum(p.size) AS s, size(collect(p.size)) AS c", "SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS s, CAST(0 AS BIGINT) AS c"),
    # order, sets, lists
    "order_nulls": ("MATCH (n:Nation|Region) RETURN n.name AS name, n.regionkey AS rk ORDER BY n.nationkey NULLS LAST, name", "SELECT n_name AS name, CAST(n_regionkey AS BIGINT) AS rk FROM (SELECT n_name, n_regionkey, n_nationkey FROM nation UNION ALL SELECT r_name, r_regionkey, NULL FROM region) ORDER BY n_nationkey NULLS LAST, n_name"),
    "skip_limit": ("MATCH (o:Order) RETURN o.orderkey AS ok ORDER BY ok SKIP 10 LIMIT 20", "SELECT o_orderkey AS ok FROM orders ORDER BY 1 LIMIT 20 OFFSET 10"),
    "topk": ("MATCH (o:Order) RETURN o.orderkey AS ok, o.totalprice AS price ORDER BY price DESC, ok LIMIT 25", "SELECT o_orderkey AS ok, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
    "union_distinct": ("MATCH (c:Customer) RETURN c.nationkey AS nk UNION MATCH (s:Supplier) RETURN s.nationkey AS nk", "SELECT CAST(c_nationkey AS BIGINT) AS nk FROM customer UNION SELECT s_nationkey FROM supplier"),
    "union_all": ("MATCH (n:Nation) RETURN n.name AS name UNION ALL MATCH (r:Region) RETURN r.name AS name", "SELECT n_name AS name FROM nation UNION ALL SELECT r_name FROM region"),
    "unwind_list": ("UNWIND [3, 1, null, 2] AS x RETURN x, x * x AS sq", "SELECT CAST(x AS BIGINT) AS x, CAST(x * x AS BIGINT) AS sq FROM (VALUES (3), (1), (NULL), (2)) AS t(x)"),
    "unwind_match": ("UNWIND [1, 2, 3] AS k MATCH (n:Nation) WHERE n.regionkey = k RETURN k, count(n) AS n", "SELECT CAST(n_regionkey AS BIGINT) AS k, count(*) AS n FROM nation WHERE n_regionkey IN (1, 2, 3) GROUP BY 1"),
    "list_comprehension": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.name AS region, collect(n.nationkey) AS ks RETURN region, [k IN ks WHERE k % 2 = 0 | k * 10] AS xs", "SELECT r_name AS region, list_transform(list_filter(list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey), lambda k: k % 2 = 0), lambda k: k * 10) AS xs FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "quantifiers": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.name AS region, collect(n.nationkey) AS ks RETURN region, ANY(k IN ks WHERE k > 20) AS a, ALL(k IN ks WHERE k >= 0) AS b, NONE(k IN ks WHERE k > 20) AS c, SINGLE(k IN ks WHERE k > 20) AS d", "SELECT r_name AS region, count(*) FILTER (n_nationkey > 20) > 0 AS a, true AS b, count(*) FILTER (n_nationkey > 20) = 0 AS c, count(*) FILTER (n_nationkey > 20) = 1 AS d FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "reduce_sum": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.name AS region, collect(n.nationkey) AS ks RETURN region, REDUCE(s = 0, k IN ks | s + k * k) AS total", "SELECT r_name AS region, CAST(sum(n_nationkey * n_nationkey) AS BIGINT) AS total FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "slice_index": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.name AS region, collect(n.nationkey) AS ks RETURN region, ks[1..3] AS mid, ks[0] AS first, ks[-1] AS last, ks[99] AS none", "SELECT region, ks[2:3] AS mid, ks[1] AS first, ks[-1] AS last, CAST(NULL AS BIGINT) AS none FROM (SELECT r_name AS region, list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey) AS ks FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1)"),
    "range_fn": ("UNWIND range(0, 20, 5) AS x RETURN x, size(range(x, 3)) AS n", "SELECT CAST(x AS BIGINT) AS x, CAST(greatest(0, 4 - x) AS BIGINT) AS n FROM range(0, 21, 5) AS t(x)"),
    # patterns
    "one_hop": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 200000 RETURN c.mktsegment AS segment, count(*) AS n", "SELECT c_mktsegment AS segment, count(*) AS n FROM customer JOIN orders ON o_custkey = c_custkey WHERE o_totalprice > 200000 GROUP BY 1"),
    "two_hop": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)-[:IN_REGION]->(r:Region) RETURN r.name AS region, count(c) AS n", "SELECT r_name AS region, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "incoming": ("MATCH (r:Region)<-[:IN_REGION]-(n:Nation) RETURN r.name AS region, count(*) AS n", "SELECT r_name AS region, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "undirected": ("MATCH (t:Turn)-[:NEXT]-(u:Turn) WHERE t.turn = 1 RETURN t.conv AS conv, count(u) AS n", "SELECT a.conv_id AS conv, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn IN (0, 2) WHERE a.turn = 1 GROUP BY 1"),
    "multi_type": ("MATCH (x)-[:IN_NATION|IN_REGION]->(y) RETURN count(*) AS n", "SELECT (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM nation) AS n"),
    "any_type": ("MATCH (x)-[e]->(y) RETURN type(e) AS t, count(*) AS n", "SELECT 'IN_REGION' AS t, count(*) AS n FROM nation UNION ALL SELECT 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'PLACED', count(*) FROM orders UNION ALL SELECT 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'DID', count(*) FROM events UNION ALL SELECT 'NEXT', (SELECT count(*) FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"),
    "edge_props": ('MATCH (o:Order)-[l:CONTAINS {returnflag: "R"}]->(p:Part) RETURN p.brand AS brand, sum(toInt(l.quantity)) AS qty', "SELECT p_brand AS brand, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag = 'R' GROUP BY 1"),
    "edge_ends": ("MATCH (n:Nation)-[e:IN_REGION]->(r:Region) RETURN count(*) AS n, sum(CASE WHEN startNode(e) = n AND endNode(e) = r THEN 1 ELSE 0 END) AS ok", "SELECT count(*) AS n, count(*) AS ok FROM nation"),
    "comma_join": ("MATCH (c:Customer), (s:Supplier) WHERE c.nationkey = s.nationkey RETURN c.nationkey AS nk, count(*) AS n", "SELECT CAST(c_nationkey AS BIGINT) AS nk, count(*) AS n FROM customer JOIN supplier ON c_nationkey = s_nationkey GROUP BY 1"),
    "theta_join": ("MATCH (a:Nation), (b:Nation) WHERE a.nationkey < b.nationkey AND a.regionkey = b.regionkey RETURN count(*) AS n", "SELECT count(*) AS n FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey AND a.n_regionkey = b.n_regionkey"),
    "cross_product": ("MATCH (a:Region), (b:Region) RETURN a.name AS x, b.name AS y", "SELECT a.r_name AS x, b.r_name AS y FROM region a CROSS JOIN region b"),
    "cycle_close": ("MATCH (c:Customer)-[:IN_NATION]->(n:Nation)<-[:IN_NATION]-(s:Supplier) RETURN n.name AS nation, count(*) AS n", "SELECT n_name AS nation, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN supplier ON s_nationkey = n_nationkey GROUP BY 1"),
    "isomorphism": ("MATCH (a:Order)-[:CONTAINS]->(p:Part)<-[:CONTAINS]-(b:Order) RETURN p.partkey AS pk, count(*) AS n", "SELECT l_partkey AS pk, count(*) * (count(*) - 1) AS n FROM lineitem GROUP BY 1 HAVING count(*) > 1"),
    "two_matches": ("MATCH (a:Order)-[:CONTAINS]->(p:Part) MATCH (p)<-[:CONTAINS]-(b:Order) RETURN p.partkey AS pk, count(*) AS n", "SELECT l_partkey AS pk, count(*) * count(*) AS n FROM lineitem GROUP BY 1"),
    "optional_match": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 300000 RETURN c.custkey AS ck, count(o) AS n", "SELECT c_custkey AS ck, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_totalprice > 300000 GROUP BY 1"),
    "optional_where_left": ("MATCH (n:Nation) OPTIONAL MATCH (s:Supplier)-[:IN_NATION]->(n) WHERE s.acctbal > n.nationkey * 400 RETURN n.nationkey AS nk, count(s) AS n", "SELECT CAST(n_nationkey AS BIGINT) AS nk, count(s_suppkey) AS n FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey AND s_acctbal > n_nationkey * 400 GROUP BY 1"),
    "optional_anti": ("MATCH (c:Customer) OPTIONAL MATCH (c)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 WITH c, count(o) AS n WHERE n = 0 RETURN c.custkey AS ck", "SELECT c_custkey AS ck FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "semi_join": ("MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 400000 RETURN DISTINCT c.custkey AS ck", "SELECT c_custkey AS ck FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)"),
    "path_functions": ("MATCH p = (t:Turn)-[:NEXT]->(u:Turn)-[:NEXT]->(v:Turn) RETURN t.conv AS conv, length(p) AS hops, size(nodes(p)) AS ns, size(relationships(p)) AS es", "SELECT a.conv_id AS conv, CAST(2 AS BIGINT) AS hops, CAST(3 AS BIGINT) AS ns, CAST(2 AS BIGINT) AS es FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = a.turn + 2"),
    "path_node_props": ("MATCH p = (t:Turn {turn: 0})-[:NEXT*2]->(v:Turn) RETURN t.conv AS conv, [x IN nodes(p) | x.role] AS roles", "SELECT a.conv_id AS conv, [a.role, b.role, c.role] AS roles FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = 1 JOIN conversations c ON a.conv_id = c.conv_id AND c.turn = 2 WHERE a.turn = 0"),
    "tpch_like_revenue": ("MATCH (n:Nation)<-[:IN_NATION]-(c:Customer)-[:PLACED]->(o:Order)-[l:CONTAINS]->(:Part) RETURN n.name AS nation, sum(toInt(l.quantity)) AS qty", "SELECT n_name AS nation, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS qty FROM nation JOIN customer ON c_nationkey = n_nationkey JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY 1"),
    # traversal
    "varlen_1_3": ("MATCH (t:Turn)-[k:NEXT*1..3]->(u:Turn) RETURN size(k) AS hops, count(*) AS n", "SELECT CAST(b.turn - a.turn AS BIGINT) AS hops, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn - a.turn BETWEEN 1 AND 3 GROUP BY 1"),
    "varlen_exact": ("MATCH (t:Turn {turn: 0})-[:NEXT*4]->(u:Turn) RETURN t.conv AS conv, u.turn AS turn", "SELECT conv_id AS conv, turn FROM conversations WHERE turn = 4"),
    "varlen_open": ("MATCH (t:Turn {turn: 0})-[k:NEXT*]->(u:Turn) RETURN t.conv AS conv, max(size(k)) AS far", "SELECT conv_id AS conv, CAST(max(turn) AS BIGINT) AS far FROM conversations GROUP BY 1 HAVING max(turn) > 0"),
    "varlen_undirected": ("MATCH (t:Turn {turn: 1})-[k:NEXT*1..2]-(u:Turn) RETURN t.conv AS conv, count(*) AS n", "SELECT a.conv_id AS conv, count(*) AS n FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND abs(b.turn - a.turn) BETWEEN 1 AND 2 WHERE a.turn = 1 GROUP BY 1"),
    "neighbors_depth": ("MATCH (t:Turn {turn: 0}) RETURN t.conv AS conv, size(neighbors(t, 2)) AS n", "SELECT conv_id AS conv, count(*) FILTER (turn BETWEEN 1 AND 2) AS n FROM conversations GROUP BY 1"),
    "degree_out_in_both": ('MATCH (n:Nation) RETURN n.nationkey AS nk, degree(n) AS o, degree(n, "in") AS i, degree(n, "both") AS b', "SELECT CAST(n_nationkey AS BIGINT) AS nk, CAST(1 AS BIGINT) AS o, c + s AS i, c + s + 1 AS b FROM (SELECT n_nationkey, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS c, (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS s FROM nation)"),
    "shortest_path_pattern": ("MATCH (a:Turn {turn: 0}), (b:Turn) WHERE a.conv = b.conv AND b.turn > 0 MATCH p = shortestPath((a)-[:NEXT*]->(b)) RETURN a.conv AS conv, b.turn AS turn, length(p) AS hops", "SELECT conv_id AS conv, turn, turn AS hops FROM conversations WHERE turn > 0"),
    "shortest_path_fn": ("MATCH (a:Turn {turn: 0}), (b:Turn) WHERE a.conv = b.conv RETURN a.conv AS conv, b.turn AS turn, length(shortestPath(b, a)) AS hops", "SELECT conv_id AS conv, turn, CASE WHEN turn = 0 THEN CAST(0 AS BIGINT) END AS hops FROM conversations"),
    "all_shortest": ("MATCH (o:Order)-[:CONTAINS]->(p:Part) WITH DISTINCT o, p RETURN o.orderkey AS ok, p.partkey AS pk, size(allShortestPaths(o, p)) AS n", "SELECT l_orderkey AS ok, l_partkey AS pk, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    "all_shortest_pattern": ("MATCH (o:Order)-[:CONTAINS]->(p:Part) WITH DISTINCT o, p MATCH q = allShortestPaths((o)-[:CONTAINS*]->(p)) RETURN o.orderkey AS ok, p.partkey AS pk, count(q) AS n", "SELECT l_orderkey AS ok, l_partkey AS pk, count(*) AS n FROM lineitem GROUP BY 1, 2"),
    # functions
    "string_fns": ('MATCH (n:Nation) RETURN toLower(n.name) AS low, toUpper(toLower(n.name)) AS up, size(n.name) AS len, substring(n.name, 1, 3) AS sub, replace(n.name, "A", "*") AS rep, split(n.name, "I") AS parts, trim("  x ") AS t, startsWith(n.name, "A") AS s', "SELECT lower(n_name) AS low, n_name AS up, length(n_name) AS len, substring(n_name, 2, 3) AS sub, replace(n_name, 'A', '*') AS rep, string_split(n_name, 'I') AS parts, 'x' AS t, n_name LIKE 'A%' AS s FROM nation"),
    "math_fns": ("MATCH (n:Nation) WITH n.nationkey AS k RETURN k, abs(5 - k) AS a, sign(k - 5) AS s, floor(k / 2.0) AS f, ceil(k / 2.0) AS c, k % 7 AS m, k / 3 AS d, toInt(sqrt(k * k)) AS q, toInt(k ^ 2) AS p, round(k / 4.0) AS r", "SELECT k, abs(5 - k) AS a, CAST(sign(k - 5) AS BIGINT) AS s, floor(k / 2.0) AS f, ceil(k / 2.0) AS c, k % 7 AS m, k // 3 AS d, k AS q, k * k AS p, round(CAST(k AS DOUBLE) / 4.0) AS r FROM (SELECT CAST(n_nationkey AS BIGINT) AS k FROM nation)"),
    "type_fns": ('MATCH (n:Nation) RETURN n.nationkey AS k, typeOf(n.name) AS a, typeOf(n.nothing) AS b, coalesce(n.nothing, n.name) AS c, toInt("12") + toInt(3.9) AS d, toFloat("1.5") AS e, toBool("TRUE") AS f, n.nationkey IS :: INT AS g, n.name IS NOT :: FLOAT AS h, toString(n.nationkey) AS i', "SELECT CAST(n_nationkey AS BIGINT) AS k, 'string' AS a, 'null' AS b, n_name AS c, CAST(15 AS BIGINT) AS d, CAST(1.5 AS DOUBLE) AS e, true AS f, true AS g, true AS h, CAST(n_nationkey AS VARCHAR) AS i FROM nation"),
    "list_fns": ("MATCH (n:Nation)-[:IN_REGION]->(r:Region) WITH r.name AS region, collect(n.nationkey) AS ks RETURN region, head(ks) AS h, last(ks) AS l, size(tail(ks)) AS t, reverse(ks) AS rv, 3 IN ks AS has", "SELECT r_name AS region, CAST(min(n_nationkey) AS BIGINT) AS h, CAST(max(n_nationkey) AS BIGINT) AS l, count(*) - 1 AS t, list(CAST(n_nationkey AS BIGINT) ORDER BY n_nationkey DESC) AS rv, count(*) FILTER (n_nationkey = 3) > 0 AS has FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1"),
    "map_fns": ("MATCH (r:Region) WITH r, {name: r.name, key: r.regionkey} AS m RETURN m.name AS name, m[\"key\"] AS k, keys(m) AS ks, keys(r) AS rk, size(m) AS n", "SELECT r_name AS name, CAST(r_regionkey AS BIGINT) AS k, ['key', 'name'] AS ks, ['name', 'regionkey'] AS rk, CAST(2 AS BIGINT) AS n FROM region"),
    "temporal_parts": ("MATCH (o:Order) RETURN year(o.orderdate) AS y, quarter(o.orderdate) AS q, count(*) AS n", "SELECT year(o_orderdate) AS y, quarter(o_orderdate) AS q, count(*) AS n FROM orders GROUP BY 1, 2"),
    "temporal_clock": ("MATCH (e:Event) RETURN dayOfWeek(e.ts) AS d, hour(e.ts) AS h, count(*) AS n", "SELECT isodow(ts) AS d, hour(ts) AS h, count(*) AS n FROM events GROUP BY 1, 2"),
    "date_arith": ('MATCH (o:Order) WITH o.orderkey AS ok, date(o.orderdate) AS d RETURN ok, d + duration("P1M2D") AS later, days(d - date("1992-01-01")) AS since', "SELECT o_orderkey AS ok, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH + INTERVAL 2 DAY AS DATE) AS later, CAST(CAST(o_orderdate AS DATE) - DATE '1992-01-01' AS BIGINT) AS since FROM orders"),
    "datetime_compare": ('MATCH (o:Order) WHERE o.orderdate >= datetime("1995-01-01T00:00:00") AND o.orderdate < datetime("1996-01-01T00:00:00") RETURN count(*) AS n', "SELECT count(*) AS n FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'"),
    # mutation: the script's last statement reads the new version
    "create_return": ('CREATE (a:Tag {name: "x"})-[:NEXT_TO {w: 2}]->(b:Tag {name: "y"}) RETURN a.name AS a, b.name AS b', "SELECT 'x' AS a, 'y' AS b"),
    "create_per_row": ("MATCH (n:Nation) CREATE (t:Twin {of: n.nationkey})-[:TWIN]->(n); MATCH (t:Twin)-[:TWIN]->(n:Nation) RETURN t.of AS k, n.name AS name", "SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS name FROM nation"),
    "merge_match_create": ('UNWIND ["ASIA", "ATLANTIS"] AS nm MERGE (r:Region {name: nm}) ON CREATE SET r.fresh = true RETURN nm, coalesce(r.fresh, false) AS fresh', "SELECT nm, NOT EXISTS (SELECT 1 FROM region WHERE r_name = nm) AS fresh FROM (VALUES ('ASIA'), ('ATLANTIS')) AS t(nm)"),
    "set_props": ("MATCH (r:Region) SET r.big = r.regionkey > 2, r.name = toLower(r.name); MATCH (r:Region) RETURN r.name AS name, r.big AS big", "SELECT lower(r_name) AS name, r_regionkey > 2 AS big FROM region"),
    "set_map": ("MATCH (r:Region) WHERE r.regionkey = 1 SET r = {name: \"one\"}; MATCH (r:Region) RETURN r.name AS name, r.regionkey AS rk", "SELECT CASE WHEN r_regionkey = 1 THEN 'one' ELSE r_name END AS name, CAST(CASE WHEN r_regionkey <> 1 THEN r_regionkey END AS BIGINT) AS rk FROM region"),
    "set_remove_label": ("MATCH (n:Nation) WHERE n.regionkey = 1 SET n:Marked; MATCH (n:Marked) WHERE n.nationkey < 10 REMOVE n:Marked; MATCH (n:Marked) RETURN n.nationkey AS nk, labels(n) AS ls", "SELECT CAST(n_nationkey AS BIGINT) AS nk, ['Marked', 'Nation'] AS ls FROM nation WHERE n_regionkey = 1 AND n_nationkey >= 10"),
    "detach_delete": ("MATCH (n:Nation) WHERE n.regionkey = 1 DETACH DELETE n; MATCH (n:Nation)-[:IN_REGION]->(r) RETURN n.nationkey AS nk, degree(n, \"in\") AS d", "SELECT CAST(n_nationkey AS BIGINT) AS nk, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) + (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS d FROM nation WHERE n_regionkey <> 1"),
    "delete_edges": ("MATCH (n:Nation)-[e:IN_REGION]->(r:Region) WHERE r.regionkey < 2 DELETE e; MATCH (n:Nation)-[:IN_REGION]->(r:Region) RETURN r.regionkey AS rk, count(*) AS n", "SELECT CAST(n_regionkey AS BIGINT) AS rk, count(*) AS n FROM nation WHERE n_regionkey >= 2 GROUP BY 1"),
    "transaction_rollback": ("BEGIN; MATCH (r:Region) DETACH DELETE r; ROLLBACK; MATCH (r:Region) RETURN count(*) AS n", "SELECT count(*) AS n FROM region"),
    # catalog
    "call_labels": ("CALL db.labels() YIELD label RETURN label", "SELECT label FROM (VALUES ('Region'), ('Nation'), ('Customer'), ('Supplier'), ('Part'), ('Order'), ('User'), ('Turn'), ('Event')) AS t(label)"),
    "call_edge_types": ("CALL db.edgeTypes() YIELD edgeType AS t WHERE t STARTS WITH \"I\" RETURN t", "SELECT t FROM (VALUES ('IN_NATION'), ('IN_REGION')) AS x(t)"),
    "call_property_keys": ("CALL db.propertyKeys() YIELD propertyKey WHERE propertyKey STARTS WITH \"n\" RETURN propertyKey", "SELECT propertyKey FROM (VALUES ('name'), ('nationkey')) AS t(propertyKey)"),
    "show_stats": ("SHOW STATS", "SELECT kind, name, n AS \"count\" FROM (SELECT 'label' AS kind, 'Region' AS name, count(*) AS n FROM region UNION ALL SELECT 'label', 'Nation', count(*) FROM nation UNION ALL SELECT 'label', 'Customer', count(*) FROM customer UNION ALL SELECT 'label', 'Supplier', count(*) FROM supplier UNION ALL SELECT 'label', 'Part', count(*) FROM part UNION ALL SELECT 'label', 'Order', count(*) FROM orders UNION ALL SELECT 'label', 'User', count(DISTINCT user_id) FROM events UNION ALL SELECT 'label', 'Turn', count(*) FROM conversations UNION ALL SELECT 'label', 'Event', count(*) FROM events UNION ALL SELECT 'type', 'IN_REGION', count(*) FROM nation UNION ALL SELECT 'type', 'IN_NATION', (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) UNION ALL SELECT 'type', 'PLACED', count(*) FROM orders UNION ALL SELECT 'type', 'CONTAINS', count(*) FROM lineitem UNION ALL SELECT 'type', 'DID', count(*) FROM events UNION ALL SELECT 'type', 'NEXT', count(*) FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 UNION ALL SELECT 'nodes', NULL, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM part) + (SELECT count(*) FROM orders) + (SELECT count(DISTINCT user_id) FROM events) + (SELECT count(*) FROM conversations) + (SELECT count(*) FROM events) UNION ALL SELECT 'edges', NULL, (SELECT count(*) FROM nation) + (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM orders) + (SELECT count(*) FROM lineitem) + (SELECT count(*) FROM events) + (SELECT count(*) FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1))"),
    "show_constraints": ("CREATE CONSTRAINT one_name FOR (r:Region) REQUIRE r.name IS UNIQUE; CREATE CONSTRAINT has_key FOR (n:Nation) REQUIRE n.nationkey IS NOT NULL; SHOW CONSTRAINTS", "SELECT 'one_name' AS name, 'UNIQUE' AS kind, 'node' AS entity, 'Region' AS label, 'name' AS property, CAST(NULL AS VARCHAR) AS type UNION ALL SELECT 'has_key', 'EXISTS', 'node', 'Nation', 'nationkey', NULL"),
    "explain_plan": ("EXPLAIN MATCH (c:Customer)-[:PLACED]->(o:Order) WHERE o.totalprice > 200000 RETURN c.mktsegment AS segment, count(*) AS n", "SELECT plan FROM (VALUES ('Aggregate(c.mktsegment AS segment, count(*) AS n)'), ('  Filter(o.totalprice > 200000)'), ('    Expand((c)-[:PLACED]->(o:Order))'), ('      LabelScan((c:Customer))')) AS t(plan)"),
    # the older line language
    "legacy_match": ("MATCH Nation WHERE nationkey > 20", "SELECT CAST(2 * 1099511627776 + n_nationkey AS BIGINT) AS n FROM nation WHERE n_nationkey > 20"),
    "legacy_edges": ("EDGES 2199023255555 TO 1099511627779", "SELECT CAST(1099511627776 + n_nationkey AS BIGINT) AS e FROM nation WHERE n_nationkey = 3 AND n_regionkey = 3"),
    "legacy_neighbors": ("NEIGHBORS 2199023255552 DEPTH 2", "SELECT CAST(1099511627776 + n_regionkey AS BIGINT) AS m FROM nation WHERE n_nationkey = 0"),
}
FLAGSHIP = "one_hop"


_graphs: dict[tuple[str, str], Graph] = {}


def _graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The tables' graph: plans only, kept so that file footers aren't read for each query."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _graphs:
        _graphs[key] = tables_graph(spark, sf_dir)
    return _graphs[key]


def _query(script: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: Session(spark, _graph(spark, sf_dir)).query(script)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(CATALOG[FLAGSHIP][0])(spark, sf_dir)


def _call(of: Callable[[SparkSession, Graph], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: of(spark, _graph(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    scripts = {name: _query(script) for name, (script, _) in (CATALOG | SCRIPTS).items()}
    return scripts | {name: _call(of) for name, (of, _) in CALLS.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in (CATALOG | SCRIPTS | CALLS).items() if sql}

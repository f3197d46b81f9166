import pytest

from weft.errors import GraphError
from weft.operators import bulk
from weft.session import Session

ENDS = "MATCH (a:N {i: 0}), (b:N {i: 5})"


@pytest.fixture
def chain(spark):
    session = Session(spark, max_hops=3)
    session.run("CREATE (:N {i: 0})-[:E]->(:N {i: 1})-[:E]->(:N {i: 2})-[:E]->(:N {i: 3})-[:E]->(:N {i: 4})-[:E]->(:N {i: 5})")
    return session


def test_function_and_call_have_no_cap(chain):
    got = chain.run(f"{ENDS} RETURN length(shortestPath(a, b)) AS h, size(allShortestPaths(a, b)) AS n, shortestPath(b, a) IS NULL AS none")[-1].rows()
    assert got == [(5, 1, True)]
    a, b = chain.run(f"{ENDS} RETURN id(a) AS a, id(b) AS b")[-1].rows()[0]
    assert len(bulk.shortest_path(chain.graph, a, b)) == 6
    with pytest.raises(GraphError, match="limit of 3"):
        bulk.shortest_path(chain.graph, a, b, max_hops=3)


@pytest.mark.parametrize("bound", ["*", "*..9"])
def test_pattern_past_the_cap_is_an_error(chain, bound):
    with pytest.raises(GraphError) as e:
        chain.run(f"{ENDS} MATCH p = shortestPath((a)-[:E{bound}]->(b)) RETURN length(p) AS h")[-1].rows()
    assert e.value.code == "ResourceExhausted"
    near = "MATCH (a:N {i: 0}), (b:N {i: 2}) MATCH p = shortestPath((a)-[:E*]->(b)) RETURN length(p) AS h"
    assert chain.run(near)[-1].rows() == [(2,)]

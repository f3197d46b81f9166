import duckdb
import pytest

from weft import registry

SF = "/root/testdata/sf0.001"
SOME = ["one_hop", "tpch_like_revenue", "optional_where_left", "isomorphism", "varlen_1_3", "degree_out_in_both", "all_shortest", "collect_sorted", "date_arith", "set_map", "detach_delete", "legacy_neighbors", "map_shapes", "mixed_list", "optional_outer_props", "theta_less", "percentile_float", "create_after_load", "legacy_update_node", "call_neighbors", "errors_undo", "stream_edges"]


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for name in "region nation customer supplier part orders lineitem events conversations".split():
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", SOME)
def test_query_equals_sql(spark, tables, name):
    df = registry.queries()[name](spark, SF)
    found = tables.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in found.description]
    assert sorted(columns) == sorted(df.columns)
    shown = lambda rows: sorted(str(list(r)) for r in rows)
    assert shown(df.select(*columns).collect()) == shown(found.fetchall())


def test_every_query_is_known():
    assert set(registry.oracle_sql()) <= set(registry.queries()) and registry.FLAGSHIP in registry.CATALOG
